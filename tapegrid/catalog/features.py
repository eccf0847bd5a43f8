"""Queries over the grid and its feature blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapegrid.catalog.registry import query
from tapegrid.catalog.sqlbase import SW, clamp, define, q, roll, sdiv, zscore
from tapegrid.operators import asof, features as fe, grid as gr
from tapegrid.operators.windows import SESSION
from tapegrid.plans import fixtures as fx

CFG = fx.FIXTURE


def grid(spark, d):
    return gr.session_grid(fx.ticks(spark, d), CFG)


def price_grid(spark, d):
    return fe.price_context(grid(spark, d), CFG)


@query("fea01_session_grid_asof",
       "symbol:s session_date:d bar:i spot:6 age_min:i minutes_to_close:2 session_frac:6 session_sin:6 session_cos:6 dow:0",
       q("""select symbol, session_date, bar, spot, bar - src as age_min, 390.0 - bar as minutes_to_close,
            bar / 390.0 as session_frac, sin(2 * pi() * bar / 390.0) as session_sin,
            cos(2 * pi() * bar / 390.0) as session_cos, isodow(session_date) - 1 as dow from grid"""))
def _(spark, d):
    return grid(spark, d)


@query("flt01_regular_hours", "symbol:s session_date:d n:i lo:4 hi:4",
       q("select symbol, session_date, count(*) as n, min(spot) as lo, max(spot) as hi from rth group by 1, 2"))
def _(spark, d):
    t = gr.with_session(gr.regular_hours(fx.ticks(spark, d), CFG), CFG)
    return t.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n"), F.min("spot").alias("lo"), F.max("spot").alias("hi"))


@query("jn10_asof_backward", "seq:i symbol:s premium:4 quote:4 quote_seq:i",
       q("""select t.seq, t.symbol, t.premium, k.spot as quote, k.seq as quote_seq
            from (select * from prints where trade_type = 'block') t
            asof left join (select ticks.* from ticks join events on seq = event_id where event_type <> 'purchase') k
            on t.symbol = k.symbol and t.ts >= k.ts"""))
def _(spark, d):
    ev = fx.table(spark, d, "events").selectExpr(
        "event_id as seq", "concat('S', cast(user_id % 2 as string)) as symbol", "cast(ts as timestamp) as ts",
        "event_type", "value as premium", "100.0 + value as quote", "event_id as quote_seq")
    trades = ev.filter("event_type = 'purchase'").select("seq", "symbol", "ts", "premium")
    quotes = ev.filter("event_type <> 'purchase'").select("seq", "symbol", "ts", "quote", "quote_seq")
    return asof.asof_backward(trades, quotes, ["symbol"], ["quote", "quote_seq"])


PRICE = ("symbol:s session_date:d bar:i spot:6 ret_1m:8 ret_5m:8 ret_15m:8 ret_30m:8 rv_1m:8 ret_from_open:8 "
         "session_range:6 pos_in_session_range:6 dist_to_session_high:6 dist_to_session_low:6 dist_to_twap:8")
define("price0", f"""select symbol, session_date, bar, spot, ln(spot) as lp,
    ln(spot) - lag(ln(spot), 1) over {SW} as ret_1m, ln(spot) - lag(ln(spot), 5) over {SW} as ret_5m,
    ln(spot) - lag(ln(spot), 15) over {SW} as ret_15m, ln(spot) - lag(ln(spot), 30) over {SW} as ret_30m,
    max(spot) over {SW} as hi, min(spot) over {SW} as lo,
    first_value(ln(spot) ignore nulls) over {SW} as lp0, sum(spot) over {SW} / (bar / 5.0 + 1) as twap from grid""")
define("price", f"""select symbol, session_date, bar, spot, ret_1m, ret_5m, ret_15m, ret_30m,
    greatest(1e-4, nullif({roll('ret_1m', 30, 'stddev_samp', 5)}, null)) as rv_raw,
    case when ({roll('ret_1m', 30, 'stddev_samp', 5)}) is not null
        then greatest(1e-4, {roll('ret_1m', 30, 'stddev_samp', 5)}) end as rv_1m,
    lp - lp0 as ret_from_open, hi - lo as session_range,
    greatest(0.0, least(1.0, {sdiv('spot - lo', '(hi - lo)', '0.5')})) as pos_in_session_range,
    hi - spot as dist_to_session_high, spot - lo as dist_to_session_low, spot - twap as dist_to_twap from price0""")


@query("fea02_price_context", PRICE, q("select * from price"))
def _(spark, d):
    return price_grid(spark, d)


define("gdaily", """select symbol, session_date, arg_min(spot, bar) filter (spot is not null) as open,
    arg_max(spot, bar) filter (spot is not null) as close, max(spot) as high, min(spot) as low
    from grid group by 1, 2""")


@query("agg01_daily_ohlc", "symbol:s session_date:d open:6 high:6 low:6 close:6", q("select * from gdaily"))
def _(spark, d):
    return fe.daily_table(grid(spark, d))


define("hist", """select symbol, session_date, pc as hist_prior_close, lag(r) over w as hist_prior_ret,
    lag((high - low) / close) over w as hist_prior_range_pct, ln(open / pc) as hist_gap_pct
    from (select *, ln(close / pc) as r from (select *, lag(close) over w as pc from gdaily
        window w as (partition by symbol order by session_date)))
    window w as (partition by symbol order by session_date)""")


@query("win12_prior_session_lag", "symbol:s session_date:d hist_prior_close:6 hist_prior_ret:8 hist_prior_range_pct:8 hist_gap_pct:8",
       q("select * from hist"))
def _(spark, d):
    return fe.prior_session_table(fe.daily_table(grid(spark, d)))


@query("fea03_prior_session",
       "symbol:s session_date:d bar:i hist_prior_close:6 hist_prior_ret:8 hist_prior_range_pct:8 hist_gap_pct:8 dist_to_prior_close:6",
       q("""select g.symbol, g.session_date, g.bar, hist_prior_close, hist_prior_ret, hist_prior_range_pct, hist_gap_pct,
            g.spot - hist_prior_close as dist_to_prior_close
            from grid g left join hist h on g.symbol = h.symbol and g.session_date = h.session_date"""))
def _(spark, d):
    return fe.prior_session(grid(spark, d))


define("premrows", """select l.symbol, l.session_date, cast(ceil(l.us / 300000000.0) * 5 - 570 as int) as bar, l.strike,
    call_ask_prem is not null and call_bid_prem is not null and put_ask_prem is not null and put_bid_prem is not null as ok,
    call_prem, put_prem, call_ask_prem - call_bid_prem as wc, put_ask_prem - put_bid_prem as wp from ladder l""")
define("prembars", """select p.symbol, p.session_date, p.bar, count(*) as n, sum(cast(ok as int)) as k
    from premrows p join grid g on p.symbol = g.symbol and p.session_date = g.session_date and p.bar = g.bar group by 1, 2, 3""")
define("premflag", f"""select symbol, session_date, bar, case when sum(k) over {SW} * 1.0 / sum(n) over {SW} > 0.5 then 1.0 else 0.0 end as side_w from prembars""")
define("premium", """select symbol, session_date, bar, sum(sc) as call_prem_1m, sum(sp) as put_prem_1m,
    sum(case when strike > spot then sc else 0 end) as otm_call_prem_1m,
    sum(case when strike < spot then sp else 0 end) as otm_put_prem_1m, sum(sc) - sum(sp) as net_prem_1m,
    max(side_w) as flow_side_weighted
    from (select p.*, g.spot, f.side_w, case when side_w > 0 then coalesce(wc, 0) else coalesce(call_prem, 0) end as sc,
          case when side_w > 0 then coalesce(wp, 0) else coalesce(put_prem, 0) end as sp
          from premrows p join grid g on p.symbol = g.symbol and p.session_date = g.session_date and p.bar = g.bar
          join premflag f on p.symbol = f.symbol and p.session_date = f.session_date and p.bar = f.bar) group by 1, 2, 3""")


@query("agg02_bar_premium",
       "symbol:s session_date:d bar:i call_prem_1m:4 put_prem_1m:4 otm_call_prem_1m:4 otm_put_prem_1m:4 net_prem_1m:4 flow_side_weighted:0",
       q("select * from premium"))
def _(spark, d):
    return fe.bar_premium(fx.ladder(spark, d), grid(spark, d), CFG)


def switched(spark, d, scope):
    rows = fe.strike_premium(fx.ladder(spark, d), CFG).join(grid(spark, d).select(*SESSION, "bar"), [*SESSION, "bar"])
    return fe.feed_switch(rows, scope)


@query("agg03_feed_switch", "symbol:s session_date:d bar:i flow_side_weighted:0",
       q("select symbol, session_date, bar, side_w as flow_side_weighted from premflag"))
def _(spark, d):
    return switched(spark, d, "causal").select(*SESSION, "bar", "flow_side_weighted").distinct()


@query("agg03_feed_switch_session", "symbol:s session_date:d flow_side_weighted:0",
       q("select symbol, session_date, case when sum(k) * 1.0 / sum(n) > 0.5 then 1.0 else 0.0 end as flow_side_weighted from prembars group by 1, 2"))
def _(spark, d):
    return switched(spark, d, "session").groupBy(*SESSION).agg(F.max("flow_side_weighted").alias("flow_side_weighted"))


define("prem0", f"""select g.symbol, g.session_date, g.bar, {', '.join(
    f'coalesce(p.{c}, 0.0) as {c}' for c in fe.PREMIUM_COLS)}, coalesce(last_value(f.side_w ignore nulls) over (partition by g.symbol, g.session_date order by g.bar rows between unbounded preceding and current row), 0.0) as flow_side_weighted
    from grid g left join premium p on g.symbol = p.symbol and g.session_date = p.session_date and g.bar = p.bar
    left join premflag f on g.symbol = f.symbol and g.session_date = f.session_date and g.bar = f.bar""")
define("prem1", f"""select *, {', '.join(f"{roll('net_prem_1m', n, 'sum')} as net_prem_{n}m" for n in (5, 15))},
    sum(net_prem_1m) over {SW} as net_prem_cum_session,
    greatest(-50.0, least(50.0, {sdiv('(' + roll('call_prem_1m', 15, 'sum') + ')', 'abs(' + roll('put_prem_1m', 15, 'sum') + ')')}))
        as call_put_prem_ratio_15m,
    {roll('otm_call_prem_1m', 5, 'sum')} as oc, {roll('otm_put_prem_1m', 5, 'sum')} as op from prem0""")
define("prem2", f"""select *, {', '.join(f"{zscore(f'net_prem_{n}m')} as net_prem_z_{n}m, net_prem_{n}m - lag(net_prem_{n}m) over {SW} as net_prem_vel_{n}m" for n in (5, 15))},
    oc - 2 * lag(oc, 1) over {SW} + lag(oc, 2) over {SW} as otm_call_accel,
    op - 2 * lag(op, 1) over {SW} + lag(op, 2) over {SW} as otm_put_accel from prem1""")
define("prem3", f"""select *, {', '.join(f"{zscore(f'net_prem_vel_{n}m')} as net_prem_vel_z_{n}m" for n in (5, 15))},
    greatest(-1.0, least(1.0, {sdiv('otm_call_accel - otm_put_accel', '(abs(otm_call_accel) + abs(otm_put_accel))')})) as otm_skew_momentum,
    ln((coalesce(abs(otm_call_accel), 0) + 1) / (coalesce(abs(otm_put_accel), 0) + 1))
        * sign(coalesce(otm_call_accel - otm_put_accel, 0)) as otm_skew_log_ratio,
    greatest(-1.0, least(1.0, {sdiv('oc - op', '(abs(oc) + abs(op))')})) as otm_skew_level from prem2""")


@query("fea04_net_premium",
       "symbol:s session_date:d bar:i net_prem_1m:4 net_prem_5m:4 net_prem_15m:4 net_prem_z_5m:5 net_prem_z_15m:5 "
       "net_prem_vel_5m:4 net_prem_vel_15m:4 net_prem_vel_z_5m:5 net_prem_vel_z_15m:5 net_prem_cum_session:4 "
       "call_put_prem_ratio_15m:6 otm_call_accel:4 otm_put_accel:4 otm_skew_momentum:6 otm_skew_log_ratio:6 otm_skew_level:6",
       q("select * from prem3"))
def _(spark, d):
    g = grid(spark, d)
    return fe.premium_block(g, fe.bar_premium(fx.ladder(spark, d), g, CFG))


define("flow", """select symbol, session_date, cast(ceil(us / 300000000.0) * 5 - 570 as int) as bar,
    sum(case when trade_type in ('block', 'dark_pool') then premium else 0 end) as blk,
    sum(case when trade_type = 'dark_pool' then premium else 0 end) as dark,
    sum(case when trade_type = 'sweep' then premium else 0 end) as swp, sum(premium) as all_prem,
    sum(case when trade_type in ('block', 'dark_pool') then premium else 0 end
        * case when side in ('ask', 'buy') then 1 when side in ('bid', 'sell') then -1 else 0 end
        * case upper(left(option_type, 1)) when 'C' then 1 when 'P' then -1 else 0 end) as sblk
    from prints group by 1, 2, 3""")


@query("agg04_flow_notional", "symbol:s session_date:d bar:i blk:4 dark:4 swp:4 all_prem:4 sblk:4",
       q("select * from flow where bar between 0 and 390"))
def _(spark, d):
    return fe.bar_flow(fx.prints(spark, d), CFG)


define("flow1", f"""select g.symbol, g.session_date, g.bar, {', '.join(f'coalesce(f.{c}, 0.0) as {c}' for c in fe.FLOW_COLS)}
    from grid g left join flow f on g.symbol = f.symbol and g.session_date = f.session_date and g.bar = f.bar""")
define("flow2", f"select symbol, session_date, bar, {', '.join(f'{roll(c, 15, chr(115) + chr(117) + chr(109))} as r_{c}' for c in fe.FLOW_COLS)} from flow1")
define("flow3", f"""select symbol, session_date, bar, r_blk as block_notional_15m, r_swp as sweep_notional_15m,
    greatest(0.0, least(1.0, {sdiv('r_blk', '(r_blk + r_swp)')})) as inst_block_weight,
    greatest(0.0, least(1.0, {sdiv('r_dark', 'r_all_prem')})) as dark_pool_share,
    {zscore('gap')} as block_vs_sweep_z, greatest(-1.0, least(1.0, {sdiv('r_sblk', 'r_blk')})) as block_signed_bias
    from (select *, r_blk - r_swp as gap from flow2)""")


@query("fea05_block_sweep",
       "symbol:s session_date:d bar:i block_notional_15m:4 sweep_notional_15m:4 inst_block_weight:6 dark_pool_share:6 "
       "block_vs_sweep_z:5 block_signed_bias:6", q("select * from flow3"))
def _(spark, d):
    return fe.block_sweep(grid(spark, d), fe.bar_flow(fx.prints(spark, d), CFG))


_RNG = "nullif(high - low, 0)"
define("candle", f"""select b.symbol, b.session_date, b.bar, {_RNG} / spot * 1e4 as bar_range_bp,
    {clamp(f'(spot - open) / {_RNG}', '-1.0', '1.0')} as bar_body_frac,
    {clamp(f'(high - greatest(open, spot)) / {_RNG}', '0.0', '1.0')} as upper_wick_frac,
    {clamp(f'(least(open, spot) - low) / {_RNG}', '0.0', '1.0')} as lower_wick_frac, vol_avg_30,
    (volume - vol_avg_30) / nullif(sd, 0) as vol_z_30, volume / nullif(avg_v, 0) as vol_ratio_session,
    cum_v / nullif(prior, 0) as vol_cum_frac
    from (select symbol, session_date, bar, spot, open, high, low, volume, {roll('volume', 30, 'avg', 5)} as vol_avg_30,
          {roll('volume', 30, 'stddev_samp', 5)} as sd, avg(volume) over {SW} as avg_v, sum(volume) over {SW} as cum_v
          from bars) b
    left join (select symbol, session_date, lag(t) over (partition by symbol order by session_date) as prior
          from (select symbol, session_date, sum(volume) as t from bars group by 1, 2)) t
    on b.symbol = t.symbol and b.session_date = t.session_date""")


@query("fea06_candles",
       "symbol:s session_date:d bar:i bar_range_bp:5 bar_body_frac:6 upper_wick_frac:6 lower_wick_frac:6 vol_avg_30:6 "
       "vol_z_30:6 vol_ratio_session:6 vol_cum_frac:6", q("select * from candle"))
def _(spark, d):
    return fe.candle_block(gr.ticks_to_bars(fx.ticks(spark, d), CFG))


@query("jn16_extras_on_grid", "symbol:s session_date:d bar:i bar_range_bp:5 vol_avg_30:6",
       q("""select g.symbol, g.session_date, g.bar, coalesce(bar_range_bp, 0) as bar_range_bp, coalesce(vol_avg_30, 0) as vol_avg_30
            from grid g left join candle c on g.symbol = c.symbol and g.session_date = c.session_date and g.bar = c.bar"""))
def _(spark, d):
    t = fx.ticks(spark, d)
    return gr.onto_grid(gr.session_grid(t, CFG), fe.candle_block(gr.ticks_to_bars(t, CFG)), fe.CANDLE_COLS)


_LAGS = [f"ret_{k}m" for k in (10, 20, 25, 40, 50)] + [f"rv_1m_d{k}m" for k in (5, 10, 15, 20, 30, 50)]


@query("fea07_lag_block", "symbol:s session_date:d bar:i " + " ".join(f"{c}:8" for c in _LAGS),
       q("select symbol, session_date, bar, " + ", ".join(
           [f"coalesce(ln(spot) - lag(ln(spot), {k}) over {SW}, 0) as ret_{k}m" for k in (10, 20, 25, 40, 50)]
           + [f"coalesce(rv_1m - lag(rv_1m, {k}) over {SW}, 0) as rv_1m_d{k}m" for k in (5, 10, 15, 20, 30, 50)])
         + " from price"))
def _(spark, d):
    return fe.lag_block(price_grid(spark, d))
