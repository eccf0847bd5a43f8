"""Queries over predictions, trades, signals, fusion and the board."""

from __future__ import annotations

from pyspark.sql import functions as F

import tapegrid.catalog.labels  # noqa: F401  (defines SQL blocks used here)
from tapegrid.catalog.features import CFG, grid, price_grid
from tapegrid.catalog.labels import HS
from tapegrid.catalog.ladder import state
from tapegrid.catalog.registry import query
from tapegrid.catalog.sqlbase import SW, define, q
from tapegrid.functions.market import side_label
from tapegrid.functions.nulls import mean_of, safe_div
from tapegrid.operators import board as bd, evaluate as ev, fusion as fu, physics as ph, targets as tg
from tapegrid.operators.windows import SESSION, by_bar, roll
from tapegrid.plans import fixtures as fx
from tapegrid.plans.session import materialise

H3 = ["5m", "20m", "eod"]
KEY = "symbol:s session_date:d bar:i "

define("scored", """select *, abs(p - y) as e, horizon <> 'eod' or us < 39600000000 as ok from
    (select *, (lgb + coalesce(cat, 0) + q50) / (2 + (cat is not null)::int) as p from preds)""")
define("cuts", "select horizon, quantile_cont(e, 0.95) as cut from scored where ok group by 1")
define("hscores", """select horizon, case when scored >= 30 then mae end as mae, case when scored >= 30 then acc end as acc, scored, dropped from
    (select s.horizon, count(*) filter (ok) as scored, count(*) filter (not ok) as dropped, avg(e) filter (ok and e <= cut) as mae,
     coalesce(avg((sign(p) = sign(y))::int) filter (ok and abs(y) > 0.1), 0.5) as acc from scored s join cuts c on s.horizon = c.horizon group by 1)""")


def scored(spark, d):
    return ev.scored_rows(fx.preds(spark, d), CFG.tz)


@query("agg15_expert_mean", "seq:i p:8", q("select seq, p from scored"))
def _(spark, d):
    return fx.preds(spark, d).withColumn("p", mean_of("lgb", "cat", "q50"))


@query("eva01_horizon_scores", "horizon:s mae:7 acc:7 scored:i dropped:i", q("select * from hscores"))
def _(spark, d):
    return ev.horizon_scores(scored(spark, d), H3)


@query("eva01_board_score", "mae_mean:7 acc_mean:7 score:7 scoring_version:s",
       q("select avg(mae) as mae_mean, avg(acc) as acc_mean, avg(mae) - 0.25 * (avg(acc) - 0.5) as score, 'eod_pre11' as scoring_version from hscores"))
def _(spark, d):
    return ev.board_score(ev.horizon_scores(scored(spark, d), H3))


@query("eva02_trimmed_mae", "horizon:s tmae:7 dir_acc:7",
       q("""select s.horizon, avg(e) filter (e between lo and hi) as tmae, avg((sign(p) = sign(y))::int) filter (abs(y) > 0.1) as dir_acc
            from scored s join (select horizon, quantile_cont(e, 0.05) as lo, quantile_cont(e, 0.95) as hi from scored group by 1) b on s.horizon = b.horizon group by 1"""))
def _(spark, d):
    return ev.trimmed_mae(scored(spark, d), H3)


@query("eva03_pinball", "horizon:s pinball:7",
       q("""select horizon, avg((greatest(0.1 * (y - q10), -0.9 * (y - q10)) + greatest(0.5 * (y - q50), -0.5 * (y - q50))
            + greatest(0.9 * (y - q90), -0.1 * (y - q90))) / 3) as pinball from preds group by 1"""))
def _(spark, d):
    return ev.pinball(fx.preds(spark, d), {"q10": 0.1, "q50": 0.5, "q90": 0.9})


@query("eva04_weighted_score", "score:7 n_horizons:i",
       q("""select sum(w * mae * (1.5 - acc)) / sum(w) as score, count(*) as n_horizons from
            (select *, case horizon when '5m' then 0.30 when 'eod' then 0.02 else 0.05 end as w from hscores where mae is not null)"""))
def _(spark, d):
    return ev.weighted_score(ev.horizon_scores(scored(spark, d), H3))


# ---------------------------------------------------------------- board
def board(spark, d):
    return fx.board(spark, d).withColumn("test_score", F.col("screen_score") + (F.col("seconds") - 300.0) / 5000.0)


define("tboard", "select *, screen_score + (seconds - 300.0) / 5000.0 as test_score from board")


@query("eva05_seed_bar", "bar:6 n_comparable:i",
       q("select coalesce(min(score), 'inf'::double) as bar, count(*) as n_comparable from board where status = 'ok' and scoring_version = 'eod_pre11'"))
def _(spark, d):
    return bd.seed_bar(board(spark, d))


@query("eva06_records", "node:s trial:i score:8 is_record:b",
       q("""select node, trial, score, coalesce(s < coalesce(min(s) over w, 'inf'::double) - 0.001, false) as is_record from
            (select *, case when status = 'ok' and scoring_version = 'eod_pre11' then score end as s from board)
            window w as (partition by node order by trial rows between unbounded preceding and 1 preceding)"""))
def _(spark, d):
    return bd.records(board(spark, d), ["node"], margin=0.001)


_WALK = q("""select 1 from tboard""").replace("select 1 from tboard", "").rstrip().replace("with ", "with recursive ", 1) + """,
    seqd as (select node, trial, score, test_score, row_number() over (partition by node order by trial) as rn from tboard
             where status = 'ok' and scoring_version = 'eod_pre11' and score is not null),
    walk as (select node, 0::bigint as rn, 0::bigint as trial, 'inf'::double as bar, 'inf'::double as champ, false as tested, false as promoted
             from (select distinct node from seqd)
        union all
        select w.node, s.rn, s.trial, case when {move} then s.score else w.bar end, case when s.score < w.bar - 0.001 and s.test_score < w.champ - 0.001 then s.test_score else w.champ end,
            s.score < w.bar - 0.001, s.score < w.bar - 0.001 and s.test_score < w.champ - 0.001
        from walk w join seqd s on s.node = w.node and s.rn = w.rn + 1)
    """
_ANY = _WALK.replace("{move}", "s.score < w.bar - 0.001")
_PROMO = _WALK.replace("{move}", "s.score < w.bar - 0.001 and s.test_score < w.champ - 0.001")


@query("eva06_promotion_gate", "node:s trial:i promoted:b", _ANY + "select node, trial, promoted from walk where tested")
def _(spark, d):
    return bd.promotions(board(spark, d), ["node"], margin=0.001)


@query("eva06_promotion_gate_strict", "node:s trial:i", _PROMO + "select node, trial from walk where promoted")
def _(spark, d):
    return bd.promotions(board(spark, d), ["node"], margin=0.001, advance="promotion")


@query("win20_plateau", "node:s trial:i since_promotion:i notice:b",
       _ANY + """, m as (select b.node, b.trial, row_number() over (partition by b.node order by b.trial) as n, w.promoted from tboard b
            left join walk w on b.node = w.node and b.trial = w.trial and w.promoted)
        select node, trial, s as since_promotion, s > 0 and s % 50 = 0 as notice from
            (select *, n - coalesce(max(case when promoted then n end) over (partition by node order by trial), 0) as s from m)""")
def _(spark, d):
    b = board(spark, d)
    won = bd.promotions(b, ["node"], margin=0.001)
    return bd.plateau(bd.mark_promotions(b, won, ["node"]), ["node"])


@query("win19_prune_bar", "node:s trial:i prune_bar:10 prune:b",
       q("""select node, trial, bar as prune_bar, coalesce(screen_score > bar, false) as prune from
            (select *, case when count(*) over w >= 8 then quantile_cont(screen_score, 0.6) over w end as bar from board
             window w as (partition by node order by trial rows between unbounded preceding and 1 preceding))"""))
def _(spark, d):
    return bd.prune_bar(board(spark, d), ["node"], store=materialise)


@query("eva09_prune_stats", "node:s pruned:i trials:i",
       q("""select node, count(*) filter (screen_score > bar) as pruned, count(*) as trials from
            (select *, case when count(*) over w >= 8 then quantile_cont(screen_score, 0.6) over w end as bar from board
             window w as (partition by node order by trial rows between unbounded preceding and 1 preceding)) group by 1"""))
def _(spark, d):
    p = bd.prune_bar(board(spark, d), ["node"], store=materialise)
    return p.groupBy("node").agg(F.sum(F.col("prune").cast("bigint")).alias("pruned"), F.count(F.lit(1)).alias("trials"))


@query("tk05_best_trials", "trial:i node:s score:6", q("select trial, node, score from board where score is not null order by score, trial limit 20"))
def _(spark, d):
    return bd.best_trials(board(spark, d), 20)


@query("agg23_board_nodes", "node:s trials:i ok:i pruned:i best_score:6 median_seconds:3",
       q("""select node, count(*) as trials, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'pruned') as pruned,
            min(score) filter (status = 'ok') as best_score, median(seconds) as median_seconds from board group by 1"""))
def _(spark, d):
    return bd.per_node(board(spark, d))


@query("agg28_importance", "model:s feature:s share:7",
       q("""select p_brand as model, p_type as feature, sum(p_retailprice) / sum(sum(p_retailprice)) over (partition by p_brand) as share from part group by 1, 2"""))
def _(spark, d):
    g = fx.table(spark, d, "part").groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("feature")).agg(F.sum("p_retailprice").alias("gain"))
    return ev.importance_share(g)


# ---------------------------------------------------------------- trades
@query("agg16_per_horizon", "horizon:s trades:i win_rate:6 pnl:3 avg_pnl:5 hit_target:6",
       q("""select horizon, count(*) as trades, avg((pnl_net > 0)::int) as win_rate, sum(pnl_net) as pnl, avg(pnl_net) as avg_pnl,
            avg(hit_target::int) as hit_target from trades group by 1"""))
def _(spark, d):
    return ev.per_group(fx.trades(spark, d), "horizon")


@query("agg17_reasons", "reason:s trades:i pnl:3 avg_pnl:5",
       q("select reason, count(*) as trades, sum(pnl_net) as pnl, avg(pnl_net) as avg_pnl from trades group by 1"))
def _(spark, d):
    return ev.per_group(fx.trades(spark, d), "reason")


define("dpnl", """select day, sum(pnl_net) as pnl, sum(costs) as costs, count(*) as trades, count(*) filter (pnl_net > 0) as wins,
    coalesce(sum(pnl_net) filter (pnl_net > 0), 0) as gains, coalesce(-sum(pnl_net) filter (pnl_net < 0), 0) as losses from trades group by 1""")


@query("agg18_daily_pnl", "day:d pnl:4 costs:4 trades:i wins:i gains:4 losses:4", q("select * from dpnl"))
def _(spark, d):
    return ev.daily_pnl(fx.trades(spark, d))


CAP = 10_000_000.0
define("eq0", "select *, 10000000.0 + sum(pnl) over (order by day) as equity from dpnl")
define("eq", "select *, max(equity) over (order by day) as peak, (equity - max(equity) over (order by day)) / max(equity) over (order by day) as drawdown from eq0")


@query("win17_equity_drawdown", "day:d equity:4 peak:4 drawdown:8", q("select * from eq"))
def _(spark, d):
    return ev.equity_curve(ev.daily_pnl(fx.trades(spark, d)), CAP)


@query("eva08_risk", "cumulative_return:7 total_pnl:2 total_costs:2 sharpe:6 sortino:6 max_drawdown:7 win_rate:6 profit_factor:6 avg_trade:4",
       q("""select arg_max(equity, day) / 1e7 - 1 as cumulative_return, sum(pnl) as total_pnl, sum(costs) as total_costs,
            avg(pnl / 1e7) / (stddev_samp(pnl / 1e7) + 1e-9) * sqrt(252) as sharpe,
            avg(pnl / 1e7) / (stddev_samp(pnl / 1e7) filter (pnl < 0) + 1e-9) * sqrt(252) as sortino, min(drawdown) as max_drawdown,
            sum(wins) / sum(trades) as win_rate, sum(gains) / sum(losses) as profit_factor, sum(pnl) / sum(trades) as avg_trade from eq"""))
def _(spark, d):
    return ev.risk_report(ev.daily_pnl(fx.trades(spark, d)), CAP)


# ---------------------------------------------------------------- signals
define("sig0", "union all".join(
    f""" select symbol, session_date, bar, '{h}' as horizon, spot, spot + coalesce(ret_5m, 0) * spot * 0.5 as target, "y_price_{h}" as realized,
    0.01 * spot as implied_move, last_value(spot) over (partition by symbol, session_date order by bar rows between unbounded preceding and unbounded following) as eod_close
    from (select t.*, p.ret_5m from targets t join price p on t.symbol = p.symbol and t.session_date = p.session_date and t.bar = p.bar) """ for h, _ in HS))
define("sig", """select *, case when abs(target - spot) > 0.05 * implied_move then sign(target - spot) else 0 end as pred_dir,
    case when realized is not null and abs(realized - spot) > 0.05 * implied_move then sign(realized - spot) else 0 end as real_dir,
    abs(target - realized) as abs_err from sig0 where spot is not null""")


def signals(spark, d):
    t = tg.horizon_targets(price_grid(spark, d), CFG).filter("spot is not null")
    t = ph.horizon_rows(t)
    real = F.coalesce(*[F.when(F.col("horizon") == h, F.col(f"y_price_{h}")) for h, _ in HS])
    return ev.signal_table(t.select(
        *SESSION, "bar", "horizon", "spot", (F.col("spot") + F.coalesce("ret_5m", F.lit(0.0)) * F.col("spot") * 0.5).alias("target"),
        real.alias("realized"), (0.01 * F.col("spot")).alias("implied_move"), F.col("y_price_eod").alias("eod_close")))


@query("eva07_signal_table", KEY + "horizon:s target:5 realized:4 pred_dir:i real_dir:i abs_err:5", q("select * from sig"))
def _(spark, d):
    return signals(spark, d)


@query("agg19_confusion", "pred_dir:i down:i flat:i up:i",
       q("""select v as pred_dir, count(s.horizon) filter (real_dir = -1) as down, count(s.horizon) filter (real_dir = 0) as flat, count(s.horizon) filter (real_dir = 1) as up
            from (values (-1), (0), (1)) as l(v) left join (select * from sig where realized is not null) s on s.pred_dir = v group by 1"""))
def _(spark, d):
    return ev.confusion(signals(spark, d))


@query("agg20_accuracy", "horizon:s accuracy:7 mae:6 n:i",
       q("""select horizon, avg((pred_dir = real_dir)::int) filter (pred_dir <> 0) as accuracy, avg(abs_err) as mae, count(*) as n
            from sig where realized is not null group by 1"""))
def _(spark, d):
    return ev.accuracy_by_horizon(signals(spark, d))


@query("agg21_final_call", "call_error:6 naive_error:6 sessions:i",
       q("""select avg(abs(target - eod_close)) as call_error, avg(abs(spot - eod_close)) as naive_error, count(*) as sessions from
            (select * from sig where horizon = 'eod' and realized is not null qualify row_number() over (partition by symbol, session_date order by bar desc) = 1)"""))
def _(spark, d):
    return ev.final_call(signals(spark, d))


define("ent", f"""select *, sign(spot - lag(spot) over {SW}) as dir from grid""")
define("entry", """select symbol, session_date, bar, spot, dir as side, spot - dir * 40 as stop, spot + dir * 60 as take from ent where dir <> 0""")


@query("jn22_barrier_exit", KEY + "side:i exit_bar:i exit_spot:4 reason:s hold_min:i",
       q("""select e.symbol, e.session_date, e.bar, e.side, min(b.bar) as exit_bar, arg_min(b.spot, b.bar) as exit_spot, min(b.bar) - e.bar as hold_min,
            arg_min(case when 390 - b.bar <= 2 then 'EOD_FLAT' when b.bar >= least(e.bar + 30, 388) then 'HORIZON_EXPIRY'
                when (b.spot - e.stop) * e.side <= 0 then 'STOP_LOSS' else 'TAKE_PROFIT' end, b.bar) as reason
            from entry e left join grid b on e.symbol = b.symbol and e.session_date = b.session_date and b.bar > e.bar and b.bar <= e.bar + 30
            and (390 - b.bar <= 2 or b.bar >= least(e.bar + 30, 388) or (b.spot - e.stop) * e.side <= 0 or (b.spot - e.take) * e.side >= 0)
            group by 1, 2, 3, 4"""))
def _(spark, d):
    g = grid(spark, d)
    side = F.signum(F.col("spot") - F.lag("spot").over(by_bar()))
    e = g.withColumn("side", F.when(side != 0, side)).withColumns(
        {"stop": F.col("spot") - F.col("side") * 40, "take": F.col("spot") + F.col("side") * 60})
    return ev.barrier_exit(e, CFG, 30)


_P = "greatest(0.05, 0.4 * s * rv * sqrt(greatest(rem, 1)))"


@query("fus10_costs", "l_orderkey:i l_linenumber:i premium:9 costs:8 pnl_gross:8 pnl_net:8",
       f"""select *, pnl_gross - costs as pnl_net from (select *, {_P} as premium,
            n * ((greatest(0.02, 0.04 * {_P}) + 0.02 * sqrt(n)) * 100 + 1.4) as costs,
            n * 100 * (0.5 * (x - s) * side - {_P} * (1 - sqrt(greatest(0, 1 - least(hold, rem) / greatest(rem, 1))))) as pnl_gross
            from (select l_orderkey, l_linenumber, l_linenumber as n, l_extendedprice / 100 as s, l_extendedprice / 100 * (1 + (l_tax - 0.04) / 10) as x,
                  0.0005 + l_discount / 100 as rv, l_quantity * 5 as rem, l_quantity * 3 as hold, case when l_returnflag = 'A' then -1 else 1 end as side from lineitem))""")
def _(spark, d):
    li = fx.table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_linenumber as contracts", "l_extendedprice / 100 as entry_spot",
        "l_extendedprice / 100 * (1 + (l_tax - 0.04) / 10) as exit_spot", "0.0005 + l_discount / 100 as rv_1m",
        "l_quantity * 5 as remaining_min", "l_quantity * 3 as hold_min", "case when l_returnflag = 'A' then -1 else 1 end as side")
    return ev.option_pnl(li)


# ---------------------------------------------------------------- fusion
define("fin", """select s.symbol, s.session_date, s.bar, s.horizon, hm, s.spot, mtc, im, r.rv, s.band_mass_share as pin,
    ((s.bar + horizon_no * 17) % 31 - 15) / 10.0 as lgb, case when (s.bar + horizon_no) % 7 = 0 then null else ((s.bar * 3 + horizon_no) % 29 - 14) / 10.0 end as cat,
    -0.8 as q10, case when s.bar % 120 = 30 then null else 0.05 end as q50, 0.9 as q90,
    case when s.bar > 300 and horizon_no = 1 then null else peak_gex_strike end as phys, (s.bar / 60.0 - 3.2) * 1.3 as z
    from scales s join (select symbol, session_date, bar, max(case when rv0 > 0 then rv0 else im / (spot * sqrt(greatest(mtc, 1))) end) as rv from lstate group by 1, 2, 3) r
    on s.symbol = r.symbol and s.session_date = r.session_date and s.bar = r.bar""")
_PX = "case when {0} is not null then spot * exp(greatest(-0.2, least(0.2, {0} * rv * sqrt(coalesce(hm, greatest(mtc, 1)))))) end"
define("fx0", f"""select *, {_PX.format('lgb')} as xl, {_PX.format('cat')} as xc, {_PX.format('q10')} as lo, {_PX.format('q90')} as hi,
    coalesce({_PX.format('q50')}, 0.5 * ({_PX.format('q10')} + {_PX.format('q90')})) as xt from fin""")
define("fw0", """select f.*, p.a, p.b, p.c, p.d, 1 / (1 + exp(greatest(-60, least(60, (mtc - 30) / 8.0)))) as ramp from fx0 f join
    (values ('5m', 0.40, 0.35, 0.15, 0.10), ('15m', 0.38, 0.32, 0.20, 0.10), ('30m', 0.20, 0.15, 0.50, 0.15),
     ('1h', 0.15, 0.12, 0.53, 0.20), ('eod', 0.15, 0.10, 0.30, 0.45)) as p(h, a, b, c, d) on f.horizon = p.h""")
define("fw1", """select *, least(1, d + (0.85 - d) * ramp + 0.5 * pin * ramp) as ph from fw0""")
define("fw2", """select * exclude (a, b, c, d), case when horizon = 'eod' then a / (a + b + c + 1e-9) * (1 - ph) else a end as a,
    case when horizon = 'eod' then b / (a + b + c + 1e-9) * (1 - ph) else b end as b, case when horizon = 'eod' then c / (a + b + c + 1e-9) * (1 - ph) else c end as c,
    case when horizon = 'eod' then ph else d end as d, abs(z) >= 3 as hot from fw1""")
define("fw3", """select *, greatest(d * 0.5, case when horizon = 'eod' then 0.3 else 0 end) as nd from fw2""")
define("fw4a", """select *, a + (c + d - nd) * a / (a + b + 1e-9) as na, b + (c + d - nd) * b / (a + b + 1e-9) as nb from fw3""")
define("fw4", """select * exclude (a, b, c, d), case when hot then na / (na + nb + nd + 1e-9) else a end as a, case when hot then nb / (na + nb + nd + 1e-9) else b end as b,
    case when hot then 0 else c end as c, case when hot then nd / (na + nb + nd + 1e-9) else d end as d from fw4a""")
define("fw5", """select *, a * (xl is not null)::int + b * (xc is not null)::int + c * (xt is not null)::int + d * (phys is not null)::int + 1e-9 as tot from fw4""")
define("fw", """select * exclude (a, b, c, d), a * (xl is not null)::int / tot as a, b * (xc is not null)::int / tot as b, c * (xt is not null)::int / tot as c,
    d * (phys is not null)::int / tot as d from fw5""")
define("fused", """select *, coalesce(xl * a, 0) + coalesce(xc * b, 0) + coalesce(xt * c, 0) + coalesce(phys * d, 0) as t,
    greatest(xl, xc, xt, phys) - least(xl, xc, xt, phys) as spread from fw""")


def fusion_input(spark, d):
    p = ph.horizon_rows(ph.profile(state(spark, d)))
    b, h = F.col("bar"), F.col("horizon_no")
    return p.withColumns({
        "pin_strength": F.col("band_mass_share"), "lgb": ((b + h * 17) % 31 - 15) / 10.0,
        "cat": F.when((b + h) % 7 != 0, ((b * 3 + h) % 29 - 14) / 10.0), "q10": F.lit(-0.8), "q90": F.lit(0.9),
        "q50": F.when(b % 120 != 30, 0.05), "x_physics": F.when(~((b > 300) & (h == 1)), F.col("peak_gex_strike")),
        "net_prem_z": (b / 60.0 - 3.2) * 1.3})


@query("fus01_03_expert_prices", KEY + "horizon:s x_lgb:5 x_cat:5 x_tft:5 consensus:5",
       q("select *, xl as x_lgb, xc as x_cat, xt as x_tft, (xl + coalesce(xc, 0) + xt) / (2 + (xc is not null)::int) as consensus from fx0"))
def _(spark, d):
    return fu.expert_prices(fusion_input(spark, d))


@query("fus01_target_kinds", KEY + "horizon:s as_price:5 as_dprice:5 as_ret:5",
       q("select *, lgb as as_price, spot + lgb as as_dprice, spot * exp(greatest(-0.2, least(0.2, lgb))) as as_ret from fin"))
def _(spark, d):
    f = fusion_input(spark, d)
    return f.withColumns({f"as_{k}": fu.to_price(F.col("lgb"), k) for k in ("price", "dprice", "ret")})


@query("fus04_prior_weights", KEY + "horizon:s w_lgb:7 w_cat:7 w_tft:7 w_physics:7", q("select *, a as w_lgb, b as w_cat, c as w_tft, d as w_physics from fw2"))
def _(spark, d):
    return fu.prior_weights(fusion_input(spark, d))


@query("fus05_learned_weights", KEY + "horizon:s alpha_learned:7 w_lgb:7 w_physics:7",
       q("""select *, 100 / 160.0 as alpha_learned, (60 / 160.0) * a + (100 / 160.0) * 0.25 as w_lgb, (60 / 160.0) * d + (100 / 160.0) * 0.25 as w_physics from fw2"""))
def _(spark, d):
    f = fu.prior_weights(fusion_input(spark, d))
    learned = f.groupBy("horizon").agg(F.lit(100.0).alias("n"), *[F.lit(0.25).alias(f"l_{e}") for e in ("lgb", "cat", "tft", "physics")])
    return fu.learned_weights(f, learned, [h for h, _ in HS])


@query("fus06_regime", KEY + "horizon:s high_vol_fallback:b w_lgb:7 w_cat:7 w_tft:7 w_physics:7", q("select *, hot as high_vol_fallback, a as w_lgb, b as w_cat, c as w_tft, d as w_physics from fw4"))
def _(spark, d):
    return fu.regime_adjust(fu.prior_weights(fusion_input(spark, d)))


@query("fus07_available", KEY + "horizon:s w_lgb:7 w_cat:7 w_tft:7 w_physics:7", q("select *, a as w_lgb, b as w_cat, c as w_tft, d as w_physics from fw"))
def _(spark, d):
    return fu.gate(fu.expert_prices(fusion_input(spark, d)))


define("fout", """select *, t - spot as delta, case when abs(t - spot) > 0.05 * im then sign(t - spot) else 0 end as direction,
    greatest(0, least(1, 0.5 * exp(-spread / (0.35 * im + 1e-9)) + 0.25 * (a * a + b * b + c * c + d * d) + 0.25 * exp(-(hi - lo) / (2 * im + 1e-9)))) as confidence,
    t - 0.5 * (hi - lo) as band_lo, t + 0.5 * (hi - lo) as band_hi from fused""")


def fused(spark, d):
    return fu.fuse(fu.gate(fu.expert_prices(fusion_input(spark, d))))


@query("fus08_fusion", KEY + "horizon:s delta:5 direction:i confidence:7 band_lo:5 band_hi:5", q("select * from fout"))
def _(spark, d):
    return fused(spark, d)


@query("fus09_entries", KEY + "horizon:s direction:i stop:5 take:5 expiry_bar:1",
       q("""select *, spot - direction * greatest(0.12 * im, least(1.5 * im, case when direction > 0 then spot - band_lo else band_hi - spot end)) as stop,
            spot + delta as take, least(bar + coalesce(least(hm, mtc), mtc), bar + mtc - 2) as expiry_bar from fout
            where direction <> 0 and confidence >= 0.35 and abs(delta) >= 0.08 * im
            and mtc > case horizon when '5m' then 6 when '15m' then 16 when '30m' then 31 when '1h' then 61 else 12 end"""))
def _(spark, d):
    from tapegrid.config import RiskConfig
    # the fixture's experts disagree widely: the bar is lowered so that entries exist
    return fu.entries(fused(spark, d), RiskConfig(min_confidence=0.35))


# ---------------------------------------------------------------- ML-04 sums
define("gram", """select *, xl - spot as d1, coalesce(xc - spot, 0) as d2, xt - spot as d3, coalesce(phys - spot, 0) as d4, peak - spot as dy from
    (select f.*, g.wall as peak from fx0 f join (select symbol, session_date, bar, coalesce(wall_above, wall_below, peak_gex_strike) as wall from prof) g
     on f.symbol = g.symbol and f.session_date = g.session_date and f.bar = g.bar)""")
_PAIRS = [(i, j) for i in range(1, 5) for j in range(i, 5)]


def gate_history(spark, d):
    f = fu.expert_prices(fusion_input(spark, d))
    return f.withColumn("realized", F.coalesce("wall_above", "wall_below", "peak_gex_strike"))


@query("ml04_gate_gram", "horizon:s n:i " + " ".join(f"g{i}{j}:2" for i, j in _PAIRS) + " " + " ".join(f"b{i}:2" for i in range(1, 5)),
       q("select horizon, count(*) as n, " + ", ".join(f"sum(d{i} * d{j}) as g{i}{j}" for i, j in _PAIRS) + ", "
         + ", ".join(f"sum(d{i} * dy) as b{i}" for i in range(1, 5)) + " from gram group by 1"))
def _(spark, d):
    from tapegrid.operators.forecast import gate_gram
    return gate_gram(gate_history(spark, d))


@query("ml04_gate_weights", "horizon:s n:i l_lgb:6 l_cat:6 l_tft:6 l_physics:6")
def _(spark, d):
    from tapegrid.operators.forecast import gate_gram, gate_weights
    return gate_weights(gate_gram(gate_history(spark, d)))


# ---------------------------------------------------------------- small expressions
@query("up02_safe_div", "trial:i q:6",
       q("select trial, coalesce(case when abs(seconds - 300) >= 1e-9 then score / (seconds - 300) end, 0) as q from board"))
def _(spark, d):
    return board(spark, d).select("trial", safe_div(F.col("score"), F.col("seconds") - 300.0).alias("q"))


@query("up03_clip", "seq:i y:4", q("select seq, greatest(-0.5, least(0.5, y)) as y from preds"))
def _(spark, d):
    from tapegrid.functions.nulls import clip
    return fx.preds(spark, d).select("seq", clip("y", -0.5, 0.5).alias("y"))


@query("up07_side_normalise", "side_label:s side_sign:i type_sign:i n:i premium:3",
       q("""select case side when 'buy' then 'ask' when 'sell' then 'bid' else side end as side_label,
            case when side in ('ask', 'buy') then 1 when side in ('bid', 'sell') then -1 else 0 end as side_sign,
            case upper(left(option_type, 1)) when 'C' then 1 when 'P' then -1 else 0 end as type_sign, count(*) as n, sum(premium) as premium from prints group by 1, 2, 3"""))
def _(spark, d):
    from tapegrid.functions.market import side_sign, type_sign
    p = fx.prints(spark, d)
    return p.groupBy(side_label(F.col("side")).alias("side_label"), side_sign(F.col("side")).alias("side_sign"),
                     type_sign(F.col("option_type")).alias("type_sign")).agg(F.count(F.lit(1)).alias("n"), F.sum("premium").alias("premium"))


@query("udf01_rolling_by_name", KEY + "span:4 mid:4",
       q("""select *, max(spot) over w - min(spot) over w as span, median(spot) over w as mid from grid
            window w as (partition by symbol, session_date order by bar rows 9 preceding)"""))
def _(spark, d):
    g = grid(spark, d)
    # a composite statistic is built from registered single ones
    return g.withColumns({"span": roll("spot", 10, "max") - roll("spot", 10, "min"), "mid": roll("spot", 10, "median")})
