"""Queries over option bars and the ladder feed built from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

import tapegrid.catalog.ladder  # noqa: F401  (defines SQL blocks used here)
from tapegrid.catalog.features import CFG, grid
from tapegrid.catalog.registry import query
from tapegrid.catalog.sqlbase import define, q
from tapegrid.functions import market as mk
from tapegrid.functions import pricing as pr
from tapegrid.functions.pricing import option_delta
from tapegrid.operators import chain as ch, features as fe, ladder as ld
from tapegrid.operators.windows import SESSION
from tapegrid.plans import fixtures as fx

KEY = "symbol:s session_date:d bar:i "
CW = "(partition by symbol, session_date, strike, type order by bar)"

define("cbars", """select symbol, session_date, strike, type, cast(ceil(us / 300000000.0) * 5 - 570 as int) as bar,
    arg_max(c, ts) as c, sum(v) as v, case when sum(v) > 0 then sum(c * v) / sum(v) else arg_max(c, ts) end as vw, count(*) as n
    from optbars where us >= 34200000000 and us < 57600000000 and isodow(session_date) <= 5 group by 1, 2, 3, 4, 5""")


def bars(spark, d):
    return ch.contract_bars(fx.option_bars(spark, d), CFG)


@query("flt02_option_hours", KEY + "strike:1 type:s c:5 v:0 vw:6 n:i", q("select * from cbars"))
def _(spark, d):
    return bars(spark, d)


define("cpairs", """select symbol, session_date, bar, strike, max(c) filter (type = 'C') as cc, max(c) filter (type = 'P') as pc
    from cbars group by 1, 2, 3, 4 having cc is not null and pc is not null""")


@query("jn05_call_put_pairs", KEY + "strike:1 call_close:5 put_close:5",
       q("""select a.symbol, a.session_date, a.bar, a.strike, a.c as call_close, b.c as put_close
            from (select * from cbars where type = 'C') a join (select * from cbars where type = 'P') b
            on a.symbol = b.symbol and a.session_date = b.session_date and a.bar = b.bar and a.strike = b.strike"""))
def _(spark, d):
    return ch.pairs(bars(spark, d))


define("parity", """select symbol, session_date, bar, median(cc - pc + strike) as spot from
    (select *, row_number() over (partition by symbol, session_date, bar order by abs(cc - pc), strike) as r from cpairs)
    where r <= 3 group by 1, 2, 3""")


@query("agg07_parity_spot", KEY + "spot:6", q("select * from parity"))
def _(spark, d):
    return ch.parity_spot(bars(spark, d))


@query("win15_top3_rank", KEY + "strike:1 r:i",
       q("""select *, row_number() over (partition by symbol, session_date, bar order by abs(cc - pc), strike) as r from cpairs qualify r <= 3"""))
def _(spark, d):
    from pyspark.sql import Window
    gap = F.abs(F.col("call_close") - F.col("put_close"))
    w = Window.partitionBy(*SESSION, "bar").orderBy(gap, "strike")
    return ch.pairs(bars(spark, d)).withColumn("r", F.row_number().over(w)).filter("r <= 3")


define("pspine", """select symbol, session_date, unnest(range(0, 391, 5)) as bar from (select distinct symbol, session_date from parity)""")
define("pgrid", """select s.symbol, s.session_date, s.bar, last_value(p.spot ignore nulls) over w as spot,
    first_value(p.spot ignore nulls) over (partition by s.symbol, s.session_date order by s.bar rows between current row and unbounded following) as nxt
    from pspine s left join parity p on s.symbol = p.symbol and s.session_date = p.session_date and s.bar = p.bar
    window w as (partition by s.symbol, s.session_date order by s.bar)""")


@query("win09_forward_fill", KEY + "spot:6", q("select * from pgrid"))
def _(spark, d):
    return ch.parity_grid(bars(spark, d), CFG)


@query("win10_backward_fill", KEY + "spot:6", q("select symbol, session_date, bar, coalesce(spot, nxt) as spot from pgrid"))
def _(spark, d):
    return ch.parity_grid(bars(spark, d), CFG, fill="both")


define("sided", f"""select *, case when c > lag(c) over {CW} then 'ask' when c < lag(c) over {CW} then 'bid' else 'mid' end as side,
    vw * v * 100 as premium from cbars""")


@query("up06_tick_rule", KEY + "strike:1 type:s side:s signed_v:0 premium:4",
       q("select *, case side when 'ask' then v when 'bid' then -v else 0 end as signed_v from sided"))
def _(spark, d):
    return ch.tick_rule(bars(spark, d))


@query("up06_tick_rule_two_way", KEY + "strike:1 type:s side:s",
       q(f"select *, case when coalesce(c - lag(c) over {CW}, 0) >= 0 then 'ask' else 'bid' end as side from cbars"))
def _(spark, d):
    return ch.tick_rule(bars(spark, d), two_way=True)


@query("up08_size_class", "trade_type:s n:i total:0",
       q("select case when v >= 500 then 'block' else 'regular' end as trade_type, count(*) as n, sum(v) as total from cbars group by 1"))
def _(spark, d):
    t = bars(spark, d).withColumn("trade_type", mk.size_class(F.col("v")))
    return t.groupBy("trade_type").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("up08_volume_class", KEY + "strike:1 type:s trade_type:s",
       q(f"""select *, case when v > 3 * coalesce(case when count(v) over w >= 2 then median(v) over w end, v) then 'sweep' else 'block' end as trade_type
            from cbars window w as (partition by symbol, session_date, strike, type order by bar rows 29 preceding)"""))
def _(spark, d):
    # contract sessions of the fixture are short, so the warm-up is two rows
    return ch.volume_class(bars(spark, d), least=2)


@query("up09_signed_volume", "side:s signed:0", q("select side, sum(case side when 'ask' then v when 'bid' then -v else 0 end) as signed from sided group by 1"))
def _(spark, d):
    return ch.tick_rule(bars(spark, d)).groupBy("side").agg(F.sum("signed_v").alias("signed"))


@query("up10_premium", KEY + "type:s premium:4", q("select symbol, session_date, bar, type, sum(premium) as premium from sided group by 1, 2, 3, 4"))
def _(spark, d):
    return ch.tick_rule(bars(spark, d)).groupBy(*SESSION, "bar", "type").agg(F.sum("premium").alias("premium"))


_A = ", ".join(f"""coalesce(sum(v) filter (type = '{l}'), 0) as {s}_vol, coalesce(sum(premium) filter (type = '{l}'), 0) as {s}_prem,
    coalesce(sum(premium) filter (type = '{l}' and side = 'ask'), 0) as {s}_ask_prem,
    coalesce(sum(premium) filter (type = '{l}' and side = 'bid'), 0) as {s}_bid_prem,
    coalesce(sum(case side when 'ask' then v when 'bid' then -v else 0 end) filter (type = '{l}'), 0) as {s}_signed_v,
    arg_max(c, bar) filter (type = '{l}') as {s}_close""" for l, s in (("C", "call"), ("P", "put")))
define("chain5", f"""select symbol, session_date, cast(ceil(bar / 60.0) * 60 as int) as snap, strike, {_A} from sided group by 1, 2, 3, 4""")
_SUMSPEC = " ".join(f"{s}_vol:0 {s}_prem:4 {s}_ask_prem:4 {s}_bid_prem:4 {s}_signed_v:0 {s}_close:5" for s in ("call", "put"))


def chain5(spark, d):
    return ch.snapshot_aggregate(ch.tick_rule(bars(spark, d)), 60)


@query("agg05_chain_build", KEY + "strike:1 " + _SUMSPEC, q("select *, snap as bar from chain5"))
def _(spark, d):
    return chain5(spark, d)


@query("agg08_pivot_sides", KEY + "strike:1 call_close:5 put_close:5 call_v:0 put_v:0",
       q("""select symbol, session_date, bar, strike, max(c) filter (type = 'C') as call_close, max(c) filter (type = 'P') as put_close,
            max(v) filter (type = 'C') as call_v, max(v) filter (type = 'P') as put_v from cbars group by 1, 2, 3, 4"""))
def _(spark, d):
    return ch.sides_wide(bars(spark, d), ch.SNAP_STRIKE, {"c": "close", "v": "v"})


define("dense5", """select k.symbol, k.session_date, t.snap, k.strike from (select distinct symbol, session_date, strike from chain5) k
    join (select distinct symbol, session_date, snap from chain5) t on k.symbol = t.symbol and k.session_date = t.session_date""")
define("filled5", """select d.symbol, d.session_date, d.snap as bar, d.strike, coalesce(call_vol, 0) as call_vol, coalesce(put_vol, 0) as put_vol,
    last_value(call_close ignore nulls) over w as call_close, last_value(put_close ignore nulls) over w as put_close,
    sum(coalesce(call_vol, 0)) over w as call_cumvol, sum(coalesce(put_vol, 0)) over w as put_cumvol,
    sum(coalesce(call_signed_v, 0)) over w as call_cum_signed, sum(coalesce(put_signed_v, 0)) over w as put_cum_signed
    from dense5 d left join chain5 c on d.symbol = c.symbol and d.session_date = c.session_date and d.snap = c.snap and d.strike = c.strike
    window w as (partition by d.symbol, d.session_date, d.strike order by d.snap)""")


@query("jn17_dense_ladder", KEY + "strike:1", q("select *, snap as bar from dense5"))
def _(spark, d):
    return ch.dense_ladder(chain5(spark, d))


@query("win05_cumulative_volume", KEY + "strike:1 call_close:5 put_close:5 call_cumvol:0 put_cumvol:0 call_cum_signed:0 put_cum_signed:0",
       q("select * from filled5"))
def _(spark, d):
    return ch.fill_ladder(ch.dense_ladder(chain5(spark, d)))


@query("jn06_ladder_price", KEY + "strike:1 spot:6",
       q("""select f.symbol, f.session_date, f.bar, f.strike, p.spot from filled5 f left join pgrid p
            on f.symbol = p.symbol and f.session_date = p.session_date and f.bar = p.bar"""))
def _(spark, d):
    b = bars(spark, d)
    lad = ch.fill_ladder(ch.dense_ladder(ch.snapshot_aggregate(ch.tick_rule(b), 60)))
    return lad.join(ch.parity_grid(b, CFG).select(*SESSION, "bar", "spot"), [*SESSION, "bar"], "left")


# greeks with a volatility derived from the row, so that SQL can follow
_D1 = "((ln(s / k) + (r + 0.5 * sg * sg) * t) / (sg * sqrt(t)))"
define("gk", """select l.symbol, l.session_date, l.bar, l.strike as k, g.spot as s, greatest(390.0 - l.bar, 1) / 98280.0 as t, 0.045 as r,
    0.1 + call_oi / 2000.0 as ivc, 0.1 + put_oi / 2000.0 as ivp, ((0.1 + call_oi / 2000.0) + (0.1 + put_oi / 2000.0)) / 2 as sg,
    (call_vol - put_vol) * 100 * g.spot as net, call_vol, put_vol, call_oi, put_oi, call_oi * 2 as cp, put_oi * 3 as pp
    from lrows l join grid g on l.symbol = g.symbol and l.session_date = g.session_date and l.bar = g.bar where g.spot is not null""")


def greek_rows(spark, d):
    from tapegrid.catalog.ladder import spotted
    return spotted(spark, d).withColumns({"iv_call": 0.1 + F.col("call_oi") / 2000.0, "iv_put": 0.1 + F.col("put_oi") / 2000.0,
                                          "call_prem": F.col("call_oi") * 2, "put_prem": F.col("put_oi") * 3})


@query("lad21_vanna_charm", KEY + "strike:1 vanna:5 charm:5",
       q(f"""select *, k as strike, -exp(-0.5 * {_D1} * {_D1}) / sqrt(2 * pi()) * ({_D1} - sg * sqrt(t)) / sg * net * 0.01 as vanna,
            -exp(-0.5 * {_D1} * {_D1}) / sqrt(2 * pi()) * (2 * r * t - ({_D1} - sg * sqrt(t)) * sg * sqrt(t)) / (2 * t * sg * sqrt(t)) * net * (390 / 98280.0) as charm
            from gk"""))
def _(spark, d):
    rows = greek_rows(spark, d).drop("vanna", "charm", "spot")
    return ch.fill_greeks(rows, grid(spark, d), CFG)


@query("lad21_gamma", KEY + "strike:1 gamma:8",
       q(f"select *, k as strike, exp(-0.5 * {_D1} * {_D1}) / sqrt(2 * pi()) / (s * sg * sqrt(t)) as gamma from gk"))
def _(spark, d):
    t = mk.year_fraction(F.lit(390.0) - F.col("bar"), 1.0, mk.TRADING_YEAR)
    vol = (F.col("iv_call") + F.col("iv_put")) / 2.0
    return greek_rows(spark, d).withColumn("gamma", mk.bs_gamma(F.col("spot"), F.col("strike"), t, vol, mk.TRADING_RATE))


_X = "((ln(s / k) + 0.5 * sg * sg * t) / (sg * sqrt(t)) / sqrt(2.0))"
_ERF = (f"case when abs(x) > 5.5 then sign(x) else exp(-x * x) * list_sum(list_transform(range(0, 110), "
        f"lambda n: pow(x, 2 * n + 1) / gamma(n + 1.5))) end")


@query("lad21_delta", KEY + "strike:1 call_delta:7 put_delta:7",
       q(f"select *, k as strike, 0.5 * (1 + e) as call_delta, 0.5 * (1 + e) - 1 as put_delta from (select *, {_ERF} as e from (select *, {_X} as x from gk))"))
def _(spark, d):
    t = mk.year_fraction(F.lit(390.0) - F.col("bar"), 1.0, mk.TRADING_YEAR)
    rows = greek_rows(spark, d).withColumns({"t": t, "sg": (F.col("iv_call") + F.col("iv_put")) / 2.0})
    at = [F.col(c) for c in ("spot", "strike", "t", "sg")]
    return rows.withColumns({"call_delta": option_delta(*at, F.lit(True)), "put_delta": option_delta(*at, F.lit(False))})


_G = "(exp(-0.5 * {0} * {0}) / sqrt(2 * pi()) / (s * {1} * sqrt(t)))"
_GC = _G.format("((ln(s / k) + (r + 0.5 * ivc * ivc) * t) / (ivc * sqrt(t)))", "ivc")
_GP = _G.format("((ln(s / k) + (r + 0.5 * ivp * ivp) * t) / (ivp * sqrt(t)))", "ivp")
_GM = _G.format(_D1, "sg")


@query("lad23_gex_modes", KEY + "strike:1 gex_minute:3 gex_cum:3 gex_oi:3 gex_signed:3",
       q(f"""select *, k as strike, {_GM} * (call_vol - put_vol) * 100 * s * s * 0.01 as gex_minute,
            ({_GC} * call_vol - {_GP} * put_vol) * s * s as gex_cum, ({_GC} * call_oi - {_GP} * put_oi) * s * s as gex_oi,
            -({_GC} * call_vol + {_GP} * put_vol) * s * s as gex_signed from gk"""))
def _(spark, d):
    t = mk.year_fraction(F.lit(390.0) - F.col("bar"), 1.0, mk.TRADING_YEAR)
    s, k, r = F.col("spot"), F.col("strike"), mk.TRADING_RATE
    rows = greek_rows(spark, d).withColumns({
        "gamma": mk.bs_gamma(s, k, t, (F.col("iv_call") + F.col("iv_put")) / 2.0, r), "call_gamma": mk.bs_gamma(s, k, t, F.col("iv_call"), r),
        "put_gamma": mk.bs_gamma(s, k, t, F.col("iv_put"), r), "call_cumvol": F.col("call_vol"), "put_cumvol": F.col("put_vol"),
        "call_cum_signed": F.col("call_vol"), "put_cum_signed": F.col("put_vol")})
    out = rows
    for mode, name in (("minute_volume", "gex_minute"), ("cum_volume", "gex_cum"), ("oi", "gex_oi")):
        out = ch.gex_ladder(out, mode).withColumn(name, F.col("gex"))
    return ch.gex_ladder(out, "signed")


@query("lad25_atm_block", KEY + "iv_call_atm:5 iv_put_atm:5 iv_skew_atm:5 straddle_pct:6 iv_atm_chg_5:6",
       q("""select *, (iv_call_atm + iv_put_atm) / 2 - lag((iv_call_atm + iv_put_atm) / 2, 5) over (partition by symbol, session_date order by bar) as iv_atm_chg_5
            from (select g.symbol, g.session_date, g.bar, ivc as iv_call_atm, ivp as iv_put_atm, ivp - ivc as iv_skew_atm, (cp + pp) / g.spot * 100 as straddle_pct
                  from grid g left join (select * from gk qualify row_number() over (partition by symbol, session_date, bar order by abs(k - s), k) = 1) a
                  on g.symbol = a.symbol and g.session_date = a.session_date and g.bar = a.bar)"""))
def _(spark, d):
    return ld.atm_block(grid(spark, d), greek_rows(spark, d).drop("spot"))


@query("jn07_ladder_atm", KEY + "strike:1", q("select *, k as strike from gk qualify row_number() over (partition by symbol, session_date, bar order by abs(k - s), k) = 1"))
def _(spark, d):
    near = F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))
    return greek_rows(spark, d).groupBy(*SESSION, "bar").agg(F.min_by("strike", near).alias("strike"))


def _ncdf(x: str) -> str:
    """SQL text of the normal distribution function (checked against the error function's series by lad21_delta)."""
    a = f"abs({x})"

    def poly(cs):
        out = f"{cs[0]!r}::double"
        for c in cs[1:]:
            out = f"({out} * {a} + {c!r}::double)"
        return out

    up = (f"(case when {a} > 37 then 0.0 when {a} < {pr.SPLIT!r} then exp(-{x} * {x} / 2) * {poly(pr.TOP)} / {poly(pr.BOTTOM)} "
          f"else exp(-{x} * {x} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / 2.506628274631::double end)")
    return f"(case when {x} > 0 then 1 - {up} else {up} end)"


def bisected(rows: str, rate: float, edge: str, steps: int = 50) -> str:
    """SQL of implied volatility by bisection: ``rows`` needs symbol, session_date, bar, strike, type, c, spot, t."""
    keys = "symbol, session_date, bar, strike, type, c, spot, t"
    return f"""select {keys}, (lo + hi) / 2 as iv from (with recursive walk as (
        select {keys}, 0.01::double as lo, 5.0::double as hi, 0 as n from ({rows})
        where spot > 0 and t > 0 and c - greatest(case type when 'C' then spot - strike else strike - spot end, 0) > {edge}
        union all
        select {keys}, case when value > c then lo else mid end, case when value > c then mid else hi end, n + 1 from
            (select *, case type when 'C' then spot * {_ncdf('d1')} - kd * {_ncdf('d2')} else kd * (1 - {_ncdf('d2')}) - spot * (1 - {_ncdf('d1')}) end as value from
                (select *, d1 - mid * sqrt(t) as d2, strike * exp(-{rate} * t) as kd from
                    (select *, (ln(spot / strike) + ({rate} + mid * mid / 2) * t) / (mid * sqrt(t)) as d1 from
                        (select *, (lo + hi) / 2 as mid from walk where n < {steps})))))
        select * from walk where n = {steps})"""


define("optspot", """select b.symbol, b.session_date, b.bar, b.strike, b.type, b.c, b.v, b.side, g.spot, greatest((390 - b.bar) / 525600.0, 0) as t
    from sided b left join pgrid g on b.symbol = g.symbol and b.session_date = g.session_date and b.bar = g.bar""")
define("optsolved", bisected("select * from optspot", 0.0, "1e-4"))
define("optvol", """select o.*, case when i.iv < 4.999 then i.iv end as iv from optspot o left join optsolved i
    on o.symbol = i.symbol and o.session_date = i.session_date and o.bar = i.bar and o.strike = i.strike and o.type = i.type""")


@query("lad22_implied_vol", KEY + "strike:1 type:s iv:6", q("select * from optvol"))
def _(spark, d):
    b = bars(spark, d)
    return ch.enrich(b, CFG, ch.parity_grid(b, CFG))


define("optsolved2", bisected("select symbol, session_date, bar, strike, type, c, spot, greatest(390 - bar, 1) / 98280.0 as t from optspot", mk.TRADING_RATE, "1e-6"))


@query("udf06_implied_vol", KEY + "strike:1 type:s iv:6",
       q("""select o.*, i.iv from optspot o left join optsolved2 i
            on o.symbol = i.symbol and o.session_date = i.session_date and o.bar = i.bar and o.strike = i.strike and o.type = i.type"""))
def _(spark, d):
    """The solver called from SQL text, at the trading-year conventions."""
    pr.register(spark)
    b = bars(spark, d)
    return spark.sql("""select b.*, implied_vol_bounded(b.c, g.spot, b.strike, greatest(390 - b.bar, 1) / 98280.0D, b.type = 'C', 0.045D) as iv
                        from {b} b left join {g} g on b.symbol = g.symbol and b.session_date = g.session_date and b.bar = g.bar""",
                     b=b, g=ch.parity_grid(b, CFG))


_GF = _G.replace("sqrt(t)", "sqrt(tt)").format("((ln(s / k) + 0.5 * f * f * tt) / (f * sqrt(tt)))", "f")
define("rich24", f"""select *, cast(ceil(bar / 60.0) * 60 as int) as snap, {_GF} as gamma, case side when 'ask' then v when 'bid' then -v else 0 end as sv from
    (select *, spot as s, strike as k, greatest(t, 1e-9) as tt,
     coalesce(last_value(iv ignore nulls) over (partition by symbol, session_date, strike, type order by bar rows unbounded preceding), 0.2) as f from optvol)""")
define("agg24", """select symbol, session_date, snap as bar, strike, sum(v) filter (type = 'C') as cv, sum(v) filter (type = 'P') as pv,
    sum(sv) filter (type = 'C') as cs, sum(sv) filter (type = 'P') as ps, avg(gamma) filter (type = 'C') as cg, avg(gamma) filter (type = 'P') as pg
    from rich24 group by 1, 2, 3, 4""")
define("spot24", "select symbol, session_date, cast(ceil(bar / 60.0) * 60 as int) as bar, arg_max(spot, bar) as spot from pgrid where spot is not null group by 1, 2, 3")
_RUN = "over (partition by symbol, session_date, strike order by bar rows unbounded preceding)"
define("fill24", f"""select symbol, session_date, bar, strike, cv, pv, sum(cv) {_RUN} as ccum, sum(pv) {_RUN} as pcum, sum(cs) {_RUN} as ccs, sum(ps) {_RUN} as pcs,
    coalesce(last_value(cg ignore nulls) {_RUN}, 0) as cg, coalesce(last_value(pg ignore nulls) {_RUN}, 0) as pg from
    (select x.symbol, x.session_date, x.strike, y.bar, coalesce(cv, 0) as cv, coalesce(pv, 0) as pv, coalesce(cs, 0) as cs, coalesce(ps, 0) as ps, cg, pg
     from (select distinct symbol, session_date, strike from agg24) x join (select distinct symbol, session_date, bar from agg24) y
     on x.symbol = y.symbol and x.session_date = y.session_date
     left join agg24 a on a.symbol = x.symbol and a.session_date = x.session_date and a.strike = x.strike and a.bar = y.bar)""")


@query("lad24_session_build", KEY + "strike:1 call_vol:0 put_vol:0 call_cumvol:0 put_cumvol:0 gex:2 gex_signed:2 spot:5",
       q("""select f.symbol, f.session_date, f.bar, f.strike, cv as call_vol, pv as put_vol, ccum as call_cumvol, pcum as put_cumvol, s.spot,
            (cg * ccum - pg * pcum) * s.spot * s.spot as gex, -(cg * ccs + pg * pcs) * s.spot * s.spot as gex_signed
            from fill24 f left join spot24 s on f.symbol = s.symbol and f.session_date = s.session_date and f.bar = s.bar"""))
def _(spark, d):
    return ch.build_session(fx.option_bars(spark, d), CFG)[0]


@query("lad24_session_prints", KEY + "strike:1 option_type:s premium:4 side:s size:0 trade_type:s underlying_price:6",
       q("""select p.symbol, p.session_date, p.bar, p.strike, type as option_type, premium, side, v as size,
            case when v >= 500 then 'block' else 'regular' end as trade_type, g.spot as underlying_price
            from sided p left join pgrid g on p.symbol = g.symbol and p.session_date = g.session_date and p.bar = g.bar"""))
def _(spark, d):
    return ch.build_session(fx.option_bars(spark, d), CFG)[1]


define("dense2", """select x.symbol, x.session_date, g.bar, x.strike, x.type, b.c, coalesce(b.v, 0) as v, g.spot, greatest(390 - g.bar, 1) / 98280.0 as t
    from (select distinct symbol, session_date, strike, type from cbars) x join pgrid g on x.symbol = g.symbol and x.session_date = g.session_date and g.spot is not null
    left join cbars b on b.symbol = x.symbol and b.session_date = x.session_date and b.strike = x.strike and b.type = x.type and b.bar = g.bar""")
define("solved2", bisected("select * from dense2 where c is not null", mk.TRADING_RATE, "1e-6"))
define("wide2", """select d.symbol, d.session_date, d.bar, d.strike, max(d.spot) as s, max(d.t) as t, d.strike as k, 0.045 as r, max(d.c) filter (d.type = 'C') as call_prem,
    max(d.c) filter (d.type = 'P') as put_prem, coalesce(max(d.v) filter (d.type = 'C'), 0) as call_vol, coalesce(max(d.v) filter (d.type = 'P'), 0) as put_vol,
    max(i.iv) filter (d.type = 'C') as iv_call, max(i.iv) filter (d.type = 'P') as iv_put, avg(i.iv) as sg
    from dense2 d left join solved2 i on d.symbol = i.symbol and d.session_date = i.session_date and d.bar = i.bar and d.strike = i.strike and d.type = i.type
    group by 1, 2, 3, 4""")


@query("lad24_bar_ladder", KEY + "strike:1 call_prem:5 put_prem:5 call_vol:0 put_vol:0 iv_call:6 iv_put:6 gex:3",
       q(f"select *, {_GM} * (call_vol - put_vol) * 100 * s * s * 0.01 as gex from wide2"))
def _(spark, d):
    return ch.bar_session(fx.option_bars(spark, d), CFG)[0]


@query("lad24_bar_prints", KEY + "strike:1 option_type:s premium:4 side:s trade_type:s",
       q("""select *, case type when 'C' then 'call' else 'put' end as option_type, c * v * 100 as premium,
            case when v > 3 * case when k >= 5 then m else v end then 'sweep' else 'block' end as trade_type from
            (select *, case when coalesce(c - lag(c) over w, 0) >= 0 then 'ask' else 'bid' end as side,
             count(v) over (partition by symbol, session_date, strike, type order by bar rows 29 preceding) as k,
             median(v) over (partition by symbol, session_date, strike, type order by bar rows 29 preceding) as m
             from dense2 window w as (partition by symbol, session_date, strike, type order by bar)) where c * v > 0"""))
def _(spark, d):
    return ch.bar_session(fx.option_bars(spark, d), CFG)[1]


define("dayclose", "select symbol, session_date, arg_max(spot, bar) as close from grid where spot is not null group by 1, 2")
define("cday", "select symbol, session_date, strike, type, sum(v) as vol from cbars group by 1, 2, 3, 4")
_DG = "exp(-0.5 * pow((ln(close / strike) + (0.045 + 0.5 * 0.18 * 0.18) / 252.0) / (0.18 * sqrt(1 / 252.0)), 2)) / sqrt(2 * pi()) / (close * 0.18 * sqrt(1 / 252.0))"


@query("agg06_contract_ladder", "symbol:s session_date:d strike:1 gex:4 call_oi:0 put_oi:0 call_vol:0 put_vol:0",
       q("""select symbol, session_date, strike, max(spot) * max(spot) * (coalesce(avg(gm) filter (type = 'C'), 0) * coalesce(sum(oi) filter (type = 'C'), 0)
            - coalesce(avg(gm) filter (type = 'P'), 0) * coalesce(sum(oi) filter (type = 'P'), 0)) as gex,
            coalesce(sum(oi) filter (type = 'C'), 0) as call_oi, coalesce(sum(oi) filter (type = 'P'), 0) as put_oi,
            coalesce(sum(v) filter (type = 'C'), 0) as call_vol, coalesce(sum(v) filter (type = 'P'), 0) as put_vol
            from (select *, 150.0 as spot, (seq % 97) / 1000.0 as gm, cast(seq % 13 as double) as oi from optbars) group by 1, 2, 3"""))
def _(spark, d):
    c = fx.option_bars(spark, d).withColumns({"spot": F.lit(150.0), "gamma": (F.col("seq") % 97) / 1000.0,
                                              "oi": (F.col("seq") % 13).cast("double"), "vol": F.col("v")})
    return ch.contract_ladder(c, SESSION)


@query("lad28_past_session_ladder", "symbol:s session_date:d strike:1 gex:4 call_oi:0 put_oi:0",
       q(f"""select c.symbol, c.session_date, c.strike, max(close * close) * max({_DG}) * (coalesce(sum(vol) filter (type = 'C'), 0) - coalesce(sum(vol) filter (type = 'P'), 0)) as gex,
            coalesce(sum(vol) filter (type = 'C'), 0) as call_oi, coalesce(sum(vol) filter (type = 'P'), 0) as put_oi
            from cday c join dayclose k on c.symbol = k.symbol and c.session_date = k.session_date group by 1, 2, 3"""))
def _(spark, d):
    return ch.past_session_ladder(bars(spark, d), fe.daily_table(grid(spark, d)))


@query("jn08_outer_sides", KEY + "strike:1 cv:0 pv:0",
       q("""select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.session_date, b.session_date) as session_date, coalesce(a.bar, b.bar) as bar,
            coalesce(a.strike, b.strike) as strike, coalesce(a.v, 0) as cv, coalesce(b.v, 0) as pv
            from (select * from cbars where type = 'C') a full join (select * from cbars where type = 'P') b
            on a.symbol = b.symbol and a.session_date = b.session_date and a.bar = b.bar and a.strike = b.strike"""))
def _(spark, d):
    return (ch.sides_wide(bars(spark, d), ch.SNAP_STRIKE, {"v": "v"})
            .fillna(0.0, subset=["call_v", "put_v"]).withColumnsRenamed({"call_v": "cv", "put_v": "pv"}))


# snapshots of cumulative day volume
define("csnap", """select symbol, session_date, strike, cast(ceil(bar / 60.0) * 60 as int) as bar, type, arg_max(cum, bar) as dayvol, arg_max(vw, bar) as dayvwap
    from (select *, sum(v) over (partition by symbol, session_date, strike, type order by bar) as cum from cbars) group by 1, 2, 3, 4, 5""")
define("cwide", """select symbol, session_date, bar, strike, max(dayvol) filter (type = 'C') as call_dayvol, max(dayvol) filter (type = 'P') as put_dayvol,
    max(dayvwap) filter (type = 'C') as call_dayvwap, max(dayvwap) filter (type = 'P') as put_dayvwap from csnap group by 1, 2, 3, 4""")


def snapshots(spark, d):
    w = ch.contract_window().rowsBetween(Window.unboundedPreceding, 0)
    b = bars(spark, d).withColumn("cum", F.sum("v").over(w)).withColumn("src", F.col("bar")).withColumn("bar", ch.snap_label(F.col("bar"), 60))
    s = b.groupBy(*ch.CONTRACT, "bar").agg(F.max_by("cum", "src").alias("dayvol"), F.max_by("vw", "src").alias("dayvwap"))
    return ch.sides_wide(s, ch.SNAP_STRIKE, {"dayvol": "dayvol", "dayvwap": "dayvwap"}).withColumns(
        {"call_close": F.lit(None).cast("double"), "put_close": F.lit(None).cast("double")})


@query("snk06_fold_snapshots", KEY + "strike:1 call_vol:0 put_vol:0 call_prem:4 put_prem:4 call_cumvol:0 put_cumvol:0 volume:0",
       q("""select *, call_vol + put_vol as volume, call_vol * coalesce(call_dayvwap, 0) * 100 as call_prem, put_vol * coalesce(put_dayvwap, 0) * 100 as put_prem,
            call_dayvol as call_cumvol, put_dayvol as put_cumvol from
            (select *, greatest(0, coalesce(call_dayvol - lag(call_dayvol) over w, call_dayvol)) as call_vol,
             greatest(0, coalesce(put_dayvol - lag(put_dayvol) over w, put_dayvol)) as put_vol from cwide
             window w as (partition by symbol, session_date, strike order by bar))"""))
def _(spark, d):
    return ch.fold_snapshots(snapshots(spark, d))


@query("agg24_price_mode", "symbol:s session_date:d mode_price:2",
       q("""select symbol, session_date, arg_max(p, {'n': n, 'p': -p}) as mode_price from
            (select symbol, session_date, round(c) as p, count(*) as n from optbars where round(c) > 0 group by 1, 2, 3) group by 1, 2"""))
def _(spark, d):
    return ch.price_mode(fx.option_bars(spark, d).withColumn("p", F.round("c")), list(SESSION), "p")


@query("agg25_volume_strike", "symbol:s session_date:d volume_strike:1",
       q("""select symbol, session_date, arg_max(strike, {'v': v, 'k': -strike}) as volume_strike from
            (select symbol, session_date, strike, sum(v) as v from optbars group by 1, 2, 3) group by 1, 2"""))
def _(spark, d):
    return ch.busiest_strike(fx.option_bars(spark, d), list(SESSION))


@query("lad27_underlying_price", "symbol:s session_date:d spot:4 spot_source:s",
       q("""select k.symbol, k.session_date, coalesce(c.close, k.vs) as spot, case when c.close is not null then 'quote' else 'volume_strike' end as spot_source
            from (select symbol, session_date, arg_max(strike, {'v': v, 'k': -strike}) as vs from
                  (select symbol, session_date, strike, sum(v) as v from optbars group by 1, 2, 3) group by 1, 2) k
            left join dayclose c on k.symbol = c.symbol and k.session_date = c.session_date"""))
def _(spark, d):
    quote = fe.daily_table(grid(spark, d)).select(*SESSION, F.col("close").alias("quote"))
    base = ch.busiest_strike(fx.option_bars(spark, d), list(SESSION)).join(quote, list(SESSION), "left")
    return ch.resolve_underlying(base.withColumn("given", F.lit(None).cast("double")))


@query("flt10_strike_hints", "symbol:s session_date:d lo:5 hi:5",
       q("""select symbol, session_date, coalesce(case when isodow(session_date) <> 3 then dl end, lag(pl) over w - 5, a) - 8 as lo,
            coalesce(case when isodow(session_date) <> 3 then dh end, lag(ph) over w + 5, b) + 8 as hi from
            (select l.symbol, l.session_date, l.a, l.b, g.low as dl, g.high as dh, g.low as pl, g.high as ph from
             (select symbol, session_date, quantile_cont(strike, 0.35) as a, quantile_cont(strike, 0.65) as b
              from (select distinct symbol, session_date, strike from optbars) group by 1, 2) l
             left join gdaily g on l.symbol = g.symbol and l.session_date = g.session_date)
            window w as (partition by symbol order by session_date)"""))
def _(spark, d):
    day = fe.daily_table(grid(spark, d))
    # Wednesdays stand for sessions without a daily range
    return ch.strike_hints(day.filter(F.weekday("session_date") != 2), fx.option_bars(spark, d), day, 8.0)


@query("up13_contract_ticker", "ticker:s n:i",
       q("""select concat('O:', symbol, strftime(session_date, '%y%m%d'), type, lpad(cast(cast(round_even(strike * 1000, 0) as bigint) as varchar), 8, '0')) as ticker,
            count(*) as n from optbars group by 1"""))
def _(spark, d):
    t = mk.contract_ticker(F.col("symbol"), F.col("session_date"), F.col("type"), F.col("strike"))
    return fx.option_bars(spark, d).groupBy(t.alias("ticker")).agg(F.count(F.lit(1)).alias("n"))
