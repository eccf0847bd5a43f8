"""Queries over the option ladder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapegrid.catalog.features import CFG, grid, price_grid
from tapegrid.catalog.registry import query
from tapegrid.catalog.sqlbase import SW, define, q, sdiv
from tapegrid.operators import asof, ladder as ld, physics as ph
from tapegrid.plans import fixtures as fx

KEY = "symbol:s session_date:d bar:i "
COLS = (*ld.LEVELS, "call_vol", "put_vol")


def rows(spark, d):
    return ld.strike_rows(fx.ladder(spark, d), CFG, COLS)


def spotted(spark, d):
    return ld.with_spot(rows(spark, d), grid(spark, d))


def state(spark, d):
    """Ladder rows with spot, minutes to close and volatility of the snapshot bar."""
    g = price_grid(spark, d).select("symbol", "session_date", "bar", "spot", "rv_1m", "minutes_to_close").filter("spot is not null")
    r = ph.ladder_state(rows(spark, d)).join(g, list(ld.SNAP))
    return ph.attractor_masses(ph.implied_move(r))


define("lrows", """select symbol, session_date, cast(ceil(us / 3600000000.0) * 60 - 570 as int) as bar, strike,
    arg_max(gex, ts) filter (gex is not null) as gex, arg_max(vanna, ts) filter (vanna is not null) as vanna,
    arg_max(charm, ts) filter (charm is not null) as charm, arg_max(call_oi, ts) as call_oi, arg_max(put_oi, ts) as put_oi,
    arg_max(call_vol, ts) as call_vol, arg_max(put_vol, ts) as put_vol
    from ladder where us > 8 * 3600000000 and us <= 16 * 3600000000 group by 1, 2, 3, 4 having bar between 0 and 390""")
define("lspot", """select l.*, g.spot, coalesce(gex, 0.0) as g from lrows l join grid g
    on l.symbol = g.symbol and l.session_date = g.session_date and l.bar = g.bar where g.spot is not null""")


@query("agg09_last_nonnull", KEY + "strike:1 gex:4 vanna:4 charm:4 call_oi:0 put_oi:0", q("select * from lrows"))
def _(spark, d):
    return rows(spark, d)


@query("jn02_ladder_spot", KEY + "strike:1 spot:4 gex:4", q("select * from lspot"))
def _(spark, d):
    return spotted(spark, d)


@query("flt03_strike_band", KEY + "strike:1 spot:4", q("select * from lspot where abs(strike - spot) <= 15"))
def _(spark, d):
    return spotted(spark, d).filter(F.abs(F.col("strike") - F.col("spot")) <= 15)


@query("flt04_whole_strikes", KEY + "strike:1 half:2", q("select *, strike / 2 as half from lrows where (strike / 2) % 1 = 0"))
def _(spark, d):
    return rows(spark, d).withColumn("half", F.col("strike") / 2).filter(F.col("half") % 1 == 0)


@query("flt09_thick_snapshots", KEY + "n:i",
       q("select symbol, session_date, bar, count(distinct strike) as n from lspot group by 1, 2, 3 having n >= 3"))
def _(spark, d):
    return ld.thick_snapshots(spotted(spark, d)).groupBy(*ld.SNAP).agg(F.count("strike").alias("n"))


SNW = "(partition by symbol, session_date, bar order by strike)"
define("cross0", f"""select *, lead(strike) over {SNW} as k1, lead(g) over {SNW} as g1,
    sum(g) over {SNW} as c0 from lspot""")
define("cross1", """select *, case when sign(g) * sign(g1) < 0 then strike - g * (k1 - strike) / (g1 - g) end as per,
    case when sign(c0) * sign(c0 + g1) < 0 then strike - c0 * (k1 - strike) / g1 end as cum from cross0""")
define("zero", """select symbol, session_date, bar, coalesce(
    arg_min(per, {'d': abs(per - spot), 'k': strike}) filter (per is not null),
    arg_min(cum, {'d': abs(cum - spot), 'k': strike}) filter (cum is not null)) as z from cross1 group by 1, 2, 3""")


@query("win22_sign_change", KEY + "strike:1 cross_strike:6", q("select *, per as cross_strike from cross1 where per is not null"))
def _(spark, d):
    return ld.with_profile(spotted(spark, d)).filter("cross_strike is not null")


define("pain", """select a.symbol, a.session_date, a.bar, a.strike,
    sum(b.call_oi * greatest(a.strike - b.strike, 0) + b.put_oi * greatest(b.strike - a.strike, 0)) as pain,
    count(b.call_oi) + count(b.put_oi) as n
    from lspot a join lspot b on a.symbol = b.symbol and a.session_date = b.session_date and a.bar = b.bar group by 1, 2, 3, 4""")
define("maxpain", """select symbol, session_date, bar, arg_min(strike, {'p': pain, 'k': strike}) filter (n >= 2) as mp
    from pain group by 1, 2, 3""")


@query("lad11_max_pain", KEY + "max_pain:1", q("select *, mp as max_pain from maxpain"))
def _(spark, d):
    return ld.with_profile(spotted(spark, d)).groupBy(*ld.SNAP).agg(ld.max_pain().alias("max_pain"))


@query("lad02_zero_level", KEY + "zero_level:6", q("select *, z as zero_level from zero"))
def _(spark, d):
    return ld.with_profile(spotted(spark, d)).groupBy(*ld.SNAP).agg(ld.zero_level().alias("zero_level"))


define("metrics0", """select symbol, session_date, bar, max(spot) as s, count(gex) as has, count(*) as n_strikes,
    sum(g) as gex_net_total, sum(abs(g)) as t, list_sum(list_sort(list(abs(g)), 'desc')[1:3]) as top3, sum(g * g) as sq,
    coalesce(sum(g) filter (abs(strike - spot) <= 3), 0) as bn, coalesce(sum(abs(g)) filter (abs(strike - spot) <= 3), 0) as ba,
    sum(g) filter (g > 0) as pm, sum(strike * g) filter (g > 0) as pk, sum(strike * abs(g)) as ka,
    arg_max(strike, {'g': abs(g), 'k': -strike}) as mk, arg_max(g, {'g': abs(g), 'k': -strike}) as mv,
    coalesce(max(g) filter (g > 0 and strike > spot), 0) as wa, coalesce(max(g) filter (g > 0 and strike < spot), 0) as wb,
    arg_max(strike, {'g': g, 'k': -strike}) filter (strike > spot) as wak,
    arg_max(strike, {'g': g, 'k': -strike}) filter (strike < spot) as wbk,
    coalesce(min(g) filter (strike > spot), 0) as na, coalesce(min(g) filter (strike < spot), 0) as nb,
    sum(vanna) as vt, sum(vanna) filter (abs(strike - spot) <= 3) as vb, sum(charm) as ct,
    sum(charm) filter (abs(strike - spot) <= 3) as cb from lspot group by 1, 2, 3""")
_M = {
    "gex_net_total": "gex_net_total", "gex_abs_total": "t", "gex_zero_level": "z", "gex_dist_to_zero": "s - z",
    "gex_dist_to_zero_pct": "(s - z) / s", "gex_above_zero": "cast(s > z as double)",
    "gex_top3_concentration": sdiv("top3", "t"), "gex_hhi": sdiv("sq", "(t * t)"), "gex_band_net": "bn",
    "gex_band_abs": "ba", "gex_band_share": sdiv("ba", "t"), "gex_pos_centroid": "pk / nullif(pm, 0)",
    "gex_pos_centroid_dist": "pk / nullif(pm, 0) - s", "gex_abs_centroid_dist": "ka / nullif(t, 0) - s",
    "gex_max_node_strike": "mk", "gex_max_node_value": "mv", "gex_max_node_dist": "mk - s", "gex_wall_above": "wa",
    "gex_wall_above_dist": "wak - s", "gex_wall_below": "wb", "gex_wall_below_dist": "s - wbk",
    "gex_neg_pocket_above": "na", "gex_neg_pocket_below": "nb", "vanna_net_total": "vt", "vanna_band_net": "vb",
    "charm_net_total": "ct", "charm_band_net": "cb", "max_pain": "mp", "max_pain_dist": "mp - s"}
define("metrics", "select m.symbol, m.session_date, m.bar, m.n_strikes, " + ", ".join(
    f"case when has > 0 then {e} end as {c}" for c, e in _M.items()) +
    """ from metrics0 m join zero z on m.symbol = z.symbol and m.session_date = z.session_date and m.bar = z.bar
    join maxpain p on m.symbol = p.symbol and m.session_date = p.session_date and m.bar = p.bar""")


def metrics(spark, d):
    return ld.snapshot_metrics(spotted(spark, d))


_GEX = [c for c in ld.GEX_COLUMNS]
_SPEC = " ".join(f"{c}:5" for c in _GEX)


@query("lad01_12_gex_profile", KEY + "n_strikes:i " + _SPEC, q("select * from metrics"))
def _(spark, d):
    return metrics(spark, d)


@query("tk02_top3_concentration", KEY + "gex_top3_concentration:6 gex_hhi:6", q("select * from metrics"))
def _(spark, d):
    return metrics(spark, d)


@query("tk04_extreme_strikes", KEY + "gex_max_node_strike:1 gex_wall_above_dist:4 gex_wall_below_dist:4 max_pain:1", q("select * from metrics"))
def _(spark, d):
    return metrics(spark, d)


@query("jn01_grid_snapshot", KEY + "spot:4 gex_net_total:5 gex_zero_level:5",
       q("""select g.symbol, g.session_date, g.bar, g.spot, gex_net_total, gex_zero_level from grid g left join metrics m
            on g.symbol = m.symbol and g.session_date = m.session_date and g.bar = m.bar"""))
def _(spark, d):
    return grid(spark, d).join(metrics(spark, d).drop("spot"), list(ld.SNAP), "left")


define("carried", "select g.symbol, g.session_date, g.bar, g.spot, g.bar - last_value(m.bar ignore nulls) over w as gex_snapshot_age_min, "
       + ", ".join(f"last_value({c} ignore nulls) over w as {c}" for c in _GEX) +
       """ from grid g left join metrics m on g.symbol = m.symbol and g.session_date = m.session_date and g.bar = m.bar
       window w as (partition by g.symbol, g.session_date order by g.bar)""")
_DECAY = ", ".join(f"""gex_band_net - lag(gex_band_net, {n}) over {SW} as gex_band_decay_{n}m,
    gex_dist_to_zero - lag(gex_dist_to_zero, {n}) over {SW} as gex_dist_zero_chg_{n}m,
    greatest(-50.0, least(50.0, {sdiv(f'(gex_band_net - lag(gex_band_net, {n}) over {SW})', 'abs(gex_band_abs)')})) as gex_band_decay_pct_{n}m""" for n in (5, 15))
define("gexgrid", f"select *, {_DECAY}, charm_band_net * (390.0 - bar) / 390.0 as charm_drift_to_close from carried")


@query("jn12_carry_forward", KEY + "gex_snapshot_age_min:i gex_net_total:5 gex_zero_level:5 max_pain:1", q("select * from carried"))
def _(spark, d):
    return ld.grid_metrics(grid(spark, d), metrics(spark, d), CFG)


@query("lad13_grid_carry", KEY + _SPEC + " gex_snapshot_age_min:i charm_drift_to_close:5 " + " ".join(
    f"gex_band_decay_{n}m:5 gex_band_decay_pct_{n}m:5 gex_dist_zero_chg_{n}m:5" for n in (5, 15)), q("select * from gexgrid"))
def _(spark, d):
    return ld.grid_metrics(grid(spark, d), metrics(spark, d), CFG)


@query("jn11_asof_ladder", KEY + "asof_bar:i strike:1 gex:4",
       q("""select g.symbol, g.session_date, g.bar, g.asof_bar, l.strike, l.gex from
            (select g.symbol, g.session_date, g.bar, (select max(l.bar) from lrows l where l.symbol = g.symbol
             and l.session_date = g.session_date and l.bar <= g.bar) as asof_bar from grid g) g
            join lrows l on l.symbol = g.symbol and l.session_date = g.session_date and l.bar = g.asof_bar
            qualify count(*) over (partition by g.symbol, g.session_date, g.bar) >= 3"""))
def _(spark, d):
    got = asof.snapshot_asof(grid(spark, d).select(*ld.SNAP), rows(spark, d))
    return ld.thick_snapshots(got)


# ---------------------------------------------------------------- physics
define("lstate0", """select l.symbol, l.session_date, l.bar, strike, l.spot, g, coalesce(call_oi, 0) + coalesce(put_oi, 0) as oi,
    coalesce(call_vol, 0) + coalesce(put_vol, 0) as vol, 390.0 - l.bar as mtc, p.rv_1m as rv0
    from lspot l join price p on l.symbol = p.symbol and l.session_date = p.session_date and l.bar = p.bar""")
define("lstate1", f"""select *, case when rv0 > 0 then spot * rv0 * sqrt(greatest(mtc, 1)) else 0.01 * spot end as im,
    0.60 * {sdiv('abs(g)', 'sum(abs(g)) over w')} + 0.25 * {sdiv('oi', 'sum(oi) over w')}
    + 0.15 * {sdiv('vol', 'sum(vol) over w')} as m from lstate0
    window w as (partition by symbol, session_date, bar)""")
define("lstate", """select *, case when sum(m) over w > 1e-9 then m / sum(m) over w else 1.0 / count(*) over w end as mass
    from lstate1 window w as (partition by symbol, session_date, bar)""")


@query("lad14_attractor_mass", KEY + "strike:1 mass:7", q("select * from lstate"))
def _(spark, d):
    return state(spark, d)


@query("lad17_implied_move", KEY + "spot:4 implied_move:6 rv_1m:8",
       q("""select symbol, session_date, bar, max(spot) as spot, max(im) as implied_move,
            max(case when rv0 > 0 then rv0 else im / (spot * sqrt(greatest(mtc, 1))) end) as rv_1m from lstate group by 1, 2, 3"""))
def _(spark, d):
    return state(spark, d).groupBy(*ld.SNAP).agg(*[F.max(c).alias(c) for c in ("spot", "implied_move", "rv_1m")])


@query("lad26_ladder_state", KEY + "strike:1 gex:4 call_oi:0 put_oi:0 volume:0",
       q("""select symbol, session_date, bar, strike, g as gex, coalesce(call_oi, 0) as call_oi, coalesce(put_oi, 0) as put_oi,
            coalesce(call_vol, 0) + coalesce(put_vol, 0) as volume from
            (select *, count(*) over (partition by symbol, session_date, bar) as n from lspot) where n >= 3
            union all
            select symbol, session_date, bar, floor(s) + o, 0.0, 0.0, 0.0, 0.0 from
            (select symbol, session_date, bar, max(spot) as s from lspot group by 1, 2, 3 having count(*) < 3),
            (values (-1.0), (0.0), (1.0)) as v(o)"""))
def _(spark, d):
    return ph.thin_fallback(ph.ladder_state(spotted(spark, d)))


define("clus0", f"""select *, lag(abs(g)) over {SNW} as pa, lead(abs(g)) over {SNW} as na, lag(strike) over {SNW} as pk from lstate""")
define("clus1", """select *, abs(g) < coalesce(pa, 'inf'::double) and abs(g) <= coalesce(na, 'inf'::double)
    and abs(g) < 0.6 * least(coalesce(pa, 'inf'::double), coalesce(na, 'inf'::double)) as valley from clus0""")
define("clus2", f"""select *, coalesce(strike - pk > %s, false) or coalesce(lag(valley) over {SNW}, false) as st from clus1""" % "5.0")
define("clus3", f"select *, sum(cast(st as int)) over {SNW} as cluster_id from clus2")
define("clus", """select symbol, session_date, bar, cluster_id, sum(mass) as mass, sum(g) as gex_sum, sum(abs(g)) as abs_gex_sum,
    sum(strike * (mass + 1e-9)) / sum(mass + 1e-9) as center, arg_max(strike, {'a': abs(g), 'k': strike}) as peak_strike,
    count(*) as n_strikes, max(spot) as spot from clus3 group by 1, 2, 3, 4""")


@query("win21_cluster_ids", KEY + "strike:1 cluster_id:i", q("select * from clus3"))
def _(spark, d):
    # the fixture ladder is spaced by 5 points, so neighbours merge up to that distance
    return ph.cluster_ids(state(spark, d), ph.PhysicsConfig(merge_points=5.0))


@query("lad15_clusters", KEY + "rank:i cluster_id:i mass:7 gex_sum:5 abs_gex_sum:5 center:5 peak_strike:1 n_strikes:i sign:i dist:5",
       q("""select *, sign(gex_sum) as sign, center - spot as dist, row_number() over
            (partition by symbol, session_date, bar order by abs_gex_sum desc, cluster_id) as rank from clus qualify rank <= 5"""))
def _(spark, d):
    return ph.clusters(state(spark, d), ph.PhysicsConfig(merge_points=5.0))


define("prof", """select l.symbol, l.session_date, l.bar, max(l.spot) as spot, max(mtc) as mtc, max(im) as im, max(z.z) as z,
    case when max(l.spot) < max(z.z) then 'negative_gamma' else 'positive_gamma' end as regime,
    coalesce(sum(mass) filter (abs(strike - l.spot) <= 3), 0) as band_mass_share,
    arg_max(strike, {'g': g, 'k': -strike}) filter (g > 0 and strike > l.spot) as wall_above,
    coalesce(arg_max(mass, {'g': g, 'k': -strike}) filter (g > 0 and strike > l.spot), 0) as wall_above_mass,
    arg_max(strike, {'g': g, 'k': -strike}) filter (g > 0 and strike < l.spot) as wall_below,
    coalesce(arg_max(mass, {'g': g, 'k': -strike}) filter (g > 0 and strike < l.spot), 0) as wall_below_mass,
    arg_max(strike, {'g': abs(g), 'k': -strike}) as peak_gex_strike
    from lstate l join zero z on l.symbol = z.symbol and l.session_date = z.session_date and l.bar = z.bar group by 1, 2, 3""")


@query("lad16_profile", KEY + "spot:4 zero_gamma_level:5 regime:s band_mass_share:7 wall_above:1 wall_above_mass:7 wall_below:1 wall_below_mass:7 peak_gex_strike:1",
       q("select *, z as zero_gamma_level from prof"))
def _(spark, d):
    return ph.profile(state(spark, d))


define("hdim", "select * from (values (0, '5m', 5.0), (1, '15m', 15.0), (2, '30m', 30.0), (3, '1h', 60.0), (4, 'eod', null)) as h(horizon_no, horizon, hm)")
define("scales", """select p.*, h.*, greatest(0.60 * im * least(1, sqrt(least(coalesce(hm, greatest(mtc, 1)), greatest(mtc, 1)) / greatest(mtc, 1))), 0.35)
    * case when regime = 'negative_gamma' then 1.6 else 1.0 end as sigma,
    case when regime = 'negative_gamma' then 0.55 else 1.0 end * case when hm is null then 1.0
    else pow(least(hm, greatest(mtc, 1)) / greatest(mtc, 1), 0.55) end as mass_scale from prof p cross join hdim h""")


@query("lad18_gravity", KEY + "horizon:s sigma:6 mass_scale:7 gravity:7",
       q("""select s.symbol, s.session_date, s.bar, s.horizon, max(sigma) as sigma, max(mass_scale) as mass_scale,
            sum(mass * mass_scale * exp(-0.5 * pow((strike - s.spot) / sigma, 2)) * (strike - s.spot)) / max(sigma * sigma) as gravity
            from scales s join lstate l on s.symbol = l.symbol and s.session_date = l.session_date and s.bar = l.bar group by 1, 2, 3, 4"""))
def _(spark, d):
    p = ph.horizon_scales(ph.horizon_rows(ph.profile(state(spark, d)))).withColumn("start", F.col("spot"))
    return ph.gravity(p)


MSHIFT = q("select * from scales join lstate").split("\nselect * from scales join lstate")[0]
SHIFT_SQL = MSHIFT.replace("with ", "with recursive ", 1) + ",\nmshift as (" + """
    select 0 as it, symbol, session_date, bar, horizon, spot as x0, sigma, mass_scale, spot as x, false as done from scales
    union all
    select max(it) + 1, symbol, session_date, bar, horizon, max(x0), max(sigma), max(mass_scale),
        case when bool_or(done) then max(x) else (sum(w * strike) + max(w0 * x0)) / (sum(w) + max(w0) + 1e-9) end,
        bool_or(done) or abs((sum(w * strike) + max(w0 * x0)) / (sum(w) + max(w0) + 1e-9) - max(x)) < 1e-4
    from (select t.*, l.strike, l.mass * t.mass_scale * exp(-0.5 * pow((l.strike - t.x) / t.sigma, 2)) as w,
          0.35 * exp(-0.5 * pow((t.x0 - t.x) / (2 * t.sigma), 2)) as w0
          from mshift t join lstate l on l.symbol = t.symbol and l.session_date = t.session_date and l.bar = t.bar
          where t.it < 40) group by symbol, session_date, bar, horizon)
"""


@query("lad19_mean_shift", KEY + "horizon:s physics_target:5",
       SHIFT_SQL + "select *, x as physics_target from mshift where it = 40")
def _(spark, d):
    return ph.targets(ph.profile(state(spark, d)))


@query("lad20_eod_pin", KEY + "eod_unsnapped:5 snap_radius:6 time_ramp:7 pin_strike:2 pin_mass:6 pin_strength:5",
       SHIFT_SQL + """, eod as (select m.symbol, m.session_date, m.bar, m.x as xe, p.im, p.mtc, p.regime, p.band_mass_share,
            greatest(0.35 * p.im, 0.5) as radius from mshift m join prof p on m.symbol = p.symbol
            and m.session_date = p.session_date and m.bar = p.bar where it = 40 and horizon = 'eod'),
        near as (select e.symbol, e.session_date, e.bar, arg_max(strike, {'m': mass, 'k': -strike}) as k, max(mass) as mass
            from eod e join lstate l on e.symbol = l.symbol and e.session_date = l.session_date and e.bar = l.bar
            where g > 0 and abs(strike - xe) <= radius group by 1, 2, 3),
        pin as (select e.*, n.k, n.mass, n.mass / (band_mass_share + 1e-9) as share,
            1 / (1 + exp(greatest(-60, least(60, (mtc - 30) / 10.0)))) as ramp
            from eod e left join near n on e.symbol = n.symbol and e.session_date = n.session_date and e.bar = n.bar)
        select symbol, session_date, bar, xe as eod_unsnapped, radius as snap_radius, ramp as time_ramp,
            case when share >= 0.22 then round_even(k / 0.5, 0) * 0.5 end as pin_strike,
            case when share >= 0.22 then mass else 0 end as pin_mass,
            case when share >= 0.22 then least(1, share / 0.44) * (0.35 + 0.65 * ramp) * (0.5 + 0.5 * (1 - least(abs(k - xe) / radius, 1)))
                * case when regime = 'negative_gamma' then 0.55 else 1 end else 0 end as pin_strength from pin""")
def _(spark, d):
    return ph.targets(ph.profile(state(spark, d))).filter("horizon = 'eod'")


