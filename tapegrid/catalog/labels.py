"""Queries over targets, splits, scaling and sequence windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapegrid.catalog.features import CFG, grid, price_grid
from tapegrid.catalog.registry import query
from tapegrid.catalog.sqlbase import SW, define, q
from tapegrid.config import SEQUENCE_EXCLUDE, FeatureConfig
from tapegrid.operators import features as fe, grid as gr, scaling as sc, sequences as sq, splits as sp, targets as tg
from tapegrid.operators.windows import SESSION
from tapegrid.plans import fixtures as fx
from tapegrid.plans.session import materialise

KEY = "symbol:s session_date:d bar:i "
HS = FeatureConfig().horizons
_T = []
for _h, _m in HS:
    _f = (f"last_value(spot) over (partition by symbol, session_date order by bar rows between unbounded preceding and unbounded following)"
          if _m is None else f"lead(spot, {max(1, _m // 5)}) over {SW}")
    _t = "greatest(390.0 - bar, 1)" if _m is None else str(float(_m))
    _T.append(f"""{_f} as "y_price_{_h}", ln({_f}) - ln(spot) as "y_ret_{_h}", {_f} - spot as "y_dprice_{_h}",
        (ln({_f}) - ln(spot)) / nullif(rv_1m * sqrt({_t}), 0) as "y_retn_{_h}" """)
define("targets", f"select symbol, session_date, bar, spot, rv_1m, 390.0 - bar as y_eod_minutes_ahead, {', '.join(_T)} from price")


@query("tgt01_targets", KEY + "y_eod_minutes_ahead:1 " + " ".join(
    f"y_price_{h}:4 y_ret_{h}:8 y_dprice_{h}:4 y_retn_{h}:6" for h, _ in HS), q("select * from targets"))
def _(spark, d):
    return tg.horizon_targets(price_grid(spark, d), CFG)


@query("jn20_forward_lookup", KEY + "spot:4 fwd:4", q(f"select *, lead(spot, 6) over {SW} as fwd from grid"))
def _(spark, d):
    from tapegrid.operators.windows import by_bar
    return grid(spark, d).withColumn("fwd", F.lead("spot", 6).over(by_bar()))


define("exc", """select symbol, session_date, bar, spot, cast(bar // 15 as int) as bucket,
    case when count(spot) over w >= 5 then greatest(max(spot) over w - spot, 0) end as up,
    case when count(spot) over w >= 5 then greatest(spot - min(spot) over w, 0) end as dn
    from grid where spot is not null
    window w as (partition by symbol, session_date order by bar rows between 1 following and 6 following)""")


def exc(spark, d):
    return tg.excursions(grid(spark, d), CFG)


@query("tgt02_excursion", KEY + "up:4 dn:4 bucket:i", q("select * from exc"))
def _(spark, d):
    return exc(spark, d)


@query("jn21_forward_range", KEY + "spot:4 up:4 dn:4", q("select * from exc where up is not null"))
def _(spark, d):
    return exc(spark, d).filter("up is not null")


define("excmed", "select symbol, session_date, bucket, (median(up) + median(dn)) / 2 as e from exc group by 1, 2, 3")


@query("agg22_tod_median", "symbol:s session_date:d bucket:i exc:5", q("select *, e as exc from excmed"))
def _(spark, d):
    return tg.bucket_medians(exc(spark, d))


define("basegrid", """select s.symbol, s.session_date, b.bucket, m.e from (select distinct symbol, session_date from excmed) s
    join (select symbol, unnest(range(min(bucket), max(bucket) + 1)) as bucket from excmed group by symbol) b on s.symbol = b.symbol
    left join excmed m on s.symbol = m.symbol and s.session_date = m.session_date and b.bucket = m.bucket""")
define("base0", """select *, case when count(e) over w >= 5 then quantile_cont(e, 0.5) over w end as raw from basegrid
    window w as (partition by symbol, bucket order by session_date rows between 20 preceding and 1 preceding)""")
define("base", """select symbol, session_date, bucket, last_value(raw ignore nulls) over
    (partition by symbol, bucket order by session_date) as base from base0""")


@query("win14_rolling_bucket_median", "symbol:s session_date:d bucket:i base:5", q("select * from base"))
def _(spark, d):
    return tg.tod_baseline(tg.bucket_medians(exc(spark, d)))


define("mags0", """select e.*, b.base as b0 from exc e left join base b
    on e.symbol = b.symbol and e.session_date = b.session_date and e.bucket = b.bucket""")
define("mags1", """select m.*, greatest(coalesce(b0, med, 0.5), 0.05) as base from mags0 m
    left join (select symbol, median(b0) as med from mags0 group by 1) g on m.symbol = g.symbol""")
_MAG = "round_even(greatest(0, least(10, 10 * (1 - pow(2, -greatest({0} / base, 0))))), 1)"
define("mags", f"select *, case when up is not null then {_MAG.format('up')} end as mag_up, case when dn is not null then {_MAG.format('dn')} end as mag_dn from mags1")


def mags(spark, d):
    return tg.magnitude_targets(exc(spark, d), store=materialise)


@query("tgt03_tod_baseline", KEY + "bucket:i base:5 mag_up:1 mag_dn:1", q("select * from mags"))
def _(spark, d):
    return mags(spark, d)


@query("jn13_bucket_baseline", KEY + "bucket:i base:5",
       q("""select e.symbol, e.session_date, e.bar, e.bucket, b.base from exc e left join base b
            on e.symbol = b.symbol and e.session_date = b.session_date and e.bucket = b.bucket"""))
def _(spark, d):
    e = exc(spark, d)
    return e.join(tg.tod_baseline(tg.bucket_medians(e)), [*SESSION, "bucket"], "left")


@query("tgt03_baseline_now", "symbol:s bucket:i base:5",
       q("""select symbol, bucket, arg_max(base, session_date) as base from mags where session_date < date '2024-01-25' group by 1, 2"""))
def _(spark, d):
    return tg.baseline_now(mags(spark, d), "2024-01-25")


@query("tgt04_big_move", KEY + "big_move:i",
       q("""select *, case when count(spot) over f >= 20 and count(spot) over b >= 20 then
            cast(max(spot) over f - min(spot) over f > 2 * (max(spot) over b - min(spot) over b) as int) end as big_move from grid
            window f as (partition by symbol, session_date order by bar rows between 1 following and 20 following),
            b as (partition by symbol, session_date order by bar rows 19 preceding)"""))
def _(spark, d):
    return tg.big_move(grid(spark, d))


# ---------------------------------------------------------------- splits over the order calendar
define("days", """select session_date, row_number() over (order by session_date) - 1 as r, count(*) over () as n
    from (select distinct session_date from daily)""")


def days(spark, d):
    return sp.session_dates(fx.daily(spark, d))


@query("set05_distinct_sessions", "session_date:d ordinal:i", q("select session_date, r as ordinal from days"))
def _(spark, d):
    return days(spark, d)


define("chrono", """select *, case when r < greatest(1, floor(0.7 * n)) then 'train'
    when r >= greatest(1, floor(0.7 * n)) + 1 and r < greatest(1, floor(0.7 * n)) + 1 + greatest(1, floor(0.15 * n)) then 'val'
    when r >= greatest(1, floor(0.7 * n)) + 2 + greatest(1, floor(0.15 * n)) then 'test' else 'embargo' end as split from days""")


@query("spl01_chrono_split", "session_date:d split:s", q("select * from chrono"))
def _(spark, d):
    return sp.chrono_split(days(spark, d))


@query("spl01_split_rows", "split:s n:i lo:d hi:d",
       q("""select split, count(*) as n, min(c.session_date) as lo, max(c.session_date) as hi
            from orders join chrono c on cast(o_orderdate as date) = c.session_date group by 1"""))
def _(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("session_date"))
    return sp.with_split(o, sp.chrono_split(days(spark, d))).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("session_date").alias("lo"), F.max("session_date").alias("hi"))


define("folds", """select k as fold, session_date, case when r < n - (3 - k) * greatest(1, n // 5) - 1 then 'train'
    when r >= n - (3 - k) * greatest(1, n // 5) and r < n - (3 - k) * greatest(1, n // 5) + greatest(1, n // 5) then 'val' end as role
    from days cross join (values (0), (1), (2)) as f(k) where n - (3 - k) * greatest(1, n // 5) - 1 >= 3""")


@query("spl02_rolling_folds", "fold:i role:s session_date:d", q("select * from folds where role is not null"))
def _(spark, d):
    return sp.rolling_folds(days(spark, d))


@query("spl02_row_fallback", "symbol:s session_date:d bar:i role:s",
       q("""select *, case when r < greatest(1, n - greatest(1, floor(n * 0.2)) - 30) then 'train'
            when r >= n - greatest(1, floor(n * 0.2)) then 'val' else 'embargo' end as role from
            (select *, row_number() over (order by session_date, bar, symbol) - 1 as r, count(*) over () as n from grid)"""))
def _(spark, d):
    return sp.row_split(grid(spark, d), ["symbol"])


@query("spl03_holdout", "role:s session_date:d",
       q("""select *, case when r < n - greatest(1, round_even(n * 0.2, 0)) - 1 then 'train'
            when r >= n - greatest(1, round_even(n * 0.2, 0)) then 'val' end as role from days where r < n - greatest(1, round_even(n * 0.2, 0)) - 1 or r >= n - greatest(1, round_even(n * 0.2, 0))"""))
def _(spark, d):
    return sp.holdout(days(spark, d))


@query("spl04_recent_screen", "session_date:d", q("select session_date from days where r >= n - greatest(3, floor(n * 0.5))"))
def _(spark, d):
    return sp.newest_share(days(spark, d), 0.5)


@query("spl05_test_days", "session_date:d", q("select session_date from days where r >= n - greatest(3, floor(n * 0.15))"))
def _(spark, d):
    return sp.newest_share(days(spark, d), 0.15)


@query("set04_embargo_sessions", "session_date:d", q("select session_date from chrono where split = 'embargo'"))
def _(spark, d):
    s = sp.chrono_split(days(spark, d))
    return s.select("session_date").exceptAll(s.filter("split <> 'embargo'").select("session_date"))


@query("jn18_semi_sessions", "o_orderkey:i", q("""select o_orderkey from orders where cast(o_orderdate as date) in
       (select session_date from chrono where split = 'test')"""))
def _(spark, d):
    o = fx.table(spark, d, "orders").withColumn("session_date", F.col("o_orderdate").cast("date"))
    return o.join(sp.chrono_split(days(spark, d)).filter("split = 'test'"), "session_date", "left_semi")


@query("jn19_anti_sessions", "session_date:d n:i",
       q("""select session_date, count(*) as n from (select cast(l_shipdate as date) as session_date from lineitem) l
            where not exists (select 1 from daily where daily.session_date = l.session_date) group by 1"""))
def _(spark, d):
    li = fx.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("session_date"))
    counts = li.groupBy("session_date").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(fx.daily(spark, d).select("session_date"), "session_date", "left_anti")


@query("flt05_last_sessions", "session_date:d n:i",
       q("""select cast(l_shipdate as date) as session_date, count(*) as n from lineitem group by 1
            qualify dense_rank() over (order by session_date desc) <= 60"""))
def _(spark, d):
    li = fx.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("session_date"))
    return gr.last_sessions(li, 60).groupBy("session_date").agg(F.count(F.lit(1)).alias("n"))


@query("flt06_date_range", "session_date:d close:2", q("select session_date, close from daily where session_date between date '1997-01-01' and date '1998-06-30'"))
def _(spark, d):
    return fx.daily(spark, d).filter(F.col("session_date").between(F.lit("1997-01-01").cast("date"), F.lit("1998-06-30").cast("date")))


@query("win16_decay", "session_date:d age:i weight:9",
       q("select session_date, n - 1 - r as age, pow(0.5, (n - 1 - r) / 60.0) as weight from days"))
def _(spark, d):
    return sp.decay_weight(days(spark, d), 60.0)


@query("up12_opex_flags", "session_date:d monthly:b quad:b",
       q("""select session_date, isodow(session_date) = 5 and day(session_date) between 15 and 21 as monthly,
            isodow(session_date) = 5 and day(session_date) between 15 and 21 and month(session_date) in (3, 6, 9, 12) as quad from days"""))
def _(spark, d):
    from tapegrid.functions import clock
    c = F.col("session_date")
    return days(spark, d).withColumns({"monthly": clock.third_friday(c), "quad": clock.quad_witching(c)})


# ---------------------------------------------------------------- scaling
COLS = ["ret_1m", "ret_5m", "rv_1m", "pos_in_session_range", "dist_to_twap", "hist_gap_pct", "flag"]
define("feat", """select p.symbol, p.session_date, p.bar, ret_1m, ret_5m, rv_1m, pos_in_session_range, dist_to_twap, h.hist_gap_pct,
    cast(p.bar >= 90 as double) as flag, p.session_date < date '2024-01-22' as train from price p
    left join hist h on p.symbol = h.symbol and p.session_date = h.session_date""")
_q = "union all".join(f" select '{c}' as column_name, count(*) as rows, count({c}) as n, count(distinct {c}) as nun, coalesce(median({c}), 0) as fill from feat where train " for c in COLS)
define("sc0", _q)
_q = "union all".join(f""" select '{c}' as column_name, quantile_cont(x, 0.05) as q05, quantile_cont(x, 0.5) as center, quantile_cont(x, 0.95) as q95
    from (select coalesce({c}, (select fill from sc0 where column_name = '{c}')) as x from feat where train) """ for c in COLS)
define("sc1", _q)
define("scp", """select a.column_name, fill, center, case when q95 - q05 > 0 then q95 - q05 else 1 end as scale, n < rows as has_null,
    nun <= 2 as is_binary from sc0 a join sc1 b on a.column_name = b.column_name""")


def feats(spark, d):
    f = fe.prior_session(price_grid(spark, d)).withColumn("flag", (F.col("bar") >= 90).cast("double"))
    return f.withColumn("train", F.col("session_date") < F.lit("2024-01-22").cast("date"))


def fitted(spark, d):
    return sc.fit_scaler(feats(spark, d).filter("train"), COLS, store=materialise)


@query("scl01_scaler_params", "column_name:s fill:7 center:7 scale:7 has_null:b is_binary:b", q("select * from scp"))
def _(spark, d):
    return fitted(spark, d)


_X = ", ".join(f"""(select case when is_binary then coalesce({c}, fill) else greatest(-8.0, least(8.0, (coalesce({c}, fill) - center) / scale)) end
    from scp where column_name = '{c}') as {c}, (select case when has_null then cast({c} is null as int) end from scp where column_name = '{c}') as {c}__isna""" for c in COLS)


@query("scl01_transform", KEY + " ".join(f"{c}:6 {c}__isna:0" for c in COLS), q(f"select symbol, session_date, bar, {_X} from feat"))
def _(spark, d):
    return sc.transform(feats(spark, d), fitted(spark, d), COLS, [*SESSION, "bar"])


AUDIT = ["ret_1m", "ret_5m", "pos_in_session_range", "hist_gap_pct", "flag"]


@query("agg12_null_audit", "column_name:s n_rows:i null_frac:7 n_distinct:i",
       q("union all".join(f" select '{c}' as column_name, count(*) as n_rows, avg(cast({c} is null as int)) as null_frac, count(distinct {c}) as n_distinct from feat " for c in AUDIT)))
def _(spark, d):
    return sc.null_audit(feats(spark, d), AUDIT)


FLAGS = ["A", "N", "R"]


@query("agg13_quantiles", "horizon:s q005:8 q05:8 q50:8 q95:8 q995:8",
       q("""select horizon, quantile_cont(pnl_net, 0.005) as q005, quantile_cont(pnl_net, 0.05) as q05, quantile_cont(pnl_net, 0.5) as q50,
            quantile_cont(pnl_net, 0.95) as q95, quantile_cont(pnl_net, 0.995) as q995 from trades group by 1"""))
def _(spark, d):
    from tapegrid.operators.quantiles import exact_quantiles
    return exact_quantiles(fx.trades(spark, d), ["horizon"], "pnl_net", [0.005, 0.05, 0.5, 0.95, 0.995],
                           ["q005", "q05", "q50", "q95", "q995"], domain=FLAGS)


define("wz", """select horizon, quantile_cont(pnl_net, 0.005) as lo, quantile_cont(pnl_net, 0.995) as hi from trades group by 1""")


@query("scl02_winsor", "horizon:s lo:8 hi:8 mid:8",
       q("""select t.horizon, max(lo) as lo, max(hi) as hi, median(greatest(lo, least(hi, pnl_net))) as mid
            from trades t join wz on t.horizon = wz.horizon group by 1"""))
def _(spark, d):
    return sc.winsorise(fx.trades(spark, d), "horizon", FLAGS, "pnl_net").withColumnRenamed("offset", "mid")


define("mc", "select horizon, median(pnl_net) as center from trades group by 1")


@query("scl03_mad", "horizon:s center:5 scale:5",
       q("""select t.horizon, max(center) as center, 1.4826 * median(abs(pnl_net - center)) as scale
            from trades t join mc on t.horizon = mc.horizon group by 1"""))
def _(spark, d):
    return sc.mad_params(fx.trades(spark, d), "horizon", FLAGS, "pnl_net")


@query("agg14_mad_scale", "column_name:s center:6 scale:6",
       q("""select 'price' as column_name, median(o_totalprice) as center, 1.4826 * median(abs(o_totalprice - (select median(o_totalprice) from orders))) as scale from orders"""))
def _(spark, d):
    o = fx.table(spark, d, "orders").select(F.lit("price").alias("column_name"), F.col("o_totalprice").alias("v"))
    return sc.mad_params(o, "column_name", ["price"], "v")


# ---------------------------------------------------------------- sequences
SEQ = ["ret_1m", "pos_in_session_range", "dist_to_twap"]


@query("seq01_windows", KEY + "n_rows:i width:i newest:5 oldest:5 total:4",
       q(f"""select symbol, session_date, bar, 12 as n_rows, 3 as width, cast(coalesce(dist_to_twap, 0) as float) as newest,
            lag(cast(coalesce(dist_to_twap, 0) as float), 11) over {SW} as oldest,
            sum(cast(cast(coalesce(pos_in_session_range, 0) as float) as double)) over (partition by symbol, session_date order by bar rows 11 preceding) as total
            from price qualify row_number() over {SW} >= 12"""))
def _(spark, d):
    w = sq.windows(price_grid(spark, d), SEQ, 12)
    x = F.col("x_seq")
    return w.select(*SESSION, "bar", F.size(x).alias("n_rows"), F.size(x[0]).alias("width"), x[11][2].alias("newest"),
                    x[0][2].alias("oldest"), F.aggregate(x, F.lit(0.0), lambda a, r: a + r[1]).alias("total"))


@query("seq01_static_known", KEY + "dow:0 prior_ret:7 opex:0 ahead:2 frac:6 sine:6 frac_eod:3",
       q("""select g.symbol, g.session_date, g.bar, isodow(g.session_date) - 1 as dow, coalesce(hist_prior_ret, 0) as prior_ret,
            cast(isodow(g.session_date) = 5 and day(g.session_date) between 15 and 21 as int) as opex, greatest(390 - g.bar - 30, 0) as ahead,
            1 - greatest(390 - g.bar - 30, 0) / 390.0 as frac, sin(2 * pi() * (1 - greatest(390 - g.bar - 30, 0) / 390.0)) as sine, 1.0 as frac_eod
            from grid g left join hist h on g.symbol = h.symbol and g.session_date = h.session_date"""))
def _(spark, d):
    s = sq.static_inputs(sq.known_future(fe.prior_session(grid(spark, d)), CFG))
    k, st = F.col("x_known"), F.col("x_static")
    return s.select(*SESSION, "bar", st[0].alias("dow"), st[1].alias("prior_ret"), st[4].alias("opex"),
                    k[2][0].alias("ahead"), k[2][1].alias("frac"), k[2][2].alias("sine"), k[4][1].alias("frac_eod"))


PROFILED = ["spot", "ret_1m", "rv_1m", "ret_10m", "ret_20m", "rv_1m_d5m", "dead", "gap", "thin"]
define("lagged", f"""select spot, ret_1m, rv_1m, coalesce(ln(spot) - lag(ln(spot), 10) over {SW}, 0) as ret_10m, coalesce(ln(spot) - lag(ln(spot), 20) over {SW}, 0) as ret_20m,
    coalesce(rv_1m - lag(rv_1m, 5) over {SW}, 0) as rv_1m_d5m, 1.0 as dead, case when bar >= 120 then spot end as gap, case when bar >= 300 then spot end as thin from price""")


def profiled(cols, source):
    return " union all ".join(f"select '{c}' as column_name, count(*) as n, count(*) - count({c}) as nulls, min({c}) as low, max({c}) as high from {source}" for c in cols)


def lagged_frame(spark, d):
    lagged = fe.lag_block(price_grid(spark, d).select(*SESSION, "bar", "spot", "ret_1m", "rv_1m"), FeatureConfig(lag_return_rows=(1, 10, 20), lag_state_rows=(5,)))
    late = lambda b: F.when(F.col("bar") >= b, F.col("spot"))
    return lagged.withColumns({"dead": F.lit(1.0), "gap": late(120), "thin": late(300)})


@query("flt07_column_exclusion", "column_name:s n:i nulls:i low:6 high:6 kept:b",
       q(f"""select *, not regexp_matches(column_name, '{SEQUENCE_EXCLUDE}') and coalesce(nulls <= 0.5 * n and low < high, false) as kept from ({profiled(PROFILED, "lagged")})"""))
def _(spark, d):
    return sq.usable(sq.column_profile(lagged_frame(spark, d), PROFILED))
