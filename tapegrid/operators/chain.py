"""From option bars to the ladder feed: parity price, implied vol, greeks, snapshot aggregates, dealer gamma.

A contract is (symbol, session_date, strike, type). Raw rows collapse to contract bars
first, so contract windows hold one session of bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapegrid.config import SessionConfig
from tapegrid.functions import clock, market as mk
from tapegrid.operators.grid import fill_grid
from tapegrid.operators.windows import SESSION, back_fill, carry

CONTRACT = (*SESSION, "strike", "type")
SNAP_STRIKE = (*SESSION, "bar", "strike")
MULTIPLIER = 100.0


def contract_window():
    return Window.partitionBy(*CONTRACT).orderBy("bar")


def contract_bars(raw: DataFrame, cfg: SessionConfig, label: str = "end") -> DataFrame:
    """One row per (contract, bar): last close, summed volume, volume-weighted price.

    Regular hours with the closing minute left out. ``label='start'`` floors the bar, as in files whose
    label precedes the data; the default labels a bar when it is complete.
    """
    bar = clock.ceil_bar(F.col("ts"), cfg) if label == "end" else clock.floor_bar(F.col("ts"), cfg, cfg.bar_minutes)
    t = raw.filter(clock.in_session(F.col("ts"), cfg, "left")).withColumns(
        {"session_date": clock.local_date(F.col("ts"), cfg.tz), "bar": bar})
    g = t.groupBy(*CONTRACT, "bar").agg(
        F.max_by("c", clock.order_key(F.col("ts"), F.col("seq"))).alias("c"), F.sum("v").alias("v"),
        F.sum(F.col("c") * F.col("v")).alias("_cv"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("vw", F.when(F.col("v") > 0, F.col("_cv") / F.col("v")).otherwise(F.col("c"))).drop("_cv")


def sides_wide(df: DataFrame, keys: tuple[str, ...], values: dict[str, str]) -> DataFrame:
    """Pivot type C/P into call_/put_ columns by conditional aggregation (fixed columns, one shuffle)."""
    aggs = []
    for letter, side in (("C", "call"), ("P", "put")):
        on = F.col("type") == letter
        aggs += [F.max(F.when(on, F.col(src))).alias(f"{side}_{dst}") for src, dst in values.items()]
    return df.groupBy(*keys).agg(*aggs)


def pairs(bars: DataFrame) -> DataFrame:
    """Call and put close of the same bar and strike, both present."""
    w = sides_wide(bars, SNAP_STRIKE, {"c": "close"})
    return w.filter(F.col("call_close").isNotNull() & F.col("put_close").isNotNull())


def parity_spot(bars: DataFrame, strikes: int = 3) -> DataFrame:
    """Median of C - P + K over the strikes nearest the money, per bar."""
    gap = F.col("call_close") - F.col("put_close")
    p = pairs(bars).withColumns({"parity": gap + F.col("strike"), "_gap": F.abs(gap)})
    w = Window.partitionBy(*SESSION, "bar").orderBy("_gap", "strike")
    near = p.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= strikes)
    return near.groupBy(*SESSION, "bar").agg(F.percentile("parity", F.lit(0.5)).alias("spot"))


def parity_grid(bars: DataFrame, cfg: SessionConfig, fill: str = "causal") -> DataFrame:
    """Parity price on the dense grid; ``fill='both'`` also fills backwards to the open."""
    g = fill_grid(parity_spot(bars), cfg)
    return g.withColumn("spot", F.coalesce("spot", back_fill("spot"))) if fill == "both" else g


def tick_rule(bars: DataFrame, two_way: bool = False) -> DataFrame:
    prev = F.lag("c").over(contract_window())
    d = bars.withColumn("side", mk.tick_side(F.col("c"), prev, two_way))
    return d.withColumns({"signed_v": mk.signed_volume(F.col("side"), F.col("v")),
                          "premium": F.col("vw") * F.col("v") * MULTIPLIER})


def volume_class(bars: DataFrame, rows: int = 30, least: int = 5, ratio: float = 3.0) -> DataFrame:
    """sweep when volume exceeds ``ratio`` times its rolling median, else block (before warm-up: block)."""
    f = contract_window().rowsBetween(-(rows - 1), 0)
    med = F.when(F.count("v").over(f) >= least, F.percentile("v", F.lit(0.5)).over(f))
    v = F.col("v")
    return bars.withColumn("trade_type", F.when(v > ratio * F.coalesce(med, v), "sweep").otherwise("block"))


def enrich(bars: DataFrame, cfg: SessionConfig, spot: DataFrame, fill: str = "causal", year: float = mk.CALENDAR_YEAR,
           rate: float = mk.CALENDAR_RATE, default_vol: float = 0.2) -> DataFrame:
    """Spot, implied vol, gamma, delta, premium and tick side per contract bar."""
    from tapegrid.functions.pricing import implied_vol, option_delta
    call = F.col("type") == "C"
    d = bars.join(spot.select(*SESSION, "bar", "spot"), [*SESSION, "bar"], "left")
    t = (F.lit(float(cfg.length)) - F.col("bar")) / year
    d = d.withColumn("t_years", F.greatest(t, F.lit(0.0)))
    d = d.withColumn("iv", implied_vol("c", "spot", "strike", "t_years", call, F.lit(rate)))
    w = contract_window()
    iv = carry("iv", w) if fill == "causal" else F.coalesce(carry("iv", w), back_fill("iv", w))
    d = tick_rule(d).withColumn("_iv", F.coalesce(iv, F.lit(default_vol)))
    safe_t = F.greatest(F.col("t_years"), F.lit(1e-9))
    return d.withColumns({
        "gamma": mk.bs_gamma(F.col("spot"), F.col("strike"), safe_t, F.col("_iv"), rate),
        "delta": option_delta(F.col("spot"), F.col("strike"), F.col("t_years"), F.col("_iv"), call, rate)}).drop("_iv", "t_years")


def to_prints(enriched: DataFrame) -> DataFrame:
    """Trade-print feed from contract bars."""
    return enriched.select(
        *SESSION, "bar", "strike", F.col("type").alias("option_type"), "premium", "side", F.col("v").alias("size"),
        F.col("n").alias("n_trades"), F.col("c").alias("price"), F.col("vw").alias("vwap"), "iv", "delta", "gamma",
        F.col("spot").alias("underlying_price"), mk.size_class(F.col("v")).alias("trade_type"))


def snap_label(bar: Column, minutes: int, label: str = "end") -> Column:
    if label == "start":
        return (F.floor(bar / minutes) * minutes).cast("int")
    return (F.ceil(bar / minutes) * minutes).cast("int")


SUMS = ("vol", "prem", "ask_prem", "bid_prem", "signed_v")
LEVELS = ("iv", "gamma", "delta", "close")


def snapshot_aggregate(enriched: DataFrame, minutes: int, label: str = "end") -> DataFrame:
    """Per (snapshot, strike): call_/put_ sums of volume and premium, mean greeks, last close. One shuffle."""
    d = enriched.withColumn("_src", F.col("bar")).withColumn("bar", snap_label(F.col("bar"), minutes, label))
    have = set(d.columns)
    aggs = []
    for letter, side in (("C", "call"), ("P", "put")):
        on = F.col("type") == letter
        pick = lambda c, extra=None: F.when(on if extra is None else on & extra, F.col(c))
        aggs += [F.sum(pick("v")).alias(f"{side}_vol"), F.sum(pick("premium")).alias(f"{side}_prem"),
                 F.sum(pick("premium", F.col("side") == "ask")).alias(f"{side}_ask_prem"),
                 F.sum(pick("premium", F.col("side") == "bid")).alias(f"{side}_bid_prem"),
                 F.sum(pick("signed_v")).alias(f"{side}_signed_v"),
                 *[F.avg(pick(c)).alias(f"{side}_{c}") for c in ("iv", "gamma", "delta") if c in have],
                 F.max_by("c", F.when(on, F.col("_src"))).alias(f"{side}_close")]
    g = d.groupBy(*SNAP_STRIKE).agg(*aggs)
    return g.fillna(0.0, subset=[f"{s}_{c}" for s in ("call", "put") for c in SUMS])


def dense_ladder(agg: DataFrame) -> DataFrame:
    """Every snapshot time of a session for every strike of that session.

    Both sets are bounded (bars per session, listed strikes), the times ride along as one array, and
    nothing is cross joined: the rows are the dense index itself.
    """
    times = agg.groupBy(*SESSION).agg(F.collect_set("bar").alias("_bars"))
    strikes = agg.select(*SESSION, "strike").distinct()
    index = strikes.join(times, list(SESSION)).select(*SESSION, "strike", F.explode("_bars").alias("bar"))
    return index.join(agg, list(SNAP_STRIKE), "left")


def fill_ladder(dense: DataFrame) -> DataFrame:
    """Quiet strikes: zero flow, last known level; then running volume since the open."""
    w = Window.partitionBy(*SESSION, "strike").orderBy("bar")
    sums = [f"{s}_{c}" for s in ("call", "put") for c in SUMS if f"{s}_{c}" in dense.columns]
    levels = [f"{s}_{c}" for s in ("call", "put") for c in LEVELS if f"{s}_{c}" in dense.columns]
    d = dense.fillna(0.0, subset=sums).withColumns({c: carry(c, w) for c in levels})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumns({
        "call_cumvol": F.sum("call_vol").over(run), "put_cumvol": F.sum("put_vol").over(run),
        "call_cum_signed": F.sum("call_signed_v").over(run), "put_cum_signed": F.sum("put_signed_v").over(run),
        "volume": F.col("call_vol") + F.col("put_vol")})


def gex_ladder(df: DataFrame, mode: str, spot: Column | str = "spot") -> DataFrame:
    """Dealer gamma per strike and 1 % move.

    minute_volume: one gamma times call minus put volume of the bar; cum_volume: both gammas times volume
    since the open; oi: both gammas times open interest; signed: minus both gammas times signed volume.
    """
    s = F.col(spot) if isinstance(spot, str) else spot
    unit = s * s * 0.01 * MULTIPLIER
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    if mode == "minute_volume":
        g, src = F.col("gamma") * (z("call_vol") - z("put_vol")) * unit, "volume"
    elif mode == "cum_volume":
        g, src = (z("call_gamma") * z("call_cumvol") - z("put_gamma") * z("put_cumvol")) * unit, "volume"
    elif mode == "oi":
        g, src = (z("call_gamma") * z("call_oi") - z("put_gamma") * z("put_oi")) * unit, "oi"
    elif mode == "signed":
        return df.withColumn("gex_signed", -(z("call_gamma") * z("call_cum_signed") + z("put_gamma") * z("put_cum_signed")) * unit)
    else:
        raise ValueError(f"unknown mode {mode}")
    return df.withColumns({"gex": g, "gex_source": F.lit(src)})


def build_session(raw: DataFrame, cfg: SessionConfig, snap_minutes: int | None = None, compat: bool = False):
    """Option bars -> (ladder feed, print feed, price feed). ``compat`` labels at bar start and fills backwards."""
    label, fill = ("start", "both") if compat else ("end", "causal")
    step = snap_minutes or cfg.snap_minutes
    bars = contract_bars(raw, cfg, label)
    spot = parity_grid(bars, cfg, fill)
    rich = enrich(bars, cfg, spot, fill)
    lad = fill_ladder(dense_ladder(snapshot_aggregate(rich, step, label)))
    at = spot.withColumn("_src", F.col("bar")).withColumn("bar", snap_label(F.col("bar"), step, label)).groupBy(*SESSION, "bar").agg(
        F.max_by("spot", F.when(F.col("spot").isNotNull(), F.col("_src"))).alias("spot"))
    lad = lad.join(at, [*SESSION, "bar"], "left")
    lad = gex_ladder(gex_ladder(lad, "cum_volume"), "signed")
    return lad, to_prints(rich), spot.select(*SESSION, "bar", "spot")


def bar_session(raw: DataFrame, cfg: SessionConfig, spot: DataFrame | None = None, year: float = mk.TRADING_YEAR, rate: float = mk.TRADING_RATE):
    """Second builder's conventions: option bars -> (ladder feed, print feed), one ladder row per bar and listed strike.

    Trading-year time with at least one minute left, volume of the bar alone, one gamma from the mean of both
    implied vols, nothing carried: a bar without a trade has no premium and no gamma. Every contract is laid on
    all bars that have a price; the side compares with the bar before (ask where that is empty), sweeps stand out
    of the last 30 bars, quiet ones included.
    """
    from tapegrid.functions.pricing import implied_vol_bounded
    bars = contract_bars(raw, cfg)
    at = (parity_grid(bars, cfg) if spot is None else spot).select(*SESSION, "bar", "spot").filter(F.col("spot").isNotNull())
    clock_bars = F.sequence(F.lit(0), F.lit(int(cfg.length)), F.lit(int(cfg.bar_minutes)))
    every = bars.select(*CONTRACT).distinct().withColumn("bar", F.explode(clock_bars))
    d = every.join(at, [*SESSION, "bar"]).join(bars.select(*CONTRACT, "bar", "c", "v"), [*CONTRACT, "bar"], "left")
    d = d.withColumns({"v": F.coalesce("v", F.lit(0.0)), "t_years": F.greatest(F.lit(float(cfg.length)) - F.col("bar"), F.lit(1.0)) / year})
    d = volume_class(d).withColumns({
        "side": mk.tick_side(F.col("c"), F.lag("c").over(contract_window()), two_way=True),
        "premium": F.col("c") * F.col("v") * MULTIPLIER,
        "iv": implied_vol_bounded("c", "spot", "strike", "t_years", F.col("type") == "C", F.lit(rate))})
    lad = sides_wide(d, (*SNAP_STRIKE, "spot", "t_years"), {"c": "prem", "v": "vol", "iv": "iv"})
    a, b = F.col("call_iv"), F.col("put_iv")
    mean = F.coalesce((a + b) / 2.0, a, b)
    lad = lad.withColumn("gamma", mk.bs_gamma(F.col("spot"), F.col("strike"), F.col("t_years"), mean, rate))
    lad = lad.withColumns({f"{s}_vol": F.coalesce(f"{s}_vol", F.lit(0.0)) for s in ("call", "put")})
    lad = gex_ladder(lad, "minute_volume").withColumnsRenamed({"call_iv": "iv_call", "put_iv": "iv_put"}).drop("t_years")
    prints = d.filter(F.col("premium") > 0).withColumn("option_type", F.when(F.col("type") == "C", "call").otherwise("put"))
    return lad, prints.select(*SESSION, "bar", "strike", "option_type", "premium", "side", "trade_type")


def contract_ladder(contracts: DataFrame, keys: tuple[str, ...], spot: str = "spot", sign: float = 1.0) -> DataFrame:
    """Contract rows (type, strike, gamma, oi, vol) -> strike ladder with dealer gamma."""
    call, put = F.col("type") == "C", F.col("type") == "P"
    zero = F.lit(0.0)
    z = lambda c: F.coalesce(F.col(c), zero)
    d = contracts.groupBy(*keys, "strike").agg(
        F.max(spot).alias("_s"), F.coalesce(F.avg(F.when(call, z("gamma"))), zero).alias("_cg"),
        F.coalesce(F.avg(F.when(put, z("gamma"))), zero).alias("_pg"),
        F.sum(F.when(call, z("oi")).otherwise(0.0)).alias("call_oi"), F.sum(F.when(put, z("oi")).otherwise(0.0)).alias("put_oi"),
        F.sum(F.when(call, z("vol")).otherwise(0.0)).alias("call_vol"), F.sum(F.when(put, z("vol")).otherwise(0.0)).alias("put_vol"))
    unit = sign * F.col("_s") * F.col("_s") * 0.01 * MULTIPLIER
    return d.withColumn("gex", unit * (F.col("_cg") * F.col("call_oi") - F.col("_pg") * F.col("put_oi"))).drop("_s", "_cg", "_pg")


def past_session_ladder(bars: DataFrame, close: DataFrame, vol: float = 0.18, rate: float = mk.TRADING_RATE) -> DataFrame:
    """Daily ladder of a past session: day volume stands in for open interest, gamma at one trading day."""
    day = bars.groupBy(*CONTRACT).agg(F.sum("v").alias("vol")).join(close.select(*SESSION, F.col("close").alias("spot")), list(SESSION))
    g = mk.bs_gamma(F.col("spot"), F.col("strike"), F.lit(1.0 / 252.0), F.lit(vol), rate)
    return contract_ladder(day.withColumns({"gamma": g, "oi": F.col("vol")}), SESSION)


def fill_greeks(ladder: DataFrame, spot: DataFrame, cfg: SessionConfig, year: float = mk.TRADING_YEAR,
                rate: float = mk.TRADING_RATE) -> DataFrame:
    """Volume-weighted, dealer-signed vanna and charm where the feed has none."""
    s, k = F.col("_s"), F.col("strike")
    vol = F.coalesce((F.col("iv_call") + F.col("iv_put")) / 2.0, F.col("iv_call"), F.col("iv_put"))
    d = ladder.join(spot.select(*SESSION, "bar", F.col("spot").alias("_s")), [*SESSION, "bar"], "left")
    d = d.withColumns({"_t": F.greatest(F.lit(float(cfg.length)) - F.col("bar"), F.lit(1.0)) / year, "_vol": vol})
    net = (F.coalesce("call_vol", F.lit(0.0)) - F.coalesce("put_vol", F.lit(0.0))) * MULTIPLIER * s
    t, v = F.col("_t"), F.col("_vol")
    new = {"vanna": mk.bs_vanna(s, k, t, v, rate) * net * 0.01, "charm": mk.bs_charm(s, k, t, v, rate) * net * (390.0 / year)}
    return d.withColumns({c: F.coalesce(F.col(c), e) if c in ladder.columns else e for c, e in new.items()}).drop("_s", "_t", "_vol")


def fold_snapshots(snaps: DataFrame) -> DataFrame:
    """Cumulative day volume -> volume and premium per snapshot; order is the feed time (bar)."""
    w = Window.partitionBy(*SESSION, "strike").orderBy("bar")
    out = {}
    for side in ("call", "put"):
        cum = F.col(f"{side}_dayvol")
        step = F.greatest(F.coalesce(cum - F.lag(cum).over(w), cum), F.lit(0.0))
        out[f"{side}_vol"] = step
        out[f"{side}_prem"] = step * F.coalesce(f"{side}_dayvwap", f"{side}_close", F.lit(0.0)) * MULTIPLIER
        out[f"{side}_cumvol"] = cum
    d = snaps.withColumns(out)
    return d.withColumn("volume", F.col("call_vol") + F.col("put_vol"))


# ---------------------------------------------------------------- underlying price
def price_mode(payloads: DataFrame, keys: list[str], price: str) -> DataFrame:
    """Most frequent positive price per key, ties to the smallest. Counts combine map-side per price."""
    n = payloads.filter(F.col(price) > 0).groupBy(*keys, price).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.max_by(price, F.struct("_n", -F.col(price))).alias("mode_price"))


def busiest_strike(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Strike with the most volume, ties to the lowest."""
    n = rows.groupBy(*keys, "strike").agg(F.sum("v").alias("_v"))
    return n.groupBy(*keys).agg(F.max_by("strike", F.struct("_v", -F.col("strike"))).alias("volume_strike"))


def resolve_underlying(base: DataFrame, strict: bool = False) -> DataFrame:
    """First positive of given, payload mode, quote and busiest strike, with its source."""
    order = [c for c in ("given", "mode_price", "quote", "volume_strike") if c in base.columns]
    pos = [F.when(F.col(c) > 0, F.col(c)) for c in order]
    src = F.coalesce(*[F.when(F.col(c) > 0, F.lit(c)) for c in order])
    spot = F.coalesce(*pos)
    if strict:
        spot = F.when(spot.isNull(), F.raise_error(F.lit("no underlying price")).cast("double")).otherwise(spot)
    return base.withColumns({"spot": spot, "spot_source": src})


def strike_hints(daily: DataFrame, listed: DataFrame, previous: DataFrame, window: float, pad: float = 5.0) -> DataFrame:
    """[lo, hi] strikes per session: daily range, else previous session's price range +- pad, else the middle
    35-65 % of listed strikes; widened by ``window``."""
    mid = listed.select(*SESSION, "strike").distinct().groupBy(*SESSION).agg(
        F.percentile("strike", F.lit(0.35)).alias("_a"), F.percentile("strike", F.lit(0.65)).alias("_b"))
    w = Window.partitionBy("symbol").orderBy("session_date")
    d = (mid.join(daily.select(*SESSION, F.col("low").alias("_dl"), F.col("high").alias("_dh")), list(SESSION), "left")
         .join(previous.select(*SESSION, F.col("low").alias("_pl"), F.col("high").alias("_ph")), list(SESSION), "left"))
    d = d.withColumns({"_ql": F.lag("_pl").over(w) - pad, "_qh": F.lag("_ph").over(w) + pad})
    return d.select(*SESSION, (F.coalesce("_dl", "_ql", "_a") - window).alias("lo"), (F.coalesce("_dh", "_qh", "_b") + window).alias("hi"))
