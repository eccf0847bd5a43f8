"""Vendor JSON payloads landed as text, parsed with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BARS = "struct<ticker:string,results:array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double,vw:double,n:bigint>>>"
CONTRACTS = "struct<results:array<struct<ticker:string,strike_price:double,contract_type:string,expiration_date:date>>>"
SNAPSHOT = ("struct<results:array<struct<details:struct<strike_price:double,contract_type:string>,"
            "greeks:struct<delta:double,gamma:double,vega:double,theta:double>,"
            "day:struct<volume:double,vwap:double,close:double>,open_interest:double,implied_volatility:double,"
            "underlying_asset:struct<price:double>,last_quote:struct<bid:double,ask:double>,last_trade:struct<price:double>>>>")


def aggregate_bars(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """{ticker, results:[{t,o,h,l,c,v,vw,n}]} -> one row per bar."""
    p = raw.select(F.from_json(payload, BARS).alias("p"))
    return p.select(F.col("p.ticker").alias("ticker"), F.explode("p.results").alias("r")).select(
        "ticker", F.timestamp_millis("r.t").alias("ts"), "r.o", "r.h", "r.l", "r.c", "r.v", "r.vw", "r.n")


def contract_list(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Contract reference pages -> (ticker, strike, type, expiry), one row per ticker."""
    p = raw.select(F.explode(F.from_json(payload, CONTRACTS)["results"]).alias("r"))
    d = p.select("r.ticker", F.col("r.strike_price").alias("strike"), F.upper(F.substring("r.contract_type", 1, 1)).alias("type"),
                 F.col("r.expiration_date").alias("expiry")).dropna()
    return d.groupBy("ticker").agg(F.min(F.struct("expiry", "strike", "type")).alias("s")).select("ticker", "s.*")


def nearest_expiry(contracts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Contracts of each session: those expiring that day, else the nearest later expiry.

    Expiries and sessions are calendar-sized, so the later one is found on a merged date line.
    """
    from pyspark.sql import Window
    dates = contracts.select(F.col("expiry").alias("d"), F.col("expiry")).distinct().unionByName(
        sessions.select(F.col("session_date").alias("d")).distinct(), allowMissingColumns=True).groupBy("d").agg(
        F.max("expiry").alias("expiry"))
    w = Window.orderBy("d").rowsBetween(0, Window.unboundedFollowing)
    chosen = dates.select(F.col("d").alias("session_date"), F.first("expiry", ignorenulls=True).over(w).alias("expiry"))
    return sessions.join(chosen, "session_date").join(contracts, "expiry")


def chain_snapshot(raw: DataFrame, payload: str = "payload", keys: tuple[str, ...] = ("symbol", "ts"), window: float | None = None,
                   delay_minutes: int = 15) -> DataFrame:
    """Nested chain snapshot -> one row per strike with call_/put_ columns, price and dealer gamma.

    The price is the payload's, else the median of C - P + K over the three strikes nearest the money.
    The feed runs ``delay_minutes`` late: ``ts_feed`` is the event time.
    """
    r = raw.select(*keys, F.explode(F.from_json(payload, SNAPSHOT)["results"]).alias("r"))
    flat = r.select(*keys, F.col("r.details.strike_price").alias("strike"),
                    F.upper(F.substring("r.details.contract_type", 1, 1)).alias("type"),
                    F.col("r.open_interest").alias("oi"), F.col("r.implied_volatility").alias("iv"), "r.greeks.delta", "r.greeks.gamma",
                    "r.greeks.vega", "r.greeks.theta", F.col("r.day.volume").alias("dayvol"), F.col("r.day.vwap").alias("dayvwap"),
                    F.col("r.day.close").alias("close"), F.col("r.last_trade.price").alias("last"), "r.last_quote.bid", "r.last_quote.ask",
                    F.col("r.underlying_asset.price").alias("px")).filter(F.col("strike").isNotNull())
    fields = ("oi", "iv", "delta", "gamma", "vega", "theta", "dayvol", "dayvwap", "close", "bid", "ask", "last")
    aggs = [F.max(F.when(F.col("type") == t, F.col(f))).alias(f"{s}_{f}") for t, s in (("C", "call"), ("P", "put")) for f in fields]
    wide = flat.groupBy(*keys, "strike").agg(*aggs, F.max("px").alias("_px"))
    gap = F.col("call_last") - F.col("put_last")
    per = wide.groupBy(*keys).agg(
        F.max("_px").alias("_given"),
        F.slice(F.array_sort(F.collect_list(F.when(gap.isNotNull(), F.struct(F.abs(gap).alias("a"), F.col("strike").alias("k"),
                                                                           (gap + F.col("strike")).alias("p"))))), 1, 3).alias("_near"))
    three = F.array_sort(F.transform("_near", lambda x: x["p"]))
    n = F.size(three)
    mid = F.when(n == 0, F.lit(None)).when(n == 2, (three[0] + three[1]) / 2).otherwise(F.try_element_at(three, F.ceil(n / 2).cast("int")))
    spot = per.select(*keys, F.coalesce("_given", mid).alias("spot"))
    d = wide.drop("_px").join(spot, list(keys))
    if window is not None:
        d = d.filter(F.abs(F.col("strike") - F.col("spot")) <= window)
    from tapegrid.operators.chain import gex_ladder
    return gex_ladder(d, "oi").withColumn("ts_feed", F.col("ts") - F.expr(f"interval {delay_minutes} minutes"))


# ---------------------------------------------------------------- push messages
def _num(p: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(p, "$." + x).try_cast("double") for x in paths])


def _instant(p: Column) -> Column:
    """executed_at, timestamp or time; epoch milliseconds or text (naive text is UTC)."""
    raw = F.coalesce(*[F.get_json_object(p, "$." + x) for x in ("executed_at", "timestamp", "time")])
    return F.coalesce(F.when(raw.rlike(r"^\d+$"), F.timestamp_millis(raw.try_cast("bigint"))), F.try_to_timestamp(raw))


TICK = ("kind", "ts", "spot", "strike", "gex", "vanna", "charm", "call_oi", "put_oi", "call_vol", "put_vol", "premium", "option_type",
        "side", "trade_type", "size")


def normalise_messages(raw: DataFrame, channel: str = "channel", payload: str = "payload") -> DataFrame:
    """[channel, payload] messages -> tick rows; works on static and streaming frames.

    One message yields an array of ticks (a list payload yields one per element, a trade also its
    underlying price), exploded once: no union, so a stream is read once. Unknown channels give kind
    'unknown'.
    """
    ch, p = F.col(channel), F.col(payload)
    dbl = lambda: F.lit(None).cast("double")
    txt = lambda: F.lit(None).cast("string")

    def tick(kind: str, ts: Column, **v) -> Column:
        cols = []
        for c in TICK:
            if c == "kind":
                cols.append(F.lit(kind).alias(c))
            elif c == "ts":
                cols.append(ts.alias(c))
            else:
                cols.append(v.get(c, txt() if c in ("option_type", "side", "trade_type") else dbl()).alias(c))
        return F.struct(*cols)

    tags = F.transform(F.coalesce(F.from_json(F.get_json_object(p, "$.tags"), "array<string>"), F.array().cast("array<string>")), F.lower)
    has = lambda word: F.exists(tags, lambda t: t.contains(word))
    side = F.lower(F.get_json_object(p, "$.side"))
    side = F.when(F.length(side) > 0, side).when(has("ask"), "ask").when(has("bid"), "bid").otherwise("mid")
    kind = F.when(has("dark"), "dark_pool").when(has("sweep"), "sweep").when(has("block"), "block").otherwise("regular")
    otype = F.when(F.lower(F.get_json_object(p, "$.option_type")).startswith("c"), "C").otherwise("P")
    zero = F.lit(0.0)
    trade = tick("flow", _instant(p), premium=F.coalesce(_num(p, "premium"), zero), option_type=otype, strike=_num(p, "strike"), side=side,
                 trade_type=kind, size=F.coalesce(_num(p, "size", "volume"), zero))
    under = tick("spot", _instant(p), spot=_num(p, "underlying_price"))
    price = tick("spot", _instant(p), spot=_num(p, "price", "close", "last"))
    rows = F.when(F.ltrim(p).startswith("["), F.from_json(p, "array<string>")).otherwise(F.array(p))
    gex = F.transform(rows, lambda r: tick(
        "chain", _instant(r), strike=_num(r, "strike"), gex=F.coalesce(_num(r, "gamma_per_one_percent_move_dir", "gex"), zero),
        call_oi=F.coalesce(_num(r, "call_oi", "call_open_interest"), zero), put_oi=F.coalesce(_num(r, "put_oi", "put_open_interest"), zero),
        call_vol=F.coalesce(_num(r, "call_volume"), zero), put_vol=F.coalesce(_num(r, "put_volume"), zero),
        vanna=_num(r, "vanna_per_one_percent_move_dir"), charm=_num(r, "charm_per_one_percent_move_dir")))
    ticks = (F.when(ch.startswith("option_trades"), F.when(_num(p, "underlying_price").isNotNull(), F.array(trade, under)).otherwise(F.array(trade)))
             .when(ch.startswith("gex"), gex)
             .when(ch.startswith("price"), F.filter(F.array(price), lambda t: t["spot"].isNotNull()))
             .otherwise(F.array(tick("unknown", F.lit(None).cast("timestamp")))))
    rest = [c for c in raw.columns if c not in (channel, payload)]
    return raw.select(*rest, ch.alias("channel"), F.inline(ticks))


def merged_stream(spot: DataFrame, chain: DataFrame, flow: DataFrame, session: str | None = None) -> DataFrame:
    """Three stored tables as one kind-tagged event table, time-ordered when written or sorted."""
    def tag(df, kind):
        cols = [c for c in df.columns if c in TICK or c in ("symbol", "seq")]
        return df.select(F.lit(kind).alias("kind"), *cols)
    d = tag(spot, "spot").unionByName(tag(chain, "chain"), allowMissingColumns=True).unionByName(tag(flow, "flow"), allowMissingColumns=True)
    return d.filter(F.col("ts").cast("date") == F.lit(session).cast("date")) if session else d
