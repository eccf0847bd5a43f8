"""Leaderboard queries: best trials, records, plateaus, pruning bar.

Running values go through ``operators.running``, so even a node that owns a third
of all trials is spread over blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapegrid.functions.nulls import finite
from tapegrid.operators.quantiles import exact_quantiles
from tapegrid.operators.running import running, running_percentile
from tapegrid.plans.session import materialise

CURRENT = "eod_pre11"


def comparable(board: DataFrame, version: str = CURRENT) -> DataFrame:
    """Trials that finished, with a finite score on the current scale."""
    return board.withColumn("score", finite(F.col("score"))).filter(
        (F.col("status") == "ok") & (F.col("scoring_version") == version) & F.col("score").isNotNull())


def seed_bar(board: DataFrame, has_champion: bool = True, version: str = CURRENT) -> DataFrame:
    """Starting bar: best comparable score, +inf when there is none or no champion backs it."""
    inf = F.lit(float("inf"))
    best = comparable(board, version).agg(F.min("score").alias("_b"), F.count(F.lit(1)).alias("n_comparable"))
    return best.select(F.coalesce(F.col("_b"), inf).alias("bar") if has_champion else inf.alias("bar"), "n_comparable")


def best_trials(board: DataFrame, k: int) -> DataFrame:
    """Top-k report; orderBy + limit plans as a per-partition top-k, not a full sort."""
    return board.filter(F.col("score").isNotNull()).orderBy("score", "trial").limit(k)


def per_node(board: DataFrame, store=lambda d: d) -> DataFrame:
    med = exact_quantiles(board, ["node"], "seconds", [0.5], ["median_seconds"], store=store)
    ok = F.col("status") == "ok"
    return board.groupBy("node").agg(
        F.count(F.lit(1)).alias("trials"), F.sum(ok.cast("bigint")).alias("ok"), F.min(F.when(ok, F.col("score"))).alias("best_score"),
        F.sum((F.col("status") == "pruned").cast("bigint")).alias("pruned")).join(med, "node", "left")


def promotions(board: DataFrame, by: list[str], margin: float = 0.0005, advance: str = "any",
               block: int = 65536, store=materialise) -> DataFrame:
    """Trials that earn a test and those that are promoted, in trial order per key.

    A trial is tested when its score beats the bar by ``margin`` (not negative) and promoted when its test score also
    beats the champion by ``margin``. ``advance='any'`` moves the bar on every test, ``'promotion'`` only
    with the champion; then only promoted trials are returned.

    Bars only fall. So with ``'any'`` only a trial below every earlier score can be tested, and with ``'promotion'`` one that
    an earlier trial of its block matches or beats on both scores never wins; all others are dropped first. The
    rest is numbered and walked in runs of at most ``block`` trials a key. Every next run starts from the bars the
    walk before has left and skips all runs those bars rule out, so even a node whose scores improve without end
    takes one run after the other and never more than ``block`` rows a task.
    """
    inf = F.lit(float("inf"))
    ok = comparable(board).select(*by, F.col("trial").cast("bigint").alias("trial"), "score",
                                  F.coalesce(finite(F.col("test_score")), inf).alias("test_score"))
    both = advance == "promotion"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ok.schema.fields)
    if both:
        left = (ok.filter(F.col("test_score") < inf).withColumn("_b", F.floor(F.col("trial") / block).cast("bigint"))
                .groupBy(*by, "_b").applyInPandas(_keep_records, schema))
    else:
        left = running(ok, by, "trial", {"_best": ("min", F.col("score"))}).filter(F.col("score") < F.coalesce("_best", inf)).drop("_best")
    numbered = running(left, by, "trial", {"_p": ("sum", F.lit(1).cast("bigint"))})
    runs = store(numbered.withColumn("_run", F.floor(F.coalesce("_p", F.lit(0)) / block).cast("bigint")).drop("_p"))
    last = runs.agg(F.max("_run")).first()[0] or 0
    walked = schema + ", promoted boolean, _bar double, _champion double"

    def barred(rows: DataFrame, state: DataFrame | None) -> DataFrame:
        """Rows that the bars so far leave open."""
        if state is None:
            return rows.withColumns({"_bar": inf, "_champion": inf})
        d = rows.join(state, by, "left") if by else rows.crossJoin(F.broadcast(state))
        d = d.withColumns({c: F.coalesce(c, inf) for c in ("_bar", "_champion")})
        open_ = F.col("score") < F.col("_bar") - margin
        return d.filter(open_ & (F.col("test_score") < F.col("_champion") - margin) if both else open_)

    found, state, run = None, None, 0
    while run is not None:
        got = barred(runs.filter(F.col("_run") == run), state).groupBy(*by).applyInPandas(_walk(margin, both), walked)
        if last:
            got = store(got)
        found = got if found is None else found.unionByName(got)
        if run >= last:
            break
        state = store(found.groupBy(*by).agg(F.min("_bar").alias("_bar"), F.min("_champion").alias("_champion")))
        run = barred(runs.filter(F.col("_run") > run), state).agg(F.min("_run")).first()[0]
    return found.drop("_bar", "_champion")


def _keep_records(pdf):
    """Trials of one block that no earlier one matches or beats on both scores."""
    import bisect

    pdf = pdf.sort_values("trial")
    xs: list[float] = []     # scores of the staircase, rising; ts falls along it
    ts: list[float] = []
    hit = []
    for x, t in zip(pdf["score"], pdf["test_score"]):
        i = bisect.bisect_right(xs, x)
        if i and ts[i - 1] <= t:
            hit.append(False)
            continue
        hit.append(True)
        j = bisect.bisect_left(xs, x)
        k = j
        while k < len(xs) and ts[k] >= t:
            k += 1
        xs[j:k], ts[j:k] = [x], [t]
    return pdf.loc[hit].drop(columns="_b")


def _walk(margin: float, both: bool):
    """The rule over one run of a key, from the bars in ``_bar`` and ``_champion``; those columns return the bars after the row."""

    def walk(pdf):
        pdf = pdf.sort_values("trial")
        bar, champion = (float(pdf[c].iloc[0]) for c in ("_bar", "_champion"))
        keep, won_, bars, champions = [], [], [], []
        for x, t in zip(pdf["score"], pdf["test_score"]):
            tested = x < bar - margin
            won = tested and t < champion - margin
            if won:
                champion = t
            hit = won or (tested and not both)
            if hit:
                bar = x
                won_.append(won)
                bars.append(bar)
                champions.append(champion)
            keep.append(hit)
        res = pdf.loc[keep].drop(columns=["_run", "_bar", "_champion"])
        return res.assign(promoted=won_, _bar=bars, _champion=champions)

    return walk


def mark_promotions(board: DataFrame, promoted: DataFrame, by: list[str]) -> DataFrame:
    flags = promoted.filter("promoted").select(*by, "trial", F.lit(True).alias("promoted"))
    return board.join(flags, [*by, "trial"], "left").withColumn("promoted", F.coalesce("promoted", F.lit(False)))


def records(board: DataFrame, by: list[str], margin: float = 0.0) -> DataFrame:
    """Trials whose score beats every earlier comparable score of the key by ``margin``."""
    ok = (F.col("status") == "ok") & (F.col("scoring_version") == CURRENT)
    d = board.withColumn("_s", F.when(ok, finite(F.col("score"))))
    d = running(d, by, "trial", {"best_before": ("min", F.col("_s"))})
    beats = F.col("_s") < F.coalesce("best_before", F.lit(float("inf"))) - margin
    return d.withColumn("is_record", F.coalesce(beats, F.lit(False))).drop("_s")


def plateau(recs: DataFrame, by: list[str], notice: int = 50) -> DataFrame:
    """Trials since the last promotion, and a notice on every ``notice``-th of them."""
    d = running(recs, by, "trial", {"n_seen": ("sum", F.lit(1).cast("bigint"))}, inclusive=True)
    d = running(d, by, "trial", {"_last": ("max", F.when(F.col("promoted"), F.col("n_seen")))}, inclusive=True)
    d = d.withColumn("since_promotion", F.col("n_seen") - F.coalesce("_last", F.lit(0)))
    return d.withColumn("notice", (F.col("since_promotion") > 0) & (F.col("since_promotion") % notice == 0)).drop("_last")


def prune_bar(board: DataFrame, by: list[str], prob: float = 0.60, warmup: int = 8, rows_per_task: int = 500_000, store=materialise) -> DataFrame:
    """Running percentile of earlier finite screens; a later screen above it is pruned after the warm-up, which counts all trials."""
    d = board.withColumn("_f", finite(F.col("screen_score")))
    d = running_percentile(d, by, "trial", "_f", prob, "prune_bar", least=warmup, rows_per_task=rows_per_task, store=store)
    return d.withColumn("prune", F.coalesce(F.col("_f") > F.col("prune_bar"), F.lit(False))).drop("_f")
