"""Forecasting on pyspark.ml plus the gate solver and the magnitude quantile table."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, functions as F

from tapegrid.config import EXPERTS, GateConfig
from tapegrid.functions.market import magnitude_to_move
from tapegrid.functions.nulls import clip
from tapegrid.operators import scaling as sc
from tapegrid.operators.quantiles import attach_domain, attach_row, exact_quantiles

GC = GateConfig()


# ---------------------------------------------------------------- boosted trees and robust linear expert
def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    filled = df.fillna(0.0, subset=cols)
    return VectorAssembler(inputCols=cols, outputCol=out).transform(filled)


def fit_trees(train: DataFrame, label: str, weight: str | None = None, validation: str | None = None,
              rounds: int = 50, depth: int = 4, step: float = 0.1, seed: int = 7):
    """Gradient-boosted trees; with a validation flag column boosting stops early on those rows."""
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.fit(train.filter(F.col(label).isNotNull()))


def fit_on_folds(df: DataFrame, folds: DataFrame, label: str, weight: str | None = None, rounds: int = 50, n_folds: int = 3, least: int = 50, **kw):
    """Early-stopped round count per fold (at most ``rounds``), then a refit on all rows at max(``least``, median). Returns model and counts.

    The fold table is bounded by the calendar, hence broadcast.
    """
    best = []
    for k in range(n_folds):
        role = folds.filter(F.col("fold") == k).select("session_date", "role")
        part = df.join(F.broadcast(role), "session_date").withColumn("is_val", F.col("role") == "val")
        best.append(fit_trees(part, label, weight, "is_val", rounds, **kw).getNumTrees)
    mid = sorted(best)[len(best) // 2]
    return fit_trees(df, label, weight, None, max(least, mid), **kw), best


#: Two boosted families: squared loss with deeper trees, absolute loss with shallow ones and a larger step.
TREE_FAMILIES = (("lgb", {"loss": "squared", "depth": 4, "step": 0.1}), ("cat", {"loss": "absolute", "depth": 3, "step": 0.15}))


def horizon_labels(df: DataFrame, horizons: list[str], kind: str = "retn") -> DataFrame:
    """One row per (row, horizon) with its ``label``; the targets' own columns go. Rows without a label are kept (they can be predicted)."""
    ys = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y_{kind}_{h}").alias("label")) for h in horizons])
    rest = [c for c in df.columns if not c.startswith("y_")]
    return df.select(*rest, F.explode(ys).alias("_y")).select(*rest, "_y.horizon", "_y.label")


def label_params(train: DataFrame, horizons: list[str]) -> DataFrame:
    """(horizon, lo, hi, offset) of the training labels: clip bounds and the median after clipping."""
    return sc.winsorise(train.filter(F.col("label").isNotNull()), "horizon", horizons, "label")


def centred(rows: DataFrame, params: DataFrame, horizons: list[str]) -> DataFrame:
    """Add ``offset`` and ``target``, the clipped label less its offset."""
    d = attach_domain(rows, params, "horizon", horizons, ["lo", "hi", "offset"])
    y = F.col("label")
    return d.withColumn("target", F.when(y.isNotNull(), F.greatest("lo", F.least("hi", y)) - F.col("offset"))).drop("lo", "hi")


def _boost(train: DataFrame, rounds: int, loss: str, depth: int, step: float, seed: int):
    return GBTRegressor(featuresCol="features", labelCol="target", weightCol="weight", lossType=loss, maxIter=rounds, maxDepth=depth,
                        stepSize=step, seed=seed).fit(train)


def fit_families(train: DataFrame, folds: DataFrame, horizons: list[str], families=TREE_FAMILIES, rounds: int = 50, least: int = 50, seed: int = 7):
    """Every family for every horizon. ``train``: features, session_date, horizon, target, weight.

    Each fold is boosted for ``rounds`` rounds and scored after every one on its later sessions; the round with the smallest error
    is the fold's best. The final model takes all rows and max(``least``, median best) rounds (``rounds`` without folds).
    Returns ({(family, horizon): model}, [(family, horizon, fold, best_round, error)]). The fold table is bounded by the calendar.
    """
    models, history = {}, []
    train = train.filter(F.col("target").isNotNull())
    numbers = sorted(r["fold"] for r in folds.select("fold").distinct().collect())
    for h in horizons:
        part = train.filter(F.col("horizon") == h)
        for name, kw in families:
            best = []
            for k in numbers:
                d = part.join(F.broadcast(folds.filter(F.col("fold") == k).select("session_date", "role")), "session_date")
                errors = _boost(d.filter("role = 'train'"), rounds, seed=seed, **kw).evaluateEachIteration(d.filter("role = 'val'"), "absolute")
                at = min(range(len(errors)), key=errors.__getitem__)
                best.append(at + 1)
                history.append((name, h, k, at + 1, float(errors[at])))
            final = max(least, sorted(best)[len(best) // 2]) if best else rounds
            models[name, h] = _boost(part, final, seed=seed, **kw)
    return models, history


def predict_families(models: dict, rows: DataFrame) -> DataFrame:
    """One column per family, offset added back, and their mean ``tree_mean``. ``rows``: features, horizon, offset."""
    out = None
    names = list(dict.fromkeys(f for f, _ in models))
    for h in dict.fromkeys(h for _, h in models):
        d = rows.filter(F.col("horizon") == h)
        for f in names:
            d = models[f, h].copy().setPredictionCol(f).transform(d)
        out = d if out is None else out.unionByName(d)
    d = out.withColumns({f: F.col(f) + F.col("offset") for f in names})
    return d.withColumn("tree_mean", sum(F.col(f) for f in names) / len(names))


def held_out_scores(pred: DataFrame, names: list[str]) -> DataFrame:
    """Rows, mean absolute error per prediction and that of the offset alone (``mae_naive``), per horizon."""
    err = lambda c: F.avg(F.abs(F.col(c) - F.col("label"))).alias(f"mae_{'naive' if c == 'offset' else c}")
    return pred.filter(F.col("label").isNotNull()).groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), *[err(c) for c in (*names, "offset")])


def select_then_test(rows: DataFrame, label: str, grid: list[dict], weight: str | None = None) -> DataFrame:
    """Board (trial, phase, n_rows, score) of a search: every configuration scored on validation rows, the winner alone on test rows.

    ``rows`` has ``split`` (train, val, test). Test rows are read once, after the choice; ties go to the earlier trial.
    """
    part = lambda s: rows.filter((F.col("split") == s) & F.col(label).isNotNull())
    board, best = [], None

    def scored(model, phase):
        m = model.transform(part(phase)).agg(F.count(F.lit(1)), F.avg(F.abs(F.col("prediction") - F.col(label)))).first()
        return int(m[0]), None if m[1] is None else float(m[1])

    for trial, cfg in enumerate(grid):
        model = fit_trees(part("train"), label, weight, **cfg)
        n, score = scored(model, "val")
        board.append((trial, "val", n, score))
        if score is not None and (best is None or score < best[0]):
            best = (score, trial, model)
    if best:
        board.append((best[1], "test", *scored(best[2], "test")))
    return rows.sparkSession.createDataFrame(board, "trial bigint, phase string, n_rows bigint, score double")


def fit_robust(train: DataFrame, label: str, weight: str | None = None, epsilon: float = 1.35, reg: float = 0.1):
    """Huber regression as the robust expert."""
    lr = LinearRegression(featuresCol="features", labelCol=label, loss="huber", epsilon=epsilon, regParam=reg, maxIter=50)
    return (lr.setWeightCol(weight) if weight else lr).fit(train.filter(F.col(label).isNotNull()))


def compare_configs(train: DataFrame, val: DataFrame, label: str, grid: list[dict], metric=None) -> list[dict]:
    """Fit each configuration on train, score on validation rows only: one leaderboard entry per configuration."""
    out = []
    for trial, cfg in enumerate(grid):
        pred = fit_trees(train, label, **cfg).transform(val.filter(F.col(label).isNotNull()))
        m = pred.agg((metric or F.avg(F.abs(F.col("prediction") - F.col(label)))).alias("score")).first()
        out.append({"trial": trial, "score": float(m["score"]), **{k: float(v) for k, v in cfg.items()}})
    return out


def importance_table(spark, model, cols: list[str], name: str) -> DataFrame:
    imp = model.featureImportances
    return spark.createDataFrame([(name, c, float(imp[i])) for i, c in enumerate(cols)], "model string, feature string, gain double")


# ---------------------------------------------------------------- gate
def gate_gram(history: DataFrame) -> DataFrame:
    """Per horizon the sums of products of expert moves and of expert with realised moves: one pass, map-side combined."""
    zero = F.lit(0.0)
    d = history.filter(F.col("realized").isNotNull() & F.col("spot").isNotNull())
    x = [F.coalesce(F.col(f"x_{e}") - F.col("spot"), zero) for e in EXPERTS]
    y = F.col("realized") - F.col("spot")
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(x[i] * x[j]).alias(f"g{i + 1}{j + 1}") for i in range(4) for j in range(i, 4)]
    aggs += [F.sum(x[i] * y).alias(f"b{i + 1}") for i in range(4)]
    return d.groupBy("horizon").agg(*aggs)


def _nonnegative_ridge(g, b, alpha: float):
    """Exact non-negative ridge for four coefficients: the best of all supports."""
    import numpy as np

    a = g + alpha * np.eye(len(b))
    best, val = np.zeros(len(b)), 0.0
    for k in range(1, len(b) + 1):
        for s in combinations(range(len(b)), k):
            ix = list(s)
            w = np.linalg.solve(a[np.ix_(ix, ix)], b[ix])
            if (w < 0).any():
                continue
            full = np.zeros(len(b))
            full[ix] = w
            obj = full @ a @ full - 2 * full @ b
            if obj < val - 1e-12:
                best, val = full, obj
    return best


def gate_weights(gram: DataFrame, gc: GateConfig = GC) -> DataFrame:
    """(horizon, n, l_*) simplex weights; horizons with too few rows are left out and keep their priors."""
    priors = {h: [v / sum(p) for v in p] for h, *p in gc.priors}
    names = [f"l_{e}" for e in EXPERTS]

    def solve(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                g = np.array([[r[f"g{min(i, j)}{max(i, j)}"] for j in range(1, 5)] for i in range(1, 5)], float)
                w = _nonnegative_ridge(g, np.array([r[f"b{i}"] for i in range(1, 5)], float), gc.ridge_alpha)
                w = w / w.sum() if w.sum() > 1e-9 else np.array(priors.get(r["horizon"], [0.25] * 4))
                rows.append((r["horizon"], float(r["n"]), *[float(v) for v in w]))
            yield pd.DataFrame(rows, columns=["horizon", "n", *names])

    return gram.filter(F.col("n") >= gc.min_rows).mapInPandas(
        solve, "horizon string, n double, " + ", ".join(f"{c} double" for c in names))


# ---------------------------------------------------------------- magnitude heads
def volatility_decile(df: DataFrame, col: str = "rv_1m", fit_on: DataFrame | None = None) -> DataFrame:
    """Decile 0-9 of volatility by exact cut points over ``fit_on`` (training rows; default: all rows).

    Values and cuts are compared at twelve decimals: a cut that is itself a value must not depend on the last bit.
    """
    cuts = exact_quantiles(df if fit_on is None else fit_on, [], col, [i / 10 for i in range(1, 10)], [f"_c{i}" for i in range(1, 10)])
    d = attach_row(df, cuts)
    dec = sum(((F.round(col, 12) > F.round(f"_c{i}", 12)).cast("int") for i in range(1, 10)), F.lit(0))
    return d.withColumn("rv_decile", F.coalesce(dec, F.lit(0))).drop(*[f"_c{i}" for i in range(1, 10)])


def magnitude_table(train: DataFrame, prob: float = 0.75, store=lambda d: d) -> DataFrame:
    """Conditional quantile of both magnitudes by time bucket and volatility decile."""
    keys = ["bucket", "rv_decile"]
    up = exact_quantiles(train, keys, "mag_up", [prob], ["mu"], store=store)
    dn = exact_quantiles(train, keys, "mag_dn", [prob], ["md"], store=store)
    return up.join(dn, keys, "full_outer")


def predict_magnitude(df: DataFrame, table: DataFrame) -> DataFrame:
    """Up and down magnitude, net, moves by the inverse scale (``raw_up``, ``raw_dn``; in cents as ``dollars_up``, ``dollars_dn``) and a tag."""
    d = df.join(table, ["bucket", "rv_decile"], "left")
    mu, md = clip("mu", 0.0, 10.0), clip("md", 0.0, 10.0)
    top = F.greatest(mu, md)

    def tidy(x, digits):
        # nine digits first: an interpolated 3.95 must not fall to 3.9 through binary noise
        return F.bround(F.round(x, 9), digits)

    return d.withColumns({
        "pred_up": tidy(mu, 1), "pred_dn": tidy(md, 1), "net": tidy(mu - md, 1),
        "raw_up": magnitude_to_move(mu, F.col("base")), "raw_dn": magnitude_to_move(md, F.col("base")),
        "dollars_up": tidy(magnitude_to_move(mu, F.col("base")), 2), "dollars_dn": tidy(magnitude_to_move(md, F.col("base")), 2),
        "tag": F.when(top >= 7.5, "move").when(top >= 6.0, "elevated").otherwise("normal")})


def magnitude_metrics(pred: DataFrame, big: float = 7.0, called: float = 6.0) -> DataFrame:
    """MAE against the naive 5.0, recall and precision of big moves per head, net direction accuracy."""
    rows = pred.filter(F.col("mag_up").isNotNull() & F.col("mag_dn").isNotNull() & F.col("mu").isNotNull() & F.col("md").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n_test")]
    for side, m in (("up", "mu"), ("dn", "md")):
        p, t = clip(m, 0.0, 10.0), F.col(f"mag_{side}")
        aggs += [F.avg(F.abs(p - t)).alias(f"mae_{side}"), F.avg(F.abs(5.0 - t)).alias(f"naive_mae_{side}"),
                 F.sum((t >= big).cast("bigint")).alias(f"big_{side}_n"),
                 F.avg(F.when(t >= big, (p >= called).cast("double"))).alias(f"recall_{side}"),
                 F.avg(F.when(p >= called, (t >= big).cast("double"))).alias(f"precision_{side}")]
    net = F.col("mag_up") - F.col("mag_dn")
    hit = (F.signum(clip("mu", 0.0, 10.0) - clip("md", 0.0, 10.0)) == F.signum(net)).cast("double")
    aggs += [F.avg(F.when(F.abs(net) >= 2.0, hit)).alias("net_dir_acc"), F.sum((F.abs(net) >= 2.0).cast("bigint")).alias("net_dir_n")]
    return rows.agg(*aggs)


