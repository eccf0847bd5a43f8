"""Scoring, trade analytics and exits as set-based queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapegrid.config import DEFAULT_SCORE_WEIGHT, EPS, SCORE_WEIGHTS, CostConfig, SessionConfig
from tapegrid.functions import clock
from tapegrid.functions.nulls import mean_of, safe_div
from tapegrid.operators.quantiles import attach_domain, exact_quantiles
from tapegrid.operators.windows import by_bar

SCORING_VERSION = "eod_pre11"
EOD_CUTOFF_MINUTE = 660
MIN_ROWS = 30

# Evaluation metrics by name: expression over columns ``e`` (absolute error), ``p`` and ``y``.
METRICS = {
    "mae": lambda: F.avg("e"),
    "acc": lambda: F.avg(direction_hit(F.col("p"), F.col("y"))),
}


def register_metric(name: str, fn) -> None:
    METRICS[name] = fn


def direction_hit(p: Column, y: Column, dead: float = 0.1) -> Column:
    """1 / 0 for the sign of moves larger than ``dead``, NULL for flat ones."""
    return F.when(F.abs(y) > dead, (F.signum(p) == F.signum(y)).cast("double"))


def scored_rows(preds: DataFrame, tz: str, experts: tuple[str, ...] = ("lgb", "cat", "q50"),
                eod_cutoff: int = EOD_CUTOFF_MINUTE) -> DataFrame:
    """Ensemble mean, absolute error and whether the row counts (end-of-day rows only before the cutoff)."""
    p = mean_of(*experts)
    d = preds.withColumn("p", p).filter(F.col("p").isNotNull() & F.col("y").isNotNull())
    early = clock.minute_of_day(F.col("ts"), tz) < eod_cutoff
    return d.withColumns({"e": F.abs(F.col("p") - F.col("y")), "counts": (F.col("horizon") != "eod") | early})


def horizon_scores(rows: DataFrame, horizons: list[str]) -> DataFrame:
    """Per horizon: MAE below the 95th error percentile, direction accuracy, scored and dropped rows."""
    live = rows.filter("counts")
    cut = exact_quantiles(live, ["horizon"], "e", [0.95], ["cut"], domain=horizons)
    d = attach_domain(rows, cut, "horizon", horizons, ["cut"])
    on = F.col("counts")
    g = d.groupBy("horizon").agg(
        F.sum(on.cast("bigint")).alias("scored"), F.sum((~on).cast("bigint")).alias("dropped"),
        F.avg(F.when(on & (F.col("e") <= F.col("cut")), F.col("e"))).alias("mae"),
        F.coalesce(F.avg(F.when(on, _hit())), F.lit(0.5)).alias("acc"))
    ok = F.col("scored") >= MIN_ROWS
    return g.withColumns({"mae": F.when(ok, F.col("mae")), "acc": F.when(ok, F.col("acc"))})


def _hit() -> Column:
    return direction_hit(F.col("p"), F.col("y"))


def board_score(per_horizon: DataFrame, version: str = SCORING_VERSION) -> DataFrame:
    """Mean MAE minus a mild reward for direction; +inf, the worst score, where no horizon was scored."""
    s = per_horizon.agg(F.avg("mae").alias("mae_mean"), F.coalesce(F.avg("acc"), F.lit(0.0)).alias("acc_mean"))
    return s.withColumns({"score": F.coalesce(F.col("mae_mean") - 0.25 * (F.col("acc_mean") - 0.5), F.lit(float("inf"))), "scoring_version": F.lit(version)})


def trimmed_mae(rows: DataFrame, horizons: list[str]) -> DataFrame:
    """MAE between the 5th and 95th error percentile and direction accuracy."""
    b = exact_quantiles(rows, ["horizon"], "e", [0.05, 0.95], ["lo", "hi"], domain=horizons)
    d = attach_domain(rows, b, "horizon", horizons, ["lo", "hi"])
    return d.groupBy("horizon").agg(
        F.avg(F.when(F.col("e").between(F.col("lo"), F.col("hi")), F.col("e"))).alias("tmae"),
        F.coalesce(F.avg(_hit()), F.lit(0.5)).alias("dir_acc"))


def pinball(preds: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Mean pinball loss over quantile columns per horizon; rows without a target are masked."""
    losses = []
    for c, tau in quantiles.items():
        e = F.col("y") - F.col(c)
        losses.append(F.greatest(tau * e, (tau - 1.0) * e))
    mean = sum(losses[1:], losses[0]) / float(len(losses))
    return preds.filter(F.col("y").isNotNull()).groupBy("horizon").agg(F.avg(mean).alias("pinball"))


def weighted_score(per_horizon: DataFrame, weights: dict[str, float] = SCORE_WEIGHTS) -> DataFrame:
    """Horizon-weighted score over the horizons present; +inf where none is."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("horizon")], F.lit(DEFAULT_SCORE_WEIGHT))
    d = per_horizon.filter(F.col("mae").isNotNull()).withColumn("_w", w)
    num = F.sum(F.col("_w") * F.col("mae") * (1.5 - F.coalesce("acc", F.lit(0.5))))
    return d.agg(F.coalesce(safe_div(num, F.sum("_w"), None), F.lit(float("inf"))).alias("score"), F.count(F.lit(1)).alias("n_horizons"))


# ---------------------------------------------------------------- signals and trades
def signal_table(df: DataFrame, deadband: float = 0.05) -> DataFrame:
    """Realised direction per (bar, horizon) with an implied-move dead-band. Needs target, realized, implied_move."""
    def direction(delta):
        return F.when(F.abs(delta) > deadband * F.col("implied_move"), F.signum(delta)).otherwise(0.0).cast("int")
    s = F.col("spot")
    return df.withColumns({
        "pred_dir": direction(F.col("target") - s), "real_dir": F.coalesce(direction(F.col("realized") - s), F.lit(0)),
        "abs_err": F.abs(F.col("target") - F.col("realized"))})


def confusion(signals: DataFrame) -> DataFrame:
    """3 x 3 direction counts with every cell present, from one row of nine counters."""
    cells = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    s = signals.filter(F.col("realized").isNotNull())
    hit = lambda a, b: F.count(F.when((F.col("pred_dir") == a) & (F.col("real_dir") == b), 1))
    one = s.agg(*[hit(a, b).alias(f"c{i}") for i, (a, b) in enumerate(cells)])
    rows = [F.struct(F.lit(a).alias("pred_dir"), *[F.col(f"c{3 * k + j}").alias(n) for j, n in enumerate(("down", "flat", "up"))])
            for k, a in enumerate((-1, 0, 1))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def accuracy_by_horizon(signals: DataFrame) -> DataFrame:
    s = signals.filter(F.col("realized").isNotNull())
    called = F.when(F.col("pred_dir") != 0, (F.col("pred_dir") == F.col("real_dir")).cast("double"))
    return s.groupBy("horizon").agg(F.avg(called).alias("accuracy"), F.avg("abs_err").alias("mae"), F.count(F.lit(1)).alias("n"))


def final_call(signals: DataFrame, keys=("symbol", "session_date"), order: str = "bar") -> DataFrame:
    """Error of the last end-of-day call of each session against the close, and of the naive spot."""
    s = signals.filter((F.col("horizon") == "eod") & F.col("realized").isNotNull())
    last = s.groupBy(*keys).agg(F.max_by(F.struct("target", "spot", "eod_close"), order).alias("r"))
    err = lambda c: F.avg(F.abs(F.col(f"r.{c}") - F.col("r.eod_close")))
    return last.agg(err("target").alias("call_error"), err("spot").alias("naive_error"), F.count(F.lit(1)).alias("sessions"))


def per_group(trades: DataFrame, key: str) -> DataFrame:
    """Count, win rate, sum, mean and target-hit rate of trades."""
    return trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("trades"), F.avg((F.col("pnl_net") > 0).cast("double")).alias("win_rate"),
        F.sum("pnl_net").alias("pnl"), F.avg("pnl_net").alias("avg_pnl"), F.avg(F.col("hit_target").cast("double")).alias("hit_target"))


def daily_pnl(trades: DataFrame) -> DataFrame:
    return trades.groupBy("day").agg(
        F.sum("pnl_net").alias("pnl"), F.sum("costs").alias("costs"), F.count(F.lit(1)).alias("trades"),
        F.sum((F.col("pnl_net") > 0).cast("bigint")).alias("wins"),
        F.sum(F.when(F.col("pnl_net") > 0, F.col("pnl_net")).otherwise(0.0)).alias("gains"),
        F.sum(F.when(F.col("pnl_net") < 0, -F.col("pnl_net")).otherwise(0.0)).alias("losses"))


def equity_curve(daily: DataFrame, capital: float) -> DataFrame:
    """Equity, running peak and drawdown. One row per calendar day, so one ordered window is enough."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("equity", capital + F.sum("pnl").over(w))
    d = d.withColumn("peak", F.max("equity").over(w))
    return d.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))


def risk_report(daily: DataFrame, capital: float) -> DataFrame:
    """Cumulative return, Sharpe, Sortino, maximum drawdown, win rate, profit factor, average trade, costs."""
    r = F.col("pnl") / capital
    year = 252 ** 0.5
    d = equity_curve(daily, capital)
    return d.agg(
        (F.max_by("equity", "day") / capital - 1.0).alias("cumulative_return"), F.sum("pnl").alias("total_pnl"),
        F.sum("costs").alias("total_costs"), (F.avg(r) / (F.stddev_samp(r) + EPS) * year).alias("sharpe"),
        (F.avg(r) / (F.stddev_samp(F.when(r < 0, r)) + EPS) * year).alias("sortino"), F.min("drawdown").alias("max_drawdown"),
        (F.sum("wins") / F.sum("trades")).alias("win_rate"), safe_div(F.sum("gains"), F.sum("losses"), None).alias("profit_factor"),
        (F.sum("pnl") / F.sum("trades")).alias("avg_trade"))


def importance_share(imp: DataFrame) -> DataFrame:
    w = Window.partitionBy("model")
    return imp.withColumn("share", safe_div(F.col("gain"), F.sum("gain").over(w)))


# ---------------------------------------------------------------- exits and costs
def barrier_exit(entries: DataFrame, cfg: SessionConfig, hold_minutes: int, flat_minutes: float = 2.0) -> DataFrame:
    """First later bar that ends a position, by rule priority: flat before the close, expiry, stop, take profit.

    ``entries`` is the session grid with side, stop and take on entry rows (NULL side = no entry). The
    candidate bars of an entry are the next ``hold`` rows of its own session, read through one window
    frame; no entry meets every other bar.
    """
    n = cfg.rows(hold_minutes)
    ahead = by_bar().rowsBetween(1, n)
    d = entries.withColumn("_path", F.collect_list(F.struct("bar", "spot")).over(ahead)).filter(F.col("side").isNotNull())
    expiry = F.least(F.col("bar") + hold_minutes, F.lit(cfg.length - flat_minutes))
    side, stop, take = F.col("side"), F.col("stop"), F.col("take")

    def reason(e):
        return (F.when(cfg.length - e["bar"] <= flat_minutes, "EOD_FLAT").when(e["bar"] >= F.col("_expiry"), "HORIZON_EXPIRY")
                .when((e["spot"] - stop) * side <= 0, "STOP_LOSS").when((e["spot"] - take) * side >= 0, "TAKE_PROFIT"))

    d = d.withColumn("_expiry", expiry)
    tagged = F.transform("_path", lambda e: F.struct(e["bar"].alias("bar"), e["spot"].alias("spot"), reason(e).alias("reason")))
    d = d.withColumn("_x", F.try_element_at(F.filter(tagged, lambda e: e["reason"].isNotNull()), F.lit(1)))
    return d.withColumns({"exit_bar": F.col("_x.bar"), "exit_spot": F.col("_x.spot"), "reason": F.col("_x.reason"),
                          "hold_min": F.col("_x.bar") - F.col("bar")}).drop("_path", "_x", "_expiry")


def option_pnl(trades: DataFrame, cc: CostConfig = CostConfig()) -> DataFrame:
    """Premium, round-trip costs, gross and net profit of option trades.

    Needs side, entry_spot, exit_spot, rv_1m, remaining_min, hold_min, contracts.
    """
    n, left = F.col("contracts"), F.col("remaining_min")
    prem = F.greatest(F.lit(cc.min_premium),
                      cc.premium_mult * F.col("entry_spot") * F.col("rv_1m") * F.sqrt(F.greatest(left, F.lit(1.0))))
    d = trades.withColumn("premium", prem)
    spread = F.greatest(F.lit(cc.min_spread), cc.spread_pct * F.col("premium"))
    slip = 2.0 * cc.slip_per_side * F.sqrt(F.greatest(n, F.lit(1)))
    costs = n * ((spread + slip) * cc.multiplier + 2.0 * (cc.commission + cc.fees))
    used = F.least(F.col("hold_min"), left) / F.greatest(left, F.lit(1.0))
    theta = F.col("premium") * (1.0 - F.sqrt(F.greatest(F.lit(0.0), 1.0 - used)))
    move = (F.col("exit_spot") - F.col("entry_spot")) * F.col("side")
    gross = n * cc.multiplier * (cc.atm_delta * move - theta)
    d = d.withColumns({"costs": costs, "pnl_gross": gross})
    return d.withColumn("pnl_net", F.col("pnl_gross") - F.col("costs"))
