"""The set-based backtest: cadence, warm-up, flow score, thin snapshots."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import tapegrid.catalog  # noqa: F401
from tapegrid.catalog.registry import QUERIES
from tapegrid.config import SessionConfig
from tapegrid.operators import asof, grid as gr, ladder as ld, physics as ph
from tapegrid.plans import assembly as asm, fixtures as fx
from tapegrid.plans.session import materialise
from tests.compare import TESTDATA


def test_no_bar_is_skipped(spark):
    bars = {r.bar for r in QUERIES["backtest_signals"](spark, f"{TESTDATA}/sf0.001").select("bar").distinct().collect()}
    assert len(bars) > 50 and {b % 3 for b in bars} == {0, 1, 2}


UTC = SessionConfig(tz="UTC", bar_minutes=5, snap_minutes=60)
OPEN = dt.datetime(2024, 6, 3, 9, 30)


def feeds(spark, burst=None, thin=None):
    """One session: a tick a bar, three strikes a bar (two in the hour before the snapshot of bar ``thin``), a premium burst at bar ``burst``."""
    ticks, rows, n = [], [], 0
    for bar in range(5, 391, 5):
        n += 1
        at = OPEN + dt.timedelta(minutes=bar)
        ticks.append((n, "X", at, 105.0 + 0.1 * ((n * 7) % 5), 10.0))
        for k in ((100.0, 105.0) if thin and thin - 60 < bar <= thin else (100.0, 105.0, 110.0)):
            rows.append((n, "X", at, k, 50.0 - k / 4, 1.0, 1.0, 10.0, 12.0, 1e6 if bar == burst else 100.0 + (n * 13) % 7, 90.0, 5.0, 4.0))
    tick = spark.createDataFrame(ticks, "seq bigint, symbol string, ts timestamp, spot double, volume double")
    lad = spark.createDataFrame(rows, "seq bigint, symbol string, ts timestamp, strike double, gex double, vanna double, charm double, call_oi double, "
                                "put_oi double, call_prem double, put_prem double, call_vol double, put_vol double")
    return tick, lad.withColumns({f"{s}_{q}_prem": F.lit(None).cast("double") for s in ("call", "put") for q in ("ask", "bid")})


def signals(spark, tick, lad, **kw):
    at = ph.horizon_rows(tick.select("symbol", F.to_date("ts").alias("session_date"), F.explode(F.sequence(F.lit(0), F.lit(390), F.lit(5))).alias("bar")).distinct())
    preds = at.select("symbol", "session_date", "bar", "horizon", *[F.lit(v).alias(c) for c, v in (("lgb", 0.1), ("cat", 0.1), ("q10", -0.5), ("q50", 0.0), ("q90", 0.5))])
    return asm.backtest_signals(tick, lad, preds, UTC, store=materialise, **kw)


def test_a_premium_burst_switches_the_gate(spark):
    hot = {r.bar for r in signals(spark, *feeds(spark, burst=300), lookback=12).filter("high_vol_fallback").select("bar").distinct().collect()}
    assert 300 in hot and min(hot) == 300
    assert not signals(spark, *feeds(spark), lookback=12).filter("high_vol_fallback").count()


def test_warm_up_bars_decide_nothing(spark):
    bars = {r.bar for r in signals(spark, *feeds(spark), lookback=30).select("bar").distinct().collect()}
    assert min(bars) == 29 * 5 and max(bars) == 390
    with pytest.raises(ValueError):
        signals(spark, *feeds(spark), lookback=75)


def test_a_thin_snapshot_decides_nothing(spark):
    bars = {r.bar for r in signals(spark, *feeds(spark, thin=270), lookback=12).select("bar").distinct().collect()}
    assert bars == set(range(55, 391, 5)) - set(range(270, 330, 5))


def test_masses_of_a_snapshot_are_those_of_its_bars(spark):
    d = f"{TESTDATA}/sf0.001"
    points = gr.session_grid(fx.ticks(spark, d), UTC).filter("spot is not null").select(*ld.SNAP, "spot")
    rows = ld.strike_rows(fx.ladder(spark, d), UTC, (*ld.LEVELS, "call_vol", "put_vol"))
    cols = [*ld.SNAP, "strike", F.round("mass", 9).alias("mass")]
    once = asof.snapshot_asof(points, ph.attractor_masses(ph.ladder_state(rows))).select(*cols)
    each = ph.attractor_masses(ph.ladder_state(asof.snapshot_asof(points, rows))).select(*cols)
    assert once.count() and not once.exceptAll(each).count() and not each.exceptAll(once).count()
