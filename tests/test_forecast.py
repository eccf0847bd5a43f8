"""Tree families over horizons and the two-phase search."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapegrid.operators import forecast as fo, splits as sp

HORIZONS = ["5m", "eod"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for day in range(12):
        for bar in range(60):
            x, noise = rng.normal(), rng.normal()
            data.append((dt.date(2024, 6, 1) + dt.timedelta(days=day), bar, float(x), float(np.sign(x) + 0.1 * noise), float(5.0 - 2.0 * np.sign(x)) if bar % 7 else None))
    d = spark.createDataFrame(data, "session_date date, bar int, x double, y_retn_5m double, y_retn_eod double")
    d = sp.with_split(d, sp.chrono_split(sp.session_dates(d)))
    return fo.assemble(fo.horizon_labels(d, HORIZONS), ["x"]).cache()


def test_families_beat_the_offset_on_later_sessions(rows):
    train = rows.filter("split = 'train'")
    params = fo.label_params(train, HORIZONS)
    d = fo.centred(rows, params, HORIZONS).withColumn("weight", F.lit(1.0))
    folds = sp.rolling_folds(sp.session_dates(train), folds=2)
    models, history = fo.fit_families(d.filter("split = 'train'"), folds, HORIZONS, rounds=4, least=2)
    assert set(models) == {(f, h) for f in ("lgb", "cat") for h in HORIZONS}
    assert len(history) == 8 and all(1 <= r[3] <= 4 for r in history)
    got = {r.horizon: r for r in fo.held_out_scores(fo.predict_families(models, d.filter("split = 'test'")), ["lgb", "cat", "tree_mean"]).collect()}
    for h in HORIZONS:
        assert got[h].mae_tree_mean < 0.6 * got[h].mae_naive
    assert got["eod"].n < got["5m"].n  # rows without a label are predicted, not scored


def test_the_winner_alone_is_tested_once(rows):
    d = rows.filter("horizon = '5m'")
    board = fo.select_then_test(d, "label", [{"rounds": 1, "depth": 1}, {"rounds": 3, "depth": 2}]).collect()
    val, test = [r for r in board if r.phase == "val"], [r for r in board if r.phase == "test"]
    assert [r.trial for r in val] == [0, 1] and len(test) == 1
    assert test[0].trial == min(val, key=lambda r: (r.score, r.trial)).trial
    assert test[0].n_rows == d.filter("split = 'test'").count() and val[0].n_rows == d.filter("split = 'val'").count()
