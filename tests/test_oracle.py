"""Registered queries against their SQL. TAPEGRID_ALL=1 runs every key, otherwise one per area."""

import os

import pytest

from tests.compare import TESTDATA, compare, duck

import __spark_entry__ as entry

SOME = ["fea01_session_grid_asof", "fea02_price_context", "fea04_net_premium", "fea05_block_sweep", "jn10_asof_backward", "jn11_asof_ladder",
        "lad01_12_gex_profile", "lad15_clusters", "lad20_eod_pin", "agg05_chain_build", "agg07_parity_spot", "lad21_delta", "tgt01_targets",
        "tgt03_tod_baseline", "spl01_chrono_split", "spl02_rolling_folds", "scl01_transform", "seq01_windows", "eva01_horizon_scores",
        "eva06_promotion_gate", "eva06_promotion_gate_strict", "win19_prune_bar", "win20_plateau", "agg19_confusion", "jn22_barrier_exit", "fus08_fusion", "fus09_entries",
        "src03_timestamps", "src10_push_messages", "snk01_session_overwrite", "chk01_causality", "str08_stream_flow", "str10_session_state"]
KEYS = sorted(entry.queries()) if os.environ.get("TAPEGRID_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return duck(f"{TESTDATA}/sf0.001")


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, con, key):
    res = compare(spark, con, entry.queries()[key], entry.oracle_sql().get(key), f"{TESTDATA}/sf0.001")
    assert not res.startswith("FAIL"), res


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
