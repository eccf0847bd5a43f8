"""Sources over events whose timestamps repeat and whose rows lie in no order, against their SQL."""

import duckdb
import pytest

from tests.compare import TESTDATA, compare, duck

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Every event three times with the same ts and symbol, other keys and prices."""
    d = str(tmp_path_factory.mktemp("repeated"))
    duckdb.sql(f"""copy (select event_id + k * 1001 as event_id, ts, user_id + k * 1000 as user_id, event_type, value + k * 3 as value, props
                   from '{TESTDATA}/sf0.001/events.parquet', range(3) as r(k) order by hash(event_id + k * 1001))
                   to '{d}/events.parquet' (format parquet, row_group_size 2048)""")
    return d


@pytest.mark.parametrize("key", ["src01_ohlcv_csv", "src02_price_csv", "src04_history_prices"])
def test_repeated_timestamps(spark, repeated, key):
    res = compare(spark, duck(repeated), entry.queries()[key], entry.oracle_sql()[key], repeated)
    assert res.startswith("ok") and "EMPTY" not in res, res


def test_ladder_price_of_a_session_without_price_file(spark, tmp_path):
    """The last row of a timestamp by strike, then seq; rows without a strike count as the first."""
    from tapegrid.sources import files as fs
    rows = [(1, 100.0, 9.0), (2, 105.0, 7.0), (4, 105.0, 6.0), (3, 105.0, 8.0), (5, None, 5.0)]
    d = spark.createDataFrame(rows, "seq long, strike double, spot double").selectExpr(
        "'A' as symbol", "date'2024-01-05' as session_date", "timestamp'2024-01-05 10:00:00' as ts", "*")
    late = d.filter("strike IS NULL").selectExpr("symbol", "session_date", "ts + interval 1 hour as ts", "seq", "strike", "spot")
    d.unionByName(late).write.partitionBy("session_date").parquet(f"{tmp_path}/ladder")
    none = d.filter("false")
    none.write.parquet(f"{tmp_path}/prints")
    none.write.parquet(f"{tmp_path}/spot")
    assert sorted(r.spot for r in fs.read_history(spark, str(tmp_path))[0].collect()) == [5.0, 6.0]
