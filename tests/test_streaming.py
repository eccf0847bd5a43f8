"""Streams cut into micro-batches: same rows as at once, ending state, silences, late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapegrid.catalog.features import CFG
from tapegrid.plans.session import scratch
from tapegrid.streaming import ticks as st

TICKS = "seq long, symbol string, ts timestamp, spot double"
DAY = dt.datetime(2024, 1, 9)


def feed(spark, batches, schema):
    """One file a batch, in order."""
    path = scratch(spark, "feed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return st.read_parquet_stream(spark, path, 1)


def at(minutes, day=0):
    return DAY + dt.timedelta(days=day, minutes=minutes)


BEAT = [(None, None, at(0, 4), None)]


def bar_rows(minutes, symbol="A", day=0, spot=100.0):
    """Bar rows (symbol, label, spot, first, last) of single ticks at given minutes of the day."""
    return [(symbol, at(-(-m // 5) * 5, day), spot + m, at(m, day), at(m, day)) for m in minutes]


BARS = "symbol string, ts timestamp, spot double, first_ts timestamp, last_ts timestamp"


def session_rows(spark, batches, stale="30 minutes"):
    df, counts = st.drained(st.session_state_stream(feed(spark, [*batches, [(None, at(0, 4), None, None, None)]], BARS), CFG, stale), "state")
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[2], r[8])), counts


def test_two_silences_in_one_session_and_no_state_left(spark):
    rows = bar_rows([600, 604, 640, 645, 700, 702]) + bar_rows([1400], "B")
    whole, _ = session_rows(spark, [rows])
    stale = [(r[0], r[2]) for r in whole if r[8]]
    assert stale == [("A", at(634)), ("A", at(675)), ("A", at(732)), ("B", at(1430))]
    ordered, counts = session_rows(spark, [rows[:2], rows[2:3], rows[3:4], rows[4:5], rows[5:]])
    assert ordered == whole and counts["batches"] >= 6 and counts["state_rows"] == 0 and counts["late"] == 0


def test_session_ends_with_its_day(spark):
    rows = bar_rows([900], day=0) + bar_rows([600, 610], day=1, spot=50.0)
    got, counts = session_rows(spark, [rows[:1], rows[1:]], None)
    assert [(r[1].day, r[4], r[5], r[7]) for r in got] == [(9, 1000.0, 1000.0, 1), (10, 650.0, 650.0, 1), (10, 660.0, 650.0, 2)]
    assert counts["state_rows"] == 0


def test_rows_out_of_order_within_the_watermark(spark):
    rows = bar_rows([600, 605, 610, 615])
    whole, _ = session_rows(spark, [rows], None)
    mixed, counts = session_rows(spark, [[rows[1]], [rows[0], rows[3]], [rows[2]]], None)
    assert mixed == whole and counts["late"] == 0
    late, counts = session_rows(spark, [[rows[3]], bar_rows([660]), [rows[0]]], None)
    assert counts["late"] == 1 and len(late) == 2


def test_live_ladder(spark):
    schema = "symbol string, strike double, ts timestamp, seq long, gex double, oi double"
    bar = [("A", 100.0 + k, at(601 + k), k, float(k), None) for k in range(3)] + [("A", 101.0, at(604), 9, None, 5.0)]
    thin = [("A", 100.0, at(606), 10, 7.0, 1.0), ("A", 101.0, at(607), 11, 7.0, 1.0)]  # two strikes only: the one before stays the latest
    later = [("A", 100.0 + k, at(661 + k / 9), 20 + k, 1.0, 1.0) for k in range(4)]
    late = [("A", 102.0, at(603), 30, 99.0, 99.0), ("A", 103.0, at(603), 31, 99.0, 99.0)]
    beat = [(None, None, at(0, 2), None, None, None)]
    df, counts = st.drained(st.ladder_stream(feed(spark, [bar[:2], bar[2:] + thin, later[:2], later[2:], late, beat], schema), 5), "ladder")
    got = sorted((r.ts, r.strike, r.gex, r.oi) for r in df.collect())
    assert got == [(at(605), 100.0, 0.0, None), (at(605), 101.0, 1.0, 5.0), (at(605), 102.0, 2.0, None)] + [(at(665), 100.0 + k, 1.0, 1.0) for k in range(4)]
    assert counts["late"] == 2


@pytest.mark.parametrize("parts", [1, 6])
def test_decisions_do_not_depend_on_batches(spark, parts):
    ticks = [(k, "A", at(570 + k * 2), 100.0 + (k * 7) % 13) for k in range(90)] + [(1000 + k, "B", at(600 + k, 1), 50.0 + k) for k in range(40)]
    buffer = st.SessionBuffer(spark, CFG)
    step = -(-len(ticks) // parts)
    stream = feed(spark, [ticks[i: i + step] for i in range(0, len(ticks), step)], TICKS)
    st.decision_cycle(stream, lambda df, i: buffer.put(st.live_decisions(buffer.take(df, i), CFG), i), scratch(spark, "c"), every=None).awaitTermination()
    got = buffer.result("symbol string, session_date date, bar int, rows long, spot double, high double, low double", ("symbol", "session_date", "bar"))
    static = spark.createDataFrame(ticks, TICKS).withColumn("session_date", F.to_date("ts"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, st.live_decisions(static, CFG).collect()))
    assert min(r.rows for r in got.collect()) >= 30 and buffer.late().count() == parts


def test_late_rows_are_counted(spark):
    buffer = st.SessionBuffer(spark, CFG, "10 minutes")
    rows = [[(1, "A", at(600), 1.0)], [(2, "A", at(660), 2.0), (3, "A", at(595), 3.0)], [(4, "A", at(655), 4.0), (5, "A", at(600), 5.0), (6, "A", at(640), 6.0)]]
    seen = []
    for i, r in enumerate(rows):
        seen.append(sorted(x.seq for x in buffer.take(spark.createDataFrame(r, TICKS), i).collect()))
    assert seen == [[1], [1, 2, 3], [1, 2, 3, 4]]
    buffer.take(spark.createDataFrame(rows[2], TICKS), 2)  # a replayed batch changes nothing
    assert sorted(map(tuple, buffer.late().collect())) == [(0, 1, 0), (1, 2, 0), (2, 3, 2)]


def test_file_order_decides_duplicates(spark, tmp_path):
    from tapegrid.sources import files as fs
    (tmp_path / "p.csv").write_text("time,close\n2024-01-09 10:00:00,101\n2024-01-09 10:05:00,7\n2024-01-09 10:00:00,100.5\n")
    (tmp_path / "q.csv").write_text("time,close\n2024-01-09 10:05:00,6\n")
    assert sorted(r.spot for r in fs.read_prices(spark, str(tmp_path), CFG).collect()) == [6.0, 100.5]
    for name, rows in (("lad_20240109_1000", "100,1\n100,2\n105,3\n"), ("lad_20240109_1100", "100,4\n"), ("notes", "1,1\n")):
        (tmp_path / "l").mkdir(exist_ok=True)
        (tmp_path / "l" / f"{name}.csv").write_text("strike,gex\n" + rows)
    got = sorted((r.ts.hour, r.strike, r.gex) for r in fs.read_ladder_dir(spark, str(tmp_path / "l"), tz="UTC").collect())
    assert got == [(10, 100.0, 2.0), (10, 105.0, 3.0), (11, 100.0, 4.0)]
