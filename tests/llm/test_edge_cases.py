"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest

from tapegrid.llm import bpe, licenses, lm, packing, quality, secrets, simhash, substring, toxicity, weighted
from tapegrid.llm.queries import tokenizer
from tapegrid.llm.text import one_label

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, 1, 1), (6, 0, 0), (None, None, None), (4, None, 1), (99, 0, 0)], LABELS)


SMALL = lm.Shape(top=20, classes=8, width=4, noise=4, batch=256, head=64)
OPERATORS = {
    "op1": lambda d, y: substring.report(d), "op2": lambda d, y: lm.score(d, SMALL), "op3": lambda d, y: quality.judge(d, y), "op4": lambda d, y: simhash.report(d),
    "op5": lambda d, y: packing.report(d, tokenizer()), "op6": lambda d, y: weighted.report(d, 16), "op7": lambda d, y: secrets.report(d), "op8": lambda d, y: toxicity.report(d, y),
    "op9": lambda d, y: bpe.report(d, tokenizer()), "op10": lambda d, y: licenses.report(d),
    "keep": lambda d, y: quality.keep(d, y), "first": lambda d, y: simhash.keep_first(d), "remove": lambda d, y: substring.remove(d), "redact": lambda d, y: secrets.redact(d),
}
PER_ROW = ["op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10"]


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(odd, labels, name):
    got = OPERATORS[name](odd, labels).collect()
    if name in PER_ROW:
        assert len(got) == odd.count()
        assert sum(r.doc_id is None for r in got) == 2
        same = [tuple(v for k, v in r.asDict().items() if k not in ("near_next", "near_edited", "edited_sha256", "edited_fingerprint")) for r in got if r.doc_id == 5]
        assert same[0] == same[1]
    if name in ("keep", "first", "remove", "redact"):
        assert OPERATORS[name](odd, labels).columns == odd.columns


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(none, spark, name):
    assert OPERATORS[name](none, spark.createDataFrame([], LABELS)).collect() == []


def test_an_id_with_two_labels_has_the_smaller(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (2, None, None), (None, 1, 1)]
    for table in (rows, rows[::-1]):
        labels = spark.createDataFrame(table, LABELS).repartition(3)
        assert {tuple(r) for r in one_label(labels, "doc_id", "quality", "_good").collect()} == {(1, 0), (2, 1)}
        assert {tuple(r) for r in one_label(labels, "doc_id", "toxic", "_y").collect()} == {(1, 0), (2, 1)}


def test_a_mark_may_hold_quotes(spark):
    docs = spark.createDataFrame([(1, "a password=abcdefgh12345 z", "s")], "doc_id long, text string, source string")
    mark = "<it's \\'gone'\">"
    assert secrets.redact(docs, mark=mark).first()["text"].count(mark) == 1


def test_packing_keeps_clashing_columns(spark):
    rows = [(i, 0, 0, n, 0, f"t{i}", i, -1, -1) for i, n in enumerate([1000, 24, 600, 424, 1024, 3])]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, _task string, _k long, sequence_id long, `offset` long")
    got = {r["doc_id"]: r for r in packing.pack(pieces).collect()}
    assert all(got[i]["_task"] == f"t{i}" and got[i]["_k"] == i for i in range(6))
    assert got[0]["sequence_id"] == got[1]["sequence_id"] and got[2]["sequence_id"] == got[3]["sequence_id"]
    assert len({r["sequence_id"] for r in got.values()}) == 4 and got[1]["offset"] == 1000 and got[3]["offset"] == 600
