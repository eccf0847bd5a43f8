"""Quality rules: statistics of simple rules for each text, an isolation forest over them, a calibrated cut.

The forest is grown on a bounded sample of rows labelled good, so documents unlike them get short paths. The cut is taken
from the scores of all labelled rows: of the cuts that reject at most ``good_loss`` of the good rows, the one
that separates best. Without labelled rows of both kinds nothing is rejected beyond the base rules.

Null or empty text: zero words, so the base rules reject it. Null ids and repeated rows are scored like any row;
a label counts once for each row of its id. Null labels are left out. Labels never decide a row directly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.forest import IsolationForest
from tapegrid.llm.text import SPACE, drawn, map_docs, one_label, shingles, texts, words
from tapegrid.plans.session import materialise

#: Characters counted as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True
STEPS = 1000
BLANKS = b" \t\n\x0b\x0c\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["long_log", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "other_rate", "mark_rate", "same_rate"]


def rule_arrays(col: pa.Array) -> dict[str, np.ndarray]:
    """Counts and rates of each whole text of an Arrow column."""
    w = words(col)
    raws = texts(col)
    n = np.diff(w.first)
    edge = np.zeros(len(raws) + 1, np.int64)
    np.cumsum([len(r) for r in raws], out=edge[1:])

    def count(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(w.buf) + 1, np.int64)
        np.cumsum(table[w.buf], out=total[1:])
        return total[edge[1:]] - total[edge[:-1]]

    symbols, upper, digits, letters, blanks = map(count, (SYMBOLS, UPPER, DIGIT, LETTER, SPACE))
    solid = np.diff(edge) - blanks
    chars = solid - count(CONTINUES)
    lines, dups = np.zeros(len(raws), np.int64), np.zeros(len(raws), np.int64)
    for i, raw in enumerate(raws):
        own = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
        lines[i], dups[i] = len(own), len(own) - len(set(own))
    repeat = w.per_doc(_repeated(w))
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    marks = np.zeros(len(w.hash), bool)
    if len(w.hash):
        marks = SYMBOLS[w.buf[w.ends - 1]] | (w.ends - w.starts == 1) & ~LETTER[w.buf[w.starts]] & ~DIGIT[w.buf[w.starts]]
    one, sign = np.maximum(n, 1), np.maximum(solid, 1)
    counts = (n, chars, symbols, dups, repeat)
    rates = (np.log1p(n), chars / one, symbols / sign, dups / np.maximum(lines, 1), repeat / one, upper / sign, digits / sign,
             (solid - letters - digits) / sign, w.per_doc(marks) / one, w.per_doc(same) / one)
    return dict(zip(COUNTS, (x.astype(np.int64) for x in counts))) | dict(zip(RATES, (np.asarray(x, np.float64) for x in rates)))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and rates of each row's whole text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = rule_arrays(b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, x.values())], names=["doc_id", *x])

    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_docs(inner, run, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in RATES)]))


def _repeated(w) -> np.ndarray:
    """Whether each word lies in a 3-word window that its text holds twice or more."""
    h, ok = shingles(w, 3)
    at = np.flatnonzero(ok)
    order = at[np.lexsort((h[at], w.doc[at]))]
    twin = (h[order[1:]] == h[order[:-1]]) & (w.doc[order[1:]] == w.doc[order[:-1]])
    hit = np.zeros(len(h) + 2, bool)
    hit[order[1:][twin]] = True
    hit[order[:-1][twin]] = True
    out = hit[:-2].copy()
    out[1:] |= hit[:-3]
    out[2:] |= hit[:-4]
    return out[: len(h)]


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class Rules:
    """A grown forest and the step of its score (thousandths) from which rows are rejected."""

    forest: IsolationForest | None
    cut: int

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        return self.forest.score(x) if self.forest is not None else np.zeros(len(x))

    def passes(self, anomaly: np.ndarray) -> np.ndarray:
        return np.floor(anomaly * STEPS) < self.cut


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", trees: int = 100, sample: int = 256, good_loss: float = 0.03) -> Rules:
    """The forest sees at most ``trees * sample`` good rows, those whose hashed ids are smallest; the cut comes
    from all labelled rows, counted by steps of the score. An id with several labels counts as the smallest of them."""
    marked = one_label(labels, id_col, label_col, "_good")
    known = stats.filter(~base_failed()).join(marked, F.col("doc_id") == F.col("_id"))
    good = known.filter("_good = 1").select("doc_id", *RATES)
    points = drawn(good, "doc_id", trees * sample, good.count()).select(*RATES).toPandas().to_numpy(np.float64).reshape(-1, len(RATES))
    if not len(points):
        return Rules(None, STEPS + 1)
    rules = Rules(IsolationForest(points, trees, sample), STEPS + 1)
    scored = _scored(known.select("doc_id", *COUNTS, *RATES, "_good"), rules, extra=["_good int"])
    steps = scored.groupBy(F.floor(F.col("anomaly") * STEPS).cast("int").alias("step")).agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad")).toPandas()
    return Rules(rules.forest, _cut(steps.step.to_numpy(), steps.good.to_numpy(), steps.bad.to_numpy(), good_loss))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row's counts, anomaly score, base_failed and kept. The statistics are computed once and kept."""
    stats = materialise(statistics(docs, id_col, text_col), "quality")
    rules = learn(stats, labels, id_col, **options)
    kept = ~base_failed() & (F.floor(F.col("anomaly") * STEPS) < rules.cut)
    return _scored(stats, rules).select("doc_id", *COUNTS, "anomaly", base_failed().alias("base_failed"), kept.alias("kept"))


def _cut(step: np.ndarray, good: np.ndarray, bad: np.ndarray, good_loss: float) -> int:
    """The step from which rejecting gains most (share of bad rows caught less share of good rows lost), losing at most
    ``good_loss`` of the good rows; beyond all steps without rows of both kinds."""
    if not bad.sum() or not good.sum():
        return STEPS + 1
    order = np.argsort(-step)
    lost, caught = np.cumsum(good[order]) / good.sum(), np.cumsum(bad[order]) / bad.sum()
    gain = np.where(lost <= good_loss, caught - lost, -1.0)
    best = int(np.argmax(gain))
    return int(step[order][best]) if gain[best] > 0 else STEPS + 1


def _scored(stats: DataFrame, rules: Rules, extra: list[str] = ()) -> DataFrame:
    names = ["doc_id", *COUNTS, *RATES, *(x.split()[0] for x in extra)]
    shared = stats.sparkSession.sparkContext.broadcast(rules)

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in RATES])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.anomaly(x))], names=[*names, "anomaly"])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in RATES), *extra, "anomaly double"])
    return stats.select(*names).mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that the rules keep, with their own columns; each row is judged in place, without a join."""
    stats = materialise(statistics(docs, id_col, text_col), "quality")
    shared = docs.sparkSession.sparkContext.broadcast(learn(stats, labels, id_col, **options))
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = rule_arrays(b.column(at))
        fine = (x["n_words"] >= 50) & (100 * x["n_repeat_words"] <= 50 * x["n_words"])
        fine &= shared.value.passes(shared.value.anomaly(np.column_stack([x[c] for c in RATES])))
        return b.filter(pa.array(fine))

    return map_docs(docs, run, docs.schema, text_col)
