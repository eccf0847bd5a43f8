"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence's probability is a logistic function of its hashed words; the
document's is their noisy-or, ``1 - prod(1 - p)``. Only document labels are known; their gradient passes through the
noisy-or to the sentences, so the offending ones carry the weight and can be located afterwards.

Training takes at most ``max_train`` labelled rows (smallest hashed ids; a documented bound for a fitted classifier).
Scoring covers every whole text. Null or empty text: no sentence, score of the empty bag (0). Null ids,
repeated rows: scored like any row. Null labels are left out. With one class only, every score is the empty bag's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.text import crc_mod, drawn, map_docs, one_label, words

#: Bytes of words: letters, digits and everything beyond ASCII; the rest separates words.
OUTSIDE = np.ones(256, bool)
OUTSIDE[48:58] = OUTSIDE[65:91] = OUTSIDE[97:123] = False
OUTSIDE[128:] = False
#: Bytes that end a sentence.
STOP = np.zeros(256, bool)
STOP[list(b".!?\n")] = True


@dataclass
class Bags:
    """Distinct words of each sentence: feature ids, the sentence of each, and the document of each sentence."""

    feature: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def bags(col: pa.Array, bits: int = 18) -> Bags:
    """Sentences of a batch; words are lower-cased and hashed to ``2 ** bits`` features."""
    w = words(col, lower=True, outside=OUTSIDE)
    stops = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(STOP[w.buf], out=stops[1:])
    if not len(w.hash):
        return Bags(*(np.zeros(0, np.int64),) * 5)
    new = np.ones(len(w.hash), bool)
    new[1:] = (w.doc[1:] != w.doc[:-1]) | (stops[w.starts[1:]] != stops[w.ends[:-1]])
    sentence = np.cumsum(new) - 1
    pair = np.unique(sentence.astype(np.int64) << bits | (w.hash & np.uint64(2 ** bits - 1)).astype(np.int64))
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(new)] - 1
    base = np.searchsorted(w.doc, np.arange(len(col)))
    doc = w.doc[first]
    return Bags(pair & (2 ** bits - 1), pair >> bits, doc, first - base[doc], last + 1 - base[doc])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, b: Bags) -> np.ndarray:
        z = np.bincount(b.sentence, self.weights[b.feature], minlength=len(b.doc)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def documents(self, b: Bags, n: int) -> np.ndarray:
        """Noisy-or over each document's sentences."""
        return 1 - np.exp(np.bincount(b.doc, np.log1p(-np.minimum(self.sentences(b), 1 - 1e-12)), minlength=n)) if len(b.doc) else np.zeros(n)


def fit(b: Bags, label: np.ndarray, bits: int = 18, least_docs: int = 4, least_z: float = 4.0, rounds: int = 300, rate: float = 0.05, decay: float = 2e-3) -> Model:
    """Gradient ascent (Adam) on the likelihood of document labels through the noisy-or.

    Only words get a weight that ``least_docs`` toxic documents hold and that are ``least_z`` standard deviations more frequent
    there than in clean ones, so single documents are not learned by heart.
    """
    n = len(label)
    model = Model(np.zeros(2 ** bits), -6.0)
    if not n or label.min() == label.max():
        return model
    seen = np.unique(b.doc[b.sentence].astype(np.int64) << bits | b.feature)
    bad, toxic = label.sum(), label[seen >> bits] > 0
    of_bad, of_good = (np.bincount((seen & (2 ** bits - 1))[m], minlength=2 ** bits) for m in (toxic, ~toxic))
    rate_good = (of_good + 0.5) / (n - bad + 1)
    known = (of_bad >= least_docs) & (of_bad - bad * rate_good >= least_z * np.sqrt(bad * rate_good * (1 - np.minimum(rate_good, 1))))
    use = known[b.feature]
    own, inverse = np.unique(b.feature[use], return_inverse=True)
    at = b.sentence[use]
    w, bias = np.zeros(len(own)), -6.0
    m, v = np.zeros(len(own) + 1), np.zeros(len(own) + 1)
    for step in range(1, rounds + 1):
        z = np.clip(np.bincount(at, w[inverse], minlength=len(b.doc)) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(b.doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
        # d log L / d z of a sentence: p * none / (1 - none) in toxic bags, -p in clean ones
        pull = np.where(label > 0, none / np.maximum(1 - none, 1e-9), -1.0)
        g = p * pull[b.doc]
        grad = np.r_[np.bincount(inverse, g[at], minlength=len(own)), g.sum()] / n
        grad[:-1] -= decay / n ** 0.5 * np.sign(w) + decay * w / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w + move[:-1], bias + move[-1]
    model.weights[own], model.bias = w, float(bias)
    return model


def train(docs: DataFrame, labels: DataFrame, max_train: int = 12000, bits: int = 18, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most ``max_train`` labelled rows whose crc32 remainder is not 0; texts travel as feature ids.

    Half of the room is for each class at most, so rare toxic rows are used first; the other class's share is
    weighted back through the bias. An id with several labels counts as the smallest of them.
    """
    marked = one_label(labels, id_col, label_col, "_y")
    marked = marked.filter(crc_mod(F.col("_id"), 5) != 0)
    share = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(share) < 2:
        return Model(np.zeros(2 ** bits), -6.0)
    picked = None
    for y in (0, 1):
        one = drawn(marked.filter(F.col("_y") == y), "_id", max_train // 2, share.get(y, 0))
        picked = one if picked is None else picked.unionByName(one)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = bags(b.column(0), bits)
        # of a sentence only its words count here: sentences without any repeat in the bag are merged nowhere
        cut = np.searchsorted(x.sentence, np.searchsorted(x.doc, np.arange(b.num_rows + 1)))
        first = np.searchsorted(x.doc, np.arange(b.num_rows))
        feats = [x.feature[a:z].astype(np.int32) for a, z in zip(cut[:-1], cut[1:])]
        sents = [(x.sentence[a:z] - f).astype(np.int32) for a, z, f in zip(cut[:-1], cut[1:], first)]
        return pa.RecordBatch.from_arrays([b.column(1), pa.array(feats, pa.list_(pa.int32())), pa.array(sents, pa.list_(pa.int32()))], names=["y", "f", "s"])

    got = map_docs(rows.select("text", "_y"), run, "y int, f array<int>, s array<int>").toArrow()
    y = got["y"].to_numpy().copy()
    f, s = (got[c].combine_chunks() for c in ("f", "s"))
    sizes = np.diff(f.offsets.to_numpy())
    feature, local = f.values.to_numpy()[: int(sizes.sum())].copy(), s.values.to_numpy()[: int(sizes.sum())].copy()
    del got, f, s
    doc = np.repeat(np.arange(len(y)), sizes)
    begin = np.zeros(len(y) + 1, np.int64)
    top = np.full(len(y), -1, np.int64)
    np.maximum.at(top, doc, local)
    np.cumsum(top + 1, out=begin[1:])
    per = np.repeat(np.arange(len(y)), top + 1)
    order = np.zeros(len(per), np.int64)
    sentence = (local + begin[doc]).astype(np.int32)
    del local, doc
    model = fit(Bags(feature, sentence, per, order, order), y.astype(float), bits)
    took = np.bincount(y, minlength=2)
    odds = (share[1] / share[0]) / max(1e-9, took[1] / max(1, took[0]))
    model.bias += float(np.clip(np.log(odds), -3, 3))
    return model


def score(docs: DataFrame, model: Model, bits: int = 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's score, and its worst sentence: first word, end word and probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, x, n = shared.value, bags(b.column(1), bits), b.num_rows
        p = m.sentences(x)
        total = m.documents(x, n)
        order = np.lexsort((-np.arange(len(p)), p, x.doc))
        last = np.searchsorted(x.doc[order], np.arange(n), "right") - 1
        has = np.bincount(x.doc, minlength=n) > 0
        worst = order[np.maximum(last, 0)] if len(order) else np.zeros(n, np.int64)
        pick = lambda a: pa.array(a[worst] if len(order) else np.zeros(n), mask=~has)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(total), pick(x.start).cast(pa.int64()), pick(x.end).cast(pa.int64()), pick(p).cast(pa.float64())],
                                          names=["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_docs(inner, run, "doc_id long, score double, worst_start long, worst_end long, worst_score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      "worst_start", "worst_end", "worst_score")
