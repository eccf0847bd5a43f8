"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are lower-cased words and one end for each text. Their counts over all training texts give the base (unigram) score. The
model predicts symbols: the most frequent words, the end, and classes that share the other words by their last two
bytes; a word inside its class follows the class's counts. With embeddings r, position matrices C1, C2 and biases b, a
symbol's score after (u, v) is ``(r_u C1 + r_v C2) . r_w + b_w``.

* counts: combined inside map tasks, then by word hash; they cover every training text and grow with them
* training: every task runs minibatches over all its training texts against shared noise samples drawn from the
  symbols' frequencies; the tasks' parameters are averaged, weighted by their tokens, element by element
* normalisation: the sum over all symbols for every pair of context symbols, as batched matrix products spread over tasks
* scoring: table look-ups for the ``head`` most frequent words; counts of all other words come by a join on their hash

Tables on the driver are bounded by ``head`` and by symbols squared, which are parameters. Words are told apart by 64-bit hashes.

Null or empty text: one end. Null ids: their crc32 is that of the empty text. Repeated rows are scored each; each trains.
Without any training text all symbols are equally likely.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.text import crc_mod, map_docs, pieces, words
from tapegrid.plans.session import materialise

#: Hash that stands for the end of a text.
END = np.uint64(1)
LN10 = np.log(10.0)


@dataclass(frozen=True)
class Shape:
    """Sizes of the model: most frequent words as symbols, classes of the others, width, noise samples, minibatch, rate."""

    top: int = 511
    classes: int = 256
    width: int = 24
    noise: int = 48
    batch: int = 4096
    rate: float = 0.15
    head: int = 1 << 17

    @property
    def symbols(self) -> int:
        return self.top + 1 + self.classes


def tokens(col: pa.Array, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token of a batch, ends included, and the edges of each text's tokens."""
    w = words(col, lower=True)
    last = w.buf[w.ends - 1].astype(np.int64) if len(w.hash) else np.zeros(0, np.int64)
    prior = np.where(w.ends - w.starts > 1, w.buf[w.ends - 2], 0).astype(np.int64) if len(w.hash) else last
    kind = (last * 131 + prior * 7) % 1009 % classes
    return np.insert(w.hash, w.first[1:], END), np.insert(kind, w.first[1:], -1), w.first + np.arange(len(w.first))


def _inner(docs: DataFrame, id_col: str, text_col: str, held: int, mod: int) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(F.col(id_col), mod) == held).alias("held_out"), F.col(text_col).cast("string").alias("text"))


def counts(inner: DataFrame, classes: int, room: int = 1 << 20) -> DataFrame:
    """(hash, kind, c) of every distinct training token. A task sums up to ``room`` distinct tokens before it passes them on."""

    def run(batches):
        parts: list[tuple] = []
        held = 0

        def merged():
            h, k, c = (np.concatenate(x) for x in zip(*parts))
            own, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return own, k[first], np.bincount(inverse, c).astype(np.int64)

        def out(own, kind, c):
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(c)], names=["hash", "kind", "n"])

        for b in batches:
            for p in pieces(b):
                h, k, _ = tokens(p.column(0), classes)
                own, first, c = np.unique(h, return_index=True, return_counts=True)
                parts.append((own, k[first], c))
                held += len(own)
                if held > room:
                    parts = [merged()]
                    held = len(parts[0][0])
                    if held > room // 2:
                        yield out(*parts.pop())
                        held = 0
        if parts:
            yield out(*merged())

    rows = inner.filter("NOT held_out").select("text").mapInArrow(run, "hash long, kind int, n long")
    return rows.groupBy("hash").agg(F.min("kind").alias("kind"), F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """What scoring looks up: totals, head words with counts, symbols of the top ones, and class totals."""

    total: int
    distinct: int
    head: np.ndarray
    count: np.ndarray
    symbol: np.ndarray
    noise: np.ndarray
    class_mass: np.ndarray
    shape: Shape

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.head, h), max(0, len(self.head) - 1))
        return at, self.head[at] == h if len(self.head) else np.zeros(len(h), bool)

    def symbols(self, h: np.ndarray, kind: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Symbol of each token: its own, the end's, or its class's."""
        own = np.where(known, self.symbol[at] if len(self.symbol) else -1, -1)
        out = np.where(own >= 0, own, self.shape.top + 1 + kind)
        return np.where(h == END, self.shape.top, out)


def vocabulary(table: DataFrame, shape: Shape) -> Vocabulary:
    total, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # words by steps of their count: whole steps from the top, as many as ``head`` words allow, so tasks send no more than that
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    sizes = sorted(table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v")).collect(), reverse=True)
    low = next((s.step + 1 for s, many in zip(sizes, np.cumsum([s.v for s in sizes])) if many > shape.head), 0)
    top = table.filter((step >= low) | (F.col("hash") == int(END))).toPandas().sort_values(["c", "hash"], ascending=[False, True])
    h, c, kind = top.hash.to_numpy(np.int64).view(np.uint64), top.c.to_numpy(np.int64), top.kind.to_numpy(np.int64)
    words_only = np.flatnonzero(h != END)[: shape.top]
    symbol = np.full(len(h), -1, np.int64)
    symbol[words_only] = np.arange(len(words_only))
    by = table.groupBy("kind").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toPandas()
    mass, size = np.zeros(shape.classes), np.zeros(shape.classes)
    inside = by.kind.to_numpy() >= 0
    mass[by.kind[inside]], size[by.kind[inside]] = by.c[inside], by.v[inside]
    np.subtract.at(mass, kind[words_only], c[words_only])
    np.subtract.at(size, kind[words_only], 1)
    ends = float(by.c[~inside].sum())
    noise = np.r_[c[words_only].astype(float), np.zeros(shape.top - len(words_only)), ends, mass] + 0.5
    order = np.argsort(h)
    return Vocabulary(int(total), int(distinct), h[order], c[order], symbol[order], noise / noise.sum(), mass + 0.5 * (size + 1), shape)


@dataclass
class Parameters:
    r: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(v: Vocabulary, seed: int = 5) -> "Parameters":
        """Small random embeddings (one more for the start of a text) and the symbols' log frequencies as biases."""
        rng, d = np.random.default_rng(seed), v.shape.width
        eye = np.eye(d, dtype=np.float32)
        return Parameters(rng.normal(0, 0.1, (v.shape.symbols + 1, d)).astype(np.float32), eye * 0.5, eye * 0.5, np.log(v.noise).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in (self.r, self.c1, self.c2, self.b)])

    def unflat(self, x: np.ndarray) -> "Parameters":
        out, lo = [], 0
        for old in (self.r, self.c1, self.c2, self.b):
            out.append(x[lo: lo + old.size].reshape(old.shape).astype(np.float32))
            lo += old.size
        return Parameters(*out)


def _scatter(rows: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
    """Adds each value row to its id's row."""
    order = np.argsort(ids, kind="stable")
    at = ids[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    rows[at[starts]] += np.add.reduceat(values[order], starts, axis=0)


class Trainer:
    """Minibatch noise-contrastive estimation with per-parameter rates."""

    def __init__(self, p: Parameters, noise: np.ndarray, shape: Shape, seed: int):
        self.p, self.shape, self.rng = Parameters(*(x.copy() for x in (p.r, p.c1, p.c2, p.b))), shape, np.random.default_rng(seed)
        self.cumulative = np.cumsum(noise)
        self.log_noise = np.log(noise * shape.noise).astype(np.float32)
        self.seen = Parameters(*(np.full(x.shape, 1e-6, np.float32) for x in (p.r, p.c1, p.c2, p.b)))

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        p, k = self.p, self.shape.noise
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(k) * self.cumulative[-1]), len(p.b) - 1)
        ru, rv, rw, rn = p.r[u], p.r[v], p.r[w], p.r[drawn]
        q = ru @ p.c1 + rv @ p.c2
        up = 1 / (1 + np.exp((q * rw).sum(1) + p.b[w] - self.log_noise[w]))
        down = -1 / (1 + np.exp(-(q @ rn.T + p.b[drawn] - self.log_noise[drawn])))
        dq = up[:, None] * rw + down @ rn
        g = Parameters(*(np.zeros_like(x) for x in (p.r, p.c1, p.c2, p.b)))
        _scatter(g.r, w, up[:, None] * q)
        np.add.at(g.r, drawn, down.T @ q)
        _scatter(g.r, u, dq @ p.c1.T)
        _scatter(g.r, v, dq @ p.c2.T)
        g.c1[:], g.c2[:] = ru.T @ dq, rv.T @ dq
        g.b[:] = np.bincount(w, up, minlength=len(p.b))
        np.add.at(g.b, drawn, down.sum(0))
        for name in ("r", "c1", "c2", "b"):
            x, s, d = getattr(p, name), getattr(self.seen, name), getattr(g, name) / len(w)
            s += d * d
            x += self.shape.rate * d / np.sqrt(s + 1e-8)


def contexts(s: np.ndarray, edges: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The two symbols before each token; the start symbol before a text."""
    v = np.r_[start, s[:-1]] if len(s) else s
    v[edges[:-1]] = start
    u = np.r_[start, v[:-1]] if len(s) else s
    u[edges[:-1]] = start
    return u, v


def train(inner: DataFrame, v: Vocabulary, rounds: int = 1) -> Parameters:
    """Parameters after each task's pass over all its training texts, averaged; again for every round."""
    spark, shape = inner.sparkSession, v.shape
    p = Parameters.start(v)
    if not v.total:
        return p
    lookup = spark.sparkContext.broadcast(v)
    for _ in range(rounds):
        begin = spark.sparkContext.broadcast(p)

        def run(batches):
            voc, n = lookup.value, 0
            t = Trainer(begin.value, voc.noise, shape, seed=TaskContext.get().partitionId())
            for b in batches:
                for part in pieces(b):
                    h, kind, edges = tokens(part.column(0), shape.classes)
                    s = voc.symbols(h, kind, *voc.find(h))
                    u, w = contexts(s, edges, shape.symbols)
                    order = t.rng.permutation(len(s))
                    for lo in range(0, len(s), shape.batch):
                        at = order[lo: lo + shape.batch]
                        t.step(u[at], w[at], s[at])
                    n += len(s)
            if n:
                flat = t.p.flat()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64)), pa.array(np.full(len(flat), float(n)))], names=["i", "x", "n"])

        mean = inner.filter("NOT held_out").select("text").mapInArrow(run, "i int, x double, n double").groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).toPandas()
        flat = p.flat().astype(np.float64)
        flat[mean.i] = mean.x
        p = p.unflat(flat)
    return p


def normalisers(spark, p: Parameters, symbols: int) -> np.ndarray:
    """Log of the sum over all symbols after every pair of symbols, (symbols + 1) squared values."""
    shared = spark.sparkContext.broadcast(p)

    def run(batches):
        p = shared.value
        right, out = p.r @ p.c2, p.r[:symbols].T
        for b in batches:
            for u in b.column(0).to_pylist():
                z = (p.r[u] @ p.c1 + right) @ out + p.b
                top = z.max(1)
                yield pa.RecordBatch.from_pydict({"u": pa.array([u], pa.int64()), "z": pa.array([(np.log(np.exp(z - top[:, None]).sum(1)) + top).astype(np.float64)], pa.list_(pa.float64()))})

    rows = spark.range(0, symbols + 1, 1, 12).mapInArrow(run, "u long, z array<double>").toPandas()
    out = np.zeros((symbols + 1, symbols + 1), np.float32)
    out[rows.u] = np.stack(rows.z)
    return out


def score(docs: DataFrame, shape: Shape = Shape(), rounds: int = 1, held: int = 1, mod: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's tokens, known tokens, base score and the model's log10 probability; training rows are those not held out."""
    spark = docs.sparkSession
    inner = _inner(docs, id_col, text_col, held, mod)
    table = materialise(counts(inner, shape.classes), "lm-counts")
    voc = vocabulary(table, shape)
    p = train(inner, voc, rounds)
    z = normalisers(spark, p, shape.symbols)
    first, second = (p.r @ p.c1) @ p.r[: shape.symbols].T + p.b, (p.r @ p.c2) @ p.r[: shape.symbols].T
    shared = spark.sparkContext.broadcast((voc, first, second, z))

    def run(batches):
        voc, first, second, z = shared.value
        task, done = TaskContext.get().partitionId(), 0
        in_class = -np.log10(voc.class_mass)
        log_head = np.log10(voc.count + 0.5)
        for b in batches:
            for part in pieces(b):
                h, kind, edges = tokens(part.column(2), shape.classes)
                at, known = voc.find(h)
                s = voc.symbols(h, kind, at, known)
                u, v = contexts(s, edges, shape.symbols)
                model = (first[u, s] + second[v, s] - z[u, v]).astype(np.float64) / LN10
                classed = s > shape.top
                own = np.where(known, log_head[at] if len(log_head) else 0.0, 0.0)
                model += np.where(classed, own + in_class[np.maximum(s - shape.top - 1, 0)], 0.0)
                total = lambda x: np.add.reduceat(x, edges[:-1])  # noqa: E731  every text has its end
                far = h[~known].view(np.int64)
                cuts = np.r_[0, np.cumsum(total((~known).astype(np.int64)))]
                rows = len(edges) - 1
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array((np.int64(task) << 36) + done + np.arange(rows)), pa.array(np.diff(edges)), pa.array(total(known.astype(np.int64))),
                    pa.array(total(own)), pa.array(total(model)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(far))], schema=wide)
                done += rows

    wide = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_head", pa.int64()),
                      ("base", pa.float64()), ("model", pa.float64()), ("far", pa.list_(pa.int64()))])
    seen = materialise(inner.mapInArrow(run, "doc_id long, held_out boolean, row long, n_tokens long, n_head long, base double, model double, far array<long>"), "lm-scores")
    far = seen.select("row", F.explode("far").alias("hash")).join(table.select("hash", "c"), "hash", "left")
    sums = far.groupBy("row").agg(F.count("c").alias("n_far"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_far"))
    base_z = float(np.log10(voc.total + 0.5 * (voc.distinct + 1)))
    more = F.coalesce("log_far", F.lit(0.0))
    return seen.drop("far").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_far", F.lit(0))).alias("n_known"), F.lit(voc.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * base_z).alias("base_score"), (F.col("model") + more).alias("score"))
