"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its words, lower-cased (A-Z), weighted by their number. For each of ``size`` samples and
each term, gamma and uniform variates that depend on the term alone give a value; the smallest over a text's terms is its
sample. Two texts share a sample with a probability equal to their generalised Jaccard similarity, sum of smaller over sum
of larger weights. The value itself names (term, quantised weight), so a fingerprint keeps 16 bits of each.

Null or empty text, or one without words: the fingerprint of no terms, alike among themselves. Equal texts have equal
fingerprints. Null ids come last in the order by id, rows of one id are ordered by their text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.text import STEP, mix, pieces, texts, words
from tapegrid.plans.session import materialise

#: Rows (terms) whose variates are drawn at once, and texts handled at once.
BLOCK_TERMS = 1 << 15
BLOCK_BYTES = 3 << 20


def variates(terms: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Log values of every (term, weight) pair for each sample: ln c - r (t - b + 1), t = floor(ln w / r + b),
    with r, c ~ Gamma(2, 1) and b uniform, all drawn from the term's hash."""
    out = np.empty((len(terms), size), np.float32)
    lane = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    scale = np.float32(1 / 2 ** 21)
    with np.errstate(over="ignore"):
        for lo in range(0, len(terms), BLOCK_TERMS):
            t = terms[lo: lo + BLOCK_TERMS, None]
            one = mix(t + lane)
            two = mix(one ^ STEP)
            # five uniforms of 21 bits each
            u = [((x >> np.uint64(s)).astype(np.uint32) & np.uint32(0x1FFFFF)).astype(np.float32) * scale + scale / 2 for x, s in ((one, 0), (one, 21), (one, 42), (two, 0), (two, 21))]
            b = (two >> np.uint64(43)).astype(np.float32) * scale
            r = -np.log(u[0] * u[1])
            c = -np.log(u[2] * u[3])
            w = np.log(weights[lo: lo + BLOCK_TERMS, None].astype(np.float32))
            q = np.floor(w / r + b)
            out[lo: lo + BLOCK_TERMS] = np.log(c) - r * (q - b + 1)
    return out


def signatures(raws: list[bytes], size: int) -> np.ndarray:
    """16-bit samples of each text, one row each."""
    out = np.zeros((len(raws), size), np.uint16)
    w = words(pa.array(raws, pa.large_binary()), lower=True)
    if not len(w.hash):
        return out
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.r_[at, len(h)])
    term, doc = h[at], d[at]
    with np.errstate(over="ignore"):
        _, first, inverse = np.unique(mix(term + weight.astype(np.uint64) * STEP), return_index=True, return_inverse=True)
    table = variates(term[first], weight[first], size)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    # texts in groups, so that the gathered rows stay small
    edges = np.r_[starts, len(doc)]
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + 4 * BLOCK_TERMS, "right")) - 1)
        a, z = edges[lo], edges[hi]
        if z - a > 8 * BLOCK_TERMS:  # one very long text
            least = np.min([table[inverse[x: min(z, x + BLOCK_TERMS)]].min(0) for x in range(a, z, BLOCK_TERMS)], axis=0)[None]
        else:
            least = np.minimum.reduceat(table[inverse[a:z]], edges[lo:hi] - a, axis=0)
        bits = mix(np.ascontiguousarray(least).view(np.uint32).astype(np.uint64))
        out[doc[edges[lo:hi]]] = (bits >> np.uint64(48)).astype(np.uint16)
        lo = hi
    return out


def fingerprints(docs: DataFrame, size: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and its samples as hex, four digits each."""
    from tapegrid.llm.text import map_docs

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([s.astype(">u2").tobytes().hex() for s in signatures(texts(b.column(1)), size)])], names=["doc_id", "fingerprint"])

    return map_docs(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fingerprint string")


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [x.split()[0] for x in ROW.split(", ")]


def compared(ids: list, own: list[str], following: list[str], size: int) -> pa.RecordBatch:
    """Each text, its edit by the following text, and their likeness."""
    edited = []
    for text, other in zip(own, following):
        half = len(text) // 2
        edited.append((text[: len(text) - half] + other[:half]).encode("utf-8", "surrogatepass"))
    raw = [t.encode("utf-8", "surrogatepass") for t in own]
    last = following[-1].encode("utf-8", "surrogatepass")
    sig = signatures(raw + [last] + edited, size)  # together: an edit shares most terms with its texts
    mine, after, alt = sig[: len(raw)], sig[1: len(raw) + 1], sig[len(raw) + 1:]
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
        pa.array([s.astype(">u2").tobytes() for s in mine], pa.binary()), pa.array([s.astype(">u2").tobytes() for s in alt], pa.binary()),
        pa.array((mine == alt).mean(1)), pa.array((mine == after).mean(1))], names=NAMES)


def report(docs: DataFrame, size: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint beside those of its edited text and of the next row, by descending id; after the last comes the first.

    Texts are range-sorted once. A task holds one text back; only the last row of each task waits for the first row of
    the next, and these rows, one of each kind a task, are joined by the tasks' order.
    """
    names = ["doc_id", "text"]
    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    ranged = inner.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        """Compared rows; the task's first and last text with its number, for the seams between tasks."""
        task, held, first = TaskContext.get().partitionId(), None, None
        blank = {n: None for n in NAMES}
        for b in batches:
            for p in pieces(b, "text", BLOCK_BYTES):
                ids, own = p.column(0).to_pylist(), p.column(1).to_pylist()
                if held is None:
                    first = own[0]
                else:
                    ids, own = [held[0], *ids], [held[1], *own]
                if len(own) > 1:
                    out = compared(ids[:-1], own[:-1], own[1:], size)
                    n = out.num_rows
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], schema=wide)
                held = (ids[-1], own[-1])
        if held is not None:
            yield pa.RecordBatch.from_pylist([blank | {"doc_id": held[0], "_task": task, "_first": first, "_last": held[1]}], schema=wide)

    wide = pa.schema([(n, t) for n, t in zip(NAMES, (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()))] + [("_task", pa.int32()), ("_first", pa.string()), ("_last", pa.string())])
    done = materialise(ranged.mapInArrow(run, f"{ROW}, _task int, _first string, _last string"), "weighted")
    seams = done.filter("_task IS NOT NULL")
    tasks = [r["_task"] for r in seams.select("_task").orderBy("_task").collect()]
    after = docs.sparkSession.createDataFrame([(a, z) for a, z in zip(tasks, tasks[1:] + tasks[:1])], "_task int, _next int")
    pairs = (seams.select("_task", "doc_id", "_last").join(after, "_task")
             .join(seams.select(F.col("_task").alias("_next"), F.col("_first").alias("_follow")), "_next").select("doc_id", "_last", "_follow"))

    def seam(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield compared([b.column(0)[i].as_py()], [b.column(1)[i].as_py()], [b.column(2)[i].as_py()], size)

    out = done.filter("_task IS NULL").select(*NAMES).unionByName(pairs.mapInArrow(seam, ROW))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
