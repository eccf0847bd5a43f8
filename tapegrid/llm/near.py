"""Near copies by the Jaccard similarity of five-word shingle sets.

1. Sketch: 48 minima of each text's shingles, 16 bands of three. A pair at 0.8 shares no band with a chance of 1 in 100,000.
   Texts of one multiset of shingles are one entry.
2. Every entry of a band's bucket is paired with the smallest. Pairs whose sketches agree in fewer than 26 of 48 places (a pair at
   0.8 has fewer with under 1 in 10,000) are dropped; the others are verified by their shingle sets, and components joined.
3. Buckets that still hold several components are filed again under longer keys: two bands, then three (a pair at 0.8 shares fewer with
   2 in 10,000 and 2 in 1,000). Again every entry is paired with the smallest only. So rows are a fixed multiple of the entries (16, at
   most 120, at most 560 keys), however large a bucket is. No bucket is cut or sampled.

Sets are built from 16-bit word codes, as alignments are. Words are lower-cased (A-Z). Texts under five words match whole.
Null ids, null and empty texts stay. Rows of one id stay or go together; where their texts differ, the last by its codes is compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.components import components
from tapegrid.llm.substring import SHINGLE, SIMILAR, _code_shingles, codes, complete
from tapegrid.llm.text import STEP, fresh, map_docs, mix, shingles, words
from tapegrid.plans.session import materialise

HASHES, ROWS, AGREE, DEPTH = 48, 3, 26, 3
#: Odd multipliers, one a minimum.
FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * STEP) | np.uint64(1)


def sketches(inner: DataFrame) -> DataFrame:
    """(doc, whole, sketch, bands) of each text that has words; ``whole`` is the same for equal multisets of shingles."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        w = words(b.column(1), lower=True)
        h, ok = shingles(w, SHINGLE)
        count = np.diff(w.first)
        with np.errstate(over="ignore"):
            for i in np.flatnonzero((count > 0) & (count < SHINGLE)).tolist():
                own = slice(w.first[i], w.first[i + 1])
                ok[w.first[i]] = True
                h[w.first[i]] = mix(np.array([(w.hash[own] * FACTORS[: count[i]]).sum(dtype=np.uint64)]))[0]
            at = np.flatnonzero(ok)
            h, doc = h[at], w.doc[at]
            begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(at) else at
            if not len(at):
                return None
            n = np.diff(np.r_[begin, len(at)]).astype(np.uint64)
            whole = mix(np.add.reduceat(mix(h), begin) + n * STEP)
            low = np.stack([np.minimum.reduceat(h * f, begin) for f in FACTORS], axis=1)
            marks = (mix(low) & np.uint64(255)).astype(np.uint8)
            bands = np.zeros((len(begin), HASHES // ROWS), np.uint64)
            for k in range(ROWS):
                bands = mix(bands * STEP + low[:, k::ROWS])
            bands = mix(bands + np.arange(HASHES // ROWS, dtype=np.uint64) * STEP).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[begin])), pa.array(whole.view(np.int64)), pa.array([x.tobytes() for x in marks], pa.binary()),
                                           pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32)), pa.array(bands.reshape(-1)))],
                                          names=["doc", "whole", "sketch", "bands"])

    return map_docs(inner, run, "doc long, whole long, sketch binary, bands array<long>")


def _verified(similar: float):
    def run(batches):
        for a, b, side, raw in complete(batches, 2):
            edges = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]), True])
            found = []
            for x, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                both = {int(side[i]): i for i in range(x, z)}
                if len(both) < 2:
                    continue
                u, v = (np.unique(_code_shingles(np.frombuffer(raw[both[k]], "<u2"))) for k in (0, 1))
                shared = len(np.intersect1d(u, v, assume_unique=True))
                if shared and shared >= similar * (len(u) + len(v) - shared) - 1e-9:
                    found.append(x)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[found])], names=["a", "b"])

    return run


def verified(inner: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    wanted = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("doc")).unionByName(pairs.select("a", "b", F.lit(1).alias("side"), F.col("b").alias("doc")))
    own = inner.join(wanted.select(F.col("doc").alias("_doc")).distinct(), F.col("doc_id") == F.col("_doc"), "left_semi")
    parts = wanted.join(codes(own), "doc").select("a", "b", "side", "codes")
    return parts.repartition("a", "b").sortWithinPartitions("a", "b", "side", "codes").mapInArrow(_verified(similar), "a long, b long")


def _agreeing(batches):
    """Pairs whose sketches agree in ``AGREE`` places or more; columns a, b and their sketches."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= AGREE))


def groups(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, root) of every row with an id and words: root is the smallest id of its group."""
    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    rows = materialise(sketches(inner), "near")
    reps = materialise(rows.groupBy("whole").agg(F.min("doc").alias("rep"), F.min_by(F.struct("sketch", "bands"), "doc").alias("s")).select("whole", "rep", "s.*"), "near-distinct")
    sketch = reps.groupBy("rep").agg(F.min("sketch").alias("sketch"))  # an id whose rows differ has several
    filed = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    links = tried = roots = None
    for depth in range(DEPTH):
        leads = filed.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("_top")).filter("_top > lead").drop("_top")
        filed = materialise(filed.join(leads, "key"), "near-buckets")
        pairs = filed.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        both = (pairs.join(sketch.select(F.col("rep").alias("a"), F.col("sketch").alias("_x")), "a")
                .join(sketch.select(F.col("rep").alias("b"), F.col("sketch").alias("_y")), "b").select("a", "b", "_x", "_y"))
        close = materialise(both.mapInArrow(_agreeing, "a long, b long"), "near-close")
        found = materialise(verified(inner, close, similar), "near-links")
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        if depth + 1 == DEPTH:
            break
        rooted = filed.join(roots, filed.rep == roots.node, "left").select("key", "rep", "band", F.coalesce("root", "rep").alias("root"))
        rooted = materialise(rooted, "near-rooted")
        mixed = rooted.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_top"), F.count(F.lit(1)).alias("_n")).filter("_top > _low AND _n > 2").select("key")
        deeper = rooted.join(mixed, "key").join(reps.select("rep", F.posexplode("bands").alias("_next", "_band")), "rep").filter("_next > band")
        filed = materialise(deeper.select("rep", F.col("_next").alias("band"), F.xxhash64("key", "_next", "_band").alias("key")), "near-filed")
        if filed.isEmpty():
            break
    tops = reps.join(roots, reps.rep == roots.node, "left").select("whole", F.coalesce("root", "rep").alias("root"))
    return rows.select("doc", "whole").join(tops, "whole").select("doc", "root")


def keep_first(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose group holds a smaller id."""
    gone, = fresh(docs.columns, "_gone")
    found = materialise(groups(docs, similar, id_col, text_col).filter("doc <> root").select(F.col("doc").alias(gone)).distinct(), "near-gone")
    return docs.join(found, F.col(id_col).cast("long") == F.col(gone), "left_anti")
