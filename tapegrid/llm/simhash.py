"""SimHash near-duplicates by pivot distance tables.

Fingerprints have 64 bits, one vote of each shingle's hash a bit; two link at ``reach`` = 2 or fewer differing bits. Distances to
reference fingerprints (pivots) are computed once for each distinct fingerprint:

* block pivots: the zero fingerprint and one whose ones fill one of 16 four-bit blocks. Their distances give the number of ones in
  each block, a cell. Linked fingerprints differ by two at most in the sum of these coordinates, so a cell one step
  from both (or their own) exists: each fingerprint is filed under its own cell and those one step away, 33 at most.
* scattered pivots: pairs under one cell whose distances to any of them differ by more than two cannot link
  and are discarded; survivors are verified by their differing bits.

A cell may hold very many fingerprints (near copies of one text). Cells above ``room`` are not compared pairwise:
their entries are filed again under whole fingerprints one bit away, of which one is shared by any linked pair. There
all entries are linked with each other, at most 65 of them, so the smallest stands for the rest. No link is lost, and
rows stay a fixed multiple of the distinct fingerprints.

Null or empty texts have the fingerprint zero and link like any other. Null ids take part; a component of null ids
alone has a null id. Repeated rows get their component each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapegrid.llm.components import components, local_roots
from tapegrid.llm.text import fresh, map_docs, texts
from tapegrid.plans.session import materialise

REACH = 2
BLOCKS = 16
ONE = np.uint64(1)
BITS = ONE << np.arange(64, dtype=np.uint64)
#: Block pivots beside the zero fingerprint, and pivots scattered by a fixed rule.
MASKS = np.uint64(0xF) << (np.arange(BLOCKS, dtype=np.uint64) * np.uint64(4))
SCATTERED = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 7) for i in range(24)], np.uint64)


def fingerprint_batch(raws: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Votes of all shingles of each whole text (A-Z lower-cased; repeats included)."""
    hashes: list[int] = []
    counts = np.zeros(len(raws), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, raw in enumerate(raws):
        own = raw.lower().split()
        n = len(own)
        if not n:
            continue
        if n <= shingle:
            hashes.append(digest(b" ".join(own), seed))
            counts[i] = 1
            continue
        for parts in zip(*(own[k:] for k in range(shingle))):
            hashes.append(digest(b" ".join(parts), seed))
        counts[i] = n - shingle + 1
    out = np.zeros(len(raws), np.uint64)
    h = np.array(hashes, np.uint64)
    edges = np.r_[0, np.cumsum(counts)]
    some = np.flatnonzero(counts)
    lo = 0
    while lo < len(some):  # texts in groups, so that the unpacked bits stay small; long ones in parts
        hi = lo + 1
        while hi < len(some) and edges[some[hi] + 1] - edges[some[lo]] <= 1 << 17:
            hi += 1
        a, z = edges[some[lo]], edges[some[hi - 1] + 1]
        if hi - lo == 1:
            votes = sum(np.unpackbits(h[x: min(z, x + (1 << 17))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for x in range(a, z, 1 << 17))[None]
        else:
            bits = np.unpackbits(h[a:z].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes = np.add.reduceat(bits, edges[some[lo:hi]] - a, axis=0, dtype=np.int32)
        out[some[lo:hi]] = ((2 * votes > counts[some[lo:hi], None]) * BITS).sum(1, dtype=np.uint64)
        lo = hi
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprint_batch(texts(b.column(1)), shingle).view(np.int64))], names=["doc_id", "fp"])

    return map_docs(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def distances(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Pivot table: Hamming distance of each fingerprint to each pivot."""
    return np.bitwise_count(fp[:, None] ^ pivots[None, :])


def cells(fp: np.ndarray) -> np.ndarray:
    """Cell of each fingerprint: ones in each block, four bits a block, from the distances to the block pivots."""
    zero = np.bitwise_count(fp).astype(np.int64)[:, None]
    ones = (4 + zero - distances(fp, MASKS)) // 2
    return (ones.astype(np.uint64) << (np.arange(BLOCKS, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64)


def _filed(batches):
    """Each fingerprint under its cell and all cells one step away."""
    for b in batches:
        for lo in range(0, b.num_rows, 1 << 14):
            fp = b.column(0).to_numpy(zero_copy_only=False)[lo: lo + (1 << 14)].view(np.uint64)
            own = cells(fp)
            step = ONE << (np.arange(BLOCKS, dtype=np.uint64) * np.uint64(4))
            level = (own[:, None] // step) & np.uint64(0xF)
            keys = np.concatenate([own[:, None], own[:, None] + step, own[:, None] - step], axis=1)
            ok = np.concatenate([np.ones((len(fp), 1), bool), level < 4, level > 0], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys[ok].view(np.int64)), pa.array(np.repeat(fp, ok.sum(1)).view(np.int64))], names=["cell", "fp"])


def compare(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs inside cells (rows sorted by cell): discarded by pivot distances, then verified."""
    table = distances(fp, SCATTERED).astype(np.int8)
    at, found = np.arange(len(cell)), []
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(cell)]
        at = at[cell[at] == cell[at + step]]
        for lo in range(0, len(at), 1 << 15):
            i = at[lo: lo + (1 << 15)]
            i = i[np.abs(table[i] - table[i + step]).max(1, initial=0) <= REACH]
            found.append(i[np.bitwise_count(fp[i] ^ fp[i + step]) <= REACH])
            found.append(found[-1] + step)
    return (np.concatenate(found[::2]), np.concatenate(found[1::2])) if found else (np.zeros(0, np.int64),) * 2


def _compared(room: int):
    def run(batches):
        """Rows of a task, sorted by cell: links of complete cells (pending false), entries of crowded ones (pending true)."""
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        crowded = None

        def links(c, f):
            i, j = compare(c, f)
            x, y = local_roots(f[i].view(np.int64), f[j].view(np.int64)) if len(i) else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.zeros(len(x), bool))], names=["a", "b", "pending"])

        def pending(c, f):
            return pa.RecordBatch.from_arrays([pa.array(c), pa.array(f.view(np.int64)), pa.array(np.ones(len(c), bool))], names=["a", "b", "pending"])

        for b in batches:
            cell = np.r_[cell, b.column(0).to_numpy(zero_copy_only=False)]
            fp = np.r_[fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            last = np.searchsorted(cell, cell[-1]) if len(cell) else 0
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
            size = np.repeat(np.diff(np.r_[starts, len(cell)]), np.diff(np.r_[starts, len(cell)]))
            full = (size > room) | (cell == crowded if crowded is not None else False)
            if len(cell):
                # the last cell may go on in the next batch: kept back unless it is known to be crowded
                crowded = cell[-1] if full[-1] else None
            done = np.arange(len(cell)) < last
            fine = done & ~full
            if fine.any():
                yield links(cell[fine], fp[fine])
            if full.any():
                yield pending(cell[full], fp[full])
            left = ~done & ~full
            cell, fp = cell[left], fp[left]
        if len(cell):
            yield links(cell, fp)

    return run


def _whole(batches):
    """Entries of crowded cells under each fingerprint at most one bit away that lies in the same cell."""
    for b in batches:
        for lo in range(0, b.num_rows, 1 << 13):
            c = b.column(0).to_numpy(zero_copy_only=False)[lo: lo + (1 << 13)].view(np.uint64)
            fp = b.column(1).to_numpy(zero_copy_only=False)[lo: lo + (1 << 13)].view(np.uint64)
            near = np.concatenate([fp[:, None], fp[:, None] ^ BITS], axis=1)
            same = cells(near.reshape(-1)).reshape(near.shape) == c[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(near[same].view(np.int64)), pa.array(np.repeat(fp, same.sum(1)).view(np.int64))], names=["z", "fp"])


def links(distinct: DataFrame, room: int = 48) -> DataFrame:
    """Links (a, b) that join all fingerprints of ``distinct`` (column fp) within reach, directly or through others."""
    filed = distinct.select("fp").mapInArrow(_filed, "cell long, fp long")
    seen = materialise(filed.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_compared(room), "a long, b long, pending boolean"), "simhash-links")
    again = seen.filter("pending").select("a", "b").mapInArrow(_whole, "z long, fp long")
    least = again.withColumn("m", F.min("fp").over(Window.partitionBy("z"))).filter("fp <> m")
    return seen.filter("NOT pending").select("a", "b").unionByName(least.select(F.col("fp").alias("a"), F.col("m").alias("b")))


def groups(docs: DataFrame, shingle: int = 3, room: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's doc_id, fp and component_id, the smallest id of its component."""
    rows = materialise(fingerprints(docs, shingle, id_col, text_col), "simhash")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct, room))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(ids, "root").select("fp", "component_id"), "fp")


def report(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of its smallest id. Of rows with equal ids one stays, whichever comes first
    by the hash of its columns; rows without an id stay, each on its own. Texts are shuffled once, by id."""
    names = docs.columns
    kept, nth = fresh(names, "_kept", "_nth")
    found = groups(docs.filter(F.col(id_col).isNotNull()), shingle, id_col=id_col, text_col=text_col)
    firsts = found.select(F.col("component_id").alias(kept)).distinct()
    stay = docs.join(firsts, F.col(id_col).cast("long") == F.col(kept), "left_semi")
    once = stay.withColumn(nth, F.row_number().over(Window.partitionBy(F.col(id_col).cast("long")).orderBy(F.xxhash64(*names)))).filter(F.col(nth) == 1)
    return once.select(*names).unionByName(docs.filter(F.col(id_col).isNull()))
