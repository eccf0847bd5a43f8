"""Ranked lexical search over K2-treaps of the term-document grid.

1. Statistics: documents with a term (N) and all their terms (L), one pass.
2. Index: every slice of documents becomes a block, a grid of its terms (rows, in code-point order) and documents (columns, in id order). A cell
   holds the term's impact in the document, (1e9 * tf) div (1000 * tf + 8 * m). The grid is a compressed quadtree: of each node four bits
   tell which quadrants hold cells, and its maximum is kept as the difference to its parent's. Blocks are written to the shared
   folder, one row each; all terms of all documents are in it.
3. Frequencies (df) of the terms looked for: row counts of the blocks' term lists, summed.
4. Search: in each block a path starts for each term of an item at the root. Ranges of documents are taken best first by their bound, the sum of the
   terms' weights times the maxima of their paths' cells; a range is halved and all paths descend one quadrant together, until it is
   one document, whose bound is its score. Ranges that can't reach the item's tenth place so far (score, then id) are given up. Ranges of one
   depth are taken ``WIDE`` at a time, as arrays. A task keeps ten documents an item over all its blocks; the tasks' lists are merged by rank.

Null or empty texts have no terms, hence no score; null ids count, are ranked behind all others at equal scores and come out null. Rows of
one id are ranked each. Items with a null id take part; repeated items give their rows each. Items are searched ``ITEMS`` at a time, so
what the driver and the tasks hold of them does not grow with their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapegrid.llm.text import map_docs, pieces, words
from tapegrid.plans.session import materialise

TOP = 10
#: Items of one pass, bytes of texts in one block, ranges expanded together.
ITEMS, BLOCK, WIDE = 500, 4 << 20, 64
#: Bytes that part terms: ASCII other than letters and digits.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:128] = True
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LAST = np.iinfo(np.int64).max


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all terms."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = np.diff(words(b.column(1), outside=OUTSIDE, hashed=False).first)
        return pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["docs", "terms"])

    row = map_docs(docs, run, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2^32 moved to even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def compress(row: np.ndarray, col: np.ndarray, value: np.ndarray, height: int) -> tuple[bytes, bytes]:
    """Quadtree of distinct cells of a square grid of 2^height: child bits of all nodes, level by level, eight to a byte for each level, and
    differences of maxima to the parents' as 32-bit numbers, the root's own first."""
    code = (spread(row) << np.uint64(1)) | spread(col)
    order = np.argsort(code, kind="stable")
    code, top = code[order], value[order].astype(np.int64)
    levels, maxima = [], [top]
    for _ in range(height):
        quadrant = (code & np.uint64(3)).astype(np.int64)
        parent = code >> np.uint64(2)
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        node = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(code)]))
        bits = np.zeros(4 * len(first), np.uint8)
        bits[4 * node + quadrant] = 1
        above = np.maximum.reduceat(top, first)
        maxima[-1] = above[node] - top
        levels.append(np.packbits(bits))
        maxima.append(above)
        code, top = parent[first], above
    return b"".join(x.tobytes() for x in levels[::-1]), b"".join(x.astype("<i4").tobytes() for x in maxima[::-1])


class Grid:
    """A block's quadtree, unpacked: for each level the node of every quadrant (-1: empty), and every node's maximum."""

    def __init__(self, height: int, bits: bytes, maxima: bytes):
        raw, diff = np.frombuffer(bits, np.uint8), np.frombuffer(maxima, "<i4")
        self.height, self.child, self.top = height, [], [diff[:1]]
        nodes, at, seen = 1, 0, 1
        for _ in range(height):
            size = (4 * nodes + 7) // 8
            own = np.unpackbits(raw[at: at + size])[: 4 * nodes].astype(bool)
            child = np.where(own, np.cumsum(own, dtype=np.int32) - np.int32(1), np.int32(-1))
            count = int(own.sum())
            self.top.append(self.top[-1][np.flatnonzero(own) // 4] - diff[seen: seen + count])
            self.child.append(child)
            at, seen, nodes = at + size, seen + count, count


#: ``docs`` are ids (64 bits); ``terms`` their bytes; ``lengths`` and ``counts`` their bytes and documents (32 bits). ``sizes`` are lengths before compression.
PARTS = ("docs", "terms", "lengths", "counts", "bits", "maxima")
INDEX = "height int, sizes array<int>, " + ", ".join(f"{x} binary" for x in PARTS)


def _packed(raw: bytes) -> bytes:
    return pa.compress(raw, "zstd", asbytes=True)


def _unpacked(row: dict, name: str) -> bytes:
    return pa.decompress(row[name], row["sizes"][PARTS.index(name)], "zstd", asbytes=True) if row[name] else b""


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Index rows one by one: what is unpacked is one block at a time."""
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _block(ids: list, col: pa.Array, n_docs: int, n_terms: int) -> pa.RecordBatch | None:
    """Index row of some documents."""
    w = words(col, lower=True, outside=OUTSIDE, hashed=False)
    length = np.diff(w.first)
    if not len(w.starts):
        return None
    raw = w.buf.tobytes()
    number: dict[bytes, int] = {}
    term = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(w.starts.tolist(), w.ends.tolist())), np.int64, len(w.starts))
    names = sorted(number)  # UTF-8 sorts as code points do
    rank = np.empty(len(names), np.int64)
    rank[[number[x] for x in names]] = np.arange(len(names))
    key = np.array([LAST if i is None else i for i in ids], np.int64)
    held = np.flatnonzero(length > 0)
    held = held[np.argsort(key[held], kind="stable")]
    column = np.full(len(ids), -1)
    column[held] = np.arange(len(held))
    cell, tf = np.unique(rank[term] * len(held) + column[w.doc], return_counts=True)
    row, at = cell // len(held), cell % len(held)
    m = np.array([100 - 90 + (90 * n * n_docs) // n_terms for n in length[held].tolist()], np.int64)
    value = (1_000_000_000 * tf) // (1000 * tf + 8 * m[at])
    height = max(1, int(max(len(names), len(held)) - 1).bit_length())
    bits, maxima = compress(row, at, value, height)
    parts = [key[held].tobytes(), b"".join(names), np.array([len(x) for x in names], "<i4").tobytes(), np.bincount(row, minlength=len(names)).astype("<i4").tobytes(), bits, maxima]
    return pa.RecordBatch.from_arrays([pa.array([height], pa.int32()), pa.array([[len(x) for x in parts]], pa.list_(pa.int32())), *(pa.array([_packed(x)], pa.binary()) for x in parts)],
                                      names=["height", "sizes", *PARTS])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, int]:
    """Blocks of the index over all documents and terms, and N."""
    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_docs, n_terms = totals(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            nonlocal held, size
            whole = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            return _block(whole.column(0).to_pylist(), whole.column(1).combine_chunks() if whole.num_rows else pa.array([], pa.string()), n_docs, n_terms)

        for b in batches:
            for part in pieces(b, limit=block):
                own = part.column(1).nbytes
                if held and size + own > block and (out := flush()) is not None:
                    yield out
                held.append(part)
                size += own
        if held and (out := flush()) is not None:
            yield out

    return materialise(inner.mapInArrow(run, INDEX), "treap-index"), n_docs


def terms_of(text: str | None) -> list[bytes]:
    """Distinct terms of a text."""
    w = words(pa.array([text or ""], pa.string()), lower=True, outside=OUTSIDE, hashed=False)
    raw = w.buf.tobytes()
    return sorted({raw[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist())})


class Terms:
    """Sorted terms of a block, looked up by halving."""

    def __init__(self, row: dict):
        self.raw, self.edges = _unpacked(row, "terms"), np.r_[0, np.cumsum(np.frombuffer(_unpacked(row, "lengths"), "<i4"))].tolist()

    def row(self, term: bytes) -> int:
        lo, hi = 0, len(self.edges) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.raw[self.edges[mid]: self.edges[mid + 1]] < term:
                lo = mid + 1
            else:
                hi = mid
        return lo if lo < len(self.edges) - 1 and self.raw[self.edges[lo]: self.edges[lo + 1]] == term else -1


def frequencies(blocks: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """Documents that hold each of the terms."""

    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for row in _rows(b):
                own, n = Terms(row), np.frombuffer(_unpacked(row, "counts"), "<i4")
                for k, x in enumerate(wanted):
                    at = own.row(x)
                    if at >= 0:
                        total[k] += n[at]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    found = blocks.select("sizes", "terms", "lengths", "counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {wanted[r.term]: r.df for r in found.collect()}


def descend(grid: Grid, rows: np.ndarray, weights: np.ndarray, docs: np.ndarray, best: list[tuple[int, int]], top: int = TOP, wide: int = WIDE) -> None:
    """Adds the block's documents to ``best``, (-score, id) in order, as far as they belong to its first ``top``."""
    n, height = len(docs), grid.height

    def worth(bound, first):
        if len(best) < top:
            return bound > 0
        score, doc = -best[-1][0], best[-1][1]
        return (bound > score) | ((bound == score) & (docs[first] < doc) & (bound > 0))

    # waiting ranges, grouped by depth: bounds, first documents' numbers, and a node of each term's path
    waiting = [(np.array([int((weights * grid.top[0][0]).sum())], np.int64), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int32), 0)]
    while waiting:
        at = max(range(len(waiting)), key=lambda i: waiting[i][0][0])
        bound, first, path, depth = waiting.pop(at)
        live = worth(bound, first)
        bound, first, path = bound[live], first[live], path[live]
        if not len(bound):
            continue
        if len(bound) > wide:
            waiting.append((bound[wide:], first[wide:], path[wide:], depth))
            bound, first, path = bound[:wide], first[:wide], path[:wide]
        if depth == height:
            for score, k in zip(bound.tolist(), first.tolist()):
                if worth(score, k):
                    best.append((-score, int(docs[k])))
                    best.sort()
                    del best[top:]
            continue
        half = 1 << (height - 1 - depth)
        quadrant = 4 * path + 2 * ((rows >> (height - 1 - depth)) & 1)
        there = path >= 0
        below, starts = [], []
        for side in (0, 1):
            inside = first + side * half < n
            if inside.any():
                below.append(np.where(there[inside], grid.child[depth][np.where(there, quadrant + side, 0)[inside]], -1))
                starts.append(first[inside] + side * half)
        path, first = np.concatenate(below), np.concatenate(starts)
        bound = np.where(path >= 0, grid.top[depth + 1][path], 0).astype(np.int64) @ weights
        live = worth(bound, first)
        bound, first, path = bound[live], first[live], path[live]
        if len(bound):
            order = np.lexsort((first, -bound))
            waiting.append((bound[order], first[order], path[order], depth + 1))


FOUND = "item long, doc_id long, score long"


def _searched(items: list[tuple[list[bytes], list[int]]], top: int):
    def run(batches):
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        wanted = sorted({t for terms, _ in items for t in terms})
        for b in batches:
            for row in _rows(b):
                own, grid = Terms(row), Grid(row["height"], _unpacked(row, "bits"), _unpacked(row, "maxima"))
                place = {t: own.row(t) for t in wanted}
                ids = np.frombuffer(_unpacked(row, "docs"), np.int64)
                for (terms, weights), found in zip(items, best):
                    held = [(place[t], w) for t, w in zip(terms, weights) if w and place[t] >= 0]
                    if held:
                        descend(grid, np.array([r for r, _ in held], np.int64), np.array([w for _, w in held], np.int64), ids, found, top)
        rows = [(k, d, -s) for k, found in enumerate(best) for s, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*rows)], names=["item", "doc_id", "score"])

    return run


def search(blocks: DataFrame, n_docs: int, items: DataFrame, item_id: str = "item_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item with a score above 0, ties by id."""
    spark, parts = blocks.sparkSession, []
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    batch: list = []

    def flush():
        terms = [terms_of(r.text) for r in batch]
        df = frequencies(blocks, sorted({t for x in terms for t in x}))
        weights = [[math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in x] for x in terms]
        found = blocks.select("height", "sizes", "docs", "terms", "lengths", "bits", "maxima").mapInArrow(_searched(list(zip(terms, weights)), top), FOUND)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        ids = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(batch)], f"item long, {schema.split(',')[0]}")
        parts.append(materialise(ranked.join(ids, "item").select("item_id", "rank", F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "score"), "treap-found"))

    for row in asked.toLocalIterator():
        batch.append(row)
        if len(batch) == ITEMS:
            flush()
            batch = []
    if batch:
        flush()
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    blocks, n_docs = index(docs)
    return search(blocks, n_docs, items)


ORACLE = r"""
WITH split AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sizes AS (SELECT k, doc_id, len(terms)::BIGINT AS n FROM split WHERE len(terms) > 0),
stats AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
cells AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(terms) AS term FROM split) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
freq AS (SELECT term, floor(1000 * ln((2 * (SELECT nd FROM stats) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM cells GROUP BY term),
scored AS (
  SELECT item_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // nt)))))::BIGINT AS score
  FROM asked JOIN cells USING (term) JOIN freq USING (term) JOIN sizes USING (k), stats GROUP BY item_id, k),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored JOIN sizes USING (k) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
