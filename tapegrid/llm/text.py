"""Whole Arrow batches of texts as byte arrays, and words in them without a Python loop per word.

Words are runs of bytes outside ``\\x20 \\x09-\\x0D`` (or of a given byte class), so multi-byte characters
stay whole. Nothing is cut: a text longer than a block is read block by block, split between words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task.
BLOCK = 1 << 20
#: Odd 64-bit multipliers of the rolling hash and of its finish.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about ``limit`` bytes (one row at least)."""
    if not batch.num_rows:
        return
    sizes = np.zeros(batch.num_rows + 1, np.int64)
    col = batch.column(batch.schema.get_field_index(column))
    np.cumsum(col.is_valid().to_numpy(zero_copy_only=False) * np.diff(offsets(col)), out=sizes[1:])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_docs(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, column: str = "text") -> DataFrame:
    """``fn`` over slices of bounded size."""

    def run(batches):
        for b in batches:
            for p in pieces(b, column):
                out = fn(p)
                if out is not None and out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def drawn(df: DataFrame, key: str, k: int, n: int) -> DataFrame:
    """At most ``k`` of ``n`` rows, those whose keys' hashes sort first; a filter on the hash leaves about 2 k rows
    beforehand, so that the tasks together send a bounded number and not k each."""
    h = F.xxhash64(key)
    if n > 4 * k:
        df = df.filter(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 2 * k / n))
    return df.orderBy(h, key).limit(k)


def one_label(labels: DataFrame, id_col: str, label_col: str, name: str) -> DataFrame:
    """(_id, name): the smallest label of each id; ids or labels that are null are left out."""
    return (labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias(name)).filter(F.col(name).isNotNull() & F.col("_id").isNotNull())
            .groupBy("_id").agg(F.min(name).alias(name)))


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of the columns has."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def offsets(col: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)
    return raw[col.offset: col.offset + len(col) + 1].astype(np.int64)


def data(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts together and the edges between them; nulls are empty."""
    if col.null_count:
        col = pa.array(["" if x is None else x for x in col.to_pylist()], col.type)
    edges = offsets(col)
    raw = col.buffers()[2]
    whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return whole[edges[0]: edges[-1]] if len(edges) else whole, edges - (edges[0] if len(edges) else 0)


def texts(col: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; null: empty."""
    buf, edges = data(col)
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


@dataclass
class Words:
    """Words of a batch: byte edges in ``buf``, text index of each, and edges of each text's words."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None = None

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each word by text."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n + 1:
        inverse = pow(int(STEP), -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n + 1, x, np.uint64)], dtype=np.uint64) for x in (STEP, np.uint64(inverse)))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
        return x ^ (x >> np.uint64(31))


def _spans(buf: np.ndarray, inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    at = edges[(edges > 0) & (edges < len(buf))]
    begins[at] = inside[at]
    stops[at - 1] = inside[at - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def words(col: pa.Array, lower: bool = False, outside: np.ndarray = SPACE, hashed: bool = True) -> Words:
    """Words of every text of an Arrow string column; ``outside`` marks the bytes between words."""
    buf, edges = data(col)
    if lower:
        buf = LOWER[buf]
    inside = ~outside[buf] if len(buf) else np.zeros(0, bool)
    starts, ends = _spans(buf, inside, edges) if len(buf) else (np.zeros(0, np.int64),) * 2
    doc = np.searchsorted(edges, starts, "right") - 1
    first = np.searchsorted(starts, edges)
    out = Words(buf, starts, ends, doc, first)
    if hashed:
        out.hash = hashes(buf, starts, ends)
    return out


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (spans in order, not overlapping), from running sums over blocks."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            base = int(starts[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
            n = int(ends[hi - 1]) - base
            up, down = powers(n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((buf[base: base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
            a, b = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
            lo = hi
    return out


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word window starting at each word, and whether the window stays inside its text."""
    n = len(w.hash)
    out, ok = np.zeros(n, np.uint64), np.zeros(n, bool)
    if n >= k:
        with np.errstate(over="ignore"):
            acc = w.hash[: n - k + 1].copy()
            for j in range(1, k):
                acc = acc * STEP + w.hash[j: n - k + 1 + j]
        out[: n - k + 1] = mix(acc)
        ok[: n - k + 1] = w.doc[: n - k + 1] == w.doc[k - 1:]
    return out, ok


def char_index(raw: bytes, at: list[int]) -> list[int]:
    """Code point offsets of increasing byte offsets."""
    out, n, last = [], 0, 0
    for x in at:
        n += len(raw[last:x].decode("utf-8", "surrogatepass"))
        last = x
        out.append(n)
    return out
