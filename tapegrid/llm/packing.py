"""Best-fit packing of token pieces into sequences, in bulk-synchronous steps.

A document's ids end with the end id. Only documents longer than a sequence are cut, from their end backwards, so
the first piece is the short one. Full pieces are sequences of their own. The others are range-sorted by length over
the cluster and ranked inside their length. One superstep takes all pieces of one length, longest first:

* sweep: every piece's successor is the smallest open gap that holds it; gaps are kept sorted, as runs of equal gaps;
* conflicts: pieces that want the same run of gaps take its gaps in order of their rank, as many in one gap as fit;
* update: gaps taken move to their new run; pieces without a gap open new sequences, again by rank.

The steps run on the driver, over counts: a length has at most ``capacity`` values, so what it holds are counts by length and its decisions are
intervals of ranks, both bounded by the capacity and not by the data. Gaps are no table of the cluster. Decisions are shared with all tasks, and
each task places its own pieces.
The outcome is that of best-fit decreasing over all pieces.

Null or empty text: a piece of one end id. Repeated rows are packed each. Null ids pass through. Empty table: no rows.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.bpe import byte_letters
from tapegrid.llm.text import fresh, map_docs, texts
from tapegrid.plans.session import materialise

#: Fixed value: how byte-level tokenizers of this kind split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_state: dict = {}


def load(path: str) -> tiktoken.Encoding:
    """The file's vocabulary and special tokens in an encoder that takes ids as merge ranks, which holds if ids follow merges.

    It gives the ids of the tokenizers library (tests compare both) in a fraction of its time.
    """
    spec = json.loads(open(path, encoding="utf-8").read())
    vocab, letter = spec["model"]["vocab"], byte_letters()
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
    if any(b <= a for a, b in zip(made, made[1:])):
        raise ValueError("ids do not follow the merges")
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks={bytes(letter[c] for c in text): i for text, i in vocab.items()},
                             special_tokens={x["content"]: x["id"] for x in spec["added_tokens"]})


def encoder(path: str) -> tiktoken.Encoding:
    """One encoder in each Python worker, for all its tasks."""
    if path not in _state:
        _state.clear()
        _state[path] = load(path)
    return _state[path]


def ids(enc: tiktoken.Encoding, raw: bytes) -> bytes:
    """Little-endian 32-bit ids of a whole text; special tokens' strings become their ids."""
    return enc.encode_to_numpy(raw.decode(), allowed_special="all").astype("<u4").tobytes()


def cut(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces: doc_id, piece, start, length, ids_crc32, and the ids themselves on request."""
    end = int(end_id).to_bytes(4, "little")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        doc, piece, start, length, crc, parts = [], [], [], [], [], []
        for i, raw in enumerate(texts(b.column(1))):
            own = ids(enc, raw) + end
            n = len(own) // 4
            edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
            for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
                part = own[4 * lo: 4 * hi]
                doc.append(i)
                piece.append(k)
                start.append(lo)
                length.append(hi - lo)
                crc.append(zlib.crc32(part))
                if with_ids:
                    parts.append(np.frombuffer(part, "<u4").astype(np.int32))
        cols = [b.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        return pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_docs(inner, run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def supersteps(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Decisions for all lengths below the capacity, and the number of sequences opened.

    A decision (length, rank, sequence, together, offset): pieces of this length from this rank on go ``together`` at a time into
    consecutive sequences from ``sequence`` on, at ``offset``; it holds up to the length's next decision.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    decisions, opened = [], 0

    def take(length: int, rank: int, left: int, first: int, many: int, gap: int) -> int:
        """Up to ``left`` pieces into ``many`` sequences with this gap; returns how many went in."""
        fit = gap // length
        done = min(left, many * fit)
        full, rest = divmod(done, fit)
        for lo, hi, each in ((first, first + full, fit), (first + full, first + full + bool(rest), rest)):
            if hi > lo:
                decisions.append((length, rank + (fit * full if lo > first or not full else 0), lo, each, capacity - gap))
                if gap > each * length:
                    runs.setdefault(gap - each * length, []).append((lo, hi))
        if (used := full + bool(rest)) < many:
            runs.setdefault(gap, []).append((first + used, first + many))
        return done

    for length in range(capacity - 1, 0, -1):
        rank, left = 0, counts.get(length, 0)
        for gap in sorted(g for g in runs if g >= length):
            if not left:
                break
            waiting = runs.pop(gap)
            while waiting:
                lo, hi = waiting.pop()
                if not left:
                    runs.setdefault(gap, []).append((lo, hi))
                    continue
                done = take(length, rank, left, lo, hi - lo, gap)
                rank, left = rank + done, left - done
        if left:
            need = -(-left // (capacity // length))
            take(length, rank, left, opened, need, capacity)
            opened += need
    return decisions, opened


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (as ``cut`` makes them) with sequence_id and offset. They are kept in the shared folder first.

    Other columns are kept under any name; columns sequence_id and offset of the input are replaced.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    task_col, k_col = fresh(names, "_task", "_k")
    pieces = materialise(pieces.select(*[F.col(f"`{c}`") for c in names]), "pieces")
    schema = pieces.schema

    def number(batches):
        pid, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            size = b.column(names.index("length")).to_numpy(zero_copy_only=False)
            order = np.argsort(size, kind="stable")
            at = size[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            k = np.empty(len(at), np.int64)
            k[order] = place + seen[at]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), pid, np.int32)), pa.array(k)], names=[*names, task_col, k_col])

    short = pieces.filter(F.col("length") < capacity).repartitionByRange("length", F.xxhash64("doc_id", "piece"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    ranked = materialise(short.mapInArrow(number, f"{fields}, `{task_col}` int, `{k_col}` long"), "ranked")
    # a task holds a range of lengths: tasks + capacity rows at most
    sums = ranked.groupBy("length", task_col).agg(F.count(F.lit(1)).alias("n")).orderBy("length", task_col).collect()
    before: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for length, task, n in sums:
        before[task, length] = counts.get(length, 0)
        counts[length] = before[task, length] + n
    decisions, opened = supersteps(counts, capacity)
    table = np.array(sorted(decisions) or [(capacity, 0, 0, 1, 0)], np.int64)
    shared = spark.sparkContext.broadcast((before, table, table[:, 0] << 44 | table[:, 1]))

    def place(batches):
        before, table, keys = shared.value
        for b in batches:
            size, task, k = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", task_col, k_col))
            pair = task.astype(np.int64) * (capacity + 1) + size
            own, inverse = np.unique(pair, return_inverse=True)
            base = np.array([before[int(x) // (capacity + 1), int(x) % (capacity + 1)] for x in own], np.int64)
            rank = k + (base[inverse] if len(own) else 0)
            d = table[np.searchsorted(keys, size << 44 | rank, "right") - 1]
            nth = rank - d[:, 1]
            out = [d[:, 2] + nth // d[:, 3], d[:, 4] + nth % d[:, 3] * size]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *map(pa.array, out)], names=[*names, "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
    full = pieces.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(full)


def report(docs: DataFrame, path: str, capacity: int = 1024) -> DataFrame:
    return pack(cut(docs, path, capacity), capacity)
