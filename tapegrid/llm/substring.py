"""Substring dedup by collinear chaining.

1. Seeds: of every 8 consecutive five-word shingles of a text the one with the smallest hash (so any run of 12
   equal words shares a seed). Their occurrences are joined with the seed's first document, the anchor: a passage
   that n documents hold gives n - 1 matches a seed, not pairs of all. Parts of a passage may have different first documents,
   so runs of 2, 4 and 8 consecutive shared seeds, and pairs 2 to 5 places apart (an edit changes the seeds between), are
   joined with the first document that holds the whole key as well. Keys whose seeds lie in one anchor at like distances are
   left out: that document holds the whole key already.
2. Chains: the ordered matches of a document with one anchor are chained by a Fenwick tree over anchor positions,
   weight less a cost for each word of a gap.
3. Alignment: the windows of each chain are fetched as word codes, their shared shingles joined into exact runs, chained
   again, and the gaps between runs aligned word by word. The longest stretches in which 0.8 or more of the five-word shingles
   are shared, of at least ``least`` = 50 words, are passages.

Words are lower-cased (A-Z). Seeds and codes are hashes (64 and 16 bits). Every row's whole text takes part. Rows
with a null id, null or empty texts have no passages. Rows of one id count as one document: a passage is
never a repeat of its own id. Repeats inside a text are not looked for.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.text import STEP, fresh, map_docs, mix, shingles, words
from tapegrid.plans.session import materialise

SHINGLE = 5
WINDOW = 8
#: Numbers of consecutive shared seeds that are joined as one key; the longest spans about 36 words.
CONTEXTS = (2, 4, 8)
#: Distances, in shared seeds, of pairs that are joined as one key whatever lies between.
APART = (2, 3, 4, 5)
LEAST = 50
SIMILAR = 0.8
#: Words fetched beyond both ends of a chain; longer than the stretch that can lie between seeds.
MARGIN = 64
LAST = np.uint64(2 ** 64 - 1)


def minimizers(h: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions whose value is the smallest of some ``window`` consecutive ones of their document; of a
    run of equal neighbours every ``window``-th."""
    if not len(h):
        return np.zeros(0, np.int64)
    shift = np.r_[0, np.cumsum((doc[1:] != doc[:-1]) * (window - 1))] + window - 1
    at = np.arange(len(h)) + shift  # documents are kept apart by largest values
    x = np.full(at[-1] + window, LAST, np.uint64)
    x[at] = h
    low = _sliding(x, window, np.minimum)
    high = _sliding(low, window, np.maximum)
    # high[i] covers windows that end at i + window - 1 of x: those that hold x[i + window - 1]
    chosen = high[at - window + 1] == h
    place = np.arange(len(h))
    begin = np.maximum.accumulate(np.where(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])], place, 0))
    return np.flatnonzero(chosen & ((place - begin) % window == 0))


def _sliding(x: np.ndarray, window: int, pick) -> np.ndarray:
    """pick over x[i : i + window], by doubling."""
    out, width = x, 1
    while width < window:
        step = min(width, window - width)
        out = pick(out[: len(out) - step], out[step:])
        width += step
    return out


def seeds(inner: DataFrame, window: int = WINDOW) -> DataFrame:
    """(hash, doc, pos, first, plain). A seed that a text holds again counts its occurrences: the hash of the n-th holds n, so texts
    that repeat themselves match place by place. It is given once more under its plain hash, where ``first``
    is its first position, the one that others match. ``plain`` is false for counted hashes."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        w = words(b.column(1), lower=True)
        h, ok = shingles(w, SHINGLE)
        at = np.flatnonzero(ok)
        keep = at[minimizers(h[at], w.doc[at], window)]
        keep = keep[np.lexsort((keep, h[keep], w.doc[keep]))]
        doc, own = w.doc[keep], h[keep]
        pos = keep - w.first[doc]
        place = np.arange(len(keep))
        begin = np.maximum.accumulate(np.where(np.r_[True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])][: len(keep)], place, 0)) if len(keep) else place
        nth = place - begin
        again = np.flatnonzero(nth)
        with np.errstate(over="ignore"):
            counted = np.where(nth > 0, mix(own + nth.astype(np.uint64) * STEP), own)
        out = np.r_[counted, own[again]].view(np.int64), np.r_[doc, doc[again]], np.r_[pos, pos[again]], np.r_[pos, pos[begin[again]]], np.r_[nth == 0, np.ones(len(again), bool)]
        return pa.RecordBatch.from_arrays([pa.array(out[0]), b.column(0).take(pa.array(out[1])), pa.array(out[2].astype(np.int32)), pa.array(out[3].astype(np.int32)), pa.array(out[4])], names=["hash", "doc", "pos", "first", "plain"])

    return map_docs(inner, run, "hash long, doc long, pos int, first int, plain boolean")


def _contexts(batches):
    """Keys of runs and pairs of shared seeds (rows sorted by doc, pos): hash, doc, pos and the words to the last seed."""
    for doc, pos, own, anchor, apos in complete(batches, 1):
        h = own.view(np.uint64)
        # steps after which the anchor changes or its positions part from the text's
        parts = np.r_[0, np.cumsum((anchor[1:] != anchor[:-1]) | (np.abs(np.diff(apos) - np.diff(pos)) > 2 * WINDOW))]
        for places in [range(k) for k in CONTEXTS] + [(0, k) for k in APART]:
            k = places[-1] + 1
            n = len(h) - k + 1
            if n <= 0:
                continue
            with np.errstate(over="ignore"):
                acc = np.full(n, len(places), np.uint64)
                for j in places:
                    acc = acc * STEP + h[j: j + n]
            wide = pos[k - 1:] - pos[:n]
            # seeds of one passage are never further apart than twice the window; equal positions are rows of one id
            ok = (doc[:n] == doc[k - 1:]) & (wide <= 2 * WINDOW * (k - 1)) & (wide > 0) & (parts[:n] != parts[k - 1:])
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(mix(acc)[ok].view(np.int64)), pa.array(doc[:n][ok]), pa.array(pos[:n][ok]), pa.array(wide[ok])], names=["hash", "doc", "pos", "wide"])


def complete(batches, keys: int):
    """Sorted rows as arrays, in pieces that never part rows with equal first ``keys`` columns."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for c in cols[:keys]:
            change[1:] |= c[1:] != c[:-1]
        whole = not held or any(h[-1] != c[0] for h, c in zip(held[-1][:keys], cols[:keys]))
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if whole and held:
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        if last:
            yield [np.concatenate(x) for x in zip(*held, [c[:last] for c in cols])]
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def chains(p0, a0, p1, a1, weight, gap: float) -> list[list[int]]:
    """Ordered chains of blocks [p0, p1) x [a0, a1): the best score ending at each is its weight plus the best earlier one
    that ends before it on both sides, less ``gap`` for each word between. Best chains first; no block twice.

    A Fenwick tree over the ranks of a1 keeps the largest score + gap * (p1 + a1) of the blocks passed so far.
    """
    n = len(p0)
    ranks = sorted(set(a1))
    best, back = [-1e18] * (len(ranks) + 1), [-1] * (len(ranks) + 1)
    score, prior = [0.0] * n, [-1] * n
    by_end = sorted(range(n), key=lambda i: p1[i])
    done = 0
    for j in sorted(range(n), key=lambda i: (p0[i], a0[i])):
        while done < n and p1[by_end[done]] <= p0[j]:
            i = by_end[done]
            done += 1
            value = score[i] + gap * (p1[i] + a1[i])
            r = bisect.bisect_left(ranks, a1[i]) + 1
            while r <= len(ranks):
                if value > best[r]:
                    best[r], back[r] = value, i
                r += r & -r
        r, top, at = bisect.bisect_right(ranks, a0[j]), 0.0, -1
        while r:
            if (value := best[r] - gap * (p0[j] + a0[j])) > top:
                top, at = value, back[r]
            r -= r & -r
        score[j], prior[j] = weight[j] + top, at
    out, used = [], [False] * n
    for j in sorted(range(n), key=lambda i: (-score[i], p0[i])):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = prior[j]
        if chain:
            out.append(chain[::-1])
    return out


CHAIN = "id long, doc long, anchor long, d0 int, d1 int, a0 int, a1 int"


def _chained(least: int, window: int):
    #: Less than the seeds of a passage of ``least`` words with an edit span; four windows are the longest plain jump.
    span = max(1, min(least // 4, least - 2 * (window - 1) - SHINGLE))

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for doc, anchor, pos, apos, wide in complete(batches, 2):
            # of matches at one place the widest, which comes last
            last = np.r_[(doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (pos[1:] != pos[:-1]) | (apos[1:] != apos[:-1]), True]
            doc, anchor, pos, apos, wide = (x[last] for x in (doc, anchor, pos, apos, wide))
            edges = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]), True])
            rows = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if hi - lo < 2 and not wide[lo]:
                    continue
                p, a, far = pos[lo:hi], apos[lo:hi], wide[lo:hi].tolist()
                if hi - lo == 1 or (np.diff(p) > 0).all() and (np.diff(a) > 0).all() and max(np.diff(p).max(), np.diff(a).max()) <= 4 * window:
                    found = [range(hi - lo)]  # one chain already
                    p, a = p.tolist(), a.tolist()
                else:
                    p, a = p.tolist(), a.tolist()
                    found = chains(p, a, [x + 1 for x in p], [x + 1 for x in a], [SHINGLE] * len(p), 0.05)
                for c in found:
                    more = max(p[i] + far[i] for i in c) - p[c[-1]]
                    if p[c[-1]] + more - p[c[0]] >= span:
                        rows.append((doc[lo], anchor[lo], p[c[0]], p[c[-1]] + more + SHINGLE, a[c[0]], a[c[-1]] + more + SHINGLE))
            if rows:
                cols = list(zip(*rows))
                ids = (np.int64(task) << 36) + made + np.arange(len(rows))
                made += len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.array(c, np.int64)) for c in cols[:2]), *(pa.array(np.array(c, np.int32)) for c in cols[2:])], names=[x.split()[0] for x in CHAIN.split(", ")])

    return run


def codes(inner: DataFrame) -> DataFrame:
    """(doc, codes): 16 bits of each word's hash, as bytes."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        w = words(b.column(1), lower=True)
        raw = (w.hash >> np.uint64(48)).astype("<u2").tobytes()
        at = (2 * w.first).tolist()
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:])], pa.binary())], names=["doc", "codes"])

    return map_docs(inner, run, "doc long, codes binary")


def _code_shingles(c: np.ndarray) -> np.ndarray:
    n = len(c) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = mix(c[:n].astype(np.uint64) + np.uint64(1))
        for j in range(1, SHINGLE):
            acc = acc * STEP + c[j: j + n].astype(np.uint64) + np.uint64(1)
    return mix(acc)


def runs(d: np.ndarray, a: np.ndarray, diagonal: int) -> list[tuple[int, int, int]]:
    """Exact runs (start in d, start in a, words) of shared shingles; of several places in a, the nearest to the diagonal."""
    hd, ha = _code_shingles(d), _code_shingles(a)
    if not len(hd) or not len(ha):
        return []
    order = np.argsort(ha, kind="stable")
    own = ha[order]
    lo, hi = np.searchsorted(own, hd, "left"), np.searchsorted(own, hd, "right")
    p = np.flatnonzero(hi > lo)
    q = order[lo[p]]
    for i in np.flatnonzero(hi[p] - lo[p] > 1):
        places = order[lo[p[i]]: hi[p[i]]]
        q[i] = places[np.argmin(np.abs(places - p[i] - diagonal))]
    if not len(p):
        return []
    begin = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(q) != 1)])
    size = np.diff(np.r_[begin, len(p)]) + SHINGLE - 1
    return list(zip(p[begin].tolist(), q[begin].tolist(), size.tolist()))


def common(x: list[int], y: list[int]) -> int:
    """Words that an alignment of two gaps keeps (longest common subsequence, one bit a word of ``x``)."""
    if not x or not y:
        return 0
    places: dict[int, int] = {}
    for i, v in enumerate(x):
        places[v] = places.get(v, 0) | 1 << i
    whole = (1 << len(x)) - 1
    row = whole
    for v in y:
        hit = row & places.get(v, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(x) - row.bit_count()


def longest(first: list[int], last: list[int], gain: list[float], loss: list[float], least: int) -> list[tuple[int, int]]:
    """Pieces (from, to) of a chain of runs [first, last): the longest whose gains less the losses between its runs are not negative, then the
    longest of what is left on either side, as long as they span ``least``. ``loss`` of a run is that of the gap before it."""
    out, rest = [], [(0, len(first))]
    while rest:
        lo, hi = rest.pop()
        if hi <= lo or last[hi - 1] - first[lo] < least:
            continue
        before, after, total = [], [], 0.0  # sums up to the start of a run and to its end
        for k in range(lo, hi):
            total -= loss[k] if k > lo else 0
            before.append(total)
            total += gain[k]
            after.append(total)
        starts = []  # runs whose sum before them is smaller than of all earlier ones
        for k, x in enumerate(before):
            if not starts or x < before[starts[-1]]:
                starts.append(k)
        best, size = None, least - 1
        for k in range(hi - lo - 1, -1, -1):
            while starts and before[starts[-1]] <= after[k] + 1e-9:
                i = starts.pop()
                if i <= k and last[lo + k] - first[lo + i] > size:
                    best, size = (lo + i, lo + k), last[lo + k] - first[lo + i]
            if not starts:
                break
        if best is not None:
            out.append(best)
            rest += [(lo, best[0]), (best[1] + 1, hi)]
    return sorted(out)


def edge(d: np.ndarray, a: np.ndarray, i: int, j: int, step: int) -> tuple[int, int]:
    """Words of d and of a by which a piece that ends between i - 1 and i (``step`` -1: begins at i) goes on behind one edited word: fewer than a
    shingle, all equal. (0, 0) where none are."""
    best = (0, 0)
    for skip_d, skip_a in ((1, 1), (1, 0), (0, 1)):
        n = 0
        while n < SHINGLE - 1:
            x, y = (i + skip_d + n, j + skip_a + n) if step > 0 else (i - 1 - skip_d - n, j - 1 - skip_a - n)
            if not (0 <= x < len(d) and 0 <= y < len(a)) or d[x] != a[y]:
                break
            n += 1
        if n and skip_d + n > best[0]:
            best = (skip_d + n, skip_a + n)
    return best


def passages(d: np.ndarray, a: np.ndarray, diagonal: int, least: int = LEAST, similar: float = SIMILAR) -> list[tuple[int, int, int, int, float, float]]:
    """Fuzzy passages of two windows: (d start, d end, a start, a end, shingle similarity, word identity).

    Of every chain of exact runs the longest pieces in which ``similar`` or more of the shingles are shared, and at both ends the equal words, fewer
    than a shingle, behind one edited word, as long as that still holds.
    """
    blocks = runs(d, a, diagonal)
    out = []
    p0, a0 = [b[0] for b in blocks], [b[1] for b in blocks]
    p1, a1 = [b[0] + b[2] for b in blocks], [b[1] + b[2] for b in blocks]
    price = similar / (1 - similar) if similar < 1 else 1e9
    room = 2 * SHINGLE  # both ends may grow by that
    for c in chains(p0, a0, p1, a1, [b[2] for b in blocks], 0.1) if blocks else []:
        first, last = [p0[i] for i in c], [p1[i] for i in c]
        gain = [p1[i] - p0[i] - SHINGLE + 1 for i in c]
        lost = [0] + [max(p0[j] - p1[i], a0[j] - a1[i]) + SHINGLE - 1 for i, j in zip(c, c[1:])]
        for x, y in longest(first, last, gain, [price * v for v in lost], max(1, least - room)):
            shared, gone = sum(gain[x: y + 1]), sum(lost[x + 1: y + 1])
            same = sum(last[x: y + 1]) - sum(first[x: y + 1])
            for i, j in zip(c[x:y], c[x + 1: y + 1]):
                same += common(d[p1[i]: p0[j]].tolist(), a[a1[i]: a0[j]].tolist())
            s, e, t, u = p0[c[x]], p1[c[y]], a0[c[x]], a1[c[y]]
            for step in (-1, 1):
                more = edge(d, a, s, t, -1) if step < 0 else edge(d, a, e, u, 1)
                if more[0] and shared >= price * (gone + max(more)) - 1e-9:
                    gone += max(more)
                    same += min(more) - (more[0] == more[1])
                    s, t, e, u = (s - more[0], t - more[1], e, u) if step < 0 else (s, t, e + more[0], u + more[1])
            if e - s >= least:
                length = max(e - s, u - t)
                out.append((s, e, t, u, shared / (length - SHINGLE + 1), same / length))
    return out


PASSAGE = "doc_id long, start long, end long, source_id long, source_start long, source_end long, similarity double, identity double"


def _aligned(least: int, similar: float):
    def run(batches):
        for ids, side, doc, lo, raw in complete(batches, 1):
            edges = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
            rows = []
            for x, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                both = {int(side[i]): i for i in range(x, z)}  # rows of one id: the last by their codes stands for all
                if len(both) < 2:
                    continue
                i, j = both[0], both[1]
                d, a = np.frombuffer(raw[i], "<u2"), np.frombuffer(raw[j], "<u2")
                diagonal = 0 if not lo[i] and not lo[j] else int(min(MARGIN, lo[j] + MARGIN) - min(MARGIN, lo[i] + MARGIN))
                for s, e, t, u, sim, ident in passages(d, a, diagonal, least, similar):
                    rows.append((doc[i], lo[i] + s, lo[i] + e, doc[j], lo[j] + t, lo[j] + u, sim, ident))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in cols[:6]] + [pa.array(np.array(c, np.float64)) for c in cols[6:]], names=[x.split()[0] for x in PASSAGE.split(", ")])

    return run


def repeats(docs: DataFrame, least: int = LEAST, similar: float = SIMILAR, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of each document that an earlier one (smaller id) holds too: word ranges in both, similarity and identity."""
    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    found = seeds(inner, window)
    anchors = materialise(found.groupBy("hash").agg(F.min("doc").alias("anchor"), F.min_by("first", "doc").alias("apos"), F.max("doc").alias("_top"))
                          .filter("_top > anchor").drop("_top"), "substring-anchors")
    shared = materialise(found.select("hash", "doc", "pos", "plain").join(anchors, "hash"), "substring-shared")
    runs_of = materialise(shared.filter("plain").select("doc", "pos", "hash", "anchor", "apos").repartition("doc").sortWithinPartitions("doc", "pos", "hash")
                          .mapInArrow(_contexts, "hash long, doc long, pos int, wide int"), "substring-contexts")
    heads = (runs_of.groupBy("hash").agg(F.min("doc").alias("anchor"), F.min_by("pos", F.struct("doc", "pos")).alias("apos"), F.max("doc").alias("_top"))
             .filter("_top > anchor").drop("_top"))
    matches = (shared.filter("doc <> anchor").select("doc", "anchor", "pos", "apos", F.lit(0).alias("wide"))
               .unionByName(runs_of.join(heads, "hash").filter("doc <> anchor").select("doc", "anchor", "pos", "apos", "wide")))
    linked = materialise(matches.repartition("doc", "anchor").sortWithinPartitions("doc", "anchor", "pos", "apos", "wide").mapInArrow(_chained(least, window), CHAIN), "substring-chains")
    lo = lambda c: F.greatest(F.col(c) - MARGIN, F.lit(0))
    wanted = (linked.select("id", F.lit(0).alias("side"), "doc", lo("d0").alias("lo"), (F.col("d1") + MARGIN).alias("hi"))
              .unionByName(linked.select("id", F.lit(1).alias("side"), F.col("anchor").alias("doc"), lo("a0").alias("lo"), (F.col("a1") + MARGIN).alias("hi"))))
    parts = wanted.join(codes(inner), "doc").select("id", "side", "doc", "lo", F.expr("substring(codes, 2 * lo + 1, 2 * (hi - lo))").alias("raw"))
    return parts.repartition("id").sortWithinPartitions("id", "side", "raw").mapInArrow(_aligned(least, similar), PASSAGE)


def report(docs: DataFrame) -> DataFrame:
    return repeats(docs).dropDuplicates(["doc_id", "start", "end", "source_id", "source_start"])


def remove(docs: DataFrame, least: int = LEAST, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated passages: the first document keeps each, later ones lose its words. Texts left without a
    word are dropped; all other rows keep their columns. Removed words take the white space behind them along."""
    names, at = docs.columns, docs.columns.index(text_col)
    own, held, starting, ending = fresh(names, "_own", "_held", "_starting", "_ending")
    spans = materialise(repeats(docs, least, similar, id_col=id_col, text_col=text_col).groupBy(F.col("doc_id").alias(own))
                        .agg(F.collect_set(F.struct("start", "end")).alias(held)), "substring-spans")
    joined = docs.join(spans, F.col(id_col).cast("long") == F.col(own), "left").select(
        *names, F.transform(held, lambda s: s["start"]).alias(starting), F.transform(held, lambda s: s["end"]).alias(ending))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        starts, ends = b.column(len(names)), b.column(len(names) + 1)
        marked = np.flatnonzero(starts.is_valid().to_numpy(zero_copy_only=False))
        cols, keep = list(b.columns[: len(names)]), np.ones(b.num_rows, bool)
        if len(marked):
            text = cols[at].to_pylist()
            w = words(cols[at].take(pa.array(marked)), hashed=False)
            raw, n_chars = w.buf.tobytes(), cols[names.index("n_chars")].to_pylist() if "n_chars" in names else None
            edge = np.r_[0, np.cumsum([len(text[i].encode()) for i in marked])]
            for k, i in enumerate(marked.tolist()):
                s, stop = w.starts[w.first[k]: w.first[k + 1]], int(edge[k + 1])
                out, pos, left = [], int(edge[k]), np.ones(len(s), bool)
                for x, y in sorted(zip(starts[i].as_py(), ends[i].as_py())):
                    if y > len(s):  # of another row with this id
                        continue
                    begin, end = int(s[x]), int(s[y]) if y < len(s) else stop
                    left[x:y] = False
                    if begin > pos:
                        out.append(raw[pos:begin])
                    pos = max(pos, end)
                text[i] = (b"".join(out) + raw[pos:stop]).decode()
                keep[i] = left.any()
                if n_chars is not None:
                    n_chars[i] = len(text[i])
            cols[at] = pa.array(text, cols[at].type)
            if n_chars is not None:
                cols[names.index("n_chars")] = pa.array(n_chars, cols[names.index("n_chars")].type)
        return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    return map_docs(joined, run, docs.schema, text_col)
