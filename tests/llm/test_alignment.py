"""Alignment of passages: the longest pieces, edits at all places, exact identity."""

import random

import numpy as np
import pytest

from tapegrid.llm import substring


def brute_longest(first, last, gain, loss, least):
    """All pieces, the longest valid one first."""
    out, rest = [], [(0, len(first))]
    while rest:
        lo, hi = rest.pop()
        best = None
        for i in range(lo, hi):
            for k in range(i, hi):
                size = last[k] - first[i]
                if size >= least and sum(gain[i: k + 1]) - sum(loss[i + 1: k + 1]) >= -1e-9 and (best is None or size > best[0]):
                    best = (size, i, k)
        if best:
            out.append(best[1:])
            rest += [(lo, best[1]), (best[2] + 1, hi)]
    return sorted(out)


def test_longest_equals_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        n, at, first, last = rng.randint(1, 14), 0, [], []
        for _ in range(n):
            at += rng.randint(1, 12)
            first.append(at)
            at += rng.randint(5, 40)
            last.append(at)
        gain = [b - a - 4 for a, b in zip(first, last)]
        loss = [0] + [4 * (b - a + 4) for a, b in zip(last, first[1:])]
        least = rng.choice((1, 30, 60))
        got = substring.longest(first, last, gain, loss, least)
        want = brute_longest(first, last, gain, loss, least)
        assert max((last[k] - first[i] for i, k in got), default=0) == max((last[k] - first[i] for i, k in want), default=0)  # equal ones may part the rest differently
        assert all(sum(gain[i: k + 1]) - sum(loss[i + 1: k + 1]) >= -1e-9 for i, k in got)


def test_common_is_the_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        x, y = ([rng.randint(0, 6) for _ in range(rng.randint(0, 40))] for _ in range(2))
        row = [0] * (len(y) + 1)
        for v in x:
            prior = 0
            for j, u in enumerate(y):
                prior, row[j + 1] = row[j + 1], prior + 1 if v == u else max(row[j], row[j + 1])
        assert substring.common(x, y) == row[-1]
    assert substring.common(list(range(3000)), list(range(0, 3000, 2))) == 1500


@pytest.mark.parametrize("place", range(1, 49))
def test_one_edit_at_every_place_of_fifty_words(place):
    rng = random.Random(place)
    passage = [rng.randrange(65536) for _ in range(50)]
    for kind in ("replace", "insert", "delete"):
        other = list(passage)
        other[place: place + (kind != "insert")] = [] if kind == "delete" else [70_000 % 65536]
        a = np.array([rng.randrange(65536) for _ in range(30)] + passage + [rng.randrange(65536) for _ in range(30)], np.uint16)
        d = np.array([rng.randrange(65536) for _ in range(20)] + other + [rng.randrange(65536) for _ in range(40)], np.uint16)
        for x, y, n in ((d, a, len(other)), (a, d, 50)):
            got = substring.passages(x, y, 0)
            if n >= 50 and (2 <= place <= 47):
                assert len(got) == 1 and got[0][1] - got[0][0] >= n - 1 and got[0][4] >= 0.8, (kind, place, got)
            assert all(e - s >= 50 and sim >= 0.8 - 1e-9 for s, e, _, _, sim, _ in got)


def planted(rng):
    """Passages of 50 to 120 words with 0 to 2 words replaced, 0.8 or more of the shingles shared."""
    n, edits = rng.randint(50, 120), rng.choice((0, 1, 2))
    passage = [f"w{rng.randrange(50_000)}" for _ in range(n)]
    other = list(passage)
    for k in rng.sample(range(n), edits):
        other[k] = f"x{rng.randrange(10 ** 9)}"
    same = sum(passage[i: i + 5] == other[i: i + 5] for i in range(n - 4))
    return (passage, other, edits) if same >= 0.8 * (n - 4) else planted(rng)


def test_planted_passages_are_found(frame):
    rng = random.Random(8)
    noise = lambda k: [f"n{rng.randrange(50_000)}" for _ in range(k)]
    texts, spots = [], []
    for i in range(300):
        passage, other, edits = planted(rng)
        before = rng.randint(0, 80)
        texts += [" ".join(noise(60) + passage + noise(60)), " ".join(noise(before) + other + noise(rng.randint(0, 80)))]
        spots.append((2 * i + 1, before, before + len(other), edits))
    held = {}
    for r in substring.report(frame(texts)).collect():
        held.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    for edits in (0, 1, 2):
        own = [len(held.get(doc, set()) & set(range(lo, hi))) >= 0.8 * (hi - lo) for doc, lo, hi, e in spots if e == edits]
        assert sum(own) >= 0.95 * len(own), (edits, sum(own), len(own))
