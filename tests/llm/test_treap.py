"""Ranked search against exhaustive scoring."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tapegrid.llm import treap
from tests.llm.conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in own:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, treap.LAST if d is None else d))
        out += [(item, k + 1, None if d == treap.LAST else d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def test_quadtree_round_trip():
    rng = np.random.default_rng(1)
    for rows, cols in ((1, 1), (300, 5), (7, 200), (64, 64)):
        cells = rng.choice(rows * cols, min(rows * cols, 150), replace=False)
        row, col, value = cells // cols, cells % cols, rng.integers(1, 10 ** 6, len(cells))
        height = max(1, int(max(rows, cols) - 1).bit_length())
        grid = treap.Grid(height, *treap.compress(row, col, value, height))
        assert grid.top[0][0] == value.max()
        for r, c, v in zip(row.tolist(), col.tolist(), value.tolist()):
            node, above = 0, grid.top[0][0]
            for level in range(height):
                shift = height - 1 - level
                node = grid.child[level][4 * node + 2 * ((r >> shift) & 1) + ((c >> shift) & 1)]
                assert node >= 0 and grid.top[level + 1][node] <= above
                above = grid.top[level + 1][node]
            assert above == v


@pytest.mark.parametrize("wide", [1, 64])
def test_descent_equals_all_scores(wide):
    rng = np.random.default_rng(wide)
    texts = [prose(int(rng.integers(1, 120)), int(rng.integers(0, 40))) for _ in range(90)]  # many equal texts
    block = treap._block(list(range(0, 900, 10)), pa.array(texts), 90, 5000)
    row = next(treap._rows(block))
    own, grid, ids = treap.Terms(row), treap.Grid(row["height"], treap._unpacked(row, "bits"), treap._unpacked(row, "maxima")), np.frombuffer(treap._unpacked(row, "docs"), np.int64)
    for seed in range(8):
        asked = sorted({t.encode() for t in terms(prose(30, seed))})
        held = [own.row(t) for t in asked]
        rows, weights = np.array([r for r in held if r >= 0]), np.array([100 + k for k, r in enumerate(held) if r >= 0])
        full: list = []
        treap.descend(grid, rows, weights, ids, full, top=1000, wide=wide)
        best = [(-5_000_000, 5), (-1, 3)] if seed % 2 else []  # of other blocks
        want = sorted(best + full)[:10]
        treap.descend(grid, rows, weights, ids, best, wide=wide)
        assert best == want


def test_search_equals_brute_force(spark, frame, monkeypatch):
    rng = random.Random(4)
    texts = [prose(rng.randint(1, 300), rng.randint(0, 60)) for _ in range(150)] + [None, "", "!!!", prose(20_000, 77)] + [prose(50, 3)] * 30
    items = [(i, prose(rng.randint(1, 40), rng.randint(0, 60))) for i in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (None, prose(9, 1)), (3, prose(30, 3))]
    monkeypatch.setattr(treap, "ITEMS", 5)
    blocks, n = treap.index(frame(texts), block=20_000)
    assert blocks.count() > 5
    got = treap.search(blocks, n, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(list(enumerate(texts)), items)


def test_odd_rows(odd, none, spark):
    items = spark.createDataFrame([(1, "word"), (2, prose(40, 6))], "item_id long, text string")
    assert treap.report(none, items).collect() == []
    assert treap.report(odd, items.limit(0)).collect() == []
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, treap.report(odd, items).collect()), key=str) == brute(docs, [tuple(r) for r in items.collect()])
