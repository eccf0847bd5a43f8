"""Near copies against brute-force Jaccard of five-word shingle sets."""

import random

import pytest

from tapegrid.llm import near
from tests.llm.conftest import prose


def shingle_set(text):
    w = text.lower().split()
    return set(zip(*(w[k:] for k in range(5))))


def brute(texts):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingle_set(t) for t in texts]
    for j in range(len(texts)):
        for i in range(j):
            shared = len(sets[i] & sets[j])
            if shared and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(words, n, rng):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = "zq%d" % rng.randrange(10 ** 6)
    return w


def near_copies():
    rng = random.Random(12)
    texts = []
    for i in range(60):
        n = rng.choice((60, 200, 400, 1000))
        base = prose(n, i, 100_000).split()
        texts += [" ".join(base), " ".join(edited(base, max(1, n // rng.choice((50, 60, 90, 125))), rng))]
    walk = prose(300, 777, 100_000).split()  # a chain whose ends are far apart, and a crowd beside it
    for _ in range(40):
        texts.append(" ".join(walk))
        walk = edited(walk, 4, rng)
    crowd = prose(250, 888, 100_000).split()
    texts += [" ".join(edited(crowd, rng.randint(1, 8), rng)) for _ in range(60)]
    rng.shuffle(texts)
    return texts


def test_groups_equal_brute_force(frame):
    texts = near_copies()
    want = brute(texts)
    got = {r.doc: r.root for r in near.groups(frame(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {r.doc_id for r in near.keep_first(frame(texts)).collect()} == set(want)


def test_stage_drops_near_copies(frame, spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    base = prose(200, 1, 100_000).split()
    copy = list(base)
    copy[60] = copy[140] = "zzzz"  # more than two bits apart
    texts = [" ".join(base), prose(200, 2, 100_000), " ".join(copy)]
    assert {r.doc_id for r in pipeline.simhash_near_dedup(spark, frame(texts), "").collect()} == {0, 1}


def test_crowds_stay_linear(spark, monkeypatch):
    """3,000 near copies of one text and 600 texts that share half of their words with it: rows of every step are a fixed multiple of the entries."""
    rng = random.Random(9)
    base = prose(200, 4, 100_000).split()
    texts = [" ".join(edited(base, rng.randint(1, 2), rng)) for _ in range(3000)]
    for i in range(600):
        own = prose(100, 10_000 + i // 3, 100_000).split()
        texts.append(" ".join(base[:100] + edited(own, 1 if i % 3 else 0, rng)))
    rows = {}
    real = near.materialise

    def counted(df, label):
        out = real(df, label)
        rows[label] = max(rows.get(label, 0), out.count())
        return out

    monkeypatch.setattr(near, "materialise", counted)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {r.doc: r.root for r in near.groups(docs).collect()}
    n = len(texts)
    assert rows["near-pairs"] <= 16 * n and rows["near-buckets"] <= 120 * n and rows["near-close"] <= 16 * n
    assert sum(got[i] == got[0] for i in range(3000)) >= 0.99 * 3000
    sets = [shingle_set(t) for t in texts]
    linked = [(i, j) for k in range(200) for i in [3000 + 3 * k] for j in (i + 1, i + 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(linked) > 300 and sum(got[i] == got[j] for i, j in linked) >= 0.98 * len(linked)


def test_odd_rows(odd, none):
    assert near.keep_first(none).count() == 0
    out = near.keep_first(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
