"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapegrid.llm import variants
from tests.llm.conftest import prose


def brute_words(rows, least=7, times=2):
    total = Counter()
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= times}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_forms(words, ratio=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def test_vocabulary(frame):
    texts = [prose(400, i) + " ÉCOLESÉ Grüßgott×ABC" + " überlang" * 3 for i in range(30)] + [None, "", " \n", "x" * 50_000]
    got = {r.word: r.n for r in variants.vocabulary(frame(texts * 2)).collect()}
    assert got == brute_words(enumerate(texts * 2))


@pytest.mark.parametrize("room", [1, 3, 16])
def test_forms_equal_brute_force(spark, room):
    rng = random.Random(room)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(7, 12))) for _ in range(40)]
    words = {}
    for s in stems:
        words[s] = rng.choice((2, 20, 300, 5000))
        for _ in range(8):
            t = list(s)
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(t))
                t[k: k + 1] = rng.choice(([], [rng.choice("abcé")], [t[k], rng.choice("abcé")]))
            words.setdefault("".join(t), rng.choice((2, 2, 20, 300)))
    for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêë":  # one stem with every letter at one place, and one letter more
        words["commonst" + c + "m"] = 5
        words["commonst" + c + c + "m"] = 60
    words |= {"aaaaaaa": 900, "aaaaaaaa": 80, "aaaaaaaaa": 7, "": 3, "b": 40}
    got = {tuple(r) for r in variants.forms(spark.createDataFrame(list(words.items()), "word string, n long"), room=room).collect()}
    assert got == brute_forms(words)


def test_crowds_stay_linear(spark):
    """Thousands of words with one half in common: rows joined stay a multiple of the words."""
    rng = random.Random(5)
    words = spark.createDataFrame([("gemeinsam" + "".join(rng.choice("abcdefghij") for _ in range(9)), 2) for _ in range(4000)], "word string, n long").distinct()
    seen = []
    real = variants.materialise

    def counted(df, label):
        out = real(df, label)
        if label == "variants-sized":
            small = out.filter((F.col("_n") <= variants.ROOM) | (F.col("hi") - F.col("lo") <= 1))
            seen.append(small.groupBy("key").agg(F.count_if(~F.col("gram")).alias("c"), F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("c") * F.col("n")), F.lit(0))).first()[0])
        return out

    variants.materialise = counted
    try:
        variants.pairs(words).count()
    finally:
        variants.materialise = real
    assert sum(seen) < 2 * variants.ROOM * 4000


def test_odd_rows(odd, none):
    assert variants.report(none).collect() == []
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {tuple(r) for r in variants.report(odd).collect()} == brute_forms(brute_words(rows))
