import functools
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@functools.cache
def words_of(vocabulary):
    base = random.Random(99)
    return ["".join(base.choice("abcdefghijklmnoprstuvwé") for _ in range(base.randint(2, 9))) for _ in range(vocabulary)]


def prose(n, seed, vocabulary=3000):
    rng = random.Random(seed)
    pool = words_of(vocabulary)
    out, line = [], []
    for i in range(n):
        line.append(pool[min(int(rng.paretovariate(0.7)) - 1, vocabulary - 1)])
        if rng.random() < 0.08:
            line[-1] += "."
    for i in range(0, len(line), 40):
        out.append(" ".join(line[i: i + 40]))
    return "\n".join(out)


def rows(texts, sources=7):
    return [(i, t, "en", f"src{i % sources}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def frame(spark):
    def make(texts, sources=7):
        return spark.createDataFrame(rows(texts, sources), SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and columns whose names clash with internal ones."""
    long = prose(60_000, 5)
    data = [(None, None, None, None, None), (1, None, "en", None, None), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 4), (4, long, "en", "s", len(long)),
            (5, prose(300, 6), "en", "s", 1), (5, prose(300, 6), "en", "s", 1), (6, "word", "en", "t", 4), (6, prose(200, 7), "fr", None, None), (7, "\x00<|endoftext|> ﻿  'S", "en", "s", 3),
            (None, prose(300, 6), "en", "s", 1)]
    extra = [(*r, i, "x", [1], 0.5, True) for i, r in enumerate(data)]
    return spark.createDataFrame(extra, SCHEMA + ", fp long, hash string, spans array<int>, score double, _flag boolean")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
