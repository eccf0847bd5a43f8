"""Passages whose parts first occur in different earlier documents."""

import random

import pytest

from tapegrid.llm import substring
from tests.llm.conftest import prose

POOL = sorted(set(prose(60_000, 1, 100_000).split()))


def covered(rows, doc, lo, hi):
    """Share of the words [lo, hi) of a document that its passages hold."""
    own = set()
    for r in rows:
        if r.doc_id == doc:
            own |= set(range(r.start, r.end))
    return sum(i in own for i in range(lo, hi)) / (hi - lo)


@pytest.mark.parametrize("cuts", [((0, 30), (30, 60)), ((0, 45), (45, 90)), ((0, 40), (20, 60)), ((0, 20), (20, 40), (40, 60), (60, 80))])
def test_later_whole_holders_are_compared(frame, cuts):
    rng = random.Random(str(cuts))
    texts, want = [], []
    for case in range(12):
        whole = rng.choices(POOL, k=cuts[-1][1])
        fill = lambda: rng.choices(POOL, k=90)
        for lo, hi in cuts:
            texts.append(fill() + whole[lo:hi] + fill())
        texts.append(fill() + whole + fill())
        own = list(whole)
        if case % 2:
            own[len(own) // 2] = "zzzz"
        texts.append(fill() + own + fill())
        want.append(len(texts) - 1)
    got = substring.report(frame([" ".join(w) for w in texts])).collect()
    assert {r.doc_id for r in got} == set(want)
    assert all(covered(got, i, 95, 85 + cuts[-1][1]) == 1 for i in want)
