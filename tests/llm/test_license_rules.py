"""Every rule detects an example of each of its alternatives through the prefilter."""

import itertools
import random
import re
import time
from re import _constants as c, _parser

import pytest

from tapegrid.llm import licenses


def examples(tree):
    """Strings of a pattern: each branch, each optional part with and without; classes by one member."""
    parts = [[""]]
    for op, arg in tree:
        if op is c.LITERAL:
            own = [chr(arg)]
        elif op is c.ANY:
            own = ["x"]
        elif op is c.IN:
            kind, value = arg[0]
            own = ["7" if value is c.CATEGORY_DIGIT else "x"] if kind is c.CATEGORY else [chr(v) for k, v in arg if k is c.LITERAL]
        elif op is c.BRANCH:
            own = [x for b in arg[1] for x in examples(b)]
        elif op is c.SUBPATTERN:
            own = list(examples(arg[3]))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, inner = arg
            own = [x * n for n in sorted({low, max(1, low), min(int(high), max(2, low))}) for x in examples(inner)] if high > 1 and low == 0 else \
                [x * n for n in {low, max(1, low)} for x in examples(inner)]
        else:
            assert op is c.ASSERT_NOT, op
            own = [""]
        parts.append(list(dict.fromkeys(own)))
    return ["".join(x) for x in itertools.product(*parts)]


def test_no_rule_is_hidden():
    scanner, seen = licenses.Scanner(), 0
    for p, _, label, pattern in licenses.rules():
        for text in examples(_parser.parse(pattern)):
            n = len(text.split())
            assert any(a <= 0 and n <= z and q >= p for a, z, _, q in scanner.detect(f" {text} ".encode())), (label, pattern, text)
            seen += 1
    assert seen > 1000


@pytest.mark.parametrize("text, label", [("without warranties of any kind", "no-warranty"), ("without express written permission", "proprietary"),
                                         ("without written consent", "proprietary"), ("gpl v3", "gpl-3"), ("apache version 2 0", "apache-2.0"), ("copyright c 2020 acme", "copyright")])
def test_named_cases(text, label):
    assert label in {x for _, _, x, _ in licenses.Scanner().detect(f" {text} ".encode())}


def test_keywords_of_a_family():
    assert licenses.names(r"(?:gnu )?(?:gpl|general public)") == " gpl| general public"
    assert all(re.search("[a-z]", k) for _, name, _ in licenses.FAMILIES for k in licenses.names(name).split("|"))


def test_suppression_equals_all_comparisons():
    rng = random.Random(6)
    for _ in range(300):
        found = []
        for _ in range(rng.randint(0, 25)):
            a = rng.randint(0, 30)
            found.append((a, a + rng.randint(1, 12), rng.choice("ab"), rng.choice((50, 70, 90))))
        kept = []
        for f in sorted(found, key=lambda f: (-f[3], f[0] - f[1], f[0], f[2])):
            if not any(k[0] <= f[0] and f[1] <= k[1] for k in kept):
                kept.append(f)
        assert licenses.unsuppressed(found) == kept


def test_long_repetitive_text_is_scanned_in_linear_time():
    scanner = licenses.Scanner()
    raw = b"public domain x all rights reserved " * 20_000
    began = time.process_time()
    n, base, found = licenses.scan_text(scanner, raw)
    assert time.process_time() - began < 3
    assert n == 120_000 and len(base) == 20_000 and [w for w, _ in base] == list(range(3, n, 6)) and found
