"""License scan: ordered signature rules behind a keyword prefilter.

Texts are lower-cased (A-Z), cut into words of digits, letters and non-ASCII characters, and joined by single
spaces; rules are regular expressions over that form. A rule runs only where its keyword, or one of several parted by
"|", occurs; every string of a rule holds one of its keywords. Detections
are ordered by (priority, length, start); one whose interval lies inside a kept one is suppressed. Base
phrases are reported at every place and are never suppressed.

Null or empty text: no words, no labels, score 0. Repeated rows give repeated results. Null ids pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.text import map_docs, texts

#: The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: License families: label, pattern of its name in joined words, versions it is known with.
FAMILIES = (
    ("apache", r"apache(?: software)?", ("1 0", "1 1", "2 0", "2")),
    ("mit", r"(?:mit|expat|x11)", ()),
    ("bsd", r"(?:\w+ clause )?bsd(?: \w+ clause)?", ("2", "3", "4")),
    ("gpl", r"(?:gnu )?(?:gpl|general public)", ("1", "2", "3", "2 0", "3 0")),
    ("lgpl", r"(?:gnu )?(?:lgpl|lesser general public|library general public)", ("2", "2 1", "3", "3 0")),
    ("agpl", r"(?:gnu )?(?:agpl|affero general public)", ("1", "3", "3 0")),
    ("gfdl", r"(?:gnu )?(?:gfdl|free documentation)", ("1 1", "1 2", "1 3")),
    ("mpl", r"(?:mpl|mozilla public)", ("1 0", "1 1", "2 0")),
    ("epl", r"(?:epl|eclipse public)", ("1 0", "2 0")),
    ("cddl", r"(?:cddl|common development and distribution)", ("1 0", "1 1")),
    ("cpl", r"(?:cpl|common public)", ("1 0",)),
    ("eupl", r"(?:eupl|european union public)", ("1 0", "1 1", "1 2")),
    ("artistic", r"artistic", ("1 0", "2 0")),
    ("boost", r"(?:bsl|boost(?: software)?)", ("1 0",)),
    ("isc", r"(?:isc|internet systems consortium)", ()),
    ("zlib", r"zlib(?: libpng)?", ()),
    ("unlicense", r"unlicense", ()),
    ("wtfpl", r"wtfpl", ("2",)),
    ("cc-by", r"(?:cc by|creative commons attribution)", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)", ("2 0", "2 5", "3 0", "4 0")),
    ("cc0", r"(?:cc0|cc zero|creative commons zero)", ("1 0",)),
    ("odbl", r"(?:odbl|open database|odc open database)", ("1 0",)),
    ("odc-by", r"(?:odc by|open data commons attribution)", ("1 0",)),
    ("pddl", r"(?:pddl|public domain dedication and)", ("1 0",)),
    ("ogl", r"(?:ogl|open government)", ("1 0", "2 0", "3 0")),
    ("ofl", r"(?:ofl|sil open font|open font)", ("1 0", "1 1")),
    ("psf", r"(?:psf|python software foundation|python)", ("2",)),
    ("php", r"php", ("3 0", "3 01")),
    ("ruby", r"ruby", ()),
    ("perl", r"perl", ()),
    ("openssl", r"openssl", ()),
    ("ms-pl", r"(?:ms pl|microsoft public)", ()),
    ("ms-rl", r"(?:ms rl|microsoft reciprocal)", ()),
    ("ncsa", r"(?:ncsa|university of illinois ncsa)", ()),
    ("afl", r"(?:afl|academic free)", ("2 0", "2 1", "3 0")),
    ("osl", r"(?:osl|open software)", ("1 0", "2 0", "2 1", "3 0")),
    ("qpl", r"(?:qpl|q public)", ("1 0",)),
    ("upl", r"(?:upl|universal permissive)", ("1 0",)),
    ("postgresql", r"postgresql", ()),
    ("vim", r"vim", ()),
    ("zpl", r"(?:zpl|zope public)", ("1 1", "2 0", "2 1")),
    ("sspl", r"(?:sspl|server side public)", ("1", "1 0")),
    ("bsl", r"(?:busl|business source)", ("1 0", "1 1")),
    ("elastic", r"elastic", ("1 0", "2 0")),
    ("polyform", r"polyform \w+", ("1 0 0",)),
    ("cecill", r"cecill(?: [bc])?", ("1 0", "1 1", "2 0", "2 1")),
    ("json", r"json", ()),
    ("lppl", r"(?:lppl|latex project public)", ("1 0", "1 2", "1 3c")),
    ("openrail", r"(?:openrail(?: \w)?|open rail|responsible ai)", ()),
    ("llama", r"llama(?: \d+)? community", ()),
)

#: Sentences of license texts and notices: label, keyword, pattern, priority.
SENTENCES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 90),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 90),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms(?: with or without modification)?", 90),
    ("bsd", "neither the name", r"neither the name of .{1,80}? nor the names of its contributors", 85),
    ("apache", "apache license", r"licensed under the apache license(?: version \d(?: \d)?)?", 90),
    ("apache", "you may not use this file", r"you may not use this file except in compliance with the license", 70),
    ("gpl", "free software you can", r"this program is free software you can redistribute it and or modify it", 90),
    ("lgpl", "this library is free", r"this library is free software you can redistribute it and or modify it", 90),
    ("gpl", "any later version", r"either version \d of the license or at your option any later version", 80),
    ("mpl", "mozilla public", r"subject to the terms of the mozilla public license(?: v(?:ersion)? \d(?: \d)?)?", 90),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 90),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to|in to) the public domain", 80),
    ("public-domain", "public domain", r"public domain", 20),
    ("zlib", "express or implied", r"this software is provided as is without any express or implied warranty", 70),
    ("no-warranty", "without warrant", r"without warrant(?:y|ies) of any kind(?: express or implied)?", 30),
    ("no-warranty", "merchantability", r"merchantability (?:and|or) fitness for a particular purpose", 30),
    ("proprietary", "proprietary", r"proprietary and confidential", 85),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution)", 70),
    ("proprietary", "written", r"without (?:the )?(?:express |prior )*written (?:permission|consent)", 60),
    ("reserved", "rights reserved", r"(?:all|some|no) rights reserved", 50),
    ("copyright", "copyright", r"copyright(?: c)?(?: \d{4})?", 10),
    ("copyright", "copyrighted", r"copyrighted (?:material|work)s?", 15),
)

#: Forms in which a license is named: suffix of the rule, pattern around NAME, keyword, priority.
FORMS = (
    ("tag", r"spdx license identifier NAME", "spdx license", 100),
    ("grant", r"(?:licensed|released|distributed|available|published|provided|covered|shared) under (?:a |an |the )?(?:terms of )?(?:the )?NAME(?: licen[cs]e)?", " under ", 80),
    ("title", r"NAME (?:international |unported )?licen[cs]e", "licen", 60),
    ("field", r"licen[cs]e (?:is )?NAME", "licen", 55),
)


def names(pattern: str) -> str:
    """Keywords of a family: the literal beginning of each alternative of its name."""
    plain = re.sub(r"\(\?:[^()]*\)\?", "", pattern)
    plain = plain[3:-1] if plain.startswith("(?:") else plain
    return "|".join(" " + re.match(r"(?:[a-z0-9 ](?!\?))+", x)[0] for x in plain.split("|"))


def rules() -> list[tuple[int, str, str, str]]:
    """All rules as (priority, keyword, label, pattern): sentences, each form of each family, and each version."""
    out = [(p, key, label, pat) for label, key, pat, p in SENTENCES]
    for label, name, versions in FAMILIES:
        for _, form, key, p in FORMS:
            out.append((p, key, label, form.replace("NAME", name)))
        for v in versions:
            out.append((75, names(name), f"{label}-{v.replace(' ', '.')}", rf"{name}(?: public| international)?(?: licen[cs]e)?(?: v| version) ?{v}(?! \d)"))
    return sorted(out, key=lambda r: -r[0])


OUTSIDE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Scanner:
    """Compiled rules grouped by keyword; made once in each worker."""

    def __init__(self, extra: list[tuple[int, str, str, str]] | None = None):
        self.by_key: dict[tuple[bytes, ...], list[tuple[int, str, re.Pattern]]] = {}
        for p, key, label, pat in rules() + list(extra or ()):
            keys = tuple(key.encode().split(b"|"))
            self.by_key.setdefault(keys, []).append((p, label, re.compile(rb"(?<= )" + pat.encode() + rb"(?= )")))

    def detect(self, joined: bytes) -> list[tuple[int, int, str, int]]:
        """(start, end, label, priority) in words, after suppression."""
        found = []
        for keys, own in self.by_key.items():
            if any(k in joined for k in keys):
                for p, label, pat in own:
                    found += [(m.start(), m.end(), label, p) for m in pat.finditer(joined)]
        if not found:
            return []
        at = word_numbers(joined)
        return sorted((at(a) - 1, at(b), label, p) for a, b, label, p in unsuppressed(found))


def unsuppressed(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Detections (start, end, label, priority) that lie in no other kept one, by priority, then length, then place. A Fenwick tree over the starts
    keeps the furthest end of those kept so far, so a text with n detections takes n log n steps."""
    starts = sorted({f[0] for f in found})
    rank = {x: i + 1 for i, x in enumerate(starts)}
    furthest, kept = [-1] * (len(starts) + 1), []
    for f in sorted(found, key=lambda f: (-f[3], f[0] - f[1], f[0], f[2])):
        r, end = rank[f[0]], -1
        while r:
            end = max(end, furthest[r])
            r -= r & -r
        if end >= f[1]:
            continue
        kept.append(f)
        r = rank[f[0]]
        while r < len(furthest):
            furthest[r] = max(furthest[r], f[1])
            r += r & -r
    return kept


def word_numbers(joined: bytes):
    """Number of blanks before a byte of the joined words."""
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return lambda x: int(np.searchsorted(blanks, x))


def scan_text(scanner: Scanner, raw: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, int]]]:
    """Number of words, base places (first word, label), and the detections of the rules."""
    own = raw.lower().translate(OUTSIDE).split()
    joined = b" " + b" ".join(own) + b" "
    base = []
    for phrase, label in PHRASES:
        needle, pos = f" {phrase} ".encode(), -1
        while (pos := joined.find(needle, pos + 1)) >= 0:
            base.append((pos, label))
    at = word_numbers(joined) if base else None
    return len(own), [(at(x), label) for x, label in base], scanner.detect(joined)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra_rules: list[tuple[int, str, str, str]] | None = None) -> DataFrame:
    """One row per input row: counts, base places, and ``detections`` (first word, end word, label, priority)."""
    schema = ("doc_id long, n_words long, base array<struct<word:long,label:string>>, "
              "detections array<struct<start:long,end:long,label:string,priority:int>>")
    state = {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if "scanner" not in state:
            state["scanner"] = Scanner(extra_rules)
        rows = [scan_text(state["scanner"], raw) for raw in texts(b.column(1))]
        return pa.RecordBatch.from_arrays([
            b.column(0), pa.array([r[0] for r in rows], pa.int64()),
            pa.array([[{"word": w, "label": x} for w, x in r[1]] for r in rows], pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
            pa.array([[{"start": s, "end": e, "label": x, "priority": p} for s, e, x, p in r[2]] for r in rows],
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))),
        ], names=["doc_id", "n_words", "base", "detections"])

    return map_docs(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)


def report(docs: DataFrame) -> DataFrame:
    """Digest of ``scan``: score is the highest priority found, as a share of 100; a base phrase counts 50."""
    s = scan(docs)
    names = F.transform("base", lambda x: x["label"])
    joined = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(a)))
    starts = F.transform("base", lambda x: x["word"])
    best = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda x: x["priority"])), F.lit(0)), F.when(F.size("base") > 0, 50).otherwise(0))
    return s.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                    joined(names).alias("base_labels"), joined(F.concat(names, F.transform("detections", lambda x: x["label"]))).alias("labels"),
                    (F.least(best, F.lit(100)) / 100.0).alias("score"), F.size("detections").cast("long").alias("n_detections"))
