"""Secret scan with corpus-wide ownership frequency.

Every text gives base matches (kinds ``assign``, ``access``, ``hex``) and further candidates: long mixed strings
of high entropy outside them (kind ``entropy``). Candidate values are hashed and aggregated over the whole
corpus by distinct repository (document) and owner (source). A value that many owners hold is a copied example;
one that few hold looks live. Candidates of kind ``entropy`` become spans only if they look live; base matches
always stay, each with its verdict.

Null text: empty. Null source: an owner of its own kind (one owner for all nulls). Repeated rows count as
one repository if their ids are equal. Null ids count as one repository.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from tapegrid.llm.text import char_index, fresh, map_docs, texts
from tapegrid.plans.session import materialise

#: The base patterns, in order of kind.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")
LONG = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
#: Words of the first pattern, each needed for a match.
HINTS = (b"passw", b"secret", b"token", b"api")

SPAN = "struct<kind:string,start:long,end:long,hash:string,base:boolean>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string()), ("base", pa.bool_())]))


def entropy(x: bytes) -> float:
    n = len(x)
    return -sum(c / n * math.log2(c / n) for c in Counter(x).values())


def mixed(x: bytes, least: float) -> bool:
    """Letters and digits that change often, at ``least`` bits a character: not a word, number or ruler."""
    digits = sum(48 <= c <= 57 for c in x)
    letters = sum(c | 32 > 96 and c | 32 < 123 for c in x)
    return digits >= 3 and letters >= 3 and entropy(x) >= least


def find(raw: bytes, least: float = 3.5) -> list[tuple[int, int, str, bytes, bool]]:
    """(start, end, kind, value, base) by start, then kind as listed; byte offsets."""
    out = []
    low = raw.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign", m[2], True) for m in ASSIGN.finditer(raw) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access", m[0], True) for m in ACCESS.finditer(raw)]
    if longs := list(LONG.finditer(raw)):
        for m in longs:
            out += [(m.start() + h.start(), m.start() + h.end(), "hex", h[0], True) for h in HEX.finditer(m[0])]
        taken = [(s, e) for s, e, *_ in out]
        out += [(m.start(), m.end(), "entropy", m[0], False) for m in longs if mixed(m[0], least) and not any(s < m.end() and m.start() < e for s, e in taken)]
    return sorted(out, key=lambda f: (f[0], KINDS.index(f[2])))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", least: float = 3.5) -> DataFrame:
    """One row per input row: id, owner and all candidates as spans in code points."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for raw in texts(b.column(2)):
            found = find(raw, least)
            if not found:
                rows.append([])
                continue
            at = sorted({x for f in found for x in f[:2]})
            where = dict(zip(at, char_index(raw, at)))
            rows.append([{"kind": k, "start": where[s], "end": where[e], "hash": hashlib.sha256(v).hexdigest(), "base": own} for s, e, k, v, own in found])
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, ARROW)], names=["doc_id", "owner", "spans"])

    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).cast("string").alias("text"))
    return map_docs(inner, run, f"doc_id long, owner string, spans array<{SPAN}>")


def ownership(found: DataFrame) -> DataFrame:
    """Each candidate value's number of distinct repositories and owners.

    Distinct (value, repository, owner) rows come first, so a value that a third of all rows hold is
    reduced inside the map tasks and spread over its repositories before the last, small sums.
    """
    rows = found.select(F.explode("spans").alias("s"), "doc_id", F.coalesce("owner", F.lit("\x00")).alias("owner"))
    rows = rows.select(F.col("s.hash").alias("hash"), "doc_id", "owner")
    repos = rows.select("hash", "doc_id").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repos"))
    owners = rows.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    return repos.join(owners, "hash")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = 4, least: float = 3.5) -> DataFrame:
    """One row per input row: ``spans`` (kind, start, end, hash, base, repos, owners, live), kept ones only.

    ``example_owners``: a value that this many owners or more hold is a copied example, not a live credential.
    """
    found = materialise(candidates(docs, id_col, text_col, owner_col, least), "secrets")
    keyed = found.withColumn("row", F.monotonically_increasing_id())
    keyed = materialise(keyed.filter(F.size("spans") > 0), "secrets-rows")
    seen = ownership(keyed)
    judged = (keyed.select("row", F.posexplode("spans").alias("i", "s")).select("row", "i", "s.*").join(seen, "hash")
              .withColumn("live", F.col("owners") < example_owners).filter(F.col("base") | F.col("live")))
    again = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "kind", "start", "end", "hash", "base", "repos", "owners", "live"))).alias("judged"))
    hits = keyed.select("row", "doc_id").join(again, "row", "left").select("doc_id", "judged")
    return found.filter(F.size("spans") == 0).select("doc_id", F.lit(None).cast(hits.schema["judged"].dataType).alias("judged")).unionByName(hits).select(
        "doc_id", F.coalesce("judged", F.array().cast(hits.schema["judged"].dataType)).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """Digest of ``scan`` for each document."""
    s = scan(docs)
    text = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("spans", lambda x: x["base"])
    n = lambda cond: F.size(F.filter("spans", cond)).cast("long")
    of = lambda k: n(lambda x: x["base"] & (x["kind"] == k)).alias(f"n_{k}")
    return s.select("doc_id", *map(of, KINDS[:3]), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
                    text(F.col("spans")).alias("spans"), n(lambda x: x["live"]).alias("n_live"), n(lambda x: ~x["live"]).alias("n_example"),
                    F.coalesce(F.array_max(F.transform("spans", lambda x: x["owners"])), F.lit(0)).alias("most_owners"))


def redact(docs: DataFrame, example_owners: int = 4, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Documents with every live credential replaced by ``mark``; copied examples stay. Columns stay as they are.

    Only texts that hold candidates are kept aside and joined with their spans, by a hash of id and text; all
    others pass by in place.
    """
    names = docs.columns
    flag, key, one, live, put = fresh(names, "_flag", "_key", "_one", "_live", "_put")
    has = _has_candidates(docs, text_col, flag)
    flagged = materialise(has.filter(F.col(flag)).drop(flag).withColumn(key, F.xxhash64(id_col, text_col)), "secrets-texts")
    found = scan(flagged, key, text_col, owner_col, example_owners).dropDuplicates(["doc_id"])
    spans = found.select(F.col("doc_id").alias(one), F.filter("spans", lambda x: x["live"]).alias(live)).filter(F.size(live) > 0)
    hit = flagged.join(spans, F.col(key) == F.col(one), "left").withColumn(put, F.lit(mark))
    # spans by start: `at` is where the next piece of text begins, the furthest end so far
    cut = F.expr(f"""aggregate(`{live}`, named_struct('at', 0L, 'out', ''),
        (a, s) -> IF(s.end <= a.at, a, named_struct('at', s.end, 'out', IF(s.start < a.at, a.out,
            concat(a.out, substring(`{text_col}`, int(a.at) + 1, int(s.start - a.at)), `{put}`)))),
        a -> concat(a.out, substring(`{text_col}`, int(a.at) + 1)))""")
    new = hit.withColumn(text_col, F.when(F.col(live).isNull(), F.col(text_col)).otherwise(cut))
    if "n_chars" in names:
        new = new.withColumn("n_chars", F.when(F.col(live).isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return has.filter(~F.col(flag)).select(*names).unionByName(new.select(*names))


def _has_candidates(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with a column ``name``: whether its text holds any candidate."""
    names = docs.columns
    at = names.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        flag = pa.array([bool(find(raw)) for raw in texts(b.column(at))], pa.bool_())
        return pa.RecordBatch.from_arrays([*b.columns, flag], names=[*names, name])

    return map_docs(docs, run, StructType([*docs.schema.fields]).add(name, BooleanType()), text_col)
