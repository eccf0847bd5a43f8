"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by asymmetric q-chunks.

1. Words are counted inside tasks; their runs of letters are read from whole texts.
2. One word of a pair contributes two disjoint chunks, its halves; the other one contributes positional grams. One edit lies in one half, so
   the other half is kept: a chunk before the edit at its own place, one behind it at its place or, if the other word is longer, shifted by
   one. So the shorter word (either of two equally long ones) files its chunks, and a word files the grams at those places that a word as long as
   itself or one code point shorter could have as chunks. Entries of one key are joined and verified by their edit distance.
3. A key may hold very many words (a common stem). A crowd of more than ``room`` entries is not joined: each entry is filed again under two
   longer keys, the word without one of the halves of the segment that may hold the edit, again and again until the
   groups are small or the segment is a single code point, where a group holds one word for each letter that fits.
   No group is cut, and rows stay a fixed multiple of the entries: at most ``room`` partners an entry, or the letters of the alphabet.

Null texts have no words. A null id counts as the empty text in the id's place. Repeated rows count each. Words of any length take
part; ties between forms go to the smaller word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.text import LOWER, data, pieces
from tapegrid.plans.session import materialise

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST, TIMES, RATIO = 7, 2, 10
#: Entries of a key that are joined; and distinct words a task counts before it sends its counts.
ROOM, HELD = 16, 200_000
#: A run loses a code point if this divides its hash.
TYPO = 31


def _counted(least: int):
    def send(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for part in pieces(b):
                buf, edges = data(part.column(1))
                raw = LOWER[buf].tobytes() if len(buf) else b""
                for doc, lo, hi in zip(part.column(0).to_pylist(), edges[:-1].tolist(), edges[1:].tolist()):
                    if lo == hi:
                        continue
                    prefix = zlib.crc32(("" if doc is None else str(doc)).encode() + b":")
                    for word, n in Counter(RUN.findall(raw[lo:hi].decode("utf-8", "replace"))).items():
                        if len(word) < least:
                            continue
                        h = zlib.crc32(word.encode(), prefix)
                        if h % TYPO == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1:]
                            if len(word) < least:
                                continue
                        total[word] += n
                if len(total) > HELD:
                    yield send(total)
                    total = Counter()
        if total:
            yield send(total)

    return run


def vocabulary(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters of at least ``least`` code points found ``times`` or more; some occurrences lose a code point by the rule of the hash."""
    inner = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return inner.mapInArrow(_counted(least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _key(short: Column, lo: Column, hi: Column, gram: Column) -> Column:
    """Key of a segment [lo, hi) of words ``short`` code points long: what lies outside it. In a word one longer (``gram``) what lies behind the
    segment is shifted by one."""
    end = hi + gram.cast("int")
    return F.xxhash64(short, lo, hi, F.concat(F.expr("substring(word, 1, lo)"), F.lit("\0"), F.substring("word", end + 1, F.length("word"))))


def _filed(entries: DataFrame) -> DataFrame:
    """Entries (word, n, gram, lo, hi) under the halves of their segments."""
    short = F.length("word") - F.col("gram").cast("int")
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi"))))
    out = entries.select("word", "n", "gram", short.cast("int").alias("_short"), halves.alias("_s")).select("word", "n", "gram", "_short", "_s.lo", "_s.hi")
    return out.select("word", "n", "gram", "lo", "hi", _key(F.col("_short"), F.col("lo"), F.col("hi"), F.col("gram")).alias("key"))


def pairs(words: DataFrame, room: int = ROOM) -> DataFrame:
    """(a, a_n, b, b_n) of words one edit apart, each pair once; ``words`` are (word, n), distinct."""
    own = words.select("word", "n", F.lit(False).alias("gram"), F.lit(0).alias("lo"), F.length("word").alias("hi"))
    # as the longer word of a pair: an empty one has no shorter partner
    longer = words.filter(F.length("word") > 0).select("word", "n", F.lit(True).alias("gram"), F.lit(0).alias("lo"), (F.length("word") - 1).alias("hi"))
    entries, found = own.unionByName(longer), None
    while True:
        filed = materialise(_filed(entries), "variants-filed")
        size = filed.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("gram")).alias("_chunks")).filter("_n > 1 AND _chunks > 0")
        sized = materialise(filed.join(size, "key"), "variants-sized")
        crowd = (F.col("_n") > room) & (F.col("hi") - F.col("lo") > 1)
        small = sized.filter(~crowd)
        a = small.filter("NOT gram").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = small.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "gram")
        close = a.join(b, "key").filter((F.col("gram") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")
        close = materialise(close, "variants-pairs")
        found = close if found is None else found.unionByName(close)
        entries = sized.filter(crowd).select("word", "n", "gram", "lo", "hi")
        if entries.isEmpty():
            return found.distinct()  # an insertion beside an equal letter fits two segments


def forms(words: DataFrame, ratio: int = RATIO, room: int = ROOM) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word: its most frequent near word if that is ``ratio`` times as frequent (ties: the smaller
    word), the end of the path of forms, and the number of near words."""
    found = materialise(pairs(words, room), "variants-near")
    both = found.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(found.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("_best"))
    held = F.col("_best.rank") * -1 >= ratio * F.col("n")
    out = materialise(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(held, F.col("_best.near")).alias("form"),
                                                              F.when(held, -F.col("_best.rank")).alias("form_n")), "variants-forms")
    # paths: every step multiplies the count by the ratio, so there are few; each round doubles what is known of them
    jump = out.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = jump.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialise(jump.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "variants-roots")
        jump = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            break
    return out.join(jump, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    return forms(materialise(vocabulary(docs), "variants-words"))


# The same over the table documents: crc32 by its table, near words by leaving out one code point.
ORACLE = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
                                 lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM counted, tab),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT word, near, near_n FROM (
    SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT w.word, g.word, g.n FROM words w JOIN gaps g ON w.word = g.rest
    UNION ALL SELECT g.word, w.word, w.n FROM words w JOIN gaps g ON w.word = g.rest)),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
picked AS (SELECT b.word, n_near, top, min(near) AS near FROM best b JOIN near x ON x.word = b.word AND x.near_n = b.top GROUP BY ALL),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN near END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN picked p ON p.word = w.word),
walk AS (
  SELECT word, word AS place, 0 AS step FROM formed
  UNION ALL SELECT k.word, f.form, step + 1 FROM walk k JOIN formed f ON f.word = k.place WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(place, step) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""
