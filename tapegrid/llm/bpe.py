"""Byte-level BPE after the tokenization automaton of a merge list, for encoding and decoding whole texts.

In the automaton states stand for the last token read; an arc labelled with token t leaves state p if and only if t may follow p in
a correct tokenization. Merge gadgets define it, one for each merge (u, v) in order: wherever an arc u is followed by an arc v, the arc v is removed
behind u and an arc uv added, which leads to what was behind v at that moment.

No deterministic automaton is compiled here: its arcs (tokens times tokens) are not written out. Each merge is kept as its rank and parts, and
whether an arc exists is found on demand by unwinding the merges of both tokens, then remembered. A pre-split word has exactly one path whose labels spell
it; it is searched longest label first, with a step back where an arc is missing or the rest has no path. Decoding emits arc labels.

Splitting follows the byte-level pattern of the tokenizer file. Words are cut at spaces first and each distinct word
is encoded once in a worker (a cache of bounded size); whole texts are read, nothing is cut.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.text import map_docs, texts

#: White space of the pattern, and the pattern itself, as byte-level tokenizers define them.
BLANK = r"\t-\r \x85\xa0  -     　"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: White space other than single spaces and line ends: texts that hold any are split by the pattern as a whole.
ODD = regex.compile(rb"[\t\v\f\r]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|  | \n|\n |\n\n|^\n|\n$| $")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte: itself where printable, otherwise the next free from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Tables of a byte-level BPE file."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        letter = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.labels[i] = bytes(letter[c] for c in text)
        for raw, i in self.special.items():
            self.labels[i] = raw
        self.trie = {self.labels[i]: i for i in vocab.values()}
        #: Of each token: what it was joined from and when; bytes are there from the start.
        self.left, self.right, self.when = [-1] * size, [-1] * size, [-1] * size
        self.gadget: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            self._add(rank, vocab[u], vocab[v], vocab[u + v])
        self.longest = max(map(len, self.trie))
        self.arcs: dict[int, bool] = {}
        #: Of each label, the longest proper prefix that is also a label.
        self.shorter = [-1] * size
        for raw, i in self.trie.items():
            for n in range(len(raw) - 1, 0, -1):
                if (j := self.trie.get(raw[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.reach: dict[bytes, int] = {}
        for raw in self.trie:
            for n in (1, 2):
                self.reach[raw[:n]] = max(self.reach.get(raw[:n], 0), len(raw))

    def _add(self, rank: int, u: int, v: int, uv: int) -> None:
        self.gadget.setdefault((u, v), rank)
        if self.when[uv] < 0:
            self.left[uv], self.right[uv], self.when[uv] = u, v, rank

    def arc(self, p: int, t: int) -> bool:
        """Whether t may follow p: no gadget removed the arc at any place where the two meet.

        A gadget (a, b) acts there if a was still the end of p, and b the start of t, when its turn came.
        """
        key = p << 20 | t
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs[key] = self._arc(p, t)
            if len(self.arcs) > 2_000_000:
                self.arcs.clear()
        return known

    def _arc(self, p: int, t: int, before: int | None = None) -> bool:
        """The pairs that met at the border of p and t, from the youngest back to bytes. Of two places with the
        same gadget the left one comes first: a gadget on the border loses to the same one inside p and wins
        over the same one inside t. ``before``: only gadgets before this rank count."""
        a, b = p, t
        a_until = b_until = len(self.gadget) if before is None else before
        while True:
            rank = self.gadget.get((a, b))
            if rank is not None and rank < a_until and (rank < b_until or rank == b_until != before):
                return False
            if self.when[a] < 0 and self.when[b] < 0:
                return True
            if self.when[a] > self.when[b]:
                a_until, a = self.when[a], self.right[a]
            else:
                b_until, b = self.when[b], self.left[b]

    def longest_at(self, word: bytes, at: int) -> int:
        for n in range(min(self.reach.get(word[at: at + 2], 1), len(word) - at), 0, -1):
            i = self.trie.get(word[at: at + n])
            if i is not None:
                return i
        return -1

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one path that spells the word."""
        whole = self.trie.get(word)
        if whole is not None and self._spelt(whole):
            return [whole]
        path: list[int] = []
        at, dead = 0, set()
        t = self.longest_at(word, 0)
        n = len(word)
        while at < n:
            while t >= 0:
                end = at + len(self.labels[t])
                if end not in dead and (not path or self.arc(path[-1], t)) and self._spelt(t):
                    path.append(t)
                    at = end
                    t = self.longest_at(word, at) if at < n else -1
                    break
                t = self.shorter[t]
            else:
                dead.add(at)
                t = path.pop()
                at -= len(self.labels[t])
                t = self.shorter[t]
                if t < 0 and not path:
                    raise ValueError("no path spells the word")
        return path

    def _spelt(self, t: int) -> bool:
        """Whether a token's own parts lead to it (a later merge can be out of reach)."""
        return self.when[t] < 0 or self.arc_inside(t)

    def arc_inside(self, t: int) -> bool:
        key = -t - 1
        known = self.arcs.get(key)
        if known is None:
            u, v = self.left[t], self.right[t]
            known = self.arcs[key] = self._arc(u, v, self.when[t]) and (self.when[u] < 0 or self.arc_inside(u)) and (self.when[v] < 0 or self.arc_inside(v))
        return known


class Encoder(dict):
    """Words (cut at spaces, with their space) to their ids' bytes; filled on demand, emptied when full."""

    def __init__(self, automaton: Automaton, room: int = 400_000):
        super().__init__()
        self.automaton, self.room = automaton, room
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.room:
            self.clear()
        out = self[word] = self.split(word.decode())
        return out

    def split(self, text: str) -> bytes:
        """Ids of any text without special tokens, by the whole pattern."""
        return b"".join([self.part(x) for x in SPLIT.findall(text)])

    def part(self, x: str) -> bytes:
        out = self.parts.get(x)
        if out is None:
            if len(self.parts) >= self.room:
                self.parts.clear()
            out = np.array(self.automaton.encode_word(x.encode()), "<u4").tobytes()
            if len(x) < 64:
                self.parts[x] = out
        return out

    def encode(self, raw: bytes) -> bytes:
        """Little-endian 32-bit ids of a whole text; special tokens' strings become their ids."""
        for name, i in self.automaton.special.items():
            if name in raw:
                return i.to_bytes(4, "little").join([self.encode(x) for x in raw.split(name)])
        if not raw:
            return b""
        if ODD.search(raw):
            return self.odd(raw)
        # lines without blanks at their ends: each line end is a token of its own, each later word takes its space along
        return b"".join([self[x] for x in raw.replace(b"\n", b"\x00\n\x00").replace(b" ", b"\x00 ").split(b"\x00")]) if b"\x00" not in raw else self.odd(raw)

    def odd(self, raw: bytes) -> bytes:
        return self.split(raw.decode())


def load(path: str) -> Encoder:
    return Encoder(Automaton(path))


def decode(labels: list[bytes], ids: np.ndarray) -> bytes:
    """Emitted labels; bytes that are no UTF-8 become the replacement character."""
    return b"".join([labels[i] for i in ids.tolist()]).decode("utf-8", "replace").encode()


def _worker(path: str):
    """One encoder in each Python worker, for all its tasks."""
    global _encoder
    if "_encoder" not in globals() or _encoder[0] != path:
        _encoder = (path, load(path))
    return _encoder[1]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ids as an array. Null text: no ids. Null ids and repeated rows pass through."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = _worker(path)
        ids = [np.frombuffer(enc.encode(raw), "<u4").astype(np.int32) for raw in texts(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_docs(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, ids array<int>")


def report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of encoding and decoding each whole text, in one pass."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = _worker(path)
        rows = []
        for raw in texts(b.column(1)):
            ids = enc.encode(raw)
            back = decode(enc.automaton.labels, np.frombuffer(ids, "<u4"))
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
        n, a, z = zip(*rows)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(z)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_docs(inner, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
