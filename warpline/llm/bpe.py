"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

For every prefix of a piece there is exactly one token that its BPE encoding
ends with. An automaton over the vocabulary lists, at each position, the tokens
that are suffixes of the prefix so far; the one that may follow the stored last
token of the remaining prefix is stored, and following these back from the end
gives the ids. Whether a token may follow another is decided by undoing merges
at their border, latest first, and asking if an earlier merge would have joined
across it. The result equals the merge loop's, in time linear in the text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.llm.vocabulary import resolve
from warpline.plans.scratch import pick

#: Fixed value: the pattern that splits text before the merges of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and pieces kept ready in each Python worker, at most; further ones are encoded anew each time.
CACHE_ENTRIES = 400_000
#: Texts over this many characters are handled in blocks of pieces.
BLOCK_CHARS = 4_000_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else from 256 upwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


class _Words(dict):
    """Words to what ``make`` gives for them, up to a fixed number of entries."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.limit:
            self[key] = value
        return value


class _Irregular(Exception):
    """A word that cannot be cut from its neighbours."""


class BpeEncoder:
    """Encoder and decoder of one byte-level BPE file."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # tokens by order of their merge: single bytes first, then rank by rank
        merged = [a + b for a, b in pairs]
        single = [t for t in vocab if len(t) == 1]
        order = single + merged
        if len(set(order)) != len(order):
            raise ValueError("a token has two merges")
        rank = {t: i for i, t in enumerate(order)}
        self._ids = [vocab[t] for t in order]
        n1 = len(single)
        self._left = [*range(n1), *(rank[a] for a, _ in pairs)]
        self._right = [*range(n1), *(rank[b] for _, b in pairs)]
        self._join = {(rank[a], rank[b]): n1 + i for i, (a, b) in enumerate(pairs)}
        self._pair: dict[tuple[int, int], bool] = {}
        # only tokens that encode to themselves can end a prefix
        whole = [True] * n1
        for i in range(n1, len(order)):
            a, b = self._left[i], self._right[i]
            whole.append(whole[a] and whole[b] and self._compatible(a, b, i))
        auto = ahocorasick.Automaton()
        for i, t in enumerate(order):
            if whole[i]:
                auto.add_word(t, (i, len(t)))
        auto.make_automaton()
        self._auto = auto
        self._alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(self._alphabet)}
        self._bytes = {vocab[t]: bytes(back[c] for c in t) for t in order}
        self._added = {}
        for t in spec.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("added tokens with conditions are not supported")
            self._added[t["content"]] = t["id"]
            self._bytes[t["id"]] = t["content"].encode()
        longest = sorted(self._added, key=len, reverse=True)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self._pieces = regex.compile(PATTERN).findall
        self._iter = regex.compile(PATTERN).finditer
        self._piece_ids = _Words(self._encode_piece, cache_entries // 2)
        self._inner = _Words(lambda w: self._word(" " + w, w), cache_entries)
        self._table = {b: c for b, c in enumerate(self._alphabet)}

    def _compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side.

        ``below``: only merges of a lower rank than this count against it.
        """
        left, right, join = self._left, self._right, self._join
        limit = len(left) if below is None else below
        while True:
            c = join.get((a, b))
            if c is not None and c < limit:
                return False
            la, rb = right[a], left[b]
            if a > b and la != a:
                limit, a = min(limit, a), la
            elif rb != b:
                limit, b = min(limit, b + 1), rb
            elif la != a:
                limit, a = min(limit, a), la
            else:
                return True

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece: the last token of every prefix, then back from the end."""
        table = self._table
        chars = "".join([table[b] for b in piece.encode("utf-8", "replace")])
        n = len(chars)
        last: list[int] = [-1] * (n + 1)
        size = [0] * (n + 1)
        pair, compatible = self._pair, self._compatible
        for end, (token, length) in self._auto.iter(chars):
            at = end + 1
            if last[at] >= 0:
                continue
            if length < at:
                before = last[at - length]
                key = (before, token)
                ok = pair.get(key)
                if ok is None:
                    ok = compatible(before, token)
                    if len(pair) < 1_000_000:
                        pair[key] = ok
                if not ok:
                    continue
            last[at], size[at] = token, length
        out = []
        while n:
            if last[n] < 0:
                raise ValueError(f"the vocabulary has no token for a byte of {piece!r}")
            out.append(self._ids[last[n]])
            n -= size[n]
        return tuple(out[::-1])

    def _word(self, word: str, bare: str) -> tuple[str, bytes]:
        """Comma-joined ids and bytes of a word that starts and ends without white space."""
        if not bare or bare[0].isspace() or bare[-1].isspace():
            raise _Irregular
        ids = [i for p in self._pieces(word) for i in self._piece_ids[p]]
        return ",".join(map(str, ids)), b"".join(map(self._bytes.__getitem__, ids))

    def _parts(self, text: str) -> Iterator[list[tuple[str, bytes]]]:
        """What the words or pieces of a text without added tokens give, in blocks."""
        if len(text) <= BLOCK_CHARS:
            words = text.split(" ")
            try:
                first = self._word(words[0], words[0])
                rest = words[1:]
                yield [first, *map(self._inner.__getitem__, rest)]
                return
            except _Irregular:
                pass
        found = self._iter(text)
        while block := [m.group() for m in islice(found, 100_000)]:
            ids = [self._piece_ids[p] for p in block]
            yield [(",".join(map(str, i)), b"".join(map(self._bytes.__getitem__, i))) for i in ids]

    def blocks(self, text: str) -> Iterator[list[tuple[str, bytes]]]:
        """(comma-joined ids, decoded bytes) of the parts of a text, in order."""
        if self._cut is None or not any(t in text for t in self._added):
            if text:
                yield from self._parts(text)
            return
        for part in self._cut.split(text):
            if part in self._added:
                yield [(str(self._added[part]), part.encode())]
            elif part:
                yield from self._parts(part)

    def encode(self, text: str) -> list[int]:
        return [int(i) for block in self.blocks(text) for ids, _ in block for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the comma-joined ids, SHA-256 of the decoded text)."""
        n, ids_sha, text_sha, sep = 0, hashlib.sha256(), hashlib.sha256(), b""
        blocks = list(self.blocks(text)) if len(text) <= BLOCK_CHARS else self.blocks(text)
        tail = b""
        for block in blocks:
            ids = ",".join([p[0] for p in block]).encode()
            n += ids.count(b",") + 1
            ids_sha.update(sep + ids)
            sep = b","
            data = tail + b"".join([p[1] for p in block])
            # a character may be cut at a block's end only if its bytes are: keep an unfinished one back
            keep = _unfinished(data)
            tail = data[len(data) - keep :]
            text_sha.update(data[: len(data) - keep].decode("utf-8", "replace").encode())
        if tail:
            text_sha.update(tail.decode("utf-8", "replace").encode())
        return n, ids_sha.hexdigest(), text_sha.hexdigest()


def _unfinished(data: bytes) -> int:
    """How many bytes at the end begin a character that is not complete."""
    for k in range(1, min(4, len(data)) + 1):
        b = data[-k]
        if b & 0xC0 == 0x80:
            continue
        need = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
        return k if need > k else 0
    return 0


_encoders: dict[str, BpeEncoder] = {}


def encoder(path: str) -> BpeEncoder:
    """The encoder of a file, built once in each Python process."""
    path = resolve(path)
    if path not in _encoders:
        _encoders[path] = BpeEncoder(path)
    return _encoders[path]


def bpe_round_trip(docs: DataFrame, path: str = "byte_bpe_50k.json") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row of ``docs(doc_id, text)``.

    A null text counts as empty: no ids, both digests those of nothing. Rows are
    independent: repeated rows give repeated results, an empty table an empty
    one, and other columns are ignored. ``path`` is a file, or the name of one
    among the installed public vocabularies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            rows = [bpe.digest(t.as_py() or "") for t in b.column(1)]
            n, i, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_ids(docs: DataFrame, path: str = "byte_bpe_50k.json") -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row of ``docs(doc_id, text)``; a null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            ids = [bpe.encode(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def bpe_texts(rows: DataFrame, path: str = "byte_bpe_50k.json") -> DataFrame:
    """``(doc_id, text)`` for every row of ``rows(doc_id, ids)``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            texts = [bpe.decode(i.as_py() or []) for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    plain = pick(rows, "doc_id", "ids").withColumn("doc_id", F.col("doc_id").cast("long"))
    return plain.mapInArrow(run, "doc_id long, text string")
