"""Packing token pieces into fixed-size sequences: shortest-pack-first over the length histogram.

Documents are tokenised once and cut into full sequences and one remainder, so
only lengths and checksums travel. The histogram of piece lengths has at most
``size`` bins whatever the corpus; the driver packs that histogram, longest
length first, each time into the emptiest pack that still has room, and counts
*patterns* (sets of lengths) instead of packs. Pieces then find their slot by
rank within their length. Ranks come from counts for each (length, bucket), so
a length that a third of the pieces share is numbered by many tasks.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warpline.llm.bpe import _Words, byte_alphabet
from warpline.llm.vocabulary import resolve
from warpline.plans.scratch import Scratch, pick

CACHE_ENTRIES = 500_000
#: Rows of one rank bucket, about.
BUCKET_ROWS = 20_000
#: Fixed value: the pattern whose matches are the words of a word-end vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters alone are cut at white space before the library sees their words.
_SIMPLE = regex.compile(r"[\t\n\r -~¡-İĲ-ɏ]*+").fullmatch


class WordIds:
    """Ids of texts by the tokenizers library, with the words of plain Latin texts kept ready.

    A text of other characters, or with an added token in it, goes to the
    library whole. Both ways give the library's ids.
    """

    def __init__(self, path: str, end_id: int | None, cache_entries: int = CACHE_ENTRIES) -> None:
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self._lib.no_truncation()
        self._lib.no_padding()
        self._tail = b"" if end_id is None else struct.pack("<I", end_id)
        self._special = [t.content for t in self._lib.get_added_tokens_decoder().values()]
        self._find = regex.compile(WORD_PATTERN).findall
        self._alphabet = byte_alphabet()
        self._pieces = _Words(self._piece, cache_entries // 2)
        self._words = _Words(self._word, cache_entries)
        probe = "It's Só 12 ße, ÄÖÜ!! don't [x]~ İ\n\tŒuvre"
        self._by_word = b"".join(map(self._words.__getitem__, self._plain(probe).split())) == self._whole(probe)

    @staticmethod
    def _plain(text: str) -> str:
        return unicodedata.normalize("NFC", text).lower()

    def _piece(self, piece: str) -> bytes:
        mapped = "".join([self._alphabet[b] for b in piece.encode()])
        ids = [t.id for t in self._lib.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        return b"".join([self._pieces[p] for p in self._find(word)])

    def _whole(self, text: str) -> bytes:
        ids = self._lib.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def packed(self, text: str) -> bytes:
        """The ids of a text and the end id, 4 little-endian bytes each."""
        if self._by_word and _SIMPLE(text) and not any(s in text for s in self._special):
            return b"".join(map(self._words.__getitem__, self._plain(text).split())) + self._tail
        return self._whole(text) + self._tail


_ready: dict[tuple, WordIds] = {}


def word_ids(path: str, end_id: int | None) -> WordIds:
    key = (resolve(path), end_id)
    if key not in _ready:
        _ready[key] = WordIds(*key)
    return _ready[key]


def pieces(docs: DataFrame, path: str, end_id: int | None, size: int) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: full sequences and a remainder of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_ids(path, end_id)
        for b in batches:
            at, starts, lengths, crcs, totals = [], [], [], [], []
            for row, t in enumerate(b.column(1)):
                data = enc.packed(t.as_py() or "")
                n = len(data) // 4
                for s in range(0, n, size):
                    part = data[4 * s : 4 * (s + size)]
                    at.append(row)
                    starts.append(s)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    totals.append(n)
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(count, lengths)`` that hold ``counts`` (length -> pieces), by shortest-pack-first.

    Lengths go longest first. Each is put into the packs with the most room as
    long as they have enough of it, then into packs of their own. At most two
    patterns come of each placement, so the patterns are bounded by ``size``
    and not by the pieces.
    """
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    emptiest = 0

    def put(free: int, pattern: tuple[int, ...], n: int) -> None:
        nonlocal emptiest
        room[free][pattern] = room[free].get(pattern, 0) + n
        emptiest = max(emptiest, free)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"no sequence of {size} holds a piece of {length}")
        left = counts[length]
        while left:
            while emptiest and not room.get(emptiest):
                room.pop(emptiest, None)
                emptiest -= 1
            if emptiest >= length:
                pattern, n = room[emptiest].popitem()
                free = emptiest
                # several of this length in one pack, as deep as there is need and room
                used = min(left, n)
                if n > used:
                    room[free][pattern] = n - used
                put(free - length, (*pattern, length), used)
            else:
                used = left
                fit = min(size // length, used)
                whole, rest = divmod(used, fit)
                put(size - fit * length, (length,) * fit, whole)
                if rest:
                    put(size - rest * length, (length,) * rest, 1)
            left -= used
    return [(n, pattern) for free in sorted(room) for pattern, n in sorted(room[free].items(), reverse=True)]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length: where its rank intervals begin, their first sequence, their offset in it."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
    filled: dict[int, int] = defaultdict(int)
    base = 0
    for n, pattern in patterns:
        offset = 0
        for length in pattern:
            begins, firsts, offsets = out[length]
            begins.append(filled[length])
            firsts.append(base)
            offsets.append(offset)
            filled[length] += n
            offset += length
        base += n
    return dict(out)


def pack(docs: DataFrame, path: str = "word_bpe_49k.json", end_id: int | None = 1, size: int = 2048) -> DataFrame:
    """One row for each piece of ``docs(doc_id, text)``: where it lies among the packed sequences.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A null text counts as empty and has its end id alone. Repeated rows are
    documents of their own. Ties within a length are ranked by bucket, doc_id
    and start. An empty table gives an empty result; other columns are ignored.
    The driver gets the histogram (at most ``size`` rows) and sends back the
    slots, whose number is bounded by ``size`` too.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = scratch.save(pieces(docs, path, end_id, size), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    buckets = max(1, -(-total // BUCKET_ROWS))
    table = slots(pack_histogram(counts, size))

    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # at most buckets rows for a length
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("in_bucket", F.row_number().over(within) - 1).join(sizes, ["length", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_rank") + F.col("in_bucket")).alias("rank"))

    arrays = {k: tuple(np.asarray(x, dtype=np.int64) for x in v) for k, v in table.items()}
    sent = spark.sparkContext.broadcast(arrays)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(2).to_numpy()
            rank = b.column(5).to_numpy()
            seq = np.zeros(len(length), dtype=np.int64)
            off = np.zeros(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                begins, firsts, offsets = sent.value[int(length[part[0]])]
                k = np.searchsorted(begins, rank[part], side="right") - 1
                seq[part] = firsts[k] + rank[part] - begins[k]
                off[part] = offsets[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
