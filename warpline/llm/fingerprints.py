"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A sketch is the ``k`` smallest distinct 64-bit shingle hashes of a text, in
order. The sketch of a union is the bottom ``k`` of the sketches' union, so
parts merge in any order; two sketches give estimates of resemblance,
containment and the number of distinct shingles.

``neighbour_fingerprints`` compares each text with an edited one, whose end
comes from the next document by descending doc_id. Documents are dealt by
ranges of doc_id; the first document of a range also travels to the range that
comes before it, so each task finds every neighbour among its own rows and the
texts are shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from warpline.llm.bpe import _Words
from warpline.plans.scratch import pick

K = 128
WIDTH = 5
#: Rows of one range, about, and the most ranges (their cuts go to the driver and back).
RANGE_ROWS = 2048
MAX_RANGES = 1 << 16
#: Keys whose sketches a task merges at a time.
HELD = 20_000
_words = _Words(lambda w: xxhash.xxh64_intdigest(w, 42), 300_000)


def sketch(text: str | None, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The bottom-k sketch of a text, ascending uint64.

    A-Z count as a-z and words are what ASCII white space parts. Fewer words
    than ``width`` make one shingle; a null text or one without words has the
    empty sketch.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.array(list(map(_words.__getitem__, words)), dtype=np.uint64)
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += w[i : i + len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    if len(h) > 8 * k:  # repeats may be among the smallest; look again at all where too few are left
        low = np.unique(np.partition(h, 4 * k)[: 4 * k])
        if len(low) > k:
            return low[:k]
    return np.unique(h)[:k]


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of the texts' shingles."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.zeros(0, dtype=np.uint64)


def distinct_shingles(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact where the sketch is not full."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[k - 1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles in the union; 1 for two empty sketches, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k=k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty ``a``."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    return min(1.0, j * (na + nb) / (1 + j) / na)


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def from_text(t: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(t), dtype=">u8").astype(np.uint64)


def document_sketches(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """``(doc_id, sketch array<long>)`` of every row of ``docs(doc_id, text)``; longs hold the unsigned hashes' bits, less 2**63, so that they sort alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [(sketch(t.as_py(), k, width) ^ np.uint64(1 << 63)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.list_(pa.int64()))], names=["doc_id", "sketch"])

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, sketch array<long>")


def merge_sketches(rows: DataFrame, key: str, k: int = K) -> DataFrame:
    """``(key, sketch)``: the merged sketch of each key of ``rows(key, sketch)``.

    Tasks merge their own rows first, up to ``HELD`` keys at a time, so that a hot
    key costs ``k`` hashes or little more from each task. A null sketch counts as empty.
    """
    kind = StructType([rows.schema[key], StructField("sketch", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def ended(column: pa.DataType) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), column), pa.array(list(held.values()), pa.list_(pa.int64()))], names=[key, "sketch"])
            held.clear()
            return out

        column = None
        for b in batches:
            column = b.column(0).type
            for name, s in zip(b.column(0).to_pylist(), b.column(1)):
                new = s.values.to_numpy() if s.is_valid else np.zeros(0, dtype=np.int64)
                held[name] = np.unique(np.concatenate([held[name], new]))[:k] if name in held else new
                if len(held) > HELD:
                    yield ended(column)
        if held:
            yield ended(column)

    part = rows.select(key, "sketch").mapInArrow(run, kind)
    names = part.select(key).distinct()
    h = part.select(key, F.explode("sketch").alias("h")).distinct()
    low = h.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("r") <= k)
    merged = low.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias("sketch")).withColumnRenamed(key, "_key")
    return names.join(merged, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce("sketch", F.array().cast("array<bigint>")).alias("sketch"))


def _search(cuts: list[int], x: Column) -> Column:
    """How many of the ascending ``cuts`` are at most ``x``, by halving."""
    if not cuts:
        return F.lit(0)
    table = F.from_json(F.lit(str(cuts)), "array<bigint>")
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    step = lambda at, s: F.when((at + s <= len(cuts)) & (F.get(table, at + s - 1) <= x), at + s).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def neighbour_fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Each text's fingerprint beside its edited text's and its next document's.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has its last floor(n_chars / 2) code
    points replaced by the first as many (or all) of the next document, by
    descending doc_id; after the last comes the first, and a single document
    follows itself. Null texts count as empty. Rows with equal doc_id follow one
    another by text; rows without doc_id come last. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    n = rows.count()
    ranges = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    cuts: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(rows.agg(F.percentile_approx("key", shares, 4 * ranges).alias("c")).first()["c"]))
    rows = rows.withColumn("range", _search(cuts, F.col("key")))
    heads = {r["range"]: r["head"] for r in rows.groupBy("range").agg(F.max("key").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    of = lambda d: F.get(F.from_json(F.lit(str([d.get(i, -1) for i in range(len(cuts) + 1)])), "array<bigint>"), F.col("range"))
    own = F.struct(F.col("range").cast("long").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(of(before).alias("range"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("to", F.explode(F.when(F.col("key") == of(heads), F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select("to.range", "to.guest", "key", "doc_id", "text").repartition(len(cuts) + 1, "range")
    dealt = dealt.sortWithinPartitions("range", "guest", F.desc("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last = None
        out: list[tuple] = []
        for b in batches:
            for rng, guest, doc, text in zip(b.column(0), b.column(1), b.column(3), b.column(4)):
                rng, guest, doc, text = rng.as_py(), guest.as_py(), doc.as_py(), text.as_py()
                if last is not None and last[0] == rng and last[1] and guest:
                    continue  # rows that tie with the head of the next range: the first was it
                s = sketch(text, k, width)
                if last is not None and last[0] == rng and not last[1]:
                    out.append(_compare(last, text, s, k, width))
                last = (rng, guest, doc, text, s)
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
            out = []

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compare(row: tuple, next_text: str, next_sketch: np.ndarray, k: int, width: int) -> tuple:
    _, _, doc, text, s = row
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    e = sketch(edited, k, width)
    sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
    return doc, len(text), sha, to_text(s), to_text(e), resemblance(s, e, k), resemblance(s, next_sketch, k)
