"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are character n-grams of the lower-cased text. Each is hashed to a row
of an embedding table; a text is the average of its rows, and a linear layer
with softmax gives the languages. Training is stochastic gradient descent in
numpy on a bounded sample of labelled documents, whose whole texts reach the
driver as bucket counts. Two things are then fitted on a part of the sample kept
out of training: a temperature that calibrates the scores, and the least margin
between the two best languages, below which a text is rejected. It lies between
shares of what the kept-out texts reach, as high as random letters require.

Embeddings are averaged and the layer above is linear, so prediction needs one
number for each n-gram and language. The n-grams of a block of texts are hashed
and summed by array operations; memory is one block's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from warpline.plans.scratch import pick

ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 15
DIM = 16
#: Training documents of each language, about.
SAMPLE_PER_LANG = 400
EPOCHS = 12
#: Share of uncertainty in the labels that calibration assumes.
DOUBT = 0.01
#: Share of correct calibration documents that rejection may cost.
REJECT_SHARE = 0.001
#: Least and most part of that quantile's margin that a text must reach; the margins of NOISE random texts decide between them.
REJECT_FROM, REJECT_TO = 0.5, 0.8
NOISE = 200
#: Characters times languages of a block of texts, about; its arrays take 16 bytes for each.
_BLOCK = 1 << 21
_has_letter = regex.compile(r"\p{L}").search
_spaces = regex.compile(r"[^\p{L}\p{M}]+")


@dataclass
class LanguageModel:
    """``weights[bucket, lang]`` is embedding times layer; ``bias`` belongs to the layer."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def _codes(text: str) -> np.ndarray:
    """Code points of a lower-cased text, runs of anything but letters and marks as one space, padded."""
    clean = " " + _spaces.sub(" ", text.lower()).strip() + " "
    return np.frombuffer(clean.encode("utf-32-le", "replace"), dtype="<u4")


def _hashed(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each position."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int32)
    h = np.full(n, (order * 0x9E3779B1) & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(order):
        h ^= codes[k : k + n]
        h *= np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


def buckets(text: str) -> np.ndarray:
    codes = _codes(text)
    return np.concatenate([_hashed(codes, o) for o in ORDERS])


def shares_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets and their shares: at most 2**BUCKET_BITS numbers, whatever the length."""
    u, c = np.unique(buckets(text), return_counts=True)
    return u.astype(np.int32), (c / max(1, c.sum())).astype(np.float32)


def _noise(rng: np.random.Generator) -> list[str]:
    """Texts of random letters a-z."""
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    return [" ".join("".join(rng.choice(letters, size)) for size in rng.integers(2, 10, 60)) for _ in range(NOISE)]


def train(docs: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 7) -> LanguageModel:
    """A model of labelled texts, given by ``shares_of``; deterministic.

    One label alone gives a model that always answers it.
    """
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], dtype=np.int64)
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    emb = rng.normal(0, 1 / DIM, (size, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(names)), dtype=np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    order = rng.permutation(len(docs))
    cal, fit = order[: len(docs) // 5], order[len(docs) // 5 :]
    steps, total = 0, EPOCHS * max(1, len(fit))
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            rate = 0.5 * (1 - steps / total)
            steps += 1
            u, share = docs[i]
            if not len(u):
                continue
            hidden = share @ emb[u]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            emb[u] -= (rate * len(u) ** 0.5) * share[:, None] * back[None, :]
    weights = (emb @ out).astype(np.float32)
    z = np.array([(docs[i][1] @ weights[docs[i][0]] if len(docs[i][0]) else np.zeros(len(names))) + bias for i in cal]).reshape(len(cal), len(names))

    def shares(temperature: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
        return e / e.sum(axis=1, keepdims=True)

    temperature, threshold = 1.0, 0.0
    if len(cal) and len(names) > 1:
        grid = np.geomspace(0.01, 20, 120)
        # against slightly uncertain targets, so that a sample without an error has a best temperature too
        target = (1 - DOUBT) * np.eye(len(names))[y[cal]] + DOUBT / len(names)
        loss = [-(target * np.log(np.maximum(shares(t), 1e-300))).sum(axis=1).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        right = z.argmax(axis=1) == y[cal]
        if right.any():
            margin = np.diff(np.sort(z, axis=1)[:, -2:], axis=1)[:, 0]
            least = float(np.quantile(margin[right], REJECT_SHARE))
            noise = [weights[u].T @ share + bias for u, share in map(shares_of, _noise(rng))]
            false = float(np.quantile(np.diff(np.sort(noise, axis=1)[:, -2:], axis=1), 0.95))
            threshold = min(max(REJECT_FROM * least, false), REJECT_TO * least)
    return LanguageModel(names, weights, bias, temperature, threshold)


def predict(model: LanguageModel, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """(language, probability, rejected) of each text; ``und``, 0 and rejected where there is no letter."""
    n, k = len(texts), len(model.langs)
    sums = np.zeros((n, k))
    counts = np.zeros(n)
    letters = [bool(t) and _has_letter(t) is not None for t in texts]
    at = 0
    block = max(1 << 12, _BLOCK // max(1, k))
    while at < n:
        # a block of whole texts; one long text is cut where order - 1 characters are seen twice
        group, chars = [], 0
        while at < n and (not group or chars + len(texts[at] or "") <= block):
            if letters[at]:
                group.append(at)
                chars += len(texts[at])
            at += 1
        if not group:
            continue
        codes = [_codes(texts[i]) for i in group]
        for i, c in zip(group, codes) if len(group) == 1 else [(None, None)]:
            if c is None:
                break
            for o in ORDERS:
                for s in range(0, max(1, len(c) - o + 1), block):
                    h = _hashed(c[s : s + block + o - 1], o)
                    sums[i] += model.weights[h].sum(axis=0, dtype=np.float64)
                    counts[i] += len(h)
        if len(group) > 1:
            joined = np.concatenate(codes)
            ends = np.cumsum([len(c) for c in codes])
            begins = ends - [len(c) for c in codes]
            total = np.zeros((len(joined) + 1, k), dtype=np.float64)
            for o in ORDERS:
                h = _hashed(joined, o)
                np.cumsum(model.weights[h], axis=0, dtype=np.float64, out=total[1 : len(h) + 1])
                last = np.maximum(ends - o + 1, begins)
                sums[group] += total[last] - total[begins]
                counts[group] += last - begins
    z = sums / np.maximum(counts, 1)[:, None] + model.bias
    e = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
    p = e / e.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    margin = np.diff(np.sort(z, axis=1)[:, -2:], axis=1)[:, 0] if k > 1 else np.ones(n)
    return [(model.langs[b], float(p[i, b]), bool(margin[i] < model.threshold)) if letters[i] else ("und", 0.0, True) for i, b in enumerate(best)]


def fold(mod: int) -> Column:
    """crc32 of doc_id as text, modulo ``mod``; the row without doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def _arrays(lists: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The rows of a column of lists, as views of its memory and not as Python numbers."""
    for chunk in lists.chunks:
        values = chunk.values.to_numpy()
        for a, b in pairwise(chunk.offsets.to_pylist()):
            yield values[a:b]


def labelled_sample(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """About ``per_lang`` rows (lang, buckets, shares) of each language, by a hash of doc_id.

    The driver gets at most twice ``per_lang`` rows for each language, each of
    bounded size. Every language is learned; their number is that of the model's
    classes, which all tasks hold.
    """
    rows = pick(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
    seen = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_lang)) / F.count(F.lit(1))).alias("_share"))
    seen = docs.sparkSession.createDataFrame(seen.collect(), seen.schema)
    langs = seen.count()
    if not langs:
        return []
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 24)) / F.lit(float(1 << 24))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shares_of(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([u for u, _ in got], pa.list_(pa.int32())), pa.array([c for _, c in got], pa.list_(pa.float32()))], names=["doc_id", "lang", "at", "share"])

    cut = rows.join(F.broadcast(seen), "lang").where(draw < F.col("_share")).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    got = cut.mapInArrow(features, "doc_id long, lang string, at array<int>, share array<float>").limit(2 * per_lang * langs).toArrow()
    found = list(zip(got.column("lang").to_pylist(), _arrays(got.column("at")), _arrays(got.column("share")), got.column("doc_id").to_pylist()))
    found.sort(key=lambda r: (r[3] is None, r[3] or 0, r[0], len(r[1])))
    return [r[:3] for r in found]


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> LanguageModel | None:
    """A model of ``docs(doc_id, text, lang)``, or None where nothing is labelled."""
    got = labelled_sample(docs, per_lang)
    return train([(u, c) for _, u, c in got], [x for x, _, _ in got]) if got else None


def _tagged(plain: DataFrame, at: int, model: LanguageModel | None) -> DataFrame:
    """``plain`` with columns lang_pred, score and rejected at its end; column ``at`` is the text."""
    sent = plain.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = b.column(at).to_pylist()
            got = predict(m, texts) if m is not None and texts else [("und", 0.0, True)] * len(texts)
            cols = list(zip(*got)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected added; every row is read whole.

    A null text, or one without a letter, is ``und`` with score 0 and rejected;
    so is every row where there is no model. Columns of these names in ``docs``
    are replaced. Repeated rows give repeated results.
    """
    new = ("lang_pred", "score", "rejected")
    kept = [n for n in docs.columns if n not in new]
    rows = pick(docs, *kept)
    return _tagged(rows, kept.index("text"), model)


def language_id(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` of every row of ``docs(doc_id, text, lang)``.

    Learns from rows with text and lang whose crc32(doc_id) mod 4 is not 2; the
    others are held out. Only the text decides a prediction.
    """
    rows = pick(docs, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(rows.where(fold(4) != 2))
    out = identify(rows.select("doc_id", (fold(4) == 2).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def crc_fold(doc_id: int | None, mod: int) -> int:
    """``fold`` of one id, for tests."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that language ID rejects; columns as before, whatever their names."""
    names = docs.columns
    model = fit(docs)
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    kept = _tagged(plain, names.index("text"), model).where("not rejected")
    return kept.select(*plain.columns).toDF(*names)
