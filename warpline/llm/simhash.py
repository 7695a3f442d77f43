"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64-bit majorities over XXH64 word shingles. Two fingerprints
link when at most ``radius`` bits differ. Candidates come from a *covering*
family of masks: every bit position gets a non-zero vector of GF(2)^(radius+1),
and for each non-zero ``v`` of that space one table keeps the bits whose vector
is not orthogonal to ``v``. The vectors of any ``radius`` positions span at most
``radius`` dimensions, so some ``v`` is orthogonal to all of them and its table
ignores exactly those bits: every pair within the radius collides somewhere,
with certainty. With radius 4 there are 31 tables of about 32 kept bits.

Work is done on distinct fingerprints. In a bucket every member is compared
with one leader, then union-find runs, and only members outside a bucket's
largest component are compared with the rest of it. Every pair of a bucket is
thus either compared or already in one component, so no link that matters is
lost, and a bucket of thousands of copies costs one comparison for each.

Joins of buckets are merged by a hint. Spark takes the members, a row for each
fingerprint and table, to be as small as the fingerprints' file, and would send
them all to the driver to broadcast them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.llm.components import components
from warpline.plans.scratch import Scratch, bounded, pick

BITS = 64
_BLOCK = 1 << 16


def masks(radius: int) -> list[int]:
    """The covering family: one 64-bit mask of kept bits for each non-zero vector."""
    n = (1 << (radius + 1)) - 1
    vector = [1 + i % n for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, width: int = 4) -> int:
    """The unsigned fingerprint of one text; zero where there is no word.

    Memory holds the shingle hashes of one block at a time, whatever the length.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(line, 42)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = len(words) - width + 1
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, _BLOCK):
        m = min(n, k + _BLOCK)
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(line[a : b - 1], 42) for a, b in zip(starts[k:m], starts[k + width : m + width])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs(doc_id, text)``; ``fp`` is the signed 64-bit fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t.as_py(), width)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fp long")


def linked(fps: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """``(fp, root)`` of every distinct fingerprint of ``fps(fp)`` that links to another one."""
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks(radius)])
    members = fps.select("fp", F.posexplode(keys).alias("t", "k"))
    salt = F.xxhash64("t")
    leaders = members.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("fp").bitwiseXOR(salt)).alias("m")).where("n > 1")
    leaders = leaders.select("t", "k", F.col("m").bitwiseXOR(salt).alias("leader"))
    rows = scratch.save(members.join(leaders.hint("merge"), ["t", "k"]), "buckets")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    first = rows.where((F.col("fp") != F.col("leader")) & near(F.col("fp"), F.col("leader"))).select(F.col("fp").alias("a"), F.col("leader").alias("b"))
    roots = components(first, scratch)

    labels = bounded(roots.select(F.col("node").alias("fp"), "root"))
    labelled = rows.select("t", "k", "fp").join(labels, "fp", "left")
    labelled = scratch.save(labelled.select("t", "k", "fp", F.coalesce("root", "fp").alias("root")), "labelled")
    sizes = labelled.groupBy("t", "k", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("t", "k").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "k", "main")
    open_ = scratch.save(labelled.join(main.hint("merge"), ["t", "k"]), "open")
    few = open_.where("root <> main").select("t", "k", F.col("fp").alias("f1"), F.col("root").alias("a"))
    all_ = open_.select("t", "k", F.col("fp").alias("f2"), F.col("root").alias("b"))
    second = scratch.save(few.join(all_.hint("merge"), ["t", "k"]).where((F.col("a") != F.col("b")) & near(F.col("f1"), F.col("f2"))).select("a", "b").distinct(), "second")
    merged = components(second, scratch)
    # a single fingerprint gains its root only in the second pass
    alone = second.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(labels.select("fp"), "fp", "left_anti")
    known = roots.select(F.col("node").alias("fp"), "root").unionByName(alone.select("fp", F.col("fp").alias("root")))
    up = bounded(merged.select(F.col("node").alias("root"), F.col("root").alias("up")))
    out = scratch.save(known.join(up, "root", "left").select("fp", F.coalesce("up", "root").alias("root")), "linked")
    scratch.drop(rows, roots, labelled, open_, second, merged)
    return out


def _classes(rows: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """``(fp, root, component_id)`` of every distinct ``fp`` of written ``rows(doc_id, fp)``; ``root`` tells components apart."""
    classes = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = bounded(linked(classes.select("fp"), radius, scratch))
    in_root = classes.join(roots, "fp")
    least = in_root.groupBy("root").agg(F.min("first").alias("least"))
    grouped = in_root.join(least, "root").select("fp", "root", "least")
    return classes.join(grouped, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"))


def simhash_components(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest
    doc_id reachable over links, itself included. A null or empty text has the
    zero fingerprint and links like any other. Equal texts share a fingerprint
    and so a component; repeated rows give repeated result rows. A row without
    doc_id gets its component's id, which is null if no member has one. An
    empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, width), "fps")
    out = bounded(rows).join(_classes(rows, radius, scratch).drop("root"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """``docs`` with the row of smallest doc_id of each component and no other row.

    All columns stay. A row is known by its doc_id and text: rows of one doc_id
    and different texts are judged by themselves, and of several in one component
    one stays. Equal rows count as one. Rows without doc_id have no identity to
    compare and all stay. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "keepone")
    doc, text = f"_{docs.columns.index('doc_id')}", f"_{docs.columns.index('text')}"
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    plain = plain.withColumns({"_wl_1": F.xxhash64(text), "_wl_2": F.xxhash64(F.col(text), F.lit(1))})
    texts = plain.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), "_wl_1", "_wl_2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t.as_py(), width)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(fps, pa.int64())], names=["doc_id", "_wl_1", "_wl_2", "fp"])

    rows = scratch.save(texts.mapInArrow(run, "doc_id long, _wl_1 long, _wl_2 long, fp long"), "fps")
    first = bounded(rows).join(_classes(rows, radius, scratch), "fp").where("doc_id = component_id")
    first = first.groupBy("root").agg(F.min(F.struct("doc_id", "_wl_1", "_wl_2")).alias("row")).select(F.col("row.doc_id").alias("_wl_id"), "row._wl_1", "row._wl_2").distinct()
    once = plain.dropDuplicates([doc, "_wl_1", "_wl_2"]).withColumn("_wl_id", F.col(doc).cast("long")).join(first, ["_wl_id", "_wl_1", "_wl_2"], "left_semi")
    none = plain.where(F.col(doc).isNull())
    return once.select(*plain.columns).unionByName(none).drop("_wl_1", "_wl_2").toDF(*docs.columns)
