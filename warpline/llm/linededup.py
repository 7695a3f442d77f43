"""Fuzzy line dedup by MinHash over character shingles, in DataFrame operations alone.

1. A line's shingles are its runs of ``SHINGLE`` UTF-16 units, lower-cased, one
   from every position on; a shorter line is one shingle. Each is hashed in
   generated code. One-permutation MinHash: a hash falls into one of ``BANDS *
   ROWS`` bins, and each bin's minimum is part of the signature. Of a long line
   only the smallest hashes, ``KEPT`` or more of them, can be minima, so the others
   stop before the bins.
2. Equal lines meet by a 128-bit hash; map tasks combine them first, so a line
   that a third of the documents share is one row for each task. No text is
   shuffled for this.
3. ``ROWS`` bins make a band. At similarity 0.8 a pair shares one of the bands with
   probability 0.999. In a bucket every line is compared with one leader, so
   candidates grow with the rows and not with the square of a group. A pair whose
   signatures agree in fewer than ``AGREE`` bins is not compared (at similarity 0.8:
   0.0004 of the pairs). Maps of the places that the shingles' hashes take then
   bound a pair's similarity from above, which loses no pair and rules most out. Of
   the others the exact Jaccard similarity of their shingle sets, made from the
   texts, decides.
4. Union-find joins links. In a bucket that still holds several components, the
   lines outside its largest one are compared with that one's most
   central members. Then what is still outside is paired with all others: directly in a
   bucket of at most ``SMALL`` members, so that pairs grow with the rows, and in a
   larger one by a prefix filter. For that, lines' shingles are ordered by their
   count; a pair at the similarity must share one among the first
   ``n - ceil(0.8 n) + 1`` of each, at places that leave room for the overlap. So
   every pair of a bucket is compared, ruled out by a bound, or already joined.
5. Of each component the occurrence of smallest (doc_id, line number) is kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpline.llm.components import components, extended
from warpline.plans.scratch import Scratch, pick

SHINGLE = 12
BANDS, ROWS = 7, 2
#: Hashes of a line, or more, among which the bins' minima are sought.
KEPT = 64
#: Bins of BANDS * ROWS in which a pair's signatures must agree before it is compared.
AGREE = 6
SIMILARITY = 0.8
#: Central members of a component that lines outside it are compared with before all others.
HUBS = 8
#: Members of a bucket up to which its pairs are made directly; beyond, by the prefix filter. Neither loses a pair.
SMALL = 64
#: Words of a line's map of places, a power of two.
WORDS = 32
#: Shingles that a task compares at a time, about.
TASK_SHINGLES = 2_000_000
#: Shingles of a pair of lines up to which they are compared as arrays; beyond, as rows. Both are exact.
ARRAY_SHINGLES = 1 << 18
#: Rows of a written table up to which a join sends it whole; a larger one sends a map of its keys first.
WHOLE_ROWS = 100_000
#: Written tables are broadcast up to this many rows; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_LINE_BASE = 1 << 32
_LAST = (1 << 63) - 1
#: White space that ends of lines lose.
SPACES = " \t\r\x0b\x0c"
_BINS = [f"m{j}" for j in range(BANDS * ROWS)]


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, t1, t2, line_no, h1, h2, line)`` of every line with a character besides white space; ``t1, t2`` tell the text."""
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    loose = reduce(Column.bitwiseOR, [F.startswith("line", F.lit(c)).cast("int") for c in SPACES] + [F.endswith("line", F.lit(c)).cast("int") for c in SPACES]) > 0
    rows = rows.withColumn("line", F.when(loose, F.btrim("line", F.lit(SPACES))).otherwise(F.col("line"))).where("line <> ''")
    return rows.select("doc_id", "t1", "t2", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), "line")


def _place(doc_id: Column, line_no: Column) -> Column:
    """An occurrence as one number that orders like (doc_id, line_no); a missing doc_id comes last."""
    return F.coalesce(doc_id, F.lit(_LAST)).cast("decimal(20,0)") * F.lit(_LINE_BASE).cast("decimal(11,0)") + line_no.cast("decimal(11,0)")


def _units(line: Column) -> Column:
    """The lower-cased line in two bytes for each unit."""
    return F.encode(F.lower(line), "UTF-16BE")


def _count(units: Column) -> Column:
    """Number of shingles, repeats included."""
    return F.greatest(F.lit(1), (F.length(units) / 2).cast("int") - (SHINGLE - 1))


def _hash(units: Column, i: Column) -> Column:
    """Hash of the shingle that starts at unit ``i``, from 1."""
    return F.xxhash64(F.substring(units, i * 2 - 1, F.lit(2 * SHINGLE)))


def _signatures(lines: DataFrame) -> DataFrame:
    """``(id, h1, h2, first, n, m0...)`` of each distinct line: its first place, shingle count and the bins' minima."""
    rows = lines.select("h1", "h2", _place(F.col("doc_id"), F.col("line_no")).alias("place"), _units(F.col("line")).alias("u"))
    rows = rows.withColumn("n", _count(F.col("u")))
    rows = rows.withColumn("cut", F.greatest(F.lit(0), F.floor(F.log2(F.col("n") / KEPT)).cast("int")))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    # unsigned order: the small hashes are those whose first ``cut`` bits are zero;
    # the filter goes below the hash, so it hashes by itself, and only where lines are long
    rows = rows.withColumn("h", _hash(F.col("u"), F.col("i")))
    small = F.expr("cut = 0 or shiftrightunsigned(h, 64 - cut) = 0")
    rows = rows.where((F.col("cut") == 0) | (F.col("i") == 1) | small)
    rows = rows.withColumn("z", F.when(small, F.expr(f"cast(shiftright((h & 16777215) * {len(_BINS)}, 24) as int)")).otherwise(F.lit(-1)))
    rows = rows.withColumn("v", F.expr(f"cast(shiftright(h ^ {-(1 << 63) + 1}L ^ 1L, 32) as int)"))
    mins = [F.expr(f"min(v) filter (where z = {j})").alias(m) for j, m in enumerate(_BINS)]
    found = rows.groupBy("h1", "h2").agg(F.expr("min(place) filter (where i = 1)").alias("first"), F.max("n").alias("n"), *mins)
    return found.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "first", "n", *_BINS)


def _keys() -> Column:
    """The band keys of a signature; a band without any shingle has none."""
    bands = [_BINS[b * ROWS : (b + 1) * ROWS] for b in range(BANDS)]
    return F.array_compact(F.array(*[F.when(F.coalesce(*own).isNotNull(), F.xxhash64(F.lit(b), *own)) for b, own in enumerate(bands)]))


def _agree(a: str, b: str) -> Column:
    """Whether two signatures agree in enough bins; two empty bins do."""
    return reduce(Column.__add__, [F.col(f"{a}.{m}").eqNullSafe(F.col(f"{b}.{m}")).cast("int") for m in _BINS]) >= AGREE


def _maps(texts: DataFrame) -> DataFrame:
    """``(id, n, w0...)``: which of ``64 * WORDS`` places the hashes of a line's shingles take."""
    each = texts.select("id", "n", _units(F.col("line")).alias("u")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    each = each.select("id", "n", _hash(F.col("u"), F.col("i")).alias("h"))
    each = each.select("id", "n", F.expr(f"cast(shiftright(h, 6) & {WORDS - 1} as int)").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    return each.groupBy("id").agg(F.max("n").alias("n"), *[F.expr(f"coalesce(bit_or(bit) filter (where w = {j}), 0L)").alias(f"w{j}") for j in range(WORDS)])


def _of(pairs: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``lines(id, ...)`` that ``pairs(a, b)`` name, so that no others are shuffled to join them."""
    named = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "named")
    return lines.join(_small(named), "id", "left_semi")


def _close(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs ``(a, b, n1, n2)`` whose maps of places allow ``SIMILARITY``.

    A place that one line takes and the other does not is at least one shingle of
    the one alone. So ``x`` and ``y`` such places bound the similarity by
    ``(n - x) / (n + y)`` with the first line's count ``n``, and likewise by the second's.
    """
    side = lambda x: maps.select(F.col("id").alias(x), F.struct("n", *[f"w{j}" for j in range(WORDS)]).alias(f"m_{x}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    alone = lambda x, y: reduce(Column.__add__, [F.bit_count(F.col(f"{x}.w{j}").bitwiseAND(F.bitwise_not(F.col(f"{y}.w{j}")))) for j in range(WORDS)])
    both = both.select("a", "b", F.col("m_a.n").alias("n1"), F.col("m_b.n").alias("n2"), alone("m_a", "m_b").alias("x"), alone("m_b", "m_a").alias("y"))
    return both.where("n1 - x >= {0} * (n1 + y) - 1e-6 and n2 - y >= {0} * (n2 + x) - 1e-6".format(SIMILARITY)).drop("x", "y")


def _verified(pairs: DataFrame, texts: DataFrame, maps: DataFrame, scratch: Scratch) -> DataFrame:
    """The ``(a, b)`` of distinct pairs whose lines' shingle sets reach ``SIMILARITY``; ``texts(id, line, n)``.

    Pairs that ``_close`` leaves are dealt out so that a task has about ``TASK_SHINGLES`` to count.
    """
    pairs = scratch.save(_close(pairs, _of(pairs, maps, scratch)), "close")
    texts = _of(pairs, texts, scratch)
    side = lambda x: texts.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"), F.col("n").alias(f"n_{x}"))
    sizes = pairs.agg(F.sum(F.col("n1") + F.col("n2")).alias("all"), F.max(F.col("n1") + F.col("n2")).alias("most")).first()
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").repartition(1 + (sizes["all"] or 0) // TASK_SHINGLES, "a", "b")
    both = both.select("a", "b", _units(F.col("line_a")).alias("x"), _units(F.col("line_b")).alias("y"), "n_a", "n_b")
    if (sizes["most"] or 0) <= ARRAY_SHINGLES:
        return _by_arrays(both)
    short = F.col("n_a") + F.col("n_b") <= ARRAY_SHINGLES
    return _by_arrays(both.where(short)).unionByName(_by_rows(both.where(~short)))


def _by_arrays(both: DataFrame) -> DataFrame:
    """The ``(a, b)`` of ``both(a, b, x, y, n_a, n_b)`` that reach ``SIMILARITY``; a line's hashes are one array.

    The outer function holds the units, which the optimizer would else make anew for each shingle.
    """
    hashes = lambda u, n: F.get(F.transform(F.array(F.col(u)), lambda v: F.transform(F.sequence(F.lit(1), F.col(n)), lambda i: _hash(v, i))), F.lit(0))
    sets = both.select("a", "b", hashes("x", "n_a").alias("x"), hashes("y", "n_b").alias("y"))
    sizes = sets.select("a", "b", F.size(F.array_union("x", "y")).alias("any"), F.size(F.array_intersect("x", "y")).alias("common"))
    return sizes.where(F.col("common") / F.col("any") >= SIMILARITY).select("a", "b")


def _by_rows(both: DataFrame) -> DataFrame:
    """What ``_by_arrays`` does, a row for each shingle, so that lines of any length fit a task's memory."""
    each = both.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n_a") + F.col("n_b"))))
    first = F.col("i") <= F.col("n_a")
    each = each.select("a", "b", _hash(F.when(first, F.col("x")).otherwise(F.col("y")), F.when(first, F.col("i")).otherwise(F.col("i") - F.col("n_a"))).alias("h"), F.when(first, 1).otherwise(2).alias("side"))
    sets = each.groupBy("a", "b", "h").agg(F.bit_or("side").alias("sides"))
    sizes = sets.groupBy("a", "b").agg(F.count(F.lit(1)).alias("any"), F.sum(F.when(F.col("sides") == 3, 1).otherwise(0)).alias("common"))
    return sizes.where(F.col("common") / F.col("any") >= SIMILARITY).select("a", "b")


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its row count is within the bound."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _joined(rows: DataFrame, table: DataFrame, on: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` joined with a written ``table`` that few of them match, so that neither all rows are shuffled nor the table goes to the driver.

    A map with 16 bits for each of the table's rows, in words of 64, is broadcast; the rows that it
    lets through, some of them wrongly, are joined by a shuffle. A small table is broadcast, and a map beyond the bound is not made.
    """
    n = table.count()
    if n <= WHOLE_ROWS or n > BROADCAST_ROWS:
        return rows.join(_small(table), on)
    words = n // 4
    key = F.xxhash64(*on)
    word, bit = F.pmod(key, F.lit(words)).cast("int"), F.expr(f"shiftleft(1L, cast(shiftright(xxhash64({', '.join(on)}), 40) & 63 as int))")
    taken = scratch.save(table.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits")), "map")
    through = rows.withColumn("_word", word).join(F.broadcast(taken), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")
    return through.join(table.hint("merge"), on)


def _open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, but for the leaders, of buckets where these are of several components: ``main`` is the largest one, ``rows`` the number of members."""
    labelled = buckets.where("members > 2 and id <> leader").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = labelled.groupBy("k", "root").agg(F.count(F.lit(1)).alias("rows"))
    main = sizes.groupBy("k").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows")).where("parts > 1")
    return labelled.join(main.select("k", "main", "rows"), "k").select("k", "id", "n", "root", "main", "rows", "sig")


def _to_hubs(open_: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs ``(a, b, n1, n2)`` of lines outside a bucket's largest component and its ``HUBS`` most central members.

    Central is a member whose bins' minima many others of the component have
    too: in a group of edited copies, one that is close to what was copied.
    """
    members = open_.where("root = main").select("id", "n", "root", "sig").dropDuplicates(["id"])
    bins = members.select("id", "root", F.posexplode(F.array(*[F.col(f"sig.{m}") for m in _BINS])).alias("j", "v"))
    shared = scratch.save(bins.groupBy("root", "j", "v").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    weight = bins.join(_small(shared), ["root", "j", "v"]).groupBy("id", "root").agg(F.sum("c").alias("w"))
    part = F.pmod(F.xxhash64("id"), F.lit(HUBS))
    best = weight.groupBy("root").agg(*[F.max(F.when(part == j, F.struct("w", "id"))).alias(f"h{j}") for j in range(HUBS)])
    hubs = best.select(F.explode(F.array_compact(F.array(*[F.col(f"h{j}.id") for j in range(HUBS)]))).alias("id"))
    hubs = members.join(hubs, "id").select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("sig").alias("y"), "root")
    outer = open_.where("root <> main").select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("sig").alias("x"), F.col("main").alias("root")).dropDuplicates(["a", "root"])
    return outer.join(hubs, "root").where(_agree("x", "y")).select("a", "b", "n1", "n2").distinct()


def _within(open_: DataFrame) -> DataFrame:
    """Pairs ``(a, b, n1, n2)`` of different components in a bucket, one outside its largest; for buckets of bounded size."""
    rows = open_.select("k", F.struct("id", "root", "n", "sig", (F.col("root") != F.col("main")).alias("outer")).alias("x"))
    both = rows.where("x.outer").withColumnRenamed("x", "a").join(rows.withColumnRenamed("x", "b"), "k")
    both = both.where((F.col("a.root") != F.col("b.root")) & (~F.col("b.outer") | (F.col("a.id") < F.col("b.id"))) & _agree("a.sig", "b.sig"))
    return both.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("n1"), F.col("b.n").alias("n2"))


def _prefixes(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, size, p, h, before)``: those of a line's rarest shingles that other lines of ``texts(id, line, n)`` have too.

    ``size`` is the number of a line's distinct shingles, ``p`` the place of ``h``
    (from 0) in their order by count, ``before`` the one before it; places beyond ``size - ceil(SIMILARITY * size)`` are left out.
    """
    total = texts.agg(F.sum("n")).first()[0] or 0
    dealt = texts.repartition(1 + total // TASK_SHINGLES, "id").select("id", _units(F.col("line")).alias("u"), "n")
    each = dealt.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).select("id", _hash(F.col("u"), F.col("i")).alias("h")).distinct()
    often = scratch.save(each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "often")
    ranked = each.join(_small(often), "h", "left").groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "h")))).alias("shared"))
    room = (F.col("size") - F.ceil(F.col("size") * SIMILARITY) + 1).cast("int")
    alone = (F.col("size") - F.size("shared")).cast("int")
    ranked = ranked.select("id", "size", alone.alias("alone"), F.slice("shared", F.lit(1), F.greatest(F.lit(0), room - alone)).alias("shared"))
    hashes = F.col("shared.h")
    each = F.arrays_zip(hashes.alias("h"), F.concat(F.array(F.lit(None).cast("long")), hashes).alias("before"))
    ranked = ranked.select("id", "size", "alone", F.posexplode(each).alias("p", "s")).where("s.h is not null")
    return ranked.select("id", "size", (F.col("p") + F.col("alone")).alias("p"), F.col("s.h").alias("h"), F.col("s.before").alias("before"))


def _beyond(open_: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs ``(a, b, n1, n2)`` of different components, one outside the largest of a bucket, that pass the prefix filter."""
    lines = open_.groupBy("id").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.max(F.col("root") != F.col("main")).alias("outer"))
    rows = lines.join(prefixes, "id").select("h", F.struct("id", "root", "n", "size", "p", "before", "sig", "outer").alias("x"))
    both = rows.where("x.outer").withColumnRenamed("x", "a").join(rows.withColumnRenamed("x", "b"), "h")
    size = lambda s: F.col(f"{s}.size")
    left = lambda s: size(s) - F.col(f"{s}.p")
    need = (size("a") + size("b")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6
    both = both.where((F.col("a.root") != F.col("b.root")) & (~F.col("b.outer") | (F.col("a.id") < F.col("b.id"))))
    # a pair with the same shingle before this one has met at that one
    both = both.where(F.col("a.before").isNull() | F.col("b.before").isNull() | (F.col("a.before") != F.col("b.before")))
    both = both.where((F.least(size("a"), size("b")) >= SIMILARITY * F.greatest(size("a"), size("b"))) & (F.least(left("a"), left("b")) >= need) & _agree("a.sig", "b.sig"))
    return both.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("n1"), F.col("b.n").alias("n2"))


def _classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, t1, t2, line_no, place, keep)`` of every line; ``keep`` is the place of its class that stays."""
    scratch = Scratch(docs.sparkSession, "linededup")
    lines = _lines(docs)
    table = scratch.save(_signatures(lines), "signatures")

    rows = table.select("id", "n", F.struct(*_BINS).alias("sig"), F.explode(_keys()).alias("k"))
    salt = F.xxhash64("k")
    leaders = rows.groupBy("k").agg(F.count(F.lit(1)).alias("members"), F.min(F.col("id").bitwiseXOR(salt)).alias("m")).where("members > 1")
    leaders = scratch.save(leaders.select("k", "members", F.col("m").bitwiseXOR(salt).alias("leader")), "leaders")
    buckets = scratch.save(_joined(rows, leaders, ["k"], scratch), "buckets")
    scratch.drop(leaders)
    heads = buckets.where("id = leader").select("k", F.col("sig").alias("b"), F.col("n").alias("n2"))
    near = buckets.where("id <> leader").withColumnRenamed("sig", "a").join(heads, "k").where(_agree("a", "b"))
    near = scratch.save(near.select(F.col("id").alias("a"), F.col("leader").alias("b"), F.col("n").alias("n1"), "n2").distinct(), "near")

    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).union(buckets.where("members > 2").select("id")).distinct()
    wanted = scratch.save(table.join(_small(scratch.save(wanted, "wanted")), "id", "left_semi").select("id", "h1", "h2", "first"), "places")
    owner = ((F.col("first") - F.col("first") % F.lit(_LINE_BASE).cast("decimal(11,0)")) / F.lit(_LINE_BASE).cast("decimal(11,0)")).cast("decimal(20,0)").cast("long")
    owners = scratch.save(wanted.select(owner.alias("_owner")).distinct(), "owners")
    held = pick(docs, "doc_id", "text").withColumn("_owner", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).join(_small(owners), "_owner", "left_semi")
    found = _joined(_lines(held).withColumn("first", _place(F.col("doc_id"), F.col("line_no"))), wanted, ["h1", "h2", "first"], scratch)
    texts = scratch.save(found.groupBy("id").agg(F.first("line").alias("line")).withColumn("n", _count(_units(F.col("line")))), "texts")
    maps = scratch.save(_maps(texts), "maps")

    roots = components(_verified(near, texts, maps, scratch), scratch)
    open_ = scratch.save(_open(buckets, roots), "open")
    again = scratch.save(_to_hubs(open_, scratch).join(near, ["a", "b"], "left_anti"), "hubs")
    roots = extended(roots, _verified(again, texts, maps, scratch), scratch)
    scratch.drop(open_)
    open_ = scratch.save(_open(buckets, roots), "last")
    large = open_.where(F.col("rows") > SMALL)
    prefixes = scratch.save(_prefixes(texts.join(large.select("id").distinct(), "id", "left_semi"), scratch), "prefixes")
    far = _within(open_.where(F.col("rows") <= SMALL)).unionByName(_beyond(large, prefixes))
    done = near.select("a", "b").unionByName(again.select("a", "b"))
    far = far.dropDuplicates(["a", "b"]).join(done, ["a", "b"], "left_anti").join(done.toDF("b", "a"), ["a", "b"], "left_anti")
    far = scratch.save(far, "far")
    roots = extended(roots, _verified(far, texts, maps, scratch), scratch)
    scratch.drop(buckets, near, again, wanted, owners, open_, prefixes, far, texts, maps)

    place = table.select("id", "h1", "h2", "first").join(roots.withColumnRenamed("node", "id"), "id", "left")
    grouped = place.where("root is not null").groupBy("root").agg(F.min("first").alias("keep"))
    keep = place.join(grouped, "root", "left").select("h1", "h2", F.coalesce("keep", "first").alias("keep"))
    out = lines.select("doc_id", "t1", "t2", "line_no", "h1", "h2").join(keep, ["h1", "h2"])
    return out.withColumn("place", _place(F.col("doc_id"), F.col("line_no"))).drop("h1", "h2")


def line_classes(docs: DataFrame) -> DataFrame:
    """Every line of ``docs(doc_id, text)`` with a character besides white space, and its class.

    Columns: doc_id, line_no (from 0), keep_doc_id, keep_line_no (the line of
    its class that stays), kept. Lines are compared without the white space at
    their ends. A null or empty text has no lines. Rows that repeat a doc_id
    repeat its lines: lines of one (doc_id, line number) count as one occurrence,
    and all of them stay if it is the first of their class. A row
    without doc_id comes after all others and so keeps a line only if no other
    document has it. An empty table gives an empty result; other columns are
    ignored.
    """
    out = _classes(docs)
    base = F.lit(_LINE_BASE).cast("decimal(11,0)")
    out = out.withColumn("kept", F.col("place") == F.col("keep"))
    out = out.withColumn("keep_line_no", (F.col("keep") % base).cast("long"))
    out = out.withColumn("keep_doc_id", F.when(F.col("keep") >= F.lit(_LAST).cast("decimal(20,0)") * base, F.lit(None)).otherwise(((F.col("keep") - F.col("keep_line_no")) / base).cast("decimal(20,0)").cast("long")))
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "keep_doc_id", "keep_line_no", "kept")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines of each class removed but for the kept one.

    Blank lines stay where they are. A document that had a line and has none
    left goes. ``n_chars``, where there is such a column, follows the new text.
    Rows without doc_id, and null or empty texts, stay as they are. Rows of one
    doc_id and different texts lose their own lines each; equal rows lose the
    same ones. An empty table gives an empty result.
    """
    names = docs.columns
    gone = _classes(docs).where("place <> keep and doc_id is not null")
    gone = gone.groupBy(F.col("doc_id").alias("_wl_id"), F.col("t1").alias("_wl_1"), F.col("t2").alias("_wl_2")).agg(F.collect_set(F.col("line_no").cast("int")).alias("_wl_gone"))
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    doc, text = f"_{names.index('doc_id')}", f"_{names.index('text')}"
    same = (F.col(doc).cast("long") == F.col("_wl_id")) & (F.xxhash64(text) == F.col("_wl_1")) & (F.xxhash64(F.col(text), F.lit(1)) == F.col("_wl_2"))
    rows = plain.join(gone, same, "left")
    lines = F.split(F.col(text), "\n")
    left = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_wl_gone")))
    cut = F.transform(F.array(lines), lambda all_: F.array_join(F.transform(left, lambda i: F.get(all_, i)), "\n"))
    rows = rows.withColumn("_wl_text", F.when(F.col("_wl_gone").isNull(), F.col(text)).otherwise(F.get(cut, 0)))
    rows = rows.where(F.col("_wl_gone").isNull() | F.col("_wl_text").rlike(r"[^ \t\r\n\x0b\x0c]"))
    new = {text: F.col("_wl_text")}
    if "n_chars" in names:
        i = names.index("n_chars")
        new[f"_{i}"] = F.when(F.col("_wl_gone").isNull(), F.col(f"_{i}")).otherwise(F.length("_wl_text")).cast(docs.schema[i].dataType)
    return rows.select(*[new.get(f"_{i}", F.col(f"_{i}")).alias(f"_{i}") for i in range(len(names))]).toDF(*names)
