"""Queries of stock operators (B), iterative applications (F), dataset preparation (G) and streams (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warpline.functions.kernels import KERNELS
from warpline.functions.vectors import f32, literal_rows, nearest
from warpline.operators import clustering, etl, graph, keyed, nbody, network
from warpline.operators.frame import cl
from warpline.plans.fixtures import doubles, table, vectors
from warpline.plans.scratch import Scratch, shared_folder
from warpline.sources import files
from warpline.streaming.frames import run_available, stream_table

K, ROUNDS = 10, 3


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _exploded(df: DataFrame, vec: str, *keep: str, places: int = 6) -> DataFrame:
    out = df.select(*keep, F.posexplode(vec).alias("pos", "x"))
    return out.select(*keep, F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), places).alias("x"))


# --- B: stock operators


def b1_text(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as delimited text and read with a declared schema."""
    path = f"{Scratch(spark, 'text').root}/rows"
    table(spark, d, "part").select(F.concat_ws(" ", "p_partkey", "p_size", "p_retailprice")).write.text(path)
    return files.read_rows(spark, path, "id long, size long, price double")


def b2_table(spark, d):
    path = f"{Scratch(spark, 'table').root}/nation"
    files.write_table(table(spark, d, "nation").select("n_nationkey", "n_name"), path, 2)
    return _long(files.read_table(spark, path), "n_nationkey")


def b4_range(spark, d):
    return spark.range(1000).select("id", (F.col("id") * F.col("id")).alias("sq"))


def b5_map(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 2, 4).alias("twice"))


def b6_flat_map(spark, d):
    return _long(keyed.replicate(table(spark, d, "part").select("p_partkey"), 3), "copy")


def b7_filter(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 45 and l_discount < 0.02").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


def b8_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey").distinct()


def b9_sum(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 4).alias("total"))


def b10_min(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("least"))


def b11_vector_sum(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return _exploded(keyed.vector_sum_by_key(rows, ["label"], "v"), "v", "label")


def b12_struct_sum(spark, d):
    p = table(spark, d, "lineitem").select("l_suppkey", F.struct(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z")).alias("p"))
    return p.groupBy("l_suppkey").agg(*[F.round(F.sum(f"p.{c}"), 4).alias(c) for c in "xyz"])


def b13_reduce(spark, d):
    return _exploded(keyed.vector_sum_by_key(vectors(spark, d), [], "v"), "v")


def b14_group(spark, d):
    """A customer's orders, few for each."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("all"))
    return o.select("o_custkey", F.array_join(F.transform("all", lambda x: x.cast("string")), ",").alias("orders"))


def b15_count_by_key(spark, d):
    return keyed.count_by_key(table(spark, d, "orders"), "o_custkey")


def b16_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


def b17_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


def b18_top(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


def b19_sample(spark, d):
    return keyed.take_sample(table(spark, d, "part").select("p_partkey"), 50, 1, ["p_partkey"])


def b19_sample_again(spark, d):
    return keyed.take_sample(table(spark, d, "part").select("p_partkey"), 50, 1, ["p_partkey"], replacement=True)


def b20_zip(spark, d):
    return _long(keyed.zip_with_index(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]), "idx")


def b18_collect(spark, d):
    """The 25 nations, a fixed table, brought to the driver and back."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return spark.createDataFrame(n.collect(), n.schema)


def b21_repartition(spark, d):
    """Rows and non-empty partitions after an even deal into 8."""
    rows = table(spark, d, "orders").select("o_orderkey").repartition(8).select(F.spark_partition_id().alias("part"))
    return rows.agg(F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("n"))


def b22_hash(spark, d):
    """Whether a key's rows all lie in the partition of its hash."""
    rows = table(spark, d, "lineitem").select("l_suppkey").repartition(8, "l_suppkey").withColumn("part", F.spark_partition_id())
    return rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("part") == F.pmod(F.hash("l_suppkey"), F.lit(8))).alias("own"))


def b23_ranges(spark, d):
    """Whether 8 range partitions hold rising ranges of keys; eight rows are compared."""
    rows = table(spark, d, "orders").select("o_orderkey").repartitionByRange(8, "o_orderkey")
    parts = rows.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count(F.lit(1)).alias("n"))
    before = F.lag("hi").over(Window.orderBy("part"))
    rising = parts.select("n", F.coalesce(before < F.col("lo"), F.lit(True)).alias("up"))
    return rising.agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.bool_and("up").alias("rising"))


def b24_cache(spark, d):
    """Two figures of one cached table, which is released after its use."""
    o = table(spark, d, "orders").select("o_custkey").cache()
    n, customers = o.count(), o.agg(F.count_distinct("o_custkey")).first()[0]
    o.unpersist()
    return spark.createDataFrame([(n, customers)], "n long, customers long")


def b25_broadcast(spark, d):
    """The 25 nations are a fixed table and go to every task."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(n), "c_nationkey").select("c_custkey", "n_name")


def b26_partitions(spark, d):
    p = table(spark, d, "part").select("p_partkey").repartition(4)
    return p.select(F.spark_partition_id().alias("p")).distinct().agg(F.count(F.lit(1)).alias("n"))


# --- F: applications


def _centre_rows(spark: SparkSession, centres: list[list[float]]) -> DataFrame:
    return _exploded(spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "cid long, v array<double>"), "v", "cid", places=4)


def f1_kmeans(spark, d):
    return _centre_rows(spark, clustering.kmeans(vectors(spark, d), K, ROUNDS, "v", "id"))


def f1_kmeans_counts(spark, d):
    centres = clustering.initial_centres(vectors(spark, d), K, "id", "v")
    return _long(clustering.assign(vectors(spark, d), centres, "v").groupBy("cid").agg(F.count(F.lit(1)).alias("n")), "cid")


def f1_kmeans_copies(spark, d):
    return _centre_rows(spark, clustering.kmeans(vectors(spark, d), K, ROUNDS, "v", "id", mode="copies"))


def f2_fuzzy(spark, d):
    return _centre_rows(spark, clustering.fuzzy_cmeans(vectors(spark, d), 3, 2, "v", "id"))


def _population(spark, d) -> list:
    first = clustering.initial_centres(vectors(spark, d), 50, "id", "v")
    return [first[i : i + 5] for i in range(0, len(first), 5)]


def f3_fitness(spark, d):
    out = clustering.fitness(vectors(spark, d), _population(spark, d), "v")
    return out.select(F.col("cid").cast("long").alias("cid"), "n", F.round("fitness", 4).alias("fitness"))


def f3_genetic(spark, d):
    made = clustering.genetic_clustering(vectors(spark, d), _population(spark, d), 2, "v")
    rows = [(i, j, c) for i, s in enumerate(made) for j, c in enumerate(s)]
    return spark.createDataFrame(rows, "cid long, centre long, v array<double>")


def _links(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def f4_pagerank(spark, d):
    edges = _links(spark, d)
    out = graph.pagerank(edges, graph.with_out_links(edges), ROUNDS)
    return out.select("id", F.round("rank", 6).alias("rank"), F.col("links").cast("long").alias("links"))


def f5_components(spark, d):
    """Edges of all orders: one long chain of ids, too long for a recursive SQL."""
    o = table(spark, d, "orders")
    return graph.connected_components(o.select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1 + F.col("o_custkey") % 3).alias("b")))


def _bodies(spark, d) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    points = p.select(F.col("p_partkey").alias("id"), f32(F.col("p_partkey") % 97).alias("x"), f32(F.col("p_size")).alias("y"), f32(F.col("p_partkey") % 31).alias("z"), f32(F.col("p_size") % 3).alias("mass"))
    pairs = p.select(F.col("p_partkey").alias("target"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("by")).select("target", (F.col("target") + F.col("by")).alias("actor"))
    return points, pairs


def f6_accelerations(spark, d):
    out = nbody.accelerations(*_bodies(spark, d))
    return out.select("id", *[F.round(c, 4).alias(c) for c in ("ax", "ay", "az")])


def f6_nbody(spark, d):
    return nbody.simulate(*_bodies(spark, d), steps=2)


_LAYERS = [64, 32, 10]


def _labelled(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def f7_predict(spark, d):
    weights = network.train(_labelled(spark, d), _LAYERS, 3, 0.5, "v", "label")
    return _exploded(network.predict(_labelled(spark, d), weights, "v", "id"), "out", "id")


def f7_gradients(spark, d):
    out = network.gradient_table(_labelled(spark, d), network.new_weights(_LAYERS), "v", "label")
    return _exploded(_long(out, "layer"), "g", "layer")


def e43_runs(spark, d):
    """Nearest centre under two sets of centres, a row for each run."""
    runs = [clustering.initial_centres(vectors(spark, d), k, "id", "v") for k in (3, 5)]
    best = F.array(*[nearest(F.col("v"), literal_rows(c)) for c in runs])
    out = vectors(spark, d).select("id", F.posexplode(best).alias("run", "b"))
    return out.select("id", F.col("run").cast("long").alias("run"), F.col("b.id").cast("long").alias("cid"))


# --- G: dataset preparation


def _files(spark, df, n, label):
    """Rows and files of a table written in ``n`` parts."""
    kept = Scratch(spark, label).save(df.repartition(n), "parts").select(F.input_file_name().alias("file"))
    return kept.agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("n"))


def g2_split(spark, d):
    return _files(spark, table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 6, "split")


def g12_zip(spark, d):
    """Customers by key beside their names by name, place by place."""
    c = table(spark, d, "customer")
    return keyed.zip_rows(c.select("c_custkey"), ["c_custkey"], c.select("c_name"), [F.desc("c_name")])


def g14_repartition(spark, d):
    return _files(spark, vectors(spark, d), 5, "repartition")


def g1_rows(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return _exploded(etl.rows_to_vectors(p, "p_partkey"), "v")


def g4_normalize(spark, d):
    e = table(spark, d, "lineitem").select((F.col("l_suppkey") * 3_000_000_019).alias("src"), (F.col("l_partkey") * 7 - 5_000_000_000).alias("dst"))
    return _long(etl.normalize_edges(e)[0], "src", "dst")


def g5_ranks(spark, d):
    return etl.doc_ranks(table(spark, d, "part"), "p_partkey")


def g6_filter(spark, d):
    return etl.filter_edges(_links(spark, d), table(spark, d, "part").count(), 0.25)


def g7_renormalize(spark, d):
    return _long(etl.normalize_edges(_links(spark, d), fold=False)[0], "src", "dst")


def _images(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    size = [(2 + F.col("p_size") % 4).alias("height"), (2 + F.col("p_size") % 3).alias("width")]
    return p.select(F.col("p_partkey").alias("id"), *size, F.lit(3).alias("channels"), F.unhex(F.repeat(F.md5("p_name"), F.lit(4))).alias("data"))


def g8_smallest(spark, d):
    return _long(etl.smallest_image(_images(spark, d)), "height", "width")


def g9_crop(spark, d):
    return _exploded(etl.crop_rgb(_images(spark, d), 2, 2), "v", "id")


def g10_merge(spark, d):
    """Vectors as lines of one file, read again as vectors."""
    path = f"{Scratch(spark, 'lines').root}/lines"
    files.write_lines(table(spark, d, "part").select(F.array(F.col("p_partkey").cast("double"), "p_retailprice").alias("v")), "v", path, files=1)
    back = files.read_vectors(spark, path)
    return back.select(F.get("v", 0).alias("k"), F.get("v", 1).alias("price"))


def g13_copies(spark, d):
    return etl.even_copies(table(spark, d, "part").select((F.col("p_partkey") - 1).alias("id"), F.col("p_partkey").alias("of")), 3, "id")


def g15_downsample(spark, d):
    return _exploded(etl.downsample(vectors(spark, d), "v", 5), "v", "id")


def g16_labels(spark, d):
    return _exploded(etl.fake_labels(vectors(spark, d), "id", 4), "label", "id")


def g17_subset(spark, d):
    path = f"{Scratch(spark, 'subset').root}/parts"
    files.write_table(table(spark, d, "part").select("p_partkey"), path, 8)
    return files.last_files(spark, path, 2)


def s1_stream(spark, d):
    """A kernel over a stream of the events table, unchanged."""
    events = stream_table(spark, f"{d}/events.parquet")
    f, ddl = KERNELS["square_times"]
    out = cl(events.select(F.col("event_id").alias("id"), F.col("value").alias("v"))).map(f, ddl).df
    return run_available(out, f"{shared_folder(spark)}").withColumn("v", F.round("v", 6))


# --- the same in DuckDB SQL

_POINTS = "pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


def _first_centres(k: int) -> str:
    return f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, v FROM (SELECT * FROM pts ORDER BY id LIMIT {k}))"


def _rows_of(centres: str) -> str:
    return f"SELECT cid, unnest(range(len(v))) AS pos, round(unnest(v), 4) AS x FROM {centres}"


def _kmeans_sql(tail: str, rounds: int = ROUNDS, k: int = K) -> str:
    out = ["WITH " + _POINTS, _first_centres(k)]
    for i in range(rounds):
        out.append(f"d{i} AS (SELECT p.id, p.v, arg_min(c.cid, struct_pack(d := list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c.cid)) AS cid FROM pts p, c{i} c GROUP BY p.id, p.v)")
        out.append(f"e{i} AS (SELECT cid, unnest(range(len(v))) AS pos, unnest(v) AS x FROM d{i})")
        out.append(f"m{i} AS (SELECT cid, list(x ORDER BY pos) AS v FROM (SELECT cid, pos, avg(x) AS x FROM e{i} GROUP BY cid, pos) GROUP BY cid)")
        out.append(f"c{i + 1} AS (SELECT c.cid, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cid))")
    return ", ".join(out) + " " + tail


def _fuzzy_sql() -> str:
    out = ["WITH " + _POINTS, _first_centres(3)]
    for i in range(2):
        out.append(f"d{i} AS (SELECT p.id, p.v, c.cid, sqrt(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM pts p, c{i} c)")
        out.append(f"t{i} AS (SELECT *, d * sum(CASE WHEN d > 0 THEN 1 / d ELSE 0 END) OVER (PARTITION BY id) AS t FROM d{i})")
        out.append(f"u{i} AS (SELECT cid, v, CASE WHEN t = 0 THEN 1 ELSE pow(t, -4) END AS u FROM t{i})")
        out.append(f"e{i} AS (SELECT cid, u, unnest(range(len(v))) AS pos, unnest(v) AS x FROM u{i})")
        out.append(f"c{i + 1} AS (SELECT cid, list(x ORDER BY pos) AS v FROM (SELECT cid, pos, sum(u * x) / sum(u) AS x FROM e{i} GROUP BY cid, pos) GROUP BY cid)")
    return ", ".join(out) + " " + _rows_of("c2")


_FITNESS = f"""WITH {_POINTS}, c AS (SELECT (row_number() OVER (ORDER BY id) - 1) // 5 AS cid, v AS c FROM (SELECT * FROM pts ORDER BY id LIMIT 50)),
d AS (SELECT cid, id, min(sqrt(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS d FROM pts, c GROUP BY cid, id)
SELECT cid, count(*) AS n, round(sum(d), 4) AS fitness FROM d GROUP BY cid"""

_LINKS = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"


def _pagerank_sql() -> str:
    out = [f"WITH {_LINKS}", "o AS (SELECT src AS id, count(*) AS links FROM e GROUP BY src)", "n0 AS (SELECT id, 1.0::DOUBLE AS rank, coalesce(links, 0) AS links FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) LEFT JOIN o USING (id))"]
    for i in range(ROUNDS):
        out.append(f"n{i + 1} AS (SELECT n.id, coalesce(w.r, n.rank) AS rank, n.links FROM n{i} n LEFT JOIN (SELECT dst AS id, sum(CASE WHEN links > 0 THEN rank / links END) AS r FROM e JOIN n{i} s ON s.id = e.src GROUP BY dst) w USING (id))")
    return ", ".join(out) + f" SELECT id, round(rank, 6) AS rank, links FROM n{ROUNDS}"


_ACCEL = """WITH p AS (SELECT p_partkey AS id, (p_partkey % 97)::FLOAT AS x, p_size::FLOAT AS y, (p_partkey % 31)::FLOAT AS z, (p_size % 3)::FLOAT AS mass FROM part),
d AS (SELECT t.id, a.mass, t.x - a.x AS x, t.y - a.y AS y, t.z - a.z AS z FROM p t JOIN p a ON a.id BETWEEN t.id + 1 AND t.id + 8),
s AS (SELECT *, x * x + y * y + z * z AS d2 FROM d),
w AS (SELECT *, mass * (1::FLOAT / sqrt((d2 * d2 * d2)::DOUBLE)::FLOAT) AS s FROM s WHERE d2 > 0)
SELECT id, round(sum((x * s)::DOUBLE), 4) AS ax, round(sum((y * s)::DOUBLE), 4) AS ay, round(sum((z * s)::DOUBLE), 4) AS az FROM w GROUP BY id"""

_RUNS = f"""WITH {_POINTS}, c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, v AS c FROM (SELECT * FROM pts ORDER BY id LIMIT 5)),
r AS (SELECT 0 AS run, * FROM c WHERE cid < 3 UNION ALL SELECT 1, * FROM c)
SELECT id, run::BIGINT AS run, arg_min(cid, struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := cid)) AS cid FROM pts, r GROUP BY id, run"""


def _dense(edges: str) -> str:
    return f"WITH e AS ({edges}), n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)) SELECT s.idx AS src, d.idx AS dst FROM e JOIN n s ON s.node = e.src JOIN n d ON d.node = e.dst"


def _fold_sql(x: str) -> str:
    return f"abs(((({x}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"


_CROP = """WITH i AS (SELECT p_partkey AS id, 2 + p_size % 3 AS w, repeat(md5(p_name), 4) AS h FROM part), p AS (SELECT *, unnest(range(12)) AS pos FROM i)
SELECT id, pos, ('0x' || substr(h, 2 * (((pos // 6) * w + pos // 3 % 2) * 3 + 2 - pos % 3) + 1, 2))::INTEGER::DOUBLE AS x FROM p"""

_EMB = "SELECT {}unnest(range(64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings"

#: name -> (query, DuckDB SQL or None)
QUERIES: dict = {
    "B1_text_file": (b1_text, "SELECT p_partkey AS id, p_size::BIGINT AS size, p_retailprice AS price FROM part"),
    "B2_B3_table_file": (b2_table, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation"),
    "B4_range": (b4_range, "SELECT range AS id, range * range AS sq FROM range(1000)"),
    "B5_map": (b5_map, "SELECT o_orderkey, round(o_totalprice * 2, 4) AS twice FROM orders"),
    "B6_flat_map": (b6_flat_map, "SELECT p_partkey, unnest(range(3)) AS copy FROM part"),
    "B7_filter": (b7_filter, "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02"),
    "B8_distinct": (b8_distinct, "SELECT DISTINCT l_suppkey FROM lineitem"),
    "B9_reduce_sum": (b9_sum, "SELECT l_suppkey, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY l_suppkey"),
    "B10_reduce_min": (b10_min, "SELECT l_partkey, min(l_orderkey) AS least FROM lineitem GROUP BY l_partkey"),
    "B11_reduce_vector": (b11_vector_sum, f"SELECT label, pos, round(sum(x), 6) AS x FROM ({_EMB.format('label::BIGINT AS label, ')}) GROUP BY label, pos"),
    "B12_reduce_struct": (b12_struct_sum, "SELECT l_suppkey, round(sum(l_quantity), 4) AS x, round(sum(l_discount), 4) AS y, round(sum(l_tax), 4) AS z FROM lineitem GROUP BY l_suppkey"),
    "B13_reduce_all": (b13_reduce, f"SELECT pos, round(sum(x), 6) AS x FROM ({_EMB.format('')}) GROUP BY pos"),
    "B14_group_by_key": (b14_group, "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey"),
    "B15_count_by_key": (b15_count_by_key, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"),
    "B16_join": (b16_join, "SELECT c_custkey, o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey"),
    "B17_count": (b17_count, "SELECT count(*) AS n FROM lineitem"),
    "B18_top": (b18_top, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "B18_collect": (b18_collect, "SELECT n_nationkey, n_name FROM nation"),
    "B19_take_sample": (b19_sample, None),
    "B19_take_sample_replaced": (b19_sample_again, None),
    "B20_zip_with_index": (b20_zip, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders"),
    "B21_repartition": (b21_repartition, "SELECT 8::BIGINT AS parts, count(*) AS n FROM orders"),
    "B22_hash_partitions": (b22_hash, "SELECT l_suppkey, count(*) AS n, true AS own FROM lineitem GROUP BY l_suppkey"),
    "B23_range_partitions": (b23_ranges, "SELECT 8::BIGINT AS parts, count(*)::BIGINT AS n, true AS rising FROM orders"),
    "B24_cache": (b24_cache, "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders"),
    "B25_broadcast": (b25_broadcast, "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey"),
    "B26_partitions": (b26_partitions, "SELECT 4::BIGINT AS n"),
    "E43_nearest_by_run": (e43_runs, _RUNS),
    "F1_kmeans": (f1_kmeans, _kmeans_sql(_rows_of(f"c{ROUNDS}"))),
    "F1_kmeans_counts": (f1_kmeans_counts, _kmeans_sql("SELECT cid, count(*) AS n FROM d0 GROUP BY cid", 1)),
    "F1_kmeans_copies": (f1_kmeans_copies, f"WITH {_POINTS}, {_first_centres(K)} {_rows_of('c0')}"),
    "F2_fuzzy_cmeans": (f2_fuzzy, _fuzzy_sql()),
    "F3_genetic_fitness": (f3_fitness, _FITNESS),
    "F3_genetic_clustering": (f3_genetic, None),
    "F4_pagerank": (f4_pagerank, _pagerank_sql()),
    "F5_connected_components": (f5_components, None),
    "F6_nbody_accelerations": (f6_accelerations, _ACCEL),
    "F6_nbody": (f6_nbody, None),
    "F7_network_gradients": (f7_gradients, None),
    "F7_network": (f7_predict, None),
    "G1_rows_to_vectors": (g1_rows, "SELECT unnest([0, 1]) AS pos, round(unnest([p_size::DOUBLE, p_retailprice]), 6) AS x FROM part"),
    "G2_split_files": (g2_split, "SELECT 6::BIGINT AS files, count(*) AS n FROM orders"),
    "G4_normalize_edges": (g4_normalize, _dense(f"SELECT {_fold_sql('l_suppkey * 3000000019')} AS src, {_fold_sql('l_partkey * 7 - 5000000000')} AS dst FROM lineitem")),
    "G5_doc_ranks": (g5_ranks, None),
    "G6_filter_edges": (g6_filter, f"WITH {_LINKS}, n AS (SELECT floor(count(*) * 0.25) AS n FROM part) SELECT src, dst FROM e, n WHERE src < n AND dst < n"),
    "G7_renormalize_edges": (g7_renormalize, _dense("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem")),
    "G8_smallest_image": (g8_smallest, "SELECT min(2 + p_size % 4)::BIGINT AS height, min(2 + p_size % 3)::BIGINT AS width FROM part"),
    "G9_crop_rgb": (g9_crop, _CROP),
    "G10_G11_merged_lines": (g10_merge, "SELECT p_partkey::DOUBLE AS k, p_retailprice AS price FROM part"),
    "G12_zip": (g12_zip, "SELECT c_custkey, c_name FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) JOIN (SELECT c_name, row_number() OVER (ORDER BY c_name DESC) AS i FROM customer) USING (i)"),
    "G13_multiply": (g13_copies, "SELECT p_partkey - 1 + c * (SELECT count(*) FROM part) AS id, p_partkey AS of FROM part, (SELECT unnest(range(3)) AS c)"),
    "G14_repartition_files": (g14_repartition, "SELECT 5::BIGINT AS files, count(*) AS n FROM embeddings"),
    "G15_downsample": (g15_downsample, "SELECT id, pos // 5 AS pos, round(x, 6) AS x FROM (" + _EMB.format("vec_id AS id, ") + ") WHERE pos % 5 = 0"),
    "G16_fake_labels": (g16_labels, None),
    "G17_last_files": (g17_subset, None),
    "S1_stream_map": (s1_stream, "SELECT event_id AS id, round(value * value * 4, 6) AS v FROM events"),
}
