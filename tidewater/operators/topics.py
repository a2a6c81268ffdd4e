"""Trees of topic clusters: walks to the most specific cluster, figures of each cluster, and splitting all topics at once."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.vectors import kmeans, norm
from tidewater.session import ensure_checkpoint_dir

#: Nodes of a tree up to which it is broadcast; beyond, items are shuffled to their node's children.
_MOST_NODES = 10_000


def gap(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def walk_down(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """vec_id, node, level, distance, path: each item goes to the nearest node without a parent, then to the nearest of that one's children,
    and so on; node is the last (most specific) one, path holds (node, level, distance) from the top. Ties: the smallest node.

    nodes: node, parent (null at the top), embedding. A round for each level of the tree; a round is a join with the
    children lists, which hold each node once. Items without an embedding have no node.
    """
    small = nodes.limit(_MOST_NODES + 1).count() <= _MOST_NODES
    kids = nodes.groupBy("parent").agg(F.collect_list(F.struct("node", "embedding")).alias("_kids"))
    kids = F.broadcast(kids) if small else kids
    step = "struct<node: {0}, level: int, distance: double>".format(nodes.schema["node"].dataType.simpleString())
    at = vectors.select("vec_id", "embedding", F.lit(None).cast(nodes.schema["node"].dataType).alias("node"), F.array().cast(f"array<{step}>").alias("path"))
    level, wave = 1, nodes.filter("parent is null").select("node")
    while wave.limit(1).count():
        near = F.array_min(F.transform("_kids", lambda k: F.struct(gap(F.col("embedding"), k["embedding"]).alias("distance"), k["node"].alias("node"))))
        moved = F.col("_kids").isNotNull() & F.col("embedding").isNotNull() & (F.size("path") == level - 1)
        at = at.join(kids, F.col("node").eqNullSafe(F.col("parent")), "left").withColumn("_near", F.when(moved, near))
        here = F.struct(F.col("_near.node").alias("node"), F.lit(level).alias("level"), F.col("_near.distance").alias("distance"))
        at = at.select("vec_id", "embedding", F.coalesce("_near.node", "node").alias("node"), F.when(F.col("_near").isNotNull(), F.concat("path", F.array(here))).otherwise(F.col("path")).alias("path"))
        wave = nodes.join(wave.withColumnRenamed("node", "parent"), "parent").select("node")
        level += 1
    last = F.try_element_at("path", F.lit(-1))
    return at.select("vec_id", "node", last["level"].alias("level"), last["distance"].alias("distance"), "path")


def node_figures(walked: DataFrame, items: DataFrame, source: str) -> DataFrame:
    """node, level, members, mean_distance, sources (map of source to members) of every node that a walk passes. items: vec_id and source."""
    seen = walked.select("vec_id", F.explode("path").alias("p")).join(items.select("vec_id", source), "vec_id", "left")
    per = seen.groupBy(F.col("p.node").alias("node"), F.col("p.level").alias("level"), F.coalesce(F.col(source).cast("string"), F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("p.distance").alias("d"))
    g = per.groupBy("node", "level").agg(F.sum("n").alias("members"), F.sum("d").alias("d"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"))
    return g.select("node", "level", "members", (F.col("d") / F.col("members")).alias("mean_distance"), "sources")


def split_all(members: DataFrame, parts: DataFrame, iterations: int = 10, seed: int = 1) -> DataFrame:
    """vec_id, topic, subtopic: k-means within each topic, for all topics in the same jobs. members: vec_id, topic, embedding; parts: topic, k.

    Centres are drawn as k-means++ does (a round for each: of a topic's members the one with the greatest log(u) / d^2 for a
    uniform u by hash, so that the chance goes with d^2), then moved `iterations` times at most. What the driver holds are the
    centres: the sum of k, the clusters that are asked for.
    """
    ensure_checkpoint_dir(members.sparkSession)
    spark = members.sparkSession
    unit = F.transform("embedding", lambda x: x.cast("double") / F.greatest(norm(F.col("embedding")), F.lit(1e-300)))
    rows = members.join(F.broadcast(parts), "topic").select("vec_id", "topic", "k", unit.alias("x")).checkpoint()
    schema = "topic long, subtopic int, c array<double>"
    centres: list[tuple[int, int, list[float]]] = []

    def nearest() -> DataFrame:
        held = spark.createDataFrame(centres, schema).groupBy("topic").agg(F.collect_list(F.struct("subtopic", "c")).alias("_c"))
        best = F.array_min(F.transform("_c", lambda c: F.struct(gap(F.col("x"), c["c"]).alias("d"), c["subtopic"].alias("subtopic"))))
        return rows.join(F.broadcast(held), "topic", "left").withColumn("_best", best)

    most = parts.agg(F.max("k")).first()[0] or 0
    for r in range(most):
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "vec_id"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
        away = F.coalesce(F.col("_best.d"), F.lit(1.0))
        drawn = nearest().filter((F.col("k") > r) & (away > 0)).groupBy("topic").agg(F.max_by("x", F.struct(F.log(u) / (away * away), -F.col("vec_id"))).alias("x")).collect()
        centres += [(d["topic"], r, d["x"]) for d in drawn]
    for _ in range(iterations):
        means = nearest().groupBy("topic", F.col("_best.subtopic").alias("subtopic")).agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("c")).collect()
        before, new = {(t, s): c for t, s, c in centres}, {(m["topic"], m["subtopic"]): list(m["c"]) for m in means}
        centres = [(*key, c) for key, c in sorted((before | new).items())]
        if max((sum((a - b) ** 2 for a, b in zip(c, before[key])) for key, c in new.items()), default=0.0) < 1e-12:
            break
    return nearest().select("vec_id", "topic", F.col("_best.subtopic").alias("subtopic"))


def two_level(vectors: DataFrame, k: int, least: int = 50, seed: int = 1) -> DataFrame:
    """vec_id, topic, subtopic (-1 where the topic is too small), distance. Topics of more than `least` members split into
    max(3, min(12, n / 200)) unless they have fewer than twice as many members; all topics split in the same jobs."""
    top = kmeans(vectors, k, seed)
    n = F.col("n")
    sizes = top.groupBy(F.col("topic").cast("long").alias("topic")).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.greatest(F.lit(3), F.least(F.lit(12), F.floor(n / 200))).cast("int"))
    parts = sizes.filter((n > least) & (n >= 2 * F.col("k"))).select("topic", "k")
    members = top.select("vec_id", F.col("topic").cast("long").alias("topic")).join(vectors.select("vec_id", "embedding"), "vec_id")
    inner = split_all(members, parts, seed=seed)
    return top.join(inner.select("vec_id", "subtopic"), "vec_id", "left").select("vec_id", "topic", F.coalesce("subtopic", F.lit(-1)).alias("subtopic"), "distance")


def representatives(assigned: DataFrame, by: list[str], k: int = 15) -> DataFrame:
    """The k members of each cluster (columns `by`) nearest to its centre."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("distance", "vec_id"))
    return assigned.withColumn("place", place).filter(F.col("place") <= k)
