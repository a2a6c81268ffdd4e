"""Vector search by cosine, topic boosts, and two-level topic clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def search(vectors: DataFrame, query: list[float], limit: int = 10, least: float = 0.3, by: list[str] = ()) -> DataFrame:
    """Rows by cosine to the query, at least `least`; the best 2 x limit of each table (columns `by`), then the best of all.

    limit is held within 1 to 100, as callers page through results.
    """
    limit = max(1, min(100, limit))
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter("embedding is not null").withColumn("similarity", cosine(F.col("embedding"), q)).filter(F.col("similarity") >= least).drop("embedding")
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("similarity"), "vec_id"))
        scored = scored.withColumn("_p", place).filter(F.col("_p") <= 2 * limit).drop("_p")
    return scored.orderBy(F.desc("similarity"), "vec_id").limit(limit)


def topic_boost(hits: DataFrame, assignments: DataFrame, centroids: DataFrame, query: list[float], boost: float = 0.05, topics: int = 3) -> DataFrame:
    """hits of the `topics` centroids nearest to the query gain `boost`, to 1 at most."""
    near = search(centroids.withColumnRenamed("topic", "vec_id"), query, topics, -1.0).select(F.col("vec_id").alias("topic"), F.lit(boost).alias("gain"))
    out = hits.join(assignments, "vec_id", "left").join(F.broadcast(near), "topic", "left")
    return out.withColumn("boosted", F.least(F.lit(1.0), F.col("similarity") + F.coalesce("gain", F.lit(0.0)))).drop("gain")


def rerank(hits: DataFrame, limit: int) -> DataFrame:
    """The first 3 x limit by similarity, then by rerank_score where there is one."""
    first = hits.orderBy(F.desc("similarity"), "vec_id").limit(3 * limit)
    return first.orderBy(F.desc(F.coalesce("rerank_score", "similarity")), "vec_id").limit(limit)


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """label and the mean vector, by one aggregation over (label, place)."""
    parts = vectors.select(label, F.posexplode("embedding").alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    items = F.array_sort(F.collect_list(F.struct("i", "x")))
    return parts.groupBy(label).agg(F.transform(items, lambda s: s["x"]).alias("embedding"))


def kmeans(vectors: DataFrame, k: int, seed: int = 1, unit: bool = True) -> DataFrame:
    """vec_id, topic, distance to the centre; vectors are normalised to length 1 first, unless `unit` is False."""
    v = vectors.select("vec_id", "embedding", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("raw"))
    v = Normalizer(inputCol="raw", outputCol="features").transform(v) if unit else v.withColumnRenamed("raw", "features")
    model = KMeans(k=k, seed=seed, initMode="k-means||", maxIter=20).fit(v)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "topic int, centre array<double>")
    out = model.transform(v).withColumnRenamed("prediction", "topic").join(F.broadcast(centres), "topic")
    length = F.greatest(norm(F.col("embedding")), F.lit(1e-300)) if unit else F.lit(1.0)
    gap = F.sqrt(F.aggregate(F.zip_with(F.transform("embedding", lambda x: x.cast("double") / length), F.col("centre"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return out.select("vec_id", "topic", gap.alias("distance"))


def nearest_members(assigned: DataFrame, k: int = 15) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("topic").orderBy("distance", "vec_id"))
    return assigned.withColumn("place", place).filter(F.col("place") <= k)


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1; a constant one becomes 0."""
    s = df.agg(*(F.min(c).alias(f"lo_{c}") for c in columns), *(F.max(c).alias(f"hi_{c}") for c in columns))
    return df.join(F.broadcast(s)).withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)) for c in columns}).drop(*s.columns)


def containing(rows: DataFrame, columns: list[str], text: str, order: list[Column], limit: int) -> DataFrame:
    """Rows one of whose columns holds the text in any case, in the given order: the search without an embedding."""
    hit = F.lower(F.lit(text))
    found = reduce(lambda x, y: x | y, [F.coalesce(F.lower(c).contains(hit), F.lit(False)) for c in columns])
    return rows.filter(found).orderBy(*order).limit(limit)


def cluster_profile(members: DataFrame, cluster: str, ts: str, source: str) -> DataFrame:
    """cluster, members, begins, ends, sources (name and count, most first, then by name) of each cluster."""
    per = members.groupBy(cluster, source).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    mix = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(source).alias("s")))), lambda x: F.concat_ws(":", x["s"], -x["k"]))
    return per.groupBy(cluster).agg(F.sum("n").alias("members"), F.min("lo").alias("begins"), F.max("hi").alias("ends"), F.array_join(mix, ",").alias("sources"))
