"""Join operators beyond plain keys: proximity in time, lags, next present day, intervals, event windows, fuzzy names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import similarity
from tidewater.operators import pairs
from tidewater.session import ensure_checkpoint_dir


def near_in_time(df: DataFrame, person: str, ts: str, seconds: int) -> DataFrame:
    """a < b, pairs of rows of different persons at most `seconds` apart, with both times.

    Time is cut into buckets of `seconds`; a row meets its own and the next bucket by an equi-join, so no nested loop. Buckets of many rows are cut into parts.
    """
    t = F.unix_timestamp(F.col(ts).cast("timestamp"))
    rows = df.select(F.col(person).alias("p"), t.alias("t"), F.floor(t / seconds).alias("bucket"))
    left = rows.select(F.col("p").alias("p1"), F.col("t").alias("t1"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    right = rows.select(F.col("p").alias("p2"), F.col("t").alias("t2"), "bucket")
    # In the same bucket each unordered pair comes twice: keep the one in order of time, then of person.
    same = (F.floor(F.col("t1") / seconds) < F.col("bucket")) | (F.struct("t1", "p1") < F.struct("t2", "p2"))
    met = pairs.between(left, right, ["bucket"]).filter(same & (F.col("p1") != F.col("p2")) & (F.abs(F.col("t1") - F.col("t2")) <= seconds))
    return met.select(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b"), "t1", "t2")


#: Rows of a part of persons, and pairs of rows that a meeting of two parts counts at once.
_ROWS, _PAIRS = 1_000_000, 1_000_000


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows as one: its persons, and by time each row's person (as its place among them), time and count (none: all are 1)."""
    rows = [b for b in batches if len(b)]
    if not rows:
        return
    p, t, c = (pa.Table.from_batches(rows).column(x).to_numpy() for x in "ptc")
    order = np.argsort(t, kind="stable")
    persons, u = np.unique(p[order], return_inverse=True)
    packed = [persons.tobytes(), u.astype(np.int32).tobytes(), t[order].tobytes(), c[order].tobytes() if c.max() > 1 else b""]
    yield pa.RecordBatch.from_pydict({"k": pa.array([TaskContext.get().partitionId()], pa.int32()), **{x: pa.array([v], pa.binary()) for x, v in zip("putc", packed, strict=True)}})


def _cells(cell: np.ndarray, weight: np.ndarray | None, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells that occur, in order, and how often (or their sums of weight): by a table of all where these are not many more than what occurs."""
    if cells > 8 * len(cell):
        found, at = np.unique(cell, return_inverse=True)
        times = np.bincount(at, minlength=len(found)) if weight is None else _sums(at, weight, len(found))
        return found, times
    times = np.bincount(cell, minlength=cells) if weight is None else _sums(cell, weight, cells)
    found = np.flatnonzero(times)
    return found, times[found]


def _sums(at: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, at, weight)
    return out


def often_near(df: DataFrame, person: str, ts: str, seconds: int, least: int, persons: int = 20_000) -> DataFrame:
    """a < b, times: persons (of type long) with at least `least` pairs of rows at most `seconds` apart.

    Persons are cut into parts of at most about `persons` and a million rows by second, each stored once as one row. Parts meet two by two where they are read,
    so neither rows nor pairs of them are copied to a disk. A meeting slides along the time for one person after the other, about a million pairs at once.
    """
    rows = df.select(F.col(person).cast("long").alias("p"), F.unix_timestamp(F.col(ts).cast("timestamp")).alias("t")).filter("p is not null and t is not null")
    n, people = rows.agg(F.count(F.lit(1)), F.approx_count_distinct("p")).first()
    parts = max(8, -(-people // persons), -(-n // _ROWS))
    rows = rows.groupBy("p", "t").agg(F.count(F.lit(1)).alias("c"))
    ensure_checkpoint_dir(df.sparkSession)
    packed = rows.repartitionById(parts, F.pmod(F.xxhash64("p"), F.lit(parts)).cast("int")).mapInArrow(_packed, "k int, p binary, u binary, t binary, c binary").checkpoint()
    first, second = (packed.select(*(F.col(x).alias(f"{x}{i}") for x in packed.columns)) for i in "12")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from meeting(row)

    def meeting(row: dict) -> Iterator[pa.RecordBatch]:
        (pa_, ua, ta, ca), (pb, ub, tb, cb) = ([np.frombuffer(row[x + i], np.int32 if x == "u" else np.int64) for x in "putc"] for i in "12")
        order = np.argsort(ua, kind="stable")
        ua, ta, width = ua[order].astype(np.int64), ta[order], len(pb)
        weighted = len(ca) or len(cb)
        ca, cb = ca[order] if len(ca) else np.ones(len(ta), np.int64), cb if len(cb) else np.ones(len(tb), np.int64)
        low = np.searchsorted(tb, ta - seconds, "left")
        n = np.searchsorted(tb, ta + seconds, "right") - low
        ends = np.cumsum(n)
        shift = low - (ends - n)  # from the number of a pair to its row of the second part

        def hits(u: np.ndarray, v: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
            keep = times >= max(least, 1)
            if row["k1"] == row["k2"]:  # here both orders of a pair are counted
                keep &= u < v
            if keep.any():
                x, y = pa_[u[keep]], pb[v[keep]]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y), "times": times[keep]})

        at, open_, held = 0, -1, None  # a person whose rows go on in the next batch is held
        while at < len(ta):
            begin = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, begin + _PAIRS, "right")))
            x = np.repeat(np.arange(at, end), n[at:end])
            y = np.arange(begin, begin + len(x)) + shift[x]
            cell, times = _cells((ua[x] - ua[at]) * width + ub[y], ca[x] * cb[y] if weighted else None, int(ua[end - 1] - ua[at] + 1) * width)
            u, v = cell // width + ua[at], cell % width
            if open_ == ua[at]:
                mine = u == open_
                held[v[mine]] += times[mine]
                u, v, times = u[~mine], v[~mine], times[~mine]
            if open_ >= 0 and (open_ != ua[at] or ua[end - 1] != open_):
                yield from hits(np.full(width, open_), np.arange(width), held)
                open_ = -1
            if open_ < 0 and end < len(ta) and ua[end] == ua[end - 1]:
                open_, mine = ua[end - 1], u == ua[end - 1]
                held = np.zeros(width, np.int64)
                held[v[mine]] = times[mine]
                u, v, times = u[~mine], v[~mine], times[~mine]
            yield from hits(u, v, times)
            at = end
        if open_ >= 0:
            yield from hits(np.full(width, open_), np.arange(width), held)

    return first.hint("shuffle_replicate_nl").join(second, F.col("k1") <= F.col("k2")).mapInArrow(count, "a long, b long, times long")


def with_lags(series: DataFrame, date: str, value: str, keys: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """keys, lag, date, value: each value moved to date - lag, so that an equi-join on date reads the value `lag` days ahead."""
    return series.select(*keys, F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(date).alias("_d"), F.col(value).alias(value)).select(*keys, "lag", F.expr("date_sub(_d, lag)").alias(date), value)


def day_index(series: DataFrame, date: str) -> DataFrame:
    """date, idx: dense numbers of the dates present. One row for each day, so the window is small."""
    days = series.select(date).distinct()
    return days.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(date)))


def around_events(series: DataFrame, events: DataFrame, date: str, event_date: str, days: int) -> DataFrame:
    """Series rows within `days` days of an event, with offset (0 on the day), by an equi-join on the exploded days."""
    spread = events.withColumn("offset", F.explode(F.array(*map(F.lit, range(-days, days + 1))))).withColumn(date, F.expr(f"date_add({event_date}, `offset`)"))
    return series.join(spread, date)


def similar_names(df: DataFrame, name: str, least: float) -> DataFrame:
    """name < other, sim: pairs of distinct names with trigram similarity above `least`.

    Distinct names meet by shared trigrams (prefix filtering: a pair above `least` shares one of the rarest
    trigrams of each name), then the similarity is computed.
    """
    names = df.select(F.col(name).alias("name")).filter("name is not null").distinct()
    grams = names.select("name", F.explode(similarity.trigrams(F.col("name"))).alias("g"))
    rarity = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("df", "g"))
    ranked = grams.join(rarity, "g").withColumn("place", place).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("name")))
    # Two sets with Jaccard above t share a gram among the first size - ceil(t * size) + 1 in any common order.
    prefix = ranked.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select("name", "g", "size")
    other = prefix.select(F.col("name").alias("other"), "g", F.col("size").alias("osize"))
    pairs = prefix.join(other, "g").filter((F.col("name") < F.col("other")) & (F.least("size", "osize") > least * F.greatest("size", "osize"))).select("name", "other").distinct()
    return pairs.withColumn("sim", similarity.trigram_similarity(F.col("name"), F.col("other"))).filter(F.col("sim") > least)


def best_match(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """name, match, sim: for each distinct name of left the most similar of right (trigrams, above `least`; ties to the smaller).

    Names meet by a shared trigram among the rarest ones of both (prefix filtering, as in similar_names), so no pair above
    `least` is missed and no nested loop is needed.
    """
    grams = left.select(F.col("name"), F.lit(0).alias("side")).union(right.select("match", F.lit(1))).filter("name is not null").distinct()
    grams = grams.select("name", "side", F.explode(similarity.trigrams(F.col("name"))).alias("g"))
    rarity = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    mine = Window.partitionBy("side", "name")
    ranked = grams.join(rarity, "g").withColumns({"place": F.row_number().over(mine.orderBy("df", "g")), "size": F.count(F.lit(1)).over(mine)})
    prefix = ranked.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least) + 1)
    a, b = prefix.filter("side = 0").select("g", "name"), prefix.filter("side = 1").select("g", F.col("name").alias("match"))
    scored = a.join(b, "g").select("name", "match").distinct().withColumn("sim", similarity.trigram_similarity(F.col("name"), F.col("match"))).filter(F.col("sim") > least)
    return scored.groupBy("name").agg(F.min(F.struct((-F.round("sim", 9)).alias("k"), "match", "sim")).alias("m")).select("name", "m.match", "m.sim")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The last row of each key by `order` (max of a struct: one aggregation with map-side combine, no window)."""
    s = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), *(F.col(c) for c in columns))
    return df.groupBy(*keys).agg(F.max(s).alias("s")).select(*keys, *(F.col(f"s.{c}").alias(c) for c in columns))
