"""Pairs of rows that share a key, where a key may hold any share of the rows.

A plain join on the key makes one task of each key, whose work is the square of its rows. Here a key of more than `block` rows is
cut into parts of about `block`, and its parts meet two by two, each meeting being a key of its own: no task holds
more than two parts of a key, and a key with a third of all rows spreads over all tasks. Keys below stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key that meet in one task.
_BLOCK = 1_000
#: Rows that a task groups or joins.
_ROWS = 250_000
#: Pairs that a task makes or groups.
_PAIRS = 1_000_000
#: Pairs that a task makes where they are scored at once and not kept, and rows of a part that meets another there.
_SCORED, _SCORED_BLOCK = 8_000_000, 2_000
#: Keys cut into parts up to which their numbers of parts are broadcast.
_MOST_BROADCAST = 100_000


def parts_of(rows: DataFrame) -> int:
    """Partitions that rows need, by their number: adaptive execution sizes partitions by compressed bytes, of which keys and counts need few, and up to spark.sql.shuffle.partitions only."""
    return rows.count() // _ROWS + 1


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys over as many partitions as they need; grouping by these and further columns needs no other shuffle."""
    return rows.repartition(parts_of(rows), *keys)


def _large(rows: DataFrame, keys: Sequence[str], block: int) -> DataFrame | None:
    """keys and their number of parts, of those with more than one; marked for broadcast where they are few. None: there are none."""
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > block).select(*keys, F.ceil(F.col("_c") / block).cast("int").alias("_parts"))
    n = large.limit(_MOST_BROADCAST + 1).count()
    return None if not n else F.broadcast(large) if n <= _MOST_BROADCAST else large


def _with(rows: DataFrame, large: DataFrame | None, keys: Sequence[str], name: str = "_parts") -> DataFrame:
    """rows with the number of parts of their key in column `name`."""
    return rows.withColumn(name, F.lit(1)) if large is None else rows.join(large.withColumnRenamed("_parts", name), list(keys), "left").withColumn(name, F.coalesce(name, F.lit(1)))


def _part(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.col("_parts")).cast("int")


def _tasks(rows: DataFrame, keys: Sequence[str], each: int = _PAIRS) -> int:
    """Partitions for the pairs of rows: the input's size doesn't tell their number, so it is counted."""
    n = F.count(F.lit(1))
    pairs = rows.groupBy(*keys).agg((n * (n - 1) / 2).alias("_n")).agg(F.sum("_n")).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // each) + 1)


def within(rows: DataFrame, keys: Sequence[str], item: str, carry: Sequence[str] = (), block: int = _BLOCK, by_pair: bool = False) -> DataFrame:
    """keys, a, b (items, a < b), and of each column in carry that of a and of b (name_a, name_b): each two rows of a key with different items, once. Rows without an item meet nobody.

    by_pair: the pairs come dealt by a and b, in as many partitions as they need, so that grouping by these holds a bounded number in a task.
    """
    rows = rows.filter(F.col(item).isNotNull()).select(*keys, item, *carry)
    large = _large(rows, keys, block)
    tasks = _tasks(rows, keys)
    side = {s: [F.col(item).alias(s), *(F.col(c).alias(f"{c}_{s}") for c in carry)] for s in "ab"}
    if large is None:
        left, right = (rows.select(*keys, *side[s]) for s in "ab")
        met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), list(keys)).filter("a < b")
        return met.repartition(tasks, "a", "b") if by_pair else met
    cut, part, last = _with(rows, large, keys), _part(item), F.col("_parts") - 1
    left = cut.withColumn("_i", part).select(*keys, *side["a"], "_i", F.explode(F.sequence("_i", last)).alias("_j"))
    right = cut.withColumn("_j", part).select(*keys, *side["b"], F.explode(F.sequence(F.lit(0), "_j")).alias("_i"), "_j")
    left, right = (x.repartition(tasks, *keys, "_i", "_j") for x in (left, right))
    met = left.join(right, [*keys, "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col("a") < F.col("b")))
    turn = F.col("a") > F.col("b")
    out = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    for c in carry:
        out += [F.when(turn, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_a"), F.when(turn, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_b")]
    met = met.select(*keys, *out)
    return met.repartition(tasks, "a", "b") if by_pair else met


def meetings(rows: DataFrame, keys: Sequence[str], item: str, block: int = _SCORED_BLOCK) -> DataFrame:
    """rows dealt by keys, _i, _j, the parts of a key that meet: a row comes once for each part of its key, with _second where its part is the later of two. Grouped by
    these columns, each two rows of a key are together in one group, in different parts of it (or in the one part). Rows without an item meet nobody."""
    rows = rows.filter(F.col(item).isNotNull())
    cut = _with(rows, _large(rows, keys, block), keys).withColumn("_k", _part(item))
    cut = cut.select(*rows.columns, "_k", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_o"))
    met = cut.select(*rows.columns, F.least("_k", "_o").alias("_i"), F.greatest("_k", "_o").alias("_j"), (F.col("_k") > F.col("_o")).alias("_second"))
    return met.repartition(_tasks(rows, keys, _SCORED), *keys, "_i", "_j")


def shared(rows: DataFrame, key: str, item: str, block: int = _BLOCK) -> DataFrame:
    """a, b (items, a < b), shared: the number of keys that two items have in common. A pair counts at the first of them only, so pairs aren't moved to be counted; an item with several keys brings them along."""
    keys = rows.filter(F.col(key).isNotNull()).groupBy(item).agg(F.collect_set(key).alias("_keys"))
    met = within(keys.select(item, F.explode("_keys").alias(key), F.when(F.size("_keys") > 1, F.col("_keys")).alias("_keys")), [key], item, ["_keys"], block)
    both = F.array_intersect("_keys_a", "_keys_b")
    return met.filter(both.isNull() | (F.array_min(both) == F.col(key))).select("a", "b", F.when(both.isNull(), 1).otherwise(F.size(both)).cast("long").alias("shared"))


def between(left: DataFrame, right: DataFrame, keys: Sequence[str], block: int = _BLOCK) -> DataFrame:
    """The join of two sides on keys; other columns have different names. Both sides of a large key are cut, and each part of one meets each of the other."""
    large = [_large(x, keys, block) for x in (left, right)]
    if large == [None, None]:
        return left.join(right, list(keys))
    out = []
    for x, mine, theirs, names in ((left, *large, ("_i", "_j")), (right, *large[::-1], ("_j", "_i"))):
        cut = _with(_with(x, mine, keys), theirs, keys, "_others")
        out.append(cut.select(*x.columns, _part(*x.columns).alias(names[0]), F.explode(F.sequence(F.lit(0), F.col("_others") - 1)).alias(names[1])))
    return out[0].join(out[1], [*keys, "_i", "_j"]).drop("_i", "_j")
