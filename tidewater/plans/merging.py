"""Merges, their undoing and dismissed candidates over the parts: equal names are one entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import merges, resolve
from tidewater.plans.base import Registry, table

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle

_ENTITY = merges.Entity("entities", "id", "name", "aliases", ("size",), "active", "notes")
_CHILDREN = [merges.Child("links", "owner", ("link_id",), ("platform", "identifier")), merges.Child("baskets", "parts", ("basket",), array=True), merges.Child("firsts", "part", ("order",))]


def _tables(spark: SparkSession, sf_dir: str) -> merges.Tables:
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey")  # moved once for both tables made of them
    k = F.col("p_partkey")
    links = [part.select((2 * k + i).alias("link_id"), k.alias("owner"), F.lit(platform).alias("platform"), F.col(c).alias("identifier")) for i, platform, c in ((0, "brand", "p_brand"), (1, "kind", "p_type"))]
    return {
        "entities": part.select(k.alias("id"), F.col("p_name").alias("name"), F.lit(True).alias("active"), F.lit(None).cast("string").alias("notes"), F.array(F.lower("p_brand")).alias("aliases"), F.col("p_size").cast("long").alias("size")),
        "links": links[0].union(links[1]),
        "baskets": lines.groupBy(F.col("l_orderkey").alias("basket")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("parts")),
        "firsts": lines.groupBy(F.col("l_orderkey").alias("order")).agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("part")),
    }


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of parts with one name the largest (then the oldest, then the first) stays; every third request takes the merged one's size. Merges of a keeper are some days old together."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("fact_count"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 700).cast("int")).alias("created"))
    m = resolve.survivors(part, ["name"])
    choice = F.when(F.col("merged") % 3 == 0, F.create_map(F.lit("size"), F.lit("b"))).otherwise(F.create_map(F.lit("size"), F.lit("a")))
    return m.select(F.col("merged").alias("candidate_id"), F.col("survivor").alias("keeper_id"), F.col("merged").alias("merged_id"), choice.alias("choices"), F.lit("auto").alias("merged_by"), (F.lit("2024-03-01").cast("timestamp") - F.make_dt_interval((F.col("survivor") % 60).cast("int"))).alias("merged_at"))


def _lines(t: merges.Tables) -> DataFrame:
    """The tables as rows (place, id, detail)."""

    def text(place: str, df: DataFrame, id_: str, detail: Column) -> DataFrame:
        return df.select(F.lit(place).alias("place"), F.col(id_).alias("id"), detail.alias("detail"))

    parts = [
        text("entities", t["entities"], "id", F.concat_ws("|", F.col("active").cast("string"), F.coalesce("notes", F.lit("-")), F.array_join("aliases", ","), F.col("size").cast("string"))),
        text("links", t["links"], "link_id", F.concat_ws("|", F.col("owner").cast("string"), "platform", "identifier")),
        text("baskets", t["baskets"], "basket", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",")),
        text("firsts", t["firsts"], "order", F.col("part").cast("string")),
    ]
    return reduce(DataFrame.union, parts)


#: All requests, and the rows of the tables after those merges that a condition on them leaves.
_MERGES = """q AS (SELECT p_partkey AS merged, first_value(p_partkey) OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey % 700, p_partkey) AS keeper FROM part)"""


def _after(where: str) -> str:
    return f"""WITH {_MERGES}, m AS (SELECT merged, keeper FROM q WHERE merged <> keeper AND ({where})),
    gained AS (SELECT keeper, list(lower(p_brand)) AS aliases, max(CASE WHEN merged % 3 = 0 THEN struct_pack(c := merged, s := p_size) END) AS chosen FROM m JOIN part ON p_partkey = merged GROUP BY 1),
    e AS (SELECT p_partkey AS id, m.merged IS NULL AS active, ' [merged into ' || m.keeper || ']' AS notes, CASE WHEN g.keeper IS NULL THEN [lower(p_brand)] ELSE list_sort(list_distinct(list_append(g.aliases, lower(p_brand)))) END AS aliases, coalesce(g.chosen.s, p_size) AS size
      FROM part LEFT JOIN gained g ON g.keeper = p_partkey LEFT JOIN m ON m.merged = p_partkey),
    l AS (SELECT 2 * p_partkey AS link_id, p_partkey AS owner, 'brand' AS platform, p_brand AS identifier FROM part UNION ALL SELECT 2 * p_partkey + 1, p_partkey, 'kind', p_type FROM part),
    moved AS (SELECT l.link_id, coalesce(m.keeper, l.owner) AS owner, platform, identifier, m.merged FROM l LEFT JOIN m ON m.merged = l.owner),
    kept AS (SELECT link_id, owner, platform, identifier FROM moved QUALIFY row_number() OVER (PARTITION BY owner, platform, identifier ORDER BY merged NULLS FIRST, link_id) = 1),
    b AS (SELECT l_orderkey, string_agg(CAST(coalesce(m.keeper, l_partkey) AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem LEFT JOIN m ON m.merged = l_partkey GROUP BY 1),
    f AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY 1)
    SELECT 'entities' AS place, id, concat_ws('|', CASE WHEN active THEN 'true' ELSE 'false' END, coalesce(notes, '-'), array_to_string(aliases, ','), CAST(size AS VARCHAR)) AS detail FROM e
    UNION ALL SELECT 'links', link_id, concat_ws('|', CAST(owner AS VARCHAR), platform, identifier) FROM kept UNION ALL SELECT 'baskets', l_orderkey, parts FROM b UNION ALL SELECT 'firsts', l_orderkey, CAST(coalesce(m.keeper, part) AS VARCHAR) FROM f LEFT JOIN m ON m.merged = part"""


_AS_OF = "2024-03-01"
#: Undoing all merges of even keepers: within 30 days they are undone.
_KEPT = "keeper % 2 = 1 OR keeper % 60 > 30"


@_r.add("merge_tables", _after("true"))
def merge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, links, arrays and references after the merges."""
    return _lines(merges.execute(_tables(spark, sf_dir), _requests(spark, sf_dir), _ENTITY, _CHILDREN, 1)[0])


def _undone(spark: SparkSession, sf_dir: str, wanted: Column) -> tuple[merges.Tables, merges.Log, DataFrame]:
    requests = _requests(spark, sf_dir)
    tables, log, _ = merges.execute(_tables(spark, sf_dir), requests, _ENTITY, _CHILDREN, 1)
    return merges.undo(tables, log, requests.filter(wanted).select(F.col("candidate_id").alias("audit_id")), _ENTITY, _CHILDREN, F.lit(_AS_OF).cast("timestamp"))


@_r.add("merge_undo_tables", _after(_KEPT))
def merge_undo_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables after all merges and the undoing of those of even keepers: as if only the others had been."""
    return _lines(_undone(spark, sf_dir, F.col("keeper_id") % 2 == 0)[0])


@_r.add("merge_undo_all", _after("keeper % 60 > 30"))
def merge_undo_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables after all merges and all undoings that are in time."""
    return _lines(_undone(spark, sf_dir, F.lit(True))[0])


@_r.add(
    "merge_undo_status",
    f"""WITH {_MERGES}, m AS (SELECT * FROM q WHERE merged <> keeper), w AS (SELECT *, merged % 4 <> 1 OR keeper % 3 = 0 AS wanted FROM m), lone AS (SELECT w.keeper, bool_and(wanted) AS whole FROM w GROUP BY 1)
    SELECT merged AS audit_id, CASE WHEN w.keeper % 60 > 30 THEN 'expired' WHEN NOT whole THEN 'blocked' ELSE 'undone' END AS status FROM w JOIN lone USING (keeper) WHERE wanted""",
)
def merge_undo_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of undoings where of some keepers a part of the merges is wanted only."""
    return _undone(spark, sf_dir, (F.col("merged_id") % 4 != 1) | (F.col("keeper_id") % 3 == 0))[2]


@_r.add(
    "merge_decisions",
    """WITH d AS (SELECT user_id AS id, ts, CASE event_type WHEN 'error' THEN 'skipped' WHEN 'purchase' THEN 'merged' ELSE 'deferred' END AS decision FROM events WHERE event_type IN ('error', 'purchase', 'signup')),
    s AS (SELECT *, CASE WHEN decision = 'skipped' THEN row_number() OVER (PARTITION BY id, decision ORDER BY ts) END AS nth FROM d),
    g AS (SELECT id, count(nth) AS skips, min(CASE WHEN nth = 3 - id % 3 THEN ts END) AS third, max(CASE WHEN decision <> 'skipped' THEN ts END) AS other, arg_max(decision, CASE WHEN decision <> 'skipped' THEN ts END) AS last FROM s GROUP BY 1)
    SELECT c.id AS candidate_id, CASE WHEN third IS NOT NULL AND (other IS NULL OR third > other) THEN 'dismissed' ELSE coalesce(last, 'pending') END AS status, c.id % 3 + coalesce(skips, 0) AS skip_count,
    CASE WHEN third IS NOT NULL AND (other IS NULL OR third > other) THEN third ELSE other END AS decided_at FROM (SELECT DISTINCT user_id AS id FROM events) c LEFT JOIN g ON g.id = c.id""",
)
def merge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates (users, with some skips to begin with) after decisions (their errors skip, purchases merge, sign-ups defer)."""
    e = table(spark, sf_dir, "events")
    none = F.lit(None)
    candidates = e.select(F.col("user_id").alias("candidate_id")).distinct().select("candidate_id", F.lit("pending").alias("status"), (F.col("candidate_id") % 3).alias("skip_count"), none.cast("string").alias("decided_by"), none.cast("timestamp_ntz").alias("decided_at"))
    kind = F.when(F.col("event_type") == "error", "skipped").when(F.col("event_type") == "purchase", "merged").otherwise("deferred")
    decisions = e.filter(F.col("event_type").isin("error", "purchase", "signup")).select(F.col("user_id").alias("candidate_id"), kind.alias("decision"), F.lit("owner").alias("by"), F.col("ts").alias("at"))
    return merges.decide(candidates, decisions).select("candidate_id", "status", "skip_count", "decided_at")
