"""Findings about queues, the mood index with its calendar, rejected pairs, hints of facts and names that become complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import knowledge, monitor
from tidewater.plans.base import Registry, table

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle

_NOW = "TIMESTAMP '2024-02-01 00:00:00'"
#: Orders as jobs and events as model calls, moved to the hours before a time; columns that both dialects read alike.
_JOBS = (
    "CASE WHEN o_custkey % 5 = 0 THEN 'journal' WHEN o_custkey % 5 = 1 THEN 'backfill' ELSE lower(o_orderpriority) END AS job_type", "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE CASE WHEN o_custkey % 3 = 0 THEN 'failed' ELSE 'completed' END END AS status",
    f"{_NOW} - INTERVAL '1' SECOND * (o_orderkey % 40000 + 1) AS updated_at", f"{_NOW} - INTERVAL '1' SECOND * (o_orderkey % 3000) AS claimed_at", f"{_NOW} - INTERVAL '1' SECOND * (9000 + o_orderkey % 40000) AS completed_at", "CASE WHEN o_orderkey % 7 <> 0 THEN 'error ' || o_orderkey END AS last_error",
)
_USAGE = (f"{_NOW} - INTERVAL '1' SECOND * (event_id * 60) AS called_at", "event_id % 9 = 0 AS fallback", "CASE WHEN event_id % 8 = 0 THEN props END AS error")
_CHECKS = "(SELECT DISTINCT job_type, 'label of ' || job_type AS label, CASE WHEN job_type = 'backfill' THEN 9e0 ELSE 1e0 END AS warn_hours, CASE WHEN job_type = 'journal' THEN 99e0 ELSE 2e0 END AS critical_hours FROM j)"


@_r.add(
    "queue_findings",
    f"""WITH j AS (SELECT {", ".join(_JOBS)} FROM orders), u AS (SELECT {", ".join(_USAGE)} FROM events), n AS (SELECT {_NOW} AS t),
    h AS (SELECT count(*) FILTER (status = 'failed') AS f, count(*) AS c FROM j, n WHERE updated_at >= t - INTERVAL 1 HOUR AND status IN ('failed', 'completed')),
    x AS (SELECT job_type, count(*) AS k FROM j, n WHERE status = 'failed' AND updated_at >= t - INTERVAL 1 HOUR GROUP BY 1 HAVING count(*) >= 3 ORDER BY k DESC, job_type LIMIT 10), l AS (SELECT job_type, arg_max(coalesce(last_error, ''), (updated_at, coalesce(last_error, ''))) AS e FROM j WHERE status = 'failed' GROUP BY 1),
    d AS (SELECT count(*) FILTER (status = 'pending') AS p, count(*) FILTER (status = 'processing' AND claimed_at < t - INTERVAL 20 MINUTE) AS s, string_agg(DISTINCT job_type, ', ' ORDER BY job_type) FILTER (status = 'processing' AND claimed_at < t - INTERVAL 20 MINUTE) AS types FROM j, n),
    r AS (SELECT c.*, (epoch_us(t) - epoch_us(m)) / 36e8 AS hours FROM {_CHECKS} c JOIN (SELECT job_type, max(completed_at) AS m FROM j WHERE status = 'completed' GROUP BY 1) USING (job_type), n), m AS (SELECT count(*) AS c, count(*) FILTER (fallback) AS f, count(error) AS e FROM u, n WHERE called_at >= t - INTERVAL 1 HOUR),
    a AS (SELECT 'job-failures' AS source, CASE WHEN f / c > 0.5 THEN 'critical' WHEN f / c >= 0.2 THEN 'warning' END AS severity, 'job-failure-rate-' || CASE WHEN f / c > 0.5 THEN 'critical' ELSE 'warning' END AS fingerprint, CAST(f / c AS DOUBLE) AS value, f || '/' || c AS note FROM h
    UNION ALL SELECT 'job-failures', CASE WHEN k >= 10 THEN 'critical' ELSE 'warning' END, 'job-type-failing-' || job_type, k, coalesce(nullif(e, ''), 'unknown') FROM x JOIN l USING (job_type) UNION ALL SELECT 'queue-depth', CASE WHEN p > 500 THEN 'critical' WHEN p > 200 THEN 'warning' END, 'queue-depth-' || CASE WHEN p > 500 THEN 'critical' ELSE 'warning' END, p, NULL FROM d
    UNION ALL SELECT 'queue-depth', CASE WHEN s >= 5 THEN 'critical' WHEN s > 0 THEN 'warning' END, 'stuck-jobs', s, types FROM d UNION ALL SELECT 'subsystem-recency', CASE WHEN hours > critical_hours THEN 'critical' WHEN hours > warn_hours THEN 'warning' END, 'subsystem-stale-' || job_type, hours, label FROM r
    UNION ALL SELECT 'model-health', CASE WHEN f > 10 THEN 'critical' WHEN f >= 3 THEN 'warning' END, 'model-fallback-' || CASE WHEN f > 10 THEN 'critical' ELSE 'warning' END, f, CAST(c AS VARCHAR) FROM m UNION ALL SELECT 'model-health', CASE WHEN e > 5 THEN 'warning' END, 'model-errors-warning', e, CAST(c AS VARCHAR) FROM m)
    SELECT source, severity, fingerprint, round(value, 4) AS value, note FROM a WHERE severity IS NOT NULL""",
)
def queue_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a monitor finds about a queue at one time."""
    jobs, usage = table(spark, sf_dir, "orders").selectExpr(*_JOBS), table(spark, sf_dir, "events").selectExpr(*_USAGE).withColumnRenamed("called_at", "at")
    kind = F.col("job_type")
    checks = jobs.select(kind, F.concat(F.lit("label of "), kind).alias("label"), F.when(kind == "backfill", 9.0).otherwise(1.0).alias("warn_hours"), F.when(kind == "journal", 99.0).otherwise(2.0).alias("critical_hours")).distinct()
    return monitor.findings(jobs, usage, checks, F.expr(_NOW)).withColumn("value", F.round("value", 4))


_RATIO = "CASE WHEN avg({0}) OVER x > 0 THEN {0} / avg({0}) OVER x END"


@_r.add(
    "mood_index",
    f"""WITH w AS (SELECT CAST(ts AS DATE) AS date, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS texts, CAST(nullif(count(*) FILTER (event_type = 'view' AND user_id < 9), 0) AS DOUBLE) AS mails, CAST(count(*) FILTER (event_type = 'signup' AND user_id % 6 = 0) AS DOUBLE) AS meetings, avg(value) FILTER (event_type = 'error' AND event_id % 5 = 0) / 100 AS feeling FROM events GROUP BY 1),
    r AS (SELECT date, {_RATIO.format("texts")} AS a, {_RATIO.format("mails")} AS b, {_RATIO.format("meetings")} AS c, feeling AS d FROM w WINDOW x AS (ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
    s AS (SELECT date, list_filter([CASE WHEN a IS NOT NULL THEN least(1e0, a) END, CASE WHEN b IS NOT NULL THEN least(1e0, b) END, d, CASE WHEN c > 1.5 THEN greatest(0e0, 1 - (c - 15e-1)) WHEN c < 0.5 THEN c * 2 WHEN c IS NOT NULL THEN 1e0 END], lambda v: v IS NOT NULL) AS s FROM r)
    SELECT date, CASE WHEN len(s) > 0 THEN floor(list_sum(s) / len(s) * 100 + 0.5) / 100 ELSE 0.5 END AS mood FROM s""",
)
def mood_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and mails against their means, the feeling as it is, and a calendar neither empty nor full."""
    kind, user = F.col("event_type"), F.col("user_id")
    w = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(
        F.count_if(kind == "click").cast("double").alias("texts"), F.nullif(F.count_if((kind == "view") & (user < 9)), F.lit(0)).cast("double").alias("mails"), F.count_if((kind == "signup") & (user % 6 == 0)).cast("double").alias("meetings"),
        (F.avg(F.when((kind == "error") & (F.col("event_id") % 5 == 0), F.col("value"))) / 100).alias("feeling"),
    )
    return monitor.mood_index(w, ["texts", "mails"], ["feeling"], ["meetings"])


@_r.add(
    "rejected_pairs",
    """SELECT l_partkey AS pair, confirmed, exceptions, CASE WHEN status = 'pending' AND exceptions > confirmed AND confirmed > 0 AND found < TIMESTAMP '2000-01-01' - INTERVAL 30 DAY THEN 'rejected' ELSE status END AS status
    FROM (SELECT l_partkey, count(*) FILTER (l_returnflag = 'N') AS confirmed, count(*) FILTER (l_returnflag = 'R') AS exceptions, CASE WHEN l_partkey % 4 = 0 THEN 'accepted' ELSE 'pending' END AS status, min(l_shipdate) + INTERVAL 1 DAY * (l_partkey % 2000) AS found FROM lineitem GROUP BY l_partkey)""",
)
def rejected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (parts) with the counts of days that confirmed them and that didn't."""
    k, flag = F.col("l_partkey"), F.col("l_returnflag")
    found = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_if(flag == "N").alias("confirmed"), F.count_if(flag == "R").alias("exceptions"), F.min("l_shipdate").alias("lo"))
    found = found.select(k.alias("pair"), "confirmed", "exceptions", F.when(k % 4 == 0, "accepted").otherwise("pending").alias("status"), (F.col("lo") + F.make_dt_interval((k % 2000).cast("int"))).alias("discovered_at"))
    return monitor.invalidated(found, F.expr("timestamp_ntz'2000-01-01 00:00:00'")).select("pair", "confirmed", "exceptions", "status")


_FACT = (
    "p_partkey AS fact_id", "CASE p_partkey % 7 WHEN 0 THEN 'people' WHEN 1 THEN 'communication' WHEN 2 THEN 'places' WHEN 3 THEN 'events' WHEN 4 THEN 'health' WHEN 5 THEN 'career' ELSE 'misc' END AS domain",
    "CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '_') || '_relationship' WHEN 1 THEN split_part(p_name, ' ', 1) || '_career' WHEN 2 THEN replace(p_name, ' ', '_') || '_12' WHEN 3 THEN 'x_' || p_name ELSE 'new_' || split_part(p_name, ' ', 2) || '_trips' END AS key", "'Saw ' || upper(p_name) || ' at ' || p_type AS value",
)
_WORDS = "list_filter(string_split({}, '_'), lambda p: p <> '')"
_TITLED = "array_to_string(list_transform({}, lambda p: upper(p[1]) || lower(p[2:])), ' ')"


@_r.add(
    "fact_hints",
    f"""WITH f AS (SELECT {", ".join(_FACT)} FROM part), c AS (SELECT min(p_partkey) AS contact_id, p_name AS name FROM part GROUP BY p_name HAVING min(p_partkey) % 3 <> 0),
    s AS (SELECT fact_id, CASE WHEN len(w) BETWEEN 1 AND 4 AND len(list_filter(w, lambda p: NOT regexp_matches(p, '^[a-zA-Z]{{2,}}$'))) = 0 THEN {_TITLED.format("w")} END AS said FROM (SELECT fact_id, {_WORDS.format(f"regexp_replace(regexp_replace(key, '_({'|'.join(knowledge.PERSON_ENDS)})$', ''), '_[0-9]+$', '')")} AS w FROM f WHERE domain IN ('people', 'communication'))),
    m AS (SELECT fact_id, said, min(c.contact_id) AS contact_id FROM s LEFT JOIN c ON c.name = lower(said) OR starts_with(c.name, lower(said) || ' ') WHERE said IS NOT NULL GROUP BY 1, 2)
    SELECT fact_id, coalesce(c.name, said) AS name, 'person' AS type, 'subject' AS role, m.contact_id FROM m LEFT JOIN c ON c.contact_id = m.contact_id
    UNION ALL SELECT f.fact_id, c.name, 'person', 'object', c.contact_id FROM f JOIN c ON contains(lower(value), lower(c.name)) LEFT JOIN s ON s.fact_id = f.fact_id WHERE domain IN ('people', 'communication') AND (said IS NULL OR lower(said) <> c.name)
    UNION ALL SELECT fact_id, {_TITLED.format("w")}, 'place', 'location', NULL FROM (SELECT fact_id, {_WORDS.format(f"regexp_replace(key, '_({'|'.join(knowledge.PLACE_ENDS)})$', '')")} AS w FROM f WHERE domain IN ('places', 'events')) WHERE len(w) BETWEEN 1 AND 3
    UNION ALL SELECT fact_id, CASE domain WHEN 'health' THEN 'Health & Fitness' WHEN 'career' THEN 'Career & Work' ELSE 'Life Events' END, 'topic', 'topic', NULL FROM f WHERE domain IN ('health', 'career', 'events')""",
)
def fact_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons, places and topics that facts speak of, by their keys, values and domains."""
    p = table(spark, sf_dir, "part")
    contacts = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("contact_id")).filter("contact_id % 3 != 0")
    return knowledge.hints(p.selectExpr(*_FACT), contacts)


_SEEN = "CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN upper(p_name) ELSE p_name || '  of ' || p_brand END"


@_r.add(
    "complete_names",
    f"""WITH RECURSIVE e AS (SELECT p_size AS entity_id, arg_min(split_part(p_name, ' ', 1), p_partkey) AS name FROM part GROUP BY 1), s AS (SELECT p_size AS entity_id, {_SEEN} AS name, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice, p_partkey) AS k FROM part),
    f AS (SELECT entity_id, name, CAST(0 AS BIGINT) AS k FROM e UNION ALL SELECT f.entity_id, CASE WHEN len(string_split_regex(trim(s.name), ' +')) > len(string_split_regex(trim(f.name), ' +')) AND contains(regexp_replace(lower(trim(s.name)), ' +', ' ', 'g'), regexp_replace(lower(trim(f.name)), ' +', ' ', 'g')) THEN trim(s.name) ELSE f.name END, s.k FROM f JOIN s ON s.entity_id = f.entity_id AND s.k = f.k + 1)
    SELECT entity_id, name FROM f QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY k DESC) = 1""",
)
def complete_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of entities (sizes) after all names seen of them, in order of price."""
    p = table(spark, sf_dir, "part")
    entities = p.groupBy(F.col("p_size").alias("entity_id")).agg(F.min_by(F.split_part("p_name", F.lit(" "), F.lit(1)), "p_partkey").alias("name"))
    return knowledge.complete_names(entities, p.select(F.col("p_size").alias("entity_id"), F.col("p_retailprice").alias("at"), F.col("p_partkey").alias("id"), F.expr(_SEEN).alias("name")))
