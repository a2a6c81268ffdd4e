"""Tables written as import files and read back by the sources, and the rules on identifiers, dates, numbers and versions that imports need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import classify, identifiers
from tidewater.plans.base import Registry, table
from tidewater.sources import files, sinks
from tidewater.sql import read_only
from tidewater.streaming.flows import scratch

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle


@_r.add("json_lines_import", "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def json_lines_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by way of JSON lines; all fit their schema."""
    path = scratch(spark, "json-lines")
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").write.json(path)
    rows = files.json_records(spark, path, "event_id long, user_id long, event_type string, value double")
    return rows.filter("_corrupt_record is null").select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


@_r.add("json_documents_import", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def json_documents_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by way of whole-file JSON: an array of records a file, or an object whose first array that isn't empty holds them."""
    path = scratch(spark, "json-documents")
    rows = F.collect_list(F.struct("p_partkey", "p_name", F.col("p_size").cast("long").alias("p_size")))
    docs = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 20).alias("k")).agg(F.to_json(rows).alias("items"))
    doc = F.when(F.col("k") % 2 == 0, F.col("items")).otherwise(F.concat(F.lit('{"meta": {"n": 1}, "none": [], "items": '), "items", F.lit("}")))
    docs.select("k", doc.alias("value")).repartition("k").write.partitionBy("k").text(path)
    return files.json_documents(spark, path, "p_partkey long, p_name string, p_size long")


@_r.add("delimited_import", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(CASE WHEN doc_id % 3 > 0 THEN lang END, '') AS lang, 'a \"quoted\" ' || source || ', x' AS remark FROM documents")
def delimited_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by way of TSV with a header, quotes and missing values."""
    path = scratch(spark, "tsv")
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"), F.concat(F.lit('a "quoted" '), "source", F.lit(", x")).alias("remark"))
    rows.write.csv(path, header=True, sep="\t", escape='"')
    return files.delimited(spark, path, "doc_id string, lang string, remark string", "\t")


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mails of mbox files: encoded subjects, quoted-printable and HTML bodies, labels, threads."""
    path, k = scratch(spark, "mbox"), F.col("o_orderkey")
    lines: list[Column] = [
        F.concat(F.lit("From sender@x.org Mon Jan  1 00:00:00 2024\nMessage-ID: <"), k, F.lit("@x.org>\nX-GM-THRID: "), F.when(k % 4 > 0, F.concat(F.lit("t"), F.col("o_custkey"))).otherwise(""), F.lit("\nFrom: =?utf-8?q?C=C3=A9line?= <c"), F.col("o_custkey"), F.lit("@x.org>\n")),
        F.concat(F.lit("Date: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nSubject: =?utf-8?b?w6k=?= "), k, F.lit("\nX-Gmail-Labels: "), F.when(k % 9 == 0, "Inbox,Spam").when(k % 9 == 1, "Trash").otherwise("Inbox"), F.lit("\n")),
        F.when(k % 2 == 0, F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\nCaf=C3=A9 "), k, F.lit(" =\ngoes on\n"))).otherwise(F.concat(F.lit("Content-Type: text/html; charset=utf-8\n\n<p>Bread</p>"), k, F.lit("\n"))),
    ]
    table(spark, sf_dir, "orders").select(F.concat(*lines).alias("value")).write.text(path)
    return files.mail_box(spark, path)


_THREAD = "CASE WHEN o_orderkey % 4 > 0 THEN 't' || o_custkey ELSE '<' || o_orderkey || '@x.org>' END"
_LABEL = "CASE o_orderkey % 9 WHEN 0 THEN 'spam' WHEN 1 THEN 'trash' END"


@_r.add("mail_import", f"""SELECT '<' || o_orderkey || '@x.org>' AS message_id, {_THREAD} AS thread_id, 'Céline <c' || o_custkey || '@x.org>' AS sender, 'é ' || o_orderkey AS subject, CASE WHEN o_orderkey % 2 = 0 THEN 'Café ' || o_orderkey || ' goes on' ELSE 'Bread ' || o_orderkey END AS body, {_LABEL} AS skipped FROM orders""")
def mail_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails with decoded headers and bodies, and the label for which one is skipped."""
    return _mails(spark, sf_dir).select("message_id", "thread_id", "sender", "subject", F.regexp_replace("body", r"\s+", " ").alias("body"), "skipped")


@_r.add("mail_threads", f"SELECT {_THREAD} AS thread_id, count(*) AS mails, string_agg(DISTINCT 'Céline <c' || o_custkey || '@x.org>', ',') AS people FROM orders WHERE {_LABEL} IS NULL GROUP BY 1")
def mail_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of the mails that aren't skipped."""
    return files.threads(_mails(spark, sf_dir).filter("skipped is null")).select("thread_id", "mails", F.array_join("people", ",").alias("people"))


_NAMES = "CASE p_partkey % 6 WHEN 0 THEN upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) WHEN 1 THEN replace(p_name, ' ', '.') WHEN 2 THEN p_name WHEN 3 THEN 'User_' || split_part(p_name, ' ', 1) WHEN 4 THEN p_brand ELSE 'Ann B. Stone' END"


@_r.add("human_names", f"SELECT p_partkey, {_NAMES} AS name, " + " OR ".join(f"regexp_matches({_NAMES}, '{p}')" for p in classify.HUMAN_NAMES) + " AS human FROM part")
def human_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names have the shape of a person's."""
    n = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_NAMES} AS name")
    return n.withColumn("human", classify.human_name(F.col("name")))


_SAID = "CASE c_custkey % 4 WHEN 0 THEN '\"Stone, Ann ' || c_custkey || '\"' WHEN 1 THEN '''A' || c_custkey || '@X.Org' WHEN 2 THEN ' plain ' || c_custkey || ' ' ELSE 'a, b, ' || c_custkey END"


@_r.add(
    "clean_recipients",
    f"""WITH t AS (SELECT c_custkey, trim(regexp_replace({_SAID}, '^["'']+|["'']+$', '', 'g')) AS t FROM customer) SELECT c_custkey, CASE WHEN contains(t, '@') THEN lower(t) WHEN regexp_matches(t, '^[^,]+,\\s*[^,]+$') THEN regexp_replace(t, '^([^,]+),\\s*([^,]+)$', '\\2 \\1') ELSE t END AS recipient FROM t""",
)
def clean_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipients of mails as they are shown."""
    k = F.col("c_custkey")
    said = F.when(k % 4 == 0, F.concat(F.lit('"Stone, Ann '), k, F.lit('"'))).when(k % 4 == 1, F.concat(F.lit("'A"), k, F.lit("@X.Org"))).when(k % 4 == 2, F.concat(F.lit(" plain "), k, F.lit(" "))).otherwise(F.concat(F.lit("a, b, "), k))
    return table(spark, sf_dir, "customer").select(k, identifiers.recipient(said).alias("recipient"))


@_r.add(
    "partial_dates",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN date_trunc('year', o_orderdate)::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE WHEN 2 THEN o_orderdate::DATE WHEN 3 THEN o_orderdate::DATE END AS day FROM orders""",
)
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, months, days, times and words as dates."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    said = F.when(k % 5 == 0, F.date_format(d, " yyyy")).when(k % 5 == 1, F.date_format(d, "yyyy-MM")).when(k % 5 == 2, F.date_format(d, "yyyy-MM-dd")).when(k % 5 == 3, F.date_format(d, "yyyy-MM-dd'T'HH:mm")).otherwise("some day")
    return table(spark, sf_dir, "orders").select(k, identifiers.partial_date(said).alias("day"))


@_r.add("polymorphic_numbers", "SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL ELSE round(value, 4) END AS number FROM events")
def polymorphic_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number plain, as text, as an object's first numeric value, or not at all."""
    k, v = F.col("event_id"), F.round("value", 4).cast("string")
    payload = F.when(k % 5 == 0, v).when(k % 5 == 1, F.concat(F.lit('"'), v, F.lit('"'))).when(k % 5 == 2, F.concat(F.lit('{"unit": "m", "qty": '), v, F.lit("}"))).when(k % 5 == 3, F.lit('{"unit": "m"}')).otherwise(F.concat(F.lit('{"qty": "'), v, F.lit('", "more": 7}')))
    return table(spark, sf_dir, "events").select(k, F.round(files.health_value(payload), 4).alias("number"))


@_r.add("device_times", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def device_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times by way of nanoseconds since 2001."""
    nanos = (F.unix_timestamp(F.col("ts").cast("timestamp")) - 978307200) * F.lit(1_000_000_000)
    return table(spark, sf_dir, "events").select("event_id", files.apple_time(nanos).cast("timestamp_ntz").alias("ts"))


@_r.add("file_kinds", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'archive' WHEN 2 THEN 'mail' WHEN 3 THEN 'other' ELSE 'csv' END AS kind FROM documents")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    path = F.concat(F.lit("in/"), F.col("source"), F.when(k % 5 == 0, ".jsonl").when(k % 5 == 1, ".TGZ").when(k % 5 == 2, ".x.mbox").when(k % 5 == 3, ".unknown").otherwise(".Tsv"))
    return table(spark, sf_dir, "documents").select("doc_id", files.file_kind(path).alias("kind"))


@_r.add(
    "versioned_facts",
    """SELECT p_partkey AS key, 1 AS version, p_type AS value, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 END AS BIGINT) AS superseded_by FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN 2 ELSE 1 END, p_name, NULL FROM part WHERE p_partkey % 3 = 0""",
)
def versioned_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third fact gets a new version, which the one before points to; of some there was none before."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    old = p.filter(k % 4 > 0).select(k.alias("key"), F.lit(1).alias("version"), F.col("p_type").alias("value"), F.lit(None).cast("long").alias("superseded_by"))
    new = p.filter(k % 3 == 0).select(k.alias("key"), F.lit(0).alias("version"), F.col("p_name").alias("value"))
    return sinks.versioned_upsert(old, new, ["key"])


@_r.add("read_only_sql", "SELECT p_brand, count(*) AS parts, round(avg(p_retailprice), 2) AS price FROM part GROUP BY 1 ORDER BY parts DESC, p_brand LIMIT 20")
def read_only_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's SELECT over a view: its first twenty rows."""
    table(spark, sf_dir, "part").createOrReplaceTempView("read_only_part")
    return read_only(spark, "SELECT p_brand, count(*) AS parts, round(avg(p_retailprice), 2) AS price FROM read_only_part GROUP BY 1 ORDER BY parts DESC, p_brand;", denied=("secrets",))
