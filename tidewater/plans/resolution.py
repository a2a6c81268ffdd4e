"""Entity resolution, merges, facts, and telemetry over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import similarity
from tidewater.operators import pairs, resolve
from tidewater.plans.base import Registry, grams_sql, jaccard_sql, name_similarity_sql, table

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle


@_r.add(
    "staged_resolution",
    """WITH r AS (SELECT user_id AS record_id, min(event_id) % 500 AS k1, user_id % 40 AS k2 FROM events GROUP BY user_id), e1 AS (SELECT c_custkey % 500 AS k1, min(c_custkey) AS e FROM customer GROUP BY 1), e2 AS (SELECT c_nationkey AS k2, min(c_custkey) AS e FROM customer GROUP BY 1)
    SELECT record_id, coalesce(e1.e, e2.e) AS entity_id, CASE WHEN e1.e IS NOT NULL THEN 'k1' WHEN e2.e IS NOT NULL THEN 'k2' ELSE 'new' END AS stage FROM r LEFT JOIN e1 ON e1.k1 = r.k1 LEFT JOIN e2 ON e2.k2 = r.k2""",
)
def staged_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("m")).select(F.col("user_id").alias("record_id"), (F.col("m") % 500).alias("k1"), (F.col("user_id") % 40).alias("k2"))
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") % 500).alias("k1"), F.col("c_nationkey").cast("long").alias("k2"))
    return resolve.staged_match(r, e, ["k1", "k2"])


@_r.add(
    "fuzzy_resolution",
    f"""WITH e AS (SELECT split_part(p_name, ' ', 1) || ' ' || p_brand AS entity_name, count(*) AS facts, min(p_partkey) AS entity_id FROM part GROUP BY 1 ORDER BY facts DESC, entity_id LIMIT 200),
    d AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT name, entity_id, {name_similarity_sql("lower(name)", "lower(entity_name)")} AS sim FROM d, e), m AS (SELECT name, entity_id, sim FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY sim DESC, entity_id) = 1)
    SELECT p_partkey AS record_id, entity_id, round(sim, 6) AS sim, CASE WHEN sim >= 0.85 THEN 'merge' WHEN sim >= 0.55 THEN 'review' ELSE 'create' END AS action FROM part JOIN m ON m.name = p_name""",
)
def fuzzy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    records = p.select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("name"))
    entities = p.groupBy(F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_brand").alias("name")).agg(F.count(F.lit(1)).alias("fact_count"), F.min("p_partkey").alias("entity_id"))
    return resolve.fuzzy_match(records, entities).withColumn("sim", F.round("sim", 6))


_CONTACTS = "c AS (SELECT c_custkey AS id, lower(c_name) AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'p' || c_custkey % 211 END AS phone, 'm' || c_custkey % 307 AS email FROM customer)"


@_r.add(
    "contact_dedup_score",
    f"""WITH {_CONTACTS}, j AS (SELECT a.id AS a, b.id AS b, a.name AS x, b.name AS y, coalesce(a.phone = b.phone, false) AS p, a.email = b.email AS e FROM c a JOIN c b ON a.id < b.id AND (a.phone = b.phone OR a.email = b.email)),
    s AS (SELECT a, b, 0.5 * p::INT + 0.3 * e::INT + 0.2 * CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.8 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END AS score FROM j)
    SELECT a, b, round(score, 6) AS score, CASE WHEN score >= 0.95 THEN 'auto' ELSE 'review' END AS action FROM s WHERE score >= 0.6""",
)
def contact_dedup_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), F.lower("c_name").alias("name"), F.when(k % 3 == 0, None).otherwise(F.concat(F.lit("p"), k % 211)).alias("phone"), F.concat(F.lit("m"), k % 307).alias("email"))
    return resolve.contact_pairs(c, digits=6)


_ENTITIES = "e AS (SELECT p_partkey AS entity_id, p_name AS name, p_size::BIGINT AS fact_count, DATE '2020-01-01' + CAST(p_partkey % 700 AS INT) AS created FROM part)"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("fact_count"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 700).cast("int")).alias("created"))


_SURVIVORS = f"{_ENTITIES}, m AS (SELECT entity_id AS merged, first_value(entity_id) OVER (PARTITION BY name ORDER BY fact_count DESC, created, entity_id) AS survivor FROM e)"


@_r.add("duplicate_collapse", f"WITH {_SURVIVORS} SELECT merged, survivor FROM m WHERE merged <> survivor")
def duplicate_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.survivors(_entities(spark, sf_dir), ["name"])


@_r.add("merge_execution", f"WITH {_SURVIVORS} SELECT survivor AS l_partkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN m ON m.merged = l_partkey GROUP BY 1")
def merge_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = resolve.apply_merges(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), resolve.survivors(_entities(spark, sf_dir), ["name"]), "l_partkey")
    return merged.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@_r.add("threshold_merges", "WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'contact' WHEN 1 THEN 'person' ELSE 'photo' END AS kind, (c_custkey % 100) / 100.0::DOUBLE AS confidence FROM customer) SELECT id, kind, confidence FROM c WHERE confidence >= CASE kind WHEN 'contact' THEN 0.9 WHEN 'person' THEN 0.95 END")
def threshold_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 == 0, "contact").when(k % 3 == 1, "person").otherwise("photo").alias("kind"), ((k % 100) / 100.0).alias("confidence"))
    return resolve.auto_apply(c, {"contact": 0.9, "person": 0.95})


@_r.add(
    "fact_supersession",
    """WITH RECURSIVE f AS (SELECT user_id AS entity, event_type AS key, CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR) AS value, round(value / 100, 3) AS confidence, 's' || event_id % 4 AS source, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL),
    r AS (SELECT entity, key, k, value, confidence, CAST(1 AS BIGINT) AS evidence, [source] AS sources, CAST(0 AS BIGINT) AS supersedes FROM f WHERE k = 1 UNION ALL
    SELECT f.entity, f.key, f.k, CASE WHEN f.value = r.value OR f.confidence < r.confidence THEN r.value ELSE f.value END, greatest(r.confidence, f.confidence), CASE WHEN f.value = r.value OR f.confidence < r.confidence THEN evidence + 1 ELSE 1 END,
    CASE WHEN f.value = r.value THEN list_append(sources, f.source) WHEN f.confidence < r.confidence THEN sources ELSE [f.source] END, supersedes + CASE WHEN f.value <> r.value AND f.confidence >= r.confidence THEN 1 ELSE 0 END FROM r JOIN f ON f.entity = r.entity AND f.key = r.key AND f.k = r.k + 1)
    SELECT entity, key, value, confidence, evidence, array_to_string(list_sort(list_distinct(sources)), ',') AS sources, supersedes FROM r QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY k DESC) = 1""",
)
def fact_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value is not null")
    facts = e.select(F.col("user_id").alias("entity"), F.col("event_type").alias("key"), F.floor(F.col("value") / 25).cast("string").alias("value"), F.round(F.col("value") / 100, 3).alias("confidence"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.concat(F.lit("s"), F.col("event_id") % 4).alias("source"))
    return resolve.fold_facts(facts)


@_r.add("alias_union", "SELECT p_brand AS name, string_agg(DISTINCT lower(trim(p_type)), '|' ORDER BY lower(trim(p_type))) AS aliases FROM part GROUP BY 1")
def alias_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("p_type")))), "|").alias("aliases"))


@_r.add("reliable_mapping", "WITH n AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2) SELECT l_partkey, l_suppkey, n FROM n QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) <= 2")
def reliable_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.operators.aggregates import top_values

    return top_values(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey", 2, 2).drop("place")


@_r.add(
    "entity_hints",
    """WITH t AS (SELECT p_partkey, trim(regexp_replace(lower(CASE p_partkey % 3 WHEN 0 THEN p_name || ' Jr.' WHEN 1 THEN split_part(p_name, ' ', 1) ELSE p_name || ' (work)' END), ' *(\\(.*\\)|jr\\.?|sr\\.?|iii?)$', '')) AS name FROM part),
    e AS (SELECT p_name AS name, min(p_partkey) AS entity_id FROM part GROUP BY 1), f AS (SELECT split_part(name, ' ', 1) AS name, min(entity_id) AS entity_id FROM e GROUP BY 1)
    SELECT p_partkey, coalesce(e.entity_id, f.entity_id) AS entity_id, CASE WHEN e.entity_id IS NOT NULL THEN 'name' ELSE 'first' END AS via FROM t LEFT JOIN e ON e.name = t.name LEFT JOIN f ON f.name = t.name WHERE coalesce(e.entity_id, f.entity_id) IS NOT NULL""",
)
def entity_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as people write them: suffixes and remarks go; a whole name finds its entity, a first name the smallest id of those that have it."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    said = F.when(k == 0, F.concat("p_name", F.lit(" Jr."))).when(k == 1, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.concat("p_name", F.lit(" (work)")))
    return resolve.hints(p.select("p_partkey", said.alias("name")), p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id")))


@_r.add("keep_first", "SELECT DISTINCT ON (p_brand, p_size) p_brand, p_size, p_partkey FROM part ORDER BY p_brand, p_size, p_partkey")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.keep_first(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand", "p_size"], ["p_partkey"])


@_r.add("pattern_reinforcement", "WITH g AS (SELECT event_type || user_id % 20 AS description, arg_min(event_id % 10 / 20.0, event_id) AS c, count(*) AS seen FROM events WHERE event_type = 'error' GROUP BY 1) SELECT description, round(least(1.0, c + 0.1 * (seen - 1)), 6)::DOUBLE AS confidence, seen FROM g")
def pattern_reinforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    p = e.select(F.concat("event_type", F.col("user_id") % 20).alias("description"), (F.col("event_id") % 10 / 20.0).alias("confidence"), F.col("event_id").alias("at"))
    return resolve.reinforce(p).withColumn("confidence", F.round("confidence", 6))


@_r.add(
    "pattern_maintenance",
    """WITH p AS (SELECT user_id AS id, CAST(max(ts) AS DATE) AS last_seen, count(*) AS seen, (user_id % 100) / 100.0::DOUBLE AS c0 FROM events GROUP BY user_id), d AS (SELECT id, seen, c0 * power(0.95, floor(greatest(0, DATE '2024-03-15' - last_seen - 14) / 7)) AS c FROM p)
    SELECT id, round(c, 4) AS confidence, CASE WHEN c >= 0.85 AND seen >= 5 THEN 'promoted' WHEN c < 0.1 THEN 'inactive' ELSE 'active' END AS state FROM d""",
)
def pattern_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.to_date(F.max("ts")).alias("last_seen"), F.count(F.lit(1)).alias("seen")).withColumn("confidence", F.col("id") % 100 / 100.0)
    return resolve.pattern_maintenance(p, F.lit("2024-03-15").cast("date")).select("id", F.round("confidence", 4).alias("confidence"), "state")


@_r.add("stale_summaries", "WITH s AS (SELECT l_suppkey, list(DISTINCT l_partkey) AS members FROM lineitem GROUP BY 1) SELECT l_suppkey, list_has_any(members, [1, 2, 3]) AS stale FROM s")
def stale_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("members"))
    return resolve.stale(s, [1, 2, 3]).select("l_suppkey", "stale")


@_r.add("knowledge_map", "WITH n AS (SELECT p_brand, p_type, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY 1, 2) SELECT p_brand AS domain, CAST(sum(n) AS BIGINT) AS facts, count(*) AS categories, round(sum(m * n) / sum(n), 2) AS mean_confidence, arg_max(p_type, (n, p_type)) AS largest FROM n GROUP BY 1")
def knowledge_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("m"))
    return n.groupBy(F.col("p_brand").alias("domain")).agg(F.sum("n").alias("facts"), F.count(F.lit(1)).alias("categories"), F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 2).alias("mean_confidence"), F.max_by("p_type", F.struct("n", "p_type")).alias("largest"))


@_r.add(
    "trigram_scores",
    f"""WITH x AS (SELECT DISTINCT p_name AS a, {grams_sql("p_name")} AS g FROM part), y AS (SELECT DISTINCT p_brand || ' ' || p_type AS b, {grams_sql("p_brand || ' ' || p_type")} AS g FROM part), w AS (SELECT a, unnest(g) AS t FROM x), v AS (SELECT b, unnest(g) AS t FROM y),
    p AS (SELECT DISTINCT a, b FROM w JOIN v ON w.t = v.t) SELECT a, b, round({jaccard_sql("x.g", "y.g")}, 6) AS sim FROM p JOIN x USING (a) JOIN y USING (b)""",
)
def trigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against kinds, of those that share a trigram (all others score 0)."""
    p = table(spark, sf_dir, "part")
    x, y = p.select(F.col("p_name").alias("a")).distinct(), p.select(F.concat_ws(" ", "p_brand", "p_type").alias("b")).distinct()
    met = pairs.between(x.select("a", F.explode(similarity.trigrams(F.col("a"))).alias("g")), y.select("b", F.explode(similarity.trigrams(F.col("b"))).alias("g")), ["g"]).select("a", "b").distinct()
    return met.select("a", "b", F.round(similarity.trigram_similarity(F.col("a"), F.col("b")), 6).alias("sim"))


# --- identities and merges


@_r.add(
    "identity_links",
    r"""WITH l AS (SELECT c_custkey AS identity_id, CASE WHEN c_custkey % 2 = 0 THEN 'phone' ELSE 'mail' END AS platform, CASE WHEN c_custkey % 2 = 0 THEN '+1555' || lpad(CAST(2000000 + c_custkey AS VARCHAR), 7, '0') ELSE 'u' || c_custkey || '@xorg' END AS key FROM customer),
    r AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 4 = 0 THEN 'chat' WHEN k % 2 = 0 THEN 'phone' ELSE 'mail' END AS platform, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '@' WHEN o_orderkey % 17 = 0 THEN 'Handle.' || o_custkey % 50 WHEN k % 2 = 0 THEN '(555) ' || substr(CAST(2000000 + k AS VARCHAR), 1, 3) || '-' || substr(CAST(2000000 + k AS VARCHAR), 4) ELSE 'U' || k || '@X.org' END AS identifier,
    CASE WHEN o_orderkey % 3 > 0 THEN 'Name ' || k ELSE ' ' END AS name FROM (SELECT *, CASE WHEN o_orderkey % 6 = 0 THEN o_custkey + 500000 ELSE o_custkey END AS k FROM orders)),
    t AS (SELECT *, regexp_replace(identifier, '[\s\-\(\)\.]', '', 'g') AS s FROM r), n AS (SELECT record_id, platform, name, CASE WHEN length(identifier) >= 2 THEN CASE WHEN regexp_matches(s, '^[2-9][0-9]{9}$') THEN '+1' || s WHEN regexp_matches(s, '^1[2-9][0-9]{9}$') THEN '+' || s WHEN contains(s, '@') THEN lower(s) ELSE s END END AS key FROM t),
    f AS (SELECT key, -min(record_id) AS fresh FROM n WHERE key IS NOT NULL AND length(trim(name)) > 1 GROUP BY 1), a AS (SELECT platform, key, min(identity_id) AS same FROM l GROUP BY 1, 2), b AS (SELECT key, min(identity_id) AS other FROM l GROUP BY 1)
    SELECT record_id, n.key, CASE WHEN contains(n.key, '@') THEN 'email' WHEN regexp_matches(n.key, '^\+?[0-9]{7,15}$') THEN 'phone' WHEN n.key IS NOT NULL THEN 'handle' END AS kind, coalesce(same, other, CASE WHEN length(trim(name)) > 1 THEN fresh END) AS identity_id,
    CASE WHEN same IS NOT NULL THEN 'platform' WHEN other IS NOT NULL THEN 'other' WHEN fresh IS NOT NULL AND length(trim(name)) > 1 THEN 'new' END AS via FROM n LEFT JOIN a ON a.platform = n.platform AND a.key = n.key LEFT JOIN b ON b.key = n.key LEFT JOIN f ON f.key = n.key""".replace("\\\\", "\\"),
)
def identity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers as people write them, resolved to identities; unknown ones open new identities."""
    c = F.col("c_custkey")
    even = c % 2 == 0
    links = table(spark, sf_dir, "customer").select(c.alias("identity_id"), F.when(even, "phone").otherwise("mail").alias("platform"), F.when(even, F.concat(F.lit("+1555"), (c + 2000000).cast("string"))).otherwise(F.concat(F.lit("u"), c, F.lit("@xorg"))).alias("key"))
    o, k = F.col("o_orderkey"), F.col("k")
    rows = table(spark, sf_dir, "orders").withColumn("k", F.when(o % 6 == 0, F.col("o_custkey") + 500000).otherwise(F.col("o_custkey")))
    digits = (k + 2000000).cast("string")
    phone = F.concat(F.lit("(555) "), digits.substr(1, 3), F.lit("-"), digits.substr(4, 9))
    said = F.when(o % 11 == 0, None).when(o % 13 == 0, "@").when(o % 17 == 0, F.concat(F.lit("Handle."), F.col("o_custkey") % 50)).when(k % 2 == 0, phone).otherwise(F.concat(F.lit("U"), k, F.lit("@X.org")))
    platform = F.when(o % 4 == 0, "chat").when(k % 2 == 0, "phone").otherwise("mail")
    return resolve.identify(rows.select(o.alias("record_id"), platform.alias("platform"), said.alias("identifier"), F.when(o % 3 > 0, F.concat(F.lit("Name "), k)).otherwise(" ").alias("name")), links)


_CASCADE = f"""WITH e AS (SELECT p_name || ' ' || p_brand AS name, min(p_partkey) AS entity_id, count(*) AS facts FROM part GROUP BY 1), q AS (SELECT *, '555' || lpad(CAST(entity_id AS VARCHAR), 7, '0') AS phone, 'nick' || entity_id AS nick, 'c' || entity_id AS contact FROM e),
    h AS (SELECT p_partkey AS record_id, CASE p_partkey % 6 WHEN 2 THEN upper(p_name || ' ' || p_brand) WHEN 4 THEN split_part(p_name, ' ', 1) || ' x ' || p_brand ELSE p_name || ' someone' END AS name, CASE p_partkey % 6 WHEN 0 THEN '555' || lpad(CAST(p_partkey % 300 AS VARCHAR), 7, '0') WHEN 3 THEN 'nick' || p_partkey % 300 END AS alias, CASE WHEN p_partkey % 6 = 1 THEN 'c' || p_partkey % 300 END AS contact FROM part),
    s AS (SELECT record_id, 1 AS stage, entity_id FROM h JOIN q ON alias = phone UNION ALL SELECT record_id, 2, entity_id FROM h JOIN q ON h.contact = q.contact UNION ALL SELECT record_id, 3, entity_id FROM h JOIN q ON lower(h.name) = lower(q.name) UNION ALL SELECT record_id, 4, entity_id FROM h JOIN q ON alias = nick),
    m AS (SELECT record_id, stage, entity_id FROM s QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY stage, entity_id) = 1), t AS (SELECT * FROM q ORDER BY facts DESC, entity_id LIMIT 200), k AS (SELECT entity_id, lower(name) AS known FROM t UNION ALL SELECT entity_id, phone FROM t UNION ALL SELECT entity_id, nick FROM t),
    d AS (SELECT DISTINCT lower(name) AS name FROM h), v AS (SELECT name, entity_id, round({name_similarity_sql("name", "known")}, 9) AS sim FROM d, k), n AS (SELECT name, entity_id, sim FROM v WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY sim DESC, entity_id) = 1)
    SELECT h.record_id, coalesce(m.entity_id, CASE WHEN n.sim >= 0.85 THEN n.entity_id END) AS entity_id, coalesce(['phone', 'contact', 'name', 'alias'][m.stage], CASE WHEN n.sim >= 0.85 THEN 'fuzzy' ELSE 'new' END) AS stage, CASE WHEN m.stage IS NULL AND n.sim >= 0.55 AND n.sim < 0.85 THEN n.entity_id END AS review_id, CASE WHEN m.stage IS NULL THEN n.sim END AS sim
    FROM h LEFT JOIN m ON m.record_id = h.record_id LEFT JOIN n ON n.name = lower(h.name)"""


@_r.add("resolution_cascade", _CASCADE)
def resolution_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints through all stages: phone, contact, name, alias, similar name, new."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    whole = F.concat_ws(" ", "p_name", "p_brand")
    e = p.groupBy(whole.alias("name")).agg(F.min(k).alias("entity_id"), F.count(F.lit(1)).alias("fact_count"))
    phone = lambda x: F.concat(F.lit("555-"), F.lpad(x.cast("string"), 7, "0"))
    e = e.select("entity_id", "name", "fact_count", F.array(phone(F.col("entity_id")), F.concat(F.lit("Nick"), "entity_id")).alias("aliases"), F.concat(F.lit("c"), "entity_id").alias("contact"))
    name = F.when(k % 6 == 2, F.upper(whole)).when(k % 6 == 4, F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" x "), "p_brand")).otherwise(F.concat("p_name", F.lit(" someone")))
    alias = F.when(k % 6 == 0, phone(k % 300)).when(k % 6 == 3, F.concat(F.lit("NICK"), k % 300))
    h = p.select(k.alias("record_id"), name.alias("name"), F.array(alias).alias("aliases"), F.when(k % 6 == 1, F.concat(F.lit("c"), k % 300)).alias("contact"))
    return resolve.cascade(h, e)


@_r.add(
    "merge_candidates",
    f"""WITH u AS (SELECT DISTINCT p_name AS name, {grams_sql("p_name")} AS g, min(p_partkey) OVER (PARTITION BY p_name) AS id FROM part), n AS (SELECT 'person' AS kind, least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, {jaccard_sql("a.g", "b.g")} AS sim FROM u a JOIN u b ON a.name < b.name),
    l AS (SELECT c_custkey AS id, 'p' || c_custkey % 211 AS key FROM customer), k AS (SELECT key, min(id) AS a FROM l GROUP BY 1), e AS (SELECT p_partkey AS id, p_name || p_brand AS name, p_size AS f FROM part), m AS (SELECT name, first(id ORDER BY f DESC, id) AS a FROM e GROUP BY 1),
    w AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS name FROM part), x AS (SELECT name, {grams_sql("name")} AS g FROM w WHERE name NOT IN (SELECT name FROM u)), y AS (SELECT x.name, u.id, {jaccard_sql("x.g", "u.g")} AS sim, u.name AS un FROM x, u), z AS (SELECT * FROM y WHERE sim > 0.5 QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(sim, 9) DESC, un) = 1),
    r AS (SELECT kind, a::VARCHAR AS a, b::VARCHAR AS b, sim * 0.8 AS c FROM n WHERE sim > 0.6 UNION ALL SELECT 'person', k.a::VARCHAR, l.id::VARCHAR, 0.95 FROM l JOIN k ON k.key = l.key AND l.id <> k.a UNION ALL SELECT 'entity', m.a::VARCHAR, e.id::VARCHAR, 1.0 FROM e JOIN m ON m.name = e.name AND e.id <> m.a UNION ALL SELECT 'photo', id::VARCHAR, name, sim * 0.9 FROM z)
    SELECT kind, a, b, round(max(c), 6)::DOUBLE AS confidence FROM r GROUP BY 1, 2, 3 HAVING max(c) >= 0.4""",
)
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to merge: similar names, shared keys, equal entities, names on photos."""
    p, k = table(spark, sf_dir, "part"), F.col("c_custkey")
    people = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    links = table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("p"), k % 211).alias("key"))
    entities = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", "p_brand").alias("name"), F.col("p_size").alias("fact_count"))
    seen = p.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name"))
    return resolve.merge_candidates(people, links, entities, seen, 0.4).withColumn("confidence", F.round("confidence", 6))


# --- queue and source telemetry


@_r.add("failure_rates", "SELECT user_id % 20 AS job, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, CASE WHEN count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.5 THEN 'critical' WHEN count(*) FILTER (WHERE event_type = 'error') / count(*) >= 0.2 THEN 'warning' ELSE 'ok' END AS state, max(ts) FILTER (WHERE event_type = 'error') AS last_error FROM events GROUP BY 1")
def failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    rate = F.avg(bad.cast("double"))
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("job")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(bad).alias("failed"), F.when(rate > 0.5, "critical").when(rate >= 0.2, "warning").otherwise("ok").alias("state"), F.max(F.when(bad, F.col("ts"))).alias("last_error"))


@_r.add("source_freshness", "SELECT user_id, CASE WHEN q >= 10 THEN 'error' WHEN q >= 3 THEN 'degraded' ELSE 'ok' END AS state FROM (SELECT user_id, (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(date_trunc('second', max(ts)))) / 36000.0 AS q FROM events GROUP BY 1)")
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.unix_timestamp(F.max(F.col("ts").cast("timestamp")))
    q = (F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - last) / 36000.0
    return table(spark, sf_dir, "events").groupBy("user_id").agg(q.alias("q")).select("user_id", F.when(F.col("q") >= 10, "error").when(F.col("q") >= 3, "degraded").otherwise("ok").alias("state"))


@_r.add("queue_depth", "SELECT o_orderpriority AS lane, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS running, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, CAST(ceil(least(4, count(*) FILTER (WHERE o_orderstatus = 'O') / 50.0)) AS BIGINT) AS workers FROM orders GROUP BY 1")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("lane")).agg(F.count_if(s == "O").alias("pending"), F.count_if(s == "P").alias("running"), F.count_if(s == "F").alias("done"), F.ceil(F.least(F.lit(4.0), F.count_if(s == "O") / 50.0)).alias("workers"))
