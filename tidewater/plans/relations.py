"""Profiles of relationships, and the chapters of the people that markers speak of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import markers, relationship
from tidewater.plans.base import Registry, table
from tidewater.plans.statistical import _MARKERS

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle

#: Events spread over a hundred days before they were, as messages, calls and video calls.
_TS = "ts - INTERVAL '1' DAY * (event_id % 100)"
_CHANNEL = "CASE WHEN user_id % 3 = 0 THEN CASE event_id % 2 WHEN 0 THEN 'gmail' ELSE 'google_chat' END WHEN user_id % 3 = 1 THEN CASE event_id % 4 WHEN 0 THEN 'imessage' WHEN 1 THEN 'instagram' ELSE 'gmail' END ELSE 'sms' END"
_MESSAGES = (
    "user_id AS person", f"{_TS} AS ts", f"{_CHANNEL} AS channel", "CASE WHEN event_id % 7 < 1 + user_id % 5 THEN 'sent' ELSE 'received' END AS direction",
    "CASE WHEN event_id % 9 <> 0 THEN length(props) * (user_id % 30) END AS length", "CASE WHEN event_id % 2 = 0 THEN event_type END AS thread",
)
#: Of some people only the older or the newer messages count, so that trends differ.
_SOME = "CASE user_id % 4 WHEN 0 THEN event_id % 100 > 45 WHEN 1 THEN event_id % 100 < 20 ELSE user_id % 6 < 5 OR event_id % 5 = 0 END"

_PROFILE = f"""WITH m AS (SELECT * FROM (SELECT {', '.join(_MESSAGES)} FROM events WHERE {_SOME}) WHERE CAST(ts AS DATE) BETWEEN DATE '2023-10-22' AND DATE '2024-01-20'),
    v AS (SELECT user_id AS person, {_TS} AS ts, CASE WHEN event_type = 'signup' THEN 'facetime' WHEN event_id % 2 = 0 THEN 'plaud' ELSE 'voice' END AS channel FROM events WHERE event_type = 'purchase' AND user_id % 4 = 0 OR event_type = 'signup' AND user_id % 5 = 0),
    c AS (SELECT person, channel, count(*) AS total, count(*) FILTER (direction = 'sent') AS sent, count(*) FILTER (direction = 'received') AS received, min(ts) AS lo, max(ts) AS hi, avg(length) AS len, true AS written FROM m GROUP BY 1, 2
      UNION ALL SELECT person, channel, count(*), 0, count(*), min(ts), max(ts), NULL, false FROM v WHERE CAST(ts AS DATE) BETWEEN DATE '2023-10-22' AND DATE '2024-01-20' GROUP BY 1, 2),
    g AS (SELECT person, sum(total) AS n, sum(sent) FILTER (written) AS s, sum(received) FILTER (written) AS r, coalesce(sum(coalesce(len, 0) * total) FILTER (written) / sum(total) FILTER (written), 0) AS len, coalesce(sum(total) FILTER (channel IN ('voice', 'plaud', 'facetime')), 0) AS spoken, min(lo) AS lo, max(hi) AS hi,
      list(channel ORDER BY channel) AS channels, arg_min(channel, (-total, channel)) AS main FROM c GROUP BY 1),
    h AS (SELECT person, string_agg(part, ',' ORDER BY n DESC, part) AS hours FROM (SELECT person, CASE WHEN extract(hour FROM ts) < 6 THEN 'night' WHEN extract(hour FROM ts) < 12 THEN 'morning' WHEN extract(hour FROM ts) < 17 THEN 'afternoon' WHEN extract(hour FROM ts) < 21 THEN 'evening' ELSE 'night' END AS part, count(*) AS n FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY person ORDER BY count(*) DESC, part) <= 2) GROUP BY 1),
    d AS (SELECT person, string_agg(day, ',' ORDER BY n DESC, day) AS days FROM (SELECT person, strftime(ts, '%a') AS day, count(*) AS n FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY person ORDER BY count(*) DESC, day) <= 3) GROUP BY 1),
    a AS (SELECT person, floor(avg(gap) + 0.5) AS response FROM (SELECT person, direction, lag(direction) OVER w AS before, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap FROM m WINDOW w AS (PARTITION BY person, coalesce(thread, channel) ORDER BY ts)) WHERE direction <> before AND gap > 5 AND gap < 86400 GROUP BY 1),
    t AS (SELECT person, count(*) FILTER (CAST(ts AS DATE) >= DATE '2023-12-21') / 30e0 AS now, count(*) FILTER (CAST(ts AS DATE) <= DATE '2023-12-21') / 60e0 AS thn FROM m GROUP BY 1),
    x AS (SELECT g.person, n, channels, main, hours, days, response, CASE WHEN coalesce(s, 0) + coalesce(r, 0) > 0 THEN floor(least(s, r) / greatest(s, r, 1) * 100 + 0.5) / 100 ELSE 0 END AS reciprocity, least(1.0, floor(len / 200 * 100 + 0.5) / 100) AS depth, floor(spoken / n * 100 + 0.5) / 100 AS in_person,
      coalesce(now, 0) AS now, coalesce(thn, 0) AS thn, floor((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(hi)) / 864e8 + 0.5) AS since, n / 13e0 AS weekly, floor((epoch_us(hi) - epoch_us(lo)) / 864e8 + 0.5) AS duration, CAST(lo AS DATE) AS lo, CAST(hi AS DATE) AS hi, len(channels) AS k
      FROM g LEFT JOIN h USING (person) LEFT JOIN d USING (person) LEFT JOIN a USING (person) LEFT JOIN t USING (person)),
    y AS (SELECT *, CASE WHEN now = 0 AND thn = 0 THEN 'silent' WHEN thn = 0 THEN 'increasing' WHEN now > thn * 13e-1 THEN 'increasing' WHEN now < thn * 7e-1 THEN 'decreasing' ELSE 'stable' END AS trend FROM x)
    SELECT person, CAST(n AS BIGINT) AS interactions, array_to_string(channels, ',') AS channels, main AS primary_channel, hours AS contact_hours, days AS contact_days, response AS response_seconds, reciprocity, depth, in_person, trend,
    CASE WHEN since > 30 THEN 'dormant' WHEN weekly >= 10 AND k >= 3 THEN 'inner_circle' WHEN weekly >= 5 OR weekly >= 2 AND k >= 2 THEN 'close' WHEN weekly >= 1 THEN 'regular' WHEN n >= 3 THEN 'acquaintance' ELSE 'dormant' END AS tier,
    CASE WHEN list_has_any(channels, ['imessage', 'instagram', 'facebook', 'facetime']) THEN 'friend' WHEN list_has_any(channels, ['google_chat', 'gmail']) THEN 'colleague' ELSE 'unknown' END AS type, round(least(95e-2, 4e-1 + k * 1e-1 + least(2e-1, n / 200)), 6) AS tier_confidence,
    floor((least(1e0, weekly / 10) * 25e-2 + reciprocity * 2e-1 + depth * 15e-2 + CASE WHEN since <= 7 THEN 1e0 WHEN since <= 14 THEN 8e-1 WHEN since <= 30 THEN 5e-1 WHEN since <= 60 THEN 2e-1 ELSE 0e0 END * 15e-2 + k / 5e0 * 1e-1 + CASE WHEN response IS NULL THEN 5e-1 ELSE least(1e0, greatest(0e0, 1 - response / 72e2)) END * 5e-2
      + CASE trend WHEN 'increasing' THEN 1e-1 WHEN 'stable' THEN 5e-2 ELSE 0e0 END) * 100 + 0.5) / 100 AS health, lo AS first_day, hi AS last_day, since AS days_since, duration AS duration_days FROM y"""


@_r.add("relationship_profiles", _PROFILE)
def relationship_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels, habits, trend, tier, type and health of each person over 90 days."""
    e = table(spark, sf_dir, "events")
    messages = e.filter(_SOME).selectExpr(*_MESSAGES)
    spoken = ["user_id AS person", f"{_TS} AS ts"]
    calls = e.filter("event_type = 'purchase' AND user_id % 4 = 0").selectExpr(*spoken, "CASE WHEN event_id % 2 = 0 THEN 'plaud' ELSE 'phone' END AS channel")
    video = e.filter("event_type = 'signup' AND user_id % 5 = 0").selectExpr(*spoken)
    out = relationship.profiles(messages, calls, video, F.lit("2024-01-20").cast("date"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("channels", "contact_hours", "contact_days")}).withColumn("tier_confidence", F.round("tier_confidence", 6))


_SAID = "CASE event_id % 6 WHEN 0 THEN 'It is her Birthday today' WHEN 1 THEN 'friends for 3 years' WHEN 2 THEN 'back in 1' WHEN 3 THEN 'I remember when we met, back in 1999' WHEN 4 THEN 'nothing to see' ELSE event_type END"
_CHAPTERS = ("p_partkey AS chapter_id", "p_brand || ' and ' || upper(p_name) AS title", "p_partkey % 700 AS begins")


@_r.add(
    "marker_chapters",
    f"""WITH m AS (SELECT DISTINCT user_id AS person FROM events WHERE regexp_matches({_SAID}, '(?i){_MARKERS}') AND ts > TIMESTAMP '2024-01-31' - INTERVAL 365 DAY), n AS (SELECT person, lower(CASE WHEN person % 20 = 0 THEN 'G' WHEN person % 20 = 1 THEN '' ELSE split_part(p_name, ' ', 1) END) AS first_name FROM m JOIN part ON p_partkey = person),
    c AS (SELECT {', '.join(_CHAPTERS)}, [p_partkey % 150, p_size] AS key_people FROM part)
    SELECT person, chapter_id, title, CAST(row_number() OVER (PARTITION BY person ORDER BY begins, chapter_id) AS INTEGER) AS place FROM n JOIN c ON list_contains(key_people, person) OR first_name <> '' AND contains(lower(title), first_name) QUALIFY row_number() OVER (PARTITION BY person ORDER BY begins, chapter_id) <= 5""",
)
def marker_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five chapters of each person of whom a message has words of dates and milestones: by key person or by title."""
    e, part = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    people = e.filter(F.expr(_SAID).rlike(f"(?i){_MARKERS}") & (F.col("ts") > F.expr("timestamp_ntz'2023-01-31'"))).select(F.col("user_id").alias("person")).distinct()
    name = F.when(F.col("person") % 20 == 0, "G x").when(F.col("person") % 20 == 1, "").otherwise(F.col("p_name"))
    people = people.join(part.select(F.col("p_partkey").alias("person"), "p_name"), "person").select("person", name.alias("name"))
    chapters = part.selectExpr(*_CHAPTERS, "array(p_partkey % 150, p_size) AS key_people")
    return markers.chapters_of(people, chapters, ["begins"]).select("person", "chapter_id", "title", "place")
