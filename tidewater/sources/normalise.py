"""Source records to the canonical record: one function for each source, all with the same columns.

Canonical columns: source_key, source_id, timestamp, category, summary, content, entities (name, type), metadata, raw.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The categories.
CATEGORIES = ("email", "message", "event", "photo", "health", "location", "social", "document", "contact", "activity")
COLUMNS = ("source_key", "source_id", "timestamp", "category", "summary", "content", "entities", "metadata", "raw")

_NO_ENTITIES = "array<struct<name:string,type:string>>"


def _people(names: Column) -> Column:
    clean = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != ""))
    return F.transform(clean, lambda n: F.struct(n.alias("name"), F.lit("person").alias("type")))


def _record(df: DataFrame, key: str, id_: Column, ts: Column, category: Column, summary: Column, content: Column, people: Column | None, metadata: dict[str, Column]) -> DataFrame:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        F.lit(key).alias("source_key"), id_.cast("string").alias("source_id"), ts.cast("timestamp").alias("timestamp"), category.alias("category"), summary.alias("summary"), content.alias("content"),
        (F.array().cast(_NO_ENTITIES) if people is None else _people(people)).alias("entities"),
        (F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"),
        F.to_json(F.struct(*df.columns)).alias("raw"),
    )


def email(df: DataFrame) -> DataFrame:
    """Columns: id, message_id, subject, sender, recipients, date, received_at, body, snippet."""
    return _record(df, "email", F.coalesce("message_id", "id"), F.coalesce("date", "received_at"), F.lit("email"), F.coalesce("subject", F.lit("(no subject)")), F.coalesce("body", "snippet", F.lit("")), F.concat(F.array("sender"), F.coalesce("recipients", F.array().cast("array<string>"))), {"from": F.col("sender")})


def calendar(df: DataFrame) -> DataFrame:
    """Columns: id, summary, description, start (dateTime, date), end, location, attendees (email, displayName)."""
    people = F.transform("attendees", lambda a: F.coalesce(a["displayName"], a["email"]))
    return _record(df, "calendar", F.col("id"), F.coalesce(F.col("start.dateTime"), F.col("start.date")), F.lit("event"), F.coalesce("summary", F.lit("(untitled)")), F.coalesce("description", F.lit("")), people, {"location": F.col("location"), "end": F.coalesce(F.col("end.dateTime"), F.col("end.date"))})


def social(df: DataFrame) -> DataFrame:
    """Columns: id, tag (post or comment), created_utc (epoch seconds), title, body, author, community."""
    comment = F.col("tag") == "comment"
    summary = F.when(comment, F.concat(F.lit("Comment in "), F.coalesce("community", F.lit("?")))).otherwise(F.coalesce("title", F.lit("(post)")))
    return _record(df, "social", F.col("id"), F.timestamp_seconds("created_utc"), F.lit("social"), summary, F.coalesce("body", F.lit("")), F.array("author"), {"tag": F.col("tag"), "community": F.col("community")})


def photo(df: DataFrame) -> DataFrame:
    """Columns: id, taken_at, persons, place, description. Unknown people are dropped."""
    known = F.filter("persons", lambda p: ~p.startswith("_UNKNOWN_"))
    summary = F.concat_ws(" ", F.lit("Photo"), F.concat(F.lit("with "), F.nullif(F.array_join(known, ", "), F.lit(""))), F.concat(F.lit("at "), F.col("place")))
    return _record(df, "photo", F.col("id"), F.col("taken_at"), F.lit("photo"), summary, F.coalesce("description", F.lit("")), known, {"place": F.col("place")})


def message(df: DataFrame) -> DataFrame:
    """Columns: id, ts, sender, chat, text. NUL characters go."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\\x00", "")
    return _record(df, "message", F.col("id"), F.col("ts"), F.lit("message"), F.left(text, F.lit(120)), text, F.array("sender"), {"chat": F.col("chat")})


def annotation(df: DataFrame) -> DataFrame:
    """Pushed notes: id, produced_at, payload (kind, note_text, recorded_at, latitude, longitude, place_label, tags)."""
    p = F.col("payload")
    category = F.when(p["kind"].contains("health"), "health").when(p["kind"].contains("location"), "location").otherwise("activity")
    return _record(df, "annotation", F.col("id"), F.coalesce(p["recorded_at"], F.col("produced_at")), category, F.left(p["note_text"], F.lit(120)), p["note_text"], None, {"place": p["place_label"], "lat": p["latitude"], "lon": p["longitude"], "tags": F.array_join(p["tags"], ",")})


def location(df: DataFrame) -> DataFrame:
    """Columns: id, recorded_at, latitude, longitude, accuracy, place. Points outside the globe, or less exact than 500 m, go."""
    lat, lon = F.col("latitude"), F.col("longitude")
    good = df.filter(lat.between(-90, 90) & lon.between(-180, 180) & (F.coalesce("accuracy", F.lit(0)) <= 500))
    at = F.concat_ws(",", F.format_string("%.4f", lat.cast("double")), F.format_string("%.4f", lon.cast("double")))
    return _record(good, "location", F.col("id"), F.col("recorded_at"), F.lit("location"), F.concat(F.lit("At "), F.coalesce("place", at)), F.lit(""), None, {"lat": lat, "lon": lon, "accuracy": F.col("accuracy"), "place": F.col("place")})


def visit(df: DataFrame) -> DataFrame:
    """Columns: id, arrived, departed, place. A stay without an end has no minutes."""
    minutes = F.floor((F.unix_timestamp("departed") - F.unix_timestamp("arrived")) / 60)
    return _record(df, "visit", F.col("id"), F.col("arrived"), F.lit("location"), F.concat_ws(" ", F.lit("Stayed at"), F.coalesce("place", F.lit("?")), F.concat(F.lit("for "), minutes.cast("string"), F.lit(" min"))), F.lit(""), None, {"place": F.col("place"), "minutes": minutes})


def health(df: DataFrame) -> DataFrame:
    """Columns: id, type, unit, value (a number or JSON as text), start_date. The value of JSON is its first number."""
    number = F.coalesce(F.col("value").try_cast("double"), F.regexp_extract("value", r":\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"))
    return _record(df, "health", F.col("id"), F.col("start_date"), F.lit("health"), F.concat_ws(" ", F.col("type"), F.round(number, 2).cast("string"), F.col("unit")), F.lit(""), None, {"type": F.col("type"), "unit": F.col("unit"), "value": number, "detail": F.when(F.col("value").startswith("{"), F.col("value"))})


NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {"email": email, "calendar": calendar, "social": social, "photo": photo, "message": message, "annotation": annotation, "location": location, "visit": visit, "health": health}

_BULK = r"(?i)(no-?reply|newsletter|notifications?@|mailer-daemon|marketing|unsubscribe|donotreply|bounce)"


def ingest(sources: dict[str, DataFrame], known: DataFrame | None = None) -> DataFrame:
    """Normalises, unites and de-duplicates by (source_key, source_id); drops bulk mail and what `known` has already.

    Of records of one id the earliest stays (then the smallest raw text); records without an id all stay.
    """
    rows = reduce(DataFrame.unionByName, [NORMALISERS[k](df) for k, df in sources.items()])
    bulk = (F.col("category") == "email") & F.coalesce(F.col("metadata")["from"].rlike(_BULK), F.lit(False))
    rows = rows.filter(~bulk)
    place = F.row_number().over(Window.partitionBy("source_key", "source_id").orderBy(F.col("timestamp").asc_nulls_last(), "raw"))
    named = rows.filter("source_id is not null").withColumn("place", place).filter("place = 1").drop("place")
    rows = named.unionByName(rows.filter("source_id is null"))
    return rows if known is None else rows.join(known.select("source_key", "source_id"), ["source_key", "source_id"], "left_anti").select(rows.columns)


def valid_annotation(payload: Column) -> Column:
    """The push schema: required fields, lengths, ranges and tag limits."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    lat, lon, tags = payload["latitude"], payload["longitude"], F.coalesce(payload["tags"], F.array().cast("array<string>"))
    return (
        ok(payload["kind"].isNotNull() & payload["recorded_at"].isNotNull() & F.char_length(payload["note_text"]).between(1, 2000))
        & (lat.isNull() | lat.between(-90, 90))
        & (lon.isNull() | lon.between(-180, 180))
        & (F.size(tags) <= 20)
        & F.forall(tags, lambda t: F.char_length(t) <= 64)
    )
