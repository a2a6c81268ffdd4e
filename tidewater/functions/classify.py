"""Classifications and predicates as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_part(hour: Column) -> Column:
    """6-11 morning, 12-17 afternoon, 18-22 evening, else night."""
    return F.when(hour.between(6, 11), "morning").when(hour.between(12, 17), "afternoon").when(hour.between(18, 22), "evening").otherwise("night")


def day_part_late(hour: Column) -> Column:
    """6-11 morning, 12-17 afternoon, 18-23 evening, before 6 night."""
    return F.when(hour.between(6, 11), "morning").when(hour.between(12, 17), "afternoon").when(hour.between(18, 23), "evening").otherwise("night")


def day_part_early(hour: Column) -> Column:
    """Before 6 night, before 12 morning, before 17 afternoon, before 21 evening, else night."""
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 17, "afternoon").when(hour < 21, "evening").otherwise("night")


def matches_any(c: Column, patterns: list[str]) -> Column:
    return reduce(or_, [c.rlike(p) for p in patterns], F.lit(False))


#: Urgent keywords.
URGENT = (r"(?i)\b911\b", r"\bSOS\b", r"(?i)\bemergency\b", r"(?i)\burgent\b")


def grid_cell(lat: Column, lon: Column, places: int = 2) -> Column:
    return F.concat_ws(",", F.round(lat, places).cast("string"), F.round(lon, places).cast("string"))


def bad_location(lat: Column, lon: Column, accuracy: Column) -> Column:
    return ((lat == 0) & (lon == 0)) | (accuracy > 1000) | lat.isNull() | lon.isNull()


def content_class(source: Column, mime: Column, length: Column, messages: Column) -> Column:
    return (
        F.when(mime.startswith("image/"), "image").when(mime.startswith("audio/"), "audio").when(source == "email", F.when(length > 2000, "long_mail").otherwise("mail")).when(messages > 1, "conversation").when(length > 5000, "document").otherwise("note")
    )


# Words that speak of a delivery, and the forms of its time.
DELIVERY_WORDS = ("deliver", "arrival", "arriving", "shipped", "package", "order", "drop-off", "dropoff", "eta", "estimated time", "window", "scheduled for")
DELIVERY_TIMES = (
    r"between\s+(\d{1,2}(?::\d{2})?\s*(?:am|pm)?)\s+(?:and|&|-)\s+(\d{1,2}(?::\d{2})?\s*(?:am|pm))",
    r"(\d{1,2}(?::\d{2})?\s*(?:am|pm))\s*[-–—to]+\s*(\d{1,2}(?::\d{2})?\s*(?:am|pm))",
    r"(?:by|before|arriving|expected|eta)\s+(\d{1,2}(?::\d{2})?\s*(?:am|pm))",
    r"window[:\s]+(\d{1,2}(?::\d{2})?\s*(?:am|pm))\s*[-–—to]+\s*(\d{1,2}(?::\d{2})?\s*(?:am|pm))",
)


def delivery_window(text: Column) -> Column:
    """The time of a delivery: the first form that matches, where a word speaks of one; else null."""
    hits = [F.nullif(F.trim(F.regexp_extract(text, f"(?i){f}", 0)), F.lit("")) for f in DELIVERY_TIMES]
    spoken = F.lower(text)
    return F.when(F.array_contains(F.transform(F.array(*map(F.lit, DELIVERY_WORDS)), lambda w: spoken.contains(w)), True), F.coalesce(*hits))


def tokens_estimate(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4)


def threshold(category: Column, levels: dict[str, float], default: float) -> Column:
    if not levels:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    return F.coalesce(F.element_at(table, category), F.lit(default))


#: Shapes of human names and user names.
HUMAN_NAMES = (r"^[A-Z][a-z]+\s+[A-Z][a-z]+", r"^[A-Z][a-z]+\.[A-Z]?[a-z]+$", r"^[a-z][a-z]+\.[a-z]+$", r"^[A-Z][a-z]+_[A-Z]?[a-z]+$", r"^[A-Z][a-z]+\s+[A-Z]\.\s+[A-Z][a-z]+$")


def human_name(c: Column) -> Column:
    return matches_any(c, list(HUMAN_NAMES))
