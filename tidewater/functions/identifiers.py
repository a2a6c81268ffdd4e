"""Normalisers of phone numbers, mail addresses and names, as Column expressions. The four phone rules differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def phone_last10(c: Column) -> Column:
    """The last ten digits; null for fewer than seven."""
    d = digits(c)
    return F.when(F.char_length(d) >= 7, F.right(d, F.lit(10)))


def phone_national(c: Column) -> Column:
    """Digits; eleven that begin with 1 lose it."""
    d = digits(c)
    return F.when((F.char_length(d) == 11) & d.startswith("1"), d.substr(2, 10)).otherwise(d)


def phone_e164(c: Column) -> Column:
    """E.164: ten digits get +1, eleven with a leading 1 get +; what already has + keeps its digits; mail addresses are
    lower-cased and everything else passes as it is."""
    t = F.trim(c)
    d = digits(t)
    return (
        F.when(t.contains("@"), F.lower(t))
        .when(t.startswith("+"), F.concat(F.lit("+"), d))
        .when((F.char_length(d) == 10), F.concat(F.lit("+1"), d))
        .when((F.char_length(d) == 11) & d.startswith("1"), F.concat(F.lit("+"), d))
        .otherwise(t)
    )


def identifier(c: Column) -> Column:
    """One key for an address of any kind: 'Name <a@b>' unwraps, mail in lower case, phones by E.164, else trimmed lower case."""
    t = F.trim(c)
    wrapped = F.regexp_extract(t, r"<([^<>]+@[^<>]+)>", 1)
    bare = F.when(wrapped != "", wrapped).otherwise(t)
    d = digits(bare)
    phone = bare.rlike(r"^[+0-9 ().-]+$") & (F.char_length(d) >= 10)
    return F.when(bare.contains("@"), F.lower(bare)).when(phone & (F.char_length(d) == 10), F.concat(F.lit("+1"), d)).when(phone, F.concat(F.lit("+"), d)).otherwise(F.lower(bare))


def recipient(c: Column) -> Column:
    """A mail recipient's display form: quotes go, 'Last, First' turns round, addresses are lower-cased."""
    t = F.trim(F.regexp_replace(c, "^[\"']+|[\"']+$", ""))
    return F.when(t.contains("@"), F.lower(t)).when(t.rlike(r"^[^,]+,\s*[^,]+$"), F.regexp_replace(t, r"^([^,]+),\s*([^,]+)$", "$2 $1")).otherwise(t)


def partial_date(c: Column) -> Column:
    """YYYY and YYYY-MM become the first day of the year or month; full dates stay; others are null."""
    t = F.trim(c)
    whole = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01"))).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.substr(1, 10))
    return whole.try_cast("date")
