"""Readers of import files: JSON in three forms, CSV and TSV, HTML and text records, mail boxes, archives, SQLite through JDBC."""

from __future__ import annotations

import email
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from email.policy import compat32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_records(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON lines, or (lines=False) files of one array or object over any number of lines; records that don't fit the schema carry _corrupt_record."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path, multiLine=not lines)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON: an array of records, or an object whose first non-empty array holds them."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))
    as_array = F.from_json("doc", f"array<struct<{schema}>>")
    values = F.map_values(F.from_json("doc", "map<string,string>"))
    first = F.get(F.filter(values, lambda v: v.startswith("[") & (v != "[]")), F.lit(0))
    rows = F.when(F.ltrim("doc").startswith("["), as_array).otherwise(F.from_json(first, f"array<struct<{schema}>>"))
    return raw.select(F.explode(rows).alias("r")).select("r.*")


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header; quotes within quotes are doubled; missing values are ''."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, escape='"').fillna("")


def html_blocks(html: Column) -> Column:
    """Texts of block elements with more than 20 characters: tags out, white space collapsed, at most 2,000 characters each."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    parts = F.split(body, r"(?i)</?(?:p|div|li|tr|h[1-6]|article|section|ul|ol|table|br)\b[^>]*>")
    text = F.transform(parts, lambda p: F.left(F.trim(F.regexp_replace(F.regexp_replace(p, r"<[^>]*>", " "), r"\s+", " ")), F.lit(2000)))
    return F.filter(text, lambda t: F.char_length(t) > 20)


def text_blocks(text: Column) -> Column:
    """Parts between blank lines with more than ten characters."""
    return F.filter(F.transform(F.split(text, r"\n{2,}"), lambda t: F.trim(t)), lambda t: F.char_length(t) > 10)


_SKIPPED_LABELS = re.compile(r"(?i)spam|trash|promotions|chat")


def header_text(value: str) -> str:
    """A header in one line, with its encoded words decoded; most have none, and are plain text as they are."""
    plain = isinstance(value, str) and value.isascii() and "=?" not in value
    return (value if plain else str(email.header.make_header(email.header.decode_header(value)))).replace("\n", " ")


def mail_box(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mbox files: message_id, thread_id, sender, recipients, subject, date, labels, body, skipped (the reason, or null).

    A mail begins at a line 'From ' after a line end. Spark splits at it, so a file of any size is read in parts; the standard library
    decodes each mail.
    """
    parts = spark.read.option("lineSep", "\nFrom ").text(path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for raw in pdf["value"]:
                if not raw.strip():
                    continue
                msg = email.message_from_string(raw.partition("\n")[2], policy=compat32)
                part = next((p for p in msg.walk() if p.get_content_type() == "text/plain"), None) or next((p for p in msg.walk() if p.get_content_type() == "text/html"), None)
                body = part.get_payload(decode=True).decode(part.get_content_charset() or "utf-8", "replace") if part is not None else ""
                if part is not None and part.get_content_type() == "text/html":
                    body = re.sub(r"<[^>]*>", " ", body)
                header = lambda k: header_text(msg.get(k, ""))  # noqa: B023, E731
                labels = header("X-Gmail-Labels")
                hit = _SKIPPED_LABELS.search(labels)
                rows.append((header("Message-ID"), header("X-GM-THRID") or header("References").split(" ")[0] or header("Message-ID"), header("From"), header("To"), header("Subject"), header("Date"), labels, body.strip(), hit[0].lower() if hit else None))
            yield pd.DataFrame(rows, columns=["message_id", "thread_id", "sender", "recipients", "subject", "date", "labels", "body", "skipped"])

    return parts.mapInPandas(decode, "message_id string, thread_id string, sender string, recipients string, subject string, date string, labels string, body string, skipped string")


def threads(mail: DataFrame) -> DataFrame:
    """thread_id, mails, subject (of the first), people."""
    return mail.groupBy("thread_id").agg(F.count(F.lit(1)).alias("mails"), F.min_by("subject", "date").alias("subject"), F.array_sort(F.collect_set("sender")).alias("people"))


#: Kinds of files by extension.
KINDS = {"json": "json", "jsonl": "json", "csv": "csv", "tsv": "csv", "htm": "html", "html": "html", "txt": "text", "md": "text", "mbox": "mail", "jpg": "image", "jpeg": "image", "png": "image", "zip": "archive", "tar": "archive", "tgz": "archive"}


def file_kind(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(F.element_at(kinds, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("other"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, content of zip and tar files."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                data = io.BytesIO(content)
                if zipfile.is_zipfile(data):
                    with zipfile.ZipFile(data) as z:
                        for m in z.infolist():
                            if not m.is_dir():
                                yield pd.DataFrame({"archive": [name], "member": [m.filename], "content": [z.read(m)]})
                else:
                    data.seek(0)
                    with tarfile.open(fileobj=data) as t:
                        for m in t:
                            if m.isfile():
                                yield pd.DataFrame({"archive": [name], "member": [m.name], "content": [t.extractfile(m).read()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(expand, "archive string, member string, content binary")


def sqlite_table(spark: SparkSession, url: str, query: str, **bounds) -> DataFrame:
    """A table of another database by JDBC (its driver must be on the class path); bounds give partitions."""
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **{k: str(v) for k, v in bounds.items()}).load()


def apple_time(c: Column) -> Column:
    """Nanoseconds since 2001-01-01 to a timestamp."""
    return F.timestamp_seconds(c / 1e9 + 978307200)


def health_value(payload: Column) -> Column:
    """A number, a numeric string, or an object's first numeric value, from JSON."""
    plain = payload.try_cast("double")
    values = F.map_values(F.from_json(payload, "map<string,string>"))
    first = F.get(F.filter(F.transform(values, lambda v: v.try_cast("double")), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(plain, F.trim(F.regexp_replace(payload, '"', "")).try_cast("double"), first)
