"""Quality classifier: a document's own evidence combined with its site's, by hierarchical empirical Bayes.

Evidence of the document: a logistic regression on text statistics, fitted on at most `most_labelled` labelled rows
(picked by a seeded hash). Evidence of the site: labelled documents are counted for each host and each path below it by
grouped aggregation. A host's rate is shrunk toward the global rate, a path's toward its host's, with strengths that
the method of moments estimates from how much the rates of hosts (paths) differ beyond chance, so sparse sites follow
their parents and sites without labels the prior. In the end
    logit P(good) = classifier's logit + weight * (logit of the path's posterior - logit of the global rate),
and a document is rejected where P(good) is below `reject_below`.

In `documents` the source is the host and the language the path.

Defined results: a null text is empty; null hosts and paths are sites of their own; labels null or of unknown documents
count nowhere; a document with several labels counts with each. Without labels of both kinds, everything is kept with
the global rate. Rows are never dropped or merged.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import as_bytes, bound_batches, join_checked, schema_with, slices, stored

_SYMBOLS = b"#*$%&|<>~^_=@\\{}[]"
_BANG = b"!?"
FEATURES = (
    "log_words", "mean_word", "sd_word", "unique", "top_word", "upper", "digits", "symbols", "bangs", "stops", "commas",
    "non_ascii", "bars", "symbol_ends", "short_lines", "repeat_lines", "long_words", "compressed", "bigram_unique", "upper_words",
)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def text_statistics(text: bytes) -> list[float]:
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)
    lengths = np.fromiter(map(len, words), np.float64, n)
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, n)

    def share(chars: bytes) -> float:
        return (size - len(text.translate(None, chars))) / size

    ends = sum(map(text.count, (b"* ", b"# ", b"$ ", b"% ", b"& ", b"| ", b"! "))) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = ids[:-1] * len(first) + ids[1:]
    return [
        math.log1p(n), float(lengths.mean()), float(lengths.std()), len(first) / n, float(np.bincount(ids).max()) / n, share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(_BANG), share(b"."), share(b",;:"),
        float(np.count_nonzero(np.frombuffer(text, np.uint8) >= 0x80)) / size, text.count(b"|") / n, ends, sum(len(x) < 40 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines), float((lengths > 20).mean()),
        len(zlib.compress(text, 1)) / size if size < 4096 else _compressed(text), len(np.unique(pairs)) / max(1, n - 1), sum(w.isupper() for w in words) / n,
    ]


def _compressed(text: bytes) -> float:
    """Compressed share of a long text, in blocks, so that it doesn't depend on the length."""
    blocks = [text[i : i + 4096] for i in range(0, len(text), 4096)]
    return sum(len(zlib.compress(b, 1)) for b in blocks) / len(text)


def _describe(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            f = [text_statistics(t) for t in as_bytes(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f, pa.list_(pa.float64()))], names=[*batch.schema.names, "qc_features"])

    return run


def described(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(_describe(docs.columns.index("text")), schema_with(docs, "qc_features array<double>"))


def _moments(groups: DataFrame, prior: Column) -> float:
    """Strength (pseudo-counts) of a Beta prior from how group rates (k of n) vary around `prior` beyond chance."""
    r = groups.filter("n > 1").agg(
        F.sum(F.col("n") * (F.col("k") / F.col("n") - prior) ** 2).alias("between"),
        F.sum(prior * (1 - prior)).alias("chance"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
    ).first()
    if not r["groups"] or not r["chance"] or r["n"] <= r["groups"]:
        return 1e6
    mean_var = r["chance"] / r["groups"]
    # E[between] = sum p(1-p) * (1 + (n-1) * rho), rho = 1 / (strength + 1)
    rho = (r["between"] - r["chance"]) / (mean_var * (r["n"] - r["groups"]))
    return min(1e6, max(2.0, 1 / rho - 1)) if rho > 1e-6 else 1e6


class Fitted:
    """A fitted classifier: adds qc_good (probability) and qc_kept to rows with qc_features."""

    def __init__(self, coefficients: np.ndarray, intercept: float, rate: float, hosts: DataFrame | None, paths: DataFrame | None, host_strength: float, path_strength: float, weight: float, reject_below: float, most_broadcast: int):
        self.coefficients, self.intercept, self.rate = coefficients, intercept, rate
        self.hosts, self.paths, self.m_host, self.m_path = hosts, paths, host_strength, path_strength
        self.weight, self.reject_below, self.most_broadcast = weight, reject_below, most_broadcast

    def __call__(self, rows: DataFrame, host: Column, path: Column) -> DataFrame:
        if self.hosts is None:
            return rows.withColumns({"qc_good": F.lit(self.rate), "qc_kept": F.lit(True)})
        products = F.zip_with("qc_features", F.array(*map(F.lit, self.coefficients.tolist())), lambda a, b: a * b)
        logit = F.aggregate(products, F.lit(self.intercept), lambda a, x: a + x)
        rows = rows.withColumns({"qc_host": F.coalesce(host.cast("string"), F.lit("\u0000")), "qc_path": F.coalesce(path.cast("string"), F.lit("\u0000")), "qc_logit": logit})
        rows = join_checked(rows, self.hosts, ["qc_host"], self.most_broadcast)
        rows = join_checked(rows, self.paths, ["qc_host", "qc_path"], self.most_broadcast)
        zero = F.lit(0)
        of_host = (F.coalesce("host_k", zero) + self.m_host * self.rate) / (F.coalesce("host_n", zero) + self.m_host)
        of_path = (F.coalesce("path_k", zero) + self.m_path * of_host) / (F.coalesce("path_n", zero) + self.m_path)
        safe = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), of_path))
        total = F.col("qc_logit") + self.weight * (F.log(safe / (1 - safe)) - math.log(self.rate / (1 - self.rate)))
        good = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), total))))
        return rows.withColumns({"qc_site": of_path, "qc_good": good, "qc_kept": good >= self.reject_below})


def fit(features: DataFrame, labels: DataFrame, host: Column, path: Column, most_labelled: int = 20_000, weight: float = 1.0, reject_below: float = 0.5, most_broadcast: int = 100_000, seed: int = 3) -> Fitted:
    """features: rows with doc_id, the columns of host and path, and qc_features; labels: doc_id and quality (0 or 1)."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("qc_label")).filter("doc_id is not null and qc_label in (0, 1)")
    rows = features.withColumns({"qc_host": F.coalesce(host.cast("string"), F.lit("\u0000")), "qc_path": F.coalesce(path.cast("string"), F.lit("\u0000"))})
    seen = stored(rows.join(known, "doc_id").select("doc_id", "qc_host", "qc_path", "qc_label", "qc_features"), "labelled")
    total = seen.agg(F.count(F.lit(1)).alias("n"), F.sum("qc_label").alias("k")).first()
    n, k = total["n"], total["k"] or 0
    rate = k / n if n else 0.5
    if not 0 < k < n:
        return Fitted(np.zeros(len(FEATURES)), 0.0, rate, None, None, 0, 0, weight, reject_below, most_broadcast)
    steps = 1 << 20
    share = min(steps, -(-steps * 11 * most_labelled // (10 * n)))  # a tenth more, of which the first by hash are taken
    drawn = F.xxhash64("doc_id", F.lit(seed))
    sample = seen.filter(F.pmod(drawn, F.lit(steps)) < share).orderBy(drawn, "doc_id", "qc_label").limit(most_labelled)
    sample = stored(sample.select(F.col("qc_label").cast("double").alias("label"), array_to_vector("qc_features").alias("raw")), "sample").coalesce(4)
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="features").fit(sample)
    model = LogisticRegression(maxIter=60, regParam=1e-3, standardization=False).fit(scaler.transform(sample))
    sd = np.array([s or 1.0 for s in scaler.std])
    coefficients = model.coefficients.toArray() / sd
    intercept = float(model.intercept - (coefficients * scaler.mean.toArray()).sum())
    hosts = stored(seen.groupBy("qc_host").agg(F.count(F.lit(1)).alias("n"), F.sum("qc_label").alias("k")), "hosts")
    m_host = _moments(hosts, F.lit(rate))
    paths = stored(seen.groupBy("qc_host", "qc_path").agg(F.count(F.lit(1)).alias("n"), F.sum("qc_label").alias("k")), "paths")
    with_host = paths.join(hosts.select("qc_host", F.col("n").alias("hn"), F.col("k").alias("hk")), "qc_host")
    m_path = _moments(with_host, (F.col("hk") + m_host * rate) / (F.col("hn") + m_host))
    hosts = hosts.select("qc_host", F.col("n").alias("host_n"), F.col("k").alias("host_k"))
    paths = paths.select("qc_host", "qc_path", F.col("n").alias("path_n"), F.col("k").alias("path_k"))
    return Fitted(coefficients, intercept, rate, hosts, paths, m_host, m_path, weight, reject_below, most_broadcast)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, good (probability), site (posterior rate of its path), kept; one row for each row of docs."""
    features = stored(described(docs.select("doc_id", "source", "lang", "text")).drop("text"), "statistics")
    model = fit(features, labels, F.col("source"), F.col("lang"), **options)
    out = model(features, F.col("source"), F.col("lang"))
    site = F.col("qc_site") if "qc_site" in out.columns else F.lit(model.rate)
    return out.select("doc_id", F.col("qc_good").alias("good"), site.alias("site"), F.col("qc_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, most_ids: int = 500_000, **options) -> DataFrame:
    """docs without those that the classifier rejects. Its columns, whatever their names, stay."""
    # No text is shuffled, whatever the size of labels: few labelled ids are broadcast to the texts, many meet statistics instead.
    rows = docs.select("doc_id", "source", "lang", "text")
    ids = labels.select("doc_id").filter("doc_id is not null").distinct()
    if ids.limit(most_ids + 1).count() <= most_ids:
        rows = rows.join(F.broadcast(ids), "doc_id", "left_semi").select(rows.columns)
    model = fit(described(rows).drop("text"), labels, F.col("source"), F.col("lang"), **options)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text").alias("text"), F.col("source").alias("source"), F.col("lang").alias("lang"))
    return model(described(whole), F.col("source"), F.col("lang")).filter("qc_kept").select("doc.*")
