"""URL filter: rules first, then gradient-boosted trees on lexical features.

The trees learn from labelled URLs: those that a rule decides. Features are lexical (length, depth, digit ratio,
entropy, parameters, ...) and statistics of the host's suffixes (smoothed share of allowed URLs among labelled ones of
the same last label and last two labels). Everything runs in Spark's own expressions and pyspark.ml.

At most `most_labelled` labelled URLs train the trees (a seeded hash of the page_id and url picks them, by label, so that a
rare label stays). The suffix statistics and the mean cover all labelled URLs.

Defined results: a null url, or one without '://', has an empty host and path; where no URL is labelled, or all labels
agree, the verdict of the others is that label, or allow. Rows are never dropped or merged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import join_checked, stored

# A-Z and a-z.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    pattern: str  # host and path, as in example.org/es/

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2] if "/" in self.pattern else ""


#: The production rules.
RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.char_length(host) + 1, F.char_length(rest) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pattern, verdict = F.when(fits, r.pattern).otherwise(pattern), F.when(fits, r.verdict).otherwise(verdict)
    return pattern, verdict


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    n = F.char_length(url)

    def count(x: Column, chars: str) -> Column:
        return F.char_length(x) - F.char_length(F.translate(x, chars, ""))

    per_char = F.transform(F.array_distinct(F.split(url, "")), lambda c: (n - F.char_length(F.replace(url, c, F.lit("")))) / F.greatest(n, F.lit(1)))
    entropy = F.aggregate(per_char, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return {
        "f_length": n,
        "f_host_length": F.char_length(host),
        "f_path_length": F.char_length(path),
        "f_depth": count(path, "/"),
        "f_labels": count(host, ".") + 1,
        "f_digits": count(url, "0123456789") / F.greatest(n, F.lit(1)),
        "f_host_digits": count(host, "0123456789"),
        "f_hyphens": count(host, "-"),
        "f_odd": count(url, "%_~$!*,;@") / F.greatest(n, F.lit(1)),
        "f_params": F.when(F.instr(url, "?") > 0, count(url, "&") + 1).otherwise(0),
        "f_fragment": (F.instr(url, "#") > 0).cast("int"),
        "f_secure": url.startswith("https://").cast("int"),
        "f_page": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
        "f_entropy": entropy,
    }


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """suffix2, allowed, n: over all labelled rows (host, label)."""
    return labelled.groupBy(_suffix(F.col("host"), 2).alias("suffix2")).agg(F.sum("label").alias("allowed"), F.count(F.lit(1)).alias("n"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, most_labelled: int = 20_000, trees: int = 12, depth: int = 4, seed: int = 7, most_broadcast: int = 50_000) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of allow; null where a rule decides)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    labelled = rows.filter("rule is not null").select("page_id", "url", "host", "path", (F.col("by_rule") == "allow").cast("double").alias("label"))
    counted = stored(suffix_counts(labelled), "suffix")
    all_ = counted.agg(F.coalesce(F.sum("allowed"), F.lit(0.0)).alias("allowed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n, by_label = all_["n"], {0.0: all_["n"] - int(all_["allowed"]), 1.0: int(all_["allowed"])}
    if 0 in by_label.values():
        only = "block" if by_label[0.0] else "allow"
        return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    mean = by_label[1.0] / n
    steps = 1 << 20

    def sample(label: float, most: int) -> DataFrame:
        share = min(steps, -(-steps * 11 * most // (10 * by_label[label])))  # a tenth more, of which the first by hash are taken
        drawn = F.xxhash64("page_id", "url", F.lit(seed))
        return labelled.filter((F.col("label") == label) & (F.pmod(drawn, F.lit(steps)) < share)).orderBy(drawn, "page_id", "url").limit(most)

    # In proportion; a rare label gets a tenth, or all it has.
    rare = min(by_label, key=by_label.get)
    few = min(by_label[rare], max(most_labelled // 10, most_labelled * by_label[rare] // n))
    picked = stored(sample(rare, few).union(sample(1.0 - rare, most_labelled - few)), "labelled")
    taken = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1.0, by_label[1.0] / taken.get(1.0, 1)).otherwise(by_label[0.0] / taken.get(0.0, 1))

    def suffixes(labels: int) -> DataFrame:
        g = counted.groupBy(_suffix(F.col("suffix2"), labels).alias(f"suffix{labels}")).agg(F.sum("allowed").alias("allowed"), F.sum("n").alias("n"))
        return g.select(f"suffix{labels}", ((F.col("allowed") + 20 * mean) / (F.col("n") + 20)).alias(f"f_suffix{labels}"), F.log1p("n").alias(f"f_seen{labels}"))

    tables = [stored(suffixes(k), f"suffix{k}") for k in (1, 2)]

    def featured(df: DataFrame) -> DataFrame:
        df = df.withColumns(lexical_features(F.col("url"), F.col("host"), F.col("path")))
        for k, t in enumerate(tables, 1):
            df = join_checked(df.withColumn(f"suffix{k}", _suffix(F.col("host"), k)), t, [f"suffix{k}"], most_broadcast)
            df = df.withColumns({f"f_suffix{k}": F.coalesce(f"f_suffix{k}", F.lit(mean)), f"f_seen{k}": F.coalesce(f"f_seen{k}", F.lit(0.0))})
        return df

    names = [*lexical_features(F.col("url"), F.col("host"), F.col("path")), "f_suffix1", "f_seen1", "f_suffix2", "f_seen2"]
    train = stored(featured(picked).select("label", weight.alias("weight"), *names), "features").coalesce(4)
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), GBTClassifier(weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, maxBins=32, subsamplingRate=0.8)]).fit(train)
    scored = model.transform(featured(rows))
    score = vector_to_array("probability")[1]
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(score >= 0.5, "allow").otherwise("block")).alias("verdict"),
        F.when(F.col("rule").isNull(), score).alias("score"),
    )
