"""Greedy matching of scored pairs, and unique labels for clusters on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.session import ensure_checkpoint_dir


def greedy_match(scores: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """left, right, score: the pairs that greedy choice takes, highest score first (ties: smallest left, then right), each left and right once.

    Rounds of mutual best: a pair that is the best of both its sides is what greedy choice takes, whatever it took before, as
    pairs are in a total order. So a round takes all such pairs at once and drops their sides; there is one at least, and few
    rounds unless scores fall along a chain. Pairs without a score don't match.
    """
    ensure_checkpoint_dir(scores.sparkSession)
    rest = scores.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, right, score).checkpoint()
    rank = F.struct((-F.col(score)).alias("s"), left, right)
    out: list[DataFrame] = []
    while True:
        mine, theirs = (rest.groupBy(side).agg(F.min(rank).alias("b")).select("b.*") for side in (left, right))
        taken = mine.join(theirs, [left, right]).select(left, right, (-mine["s"]).alias(score)).checkpoint()
        if out and not taken.limit(1).count():
            return reduce(DataFrame.union, out)
        out.append(taken)
        rest = rest.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti").select(left, right, score).checkpoint()


def label_scores(centres: DataFrame, cluster: str, labels: dict[str, Column]) -> DataFrame:
    """cluster, label, score of every cluster and label, where a label is scored by an expression over the centre's features."""
    scored = F.array(*[F.struct(F.lit(name).alias("label"), c.cast("double").alias("score")) for name, c in labels.items()])
    return centres.select(cluster, F.explode(scored).alias("x")).select(cluster, "x.*")


def unique_labels(centres: DataFrame, cluster: str, labels: dict[str, Column], none: str = "uncategorized") -> DataFrame:
    """cluster, label: each label goes to one cluster, by greedy choice over all scores; clusters left over are `none`."""
    match = greedy_match(label_scores(centres, cluster, labels), cluster, "label", "score")
    return centres.select(cluster).distinct().join(match.select(cluster, "label"), cluster, "left").select(cluster, F.coalesce("label", F.lit(none)).alias("label"))


def style_labels() -> dict[str, Column]:
    """Labels of communication styles over features scaled to 0..1. The names and weights."""
    length, emoji, questions, spread, weekend, initiated, sentiment = map(F.col, ("length", "emoji", "questions", "spread", "weekend", "initiated", "sentiment"))
    return {
        "formal_professional": 2 * length + 2 * (1 - emoji) + (1 - weekend),
        "casual_social": 2 * emoji + 2 * weekend + questions,
        "proactive_connector": 3 * initiated + 1.5 * spread,
        "appreciative_responder": 2 * (1 - initiated) + 3 * sentiment,
        "minimal_contact": 1.5 * (1 - length) + (1 - emoji) + (1 - initiated) + (1 - sentiment),
    }
