"""Mixing sources to target weights by min-cost flow over overlapping sources.

A document may belong to several sources. Documents are aggregated by their membership pattern (the set of sources), so
the flow's size depends on the patterns, not on the documents. Each pattern offers its words once at cost 0, and once
more at each further cost (convex repetition costs), up to `repeats` times; each source asks for its quota. The flow
says how many words each (pattern, source) takes at which repetition. Within a (pattern, source), a seeded hash orders
the documents, and those before a cut are taken: the cut's bucket comes from a histogram of hashes, the few documents
within that bucket are ordered by a window, and the document on the cut is taken in part.

Patterns and sources are metadata (names and sums), of which the driver takes `most_patterns` at most; documents never
pass through it. Only sources that share a pattern are nodes of the flow: what a pattern of a source that shares none
gives is the least of the quota and its words times `repeats`, which is what the flow would route.

Where each document has one source, as in `documents`, patterns are sources, and the flow is that minimum throughout.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order. Rows that
repeat a document are documents each; those of one doc_id are ordered by size. An empty table gives an empty mix. The
caller's columns, whatever their names, stay.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import join_checked, stored

#: Rows of the plan (one for each pattern) up to which it is broadcast; beyond, it is joined by a shuffle.
_MOST_BROADCAST = 100_000


def source_key(source: Column) -> Column:
    """A name of each source that is never null; those of null sources sort last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six blanks: starts of words, counted without building them."""
    blank = "\x20\x09\x0a\x0b\x0c\x0d"
    # Every blank becomes a space, runs fall away by counting only filled parts.
    return F.when(text.isNull(), 0).otherwise(F.size(F.array_remove(F.split(F.translate(text, blank, " " * 6), " "), "")))


def quotas(sizes: dict, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> dict:
    """Targets of the sources (in the dict's order): weights repeat, no target exceeds repeats times its source's size,
    and what is cut off goes to the others by weight until none is above."""
    weight = {k: weights[i % len(weights)] for i, k in enumerate(sizes)}
    left, open_, out = share * sum(sizes.values()), list(sizes), {}
    while open_:
        total = sum(weight[k] for k in open_)
        over = [k for k in open_ if left * weight[k] / total > repeats * sizes[k]]
        if not over:
            return out | {k: left * weight[k] / total for k in open_}
        for k in over:
            out[k] = float(repeats * sizes[k])
        left -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in over]
    return out


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


class MinCostFlow:
    """Successive shortest paths with potentials (Dijkstra), as all costs are at least 0."""

    def __init__(self, nodes: int):
        self.out: list[list[_Arc]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int, cost: int) -> tuple[int, int]:
        self.out[a].append(_Arc(b, room, cost, len(self.out[b])))
        self.out[b].append(_Arc(a, 0, -cost, len(self.out[a]) - 1))
        return a, len(self.out[a]) - 1

    def run(self, source: int, sink: int) -> int:
        potential, total = [0] * len(self.out), 0
        while True:
            far = float("inf")
            dist, via = [far] * len(self.out), [(-1, -1)] * len(self.out)
            dist[source] = 0
            queue: list[tuple[float, int]] = [(0, source)]
            while queue:
                d, u = heapq.heappop(queue)
                if d > dist[u]:
                    continue
                for i, e in enumerate(self.out[u]):
                    new = d + e.cost + potential[u] - potential[e.to]
                    if e.room > 0 and new < dist[e.to]:
                        dist[e.to], via[e.to] = new, (u, i)
                        heapq.heappush(queue, (new, e.to))
            if dist[sink] == far:
                return total
            potential = [p + (d if d < far else 0) for p, d in zip(potential, dist, strict=True)]
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = via[v][0]
            push = min(self.out[u][i].room for u, i in path)
            for u, i in path:
                e = self.out[u][i]
                e.room -= push
                self.out[e.to][e.back].room += push
            total += push


def route(patterns: dict[tuple, int], targets: dict, repeats: int = 2) -> dict[tuple[tuple, object], int]:
    """(pattern, source) -> words taken there, all repetitions together."""
    shared = {s for p in patterns if len(p) > 1 for s in p}
    alone = {(p, p[0]): min(round(targets[p[0]]), repeats * n) for p, n in patterns.items() if len(p) == 1 and p[0] not in shared}
    names, sets = [s for s in targets if s in shared], [p for p in patterns if shared.intersection(p)]
    flow = MinCostFlow(2 + len(sets) + len(names))
    place = {s: 2 + len(sets) + i for i, s in enumerate(names)}
    arcs = {}
    for i, p in enumerate(sets):
        for r in range(repeats):
            flow.arc(0, 2 + i, patterns[p], r * (r + 1) // 2)
        for s in p:
            arcs[p, s] = flow.arc(2 + i, place[s], repeats * patterns[p], 0)
    for s in names:
        flow.arc(place[s], 1, round(targets[s]), 0)
    flow.run(0, 1)
    return alone | {k: flow.out[flow.out[u][i].to][flow.out[u][i].back].room for k, (u, i) in arcs.items()}


def mix(docs: DataFrame, sources: Column, size: Column, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 5, most_patterns: int = 1_000_000) -> tuple[DataFrame, dict, dict]:
    """doc (a struct of docs' columns), size, taken (words taken, repeats counted); and the sizes and targets of the sources, by source_key.

    A pattern's words are dealt to its sources one after the other along the hash order, so a document may serve two.
    """
    keys = F.array_sort(F.array_distinct(F.transform(sources, source_key)))
    work = docs.select(size.cast("long").alias("size"), keys.alias("pattern"), F.col("doc_id").cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    work = work.withColumn("hash", F.xxhash64(F.coalesce(F.col("id"), -F.col("size") - 1), F.lit(seed)))
    work = work.withColumn("bucket", F.shiftrightunsigned("hash", 52).cast("int"))  # 4,096 buckets
    sums = stored(work.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")), "sizes")
    grouped = sums.groupBy("pattern").agg(F.sum("words").alias("n")).limit(most_patterns + 1).collect()
    if len(grouped) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    patterns = {tuple(r["pattern"]): r["n"] for r in grouped if r["pattern"]}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    sizes = {s: sizes[s] for s in sorted(sizes, key=str.encode)}
    targets = quotas(sizes, weights, share, repeats)
    taken: dict[tuple, int] = {}
    for (p, _), words in route(patterns, targets, repeats).items():
        taken[p] = taken.get(p, 0) + words
    plan = docs.sparkSession.createDataFrame([(list(p), taken[p] // n if n else 0, taken[p] % n if n else 0) for p, n in patterns.items()], "pattern array<string>, whole long, rest long")
    # The bucket in which the words before it stay below the rest and those through it reach it.
    along = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sums.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0))).join(plan, "pattern")
    cuts = cuts.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))).select("pattern", F.col("bucket").alias("cut"), "before")
    plan = stored(plan.join(cuts, "pattern", "left").withColumns({"cut": F.coalesce("cut", F.lit(-1)), "before": F.coalesce("before", F.lit(0))}), "plan")
    return _with_taken(join_checked(work, plan, ["pattern"], _MOST_BROADCAST)), sizes, targets


def _with_taken(dealt: DataFrame) -> DataFrame:
    """doc, size and taken. Only documents in a cut's bucket (one in 4,096) go through a window."""
    whole = F.coalesce("whole", F.lit(0)) * F.col("size")
    order = Window.partitionBy("pattern").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    on_cut = F.col("bucket") == F.coalesce("cut", F.lit(-1))
    clear = dealt.filter(~on_cut).withColumn("taken", whole + F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0))
    cut = dealt.filter(on_cut).withColumn("so_far", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    cut = cut.withColumn("taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("so_far"))))
    return clear.select("doc", "size", "taken").unionByName(cut.select("doc", "size", "taken"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for docs of doc_id, source and size (one source each)."""
    rows = stored(docs.select("doc_id", "source", "size"), "documents")
    dealt, sizes, targets = mix(rows, F.array("source"), F.col("size"), **options)
    table = docs.sparkSession.createDataFrame([(s, int(sizes[s]), float(targets[s])) for s in sizes], "key string, source_size long, target double")
    out = dealt.select("doc.doc_id", "size", "taken", source_key(F.col("doc.source")).alias("key"))
    return join_checked(out, table, ["key"], _MOST_BROADCAST).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def take(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a document taken in part keeps its first words, one taken twice comes twice. Columns stay."""
    dealt, _, _ = mix(docs, F.array("source"), word_count(F.col("text")), **options)
    # Whole copies, and one more for a rest; words and the blanks between them stay as they are.
    copies = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    rows = dealt.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    # A piece is a word with the blanks before it.
    head = F.array_join(F.slice(F.split("doc.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), words.cast("int")), "")
    text = F.when(words >= F.col("size"), F.col("doc.text")).otherwise(head)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
