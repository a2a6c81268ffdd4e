"""Periodic runs of words by Crochemore's partition refinement.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word
extends. Positions of a text are kept in classes: after stage k, two positions are in one class if the k words from them on
are equal. From stage k to k + 1 a class splits by the classes of the next positions. A class that stayed whole splits
nothing further, and of the parts of a class that split the largest needs no look either (i and j of one class have
successors that were in one class before; if neither lies in a smaller part, both lie in the largest). So a stage costs
as much as the smaller parts hold, and all stages together n log n, whatever the longest repeat.

Class members are linked in order. Neighbours whose distance is the stage's length k start a square of period k, and a
chain of e - 1 such neighbours starts a factor of exponent e. If one of its roots had a smaller period, a nearer
neighbour would lie between; so k is the smallest period. Starts that follow each other merge into one run, which ends
e * k words after the last start. Distances only grow, so a list for each distance takes each pair once.

Only runs of exponent `least_exponent` = e or more are sought: a class with fewer than e members starts no such factor,
neither does any refinement of it nor any position before one of its members at the next stage, so its members go. This
loses no run and ends most texts after a few stages.

Defined results: a null or empty text has no words, no runs, and an empty collapsed text. Repeated rows and null ids give
a row each. Other columns of the input don't matter; the result has the named ones only.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import as_bytes, bound_batches, slices

Run = tuple[int, int, int]


def _pairs(words: list, least: int) -> tuple[list[int | None], list[list[int]]]:
    """Classes of the first two stages: the class of each position at stage 1 (None: too small), and the classes of stage 2."""
    often = Counter(words)
    first = [w if often[w] >= least else None for w in words]
    two: dict[tuple, list[int]] = defaultdict(list)
    for i, pair in enumerate(zip(first, first[1:])):
        if None not in pair:
            two[pair].append(i)
    return first, [c for c in two.values() if len(c) >= least]


def _merged(starts: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the runs whose factors of `reach` words start at the given positions."""
    begin = before = None
    for i in starts:
        if before is None or i != before + 1:
            if begin is not None:
                yield begin, before - begin + reach
            begin = i
        before = i
    if begin is not None:
        yield begin, before - begin + reach


def _chained(pairs: set[int], k: int, least: int) -> list[int]:
    """Positions from which least - 1 neighbours follow at distance k, in order."""
    return sorted(i for i in pairs if all(i + step * k in pairs for step in range(1, least - 1)))


def find_runs(words: list, least_exponent: int = 4, least_length: int = 6) -> list[Run]:
    """Runs (start, length, period) of at least both, by start and period."""
    least, n = least_exponent, len(words)
    runs: list[Run] = []

    def reveal(pairs: set[int], k: int) -> None:
        runs.extend((start, length, k) for start, length in _merged(_chained(pairs, k, least), least * k) if length >= least_length)

    first, classes = _pairs(words, least)
    reveal({i for i in range(n - 1) if first[i] is not None and words[i] == words[i + 1]}, 1)
    if not classes:
        return sorted(runs, key=lambda r: (r[0], r[2]))

    of: dict[int, int] = {}  # the class of each position that still counts
    after: dict[int, int] = {}  # the next and the previous member of its class
    before: dict[int, int] = {}
    near: dict[int, list[int]] = defaultdict(list)  # by distance: positions whose next member came to lie so far
    ends: dict[int, tuple[int, int]] = {}  # first and last member of a class
    size: dict[int, int] = {}
    for c, members in enumerate(classes):
        size[c], ends[c] = len(members), (members[0], members[-1])
        for i, j in zip(members, members[1:]):
            after[i], before[j] = j, i
            near[j - i].append(i)
        of.update(dict.fromkeys(members, c))
    fresh = len(classes)
    splitters = classes  # parts that the next stage looks at
    # Successors of counting positions that don't count themselves.
    fallen = [i + 1 for i in of if i + 1 not in of]

    def leave(i: int) -> None:
        """Takes i out of its class's list."""
        c, p, x = of[i], before.pop(i, None), after.pop(i, None)
        size[c] -= 1
        if p is not None and x is not None:
            after[p], before[x] = x, p
            near[x - p].append(p)
        elif p is not None:
            del after[p]
            ends[c] = (ends[c][0], p)
        elif x is not None:
            del before[x]
            ends[c] = (x, ends[c][1])

    k = 2
    while of:
        reveal({i for i in near.pop(k, ()) if after.get(i) == i + k}, k)
        touched: dict[int, list[list[int]]] = {}
        out: list[int] = []
        for j in fallen:
            if (i := j - 1) in of:
                leave(i)
                touched.setdefault(of.pop(i), [])
                out.append(i)
        for part in splitters:
            moved: dict[int, list[int]] = {}
            for j in part:
                if (c := of.get(j - 1)) is not None:
                    moved.setdefault(c, []).append(j - 1)
            for c, members in moved.items():
                parts = touched.setdefault(c, [])
                if len(members) == size[c]:
                    continue  # the class stays whole, or what is left of it does
                last = None
                for i in members:
                    leave(i)
                    of[i] = fresh
                    if last is not None:
                        after[last], before[i] = i, last
                        near[i - last].append(last)
                    last = i
                size[fresh], ends[fresh] = len(members), (members[0], last)
                fresh += 1
                parts.append(members)
        splitters = []
        for c, parts in touched.items():
            rest: list[int] = []
            if parts or size[c] < least:
                # What is left of the class is listed only if it is too small, or no larger than its largest part.
                if size[c] < least or size[c] <= max(map(len, parts)):
                    i = ends[c][0] if size[c] else None
                    while i is not None:
                        rest.append(i)
                        i = after.get(i)
                    kept = [*parts, rest]
                    kept.remove(max(kept, key=len))
                else:
                    kept = parts
                alive = []
                for members in (*parts, rest):
                    if members and len(members) < least:
                        for i in members:
                            del of[i]
                            before.pop(i, None)
                            after.pop(i, None)
                        out.extend(members)
                    elif members:
                        alive.append(members)
                splitters.extend(p for p in kept if any(p is q for q in alive))
        fallen = out
        k += 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[Run]) -> list:
    """The words without those that any run contains after its first period."""
    kept, end = [], 0
    cuts = sorted((start + period, start + length) for start, length, period in runs)
    for a, b in cuts:
        if b > end:
            kept += words[end : max(a, end)]
            end = b
    return kept + words[end:]


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest exact exponent; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _found(least_exponent: int, least_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, all_runs, best, texts = [], [], [], []
            for text in as_bytes(batch.column(1)):
                words = text.split()
                runs = find_runs(words, least_exponent, least_length)
                counts.append(len(words))
                all_runs.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                top = strongest(runs)
                best.append(top and dict(zip(("start", "length", "period"), top)))
                texts.append(b" ".join(collapse(words, runs)))
            span = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(all_runs, pa.list_(span)), pa.array(best, span), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    return run


_SPAN = "struct<start: long, length: long, period: long>"


def periodic_runs(docs: DataFrame, least_exponent: int = 4, least_length: int = 6) -> DataFrame:
    """For each row of docs (doc_id, text): n_words, runs by start and period, the strongest run, and the text collapsed to single blanks without repeated periods.

    Texts are whole and stay in their partitions; no row meets another.
    """
    if least_exponent < 2:
        raise ValueError("a run has an exponent of 2 at least")
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_found(least_exponent, least_length), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{_SPAN}>, strongest {_SPAN}, collapsed string")
