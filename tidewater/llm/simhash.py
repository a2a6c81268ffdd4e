"""SimHash near-duplicates by tables of distances to reference fingerprints (pivots).

A document's fingerprint has a bit set if over half of its shingles' XXH64 hashes have. Documents link if their fingerprints
differ in at most `most_bits` = d bits.

Every distinct fingerprint (a class; copies meet as one) has a table of its Hamming distances to 16 fixed references, kept
by segment: 4d segments of the 64 bits, whose distances add up to the whole distance. By the triangle inequality two
fingerprints differ, in a segment, by at least the largest difference of their coordinates there. So:

1. Two that link differ in at most d of the 2d pairs of neighbouring segments (blocks), so for some d blocks all coordinates
   agree. Rows of the table are dealt out by the coordinates of each choice of d blocks (20 for d = 3), and only rows of
   one deal meet. The references are such that a segment's coordinates agree only where its bits do.
2. A deal of more than 2,000 rows (near copies of one text) is dealt out again, by the coordinates of each choice of d of
   the 2d segments in its other blocks. Then 3/4 of the bits are the same, so no deal, whatever the corpus, has more than 2**16 rows.
3. In a deal, rows are swept in order of the first coordinate; pairs with any coordinate more than d apart are discarded, and the
   survivors are verified on their fingerprints. Pairs that are connected in the deal already are not looked at, so a deal
   gives fewer links than rows.

Links between classes are united as connected components over joins. No pair within d bits is missed, and no deal is capped.

Defined results: a null text or one without words has the fingerprint zero, which links like any other; fewer words than a
shingle are one shingle. Ties: the smallest doc_id names a component. A row without doc_id has a fingerprint, but no
component, and connects nothing. Repeated rows give a row each. Other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import as_bytes, bound_batches, join_checked, mix64, slices, stored
from tidewater.llm.near_dup import connected_components

_BITS, _SEED = 64, 42
_REFERENCES = 16
#: Rows of a deal that meet as they are.
_DEAL = 2_000
#: Shingles whose bits are counted together.
_SHINGLES = 65_536
#: Large deals up to which their keys are broadcast.
_MOST_BROADCAST = 100_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, k: int) -> int:
    """Of the k-word shingles of lower-cased (A-Z) text, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    to = ends[-n:].tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], _SEED) for a, b in zip(begins.tolist(), to)), np.uint64, n)
    counts = np.zeros(_BITS, dtype=np.int64)
    for i in range(0, n, _SHINGLES):
        bits = np.unpackbits(hashes[i : i + _SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def references() -> np.ndarray:
    """16 fingerprints, drawn by the finalizer of splitmix64."""
    return mix64(np.arange(1, _REFERENCES + 1, dtype=np.uint64) * _GOLDEN)


def segments(n: int) -> np.ndarray:
    """Masks of n neighbouring segments of the 64 bits, as equal as can be."""
    cuts = [i * _BITS // n for i in range(n + 1)]
    return np.array([(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])], dtype=np.uint64)


def distance_table(prints: np.ndarray, most_bits: int) -> np.ndarray:
    """Distances (fingerprint, segment, reference)."""
    away = prints[:, None] ^ references()[None, :]
    return np.bitwise_count(away[:, None, :] & segments(4 * most_bits)[None, :, None])


def _coordinates(table: np.ndarray) -> np.ndarray:
    """A 64-bit number for the coordinates of each fingerprint in each segment."""
    out = np.zeros(table.shape[:2], dtype=np.uint64)
    for r in range(table.shape[2]):
        out = mix64(out * _GOLDEN + table[:, :, r] + np.uint64(1))
    return out


def _choices(most_bits: int) -> list[tuple[int, ...]]:
    return list(combinations(range(2 * most_bits), most_bits))


def _key(parts: np.ndarray, chosen: list[int], start: np.ndarray) -> np.ndarray:
    for s in chosen:
        start = mix64(start * _GOLDEN + parts[:, s])
    return start


def _dealt(most_bits: int):
    """Fingerprints to (key, choice, print): the deals by blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5_000):
            prints = batch.column(0).to_numpy().view(np.uint64)
            parts = _coordinates(distance_table(prints, most_bits))
            for number, blocks in enumerate(_choices(most_bits)):
                key = _key(parts, [s for b in blocks for s in (2 * b, 2 * b + 1)], np.full(len(prints), number, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(prints), number, dtype=np.int32)), batch.column(0)], names=["key", "choice", "print"])

    return run


def _dealt_again(most_bits: int):
    """Rows of large deals to deals by segments of the blocks not chosen."""
    choices = _choices(most_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5_000):
            keys, choice, all_prints = (c.to_numpy() for c in batch.columns)
            for number in np.unique(choice).tolist():
                mine = choice == number
                prints = all_prints[mine].view(np.uint64)
                parts = _coordinates(distance_table(prints, most_bits))
                left = [s for b in range(2 * most_bits) if b not in choices[number] for s in (2 * b, 2 * b + 1)]
                for again, picked in enumerate(choices):
                    key = _key(parts, [left[p] for p in picked], keys[mine].view(np.uint64) + np.uint64(again + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(prints.view(np.int64))], names=["key", "print"])

    return run


def links_of(prints: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Links (places) that connect all fingerprints of a deal which links connect: a spanning forest."""
    table = distance_table(prints, most_bits).sum(axis=1).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    reach = np.searchsorted(table[:, 0], table[:, 0] + most_bits, side="right")
    group = np.arange(len(prints))
    found = []
    for i in range(len(prints) - 1):
        j = np.arange(i + 1, reach[i])
        j = j[group[j] != group[i]]
        for r in range(1, _REFERENCES):
            if not len(j):
                break
            j = j[np.abs(table[j, r] - table[i, r]) <= most_bits]
        j = j[np.bitwise_count(prints[j] ^ prints[i]) <= most_bits]
        for other in j.tolist():
            if group[other] != group[i]:
                group[group == group[other]] = group[i]
                found.append((int(order[i]), int(order[other])))
    return found


def _linked(most_bits: int):
    """Rows (key, print) sorted by key to links within each key's deal. A deal is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prints = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def settle(deals: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
            out: list[np.ndarray] = []
            for a, b in zip(begins[:-1], begins[1:]):
                if b - a > 1:
                    deal = np.unique(deals[a:b])
                    if pairs := links_of(deal.view(np.uint64), most_bits):
                        out.append(deal[np.array(pairs)])
            both = np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            key = np.concatenate((key, batch.column(0).to_numpy()))
            prints = np.concatenate((prints, batch.column(1).to_numpy()))
            begins = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            yield settle(prints, begins)
            key, prints = key[begins[-1] :], prints[begins[-1] :]
        if len(key):
            yield settle(prints, np.array([0, len(key)]))

    return run


def _prints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, k) for t in as_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return run


def links(classes: DataFrame, most_bits: int = 3, deal: int = _DEAL) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column print, distinct longs) which differ in at most most_bits bits."""
    rows = classes.select("print").mapInArrow(_dealt(most_bits), "key long, choice int, print long")
    large = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > deal).select("key"), "large_deals")
    met = rows.select("key", "print")
    if large.limit(1).count():
        again = join_checked(rows, large, ["key"], _MOST_BROADCAST, "inner").mapInArrow(_dealt_again(most_bits), "key long, print long")
        met = join_checked(met, large, ["key"], _MOST_BROADCAST, "left_anti").unionByName(again)
    return met.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(most_bits), "a long, b long")


def groups(docs: DataFrame, shingle_words: int = 3, most_bits: int = 3) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, print (the fingerprint as a signed long), component_id."""
    if not 1 <= most_bits <= 4:
        raise ValueError("tables are dealt out for 1 to 4 bits")
    bound_batches(docs.sparkSession)
    signed = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints(shingle_words), "doc_id long, print long"), "prints")
    classes = stored(signed.filter("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep")), "classes")
    # Nodes are ordered by their smallest doc_id, so a component's smallest node names it, and no join is by component.
    node = F.struct("rep", "print")
    edges = links(classes, most_bits)
    for end in ("a", "b"):
        edges = edges.join(classes.select(F.col("print").alias(end), node.alias(f"node_{end}")), end)
    comps = connected_components(stored(edges.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "links"))
    named = classes.join(comps.select("node.print", F.col("comp.rep").alias("first")), "print", "left").select("print", F.coalesce("first", "rep").alias("component_id"))
    found = signed.join(named, "print", "left")
    return found.select("doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
