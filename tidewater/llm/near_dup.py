"""MinHash near-duplicates with SuperMinHash signatures.

A document's set holds the distinct k-word shingles of its lower-cased (A-Z) text. SuperMinHash draws, for each
element, a random permutation of the signature's places; the element's j-th place gets at least j, so drawing stops
as soon as every place holds less than the next j. Bands of the signature give candidate buckets; links are confirmed
on the full sets of both texts; linked documents are grouped by connected components.

Documents with equal sets are one class and meet as one representative, so copies are never paired. In a bucket, one
pivot is held against all members (a star, never all pairs). A pair goes whose signatures agree in so few places that
their estimate lies 4.7 standard deviations below the threshold (a true pair is lost so with probability 1e-6); only
the others cause texts to move. Of its pivots a member first meets the likeliest alone; with the others only if they
are in another component then. Texts move once to the side that names them and once to their pivot.

Stars may miss a link between two members that are both unlike the pivot. Therefore buckets whose other members still
lie in different components are settled in full: members outside the bucket's largest component are held against those
of other components, first by their signatures, then, within the task, on their full sets, until they are linked or no
partner is left. Only links leave the task. Large buckets are cut into blocks that meet two by two, so a task holds at
most two blocks; no bucket is capped.

Sets are compared as sorted 64-bit hashes of all their shingles: two shingles of a pair of texts with 100,000 shingles
each fall together with probability 5e-10.

Defined results: a null text, or one without words, has an empty set, links with nothing and is kept, as is a row
without doc_id (its component is null). Rows with equal sets (repeated rows too) are one group. Ties: the smallest
doc_id stays. Rows of one doc_id with different texts are documents each, and share their name.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import as_bytes, bound_batches, forget, fresh, join_checked, mix64, slices, stored

#: Elements of sets whose signatures are computed together.
_ELEMENTS = 60_000
#: Members, and shingles, of a block of a bucket.
_BLOCK, _BLOCK_SHINGLES = 500, 1_000_000
#: Members of one bucket that a part takes on average where buckets of mixed components are sought; larger buckets are salted.
_HOT = 1000
#: Members that meet a pivot in one task on average.
_STAR = 500
#: Rows of ids up to which they are broadcast to the texts that they name; beyond, both sides are shuffled.
_MOST_BROADCAST = 200_000


def superminhash(elements: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """Signatures (one row per set) of sets of distinct uint64 elements, laid end to end. A place holds j * 2**32 + r."""
    sets = len(sizes)
    best = np.full(sets * m, np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(sets), sizes)
    places: np.ndarray | None = None
    for j in range(m):
        draw = mix64(elements + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        pick = j + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(m - j)).astype(np.int64)
        if places is None:
            place = pick
        else:
            rows = np.arange(len(elements))
            place = places[rows, pick].astype(np.int64)
            places[rows, pick] = places[rows, j]
            places[rows, j] = place
        np.minimum.at(best, owner * m + place, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
        if j + 1 == m:
            break
        open_sets = best.reshape(sets, m).max(axis=1) >= np.uint64((j + 1) << 32)
        keep = open_sets[owner]
        if not keep.any():
            break
        if places is None:
            pick = pick[keep]
            places = np.tile(np.arange(m, dtype=np.uint16), (len(pick), 1))
            rows = np.arange(len(pick))
            places[rows, pick] = 0
            places[rows, 0] = pick
        elif not keep.all():
            places = places[keep]
        elements, owner = elements[keep], owner[keep]
    return best.reshape(sets, m)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of lower-cased text (the whole text as one, if shorter)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.full(n, min(k, len(words)), dtype=np.uint64)
    for i in range(min(k, len(words))):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def _signatures(k: int, bands: int, rows: int):
    """Batches of (doc_id, text, th) to doc_id, th, n_shingles, digest of the set (null if empty), a hash for each band, and 8 bits of each place."""
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, digests, keys = [], [], []
            places: list[bytes] = []
            held: list[np.ndarray] = []

            def flush() -> None:
                if held:
                    n = np.array([len(x) for x in held])
                    sig = superminhash(np.concatenate(held), n, m)
                    places.extend(x.tobytes() for x in (mix64(sig) & np.uint64(0xFF)).astype(np.uint8))
                    sig = sig.reshape(len(held), bands, rows)
                    key = np.full((len(held), bands), 0, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
                    for i in range(rows):
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
                    keys.extend(key.view(np.int64))
                    held.clear()

            count = 0
            for text in as_bytes(batch.column(1)):
                s = shingle_hashes(text, k)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    held.append(s)
                    count += len(s)
                    if count > _ELEMENTS:
                        flush()
                        count = 0
            flush()
            it, sig_it = iter(keys), iter(places)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([next(it).tolist() if n else [] for n in sizes], pa.list_(pa.int64())), pa.array([next(sig_it) if n else b"" for n in sizes], pa.binary())],
                names=["doc_id", "th", "n_shingles", "digest", "bands", "places"],
            )

    return run


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _places(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _alike(floor: float):
    """Keeps the pairs whose signatures (the last two columns) agree in at least `floor` of their places; adds that share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            alike = (_places(batch.column(batch.num_columns - 2)) == _places(batch.column(batch.num_columns - 1))).mean(axis=1)
            out = pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(alike)], names=[*batch.schema.names[:-2], "alike"])
            yield out.filter(pa.array(alike >= floor))

    return run


def _overlaps(k: int):
    """Sorted batches of (a, salt, cls, text), pivots (cls = a) before their members, to a, b, size of the intersection and of the union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivot = None, np.empty(0, dtype=np.uint64)
        for batch in slices(batches):
            out: list[tuple[int, int, int, int]] = []
            for a, salt, cls, text in zip(*(batch.column(i).to_pylist() for i in range(3)), as_bytes(batch.column(3)), strict=True):
                if cls == a:
                    if now != (a, salt):
                        now, pivot = (a, salt), shingle_hashes(text, k)
                    continue
                s = shingle_hashes(text, k)
                both = common_size(pivot, s)
                out.append((a, cls, both, len(pivot) + len(s) - both))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["a", "b", "both", "either"])

    return run


def _partners(table: pa.Table, num: int, den: int, floor: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each member outside the largest component of a block: members of other components that it may be linked with, likeliest first.

    A pair belongs to the first band in which both share a bucket, so that it is looked at once.
    """
    comp, n = table.column("comp").to_numpy(), table.column("n").to_numpy()
    names, inverse, counts = np.unique(comp, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    sig = _places(table.column("places").combine_chunks())
    keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(comp), -1)
    band = table.column("band")[0].as_py()
    largest = counts.argmax()
    for i in np.flatnonzero(inverse != largest):
        # Of two members outside, the later one asks.
        other = np.flatnonzero((comp != comp[i]) & (np.minimum(n, n[i]) * den >= np.maximum(n, n[i]) * num) & ((inverse == largest) | (np.arange(len(comp)) < i)))
        other = other[(keys[other] == keys[i]).argmax(axis=1) == band] if len(other) else other
        if len(other):
            alike = (sig[other] == sig[i]).mean(axis=1)
            keep = alike >= floor
            if keep.any():
                yield int(i), other[keep][np.argsort(-alike[keep], kind="stable")]


_MEMBER = "bucket long, block long, band int, cls long, rep long, th long, n long, comp long, bands array<long>, places binary"


def _possible(num: int, den: int, floor: float):
    """The members of a block that have a possible partner, or are one."""

    def run(table: pa.Table) -> pa.Table:
        used = np.zeros(table.num_rows, dtype=bool)
        for i, others in _partners(table, num, den, floor):
            used[i] = True
            used[others] = True
        return table.select([c.split()[0] for c in _MEMBER.split(", ")]).filter(pa.array(used))

    return run


def _links(k: int, num: int, den: int, floor: float):
    """Links, confirmed on full sets, that join the components of a block: no pair within what is joined already."""

    def run(table: pa.Table) -> pa.Table:
        texts, names = table.column("text"), table.column("cls").to_pylist()
        comp = table.column("comp").to_pylist()
        sets: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0
        parent: dict[int, int] = {c: c for c in comp}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        def of(i: int) -> np.ndarray:
            nonlocal held
            if i not in sets:
                sets[i] = shingle_hashes((texts[i].as_py() or "").encode(), k)
                held += len(sets[i])
                while held > 8 * _BLOCK_SHINGLES and len(sets) > 2:
                    held -= len(sets.popitem(last=False)[1])
            return sets[i]

        found = []
        for i, others in _partners(table, num, den, floor):
            for j in others.tolist():
                if root(comp[i]) == root(comp[j]):
                    continue
                one, two = of(i), of(j)
                both = common_size(one, two)
                if both * den >= (len(one) + len(two) - both) * num:
                    parent[root(comp[i])] = root(comp[j])
                    found.append((names[i], names[j]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """Union-find over pairs (a, b) of longs, or other values with an order: (node, comp), comp the smallest node reachable. Nodes without an edge have no row.

    Every node hangs from the smallest neighbour known and from that one's parent (hooking and pointer jumping), by
    joins on node, so no component is ever in one task. Rounds grow with the logarithm of the longest chain.
    """
    links = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    nodes = stored(links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "comp")
    moved = 1
    while moved:
        by_end = nodes.select(F.col("node").alias("b"), F.col("comp").alias("reach"))
        lower = links.join(by_end, "b").groupBy(F.col("a").alias("node")).agg(F.min("reach").alias("reach"))
        hooked = nodes.join(lower, "node").select("node", "comp", F.least("comp", "reach").alias("low"))
        jump = nodes.select(F.col("node").alias("low"), F.col("comp").alias("up"))
        new = stored(hooked.join(jump, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("comp"), (F.least("low", F.coalesce("up", "low")) < F.col("comp")).alias("moved")), "comp")
        forget(nodes)
        moved = new.filter("moved").limit(1).count()
        nodes = new
    forget(links)
    return nodes.select("node", "comp")


def _texts_of(keyed: DataFrame, wanted: DataFrame, most_broadcast: int) -> DataFrame:
    """wanted (doc_id, th, ...) with the texts. One plan at every size, but for a broadcast of few rows where most_broadcast allows it."""
    if most_broadcast:
        return join_checked(keyed, wanted, ["doc_id", "th"], most_broadcast, "inner")
    return keyed.join(wanted.hint("merge"), ["doc_id", "th"])


def _verified(pairs: DataFrame, keyed: DataFrame, k: int, most_broadcast: int = 0) -> DataFrame:
    """pairs (a, b; doc_id and th of each) with the sizes of the intersection and union of the full sets. Members of a large star are salted."""
    parts = F.ceil(F.col("star") / _STAR).cast("long")
    salted = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("star")), "a").withColumn("salt", F.pmod(F.xxhash64("b"), parts))
    members = salted.select(F.col("doc_b").alias("doc_id"), F.col("th_b").alias("th"), "a", "salt", F.col("b").alias("cls"))
    pivots = salted.select(F.col("doc_a").alias("doc_id"), F.col("th_a").alias("th"), "a", "salt", F.col("a").alias("cls")).distinct()
    wanted = stored(members.union(pivots), "stars")
    rows = _texts_of(keyed, wanted, most_broadcast).select("a", "salt", "cls", "text")
    met = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("cls") != F.col("a"))
    return met.mapInArrow(_overlaps(k), "a long, b long, both long, either long")


def _groups(docs: DataFrame, shingle_words: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """One row for each row of docs: doc_id, th (hash of the text), n_shingles, and the smallest doc_id (first_id) and th (first_th) of its group."""
    bound_batches(docs.sparkSession)
    least = Fraction(threshold).limit_denominator(10_000)
    num, den = least.numerator, least.denominator
    floor = threshold - 4.7 * (threshold * (1 - threshold) / (bands * rows)) ** 0.5
    linked = F.col("both") * den >= F.col("either") * num

    def near(one: str, two: str) -> Column:
        return F.least(one, two) * den >= F.greatest(one, two) * num

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    signed = stored(keyed.mapInArrow(_signatures(shingle_words, bands, rows), "doc_id long, th long, n_shingles long, digest binary, bands array<long>, places binary"), "signatures")
    keyed = keyed.filter("doc_id is not null and text is not null")
    classes = signed.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("places").alias("places"))
    # Numbers of classes are fixed once they are written.
    classes = stored(classes.select("digest", F.monotonically_increasing_id().alias("cls"), F.col("r.doc_id").alias("rep"), F.col("r.th").alias("th"), "n", "bands", "places"), "classes")
    members = classes.select("cls", "n", F.posexplode("bands").alias("band", "bucket"))
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("all_n"), F.min("cls").alias("pivot")).filter("c > 1")
    star = stored(members.join(crowded, "bucket").filter(F.col("cls") != F.col("pivot")), "star")

    pairs = star.groupBy(F.col("pivot").alias("a"), F.col("cls").alias("b")).agg(F.first("n").alias("n_b"))
    one = classes.select(F.col("cls").alias("a"), F.col("rep").alias("doc_a"), F.col("th").alias("th_a"), F.col("n").alias("n_a"), F.col("places").alias("places_a"))
    two = classes.select(F.col("cls").alias("b"), F.col("rep").alias("doc_b"), F.col("th").alias("th_b"), F.col("places").alias("places_b"))
    pairs = pairs.join(one.hint("merge"), "a").filter(near("n_a", "n_b")).join(two.hint("merge"), "b")
    pairs = pairs.select("a", "b", "doc_a", "th_a", "doc_b", "th_b", "places_a", "places_b").mapInArrow(_alike(floor), "a long, b long, doc_a long, th_a long, doc_b long, th_b long, alike double")
    pairs = stored(pairs.withColumn("nth", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("alike"), "a"))), "alike")

    tested = stored(_verified(pairs.filter("nth = 1"), keyed, shingle_words), "tested")
    comps = stored(connected_components(tested.filter(linked)), "comps")
    apart = pairs.filter("nth > 1")
    for c in ("a", "b"):
        apart = apart.join(comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")), c, "left")
    apart = stored(apart.filter(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).drop("comp_a", "comp_b"), "apart")
    if apart.limit(1).count():
        more = stored(_verified(apart, keyed, shingle_words, _MOST_BROADCAST).filter(linked), "tested")
        comps = stored(_united(comps, more), "comps")

    # The pivot has met everyone and is no member any more.
    unsettled = _mixed(star.select("bucket", "band", "cls", "n", (F.col("c") - 1).alias("c"), "all_n"), comps)
    unsettled = _in_blocks(stored(unsettled, "unsettled")).join(classes.select("cls", "rep", "th", "bands", "places"), "cls")
    possible = stored(unsettled.groupBy("bucket", "block").applyInArrow(_possible(num, den, floor), _MEMBER), "possible")
    if possible.limit(1).count():
        settled = _texts_of(keyed, possible.withColumnRenamed("rep", "doc_id"), _MOST_BROADCAST // 4)
        links = stored(settled.groupBy("bucket", "block").applyInArrow(_links(shingle_words, num, den, floor), "a long, b long"), "links")
        comps = stored(_united(comps, links), "comps")
    names = comps.join(classes.select(F.col("cls").alias("node"), "rep", "th"), "node").groupBy("comp").agg(F.min(F.struct("rep", "th")).alias("first"))
    found = classes.select("digest", F.col("cls").alias("node"), F.struct("rep", "th").alias("own")).join(comps, "node", "left").join(names, "comp", "left").select("digest", F.coalesce("first", "own").alias("first"))
    return signed.select("doc_id", "th", "n_shingles", "digest").join(found, "digest", "left").select(
        "doc_id",
        "th",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("first.rep", "doc_id")).alias("first_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("first.th", "th")).alias("first_th"),
    )


def near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept.

    A pair at the threshold 0.8 is missed by all 32 bands of 5 with probability 3e-6; pairs above it with less.
    """
    found = _groups(docs, shingle_words, threshold, bands, rows)
    return found.select("doc_id", "n_shingles", F.col("first_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("first_id"), F.lit(True)).alias("kept"))


def _parts(rows: int) -> Column:
    """Parts of a bucket of c members and all_n shingles."""
    return F.greatest(F.ceil(F.col("c") / rows), F.ceil(F.col("all_n") / _BLOCK_SHINGLES)).cast("long")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members with the blocks they belong to: a bucket of up to _BLOCK members (c) and _BLOCK_SHINGLES shingles (all_n) is one, a larger one has a block for each two of its parts."""
    parts = _parts(_BLOCK)
    part = F.pmod(F.xxhash64("cls"), parts)
    pair = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.least(j, part) * parts + F.greatest(j, part))
    return members.withColumn("block", F.explode(pair)).drop("c", "all_n")


def _united(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps after further links. Only the components that they touch are united, as nodes of a smaller graph."""
    a = links.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").select("b", F.coalesce("ca", "a").alias("a"))
    edges = a.join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left").select("a", F.coalesce("cb", "b").alias("b"))
    moved = connected_components(edges.filter("a != b"))
    old = comps.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
    return old.union(moved.join(comps.select("node"), "node", "left_anti").select("node", "comp"))


def _mixed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that lie in more than one component. Large buckets (c) are salted."""
    parts = F.ceil(F.col("c") / _HOT).cast("long")
    with_comp = members.filter("c > 1").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumns({"comp": F.coalesce("comp", "cls"), "part": F.pmod(F.xxhash64("cls"), parts)})
    mixed = with_comp.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("c").alias("c")).filter("lo < hi")
    mixed = mixed.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    return with_comp.join(mixed, ["bucket", "part"], "left_semi").drop("part")


def keep_one_of_each(docs: DataFrame, shingle_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the near-duplicates of a document that stays; of rows that repeat a doc_id and its text, one stays."""
    found = stored(_groups(docs, shingle_words, threshold, 32, 5).filter("doc_id is not null").select("doc_id", "th", "first_id", "first_th"), "groups")
    ours = (F.col("doc_id") == F.col("first_id")) & (F.col("th") == F.col("first_th"))
    gone = found.filter(~ours).select("doc_id", "th").distinct()
    twice = found.filter(ours).groupBy("doc_id", "th").count().filter("count > 1").select("doc_id", "th")
    th = fresh(docs, "text_hash")
    rows = docs.withColumn(th, F.xxhash64("text"))
    rows = join_checked(rows, gone.withColumnRenamed("th", th), ["doc_id", th], _MOST_BROADCAST, "left_anti")
    if twice.limit(1).count():
        twice = stored(twice.withColumnRenamed("th", th), "twice")
        once = join_checked(rows, twice, ["doc_id", th], _MOST_BROADCAST, "left_anti")
        rows = once.unionByName(join_checked(rows, twice, ["doc_id", th], _MOST_BROADCAST, "left_semi").dropDuplicates(["doc_id", th]))
    return rows.select(*(f"`{c}`" for c in docs.columns))
