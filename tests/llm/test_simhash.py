"""SimHash groups against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_small import docs, empty, odd_docs, words
from tidewater.llm import queries, simhash


def brute_print(text, k=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, most):
    """prints: (doc_id, fingerprint), ids not null."""
    names = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= most and names[i] != names[j]:
                old, new = names[i], names[j]
                names = [new if n == old else n for n in names]
    first = {}
    for (doc, _), n in zip(prints, names):
        first[n] = min(first.get(n, doc), doc)
    return [(doc, p, first[n]) for (doc, p), n in zip(prints, names)]


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_coordinates_tell_all_values_of_a_segment_apart(bits):
    for mask in simhash.segments(4 * bits).tolist():
        low = (mask & -mask).bit_length() - 1
        width = mask.bit_count()
        values = np.arange(1 << min(width, 16), dtype=np.uint64) << np.uint64(low)
        place = simhash.segments(4 * bits).tolist().index(mask)
        rows = simhash.distance_table(values, bits)[:, place, :]
        assert len(np.unique(rows, axis=0)) == len(values)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 4))
def test_links_connect_what_brute_force_connects(seed, most):
    rng = random.Random(seed)
    prints = {rng.getrandbits(64) for _ in range(10)}
    for _ in range(40):
        p = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 6)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    prints = sorted(prints)
    names = {p: c for p, _, c in brute_components([(p, p) for p in prints], most)}
    group = {p: p for p in prints}
    for i, j in simhash.links_of(np.array(prints, dtype=np.uint64), most):
        assert (prints[i] ^ prints[j]).bit_count() <= most
        old, new = group[prints[i]], group[prints[j]]
        assert old != new
        group = {p: new if g == old else g for p, g in group.items()}
    pairs = [(a, b) for a in prints for b in prints]
    assert all((group[a] == group[b]) == (names[a] == names[b]) for a, b in pairs)


@pytest.mark.parametrize("deal", [2000, 5, 1])
def test_deals_miss_no_pair(spark, deal):
    """Whatever the size from which deals are dealt again."""
    rng = random.Random(deal)
    base = [rng.getrandbits(64) for _ in range(120)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4))) for b in base for _ in range(3)]
    dense = [base[0] ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(0, i, 5)]
    prints = sorted(set(base + near + dense))
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    group = {p: p for p in prints}
    for a, b in simhash.links(frame, 3, deal).collect():
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 3
        old, new = group[a], group[b]
        group = {p: new if g == old else g for p, g in group.items()} if old != new else group
    names = {p: c for p, _, c in brute_components([(p, p) for p in prints], 3)}
    pairs = [(prints[i], prints[j]) for i in range(len(prints)) for j in range(i)]
    assert all((group[a] == group[b]) == (names[a] == names[b]) for a, b in pairs)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        w = words(300, i).split()
        for j in range(4):
            rows.append((1000 - 4 * i - j, " ".join(w).title() if j == 3 else " ".join(w), "en", "a"))
            w[rng.randrange(300)] = "changed"
    rows += [(2000 + i, None if i % 2 else " \t", None, None) for i in range(5)] + [(3000, "Two words", "en", "a"), (3001, "two  WORDS", "en", "a")]
    frame = docs(spark, rows).unionByName(odd_docs(spark))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_simhash_near_dedup(spark, str(tmp_path)).collect()
    texts = [(r["doc_id"], brute_print(r["text"])) for r in frame.collect()]
    want = [(d, f"{p:016x}", c) for d, p, c in brute_components([x for x in texts if x[0] is not None], 3)]
    want += [(None, f"{p:016x}", None) for d, p in texts if d is None]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert len({r["component_id"] for r in got}) < len(got) - 60


def test_empty_table_and_long_texts(spark):
    assert simhash.groups(empty(spark)).count() == 0
    text = words(90_000, 5)
    assert simhash.fingerprint(text.encode(), 3) == brute_print(text)
    with pytest.raises(ValueError):
        simhash.groups(empty(spark), most_bits=5)
