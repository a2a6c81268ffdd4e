"""Conversation repair against brute force over all edits, whole and cut into fragments."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import queries, turn_repair

TURNS = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def brute(kinds):
    """Least (cost, audit) over all edits of (role's initial, fault)."""

    @lru_cache(None)
    def go(i, state, inserted):
        best = (0, "") if i == len(kinds) and state in ("", "a") else (10**9, "")
        steps = [(5, "I", i, NEXT[state], inserted + 1)] if inserted < 3 else []
        if i < len(kinds):
            role, fault = kinds[i]
            steps.append((2, "D", i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                steps.append((1 + more, "R", i + 1, NEXT[state], 0))
                steps += [(more, "K", i + 1, role, 0)] if role == NEXT[state] or (role, state) == ("s", "") else []
        for cost, edit, *at in steps:
            rest = go(*at)
            best = min(best, (cost + rest[0], edit + rest[1]))
        return best

    return go(0, "", 0)


FAULTS = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
KINDS = st.lists(st.tuples(st.sampled_from([1, 2, 3, 2, 3, 4]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=9)


@settings(max_examples=400, deadline=None)
@given(KINDS)
def test_walk_is_the_least_of_the_cheapest(kinds):
    to_go = turn_repair.costs_to_go(kinds)
    want = brute(tuple((" sua?"[c], FAULTS[f]) for c, f in kinds))
    assert (to_go[0][0], turn_repair.walk(kinds, to_go, 0, True)[0]) == want


@settings(max_examples=200, deadline=None)
@given(KINDS, st.integers(0, 9))
def test_crossing_costs_compose(kinds, cut):
    one, two = (turn_repair.crossing_costs(k) for k in (kinds[:cut], kinds[cut:]))
    both = [min(one[4 * q + m] + two[4 * m + t] for m in range(4)) for q in range(4) for t in range(4)]
    assert [min(x, 10**15) for x in both] == turn_repair.crossing_costs(kinds)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def brute_digest(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        kinds, seen = [], set()
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\v\f\r")
            kinds.append((role[:1], "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        cost, audit = brute(tuple(kinds))
        lines, state, at = [], "", 0
        names = {"u": "user", "a": "assistant"}
        size = sum(e != "D" for e in audit)
        for e in audit:
            role, text = mine[at][2:] if e != "I" else ("", "")
            if e != "D":
                state = "s" if not lines and size % 2 else NEXT[state]
                lines.append(f"{role if e == 'K' else names[state]}:{text}")
            at += e != "I"
        turns = [r[1] for r in mine if r[1] is not None]
        pairs = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(k[1] == f for k in kinds) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def conversations(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "Yes.", "No?", "No end", " ", "", "Well! \n", "one. two", "é!", "Right.\t", None]
    rows = [(c, t if rng.random() < 0.9 else t + 3, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(10**6)}.") for c in range(60) for t in range(rng.randrange(1, 12))]
    rows += [(7000, t, "user" if t % 2 else "assistant", rng.choice(texts)) for t in range(14)] + [(None, None, "user", "x.")] * 2 + [(None, 2, "assistant", "y"), (8000, None, "system", "z!"), (8000, None, "system", "z!")]
    return rows


@pytest.mark.parametrize("size", [2000, 3, 1])
def test_query_equals_brute_force(spark, tmp_path, size):
    rows = conversations(size)
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    table = spark.read.parquet(f"{tmp_path}/conversations.parquet")
    damage = queries._damaged(table).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.digest(turn_repair.repair(damage, fragment_turns=size), table).collect()}
    assert got == brute_digest(rows)
    if size == 2000:
        assert {r["conv_id"]: tuple(r)[1:] for r in queries.op12_turn_repair(spark, str(tmp_path)).collect()} == got


def test_one_conversation_spreads_over_tasks(spark):
    """A conversation of 6,000 turns: 1,500 rows a partition at most, one result."""
    rows = [(1, i, "user" if i % 3 else "assistant", f"Text {i}.") for i in range(6000)]
    frame = spark.createDataFrame(rows, TURNS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = turn_repair.repair(frame, fragment_turns=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = {r["part"]: r["audit"] for r in out.select("part", "nth", "audit").orderBy("part", "nth").collect()}
    assert len(parts) >= 4
    whole = turn_repair.digest(out, frame).first()
    kinds = [(2 if i % 3 else 3, 0) for i in range(6000)]
    to_go = turn_repair.costs_to_go(kinds)
    assert (whole["cost"], whole["audit"]) == (to_go[0][0], turn_repair.walk(kinds, to_go, 0, True)[0])


def test_empty_table_and_other_columns(spark):
    assert turn_repair.repair(spark.createDataFrame([], TURNS)).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 5, "x"), (1, 1, "assistant", "Yes.", 6, "y")], TURNS + ", blank long, audit string")
    out = turn_repair.digest(turn_repair.repair(rows), rows).first()
    assert out["audit"] == "KK" and out["blank"] == 0 and out["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
