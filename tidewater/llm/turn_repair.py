"""Cheapest repair of conversations to alternating roles, by a dynamic program over the turns that are retained.

A repaired conversation is empty, or user and assistant in turn, ending with assistant, after at most one system turn.
Each turn is kept (0), given the other role (1) or deleted (2; blank and repeated turns have to be); an empty turn of user
or assistant may be inserted anywhere (5). A truncated turn that stays costs 5 more.

Between two retained turns all others are deleted, at the difference of two prefix sums, and their two roles say how many
turns have to be inserted. So the cost to go from a place with a given last role is a minimum over the next retained turn,
which one running minimum for each role holds, less the prefix sum of the place: constant work a turn. The minima run from
the end, since of equally cheap edits the one counts whose audit (the initials of Keep, Rerole, Delete and Insert in order) is
least in ASCII: with the costs to go known, a walk from the front takes the least initial that is still cheapest.

Nothing needs a whole conversation in one task. Turns are sorted by conversation over all partitions (range partitioning), and
a partition packs them into fragments of bounded rows and bytes. Most conversations are one fragment. For the others,
a fragment's least costs between its roles at entry and exit (4 x 4) go backwards over the conversation's fragments, giving
each its costs to go; the exits that each entry leads to go forwards, giving each its entry. `digest` alone reads a
conversation's fragments in one task, as a stream, since a SHA-256 has to.

Faults: blank (nothing but white space), then duplicate (role and text as in an earlier turn that isn't blank), then truncated
(the last character that isn't white space is none of . ! ?). The first that applies counts.

Defined results: a null role or text is one blank; a role counts by its first letter, and one that begins with none of s, u, a
(an empty one too) is never kept. Turns are ordered by turn, nulls first; ties by role, then by a hash of the text, so repeated
rows are neighbours. Rows without conv_id are one conversation. Other columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import forget, join_checked, slices, stored

#: Costs.
_REROLE, _DELETE, _INSERT, _TRUNCATED = 1, 2, 5, 5
_NEVER = 10**15
#: States: the role that the output ends with, or none yet. Codes of roles are the states; 4 is any other role.
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
_CODES = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_NAMES = {_USER: "user", _ASSISTANT: "assistant"}
#: The role that follows a state without an insertion, system at the start aside.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
#: Turns to be inserted between a state and a role.
_GAP = tuple(tuple(_NEVER if t == _NONE or t == _SYSTEM and q != _NONE else 0 if t in (_NEXT[q], _SYSTEM) else _INSERT for t in range(4)) for q in range(4))
#: What completes an output that ends with a state.
_END = (0, 2 * _INSERT, _INSERT, 0)
_LEGAL = {(_SYSTEM, _USER), (_USER, _ASSISTANT), (_ASSISTANT, _USER)}
_BLANK, _DUPLICATE, _CUT = 1, 2, 3
#: Turns and characters of a fragment.
_TURNS, _CHARS = 2_000, 4_000_000
#: Fragments at the edges of partitions up to which their costs are broadcast; beyond, both sides are shuffled.
_MOST_BROADCAST = 100_000


def _price(kind: tuple[int, int], role: int) -> int:
    """What a turn (code of its role, fault) costs where it stays as role."""
    code, fault = kind
    if fault in (_BLANK, _DUPLICATE) or role == _NONE or role == _SYSTEM and code != _SYSTEM:
        return _NEVER
    return (0 if code == role else _REROLE) + (_TRUNCATED if fault == _CUT else 0)


def costs_to_go(kinds: list[tuple[int, int]], end: tuple[int, ...] = _END) -> list[tuple[int, ...]]:
    """For each place, the end included, and each state: the least cost of what follows, if `end` is what follows the end."""
    n = len(kinds)
    deleted = [_DELETE * i for i in range(n + 1)]  # prefix sums
    least = [_NEVER] * 4  # by role: over the turns from here on, the next retained one with what follows, and what is deleted up to it
    out = [tuple(end)]
    for i in range(n - 1, -1, -1):
        for role in (_SYSTEM, _USER, _ASSISTANT):
            least[role] = min(least[role], deleted[i] + _price(kinds[i], role) + out[-1][role])
        out.append(tuple(min(deleted[n] + end[q], *(_GAP[q][t] + least[t] for t in (_SYSTEM, _USER, _ASSISTANT))) - deleted[i] for q in range(4)))
    return out[::-1]


def walk(kinds: list[tuple[int, int]], to_go: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, list[tuple[int | None, int]], int]:
    """The least of the cheapest audits from a state; the turns that stay (place or None if inserted, role); the state at the end."""
    audit, turns, i = [], [], 0
    while i < len(kinds):
        cost, role = to_go[i][state], _NEXT[state]
        code = kinds[i][0]
        kept = code if code == role or (code, state) == (_SYSTEM, _NONE) else None
        if cost == _DELETE + to_go[i + 1][state]:
            audit.append("D")
            i += 1
        elif cost == _INSERT + to_go[i][role]:
            audit.append("I")
            turns.append((None, role))
            state = role
        elif kept is not None and cost == _price(kinds[i], kept) + to_go[i + 1][kept]:
            audit.append("K")
            turns.append((i, kept))
            state, i = kept, i + 1
        else:
            audit.append("R")
            turns.append((i, role))
            state, i = role, i + 1
    while last and state in (_SYSTEM, _USER):
        audit.append("I")
        state = _NEXT[state]
        turns.append((None, state))
    return "".join(audit), turns, state


def crossing_costs(kinds: list[tuple[int, int]]) -> list[int]:
    """Least costs from each state before the turns to each state after them, row by row."""
    to = [costs_to_go(kinds, tuple(0 if q == t else _NEVER for q in range(4)))[0] for t in range(4)]
    return [to[t][q] if to[t][q] < _NEVER // 2 else _NEVER for q in range(4) for t in range(4)]


def _faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, th, fault of each turn. Of equal turns all but those with the least turn are duplicates; those with the same turn are neighbours later."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))).withColumn("th", F.md5("text"))
    rows = rows.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    first = rows.filter("not blank").groupBy("conv_id", "role", "th").agg(F.count(F.lit(1)).alias("often"), F.min(F.struct("turn")).alias("first")).filter("often > 1")
    again = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("th").alias("h"), "first")
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("th") == F.col("h")), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return rows.select("conv_id", "turn", "role", "text", "th", F.when(F.col("blank"), _BLANK).when(later, _DUPLICATE).when(cut, _CUT).otherwise(0).alias("fault"))


#: Rows of a result batch.
_ROWS = 200
_LONG, _INT, _TEXT = pa.int64(), pa.int32(), pa.string()


def _batch(rows: list[tuple], ddl: str, kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    names = [c.split()[0] for c in ddl.split(", ", len(kinds) - 1)]  # a struct can only be the last
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


_FRAGMENT = "conv_id long, part int, nth long, roles array<string>, texts array<string>, codes array<int>, faults array<int>, turns_seen array<long>, edge boolean, costs array<long>"


def _fragments(turns: int, chars: int):
    """Sorted turns to fragments. The first and last of a task, and what is cut for its size, are edges, with the costs of crossing them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        done: list[tuple] = []
        waiting = 0
        kinds = (_LONG, _INT, _LONG, pa.list_(_TEXT), pa.list_(_TEXT), pa.list_(_INT), pa.list_(_INT), pa.list_(_LONG), pa.bool_(), pa.list_(_LONG))
        now = before = None
        held, cut = 0, True  # cut: the fragment begins at an edge

        def pack(edge: bool) -> None:
            codes = [_CODES.get(r[0][:1], 4) for r in rows]
            faults = [r[2] for r in rows]
            seen = sorted({r[3] for r in rows if r[3] is not None})
            span = [seen[0], seen[-1], len(seen)] if seen else []
            costs = crossing_costs(list(zip(codes, faults))) if edge else None
            done.append((now[0], part, nth, [r[0] for r in rows], [r[1] for r in rows], codes, faults, span, edge, costs))

        for batch in slices(batches):
            for conv, turn, role, text, th, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (now != (conv,) or len(rows) >= turns or held >= chars):
                    same = now == (conv,)
                    pack(cut or same)
                    waiting += held
                    nth, cut, rows, held = nth + 1, same, [], 0
                    if len(done) >= _ROWS or waiting >= chars:
                        yield _batch(done, _FRAGMENT, kinds)
                        done.clear()
                        waiting = 0
                now = (conv,)
                this = (conv, turn, role, th)
                if not fault == _BLANK and this == before:
                    fault = _DUPLICATE
                before = this
                rows.append((role, text, fault, turn))
                held += len(text)
        if rows:
            pack(True)
        if done:
            yield _batch(done, _FRAGMENT, kinds)

    return run


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names))


_TO_GO = "part int, nth long, ends array<long>, last boolean, alone boolean, next_code int"


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges, each conversation's last first, to what follows each: costs by state at its end, and the code of the next turn."""
    now, ends, code = None, list(_END), None
    kinds = (_INT, _LONG, pa.list_(_LONG), pa.bool_(), pa.bool_(), _INT)
    held: tuple | None = None  # the last row, until it is known whether it is its conversation's only one
    for batch in batches:
        done = []
        for conv, part, nth, costs, first in _columns(batch, "conv_id", "part", "nth", "costs", "first_code"):
            new = now != (conv,)
            if held:
                done.append((*held[:4], held[4] and new, held[5]))
            if new:
                now, ends, code = (conv,), list(_END), None
            held = (part, nth, ends, code is None, new, code)
            ends = [min(_NEVER, *(costs[4 * q + t] + ends[t] for t in range(4))) for q in range(4)]
            code = first
        yield _batch(done, _TO_GO, kinds)
    if held:
        yield _batch([held], _TO_GO, kinds)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments with what follows them to the states that their cheapest walks from each state end in."""
    for batch in batches:
        out = []
        for codes, faults, ends, last in _columns(batch, "codes", "faults", "ends", "last"):
            kinds = list(zip(codes, faults))
            to_go = costs_to_go(kinds, tuple(ends))
            out.append([walk(kinds, to_go, q, last)[2] for q in range(4)])
        conv, part, nth = (batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "part", "nth"))
        yield pa.RecordBatch.from_arrays([conv, part, nth, pa.array(out, pa.list_(pa.int32()))], names=["conv_id", "part", "nth", "exits"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exits, each conversation's in order, to the state in which each fragment is entered."""
    now, state = None, _NONE
    for batch in batches:
        out = []
        for conv, exits in _columns(batch, "conv_id", "exits"):
            if now != (conv,):
                now, state = (conv,), _NONE
            out.append(state)
            state = exits[state]
        part, nth = (batch.column(batch.schema.get_field_index(c)) for c in ("part", "nth"))
        yield pa.RecordBatch.from_arrays([part, nth, pa.array(out, pa.int32())], names=["part", "nth", "entry"])


_REPAIRED = "conv_id long, part int, nth long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns_seen array<long>, repaired array<struct<role: string, text: string>>"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (_LONG, _INT, _LONG, *[_LONG] * 5, _TEXT, pa.list_(_LONG), pa.list_(pa.struct([("role", _TEXT), ("text", _TEXT)])))
    for batch in slices(batches, 50):
        out = []
        for conv, part, nth, roles, texts, codes, faults, seen, ends, last, code, entry in _columns(batch, "conv_id", "part", "nth", "roles", "texts", "codes", "faults", "turns_seen", "ends", "last", "next_code", "entry"):
            work = list(zip(codes, faults))
            last = ends is None or last
            to_go = costs_to_go(work, tuple(ends or _END))
            state = entry or _NONE
            audit, stay, at = walk(work, to_go, state, last)
            follows = codes if code is None else [*codes, code]
            illegal = sum(pair not in _LEGAL for pair in zip(follows, follows[1:]))
            cost = to_go[0][state] - (0 if last else ends[at])
            turns = [{"role": roles[i] if i is not None and codes[i] == role else _NAMES[role], "text": "" if i is None else texts[i]} for i, role in stay]
            out.append((conv, part, nth, *(faults.count(f) for f in (_BLANK, _DUPLICATE, _CUT)), illegal, cost, audit, seen, turns))
        yield _batch(out, _REPAIRED, kinds)


def repair(turns: DataFrame, fragment_turns: int = _TURNS, fragment_chars: int = _CHARS) -> DataFrame:
    """turns (conv_id, turn, role, text) repaired. A row for each fragment, in order of (part, nth) within a conversation: counts of
    faults, illegal neighbours (roles other than system-user, user-assistant, assistant-user; the next fragment's first turn included), cost and
    audit of its edits, [least, greatest, number] of its turn values (empty if all are null), and the repaired turns."""
    order = ["conv_id", "turn", "role", "th"]
    sorted_rows = _faults(turns).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "th", "fault")
    found = stored(sorted_rows.mapInArrow(_fragments(fragment_turns, fragment_chars), _FRAGMENT), "fragments")
    edges = found.filter("edge").select("conv_id", "part", "nth", "costs", F.col("codes")[0].alias("first_code"))
    behind = edges.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("nth"))
    to_go = stored(behind.mapInArrow(_backward, _TO_GO).filter("not alone").drop("alone"), "ends")
    split = join_checked(found.filter("edge"), to_go, ["part", "nth"], _MOST_BROADCAST, "inner")
    exits = split.select("conv_id", "part", "nth", "codes", "faults", "ends", "last").mapInArrow(_exits, "conv_id long, part int, nth long, exits array<int>")
    entries = exits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth").mapInArrow(_forward, "part int, nth long, entry int")
    known = stored(to_go.join(entries, ["part", "nth"]), "entries")
    forget(to_go)
    return join_checked(found.drop("edge", "costs"), known, ["part", "nth"], _MOST_BROADCAST).mapInArrow(_repaired, _REPAIRED)


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments, each conversation's in order, to one row a conversation; a conversation's texts pass by one fragment at a time."""
    now: tuple | None = None
    sums, audit, sha, lines = [0] * 5, [], hashlib.sha256(), 0
    low = high = None
    distinct = 0

    def row() -> tuple:
        return (now[0], 0 if low is None else high - low + 1 - distinct, *sums, "".join(audit), sha.hexdigest())

    kinds = (*[_LONG] * 7, _TEXT, _TEXT)
    for batch in slices(batches, 50):
        done = []
        for conv, *counts, some, seen, turns in _columns(batch, "conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns_seen", "repaired"):
            if now != (conv,):
                if now:
                    done.append(row())
                now, sums, audit, sha, lines, low, high, distinct = (conv,), [0] * 5, [], hashlib.sha256(), 0, None, None, 0
            sums = [a + b for a, b in zip(sums, counts)]
            audit.append(some)
            if seen:
                distinct += seen[2] - (high == seen[0])
                low, high = seen[0] if low is None else low, seen[1]
            for t in turns:
                sha.update((b"\n" if lines else b"") + f"{t['role']}:{t['text']}".encode())
                lines += 1
        yield _batch(done, _DIGEST, kinds)
    if now:
        yield _batch([row()], _DIGEST, kinds)


def digest(repaired: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conv_id of ids: gaps in the turns, sums and audits of the fragments, and the hash of the repaired turns as `role:text` lines."""
    folded = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth").mapInArrow(_folded, _DIGEST)
    every = ids.select(F.col("conv_id").cast("long").alias("id")).distinct()
    zero = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(folded, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in zero), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    )
