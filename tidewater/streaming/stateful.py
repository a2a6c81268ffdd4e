"""Stateful rules over keyed events, each as a stream and as its batch twin.

A rule is a step: (state, row) -> (state, rows out), with the rows of a key in order of time. On a stream, Spark keeps the state of
each key (applyInPandasWithState); in batch, a key's rows are folded in order, a batch at a time. Both give the same rows.

A rule may also act on silence: `deadline` is the time (ms) at which a state acts if no row of its key comes before, and
`expire` says how. On a stream that is a timer in event time, which fires once the watermark is past it; in batch, the next
row of the key or, after the last one, the time `until` shows that it passed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import asin, cos, radians, sin, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.operators import folds

Step = Callable[[tuple, pd.Series], tuple[tuple, list[tuple]]]


@dataclass(frozen=True)
class Rule:
    """key: column; order: columns that order a key's rows; state and out: schemas; start: a key's first state."""

    key: str
    order: tuple[str, ...]
    state: str
    start: tuple
    out: str
    step: Step
    deadline: Callable[[tuple], int | None] | None = None
    expire: Callable[[tuple, tuple], tuple[tuple, list[tuple]]] | None = None  # (key, state) -> (state, rows out)

    @property
    def names(self) -> list[str]:
        return [x.split()[0] for x in self.out.split(",")]


def _frame(rule: Rule, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=rule.names)


def _run(rule: Rule, key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, out = (tuple(state.get) if state.exists else rule.start), []
    if state.hasTimedOut:
        now, out = rule.expire(key, now)
    else:
        for row in pd.concat(list(pdfs)).sort_values(list(rule.order)).itertuples(index=False):
            now, some = _next(rule, key, now, row)
            out += some
    state.update(now)
    due = rule.deadline(now) if rule.deadline else None
    if due is not None:
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    yield _frame(rule, out)


def _next(rule: Rule, key: tuple, state: tuple, row) -> tuple[tuple, list[tuple]]:
    """The step of a row, after what its silence before brought."""
    out: list[tuple] = []
    due = rule.deadline(state) if rule.deadline else None
    if due is not None and row.ts.value // 1_000_000 >= due:
        state, out = rule.expire(key, state)
    state, some = rule.step(state, row)
    return state, [*out, *some]


def on_stream(df: DataFrame, rule: Rule) -> DataFrame:
    """df has a watermark on ts if the rule has a deadline."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _run(rule, key, pdfs, state)

    timeout = GroupStateTimeout.EventTimeTimeout if rule.deadline else GroupStateTimeout.NoTimeout
    return df.groupBy(rule.key).applyInPandasWithState(run, rule.out, rule.state, "append", timeout)


def on_batch(df: DataFrame, rule: Rule, until: int | None = None) -> DataFrame:
    """until: the time (ms) up to which silence is known, as a stream's watermark at its end; None: until the last row of each key only."""

    def end(key: tuple, state: tuple) -> list[tuple]:
        due = rule.deadline(state)
        return rule.expire(key, state)[1] if due is not None and due < until else []

    if rule.deadline is None:
        return folds.fold(df, [rule.key], list(rule.order), lambda: rule.start, rule.step, rule.out)
    return folds.fold(df, [rule.key], list(rule.order), lambda: rule.start, lambda state, row: _next(rule, (getattr(row, rule.key),), state, row), rule.out, end if until is not None else None)


# --- rules


def suppression(minutes: dict[str, int], key: str = "fingerprint") -> Rule:
    """An alert passes unless one of its key passed less than its severity's minutes ago."""

    def step(state: tuple, r) -> tuple[tuple, list[tuple]]:
        (last,) = state
        at = r.ts.value // 1_000_000
        if last < 0 or at - last >= minutes[r.severity] * 60_000:
            return (at,), [(getattr(r, key), r.ts, r.severity)]
        return state, []

    return Rule(key, ("ts", "id"), "last long", (-1,), f"{key} string, ts timestamp, severity string", step)


def alert_lifecycle(minutes: dict[str, int], quiet: int, days: int = 7, key: str = "fingerprint") -> Rule:
    """Findings to alerts that are raised and, after `quiet` minutes without a finding of their key, resolved.

    A finding raises an alert unless one of its key was raised less than its severity's minutes ago, resolved or not. What is
    resolved are the key's open alerts raised within `days`; older ones stay open. A raised alert is out at once, a resolved one
    once the silence is certain, with the time (ms) at which it was. The state holds the alerts of `days` at most, by microseconds.
    """
    window = days * 86_400_000_000

    def step(state: tuple, r) -> tuple[tuple, list[tuple]]:
        _, last, since, kinds = state
        at = r.ts.value // 1_000_000
        if 0 <= last and at - last < minutes[r.severity] * 60_000:
            return (at, last, since, kinds), []
        micros = r.ts.value // 1000
        young = [i for i, x in enumerate(since) if x > micros - window]
        since, kinds = [*(since[i] for i in young), micros], [*(kinds[i] for i in young), r.severity]
        return (at, at, since, kinds), [(getattr(r, key), r.ts, r.severity, "raised", r.ts)]

    def deadline(state: tuple) -> int | None:
        return state[0] + quiet * 60_000 if len(state[2]) else None

    def expire(name: tuple, state: tuple) -> tuple[tuple, list[tuple]]:
        due = deadline(state)
        out = [(*name, pd.Timestamp(due, unit="ms"), kind, "resolved", pd.Timestamp(x, unit="us")) for x, kind in zip(state[2], state[3]) if x > due * 1000 - window]
        return (state[0], state[1], [], []), out

    return Rule(key, ("ts", "id"), "seen long, last long, since array<long>, kinds array<string>", (-1, -1, [], []), f"{key} string, ts timestamp, severity string, change string, raised timestamp", step, deadline, expire)


def debounce(seconds: int, urgent: int = 3, key: str = "source") -> Rule:
    """A wake passes if none of its key passed within `seconds`; priorities from `urgent` always pass."""

    def step(state: tuple, r) -> tuple[tuple, list[tuple]]:
        (last,) = state
        at = r.ts.value // 1_000_000
        if r.priority >= urgent or last < 0 or at - last >= seconds * 1000:
            return (at,), [(getattr(r, key), r.ts, int(r.priority))]
        return state, []

    return Rule(key, ("ts", "id"), "last long", (-1,), f"{key} string, ts timestamp, priority long", step)


def promotion(least: int = 3, days: int = 7, keep: int = 5, key: str = "source") -> Rule:
    """When a key has `least` notable rows within `days`, its last `keep` are promoted, each once; seen counts all rows within `days`.

    The state is the times within `days`, which an exact count needs, and which of the last `keep` are done.
    """

    def step(state: tuple, r) -> tuple[tuple, list[tuple]]:
        at = r.ts.value // 1_000_000
        recent = list(state[0])
        recent = recent[bisect_left(recent, at - days * 86_400_000) :]
        insort(recent, at)
        last, done, out = recent[-keep:], set(state[1]), []
        if len(recent) >= least:
            for x in last:
                if x not in done:
                    done.add(x)
                    out.append((getattr(r, key), pd.Timestamp(x, unit="ms"), len(recent)))
        return (recent, sorted(done.intersection(last))), out

    return Rule(key, ("ts", "id"), "recent array<long>, done array<long>", ([], []), f"{key} string, ts timestamp, seen long", step)


def health_states(failures: int = 1, resend_minutes: int = 60, key: str = "service") -> Rule:
    """down after `failures` failures in a row, recovered with the outage's seconds, again while down after the resend window; muted rows are skipped."""

    def step(state: tuple, r) -> tuple[tuple, list[tuple]]:
        fails, since, alerted = state
        at = r.ts.value // 1_000_000
        if r.muted:
            return state, []
        name = getattr(r, key)
        if r.ok:
            out = [(name, r.ts, "recovered", (at - since) // 1000)] if alerted >= 0 else []
            return (0, -1, -1), out
        fails, since = fails + 1, at if since < 0 else since
        if alerted < 0 and fails >= failures:
            return (fails, since, at), [(name, r.ts, "down", 0)]
        if alerted >= 0 and at - alerted >= resend_minutes * 60_000:
            return (fails, since, at), [(name, r.ts, "still_down", (at - since) // 1000)]
        return (fails, since, alerted), []

    return Rule(key, ("ts", "id"), "fails long, since long, alerted long", (0, -1, -1), f"{key} string, ts timestamp, change string, seconds long", step)


def travel_episodes(home: tuple[float, float], away_km: float = 80, back_km: float = 20, hours: float = 6, key: str = "person") -> Rule:
    """An episode begins when the person was beyond away_km for `hours`, and ends within back_km of home; out: begin, end, farthest."""

    def km(lat: float, lon: float) -> float:
        h = sin(radians(lat - home[0]) / 2) ** 2 + cos(radians(home[0])) * cos(radians(lat)) * sin(radians(lon - home[1]) / 2) ** 2
        return 12742 * asin(sqrt(min(1.0, h)))

    def step(state: tuple, r) -> tuple[tuple, list[tuple]]:
        left, far = state
        at, d = r.ts.value // 1_000_000, km(r.lat, r.lon)
        if left < 0:
            return ((at, d) if d > away_km else state), []
        if d < back_km:
            long = at - left >= hours * 3_600_000
            return (-1, 0.0), [(getattr(r, key), pd.Timestamp(left, unit="ms"), r.ts, round(far, 3))] if long else []
        return (left, max(far, d)), []

    return Rule(key, ("ts", "id"), "left long, far double", (-1, 0.0), f"{key} string, begins timestamp, ends timestamp, farthest double", step)
