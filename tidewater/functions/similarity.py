"""Similarities of names as Column expressions, each symmetric and within 0 to 1, and the one by edit distance also of many names at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def grams(c: Column, n: int) -> Column:
    """Distinct n-grams of a string; empty where it is shorter."""
    return F.when(F.char_length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of distinct bigrams."""
    x, y = grams(a, 2), grams(b, 2)
    both = F.size(F.array_intersect(x, y))
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.try_divide(2.0 * both, F.size(x) + F.size(y)), F.lit(0.0)))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each alphanumeric word, with two blanks before it and one behind."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: grams(F.concat(F.lit("  "), w, F.lit(" ")), 3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the trigram sets."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.8 if one contains the other, else one minus the edit distance over the longer length."""
    return tidy_edit_similarity(tidy(a), tidy(b))


def tidy_edit_similarity(x: Column, y: Column) -> Column:
    """The same of names that are tidy already."""
    longer = F.greatest(F.char_length(x), F.char_length(y))
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).when(x.contains(y) | y.contains(x), 0.8).otherwise(1 - F.try_divide(F.levenshtein(x, y).cast("double"), longer))


def edit_values(longest: int) -> list[float]:
    """tidy_edit_similarity by the codes of edit_codes."""
    return [1 - d / n if n else 1.0 for n in range(longest + 1) for d in range(n + 1)] + [0.8]


def edit_codes(x: Sequence[str], y: Sequence[str], longest: int) -> np.ndarray:
    """For each two of x and y, names in order of length of at most `longest` characters, the place of their tidy_edit_similarity in edit_values(longest): all distances advance together, a character at a time."""
    lx, ly = (np.array([len(v) for v in z], dtype=np.int32) for z in (x, y))
    top = int(max(lx[-1], ly[-1], 1))
    chars = np.array([*x, *y], dtype=f"U{top}").view(np.uint32).reshape(-1, top)
    same, least = (chars == chars[0]).all(axis=0), int(min(lx[0], ly[0]))
    head = least if same[:least].all() else int(np.argmin(same[:least]))  # characters that all begin with don't change a distance
    kinds, chars = np.unique(chars[:, head:], return_inverse=True)
    chars = chars.reshape(len(x) + len(y), -1).astype(np.min_scalar_type(len(kinds)))
    cx, cy = chars[: len(x)], chars[len(x) :].T.copy()
    nx, ny = lx - head, ly - head
    kind = np.min_scalar_type(top + 1)
    before, now = (np.empty((ny[-1] + 1, len(x), len(y)), dtype=kind) for _ in range(2))
    before[:] = np.arange(ny[-1] + 1, dtype=kind)[:, None, None]
    out = np.empty((len(x), len(y)), dtype=kind)
    ends = [(int(j), *np.searchsorted(ny, [j, j + 1])) for j in np.unique(ny)]
    firsts = [int(np.searchsorted(ny, j)) for j in range(ny[-1] + 1)]
    cost, step = np.empty(out.shape, dtype=bool), np.empty(out.shape, dtype=kind)
    added = cost.view(np.uint8)
    for i in range(nx[-1] + 1):
        r, done = np.searchsorted(nx, [i, i + 1])  # names before r have ended, those before done end here
        if i:
            now[0, r:] = i
            for j in range(1, ny[-1] + 1):
                c = firsts[j]
                at = (slice(r, None), slice(c, None))
                np.not_equal(cx[r:, i - 1, None], cy[j - 1, None, c:], out=cost[at])
                np.minimum(before[j][at], now[j - 1][at], out=step[at])
                step[at] += 1
                np.add(before[j - 1][at], added[at], out=now[j][at])
                np.minimum(now[j][at], step[at], out=now[j][at])
            before, now = now, before
        for j, b, e in ends:
            out[r:done, b:e] = before[j, r:done, b:e]
    if lx[0] == ly[-1] and ly[0] == lx[-1]:
        return out + np.int32(lx[0] * (lx[0] + 1) // 2)
    longer, shorter = np.maximum(lx[:, None], ly), np.minimum(lx[:, None], ly)
    codes = longer * (longer + 1) // 2 + out
    for i, j in np.argwhere((out == longer - shorter) & (longer != shorter) & (shorter > 0)):  # one that contains the other is as far from it as it is longer
        if x[i] in y[j] or y[j] in x[i]:
            codes[i, j] = (longest + 1) * (longest + 2) // 2
    return codes


def name_key(c: Column) -> Column:
    """What name_alike compares: computed once for each name, before names meet in pairs."""
    t = tidy(c)
    return F.struct(t.alias("t"), F.split(t, " ").alias("p"), grams(t, 2).alias("g"))


def name_alike(x: Column, y: Column) -> Column:
    """Rules on parts of names, given as name_key: equal 1; same first and last .95; same last only .45; one is the other's first
    name .7; containment .65; else Dice."""
    a, b, px, py = x["t"], y["t"], x["p"], y["p"]
    many = (F.size(px) > 1) & (F.size(py) > 1)
    first, last = F.get(px, F.lit(0)) == F.get(py, F.lit(0)), F.element_at(px, -1) == F.element_at(py, -1)
    one = (F.size(px) == 1) | (F.size(py) == 1)
    shared = F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(x["g"], y["g"])), F.size(x["g"]) + F.size(y["g"])), F.lit(0.0))
    return F.when(a == b, 1.0).when(many & first & last, 0.95).when(many & last, 0.45).when(one & first, 0.7).when(a.contains(b) | b.contains(a), 0.65).otherwise(shared)


def name_similarity(a: Column, b: Column) -> Column:
    """name_alike of two names."""
    return name_alike(name_key(a), name_key(b))
