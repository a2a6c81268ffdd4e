"""Personal data: fixed patterns as seeds, and contextual patterns bootstrapped from them.

1. Seeds: the four fixed kinds (email, ip, card, phone), found in whole texts.
2. Candidates: strings of a looser shape of a kind (a phone without '+', an address without a dot, IPv6, ...), and strings of any
   shape that digits make up for the most part. The latter have no kind of their own: each kind whose patterns reach one
   claims it, and the surest claim names it.
3. Contexts: the last word, and the last two words, before a seed or candidate, and the first word after it. Each (kind,
   context) is a pattern.
4. A bipartite graph of patterns and instances is scored in rounds. A pattern's confidence is the sum of its
   instances' scores divided by how often its context occurs in the whole corpus (plus a constant), so that frequent
   words never become trusted. An instance's score is the noisy-or of its patterns. Instances that reach the
   threshold support further patterns in the next round.
5. Candidates that patterns of high confidence reach are added as spans.

Patterns need two supporting instances, whatever the corpus. Up to `most_broadcast` contexts are counted, and patterns
applied, by a broadcast; beyond it, the same by joins on context, with the same results.

Defined results: a null text is empty and has no spans; rows are never dropped or merged.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import as_texts, bound_batches, forget, fresh, schema_with, slices, stored

# Kinds in their order.
KINDS = ("email", "ip", "card", "phone")

_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin within a run of digits: if it fails at the run's begin, it fails there too. This keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

_LOOSE_NUMBER = re.compile(r"(?<![\w+.])\(?[0-9][0-9 ().-]{5,}[0-9](?!\w)")
_LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?\(at\) ?| ?\[at\] ?)[A-Za-z0-9-]++(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]++)*+")
_LOOSE_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_WORDS = re.compile(r"\w+|[:=#]")
_WITH_DIGIT = re.compile(r"""(?<![^\s"'=:,;|<>])[^\s"'=:,;|<>0-9]*+[0-9][^\s"'=:,;|<>]*+""")
_EDGES = "`.!?()[]{}*#&%$-"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the fixed patterns, by kind, then start."""
    out: list[tuple[int, int, int]] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        local = len(text[last:at]) - len(text[last:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            out.append((0, at - local, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 16 <= len(d := _DIGITS.sub("", m[0])) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings of a looser shape that overlap nothing that is taken."""
    found: list[tuple[int, int, int]] = []
    if "@" in text or "(at)" in text or "[at]" in text:
        found += [(0, m.start(), m.end()) for m in _LOOSE_EMAIL.finditer(text)]
    if ":" in text:
        found += [(1, m.start(), m.end()) for m in _LOOSE_IP.finditer(text)]
    for m in _LOOSE_NUMBER.finditer(text):
        n = len(_DIGITS.sub("", m[0]))
        if 7 <= n <= 19:
            found.append((3 if n <= 12 else 2, m.start(), m.end()))
    if not found:
        return found
    ordered = sorted((s, e) for _, s, e in taken)
    begins, ends = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))
    out: list[tuple[int, int, int]] = []
    for kind, s, e in sorted(found, key=lambda x: (x[1], x[0])):
        before = bisect_left(begins, e)  # those that begin before the end; the furthest of them mustn't reach beyond the start
        if (not before or ends[before - 1] <= s) and (not out or out[-1][2] <= s):
            out.append((kind, s, e))
    return out


def any_shapes(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of strings without blanks and separators that overlap nothing that is taken: six digits or more, which are half or more of
    its letters and digits, and 64 of these at most. Marks at the edges don't belong to them."""
    ordered = sorted((s, e) for _, s, e in taken)
    begins, ends = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))
    out = []
    for m in _WITH_DIGIT.finditer(text):
        run = m[0]
        s = m.start() + len(run) - len(run.lstrip(_EDGES))
        e = m.end() - len(run) + len(run.rstrip(_EDGES))
        signs = [c for c in text[s : min(e, s + 200)] if c.isalnum()]
        digits = sum(c in "0123456789" for c in signs)
        if e - s <= 200 and 6 <= digits and len(signs) <= min(64, 2 * digits):
            before = bisect_left(begins, e)
            if not before or ends[before - 1] <= s:
                out.append((s, e))
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all that patterns may reach; one of any shape comes once for each kind of digits.

    Of those that overlap, only the first and longest counts, so that one string isn't two instances of a pattern.
    """
    found = [(s, -e, k, (k,)) for k, s, e in loose_spans(text, taken)] + [(s, -e, len(KINDS), (1, 2, 3)) for s, e in any_shapes(text, taken)]
    out: list[tuple[int, int, int]] = []
    for s, e, _, kinds in sorted(found):
        if not out or out[-1][2] <= s:
            out += [(k, s, -e) for k in kinds]
    return out


def all_contexts(text: str, start: int, end: int) -> tuple[str, str, str]:
    """Those before start, and the word after end behind a '>' ('^' where there is none)."""
    m = _WORDS.search(text, end)
    return *contexts(text, start), f">{m[0].lower()}" if m else "^"


def _apart(found: list[tuple[int, int, float, int]]) -> list[tuple[int, int, int]]:
    """(start, -end, doubt, kind) of candidates to (kind, start, end): the surest kind of each."""
    out: list[tuple[int, int, int]] = []
    for s, e, _, kind in sorted(found):
        if not out or out[-1][2] <= s:
            out.append((kind, s, -e))
    return out


def contexts(text: str, start: int) -> tuple[str, str]:
    """The last word, and the last two words, before start ('^' where there are none)."""
    width = 64
    while True:
        at = max(0, start - width)
        found = [m[0] for m in _WORDS.finditer(text, at, start)]
        if at == 0 or len(found) > 2:  # the first one may be cut, the last two aren't
            break
        width *= 8
    words = " ".join(found[-2:]).lower().split()
    return words[-1] if words else "^", " ".join(words[-2:]) if len(words) > 1 else "^ ^"


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to rows (kind, context, instance, seed)."""
    for batch in slices(batches):
        rows: list[tuple[int, str, int, bool]] = []
        for text in as_texts(batch.column(0)):
            if not _ANY.search(text):
                continue
            seeds = base_spans(text)
            for spans, seed in ((seeds, True), (candidates(text, seeds), False)):
                for kind, s, e in spans:
                    inst = xxhash.xxh3_64_intdigest(text[s:e].encode()) - (1 << 63)
                    rows += [(kind, c, inst, seed) for c in all_contexts(text, s, e)]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_())], names=["kind", "context", "instance", "seed"])


def _occurrences(wanted):
    """Texts to (context, n): how often each wanted context occurs anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, pairs = wanted.value
        seconds = {p.split(" ")[1] for p in pairs}
        counts = dict.fromkeys([*ones, *pairs], 0)
        for batch in batches:
            for text in as_texts(batch.column(0)):
                words = _WORDS.findall(text.lower())
                for w in filter(ones.__contains__, words):
                    counts[w] += 1
                for i, w in enumerate(words):
                    if w in seconds and i and (p := f"{words[i - 1]} {w}") in pairs:
                        counts[p] += 1
        some = [(k, n) for k, n in counts.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["context", "n"])

    return run


def _all_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (context, n), as _occurrences does, of all words and pairs of words."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        some = list(counts.items())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["context", "n"])

    for batch in batches:
        for text in as_texts(batch.column(0)):
            words = _WORDS.findall(text.lower())
            counts.update(words)
            counts.update(f"{a} {b}" for a, b in zip(words, words[1:]))
            if len(counts) > 150_000:
                yield out()
    yield out()


def learn_patterns(docs: DataFrame, trust: float = 0.5, doubt: float = 1.0, rounds: int = 3, most_broadcast: int = 100_000) -> DataFrame:
    """(kind, context, confidence) of the patterns that reach trust."""
    spark = docs.sparkSession
    bound_batches(spark)
    seen = docs.select("text").mapInArrow(_observe, "kind int, context string, instance long, seed boolean")
    edges = stored(seen.groupBy("kind", "context", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("times")), "edges")
    least = 2
    often = edges.groupBy("kind", "context").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & ~F.col("context").startswith("^"))
    often = stored(often.select("context", F.ltrim("context", F.lit(">")).alias("words")).distinct(), "often")
    frequent = [r[0] for r in often.select("words").distinct().limit(most_broadcast + 1).collect()]
    empty = spark.createDataFrame([], "kind int, context string, confidence double")
    if not frequent:
        return empty
    texts = docs.select("text")
    if len(frequent) <= most_broadcast:
        wanted = spark.sparkContext.broadcast((frozenset(c for c in frequent if " " not in c), frozenset(c for c in frequent if " " in c)))
        counts = texts.mapInArrow(_occurrences(wanted), "context string, n long")
    else:
        counts = texts.mapInArrow(_all_occurrences, "context string, n long")
    total = counts.groupBy(F.col("context").alias("words")).agg(F.sum("n").alias("n"))
    total = stored(total.join(often, "words").select("context", "n"), "contexts")
    graph = stored(edges.join(total, "context"), "graph")
    scores = graph.select("kind", "instance", F.col("seed").cast("double").alias("score")).distinct()
    scores = scores.groupBy("kind", "instance").agg(F.max("score").alias("score"))
    patterns = empty
    for _ in range(rounds):
        mass = F.sum(F.col("score") * F.col("times"))
        patterns = stored(graph.join(scores, ["kind", "instance"]).groupBy("kind", "context").agg((mass / (F.greatest(F.max("n"), F.sum("times")) + doubt)).alias("confidence"), F.sum(F.when(F.col("score") >= trust, 1).otherwise(0)).alias("support")), "patterns").filter((F.col("confidence") >= trust) & (F.col("support") >= least)).drop("support")
        reached = graph.join(patterns, ["kind", "context"], "left").groupBy("kind", "instance").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log1p(-F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999)))))).alias("score"))
        scores = stored(reached.select("kind", "instance", F.when(F.col("seed"), 1.0).when(F.col("score") >= trust, F.col("score")).otherwise(0.0).alias("score")), "scores")
    forget(edges)
    return patterns


def _spans(text: str, confidence: dict, trust: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the candidates that patterns reach."""
    if not _ANY.search(text):
        return [], []
    base, added = base_spans(text), []
    if confidence:
        for kind, s, e in candidates(text, base):
            doubt = 1.0
            for c in all_contexts(text, s, e):
                doubt *= 1 - confidence.get((kind, c), 0.0)
            if 1 - doubt >= trust:
                added.append((s, -e, doubt, kind))
    return base, _apart(added)


def _find(trusted, trust: float, at: int):
    """Adds base and added spans to each row; `at` is the text's column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            found = [_spans(text, trusted.value, trust) for text in as_texts(batch.column(at))]
            both = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f[i]] for f in found], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], names=[*batch.schema.names, "b", "a"])

    return run


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first and longest."""
    parts, last = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if e > last:
            parts += [text[last : max(last, s)], f"[{KINDS[kind].upper()}]"]
            last = e
    return "".join([*parts, text[last:]])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, text) to (text_key, kind, start, end, one, two, next): candidates and their three contexts."""
    for batch in slices(batches):
        rows = [(key, k, s, e, *all_contexts(text, s, e)) for key, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), strict=True) if _ANY.search(text) for k, s, e in candidates(text, base_spans(text))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["text_key", "kind", "start", "end", "one", "two", "next"])


def _trusted_spans(docs: DataFrame, patterns: DataFrame, trust: float) -> DataFrame:
    """text_key, trusted: the candidates that patterns reach, one row for each text that has some."""
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = [[{"kind": k, "start": s, "end": e} for k, s, e in _apart([(f["start"], -f["end"], f["doubt"], f["kind"]) for f in found])] for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, span)], names=["text_key", "trusted"])

    found = docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("text_key"), "text").filter("text is not null")
    found = found.mapInArrow(_candidates, "text_key string, kind int, start long, end long, one string, two string, next string").dropDuplicates(["text_key", "kind", "start", "end"])
    doubt = F.lit(1.0)
    for c in ("one", "two", "next"):
        found = found.join(patterns.select("kind", F.col("context").alias(c), F.col("confidence").alias(f"by_{c}")), ["kind", c], "left")
        doubt = doubt * (1 - F.coalesce(f"by_{c}", F.lit(0.0)))
    found = found.withColumn("doubt", doubt).filter(1 - F.col("doubt") >= trust)
    texts = found.groupBy("text_key").agg(F.collect_list(F.struct("start", "end", "doubt", "kind")).alias("found"))
    return texts.mapInArrow(settle, "text_key string, trusted array<struct<kind:int,start:bigint,end:bigint>>")


def _trusted(docs: DataFrame, trust: float, most_broadcast: int):
    """The patterns, and their confidences as a broadcast, or None where they are too many."""
    patterns = learn_patterns(docs, trust, most_broadcast=most_broadcast)
    rows = patterns.limit(most_broadcast + 1).collect()
    few = len(rows) <= most_broadcast
    return patterns, docs.sparkSession.sparkContext.broadcast({(r["kind"], r["context"]): r["confidence"] for r in rows}) if few else None


def find_spans(docs: DataFrame, trust: float = 0.5, base: str = "base_spans", added: str = "added_spans", most_broadcast: int = 100_000) -> DataFrame:
    """docs with two columns more: spans (kind's number, start, end in code points) of the fixed patterns and of the method.

    Columns of docs of these two names give way.
    """
    docs = docs.drop(base, added)
    return _with_spans(docs, *_trusted(docs, trust, most_broadcast), trust, base, added)


def _with_spans(docs: DataFrame, patterns: DataFrame, trusted, trust: float, base: str, added: str) -> DataFrame:
    kind = "array<struct<kind:int,start:bigint,end:bigint>>"
    few = trusted or docs.sparkSession.sparkContext.broadcast({})
    out = docs.mapInArrow(_find(few, trust, docs.columns.index("text")), schema_with(docs, f"`{base}` {kind}, `{added}` {kind}"))
    if trusted:
        return out
    key, reached = fresh(out, f"{added}_key"), fresh(out, f"{added}_trusted")
    spans = _trusted_spans(docs, patterns, trust).withColumnsRenamed({"text_key": key, "trusted": reached})
    out = out.join(spans, F.sha2(F.col("text").cast("binary"), 256) == F.col(key), "left")
    return out.select(*(f"`{c}`" for c in docs.columns), base, F.coalesce(reached, added).alias(added))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as a string, from find_spans. What the method adds is counted by n_added and listed in spans only."""

    def joined(spans):
        ordered = F.array_sort(spans)
        names = F.array(*(F.lit(k) for k in KINDS))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base_spans", "added_spans")).alias("spans"),
        F.size("added_spans").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, trust: float = 0.5, most_broadcast: int = 100_000) -> DataFrame:
    """docs with every span replaced by its kind in brackets; n_chars (if there) follows the new text. A null text stays null."""
    at = docs.columns.index("text")
    patterns, trusted = _trusted(docs, trust, most_broadcast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            if trusted:
                found = [sum(_spans(t or "", trusted.value, trust), []) for t in texts]
            else:
                found = [[(s["kind"], s["start"], s["end"]) for s in a + b] for a, b in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            texts = [masked(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    width = len(docs.columns)
    rows = docs if trusted else _with_spans(docs, patterns, None, trust, fresh(docs, "pii_base_spans"), fresh(docs, "pii_added_spans"))
    out = rows.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


__all__ = ["KINDS", "base_spans", "digest", "find_spans", "learn_patterns", "redact"]
