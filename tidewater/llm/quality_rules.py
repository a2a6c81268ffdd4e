"""Quality rules: fixed counts, and divergence of a document's histograms from those of its language.

References are learned from the whole corpus: for each language, the histogram of character classes and the counts of
its common words. A document's two histograms (character classes; common words and 'other') are compared with its
language's reference by Jensen-Shannon distance. As a sample of n falls away from its own distribution by about
1/sqrt(n), the most that passes is a floor plus a noise term over sqrt(n), with n the document's characters or words.
Documents below the minimum length get no verdict from a histogram.

Every language of at least `least_words` words has a reference, whatever its share of the corpus; documents of smaller
ones get no verdict from histograms, as so few words are none. A word is common with at least 1/2000 of its language's
words, so a reference has 2,000 at most. References are aggregated in Spark. Up to `most_bytes` in all they are
broadcast; beyond, documents are joined with them by language.

Defined results: a null text has no words and fails the base rules; a null language is a language of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import as_bytes, bound_batches, join_checked, slices, stored

# The characters between words, and the symbols.
_BLANK, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
CLASSES = ("blank", "lower", "upper", "digit", "comma", "stop", "symbol", "other_ascii", "latin_lower", "latin_upper", "letter", "other")
#: Documents of fewer words or characters than these get no verdict from the word or the character histogram.
LEAST_WORDS, LEAST_CHARS = 50, 200


def _class_table() -> np.ndarray:
    import unicodedata

    out = np.full(0x3000, CLASSES.index("other"), dtype=np.uint8)
    for i in range(len(out)):
        c = chr(i)
        if i < 128 and i in _BLANK:
            k = "blank"
        elif i < 128 and c.islower():
            k = "lower"
        elif i < 128 and c.isupper():
            k = "upper"
        elif c.isdigit():
            k = "digit"
        elif c in ",;:'\"-()":
            k = "comma"
        elif c in ".!?":
            k = "stop" if c == "." else "other_ascii"
        elif i < 128 and i in _SYMBOLS:
            k = "symbol"
        elif i < 128:
            k = "other_ascii"
        elif i < 0x250 and c.isupper():
            k = "latin_upper"
        elif i < 0x250 and c.isalpha():
            k = "latin_lower"
        elif unicodedata.category(c)[0] == "L":
            k = "letter"
        else:
            continue
        out[i] = CLASSES.index(k)
    out[-1] = CLASSES.index("letter")  # stands for all above, most of which are letters
    return out


_TABLE = _class_table()


def char_classes(text: bytes) -> np.ndarray:
    """How many code points of each class the text has."""
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    return np.bincount(_TABLE[np.minimum(codes, len(_TABLE) - 1)], minlength=len(CLASSES))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(text) - sum(text.count(b) for b in _BLANK) - (0 if text.isascii() else int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        if len(number) < len(words):
            v = len(number)
            # Word numbers stay under 2**21 for texts of less than 2 million distinct words; larger ones go by pairs first.
            if v < 1 << 21:
                windows = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
            else:
                pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1].astype(np.int64)
                windows = pairs[:-1] * v + ids[2:]
            order = np.argsort(windows, kind="stable")
            s = windows[order]
            same = np.zeros(len(s) + 1, dtype=bool)
            same[1:-1] = s[1:] == s[:-1]
            twice = np.zeros(len(s), dtype=bool)
            twice[order] = same[1:] | same[:-1]
            cover = np.zeros(len(words), dtype=bool)
            for i in range(3):
                cover[i : i + len(twice)] |= twice
            repeated = int(cover.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, class or null, word or null, n)."""
    classes: dict[str | None, np.ndarray] = {}
    words: dict[str | None, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, w, None, n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, None, i, int(n)) for lang, c in classes.items() for i, n in enumerate(c) if n]
        words.clear()
        classes.clear()
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=["lang", "word", "class", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            classes[lang] = classes.get(lang, 0) + char_classes(text)
            words.setdefault(lang, Counter()).update(text.split())
        if sum(map(len, words.values())) > 150_000:
            yield out()
    yield out()


def references(docs: DataFrame, word_share: int = 2000, least_words: int = 2000, most_broadcast: int = 100_000) -> DataFrame:
    """lang, total (words), words (common ones and their counts), classes (and their counts), one row for each language of enough words."""
    counted = stored(docs.select("lang", "text").mapInArrow(_learn, "lang string, word binary, class int, n long").groupBy("lang", "word", "class").agg(F.sum("n").alias("n")), "words")
    words = counted.filter("word is not null").select("lang", "word", "n")
    total = stored(words.groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= least_words), "totals")
    common = join_checked(words, total, ["lang"], most_broadcast, "inner").filter(F.col("n") * word_share >= F.col("total"))
    common = common.groupBy("lang").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("word", "n"))).alias("words"))
    classes = counted.filter("class is not null").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("class", "n"))).alias("classes"))
    return common.join(classes, "lang")


class Reference:
    """Histograms of a language."""

    def __init__(self, total: int, words: list, classes: list):
        self.places = {bytes(w["word"]): i for i, w in enumerate(words)}
        self.words = np.array([*(w["n"] for w in words), total - sum(w["n"] for w in words)], dtype=float)
        self.classes = np.zeros(len(CLASSES))
        for c in classes:
            self.classes[c["class"]] = c["n"]

    def distances(self, text: bytes, chars: np.ndarray) -> tuple[float, float]:
        """Jensen-Shannon distances of the text's classes and words."""
        n, last = np.zeros(len(self.words)), len(self.words) - 1
        for w, c in Counter(text.split()).items():
            n[self.places.get(w, last)] += c
        return js_distance(chars.astype(float), self.classes), js_distance(n, self.words)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms."""
    p, q = p / max(p.sum(), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, (a + b) / 2)))


_JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def _judge(refs, chars_most: tuple[float, float], words_most: tuple[float, float]):
    """(doc_id, lang, text), and without broadcast references also total, words and classes, to _JUDGED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Reference | None] = {}
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(9)]
            for i, (lang, text) in enumerate(zip(batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True)):
                if lang not in known:
                    if len(known) > 500:
                        known.clear()
                    found = refs.value.get(lang) if refs else tuple(batch.column(c)[i].as_py() for c in range(3, 6))
                    known[lang] = Reference(*found) if found and found[0] else None
                counts = base_counts(text)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                c = w = None
                fits = True
                if known[lang]:
                    chars = char_classes(text)
                    n_chars = int(chars.sum())
                    c, w = known[lang].distances(text, chars)
                    fits = n_chars < LEAST_CHARS or c <= chars_most[0] + chars_most[1] / n_chars**0.5
                    fits &= counts[0] < LEAST_WORDS or w <= words_most[0] + words_most[1] / counts[0] ** 0.5
                for col, x in zip(cols, (*counts, failed, not failed and fits, c, w), strict=True):
                    col.append(x)
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[c.split()[0] for c in _JUDGED.split(", ")])

    return run


def judge(docs: DataFrame, chars_most: tuple[float, float] = (0.2, 2.0), words_most: tuple[float, float] = (0.3, 2.6), least_words: int = 2000, most_bytes: int = 50_000_000) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the two distances, one row for each row of docs. The bounds are (floor, noise)."""
    bound_batches(docs.sparkSession)
    # A null language and one of the name '' stay apart.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"), "text")
    refs = stored(references(rows, least_words=least_words), "references")
    bulk = refs.agg(F.coalesce(F.sum(40 * (F.size("words") + F.size("classes"))), F.lit(0))).first()[0]
    if bulk <= most_bytes:
        known = {r["lang"]: (r["total"], r["words"], r["classes"]) for r in refs.collect()}
        return rows.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(known), chars_most, words_most), _JUDGED)
    rows = rows.join(refs.hint("merge"), "lang", "left").select("doc_id", "lang", "text", "total", "words", "classes")
    return rows.mapInArrow(_judge(None, chars_most, words_most), _JUDGED)
