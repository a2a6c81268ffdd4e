"""Language-model scoring: the marginal likelihood of a text over all segmentations into subwords.

The vocabulary is that of a public tokenizer. Its pieces get unigram scores from the training documents: words are
counted, segmented once by the tokenizer, and the pieces' counts smoothed. A word's probability is the sum over all of
its segmentations (a lattice) of the product of the pieces' probabilities, by a forward recursion in log space; a
document's is that of its words and an end. Characters outside the vocabulary go by bytes.

Words are counted over the whole corpus by key. A word's lattice is computed once, not once for each occurrence. Words
that make up at least 1/200,000 of all tokens (so 200,000 at most) are broadcast; the others meet their documents by a
join on the word, from which documents' sums are aggregated. No table of all words is ever in one place.

Held out are the documents with crc32(doc_id as text) mod 10 = 0; a null doc_id counts as the text ''.

Defined results: a null text is empty and has one token, the end. Without training tokens, N = V = 0.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import as_bytes, bound_batches, stored

_LOG10 = math.log(10)
_END = b" "  # no word holds a blank
_BOUND = "▁"  # what pieces have for the blank before a word


def held_out(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (word, n): n counts training tokens; words of held-out documents have 0."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        words, n = list(counts.keys()), list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            words = text.lower().split()
            if held_out(doc_id):
                for w in words:
                    if w not in counts:
                        counts[w] = 0
            else:
                counts.update(words)
                counts[_END] += 1
        if len(counts) > 200_000:
            yield out()
    yield out()


def _count_pieces(path: str):
    """(word, n) to (piece, n), by the tokenizer's own segmentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        counts = [0] * sp.get_piece_size()
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            for ids, n in zip(sp.encode(words, num_threads=1), batch.column(1).to_pylist(), strict=True):
                for i in ids:
                    counts[i] += n
        some = [(i, n) for i, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([n for _, n in some], pa.int64())], names=["piece", "n"])

    return run


class Lattice:
    """Log-probabilities of words over all segmentations."""

    def __init__(self, scores: dict[str, float], byte_scores: list[float], end: float):
        self.scores, self.bytes, self.end = scores, byte_scores, end
        self.longest = max(map(len, scores), default=1)
        self.starts = {p[:2] for p in scores if len(p) > 1}

    def word(self, word: bytes) -> float:
        text = _BOUND + word.decode("utf-8", "replace")
        n = len(text)
        scores, starts, longest, exp, log = self.scores, self.starts, self.longest, math.exp, math.log
        arrivals: list[list[float]] = [[] for _ in range(n + 1)]
        arrivals[0].append(0.0)
        for i in range(n):
            into = arrivals[i]
            if len(into) == 1:
                alpha = into[0]
            elif into:
                top = max(into)
                alpha = top + log(sum([exp(x - top) for x in into]))
            else:
                continue
            arrivals[i] = []
            one = scores.get(text[i])
            # A single character goes as its piece, or by bytes where it has none.
            arrivals[i + 1].append(alpha + (one if one is not None else sum(self.bytes[b] for b in text[i].encode())))
            if text[i : i + 2] in starts:
                for j in range(i + 2, min(n, i + longest) + 1):
                    s = scores.get(text[i:j])
                    if s is not None:
                        arrivals[j].append(alpha + s)
        into = arrivals[n]
        top = max(into)
        return top + log(sum([exp(x - top) for x in into]))


def unigram_scores(counted: DataFrame, path: str, smoothing: float = 0.5) -> Lattice:
    """The tokenizer's vocabulary with log-probabilities from the training words; the end and all bytes share the unit mass."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()  # the vocabulary bounds what is collected
    train = counted.filter("n > 0")
    pieces = train.filter(F.col("word") != F.lit(_END)).mapInArrow(_count_pieces(path), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    n = {r["piece"]: r["n"] for r in pieces.collect()}
    ends = train.filter(F.col("word") == F.lit(_END)).agg(F.sum("n")).first()[0] or 0
    usable = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    mass = math.log(sum(n.get(i, 0) for i in usable) + ends + smoothing * (len(usable) + 1))
    log_p = {i: math.log(n.get(i, 0) + smoothing) - mass for i in usable}
    scores = {sp.id_to_piece(i): log_p[i] for i in usable if not sp.is_byte(i)}
    byte_scores = [math.log(smoothing) - mass] * 256
    for i in usable:
        if sp.is_byte(i):
            byte_scores[int(sp.id_to_piece(i)[3:5], 16)] = log_p[i]
    return Lattice(scores, byte_scores, math.log(ends + smoothing) - mass)


def _word_scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = model.value
        for batch in batches:
            scores = [lattice.end if w == _END else lattice.word(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["word", "n", "log_p"])

    return run


def _score_docs(head):
    """(doc_id, text) to one row for each document (its sums over frequent words) and one for each other word of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = head.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows, ids, words, times, known, bases, logs = [], [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                row += 1
                counts = Counter(text.lower().split())
                counts[_END] = 1
                k, b, s = 0, 0.0, 0.0
                total = 0
                for w, c in counts.items():
                    total += c
                    f = frequent.get(w)
                    if f is None:
                        rows.append(row)
                        ids.append(None)
                        words.append(w)
                        times.append(c)
                        known.append(0)
                        bases.append(0.0)
                        logs.append(0.0)
                    else:
                        k += c
                        b += c * f[0]
                        s += c * f[1]
                rows.append(row)
                ids.append(doc_id)
                words.append(b" %d" % row)  # a key of its own, which no word equals
                times.append(total)
                known.append(k)
                bases.append(b)
                logs.append(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int64()), pa.array(known, pa.int64()), pa.array(bases, pa.float64()), pa.array(logs, pa.float64())],
                names=["row", "doc_id", "word", "times", "known", "base", "log_p0"],
            )

    return run


def score(docs: DataFrame, vocabulary: str, head_share: int = 200_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), one row for each row of docs."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = stored(texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    stats = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n, v = stats["n"], stats["v"]
    model = spark.sparkContext.broadcast(unigram_scores(counted, vocabulary))
    scored = stored(counted.mapInArrow(_word_scores(model), "word binary, n long, log_p double"), "lattices")
    base, per = 0.1, n + 0.1 * (v + 1)

    def log_base(c):
        return F.log10((c + F.lit(base)) / F.lit(per))

    head_rows = scored.filter((F.col("n") > 0) & (F.col("n") * head_share >= n)).select("word", log_base(F.col("n")).alias("b"), "log_p").collect()  # head_share rows at most
    head = spark.sparkContext.broadcast({bytes(r["word"]): (r["b"], r["log_p"]) for r in head_rows})
    del head_rows
    parts = texts.mapInArrow(_score_docs(head), "row long, doc_id long, word binary, times long, known long, base double, log_p0 double")
    tail = scored.filter(~((F.col("n") > 0) & (F.col("n") * head_share >= n))).select("word", "n", "log_p")
    own = F.col("word").startswith(F.lit(b" ")) & (F.length("word") > 1)  # not the end
    joined = parts.join(tail, "word", "left").select(
        "row",
        "doc_id",
        F.when(own, F.col("times")).alias("n_tokens"),
        F.when(own, F.col("known")).when(F.col("n") > 0, F.col("times")).otherwise(0).alias("n_known"),
        F.when(own, F.col("base")).otherwise(F.col("times") * log_base(F.coalesce("n", F.lit(0)))).alias("b"),
        F.when(own, F.col("log_p0")).otherwise(F.col("times") * F.col("log_p")).alias("s"),
    )
    out = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("b").alias("base_score"), (F.sum("s") / _LOG10).alias("score"))
    return out.select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"),
        "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
    )


__all__ = ["Lattice", "held_out", "score", "unigram_scores"]
