"""Packing along a space-filling curve.

A document becomes token ids and an end token. Its ids, hashed into buckets, give a vector that a seeded Gaussian
projection brings down to three dimensions; their ranks on the normal curve, 10 bits each, give a Hilbert key. Rows are
range-sorted by the key, so that neighbours on the curve (documents of similar words) share sequences. Every sorted
partition then knows its number of tokens, sums of these give each partition its place in one long stream, and the
stream is cut at every `length` tokens. Only the last sequence is padded.

Ids are those of the public byte-level BPE tokenizer (the JSON file) without special tokens added; the string of a
special token within a text is that token. Where the rank file of the same vocabulary lies beside it, its library
encodes, several times as fast, what lies between special tokens.

Defined results: a null text is empty: its end token alone. Rows that repeat a document are packed each. Ties on the
curve go by doc_id. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from math import erf
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import as_texts, bound_batches, forget, slices, stored

BUCKETS, DIMS, BITS = 512, 3, 10
#: Columns of a piece; its ids follow.
PIECES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: Ids of a batch of pieces.
_FLUSH = 1_000_000
#: The rank file's library overflows its stack on much longer runs of white space; such texts go to the tokenizer.
_LONG_BLANK = 20_000
_BLANKS = re.compile(rf"\s{{{_LONG_BLANK}}}")
_encoders: dict = {}


def encoder(vocabulary: str):
    """texts -> ids as bytes of uint16: those of Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False)."""
    if vocabulary in _encoders:
        return _encoders[vocabulary]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    ranks_file = Path(vocabulary).with_suffix(".tiktoken")

    def plain(text: str) -> bytes:
        return array("H", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    encode = plain
    if ranks_file.exists():
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.read_bytes().splitlines())}
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> bytes:
            if len(text) >= _LONG_BLANK and _BLANKS.search(text):
                return plain(text)
            if any(t in text for t in special):
                return array("H", fast.encode(text, allowed_special="all")).tobytes()
            return array("H", fast.encode_ordinary(text)).tobytes()

    _encoders[vocabulary] = encode
    return encode


def projection(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each id, and the buckets' directions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, BUCKETS, 1 << 16), rng.standard_normal((BUCKETS, DIMS))


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer cells (rows x dims): undo the curve's turns from the top bit down, then
    Gray-decode and interleave the bits."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(dims):
            turned = (x[:, d] & q) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] = np.where(turned, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, d] ^= swap if d else 0
        q >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    t = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> b) & 1)
    return key


def _tokenise(vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        bucket, directions = projection()
        tail = np.array([end], dtype="<u2").tobytes()
        for batch in slices(batches):
            ids, xs = [], []
            for text in as_texts(batch.column(1)):
                ids.append(encode(text) + tail)
                counts = np.bincount(bucket[np.frombuffer(ids[-1], "<u2")], minlength=BUCKETS)
                xs.append(counts @ directions / np.sqrt(len(ids[-1]) / 2))
            x = np.array(xs).reshape(-1, DIMS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), *(pa.array(x[:, d]) for d in range(DIMS))], names=["doc_id", "ids", *(f"x{d}" for d in range(DIMS))])

    return run


def _keyed(stats: list[tuple[float, float]]):
    """Adds the Hilbert key of the projections' ranks on the normal curve."""
    normal = np.vectorize(lambda z: 0.5 * (1 + erf(z / 1.4142135623730951)), otypes=[float])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([(batch.column(2 + d).to_numpy() - m) / (s or 1.0) for d, (m, s) in enumerate(stats)], axis=1)
            cells = np.minimum((normal(x) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert_key(cells, BITS))], names=["doc_id", "ids", "key"])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition, with the partition's number and the tokens before each row in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = np.array([len(x) // 2 for x in batch.column(1).to_pylist()], dtype=np.int64)
        ends = at + np.cumsum(n)
        if len(n):
            at = int(ends[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(n), part, dtype=np.int64)), pa.array(ends - n), pa.array(n)], names=["doc_id", "ids", "part", "before", "n"])


def _cut(starts, length: int):
    """Sorted rows to pieces, in batches of about _FLUSH ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        ids: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
            ends = np.cumsum([0, *(len(x) for x in ids)]).astype(np.int32)
            values = np.concatenate(ids).view(np.int32) if ids else np.empty(0, np.int32)
            rows.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=[*PIECES, "ids"])

        for batch in batches:
            for doc_id, packed, part, before in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                wide = np.frombuffer(packed, "<u2").astype("<u4")
                n, place, done = len(wide), starts.value[part] + before, 0
                while done < n:
                    seq, offset = divmod(place + done, length)
                    take = min(n - done, length - offset)
                    piece = wide[done : done + take]
                    rows.append((doc_id, done, take, zlib.crc32(piece), n, seq, offset))
                    ids.append(piece)
                    done += take
                    held += take
                    if held >= _FLUSH:
                        yield out()
                        held = 0
        yield out()

    return run


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end: int = 1, rows_per_part: int = 20_000) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (longs) and ids (array<int>)."""
    spark = docs.sparkSession
    bound_batches(spark)
    schema = ", ".join(f"{c} long" for c in PIECES) + ", ids array<int>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = stored(texts.mapInArrow(_tokenise(vocabulary, end), "doc_id long, ids binary, x0 double, x1 double, x2 double"), "tokens", "zstd")
    m = tokens.agg(F.count(F.lit(1)).alias("n"), *(f(f"x{d}").alias(f"{k}{d}") for d in range(DIMS) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not m["n"]:
        return spark.createDataFrame([], schema)
    keyed = tokens.mapInArrow(_keyed([(m[f"m{d}"], m[f"s{d}"]) for d in range(DIMS)]), "doc_id long, ids binary, key long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-m["n"] // rows_per_part))
    ordered = keyed.repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    placed = stored(ordered.mapInArrow(_placed, "doc_id long, ids binary, part long, before long, n long"), "placed", "zstd")
    forget(tokens)
    sums = placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row for each partition
    starts, at = {}, 0
    for r in sums:
        starts[r["part"]] = at
        at += r["n"]
    return placed.select("doc_id", "ids", "part", "before").mapInArrow(_cut(spark.sparkContext.broadcast(starts), length), schema)
