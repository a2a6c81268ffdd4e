"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import html_text, lm_score, mixing, near_dup, packing, periodic_runs, pii, quality_classifier, quality_rules, simhash, topk, turn_repair, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, threshold=0.8)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the documents' source column; sizes are words."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).cast("long").alias("size"))
    return mixing.mix_sources(docs)


def _planted(text: Column, key: Column) -> Column:
    """Words of text; of every tenth document by the CRC of its key, the words from some word on repeat with some period."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    n, g = F.size(words).cast("long"), F.floor(F.crc32(key) / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    root = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    rest = F.slice(F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    planted = F.concat(F.slice(words, F.lit(1), a.cast("int")), rest)
    return F.when((F.pmod(F.crc32(key), F.lit(10)) == 0) & (n > 0), F.array_join(planted, " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = periodic_runs.periodic_runs(docs.select("doc_id", _planted(F.col("text"), F.col("doc_id").cast("string")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by the CRC of conversation and turn: dropped, emptied, without marks of a sentence's end, twice, or as the user's."""
    key = F.concat(*(F.coalesce(c, F.lit(" ")) for c in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))))
    fault, role, text = F.pmod(F.crc32(key), F.lit(20)), F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.filter(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return turn_repair.digest(turn_repair.repair(_damaged(turns)), turns)


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_table(spark, sf_dir, "documents"), shingle_words=3, most_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""

_NEAR_DUP = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept FROM w JOIN m ON m.d = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""


#: CRC-32 of an ASCII text as DuckDB has none: a byte at a time, eight shifts a byte.
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))"""

#: Runs of a period up to 8 show at every distance tried; of a longer period q, at the distance q of equal 8-word windows.
_RUNS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, xor({_CRC.format("CAST(doc_id AS VARCHAR)")}, 4294967295) AS h FROM documents),
g AS (SELECT *, len(ws) AS n, h // 10 AS g, (h // 10) % greatest(len(ws), 1) AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE ws END AS ws FROM p),
t AS (SELECT doc_id, n, i, ws[i + 1] AS w, hash(ws[i + 1 : i + 8]) AS eight, i + 8 <= n AS whole FROM (SELECT *, unnest(range(n)) AS i FROM w)),
q AS (SELECT doc_id, q FROM (SELECT doc_id, n, unnest(range(1, 9)) AS q FROM w) WHERE 4 * q <= n
  UNION SELECT x.doc_id, y.i - x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.eight = y.eight AND x.whole AND y.whole AND y.i - x.i > 8 AND 4 * (y.i - x.i) <= x.n),
m AS (SELECT q.doc_id, q.q, x.i, x.i - row_number() OVER (PARTITION BY q.doc_id, q.q ORDER BY x.i) AS island FROM q JOIN t x ON x.doc_id = q.doc_id JOIN t y ON y.doc_id = q.doc_id AND y.i = x.i + q.q AND y.w = x.w),
r AS (SELECT doc_id, start, length, min(q) AS period FROM (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM m GROUP BY doc_id, q, island) WHERE length >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
s AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs, arg_min(struct_pack(start := start, length := length, period := period), struct_pack(e := -CAST(length AS DOUBLE) / period, start := start, period := period)) AS best FROM r GROUP BY 1),
k AS (SELECT t.doc_id, string_agg(t.w, ' ' ORDER BY t.i) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY 1)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id"""


_KEEP = "CASE WHEN fault IN ('blank', 'duplicate') OR NOT {test} THEN {never} ELSE struct_pack(c := {cost} + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END + f.{to}.c, a := '{edit}' || f.{to}.a, t := chr(10) || {role} || ':' || text || f.{to}.t) END"
_NEVER = "struct_pack(c := CAST(1000000000 AS BIGINT), a := '', t := '')"


def _stay(state: str) -> str:
    """What a turn costs, with all that follows, from a state (the last role, or n for none) if nothing is inserted before it: least of Keep, Rerole, Delete."""
    to = "a" if state == "u" else "u"
    rerole = _KEEP.format(test="true", never=_NEVER, cost=1, to=to, edit="R", role="'assistant'" if to == "a" else "'user'")
    keep = _KEEP.format(test=f"role[1] = '{to}'", never=_NEVER, cost=0, to=to, edit="K", role="role")
    first = _KEEP.format(test="role[1] = 's'" if state == "n" else "false", never=_NEVER, cost=0, to="s", edit="K", role="role")
    return f"list_sort([{rerole}, {keep}, {first}, struct_pack(c := 2 + f.{state}.c, a := 'D' || f.{state}.a, t := f.{state}.t)])[1]"


def _inserted(state: str) -> str:
    """The same with up to two insertions before it."""
    one = "a" if state == "u" else "u"
    two = "a" if one == "u" else "u"
    line = {"u": "chr(10) || 'user:'", "a": "chr(10) || 'assistant:'"}
    i = f"struct_pack(c := 5 + g.{one}.c, a := 'I' || g.{one}.a, t := {line[one]} || g.{one}.t)"
    ii = f"struct_pack(c := 10 + g.{two}.c, a := 'II' || g.{two}.a, t := {line[one]} || {line[two]} || g.{two}.t)"
    return f"{state} := list_sort([g.{state}, {i}, {ii}])[1]"


_ENDS = {"n": (0, "", "''"), "s": (10, "II", "chr(10) || 'user:' || chr(10) || 'assistant:'"), "u": (5, "I", "chr(10) || 'assistant:'"), "a": (0, "", "''")}
_REPAIR = f"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC.format("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")}, 4294967295) % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair, i > 1 AS later, count(*) OVER (PARTITION BY conv_id) AS m FROM o),
e AS (SELECT conv_id, m + 1 AS i, struct_pack({", ".join(f"{q} := struct_pack(c := CAST({c} AS BIGINT), a := '{a}', t := {t})" for q, (c, a, t) in _ENDS.items())}) AS f FROM (SELECT DISTINCT conv_id, m FROM r)
  UNION ALL SELECT conv_id, i, struct_pack({", ".join(map(_inserted, "nsua"))}) FROM (SELECT e.conv_id, r.i, struct_pack({", ".join(f"{q} := {_stay(q)}" for q in "nsua")}) AS g FROM e JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i - 1)),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (later AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1)
SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, coalesce(e.f.n.c, 0) AS cost, coalesce(e.f.n.a, '') AS audit, sha256(coalesce(substr(e.f.n.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.i = 1"""


def oracle_sql() -> dict[str, str]:
    """SQL for those whose results are exact joins, islands or paths; fitted models, hashes of 64 bits and tokenizers are beyond it."""
    return {"op3_exact_top_k": _TOP_K, "op8_minhash_near_dedup": _NEAR_DUP, "op11_periodic_runs": _RUNS, "op12_turn_repair": _REPAIR}
