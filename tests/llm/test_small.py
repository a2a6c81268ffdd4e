"""Small cases of the corpus operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import html_text, lm_score, mixing, near_dup, packing, pii, quality_classifier, quality_rules, topk, url_filter

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], DOCS)


def odd_docs(spark):
    long = words(6000, 1)
    return docs(spark, [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, words(80, 2), "en", "b"), (4, words(80, 2), "en", "b"), (5, long, None, "b"), (6, long, "fr", None), (None, words(60, 3), "en", "c"), (7, "one", "de", "c"), (8, "\x00 é 漢字 🙂", "xx", "c")])


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- near duplicates


def brute_components(rows, k, threshold):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and both >= threshold * len(sets[a] | sets[b]) - 1e-12 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def test_near_duplicates_equal_brute_force(spark):
    rows, rng = [], random.Random(4)
    for g in range(12):
        base = words(60, 100 + g).split()
        for c in range(9):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, rows[0][1].upper()), (1001, ""), (1002, None), (1003, "solo"), (1004, "SOLO")]
    for k in (2, 5):
        out = {r["doc_id"]: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, 0.8).collect()}
        assert {i: r["component_id"] for i, r in out.items()} == brute_components(rows, k, 0.8)
        assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())


def test_salted_buckets_and_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "_HOT", 2)
    monkeypatch.setattr(near_dup, "_STAR", 2)
    monkeypatch.setattr(near_dup, "_MOST_BROADCAST", 0)
    monkeypatch.setattr(near_dup, "_BLOCK", 3)
    test_near_duplicates_equal_brute_force(spark)


def test_near_duplicates_odd_rows(spark):
    out = near_dup.near_duplicates(odd_docs(spark).withColumn("band", F.lit(1)), 2, 0.8).collect()
    assert len(out) == 10
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[6]["component_id"] == 5 and not by[6]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    twice = docs(spark, [(1, words(60, 1), "en", "a"), (1, words(60, 2), "en", "a"), (1, words(60, 2), "en", "b"), (2, words(60, 2), "en", "a"), (3, words(60, 3), "en", "a")])
    assert sorted((r["doc_id"], r["text"]) for r in near_dup.keep_one_of_each(twice.withColumn("text_hash", F.lit(1))).collect()) == sorted([(1, words(60, 1)), (1, words(60, 2)), (3, words(60, 3))])
    kept = near_dup.keep_one_of_each(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 8]


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2**63, 300).astype(np.uint64)])
    one = near_dup.superminhash(np.concatenate([a, b, a[:3]]), np.array([900, 900, 3]), 160)
    alone = np.concatenate([near_dup.superminhash(x, np.array([len(x)]), 160) for x in (a, b, a[:3])])
    assert (one == alone).all()  # batches don't change a signature
    assert abs((one[0] == one[1]).mean() - 0.5) < 0.15
    assert all(len(set((row >> np.uint64(32)).tolist())) >= 1 for row in one) and (one < np.iinfo(np.uint64).max).all()


def test_connected_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    out = {r["node"]: r["comp"] for r in near_dup.connected_components(edges).collect()}
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_blocks_of_a_large_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "_BLOCK", 3)
    members = spark.createDataFrame([(1, i, 10, 50) for i in range(10)] + [(2, 1, 1, 5)], "bucket long, cls long, c long, all_n long")
    rows = near_dup._in_blocks(members).collect()
    together = {(r["bucket"], r["block"]): set() for r in rows}
    for r in rows:
        together[r["bucket"], r["block"]].add(r["cls"])
    assert all(any({a, b} <= s for (k, _), s in together.items() if k == 1) for a in range(10) for b in range(10))


# --- personal data


SPANS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = []
    for k, p in enumerate(SPANS):
        for m in re.finditer(p, t):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = (True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), k != 2 or 16 <= len(d) <= 19 and pii._luhn(d), k != 3 or 8 <= len(d) <= 15)
            if all(ok):
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1279.@+-() %_é\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(t):
    assert pii.base_spans(t) == plain_spans(t)


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" + "-" * 200_000, "@" * 100_000):
        pii.base_spans(t)
        pii.loose_spans(t, [])
    many = "+1 555 555 1234, 555-0199-77; " * 20_000
    taken = pii.base_spans(many)
    assert len(taken) == 20_000 and len(pii.loose_spans(many, taken)) == 20_000


def test_contexts_are_whole_words():
    t = "x" * 5000 + " " * 100 + "y" * 70 + " badge" + " " * 500 + "1"
    assert pii.contexts(t, len(t) - 1) == ("badge", "y" * 70 + " badge")
    assert pii.contexts("1", 0) == ("^", "^ ^") and pii.contexts("a 1", 2) == ("a", "^ ^")


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"{words(20, i)} hotline: +1 (555) 555-{1000 + i} {words(10, i + 500)}", "en", "a") for i in range(30)]
    rows += [(100, f"{words(9, 7)} hotline: 555-0199-77 {words(9, 8)}", "en", "a"), (101, "the year 2024-01-02 passed", "en", "a"), (102, None, None, None), (103, "", "en", "a")]
    out = {r["doc_id"]: r for r in pii.digest(pii.find_spans(docs(spark, rows).withColumn("base_spans", F.lit(1)))).collect()}
    at = rows[30][1].index("555-0199")
    assert out[100]["n_added"] == 1 and out[100]["spans"] == f"phone:{at}:{at + 11}" and out[100]["n_phone"] == 0
    assert out[101]["spans"] == "" and out[102]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[3]["n_phone"] == 1 and len(out) == 34
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, rows).withColumn("pii_base_spans", F.lit(1))).collect()}
    assert "[PHONE]" in clean[3] and "555" not in clean[3] and "[PHONE]" in clean[100] and clean[101] == rows[31][1] and clean[102] is None
    assert pii.digest(pii.find_spans(empty(spark))).count() == 0


# --- URLs


def test_url_parts_rules_and_verdicts(spark):
    rows = [(1, "http://WWW.Example.org/es/1?x"), (2, "https://a.example.org/en/12"), (3, "ftp://x.net#f"), (4, None), (5, "no scheme"), (6, "http://org/"), (7, "http://notorg/"), (8, "http://a.com/fr/"), (9, "http://b.com/de/x://y"), (9, "http://b.com/de/x://y"), (10, "http://q.com?x=/fr/")]
    out = [tuple(r)[:5] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))).collect()]
    by = {r[0]: r for r in out}
    assert len(out) == 11 and by[1][1:] == ("www.example.org", "/es/1", "example.org/es/", "block") and by[2][3:] == ("example.org/en/1", "block")
    assert by[3][1:4] == ("x.net", "", None) and by[4][1:4] == ("", "", None) and by[5][1:4] == ("", "", None)
    assert by[6][3] == "org/" and by[7][3] is None and by[8][3:] == ("com/fr/", "allow") and by[9][1:] == ("b.com", "/de/x://y", "com/de/", "block") and by[10][1:4] == ("q.com", "", None)
    assert all(r[4] in ("allow", "block") for r in out)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute_url(url):
    """Host, path and rule by the words of the contract."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule in ("org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"):
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_url_parts_equal_brute_force(spark):
    rng = random.Random(11)
    parts = ["http", "://", "Example", ".", "org", "com", "/", "es/", "en/1", "fr/", "de/", "?", "#", "É", "a", " "]
    urls = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    urls += [f"{rng.choice(['http://', 'x://', ''])}{rng.choice(['', 'a.', 'A.B.'])}{rng.choice(['example.org', 'Example.ORG', 'x.com', 'org', 'com', 'myorg'])}{rng.choice(['/', '/es/', '/es', '/en/12', '/en/2', '/fr/', '/de/?', '#/fr/', ''])}" for _ in range(400)]
    rows = list(enumerate([*urls, None]))
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    verdict = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    assert {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in out} == {i: brute_url(u) for i, u in rows}
    assert all(r["verdict"] == verdict[r["rule"]] for r in out if r["rule"]) and all(r["verdict"] in ("allow", "block") for r in out)


def test_trees_learn_held_out_urls(spark):
    rng = random.Random(2)
    rows = [(i, f"http://{'spam' if i % 2 else 'blog'}{rng.randrange(50)}.{'xyz' if i % 2 else 'info'}/{'9' * rng.randint(5, 20) if i % 2 else 'story'}") for i in range(400)]
    rules = (url_filter.Rule("block", "xyz/9"), url_filter.Rule("allow", "info/s"))
    held = [(1000 + i, f"http://spam{i}.xyz/x{'7' * 15}") for i in range(20)] + [(2000 + i, f"http://blog{i}.info/tale") for i in range(20)]
    out = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows + held, "page_id long, url string"), rules).collect()}
    right = sum(out[i]["verdict"] == ("block" if i < 2000 else "allow") for i, _ in held)
    assert all(out[i]["rule"] is None for i, _ in held) and right >= 36


# --- exact top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(300)] + [(3000, None), (3001, [float("nan")] * 8), (3002, [float("inf")] + [0.0] * 7), (3003, [1.0] * 5), (3100, [2.0] * 5), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    got = sorted(tuple(r) for r in topk.top_k(df, F.pmod("vec_id", F.lit(100)) == 0, shard_rows=400).collect())
    want = []
    for n in (8, 5):
        ok = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v is not None and len(v) == n and np.isfinite(v).all()]
        for i, q in ok:
            if i % 100 == 0:
                best = sorted(((-int(v @ q), j) for j, v in ok if j != i))[:10]
                want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


# --- packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, None), (2, ""), (3, "a  b\n\n c\t"), (4, words(3000, 1)), (5, " lead"), (6, "trail "), (7, "it's 5 o'clock <|endoftext|> é漢🙂"), (8, "a" * 3000), (8, "a" * 3000), (9, "x y")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0)), VOCABULARY).collect()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in rows}
    for i in ids:
        mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids[i]) * (2 if i == 8 else 1)
        for r in mine:
            piece = np.array(ids[i][r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["ids"] == piece.tolist() and r["doc_tokens"] == len(ids[i])
    for s in {r["sequence_id"] for r in out}:
        mine = sorted((r for r in out if r["sequence_id"] == s), key=lambda r: r["offset"])
        assert [r["offset"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1].tolist()] and sum(r["length"] for r in mine) <= 2048
    assert packing.pack(empty(spark), VOCABULARY).count() == 0


_PARTS = ["a", "b", " ", "1", ".", "'", ",", "\n", "\t", "\x0b", "\u00a0", "\u2003", "\x85", "\x1c", "\x00", "\ufffd", "\ud7ff", "\u0301", "é", "!", "🙂", "A", "<|", "endoftext", "|>", "<|endoftext|>", " <|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(_PARTS), max_size=40).map("".join) | st.text(max_size=40).filter(lambda t: t.isprintable() or t.encode("utf-8", "ignore").decode() == t))
def test_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    global _T
    if "_T" not in globals():
        _T = Tokenizer.from_file(VOCABULARY)
    assert np.frombuffer(packing.encoder(VOCABULARY)(text), "<u2").tolist() == _T.encode(text, add_special_tokens=False).ids


def test_special_tokens_and_long_blanks():
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(VOCABULARY), packing.encoder(VOCABULARY)
    assert np.frombuffer(encode("a<|endoftext|>b"), "<u2").tolist() == [64, 50256, 65]
    for text in (" " * 20_001 + "<|endoftext|>x", "y" + "\n" * 30_000):
        assert np.frombuffer(encode(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_runs_of_one_character_are_encoded():
    encode = packing.encoder(VOCABULARY)
    for c, n in ((" ", 500_000), ("\n", 19_999), ("\n", 20_000), ("a", 500_000)):
        ids = np.frombuffer(encode("x" + c * n + "y"), "<u2")
        assert 0 < len(ids) <= n + 2


def test_hilbert_key_is_a_curve():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert_key(cells, 3)
    order = cells[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# --- HTML


PAGE = "<html><body><nav><a>Home</a></nav><div class='ad'>Buy</div>{}<footer>&copy; x</footer></body></html>"


def test_main_text(spark):
    rows = [(i, f"http://h.com/{i}", PAGE.format(f"<article><h1>T {i}</h1><p>Body  of\n <b>page</b> {i} &amp; more</p><div class='comments'><p>me too</p></div></article>")) for i in range(8)]
    rows += [(100 + i, f"http://g.com/{i}", PAGE.format(f"<div id='content'>{'<p>' + words(30, i) + '</p>' + '<p>' + words(20, i + 50) + '</p>'}</div><div class='sidebar'><p>{words(9, 1)}</p></div>")) for i in range(8)]
    rows += [(200, None, None), (201, "", ""), (202, "http://one.net/", "plain <br> text"), (203, "http://h.com/9", "<p>odd"), (204, "x", "<" * 500 + "a='")]
    out = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))).collect()}
    assert out[3]["text"] == "T 3\nBody of page 3 & more" and out[3]["n_chars"] == len(out[3]["text"])
    assert out[102]["text"] == words(30, 2) + "\n" + words(20, 52)
    assert out[200]["text"] == "" and out[201]["text"] == "" and out[202]["text"] == "plain text" and out[203]["text"] == "odd" and len(out) == 21
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    joined = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), most_broadcast=0, most_bytes=0)
    assert {r["page_id"]: r["text"] for r in joined.collect()} == {i: r["text"] for i, r in out.items()}


def plain_page(i: int, notice: bool, extra: str = "") -> tuple[str, str]:
    """A page of nameless divs and its article."""
    heading, one, two = words(4, 900 + i), words(60 if i != 7 else 3, i), words(50 if i != 7 else 3, 500 + i)
    html = f"<body><div><ul><li>Home</li><li>News</li></ul></div>{'<div><p>We use little files</p><p>Fine</p></div>' if notice else ''}<div><h1>{heading}</h1><p>{one}</p><p>{two}</p>{extra}</div><div><p>{words(12, 7000 + i)}</p><p>Ask us</p></div></body>"
    return html, f"{heading}\n{one}\n{two}"


@pytest.mark.parametrize("together", [64, 2])
def test_nameless_parts_are_told_apart_by_the_wrapper(spark, monkeypatch, together):
    monkeypatch.setattr(html_text.host_wrappers, "__defaults__", (together,))
    extra = "<h2 id=search>Search</h2><p class=response>The response was 5 ms.</p><section id=related-work><p>Related</p></section>"
    pages = {i: plain_page(i, i % 3 == 0, extra if i == 5 else "") for i in range(12)}
    df = spark.createDataFrame([(i, f"http://plain.net/{i}", html) for i, (html, _) in pages.items()], "page_id long, url string, html string").repartition(5)
    out = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    want = {i: article + ("\nSearch\nThe response was 5 ms.\nRelated" if i == 5 else "") for i, (_, article) in pages.items()}
    assert out == want
    # Without the other pages of its host, page 7 is read by its longest part, the sidebar.
    alone = html_text.main_text(df.filter("page_id = 7")).first()["text"]
    assert alone != want[7]


def test_wrapper_inference():
    def page(items, note):
        notice = f"<div><p>{note}</p></div>" if note else ""
        return html_text.page_tree(html_text.stream(f"<div><ul><li>Home</li></ul></div>{notice}<div><h1>T</h1>{'<p>x</p>' * items}</div><div><p>side</p></div>"))[0]

    w = html_text.merge(html_text.merge(page(2, ""), page(1, "n")), page(3, ""))
    assert [(x[0], x[3], sorted(k[0] for f in x[2] for k in f[2])) for x in w[2]] == [("div", 3, ["ul"]), ("div", 1, ["p"]), ("div", 3, ["h1", "p"]), ("div", 3, ["p"])]
    # Each part of a page without the notice finds its own place, not that of the notice.
    places = html_text.slots(page(5, ""), w)
    number = {id(x): i for i, x in enumerate(html_text.numbered(w))}
    assert {number[id(w[2][i])] for i in (0, 2, 3)} <= set(places) and number[id(w[2][1])] not in places


def test_region_takes_in_a_title_beside_it_and_no_sidebar():
    root = html_text.page_tree(html_text.stream("<body><div class=t><h1>Title</h1></div><div class=b><p>x</p></div></body>"))[0]
    side = html_text.page_tree(html_text.stream("<body><div class=t><p>Title</p></div><div class=b><p>x</p></div></body>"))[0]
    for tree, want in ((root, "body"), (side, "div.b")):
        nodes = html_text.numbered(tree)
        mass = [{"h1": 20.0, "p": 500.0}.get(x[0], 0.0) for x in nodes]
        if want == "div.b":
            mass[nodes.index(tree[2][0][2][0][2][0][2][0])] = 20.0
        assert nodes[html_text.region(tree, mass, set())][0] == want


def test_repeated_elements_become_a_group():
    def page(n):
        return html_text.page_tree(html_text.stream("".join(f"<section class=post><div><h3>{i}</h3></div></section>" for i in range(n)) + "<div><p>end</p></div>"))[0]

    w = html_text.merge(page(2), page(5))
    assert [(x[0], x[3]) for x in w[2]] == [("section.post", 2), ("section.post", 2), ("div", 2)]


def test_deep_and_wide_pages_keep_their_text():
    import time

    t = time.time()
    root, texts = html_text.page_tree(html_text.stream("<div>" * 10_000 + "deep" + "</x>" * 10_000 + "</div>" * 10_000))
    assert [x for _, x in texts] == ["deep"] and time.time() - t < 2
    wide = html_text.page_tree(html_text.stream("".join(f"<div class=c{'abcdefghij'[i % 10] * (1 + i // 10)}><p>{i}</p></div>" for i in range(3000))))[0]
    assert len(html_text.numbered(html_text.squeeze(html_text.merge(wide, root)))) <= html_text._NODES


# --- language model


def test_scores(spark):
    rows = [(i, words(30, i % 7) + f" rare{i}", "en", "a") for i in range(60)] + [(60, None, None, None), (61, "", "en", "a"), (62, "UPPER upper", "en", "a"), (62, "UPPER upper", "en", "a"), (63, "漢字 🙂" + "z" * 5000, "zz", "a")]
    for share in (200_000, 3):  # nearly all words by broadcast, or nearly all by the join
        out = lm_score.score(docs(spark, rows).withColumn("n", F.lit(0)), PIECES, share).collect()
        assert len(out) == len(rows)
        train = Counter()
        for i, t, *_ in rows:
            if zlib.crc32(str(i).encode()) % 10:
                train.update([*(t or "").lower().split(), " "])
        n, v = sum(train.values()), len(train)
        texts = {i: (t or "") for i, t, *_ in rows}
        for r in out:
            tokens = [*texts[r["doc_id"]].lower().split(), " "]
            assert abs(r["base_score"] - sum(log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)) < 1e-6 * len(tokens) + 1e-6
            assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(train[w] > 0 for w in tokens) and r["train_tokens"] == n
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) and -1e9 < r["score"] < 0
    assert lm_score.score(empty(spark), PIECES).count() == 0


def test_lattice_sums_all_segmentations():
    from itertools import product
    from math import exp, log

    scores = {"▁": log(0.1), "a": log(0.2), "b": log(0.1), "ab": log(0.15), "▁a": log(0.05), "ba": log(0.2), "▁ab": log(0.02)}
    model = lm_score.Lattice(scores, [log(0.001)] * 256, log(0.1))

    def brute(text):
        total = 0.0
        for cuts in product([0, 1], repeat=len(text) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[last:i])
                    last = i
            parts.append(text[last:])
            if all(p in scores for p in parts):
                total += exp(sum(scores[p] for p in parts))
        return log(total)

    for w in ("a", "ab", "abab", "babaab"):
        assert model.word(w.encode()) == pytest.approx(brute("▁" + w), abs=1e-9)
    assert model.word("é".encode()) == pytest.approx(log(0.1) + 2 * log(0.001))


# --- quality rules


def test_base_counts_equal_plain_rules():
    rng = random.Random(5)
    for _ in range(60):
        t = "".join(rng.choice(["a", "b", "é", " ", "\n", "#", "c d", "\t", "a b c "]) for _ in range(rng.randint(0, 80)))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, seen, dup = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        c, cover = Counter(zip(w, w[1:], w[2:])), set()
        for i, x in enumerate(zip(w, w[1:], w[2:])):
            if c[x] > 1:
                cover |= {i, i + 1, i + 2}
        assert quality_rules.base_counts(t.encode()) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover))


def test_quality_rules(spark):
    good = [(i, words(120, i), "en", "a") for i in range(40)]
    bad = [(100, " ".join(f"{w}!!###" for w in words(120, 1).upper().split()), "en", "a"), (101, None, None, None), (102, "", "en", "a"), (103, words(3, 1) * 1, "en", "a"), (104, " ".join([words(3, 1)] * 60), "en", "a")]
    out = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, good + bad).withColumn("kept", F.lit(1))).collect()}
    assert all(out[i]["kept"] for i, *_ in good) and not any(out[i]["kept"] for i in range(100, 105)) and not out[100]["base_failed"] and out[104]["base_failed"]
    assert quality_rules.judge(empty(spark)).count() == 0
    joined = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, good + bad), most_bytes=0).collect()}
    assert joined == out


def test_small_languages_are_judged_by_themselves_at_every_size(spark):
    small = [(i, words(300, i), "xx", "a") for i in range(10)] + [(50, " ".join(w.upper() + "##" for w in words(300, 1).split()), "xx", "a"), (51, words(90, 5).upper(), "yy", "a"), (52, words(90, 5), "", "a"), (53, words(90, 6), None, "a")]
    large = [(1000 + i, " ".join("".join(random.Random(1000 * i + j).choice("klmnopqr") for _ in range(4)) for j in range(200)), "en", "a") for i in range(600)]
    one = {r["doc_id"]: tuple(r)[7:] for r in quality_rules.judge(docs(spark, small)).collect()}
    two = {r["doc_id"]: tuple(r)[7:] for r in quality_rules.judge(docs(spark, small + large)).collect()}
    assert all(two[i] == v for i, v in one.items()) and all(one[i][0] for i in range(10)) and not one[50][0]
    assert all(one[i] == (True, None, None) for i in (51, 52, 53))  # too few words for a reference


def brute_js(p, q):
    from math import log2, sqrt

    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    return sqrt(max(0, sum(a * log2(a / c) for a, c in zip(p, m, strict=True) if a) / 2 + sum(b * log2(b / c) for b, c in zip(q, m, strict=True) if b) / 2))


def test_verdicts_equal_brute_force(spark):
    rows = [(i, words(100 + 40 * (i % 5), i) + (" THE AND" * (i * 3) if i % 4 == 0 else ""), ("en", "fr")[i % 2], "a") for i in range(60)]
    out = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, rows)).collect()}
    for lang in ("en", "fr"):
        mine = [(i, t) for i, t, la, _ in rows if la == lang]
        count = Counter(w for _, t in mine for w in t.split())
        total = sum(count.values())
        common = sorted(w for w in count if 2000 * count[w] >= total)
        bins = [*(count[w] for w in common), total - sum(count[w] for w in common)]
        classes = sum(quality_rules.char_classes(t.encode()) for _, t in mine)
        for i, t in mine:
            n = Counter(t.split())
            w = brute_js([*(n[x] for x in common), sum(n.values()) - sum(n[x] for x in common)], bins)
            c = brute_js(quality_rules.char_classes(t.encode()).tolist(), classes.tolist())
            assert out[i]["word_distance"] == pytest.approx(w, abs=1e-6) and out[i]["char_distance"] == pytest.approx(c, abs=1e-6)
            fits = c <= 0.2 + 2 / len(t) ** 0.5 and w <= 0.3 + 2.6 / len(t.split()) ** 0.5
            assert out[i]["kept"] == (fits and not out[i]["base_failed"])


# --- quality classifier


def test_classifier_held_out_accuracy_and_shrinkage(spark):
    rng, rows, labels = random.Random(6), [], []
    for i in range(400):
        good = i % 3 > 0
        t = words(80, i) if good else " ".join(w + "###" for w in words(80, i).split())
        rows.append((i, t, "en", f"s{rng.randrange(12)}"))
        if i < 200:
            labels += [(i, int(good), 0)]
    rows += [(1000, None, None, None), (1001, "", "en", "s1"), (1002, words(90, 9), None, "unseen"), (5, rows[5][1], "en", rows[5][3])]
    lab = spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(docs(spark, rows), lab).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r["doc_id"] is not None and 200 <= r["doc_id"] < 400]
    assert sum(r["kept"] == (r["doc_id"] % 3 > 0) for r in held) >= 0.97 * len(held)
    rate = (sum(q for _, q, _ in labels) + labels[5][1]) / (len(labels) + 1)  # document 5 comes twice
    unseen = next(r for r in out if r["doc_id"] == 1002)
    assert abs(unseen["site"] - rate) < 1e-9  # a site without labels has the prior
    kept = quality_classifier.keep_good(docs(spark, rows).withColumn("qc", F.lit(1)), lab)
    assert kept.columns == [*docs(spark, rows).columns, "qc"] and kept.count() == sum(r["kept"] for r in out)
    none = quality_classifier.classify(docs(spark, rows), lab.limit(0)).collect()
    assert all(r["kept"] for r in none)
    assert quality_classifier.classify(empty(spark), lab).count() == 0
    many = quality_classifier.keep_good(docs(spark, rows).withColumn("qc_logit", F.lit(1)), lab, most_ids=0)
    assert many.columns[-1] == "qc_logit" and many.count() == kept.count()


def test_posteriors_equal_brute_force(spark):
    rng, rows, labels = random.Random(9), [], []
    for i in range(600):
        s, la = f"s{rng.randrange(6)}", rng.choice(["en", "fr", None])
        good = rng.random() < (0.2 + 0.1 * int(s[1]))
        rows.append((i, words(40, i) + (" ###" * 9 if not good else ""), la, s if i % 50 else None))
        if i % 3:
            labels.append((i, int(good), 0))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_classifier.classify(docs(spark, rows), lab).collect()}
    known = [(rows[i][3], rows[i][2], q) for i, q, _ in labels]
    rate = sum(q for *_, q in known) / len(known)

    def counts(key):
        c = {}
        for r in known:
            n, k = c.get(key(r), (0, 0))
            c[key(r)] = (n + 1, k + r[2])
        return c

    def strength(groups, prior):
        some = [(n, k, prior(g)) for g, (n, k) in groups.items() if n > 1]
        between, chance = sum(n * (k / n - p) ** 2 for n, k, p in some), sum(p * (1 - p) for *_, p in some)
        rho = (between - chance) / (chance / len(some) * (sum(n for n, *_ in some) - len(some)))
        return min(1e6, max(2.0, 1 / rho - 1)) if rho > 1e-6 else 1e6

    hosts, paths = counts(lambda r: r[0]), counts(lambda r: r[:2])
    mh = strength(hosts, lambda g: rate)
    of_host = {h: (hosts.get(h, (0, 0))[1] + mh * rate) / (hosts.get(h, (0, 0))[0] + mh) for h in {r[3] for r in rows}}
    mp = strength(paths, lambda g: of_host[g[0]])
    for i, _, la, s in rows:
        n, k = paths.get((s, la), (0, 0))
        assert out[i]["site"] == pytest.approx((k + mp * of_host[s]) / (n + mp), abs=1e-9)
        assert out[i]["kept"] == (out[i]["good"] >= 0.5)


# --- mixing


def test_quotas():
    t = mixing.quotas({"a": 100, "b": 10, "c": 1000, "d": 50})
    assert t["b"] == 20 and all(t[k] <= 2 * s + 1e-9 for k, s in {"a": 100, "b": 10, "c": 1000, "d": 50}.items()) and abs(sum(t.values()) - 1740) < 1e-6


def test_flow_prefers_cheap_copies():
    out = mixing.route({("a", "b"): 100, ("a",): 50, ("b",): 10}, {"a": 60, "b": 100})
    assert sum(v for (p, s), v in out.items() if s == "a") == 60 and sum(v for (p, s), v in out.items() if s == "b") == 100
    assert sum(v for (p, s), v in out.items() if p == ("a", "b")) == 100  # nothing is taken twice where once is enough


def brute_targets(sizes):
    """Targets by the words of the contract: 5, 2, 1 repeating share 150%; caps of twice the size; the excess goes on by weight."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    target = {s: 1.5 * sum(sizes.values()) * weight[s] / sum(weight.values()) for s in sizes}
    stopped = set()
    while any(target[s] > 2 * sizes[s] + 1e-9 for s in sizes if s not in stopped):
        excess = 0.0
        for s in sizes:
            if s not in stopped and target[s] > 2 * sizes[s] + 1e-9:
                excess += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                stopped.add(s)
        rest = [s for s in sizes if s not in stopped]
        for s in rest:
            target[s] += excess * weight[s] / sum(weight[x] for x in rest)
    return target


def test_flow_costs_least(spark):
    """Against all integer flows of small cases."""
    from itertools import product

    rng = random.Random(3)
    for _ in range(25):
        names = ["a", "b", "c"]
        patterns = {p: rng.randint(0, 3) for p in rng.sample([("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c")], 3)}
        targets = {s: rng.randint(0, 4) for s in names if any(s in p for p in patterns)}
        arcs = [(p, s) for p in patterns for s in p]
        best = None
        for flow in product(*(range(2 * patterns[p] + 1) for p, _ in arcs)):
            out = {p: sum(f for f, (q, _) in zip(flow, arcs, strict=True) if q == p) for p in patterns}
            into = {s: sum(f for f, (_, t) in zip(flow, arcs, strict=True) if t == s) for s in targets}
            if all(out[p] <= 2 * patterns[p] for p in patterns) and all(into[s] <= targets[s] for s in targets):
                key = (-sum(flow), sum(max(0, out[p] - patterns[p]) for p in patterns))
                best = key if best is None or key < best else best
        got = mixing.route(patterns, targets)
        out = {p: sum(f for (q, _), f in got.items() if q == p) for p in patterns}
        assert (-sum(got.values()), sum(max(0, out[p] - patterns[p]) for p in patterns)) == best


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, words(rng.randint(1, 40), i), "en", rng.choice(["a", "b", "c", None, "", "\U0010ffff"])) for i in range(300)] + [(300, None, None, "a"), (301, "", "en", "z"), (5, "again here", "en", "a"), (None, "no id", "en", "a")]
    d = docs(spark, rows)
    narrow = d.select("doc_id", "source", mixing.word_count(F.col("text")).cast("long").alias("size"))
    one, two = (sorted(map(str, mixing.mix_sources(narrow).collect())) for _ in range(2))
    assert one == two and len(one) == len(rows)
    out = mixing.mix_sources(narrow).join(d.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None]
    want = brute_targets({s: sizes[s] for s in names})
    got = Counter()
    for r in mixing.mix_sources(narrow).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        got[r["target"], r["source_size"]] += r["taken"]
    for s in names:
        assert abs(got[want[s], sizes[s]] - want[s]) <= 1, s
    assert out
    assert mixing.mix_sources(narrow.limit(0)).count() == 0
    clash = {"size": F.lit(1), "mix_size": F.lit(2), "pattern": F.lit(3), "hash": F.lit(4), "copy": F.lit(5), "taken": F.lit(6)}
    taken = mixing.take(d.withColumns(clash))
    assert taken.columns == [*d.columns, *clash]
    total = sum(len(r["text"].split()) for r in taken.collect())
    assert abs(total - sum(want.values())) <= len(names)


# --- pipeline


def test_stages_chain_on_small_tables(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, words(120, i) + f" write to u{i}@mail.example.com now", "en", f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s1") for i in range(5)] + [(200 + i, " ".join(w + "###" for w in words(120, i).split()), "en", "s2") for i in range(20)] + [(300, None, None, None), (301, "", "en", "s0")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(200 + i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(d)
        if name != "packing":
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, unique, clean = seen[:3]
    assert good.filter("doc_id between 200 and 299").count() == 0 and good.filter("doc_id < 200").count() == 45
    assert unique.filter("doc_id between 100 and 199").count() == 0 and unique.filter("doc_id < 100").count() == 40
    assert clean.filter(F.col("text").contains("@")).count() == 0 and clean.filter(F.col("text").contains("[EMAIL]")).count() == 40
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1].count()
