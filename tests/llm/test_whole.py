"""Operators do the whole job at every size: cases that caps and samples would miss."""

from __future__ import annotations

import random
from math import floor

from pyspark.sql import functions as F

from tests.llm.test_small import docs, words
from tidewater.llm import html_text, pii, topk, url_filter


def test_two_instances_support_a_pattern_in_a_large_corpus(spark):
    rows = [(i, " ".join(f"mail u{i}x{j}@site.org" for j in range(1000)), "en", "a") for i in range(110)]
    rows += [(1000 + i, f"we read badge: +1 (555) 555-{1000 + i % 2} {words(5, i)}", "en", "a") for i in range(6)]
    rows += [(2000, "we read badge: 555-0199-77 there", "en", "a")]
    out = pii.find_spans(docs(spark, rows)).filter("doc_id = 2000").first()
    assert [(s["kind"], s["start"], s["end"]) for s in out["added_spans"]] == [(3, 15, 26)]


def test_unseen_shapes_behind_and_before_what_seeds_taught(spark):
    rows = [(i, f"{words(20, i)} hotline +1 (555) 555-{1000 + i} extension {words(10, i + 500)}", "en", "a") for i in range(30)]
    rows += [(100 + i, f"{words(9, i)} hotline {t} {words(9, 60 + i)}", "en", "a") for i, t in enumerate(("0171/23_45-67", "(AB12~3456~78x)", "1234", "abcdef"))]
    rows += [(110, f"{words(9, 7)} 0049/30/1234567 extension {words(9, 8)}", "en", "a"), (111, f"{words(9, 9)} 0049/30/1234567 zzz {words(9, 10)}", "en", "a")]
    # What is found teaches in turn: twice behind 'pager', which no seed is behind.
    rows += [(120 + i, f"{words(9, i)} pager {t} {words(9, 90 + i)}", "en", "a") for i, t in enumerate(("0171/23_45-67", "0049/30/1234567", "0171/23_45-67", "0049/30/1234567", "77~88~99~0"))]
    for n in (100_000, 0):
        out = {r["doc_id"]: r["added_spans"] for r in pii.find_spans(docs(spark, rows), most_broadcast=n).collect()}
        texts = {i: t for i, t, _, _ in rows}
        got = {i: [(s["kind"], texts[i][s["start"] : s["end"]]) for s in spans] for i, spans in out.items() if spans}
        assert got == {100: [(3, "0171/23_45-67")], 101: [(3, "AB12~3456~78x")], 110: [(3, "0049/30/1234567")], **{120 + i: [(3, t)] for i, t in enumerate(("0171/23_45-67", "0049/30/1234567", "0171/23_45-67", "0049/30/1234567", "77~88~99~0"))}}


def test_strings_of_any_shape():
    t = 'id="12-34-56", x=1234567890abcdef (99/88/77). 12:30:45 ' + "a" * 300 + "1234567 " + "7" * 65
    assert [t[s:e] for s, e in pii.any_shapes(t, [])] == ["12-34-56", "1234567890abcdef", "99/88/77"]
    assert pii.any_shapes(t, [(3, 0, len(t))]) == []
    for long in ("1/" * 100_000, "a" * 400_000, "a1 " * 100_000, "=" * 300_000):
        pii.candidates(long, [])


def test_joined_patterns_equal_broadcast_ones(spark):
    rows = [(i, f"{words(20, i)} hotline: +1 (555) 555-{1000 + i} {words(10, i + 500)}", "en", "a") for i in range(30)]
    rows += [(100 + i, f"{words(9, 7)} hotline: 555-0199-77 {words(9, 8)} hotline: 555-0199-78", "en", "a") for i in (0, 0, 1)] + [(102, None, None, None), (103, "", "en", "a")]
    few, many = (sorted(map(str, pii.digest(pii.find_spans(docs(spark, rows), most_broadcast=n)).collect())) for n in (100_000, 0))
    assert few == many and sum("n_added=2" in r for r in few) == 3
    few, many = (sorted(map(str, pii.redact(docs(spark, rows), most_broadcast=n).collect())) for n in (100_000, 0))
    assert few == many


def test_sampled_urls_bound_the_training_only(spark):
    rules = (url_filter.Rule("allow", "info/"), url_filter.Rule("block", "xyz/bad"))
    rows = [(i, f"http://b{i % 40}.info/story{i}") for i in range(3000)] + [(5000 + i, f"http://s{i}.xyz/bad{i}") for i in range(6)] + [(6000, "http://s.xyz/else"), (6001, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = {r["page_id"]: r for r in url_filter.judge(pages, rules, most_labelled=60).collect()}
    assert len(out) == len(rows) and out[6000]["score"] is not None and out[6000]["rule"] is None
    joined = {r["page_id"]: r["score"] for r in url_filter.judge(pages, rules, most_labelled=60, most_broadcast=0).collect()}
    assert joined == {i: r["score"] for i, r in out.items()}


def test_suffix_statistics_cover_all_labelled_urls(spark, monkeypatch):
    kept = {}
    plain = url_filter.stored
    monkeypatch.setattr(url_filter, "stored", lambda df, name: kept.setdefault(name, plain(df, name)))
    rows = [(i, f"http://b{i}.{'info' if i % 2 else 'xyz'}/") for i in range(2000)]
    url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), (url_filter.Rule("allow", "info/"), url_filter.Rule("block", "xyz/")), most_labelled=50)
    assert kept["suffix1"].count() == 2 and kept["suffix2"].count() == 2000 and kept["labelled"].count() <= 50


PAGES = "page_id long, url string, html string"


def test_one_off_blocks_stay_and_boilerplate_goes(spark):
    def page(host: str, i: int, extra: str = "") -> tuple:
        return i, f"http://{host}/{i}", f"<body><div class=box><p class=imprint>Printed with care by us</p>{extra}<p>{words(60, i)}</p><p>{words(50, 500 + i)}</p></div></body>"

    once = "<h2>Only here</h2><blockquote>A single quote of this page</blockquote>"
    rows = [page("large.net", i, once if i == 3 else "") for i in range(8)] + [page("small.net", 100 + i) for i in range(4)] + [page("pair.net", 200 + i) for i in range(2)]
    out = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert out[3] == f"Only here\nA single quote of this page\n{words(60, 3)}\n{words(50, 503)}"
    assert out[100] == f"{words(60, 100)}\n{words(50, 600)}" and out[200] == f"{words(60, 200)}\n{words(50, 700)}"
    joined = html_text.main_text(spark.createDataFrame(rows, PAGES), most_broadcast=0, most_bytes=0)
    assert {r["page_id"]: r["text"] for r in joined.collect()} == out


def test_many_templates_hide_no_boilerplate(spark):
    """The first page alone has 1,200 nodes; the others' template comes after it."""
    names = ["".join("abcdefghij"[int(d)] for d in str(k)) for k in range(1000, 1400)]
    rows = [(0, "http://many.net/0", "<body>" + "".join(f"<div class={n}>{n} text</div>" for n in names) + "</body>")]
    rows += [(i, f"http://many.net/{i}", f"<body><section class=story><p class=imprint>Printed with care by us</p><p>{words(2000, i)}</p></section></body>") for i in range(1, 7)]
    out = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, PAGES).coalesce(1)).collect()}
    assert all(out[i] == words(2000, i) for i in range(1, 7)) and len(out[0].splitlines()) == 400


def test_scores_are_exact_beyond_doubles(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice((1, 6, 7)) for _ in range(4)]) for i in range(400)]
    rows += [(400 + i, [3e38 * (-1) ** i, 1.0, 2.0, 3.0]) for i in range(4)] + [(500, [0.0, -0.0, 1e-300, 0.5]), (501, [float("inf"), 0.0, 0.0, 0.0]), (502, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out: dict = {}
    for r in topk.top_k(vectors, F.col("vec_id") % 20 == 0, 10, shard_rows=90, block=7).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = {i: [min(max(floor(1024 * x), -(2**63)), 2**63 - 1) for x in v] for i, v in rows if i < 501}
    # What a double holds of a component, as the contract takes components for doubles.
    whole = {i: [int(float(x)) for x in v] for i, v in whole.items()}
    for q in (i for i in whole if i % 20 == 0):
        scores = {i: min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), -(2**63)), 2**63 - 1) for i, v in whole.items() if i != q}
        assert out.pop(q) == sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert not out
