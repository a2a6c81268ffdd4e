"""The corpus queries over the smallest test tables against SQL or brute force."""

from __future__ import annotations

import os
import re
from html import unescape

import duckdb
import pytest

from tidewater.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def rows_of(query: str):
    return duckdb.sql(f"select * from ({query})").fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.oracle_sql()[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    got = queries.queries()[name](spark, SF).toArrow()
    cols = sorted(want.column_names)
    assert cols == sorted(got.column_names)
    one, two = (sorted(zip(*(t.column(c).to_pylist() for c in cols), strict=True)) for t in (want, got))
    assert one == two


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries()) == list(range(1, 14))


def test_articles(spark):
    """The test pages keep their text in one article of unclosed tags."""
    pages = dict(rows_of(f"select page_id, html from read_parquet('{SF}/pages.parquet')"))
    for r in queries.op5_html_text(spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        inner = re.sub("<br>", " ", re.sub("</?b>", "", inner))
        blocks = [re.sub(r"\s+", " ", unescape(b)).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("name", ["op7_quality_rules", "op9_quality_classifier"])
def test_good_documents_stay_and_most_junk_goes(spark, name):
    sf = SF.replace("0.001", "0.01")
    out = {r["doc_id"]: r for r in queries.queries()[name](spark, sf).collect()}
    labels = rows_of(f"select doc_id, quality from read_parquet('{sf}/labels.parquet')")
    good = [out[d] for d, q in labels if q == 1 and not (name == "op7_quality_rules" and out[d]["base_failed"])]
    junk = [out[d] for d, q in labels if q == 0]
    assert sum(r["kept"] for r in good) >= 0.995 * len(good) and sum(r["kept"] for r in junk) <= 0.1 * len(junk)
