"""Merges, their log and its inverse, and decisions on candidates."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.operators import merges

PEOPLE = merges.Entity("people", "id", "name", "aliases", ("city",), "is_person", "notes")
FACTS = merges.Entity("people", "id", "name", "aliases")
CHILDREN = [merges.Child("links", "person", ("link",), ("platform", "identifier")), merges.Child("photos", "ids", ("photo",), array=True), merges.Child("moods", "person", ("mood",))]
REQUESTS = "candidate_id long, keeper_id long, merged_id long, choices map<string,string>, merged_by string, merged_at timestamp"
AT = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "people": spark.createDataFrame(
            [(1, "Ann", ["A"], "Rome", True, None), (2, "Anne", None, "Paris", True, "x"), (3, "Anna", ["A", "Ann", "Nan"], "Oslo", True, ""), (4, "Bob", [], None, True, None), (5, "Bobby", ["Rob"], "Bern", True, None)],
            "id long, name string, aliases array<string>, city string, is_person boolean, notes string",
        ),
        "links": spark.createDataFrame([(1, 1, "mail", "a@x"), (2, 2, "mail", "a@x"), (3, 2, "sms", "5"), (4, 3, "sms", "5"), (5, 3, "sms", None), (6, 4, "mail", "b@x")], "link long, person long, platform string, identifier string"),
        "photos": spark.createDataFrame([(1, [2, 3, 4]), (2, [3, 3]), (3, []), (4, None), (5, [5, 1])], "photo long, ids array<long>"),
        "moods": spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5)], "mood long, person long"),
    }


def requests(spark, rows, days_ago=0):
    return spark.createDataFrame([(c, k, m, choices, "owner", AT - dt.timedelta(days=days_ago)) for c, k, m, choices in rows], REQUESTS)


def rows(df):
    return sorted(map(str, df.collect()))


def undo(spark, tables, log, ids):
    return merges.undo(tables, log, spark.createDataFrame([(i,) for i in ids], "audit_id long"), PEOPLE, CHILDREN, F.lit(AT))


def test_a_run_of_merges(spark, tables):
    out, log, checked = merges.execute(tables, requests(spark, [(10, 1, 2, {"city": "b"}), (11, 1, 3, {"city": "a"}), (12, 4, 5, None)]), PEOPLE, CHILDREN, 1)
    people = {r["id"]: r for r in out["people"].collect()}
    assert people[1]["aliases"] == ["A", "Anna", "Anne", "Nan"] and people[1]["city"] == "Paris" and people[1]["is_person"]
    assert (people[2]["is_person"], people[2]["notes"]) == (False, "x [merged into 1]") and people[4]["aliases"] == ["Bobby", "Rob"] and people[4]["city"] is None
    # The keeper has a@x; of the two rows (sms, 5) that of the earlier audit moves.
    assert sorted((r["link"], r["person"]) for r in out["links"].collect()) == [(1, 1), (3, 1), (5, 1), (6, 4)]
    assert {r["photo"]: r["ids"] for r in out["photos"].collect()} == {1: [1, 1, 4], 2: [1, 1], 3: [], 4: None, 5: [4, 1]}
    assert {r["mood"]: r["person"] for r in out["moods"].collect()} == {1: 1, 2: 1, 3: None, 4: 4}
    assert log.audits.count() == 3 and log.images["links"].count() == 4 and log.images["people"].count() == 6


def test_entities_without_a_flag_are_deleted(spark, tables):
    out, log, _ = merges.execute(tables, requests(spark, [(10, 1, 2, None)]), FACTS, CHILDREN[:1], 1)
    assert sorted(r["id"] for r in out["people"].collect()) == [1, 3, 4, 5]
    back, _, _ = merges.undo(out, log, spark.createDataFrame([(10,)], "audit_id long"), FACTS, CHILDREN[:1], F.lit(AT))
    assert all(rows(back[t]) == rows(tables[t]) for t in ("people", "links"))


def test_requests_that_wait_or_go(spark, tables):
    r = requests(spark, [(1, 1, 1, None), (2, 1, 99, None), (3, 98, 1, None), (4, 2, 3, None), (5, 1, 3, None), (6, 1, 2, None), (7, None, 2, None)])
    out = {x["candidate_id"]: x["reason"] for x in merges.check_requests(r, tables["people"], "id").collect()}
    assert out == {1: "itself", 2: "not_found", 3: "not_found", 4: "chained", 5: "merged_before", 6: None, 7: "not_found"}


@pytest.mark.parametrize("ids", [(10, 11, 12), (12,), (10, 11)])
def test_undo_gives_the_old_rows_back(spark, tables, ids):
    asked = [(10, 1, 2, {"city": "b"}), (11, 1, 3, None), (12, 4, 5, None)]
    out, log, _ = merges.execute(tables, requests(spark, asked), PEOPLE, CHILDREN, 1)
    back, log, status = undo(spark, out, log, ids)
    assert {r["audit_id"]: r["status"] for r in status.collect()} == dict.fromkeys(ids, "undone")
    want, _, _ = merges.execute(tables, requests(spark, [a for a in asked if a[0] not in ids]), PEOPLE, CHILDREN, 1)
    assert all(rows(back[t]) == rows(want[t]) for t in tables)
    assert {r["audit_id"] for r in log.audits.filter("undone_at is not null").collect()} == set(ids)
    again = {r["status"] for r in undo(spark, back, log, ids)[2].collect()}
    assert again == {"undone_before"}


def test_undoing_in_part_is_blocked(spark, tables):
    """One of two merges into a keeper; an early run whose keeper a later run merged; and what hangs on a blocked one."""
    first, log1, _ = merges.execute(tables, requests(spark, [(10, 1, 2, None), (11, 1, 3, None)]), PEOPLE, CHILDREN, 1)
    second, log2, _ = merges.execute(first, requests(spark, [(20, 4, 1, None)]), PEOPLE, CHILDREN, 2)
    third, log3, _ = merges.execute(second, requests(spark, [(30, 5, 4, None)], days_ago=31), PEOPLE, CHILDREN, 3)
    log = merges.joined([log1, log2, log3])

    def status(*ids):
        return {r["audit_id"]: r["status"] for r in undo(spark, third, log, ids)[2].collect()}

    assert status(10) == {10: "blocked"} and status(10, 11) == {10: "blocked", 11: "blocked"}
    assert status(10, 11, 20, 30, 77) == {10: "blocked", 11: "blocked", 20: "blocked", 30: "expired", 77: "not_found"}
    back, _, state = undo(spark, second, merges.joined([log1, log2]), (10, 11, 20))
    assert {r["status"] for r in state.collect()} == {"undone"} and all(rows(back[t]) == rows(tables[t]) for t in tables)


def test_array_elements_that_changed_since_stay(spark, tables):
    out, log, _ = merges.execute(tables, requests(spark, [(12, 4, 5, None)]), PEOPLE, CHILDREN, 1)
    out["photos"] = out["photos"].withColumn("ids", F.when(F.col("photo") == 5, F.array(F.lit(9), F.lit(1))).otherwise(F.col("ids")))
    back, _, _ = undo(spark, out, log, (12,))
    assert {r["photo"]: r["ids"] for r in back["photos"].collect()}[5] == [9, 1]


def test_decisions(spark):
    at = lambda i: AT + dt.timedelta(hours=i)
    c = spark.createDataFrame([(i, "pending", s, None, None) for i, s in ((1, 0), (2, 1), (3, 0), (4, 2), (5, 0), (6, 0), (7, 5))], "candidate_id long, status string, skip_count long, decided_by string, decided_at timestamp")
    said = [(1, "skipped", 1), (1, "skipped", 2), (2, "skipped", 1), (2, "skipped", 2), (3, "merged", 1), (3, "undone", 2), (4, "skipped", 3), (4, "deferred", 5), (5, "skipped", 1), (5, "merged", 2), (5, "skipped", 3), (5, "skipped", 4), (7, "skipped", 1)]
    d = spark.createDataFrame([(i, k, "me", at(h)) for i, k, h in said], "candidate_id long, decision string, by string, at timestamp")
    out = {r["candidate_id"]: (r["status"], r["skip_count"], r["decided_by"], r["decided_at"]) for r in merges.decide(c, d).collect()}
    assert out == {1: ("pending", 2, None, None), 2: ("dismissed", 3, "me", at(2)), 3: ("pending", 0, None, None), 4: ("deferred", 3, "me", at(5)), 5: ("dismissed", 3, "me", at(4)), 6: ("pending", 0, None, None), 7: ("dismissed", 6, "me", at(1))}
    assert merges.decide(c, d.limit(0)).filter("status = 'pending'").count() == 7


def test_links_of_contacts_and_photos(spark):
    links = spark.createDataFrame([(1, "email", "a@x.org", 1.0)], "identity_id long, platform string, identifier string, confidence double")
    contacts = spark.createDataFrame([(7, ["(555) 123-4567", "12 34", None], ["A@x.org", "B@x.org"]), (8, None, None)], "contact_id long, phones array<string>, mails array<string>")
    out = merges.link_contacts(links, contacts, spark.createDataFrame([(7, 1), (8, 1), (9, 1)], "contact_id long, identity_id long"))
    assert sorted(tuple(r)[:3] for r in out.collect()) == [(1, "email", "a@x.org"), (1, "email", "b@x.org"), (1, "phone", "5551234567")]
    photos = spark.createDataFrame([(1, ["Ann", "Bob"], [3]), (2, ["Ann"], None), (3, None, [4]), (4, ["Ann"], [1])], "photo_id long, people array<string>, person_ids array<long>")
    out = merges.link_photos(photos, spark.createDataFrame([("Ann", 1), ("Bob", 2)], "name string, person_id long"))
    assert {r["photo_id"]: r["person_ids"] for r in out.collect()} == {1: [3, 1, 2], 2: [1], 3: [4], 4: [1]}
