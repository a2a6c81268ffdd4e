"""What facts tell about entities: hints from their keys and values, and names that become more complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import folds, markers

# Ends of keys that name a person's or a place's aspect, and topics of domains.
PERSON_ENDS = (
    "relationship career preferences family health personality interests communication background lifestyle hobbies music food travel education pets vehicles home workplace birthday age gender location occupation role contact phone email nickname status notes about context dynamic history frequency pattern topics sentiment morning evening weekend weekday"
).split()
PLACE_ENDS = "trips travel visits home work office".split()
TOPICS = {"career": "Career & Work", "health": "Health & Fitness", "interests": "Interests & Hobbies", "lifestyle": "Lifestyle", "preferences": "Preferences", "events": "Life Events", "travel": "Travel"}


def _title(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))), " ")


def person_of_key(key: Column) -> Column:
    """jane_smith_career gives Jane Smith: up to four parts of two letters or more, without an aspect's name and a number at the end; else null."""
    bare = F.regexp_replace(F.regexp_replace(key, f"_({'|'.join(PERSON_ENDS)})$", ""), r"_[0-9]+$", "")
    parts = F.filter(F.split(bare, "_"), lambda p: p != "")
    named = F.forall(parts, lambda p: p.rlike("^[a-zA-Z]{2,}$"))
    return F.when(F.size(parts).between(1, 4) & named, _title(parts))


def place_of_key(key: Column) -> Column:
    """new_york_trips gives New York: up to three parts."""
    parts = F.filter(F.split(F.regexp_replace(key, f"_({'|'.join(PLACE_ENDS)})$", ""), "_"), lambda p: p != "")
    return F.when(F.size(parts).between(1, 3), _title(parts))


def _normal(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")


def hints(facts: DataFrame, contacts: DataFrame) -> DataFrame:
    """fact_id, name, type, role, contact_id: entities that facts (fact_id, domain, key, value) speak of.

    A person named by the key is the first contact (contact_id, name) of that whole name, or whose name begins with it; contacts
    whose names the value holds are objects, but for the one the key names. Both are equi-joins: contacts go by every
    beginning of their name, values meet names through an inverted table. Keys of places and events give places, domains topics.
    """
    person = facts.filter(F.col("domain").isin("people", "communication"))
    named = person.select("fact_id", person_of_key(F.col("key")).alias("said")).filter("said is not null")
    words = F.split(_normal(F.col("name")), " ")
    begins = contacts.select("contact_id", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))).alias("begin"))
    first = begins.groupBy("begin").agg(F.min(F.struct("contact_id", "name")).alias("c"))
    subjects = named.join(first, _normal(F.col("said")) == F.col("begin"), "left").select("fact_id", F.coalesce("c.name", "said").alias("name"), F.lit("person").alias("type"), F.lit("subject").alias("role"), F.col("c.contact_id").alias("contact_id"))
    texts = person.select("fact_id", F.lower("value").alias("text"))
    held = markers.held_in(texts, "text", contacts, "name").withColumnRenamed("name", "low")
    found = texts.join(held, "text").join(contacts.withColumn("low", F.lower("name")), "low").join(named, "fact_id", "left")
    objects = found.filter(F.col("said").isNull() | (_normal(F.col("name")) != _normal(F.col("said")))).select("fact_id", "name", F.lit("person").alias("type"), F.lit("object").alias("role"), "contact_id")
    none = F.lit(None).cast(contacts.schema["contact_id"].dataType).alias("contact_id")
    places = facts.filter(F.col("domain").isin("places", "events")).select("fact_id", place_of_key(F.col("key")).alias("name"), F.lit("place").alias("type"), F.lit("location").alias("role"), none)
    topic = F.element_at(F.create_map(*[F.lit(x) for kv in TOPICS.items() for x in kv]), F.col("domain"))
    topics = facts.filter(F.col("domain").isin(*TOPICS)).select("fact_id", topic.alias("name"), F.lit("topic").alias("type"), F.lit("topic").alias("role"), none)
    return subjects.union(objects).union(places.filter("name is not null")).union(topics)


def complete_names(entities: DataFrame, seen: DataFrame) -> DataFrame:
    """entity_id, name: each entity's name after the names (entity_id, at, id, name) seen of it, in order: one with more parts that holds the present one, case and blanks aside, takes its place. Entities never seen keep theirs."""

    def step(state: tuple, r) -> tuple[tuple, list[tuple]]:
        name = state[0] if state[0] is not None else r.name
        if r.kind and r.name is not None:
            new = " ".join(r.name.split())
            if len(new.split()) > len((name or "").split()) and " ".join((name or "").lower().split()) in new.lower():
                name = r.name.strip()
        return (name,), []

    first = entities.select("entity_id", F.lit(0).alias("kind"), F.lit(None).cast(seen.schema["at"].dataType).alias("at"), F.lit(None).cast("long").alias("id"), "name")
    rows = first.unionByName(seen.select("entity_id", F.lit(1).alias("kind"), "at", F.col("id").cast("long").alias("id"), "name").join(entities.select("entity_id"), "entity_id", "left_semi"))
    return folds.fold(rows, ["entity_id"], ["kind", "at", "id"], lambda: (None,), step, f"entity_id {entities.schema['entity_id'].dataType.simpleString()}, name string", lambda key, state: [(*key, state[0])])
