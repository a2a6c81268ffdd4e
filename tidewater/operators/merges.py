"""Merges of entities with a log from which they can be undone, and what happens to candidates that aren't merged.

A merge moves what refers to one entity to another, takes over aliases and chosen fields, and retires or deletes the entity.
All requests of a run are carried out together, as joins: tables stay distributed, and no request is looked at alone. For
every row that a merge touches, the log holds the row as it was before the run (its before-image), by audit id; of an array the
element. Undoing is the inverse join: touched rows go, their images come back.

A run's merges can share rows (two entities merged into one keeper, whose row both change). Their images all show the state before the run, so such merges
are undone together or not at all, and a merge of a later run that touched one of the rows has to be undone with them too.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.session import ensure_checkpoint_dir

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Entity:
    """Table of the entities: key, name, and an array of aliases; fields that a request may choose. Retired ones have `flag` false and a remark in `notes`; without a flag they are deleted."""

    table: str
    id: str
    name: str
    aliases: str
    fields: tuple[str, ...] = ()
    flag: str | None = None
    notes: str | None = None


@dataclass(frozen=True)
class Child:
    """Table whose `column` refers to entities, with the key of its rows. unique: values that an entity has once, so that a row whose values the keeper has goes. array: column is an array of ids."""

    table: str
    column: str
    key: tuple[str, ...]
    unique: tuple[str, ...] = ()
    array: bool = False


@dataclass(frozen=True)
class Log:
    """audits: audit_id, run, keeper_id, merged_id, merged_by, merged_at, undone_at; images: by table, audit_id and the row as it was, or of arrays
    the key, the place, and the id before and after."""

    audits: DataFrame
    images: Tables


def _cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def check_requests(requests: DataFrame, entities: DataFrame, id_: str) -> DataFrame:
    """requests with `reason`: null, or why a request isn't carried out in this run: itself (keeper and merged are one), not_found,
    merged_before (an earlier candidate merges the same entity), chained (the keeper is merged itself in this run: its turn is the next run)."""
    known = entities.select(F.col(id_).alias("known")).distinct()
    r = requests
    for side in ("keeper", "merged"):
        r = r.join(known.select(F.col("known").alias(f"{side}_id"), F.lit(True).alias(f"_{side}")), f"{side}_id", "left")
    r = r.withColumn("reason", F.when(F.col("keeper_id") == F.col("merged_id"), "itself").when(F.col("_keeper").isNull() | F.col("_merged").isNull(), "not_found")).drop("_keeper", "_merged")
    first = r.filter("reason is null").groupBy("merged_id").agg(F.min("candidate_id").alias("_first"))
    r = r.join(first, "merged_id", "left")
    r = r.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("candidate_id") != F.col("_first")), "merged_before").otherwise(F.col("reason")))
    gone = first.select(F.col("merged_id").alias("keeper_id"), F.lit(True).alias("_gone"))
    r = r.join(gone, "keeper_id", "left")
    return r.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_gone"), "chained").otherwise(F.col("reason"))).drop("_first", "_gone")


def _merge_entities(e: DataFrame, entity: Entity, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entity table after the merges, and its images."""
    cols, id_ = e.columns, entity.id
    as_merged = merges.select(F.col("merged_id").alias(id_), "keeper_id", "audit_id", "choices")
    as_keeper = merges.select(F.col("keeper_id").alias(id_), "audit_id")
    images = e.join(as_merged.select(id_, "audit_id"), id_).unionByName(e.join(as_keeper, id_)).select("audit_id", *cols)

    taken = [F.max(F.when(F.col("choices")[f] == "b", F.struct("audit_id", F.col(f).alias("value")))).alias(f"_{f}") for f in entity.fields]
    names = F.concat(F.coalesce(entity.aliases, F.array().cast("array<string>")), F.array(entity.name))
    gained = e.join(as_merged, id_).groupBy(F.col("keeper_id").alias(id_)).agg(F.flatten(F.collect_set(names)).alias("_gained"), *taken)
    out = e.join(gained, id_, "left").join(as_merged.select(id_, F.col("keeper_id").alias("_into")), id_, "left")
    aliases = F.array_sort(F.array_except(F.array_union(F.coalesce(entity.aliases, F.array().cast("array<string>")), F.col("_gained")), F.array(entity.name)))
    new = {entity.aliases: F.when(F.col("_gained").isNotNull(), aliases).otherwise(F.col(entity.aliases))}
    new |= {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value")).otherwise(F.col(f)) for f in entity.fields}
    if entity.flag is None:
        out = out.filter("_into is null")
    else:
        new[entity.flag] = F.when(F.col("_into").isNotNull(), False).otherwise(F.col(entity.flag))
        if entity.notes:
            remark = F.concat(F.coalesce(entity.notes, F.lit("")), F.lit(" [merged into "), F.col("_into").cast("string"), F.lit("]"))
            new[entity.notes] = F.when(F.col("_into").isNotNull(), remark).otherwise(F.col(entity.notes))
    return out.select(*(new[c].alias(c) if c in new else c for c in cols)), images


def _put(c: DataFrame, child: Child, ids: DataFrame) -> DataFrame:
    """c with the ids (key, _at, _id) at their places of its arrays; with _was, only where that stands there. Rows without one stay as they are.

    The ids of a row come to it as a list, which is laid between the elements by place: arrays are neither taken apart nor moved.
    """
    given = F.struct("_at", F.lit(0).alias("_k"), "_id", *(["_was"] if "_was" in ids.columns else []))
    now = ids.repartition(*child.key).groupBy(*child.key).agg(F.collect_list(given).alias("_now"))
    element = ids.schema["_id"].dataType

    def held(x: Column, i: Column) -> Column:
        none = [F.lit(None).cast(element).alias("_was")] if "_was" in ids.columns else []
        return F.struct(i.alias("_at"), F.lit(1).alias("_k"), x.alias("_id"), *none)

    def chosen(x: Column, i: Column) -> Column:
        p = F.get("_slots", i - 1)
        hit = (x["_k"] == 1) & (p["_k"] == 0) & (p["_at"] == x["_at"])
        if "_was" in ids.columns:
            hit &= p["_was"] == x["_id"]
        return F.struct(x["_k"].alias("_k"), F.when(hit, p["_id"]).otherwise(x["_id"]).alias("_id"))

    out = c.join(now, list(child.key), "left").withColumn("_slots", F.array_sort(F.concat(F.transform(child.column, held), "_now")))
    new = F.transform(F.filter(F.transform("_slots", chosen), lambda x: x["_k"] == 1), lambda x: x["_id"])
    return out.withColumn(child.column, F.when(F.col("_slots").isNotNull(), new).otherwise(F.col(child.column))).select(c.columns)


def _merge_child(c: DataFrame, child: Child, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A child table after the merges, and its images."""
    cols = c.columns
    if child.array:
        seen = c.select(*child.key, F.posexplode(child.column).alias("_at", "_old"))
        images = seen.join(merges.select(F.col("merged_id").alias("_old"), F.col("keeper_id").alias("_new"), "audit_id"), "_old").select("audit_id", *child.key, "_at", "_old", "_new")
        return _put(c, child, images.select(*child.key, "_at", F.col("_new").alias("_id"))), images
    moving = c.join(merges.select(F.col("merged_id").alias(child.column), F.col("keeper_id").alias("_to"), "audit_id"), child.column)
    images = moving.select("audit_id", *cols)
    if not child.unique:
        to = merges.select(F.col("merged_id").alias(child.column), F.col("keeper_id").alias("_to"))
        return c.join(to, child.column, "left").withColumn(child.column, F.coalesce("_to", child.column)).select(cols), images
    # Of rows with the same values one stays: the keeper's own, else the one of the earliest audit.
    held = c.select(F.col(child.column).alias("_to"), *(F.col(u).alias(f"_{u}") for u in child.unique)).distinct()
    same = reduce(Column.__and__, (F.col(f"m.{u}").eqNullSafe(F.col(f"h._{u}")) for u in child.unique), F.col("m._to") == F.col("h._to"))
    free = moving.alias("m").join(held.alias("h"), same, "left_anti")
    first = free.groupBy("_to", *child.unique).agg(F.min_by(F.struct(*cols), F.struct("audit_id", *child.key)).alias("_row")).select("_to", "_row.*")
    moved = first.withColumn(child.column, F.col("_to")).select(cols)
    stay = c.join(merges.select(F.col("merged_id").alias(child.column)), child.column, "left_anti")
    return stay.select(cols).unionByName(moved), images


def execute(tables: Tables, requests: DataFrame, entity: Entity, children: list[Child], run: int) -> tuple[Tables, Log, DataFrame]:
    """Tables after the merges of a run, the run's log, and the requests with what became of them.

    requests: candidate_id, keeper_id, merged_id, choices (map of field to 'b' for the merged one's value; of several, the last candidate's counts), merged_by, merged_at.
    run: a number above those of earlier runs. The audit id is the candidate's.
    """
    checked = _cut(check_requests(requests, tables[entity.table], entity.id))
    merges = checked.filter("reason is null").withColumn("audit_id", F.col("candidate_id"))
    out, images = dict(tables), {}
    out[entity.table], images[entity.table] = _merge_entities(tables[entity.table], entity, merges)
    for child in children:
        out[child.table], images[child.table] = _merge_child(tables[child.table], child, merges)
    audits = merges.select("audit_id", F.lit(run).alias("run"), "keeper_id", "merged_id", "merged_by", "merged_at", F.lit(None).cast("timestamp").alias("undone_at"))
    return out, Log(audits, images), checked


def joined(logs: list[Log]) -> Log:
    """The logs of several runs as one."""
    images = {t: reduce(DataFrame.unionByName, [x.images[t] for x in logs]) for t in logs[0].images}
    return Log(reduce(DataFrame.unionByName, [x.audits for x in logs]), images)


def _places(entity: Entity, children: list[Child]) -> dict[str, tuple[str, ...]]:
    """What identifies an image in each table."""
    return {entity.table: (entity.id,)} | {c.table: (*c.key, "_at") if c.array else c.key for c in children}


def _one_run(log: Log) -> bool:
    """Whether all merges of the log are of one run. In a run an entity is merged once, so a child's row or an element, which refers to one entity, is touched once."""
    first, last = log.audits.agg(F.min("run"), F.max("run")).first()
    return first == last


def _shared(log: Log, places: dict[str, tuple[str, ...]]) -> DataFrame:
    """audit_id, place, row: the images, in the tables of places, of rows that more than one merge touched."""
    out = []
    for t in places:
        key, images = list(places[t]), log.images[t].select("audit_id", *places[t])
        several = images.groupBy(*key).agg(F.min("audit_id").alias("_lo"), F.max("audit_id").alias("_hi")).filter("_lo != _hi").select(*key)
        same = reduce(Column.__and__, (F.col(f"i.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key))
        out.append(images.alias("i").join(several.alias("s"), same, "left_semi").select("audit_id", F.lit(t).alias("place"), F.to_json(F.struct(*key)).alias("row")))
    return reduce(DataFrame.unionByName, out).distinct()


def undo_status(log: Log, wanted: DataFrame, entity: Entity, children: list[Child], as_of: Column, days: int = 30) -> DataFrame:
    """audit_id, status of each wanted undoing: not_found, undone_before, expired (merged over `days` ago), blocked (another merge of the
    same or a later run touched one of its rows and isn't undone as well), or undone."""
    a = wanted.select("audit_id").distinct().join(log.audits, "audit_id", "left")
    late = F.col("merged_at") < as_of - F.make_dt_interval(F.lit(days))
    a = a.withColumn("status", F.when(F.col("run").isNull(), "not_found").when(F.col("undone_at").isNotNull(), "undone_before").when(late, "expired").otherwise("undone"))
    status = _cut(a.select("audit_id", "status"))
    live = log.audits.filter("undone_at is null").select("audit_id", "run")
    shared = _cut(_shared(log, _places(entity, [] if _one_run(log) else children)).join(live, "audit_id"))
    while True:  # a blocked undoing may block others: at most as many rounds as merges that follow each other on a row
        going = status.filter("status = 'undone'").select("audit_id")
        # Of the merges that stay on a row the last: it blocks those of its run and before. No merge meets each other one.
        stay = shared.join(going, "audit_id", "left_anti").groupBy("place", "row").agg(F.max("run").alias("_last"))
        stuck = shared.join(going, "audit_id").join(stay, ["place", "row"]).filter("run <= _last").select("audit_id").distinct()
        if not stuck.limit(1).count():
            return status
        status = _cut(status.join(stuck.withColumn("_stuck", F.lit(True)), "audit_id", "left").select("audit_id", F.when(F.col("_stuck"), "blocked").otherwise(F.col("status")).alias("status")))


def undo(tables: Tables, log: Log, wanted: DataFrame, entity: Entity, children: list[Child], as_of: Column, days: int = 30) -> tuple[Tables, Log, DataFrame]:
    """Tables without the merges that can be undone, the log with undone_at set, and what became of the wanted ones (`undo_status`).

    What changed in a touched row since its merge goes with it; an element of an array comes back only where the keeper's id still stands.
    """
    status = undo_status(log, wanted, entity, children, as_of, days)
    going = status.filter("status = 'undone'").select("audit_id")
    order = log.audits.join(going, "audit_id").select("audit_id", "run", "merged_id")
    named, one = {c.table: c for c in children}, _one_run(log)
    out = dict(tables)
    for t, key in _places(entity, children).items():
        child, cols = named.get(t), tables[t].columns
        if child and one:  # a place has one image, and what it refers to, by which it was found, tells its merge
            refers = "_old" if child.array else child.column
            images = log.images[t].join(order.select(F.col("merged_id").alias(refers)), refers, "left_semi")
        else:  # of a place's images the oldest: the state before all that is undone
            images, first = log.images[t].join(order.drop("merged_id"), "audit_id").groupBy(*key), F.struct("run", "audit_id")
            if child and child.array:
                images = images.agg(F.min_by("_old", first).alias("_old"), F.max_by("_new", first).alias("_new"))
            else:
                images = images.agg(F.min_by(F.struct(*cols), first).alias("_row")).select("_row.*")
        if child and child.array:
            out[t] = _put(tables[t], child, images.select(*key, F.col("_old").alias("_id"), F.col("_new").alias("_was")))
            continue
        back = images.select(*key, *(F.col(c).alias(f"_was_{c}") for c in cols if c not in key), F.lit(True).alias("_back"))
        out[t] = tables[t].join(back, list(key), "full").select(*(F.col(c) if c in key else F.when(F.col("_back"), F.col(f"_was_{c}")).otherwise(F.col(c)).alias(c) for c in cols))
    audits = log.audits.join(going.withColumn("_now", F.lit(True)), "audit_id", "left")
    audits = audits.withColumn("undone_at", F.when(F.col("_now"), as_of.cast("timestamp")).otherwise(F.col("undone_at"))).drop("_now")
    return out, replace(log, audits=audits), status


def decide(candidates: DataFrame, decisions: DataFrame, least: int = 3) -> DataFrame:
    """candidates (candidate_id, status, skip_count, decided_by, decided_at) after decisions (candidate_id, decision, by, at): merged, deferred, undone (pending again), or skipped. The last skip of `least` dismisses a candidate; of other decisions the last counts."""
    skip = F.col("decision") == "skipped"
    last = F.max(F.when(~skip, F.struct("at", "decision", "by")))
    g = decisions.groupBy("candidate_id").agg(F.count_if(skip).alias("_skips"), last.alias("_last"), F.slice(F.array_sort(F.collect_list(F.when(skip, F.struct("at", "by")))), 1, least).alias("_first"))
    out = candidates.join(g, "candidate_id", "left")
    total = F.col("skip_count") + F.coalesce("_skips", F.lit(0))
    # The skip that makes it `least`, if it is among the new ones.
    at_skip = F.try_element_at("_first", F.greatest(F.lit(1), least - F.col("skip_count")).cast("int"))
    gone = (F.col("_skips") > 0) & (total >= least) & (F.col("_last").isNull() | (at_skip["at"] > F.col("_last.at")))
    status = F.when(gone, "dismissed").when(F.col("_last.decision") == "undone", "pending").otherwise(F.coalesce("_last.decision", "status"))
    named = {"by": "decided_by", "at": "decided_at"}
    fields = [F.when(gone, at_skip[k]).when(F.col("_last.decision") == "undone", None).otherwise(F.coalesce(F.col(f"_last.{k}"), F.col(c))).alias(c) for k, c in named.items()]
    return out.select("candidate_id", status.alias("status"), total.cast("long").alias("skip_count"), *fields)


def link_contacts(links: DataFrame, contacts: DataFrame, requests: DataFrame) -> DataFrame:
    """links (identity_id, platform, identifier, confidence) with the phones (seven characters or more without blanks, dashes, brackets and points) and
    mail addresses of contacts (contact_id, phones, mails) that requests (contact_id, identity_id) tie to a person; what a link has already stays."""
    c = contacts.join(requests, "contact_id")
    phones = c.select("identity_id", F.lit("phone").alias("platform"), F.explode(F.transform("phones", lambda p: F.regexp_replace(p, r"[\s\-\(\)\.]", ""))).alias("identifier")).filter(F.length("identifier") >= 7)
    mails = c.select("identity_id", F.lit("email").alias("platform"), F.explode(F.transform("mails", F.lower)).alias("identifier"))
    new = phones.union(mails).filter("identifier is not null").distinct().withColumn("confidence", F.lit(0.9))
    return links.unionByName(new.join(links.select("identity_id", "platform", "identifier"), ["identity_id", "platform", "identifier"], "left_anti"))


def link_photos(photos: DataFrame, requests: DataFrame) -> DataFrame:
    """photos (photo_id, people, person_ids): the persons that requests (name, person_id) give for a name in `people` join person_ids, each once, in order of id."""
    found = photos.select("photo_id", F.explode("people").alias("name")).join(requests, "name").groupBy("photo_id").agg(F.array_sort(F.collect_set("person_id")).alias("_new"))
    ids = F.coalesce("person_ids", F.array().cast(photos.schema["person_ids"].dataType))
    return photos.join(found, "photo_id", "left").withColumn("person_ids", F.when(F.col("_new").isNotNull(), F.concat(ids, F.array_except("_new", ids))).otherwise(F.col("person_ids"))).select(photos.columns)
