"""Entity resolution and the fact store: staged matching, duplicate scores, merges, supersession, confidence."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import identifiers, similarity
from tidewater.operators import folds, joins, pairs


def staged_match(records: DataFrame, entities: DataFrame, stages: list[str], id_: str = "record_id", entity: str = "entity_id") -> DataFrame:
    """record_id, entity_id, stage: each record takes the first stage (a column of both sides) that finds an entity; what is
    left goes on to the next. Of several entities the smallest id."""
    left, out = records, []
    for stage in stages:
        keyed = entities.filter(F.col(stage).isNotNull()).groupBy(stage).agg(F.min(entity).alias(entity))
        hit = left.filter(F.col(stage).isNotNull()).join(keyed, stage).select(id_, entity, F.lit(stage).alias("stage"))
        out.append(hit)
        left = left.join(hit.select(id_), id_, "left_anti")
    return reduce(DataFrame.unionByName, [*out, left.select(id_, F.lit(None).cast(entities.schema[entity].dataType).alias(entity), F.lit("new").alias("stage"))])


def fuzzy_match(records: DataFrame, entities: DataFrame, merge: float = 0.85, review: float = 0.55, top: int = 200) -> DataFrame:
    """record_id, entity_id, sim, action: against the `top` entities with the most facts (a bound for the broadcast)."""
    best = entities.orderBy(F.desc("fact_count"), "entity_id").limit(top).select("entity_id", similarity.name_key(F.col("name")).alias("theirs"))
    names = records.select("name").distinct().withColumn("ours", similarity.name_key(F.col("name")))  # each name is compared once, however many records have it
    scored = names.join(F.broadcast(best), F.lit(True)).withColumn("sim", similarity.name_alike(F.col("ours"), F.col("theirs")))
    near = scored.groupBy("name").agg(F.max(F.struct("sim", (-F.col("entity_id")).alias("e"))).alias("m"))
    m = records.select("record_id", "name").join(near, "name", "left").select("record_id", (-F.col("m.e")).alias("entity_id"), "m.sim")
    return m.withColumn("action", F.when(F.col("sim") >= merge, "merge").when(F.col("sim") >= review, "review").otherwise("create"))


#: Cells of the tables of distances that a task keeps.
_CELLS = 5_000_000


def _ranks(values: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where values are; -1: null."""
    return values.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _by_length(names: pa.Array) -> tuple[list[str], np.ndarray]:
    """The different names in order of length, and each one's place among them."""
    coded = names.dictionary_encode()
    words = coded.dictionary.to_pylist()
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    place = np.empty(len(words), dtype=np.int64)
    place[order] = np.arange(len(words))
    return [words[i] for i in order], place[coded.indices.to_numpy(zero_copy_only=False)]


def _contact_score(email: float | Column, sim: float | Column) -> float | Column:
    return 0.5 + 0.3 * email + 0.2 * sim


def contact_pairs(contacts: DataFrame, most_shared: int | None = None, digits: int | None = None) -> DataFrame:
    """a < b, score (rounded to digits, if given), action for contacts (id, name, phone, email) by .5 phone + .3 mail + .2 name, of .6 at least.

    No pair reaches .6 without a common phone, so contacts meet by phones alone, in parts of a bounded number of rows; a mail is compared where they meet.
    There, all distances of names of a tile advance together, and a score is one of the few that their lengths allow.
    Phones that more than most_shared contacts have (if given) say nothing and are left out.
    """
    keyed = contacts.filter("phone is not null and phone <> ''").select("id", similarity.tidy(F.col("name")).alias("name"), "phone", F.when(F.col("email") != "", F.col("email")).alias("email"))
    if most_shared:
        few = keyed.groupBy("phone").agg(F.count_distinct("id").alias("n")).filter(F.col("n") <= most_shared)
        keyed = keyed.join(few.select("phone"), "phone", "left_semi")
    keyed = keyed.filter("name is not null")
    several = keyed.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("id", F.lit(True).alias("_s"))
    some = several.limit(1).count() > 0
    met = pairs.meetings(keyed.join(several, "id", "left") if some else keyed, ["phone"], "id")

    def rounded(score: float) -> float:
        return score if digits is None else float(Decimal(repr(score)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))

    def score(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        rows = rows.take(pc.sort_indices(rows, [("id", "ascending")]))
        ids, mail, second = rows.column("id").to_numpy(), _ranks(rows.column("email")), rows.column("_second").to_numpy()
        again = rows.column("_s").is_valid().to_numpy() if some else None
        names = rows.column("name").combine_chunks()
        longest = max(pc.max(pc.utf8_length(names)).as_py(), 1)
        sims = np.array(similarity.edit_values(longest))
        n = len(sims)
        sims = np.concatenate([sims, sims])
        scores = [_contact_score(e, s) for e in (0.0, 1.0) for s in sims[:n].tolist()]
        shown, enough, auto = np.array([rounded(s) for s in scores]), np.array([s >= 0.6 for s in scores]), np.array([s >= 0.95 for s in scores])
        one = key[1] == key[2]
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        theirs, place = _by_length(names.take(pa.array(right)))
        at = 0
        while at < len(left) and (one or len(right)):
            if one:  # a tile meets itself and what comes after it
                right = left[at:]
                theirs, place = _by_length(names.take(pa.array(right)))
            tile = max(1, _CELLS // (longest + 1) // 2 // len(right))
            mine = left[at : at + tile]
            at += tile
            ours, own = _by_length(names.take(pa.array(mine)))
            code = similarity.edit_codes(ours, theirs, longest).astype(np.min_scalar_type(2 * n))[own][:, place]
            code += ((mail[mine, None] == mail[right]) & (mail[mine, None] >= 0)).astype(code.dtype) * code.dtype.type(n)
            hit = enough[code]
            if some:
                hit |= again[mine, None] | again[right]
            if one:
                hit &= ids[mine, None] < ids[right]
            i, j = np.nonzero(hit)
            code, a, b = code[i, j], ids[mine[i]], ids[right[j]]
            if not one:
                turn = a > b
                a, b = np.where(turn, b, a), np.where(turn, a, b)
            out = {"a": a, "b": b, "score": shown[code], "auto": auto[code]}
            if some:
                out |= {"again": again[mine[i]] | again[right[j]], "email": code >= n, "sim": sims[code]}
                out = {k: v[a != b] for k, v in out.items()}
            yield pa.RecordBatch.from_pydict(out)

    kind = contacts.schema["id"].dataType.simpleString()
    out = met.groupBy("phone", "_i", "_j").applyInArrow(score, f"a {kind}, b {kind}, score double, auto boolean" + (", again boolean, email boolean, sim double" if some else ""))
    scored = out
    if some:  # pairs of contacts with one phone each meet once and go on as they are; only others are grouped
        grouped = out.filter("again").groupBy("a", "b").agg(F.bool_or("email").cast("double").alias("email"), F.max("sim").alias("sim"))
        grouped = grouped.select("a", "b", _contact_score(F.col("email"), F.col("sim")).alias("score")).filter("score >= 0.6").withColumn("auto", F.col("score") >= 0.95)
        scored = out.filter("not again").select("a", "b", "score", "auto").unionByName(grouped if digits is None else grouped.withColumn("score", F.round("score", digits)))
    return scored.select("a", "b", "score", F.when(F.col("auto"), "auto").otherwise("review").alias("action"))


def hints(said: DataFrame, entities: DataFrame) -> DataFrame:
    """said's key columns, entity_id, via: written names, without suffixes and remarks, found among entities (name, entity_id) by the
    whole name or, for a single word, by the first name (the smallest id that has it)."""
    name = F.trim(F.regexp_replace(F.lower("name"), r" *(\(.*\)|jr\.?|sr\.?|iii?)$", ""))
    whole = entities.select("name", F.col("entity_id").alias("by_name"))
    first = entities.groupBy(F.split_part("name", F.lit(" "), F.lit(1)).alias("name")).agg(F.min("entity_id").alias("by_first"))
    out = said.withColumn("name", name).join(whole, "name", "left").join(first, "name", "left").withColumn("entity_id", F.coalesce("by_name", "by_first")).filter("entity_id is not null")
    return out.withColumn("via", F.when(F.col("by_name").isNotNull(), "name").otherwise("first")).drop("name", "by_name", "by_first")


def auto_apply(candidates: DataFrame, levels: dict[str, float]) -> DataFrame:
    """Candidates whose kind's threshold their confidence reaches."""
    table = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    return candidates.filter(F.col("confidence") >= F.element_at(table, F.col("kind")))


def apply_merges(children: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    """Re-points `column` of a child table from merged to surviving ids (chains are resolved beforehand: survivors don't merge)."""
    m = merges.select(F.col("merged").alias(column), "survivor")
    return children.join(m, column, "left").withColumn(column, F.coalesce("survivor", column)).drop("survivor")


def survivors(entities: DataFrame, keys: list[str]) -> DataFrame:
    """merged, survivor: of entities with equal keys the one with the most facts stays (then the oldest, then the smallest id)."""
    best = F.max_by("entity_id", F.struct("fact_count", -F.datediff("created", F.lit("1970-01-01").cast("date")), -F.col("entity_id"))).alias("survivor")
    return entities.join(entities.groupBy(*keys).agg(best), keys).filter("entity_id != survivor").select(F.col("entity_id").alias("merged"), "survivor")


def fold_facts(facts: DataFrame) -> DataFrame:
    """entity, key, value, confidence, evidence, sources, supersedes: the current fact of each key after all observations in order.

    The same value adds evidence, takes the larger confidence and unites sources; another value of at least the current
    confidence supersedes it; a weaker one adds evidence only. The rule depends on the order, so a key is folded in sequence.
    """

    def step(state: tuple, r) -> tuple[tuple, list[tuple]]:
        value, confidence, evidence, sources, replaced = state
        if value is None or r.value != value and r.confidence >= confidence:
            return (r.value, r.confidence, 1, frozenset([r.source]), replaced + (value is not None)), []
        if r.value == value:
            return (value, max(confidence, r.confidence), evidence + 1, sources | {r.source}, replaced), []
        return (value, confidence, evidence + 1, sources, replaced), []

    def end(key: tuple, state: tuple) -> list[tuple]:
        value, confidence, evidence, sources, replaced = state
        return [(*key, value, confidence, evidence, ",".join(sorted(sources)), replaced)]

    rows = facts.select("entity", "key", "at", "id", "value", "confidence", "source")
    return folds.fold(rows, ["entity", "key"], ["at", "id"], lambda: (None, 0.0, 0, frozenset(), 0), step, "entity long, key string, value string, confidence double, evidence long, sources string, supersedes long", end)


def reinforce(patterns: DataFrame, step: float = 0.1) -> DataFrame:
    """description, confidence, seen: each observation adds `step` to the first confidence, to 1 at most."""
    g = patterns.groupBy("description").agg(F.min_by("confidence", "at").alias("c"), F.count(F.lit(1)).alias("seen"))
    return g.select("description", F.least(F.lit(1.0), F.col("c") + step * (F.col("seen") - 1)).alias("confidence"), "seen")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def stale(summaries: DataFrame, changed: list[int]) -> DataFrame:
    """Summaries with a member that changed."""
    return summaries.withColumn("stale", F.arrays_overlap("members", F.array(*map(F.lit, changed)).cast(summaries.schema["members"].dataType)))


def pattern_maintenance(patterns: DataFrame, as_of, decay: float = 0.95, idle_days: int = 14) -> DataFrame:
    """Idle patterns decay by week; .85 with five observations promotes, below .1 deactivates."""
    weeks = F.floor(F.greatest(F.lit(0), F.datediff(as_of, "last_seen") - idle_days) / 7)
    c = F.col("confidence") * F.pow(F.lit(decay), weeks)
    return patterns.withColumns({"confidence": c, "state": F.when((c >= 0.85) & (F.col("seen") >= 5), "promoted").when(c < 0.1, "inactive").otherwise("active")})


def identity_key(c: Column) -> Column:
    """An identifier without blanks, dashes, brackets and points (those of mail addresses too); US numbers get +1; mail in lower case. Null below two characters."""
    # What falls away, and the two forms of US numbers.
    t = F.regexp_replace(c, r"[\s\-\(\)\.]", "")
    t = F.when(t.rlike("^[2-9][0-9]{9}$"), F.concat(F.lit("+1"), t)).when(t.rlike("^1[2-9][0-9]{9}$"), F.concat(F.lit("+"), t)).otherwise(t)
    return F.when(F.char_length(c) >= 2, F.when(t.contains("@"), F.lower(t)).otherwise(t))


def identify(records: DataFrame, links: DataFrame) -> DataFrame:
    """record_id, key, kind, identity_id, via for records (record_id, platform, identifier, name) against links (identity_id, platform, key).

    A link of the same platform comes first (via 'platform'), then one of any platform ('other', the smallest identity); records with a
    name and no link open an identity ('new'), the records of one key together, named by the smallest record_id, negated; the rest have none.
    """
    key = identity_key(F.col("identifier"))
    kind = F.when(F.col("key").contains("@"), "email").when(F.col("key").rlike(r"^\+?[0-9]{7,15}$"), "phone").when(F.col("key").isNotNull(), "handle")
    rows = records.select("record_id", "platform", "name", key.alias("key")).withColumn("kind", kind)
    same = links.groupBy("platform", "key").agg(F.min("identity_id").alias("same"))
    other = links.groupBy("key").agg(F.min("identity_id").alias("other"))
    named = F.char_length(F.trim("name")) > 1
    fresh = rows.filter(F.col("key").isNotNull() & named).groupBy("key").agg((-F.min("record_id")).alias("fresh"))
    out = rows.join(same, ["platform", "key"], "left").join(other, "key", "left").join(fresh, "key", "left")
    return out.select(
        "record_id", "key", "kind",
        F.coalesce("same", "other", F.when(named, F.col("fresh"))).alias("identity_id"),
        F.when(F.col("same").isNotNull(), "platform").when(F.col("other").isNotNull(), "other").when(named & F.col("fresh").isNotNull(), "new").alias("via"),
    )


def aliases(c: Column) -> Column:
    """Distinct aliases in lower case: phones as national digits, others trimmed."""
    # Fixed value: the form of a phone.
    one = lambda a: F.when(a.rlike(r"^\+?\d[\d\s()\-\.]+$") & (F.char_length(identifiers.digits(a)) >= 7), identifiers.phone_national(a)).otherwise(F.lower(F.trim(a)))
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), one), lambda a: a.isNotNull() & (a != "")))


def cascade(hints_: DataFrame, entities: DataFrame, merge: float = 0.85, review: float = 0.55, top: int = 200) -> DataFrame:
    """record_id, entity_id, stage, review_id, sim: hints (record_id, name, aliases, contact) resolved among entities (entity_id, name, aliases, contact, fact_count).

    Stages, the first that finds an entity (the smallest id) wins: a phone among the aliases, the contact, the name in any case, another alias, and the
    most similar of the `top` entities with the most facts (by name or alias), if it reaches `merge`. Else the hint is new; a similarity of
    `review` or more names the entity to look at. Stages meet by equi-joins; the `top` entities are a bounded broadcast.
    """
    h = hints_.select("record_id", F.lower(F.trim("name")).alias("name"), aliases(F.col("aliases")).alias("aliases"), "contact")
    e = entities.select("entity_id", F.lower(F.trim("name")).alias("name"), aliases(F.col("aliases")).alias("aliases"), "contact", "fact_count")

    def keyed(df: DataFrame, id_: str) -> DataFrame:
        is_phone = lambda a: a.rlike(r"^\d{7,}$")
        keys = F.array(F.struct(F.lit(2).alias("stage"), F.col("contact").alias("k")), F.struct(F.lit(3).alias("stage"), F.col("name").alias("k")))
        more = F.transform("aliases", lambda a: F.struct(F.when(is_phone(a), 1).otherwise(4).alias("stage"), a.alias("k")))
        return df.select(id_, F.explode(F.concat(keys, more)).alias("x")).select(id_, "x.*").filter("k is not null and k <> ''")

    by_key = keyed(e, "entity_id").groupBy("stage", "k").agg(F.min("entity_id").alias("entity_id"))
    hits = keyed(h, "record_id").join(by_key, ["stage", "k"]).groupBy("record_id").agg(F.min(F.struct("stage", "entity_id")).alias("hit"))
    left = h.join(hits, "record_id", "left")
    best = e.orderBy(F.desc("fact_count"), "entity_id").limit(top).select("entity_id", F.explode(F.concat(F.array("name"), "aliases")).alias("known")).select("entity_id", similarity.name_key(F.col("known")).alias("theirs"))
    names = left.filter("hit is null").select("name").distinct().withColumn("ours", similarity.name_key(F.col("name"))).join(F.broadcast(best), F.lit(True))
    sims = names.withColumn("sim", similarity.name_alike(F.col("ours"), F.col("theirs"))).groupBy("name").agg(F.max(F.struct(F.round("sim", 9).alias("sim"), (-F.col("entity_id")).alias("e"))).alias("near")).filter("near.sim > 0")
    out = left.join(sims, "name", "left")
    sim, near = F.when(F.col("hit").isNull(), F.col("near.sim")), -F.col("near.e")
    stage = F.col("hit.stage")
    stages = F.when(F.col("hit").isNotNull(), F.when(stage == 1, "phone").when(stage == 2, "contact").when(stage == 3, "name").otherwise("alias"))
    return out.select(
        "record_id",
        F.coalesce("hit.entity_id", F.when(sim >= merge, near)).alias("entity_id"),
        F.coalesce(stages, F.when(sim >= merge, "fuzzy").otherwise("new")).alias("stage"),
        F.when((sim >= review) & (sim < merge), near).alias("review_id"),
        sim.alias("sim"),
    )


def merge_candidates(people: DataFrame, links: DataFrame, entities: DataFrame, seen: DataFrame, least: float = 0.6) -> DataFrame:
    """kind, a, b, confidence (strings a, b), at least `least`: pairs to merge.

    'person': names of people (id, name) with trigram similarity above .6, by .8 of it; identities that share a key of links (id, key), .95,
    each with the smallest one of its key (a star, so a key of many makes no square). 'entity': entities (id, name, fact_count) of one
    name, each with the one of most facts, 1. 'photo': names seen (name) that no person has, with the most similar person above .5, by .9 of it.
    """
    first = people.groupBy("name").agg(F.min("id").alias("id"))
    similar = joins.similar_names(people, "name", 0.6).join(first.select("name", F.col("id").alias("x")), "name").join(first.select(F.col("name").alias("other"), F.col("id").alias("y")), "other")
    named = similar.select(F.lit("person").alias("kind"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("sim") * 0.8).alias("confidence"))
    one = links.select("id", "key").distinct()
    shared = one.join(one.groupBy("key").agg(F.min("id").alias("a")), "key").filter("id != a").select(F.lit("person").alias("kind"), "a", F.col("id").alias("b"), F.lit(0.95).alias("confidence"))
    most = entities.groupBy("name").agg(F.max(F.struct("fact_count", (-F.col("id")).alias("m"))).alias("m")).select("name", (-F.col("m.m")).alias("a"))
    equal = entities.join(most, "name").filter("id != a").select(F.lit("entity").alias("kind"), "a", F.col("id").alias("b"), F.lit(1.0).alias("confidence"))
    pairs = named.unionByName(shared).unionByName(equal).select("kind", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "confidence")
    unknown = seen.select("name").distinct().join(people.select("name"), "name", "left_anti")
    photo = joins.best_match(unknown, people.select(F.col("name").alias("match")), 0.5).join(first.withColumnRenamed("name", "match"), "match")
    photo = photo.select(F.lit("photo").alias("kind"), F.col("id").cast("string").alias("a"), F.col("name").alias("b"), (F.col("sim") * 0.9).alias("confidence"))
    return pairs.unionByName(photo).groupBy("kind", "a", "b").agg(F.max("confidence").alias("confidence")).filter(F.col("confidence") >= least)


def replace_in_arrays(rows: DataFrame, merges: DataFrame, key: str, members: str) -> DataFrame:
    """key, members: arrays with merged ids replaced by surviving ones, each once. Arrays are unnested to meet the merges by a join."""
    m = merges.select(F.col("merged").alias("_m"), "survivor")
    one = rows.select(key, F.explode(members).alias("_m")).join(m, "_m", "left").select(key, F.coalesce("survivor", "_m").alias("_m"))
    return one.groupBy(key).agg(F.collect_set("_m").alias(members))


def merged_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """survivor, aliases (distinct, sorted), merged (how many), fact_count (their sum) after the merges."""
    m = merges.select(F.col("merged").alias("entity_id"), "survivor")
    kept = entities.join(m, "entity_id", "left").withColumn("survivor", F.coalesce("survivor", "entity_id"))
    known = kept.select("survivor", F.explode_outer("aliases").alias("a")).groupBy("survivor").agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    counts = kept.groupBy("survivor").agg((F.count(F.lit(1)) - 1).alias("merged"), F.sum("fact_count").alias("fact_count"))
    return counts.join(known, "survivor")
