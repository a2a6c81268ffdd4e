"""Daily metrics of sixteen areas of life: a registry of functions, each from its own sources to (date, dimension, metric, value).

A source is a table with the columns its readers name. A dimension reads one or more sources, counts each by day before anything is
joined, and puts the days together; a day on which none of them says anything has no row. `signature` runs all dimensions whose
sources are there and unites them, so a missing source costs its dimension only. A source that covers several people gives
their columns as `by`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.stats import daylight_hours, haversine_km, js_round

Sources = dict[str, DataFrame]

@dataclass(frozen=True)
class Dimension:
    """needs: sources without which it isn't computed; may: sources that it reads where they are there."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    compute: Callable[..., DataFrame]


REGISTRY: dict[str, Dimension] = {}


def dimension(name: str, needs: Sequence[str], may: Sequence[str] = ()) -> Callable:
    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = Dimension(name, tuple(needs), tuple(may), f)
        return f

    return put


def one(name: str, sources: Sources, by: Sequence[str] = (), **options) -> DataFrame:
    """(by, date, dimension, metric, value) of a dimension; null values are left out."""
    wide = REGISTRY[name].compute(sources, list(by), **options)
    names = [c for c in wide.columns if c not in (*by, "date")]
    wide = wide.select(*by, "date", F.lit(name).alias("dimension"), *(F.col(c).cast("double").alias(c) for c in names))
    return wide.unpivot([*by, "date", "dimension"], names, "metric", "value").filter("date is not null and value is not null")


def signature(sources: Sources, by: Sequence[str] = (), options: dict[str, dict] | None = None) -> DataFrame:
    """All dimensions whose sources are there, as one long table. options: by dimension, what its function takes."""
    found = [one(n, sources, by, **(options or {}).get(n, {})) for n, d in REGISTRY.items() if all(s in sources for s in d.needs)]
    return reduce(DataFrame.unionByName, found)


# --- parts


def _daily(df: DataFrame, by: list[str], when: str | Column, **metrics: Column) -> DataFrame:
    return df.groupBy(*by, F.to_date(when).alias("date")).agg(*(c.alias(k) for k, c in metrics.items()))


def _together(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Days of any part; metrics that a day lacks are 0."""
    keys = [*by, "date"]
    out = reduce(lambda a, b: a.join(b, keys, "full"), parts)
    return out.select(*keys, *(F.coalesce(F.col(c).cast("double"), _zero()).alias(c) for c in out.columns if c not in keys))


def _any(*names: str) -> Column:
    return sum((F.col(n) for n in names[1:]), F.col(names[0])) > 0


def _zero() -> Column:
    return F.lit(0.0)


def _n() -> Column:
    return F.count(F.lit(1))


def _kinds(column: str, names: dict[str, str | tuple[str, ...]]) -> dict[str, Column]:
    """Counts of rows by value: metric to the value or values."""
    return {m: F.count_if(F.col(column).isin(*([v] if isinstance(v, str) else v))) for m, v in names.items()}


def _day_parts(prefix: str, when: str, evening_until: int = 22) -> dict[str, Column]:
    h = F.hour(when)
    return {f"{prefix}_morning": F.count_if(h.between(6, 11)), f"{prefix}_afternoon": F.count_if(h.between(12, 17)), f"{prefix}_evening": F.count_if(h.between(18, evening_until)), f"{prefix}_night": F.count_if((h < 6) | (h > evening_until))}


# --- dimensions

# Kinds of samples that add up over a day (others are averaged), and the metrics that the kinds give.
CUMULATIVE = ("steps", "active_energy", "basal_energy", "distance", "flights_climbed", "exercise_time", "stand_hours", "sleep")
HEALTH = {
    "steps": "steps", "avg_heart_rate": "heart_rate_avg", "resting_heart_rate": "resting_heart_rate", "active_energy_cal": "active_energy", "distance": "distance", "blood_oxygen_pct": "blood_oxygen", "sleep_hours": "sleep", "hrv": "hrv",
    "vo2_max": "vo2_max", "weight": "weight", "body_fat_pct": "body_fat", "walking_asymmetry_pct": "walking_asymmetry", "environmental_audio_db": "environmental_audio", "flights_climbed": "flights_climbed", "exercise_minutes": "exercise_time",
    "stand_hours": "stand_hours", "respiratory_rate": "respiratory_rate", "walking_speed": "walking_speed", "basal_energy_cal": "basal_energy",
}


@dimension("health", ["health"])
def health(s: Sources, by: list[str]) -> DataFrame:
    """health: ts, kind, value. Zeros are left out; the mean heart rate falls back on plain samples; workouts are the kinds workout_*."""
    kind, value = F.col("kind"), F.col("value")
    fold = {k: (F.sum if k in CUMULATIVE else F.avg)(F.when(kind == k, value)) for k in HEALTH.values()}
    fold["heart_rate_avg"] = F.coalesce(F.nullif(fold["heart_rate_avg"], _zero()), F.avg(F.when(kind == "heart_rate", value)))
    workout = kind.startswith("workout_")
    counted = {"workout_count": F.count_if(workout), "workout_duration_minutes": js_round(F.sum(F.when(workout, value)))}
    wide = _daily(s["health"], by, "ts", **{m: fold[k] for m, k in HEALTH.items()}, **counted)
    some = F.col("workout_count") > 0
    return wide.withColumns({m: F.nullif(m, _zero()) for m in HEALTH} | {"workout_count": F.when(some, F.col("workout_count")), "workout_duration_minutes": F.when(some, F.coalesce("workout_duration_minutes", _zero()))})


@dimension("communication", ["messages"], ["calls", "video_calls"])
def communication(s: Sources, by: list[str], channels: dict[str, str] | None = None) -> DataFrame:
    """messages: ts, direction, contact, channel, length, thread; calls: ts, channel, direction, seconds, contact; video_calls: ts, seconds, contact.
    channels: further metrics, each the messages of a channel. A response is a received message that a sent one of the same contact and day follows directly, within a day."""
    m, sent = s["messages"], F.col("direction") == "sent"
    w = Window.partitionBy(*by, F.to_date("ts"), "contact").orderBy("ts")
    nxt = m.filter("contact is not null").select("*", F.lead("ts").over(w).alias("_ts"), F.lead("direction").over(w).alias("_dir"))
    gap = (F.unix_micros(F.col("_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    answers = nxt.filter((F.col("direction") == "received") & (F.col("_dir") == "sent")).withColumn("gap", gap).filter(F.col("gap").between(1, 86_400))
    parts = [
        _daily(
            m, by, "ts", total_messages=_n(), sent=F.count_if(sent), received=F.count_if(F.col("direction") == "received"), unique_contacts=F.count_distinct("contact"), channels_used=F.count_distinct("channel"),
            avg_message_length=F.avg("length"), threaded_messages=F.count("thread"), direct_messages=F.count_if(F.col("thread").isNull()), **_kinds("channel", channels or {}),
        ),
        _daily(answers, by, "ts", avg_response_seconds=F.rint(F.avg("gap"))),
    ]
    if "calls" in s:
        call = F.col("channel") == "phone"
        seconds = lambda c: F.sum(F.when(c, F.col("seconds")))
        parts.append(
            _daily(
                s["calls"], by, "ts", total_calls=_n(), calls_inbound=F.count_if(call & (F.col("direction") == "inbound")), calls_outbound=F.count_if(call & (F.col("direction") == "outbound")), voicemails=F.count_if(F.col("channel") == "voicemail"),
                recordings=F.count_if(F.col("channel") == "recorder"), call_duration_seconds=seconds(call), recording_duration_seconds=seconds(F.col("channel") == "recorder"), call_contacts=F.count_distinct("contact"),
            )
        )
    if "video_calls" in s:
        parts.append(_daily(s["video_calls"], by, "ts", video_calls=_n(), video_duration_seconds=F.sum("seconds"), video_contacts=F.count_distinct("contact")))
    return _together(parts, by)


@dimension("location", ["locations"])
def location(s: Sources, by: list[str]) -> DataFrame:
    """locations: id, ts, place, source, lat, lon. The way from point to point within a day, jumps of a degree of latitude or more left out."""
    w = Window.partitionBy(*by, F.to_date("ts")).orderBy("ts", "id")
    moved = s["locations"].filter("lat is not null").select(*by, "ts", "lat", "lon", F.lag("lat").over(w).alias("_lat"), F.lag("lon").over(w).alias("_lon")).filter(F.abs(F.col("lat") - F.col("_lat")) < 1)
    way = _daily(moved, by, "ts", total_distance_km=js_round(F.sum(haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))), 1))
    return _together([_daily(s["locations"], by, "ts", location_points=_n(), unique_places=F.count_distinct("place"), sources=F.count_distinct("source")), way], by)


@dimension("schedule", ["calendar"], ["reminders"])
def schedule(s: Sources, by: list[str]) -> DataFrame:
    """calendar: id, begins, ends, all_day, calendar, attendees (their number); reminders: due, completed_at, completed. Back to back: an
    event that begins within 15 minutes of the end of the one before it that day. A reminder counts on the day it is due and the day it is done, once if they are one."""
    c = s["calendar"]
    seconds = lambda a, b: (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1e6
    timed = c.filter("not all_day")
    w = Window.partitionBy(*by, F.to_date("begins")).orderBy("begins", "id")
    close = timed.select(*by, "begins", F.lag("ends").over(w).alias("_end")).filter(seconds("_end", "begins").between(0, 900))
    hours = F.coalesce(F.sum(F.when(~F.col("all_day"), seconds("begins", "ends") / 3600)), _zero())
    parts = [
        _daily(c, by, "begins", events=_n(), work_hours_events=F.count_if(F.hour("begins").between(9, 17)), all_day_events=F.count_if("all_day"), calendars_used=F.count_distinct("calendar"), total_meeting_hours=js_round(hours, 1), avg_attendees=js_round(F.avg(F.coalesce("attendees", F.lit(0))), 1), free_hours=js_round(F.greatest(_zero(), 9 - hours), 1)),
        _daily(close, by, "begins", back_to_back_count=_n()),
    ]
    if "reminders" in s:
        days = F.explode(F.array_distinct(F.array(F.to_date("due"), F.to_date("completed_at"))))
        parts.append(_daily(s["reminders"].select(*by, "completed", days.alias("day")), by, "day", reminder_count=_n(), reminders_completed=F.count_if("completed")))
    out = _together(parts, by)
    return out.withColumn("free_hours", F.when(F.col("events") > 0, F.col("free_hours")).otherwise(9.0))


_SEARCH, _VIEWS = ("search", "maps"), ("youtube", "youtube.com", "image_search", "discover", "assistant_apps")


@dimension("search_behavior", ["activity"])
def search_behavior(s: Sources, by: list[str]) -> DataFrame:
    """activity: ts, kind, title. Repeat searches are titles that a day has more than once."""
    a = s["activity"].filter(F.col("kind").isin(*_SEARCH))
    plain = F.col("kind") == "search"
    again = a.filter(plain & F.col("title").isNotNull()).groupBy(*by, F.to_date("ts").alias("day"), "title").agg(_n().alias("n")).filter("n > 1")
    counts = _daily(a, by, "ts", total_searches=_n(), plain_searches=F.count_if(plain), maps_searches=F.count_if(F.col("kind") == "maps"), question_searches=F.count_if(plain & F.col("title").contains("?")), **_day_parts("search", "ts"))
    return _together([counts, _daily(again, by, "day", repeat_searches=_n())], by)


@dimension("content_consumption", ["activity"])
def content_consumption(s: Sources, by: list[str]) -> DataFrame:
    a = s["activity"].filter(F.col("kind").isin(*_VIEWS))
    kinds = _kinds("kind", {"video_views": ("youtube", "youtube.com"), "image_searches": "image_search", "discover_views": "discover", "assistant_interactions": "assistant_apps"})
    return _daily(a, by, "ts", total_views=_n(), **kinds, **_day_parts("content", "ts"))


@dimension("photos", ["photos"], ["faces"])
def photos(s: Sources, by: list[str]) -> DataFrame:
    """photos: photo_id, ts, lat, description, album; faces: photo_id, person. Faces count on their photo's day."""
    p = s["photos"]
    parts = [_daily(p, by, "ts", photos_taken=_n(), with_location=F.count("lat"), with_description=F.count("description"), unique_albums=F.count_distinct("album"))]
    if "faces" in s:
        parts.append(_daily(s["faces"].join(p.select(*by, "photo_id", "ts"), "photo_id"), by, "ts", faces_detected=_n(), unique_people=F.count_distinct("person")))
    return _together(parts, by)


@dimension("social_media", ["social"])
def social_media(s: Sources, by: list[str], kinds: dict[str, tuple[str, str]] | None = None, tells: Sequence[str] = ()) -> DataFrame:
    """social: ts, network, kind. kinds: each metric's network and kind; a day counts if one of `tells` (all, if none is named) does."""
    kinds = kinds or {"posts": ("facebook", "post"), "comments": ("facebook", "comment"), "likes": ("instagram", "like")}
    wide = _daily(s["social"], by, "ts", **{m: F.count_if((F.col("network") == n) & (F.col("kind") == k)) for m, (n, k) in kinds.items()})
    return wide.filter(_any(*(tells or kinds)))


@dimension("fitness", ["workouts"], ["activities", "rings"])
def fitness(s: Sources, by: list[str]) -> DataFrame:
    """workouts: ts; activities: ts, meters, seconds; rings: date and any numbers, one row a day."""
    parts = [_daily(s["workouts"], by, "ts", health_workouts=_n())]
    if "activities" in s:
        parts.append(_daily(s["activities"], by, "ts", activities=_n(), distance_meters=F.sum("meters"), duration_seconds=F.sum("seconds")))
    out = _together(parts, by)
    if "rings" not in s:
        return out
    r = s["rings"].dropDuplicates([*by, "date"])
    rings = [c for c in r.columns if c not in (*by, "date")]
    out = out.join(r, [*by, "date"], "full")
    return out.select(*by, "date", *(F.coalesce(F.col(c).cast("double"), _zero()).alias(c) if c not in rings else F.col(c).alias(f"ring_{c}") for c in out.columns if c not in (*by, "date")))


@dimension("music", ["plays"])
def music(s: Sources, by: list[str]) -> DataFrame:
    """plays: ts, artist, album, genre, ms."""
    distinct = {"unique_artists": "artist", "unique_albums": "album", "unique_genres": "genre"}
    return _daily(s["plays"], by, "ts", tracks_played=_n(), **{m: F.count_distinct(c) for m, c in distinct.items()}, total_duration_seconds=js_round(F.coalesce(F.sum("ms"), _zero()) / 1000), **_day_parts("listen", "ts"))


@dimension("voice", ["recordings"], ["moments"])
def voice(s: Sources, by: list[str]) -> DataFrame:
    """recordings: ts, words, seconds, speakers (array); moments: ts. A recording counts, with its words and seconds, once for each speaker."""
    r = s["recordings"].select(*by, "ts", "words", "seconds", F.explode("speakers").alias("speaker"))
    parts = [_daily(r, by, "ts", recordings=_n(), words=F.sum("words"), duration_seconds=F.sum("seconds"), speakers=F.count_distinct("speaker"))]
    if "moments" in s:
        parts.append(_daily(s["moments"], by, "ts", moments=_n()))
    return _together(parts, by)


@dimension("digital_activity", ["apps"], ["visits", "assistant"])
def digital_activity(s: Sources, by: list[str]) -> DataFrame:
    """apps: ts, app, seconds, stream; visits: ts, domain; assistant: ts, domain, app, seconds."""
    parts = [_daily(s["apps"], by, "ts", app_events=_n(), unique_apps=F.count_distinct("app"), app_usage_seconds=F.sum("seconds"), app_streams=F.count_distinct("stream"))]
    if "visits" in s:
        parts.append(_daily(s["visits"], by, "ts", web_visits=_n(), unique_domains=F.count_distinct("domain")))
    if "assistant" in s:
        parts.append(_daily(s["assistant"], by, "ts", assistant_interactions=_n(), assistant_domains=F.count_distinct("domain"), assistant_apps=F.count_distinct("app"), assistant_duration_seconds=F.sum("seconds")))
    return _together(parts, by)


@dimension("meta", ["records"])
def meta(s: Sources, by: list[str], kinds: dict[str, str] | None = None, tells: Sequence[str] = ("conversations", "model_calls", "journal_entries")) -> DataFrame:
    """records: ts, kind, cost: the system's own rows. kinds: each metric's kind; a day counts if one of `tells` does."""
    kinds = kinds or {"journal_entries": "journal", "narrations": "narration", "insights": "insight", "conversations": "conversation", "messages_exchanged": "message", "model_calls": "model_call", "tool_actions": "action"}
    cost = F.coalesce(F.sum(F.when(F.col("kind") == "model_call", F.col("cost"))), _zero())
    return _daily(s["records"], by, "ts", **_kinds("kind", kinds), model_cost_cents=cost).filter(_any(*tells))


@dimension("motion", ["motion"])
def motion(s: Sources, by: list[str]) -> DataFrame:
    """motion: ts and a boolean for each state; shares in whole percents (null counts as false)."""
    states = ("stationary", "walking", "running", "automotive", "cycling")
    return _daily(s["motion"], by, "ts", motion_events=_n(), **{f"{x}_pct": js_round(F.avg(F.coalesce(x, F.lit(False)).cast("double")) * 100) for x in states})


@dimension("weather", ["weather"])
def weather(s: Sources, by: list[str], latitude: float = 0.0) -> DataFrame:
    """weather: date, high, low, rain, humidity; of several rows of a day the first by all columns counts."""
    cols = ("high", "low", "rain", "humidity")
    r = s["weather"].groupBy(*by, "date").agg(F.min(F.struct(*cols)).alias("w")).select(*by, "date", *(F.coalesce(F.col(f"w.{c}").cast("double"), _zero()).alias(c) for c in cols))
    return r.select(
        *by, "date", F.col("high").alias("temp_high"), F.col("low").alias("temp_low"), js_round((F.col("high") + F.col("low")) / 2, 1).alias("temp_avg"), F.col("rain").alias("precipitation"), F.col("humidity").alias("humidity_pct"),
        (F.col("rain") > 0.1).cast("int").alias("is_rainy"), js_round(daylight_hours(F.dayofyear("date"), F.lit(latitude)), 1).alias("daylight_hours"),
    )


@dimension("ai_assistant", ["assistant_messages"])
def ai_assistant(s: Sources, by: list[str], providers: Sequence[str] = ()) -> DataFrame:
    """assistant_messages: ts, provider, role (user or human; assistant; tool), text, conversation, model, attached, tools (calls within the message). providers: those with counts of their own."""
    user, bot = F.col("role").isin("user", "human"), F.col("role") == "assistant"
    long = lambda c: js_round(F.coalesce(F.avg(F.when(c, F.char_length("text"))), _zero()))
    h = F.hour("ts")
    parts = {f"usage_{n}": F.count_if(user & c) for n, c in (("morning", h.between(6, 11)), ("afternoon", h.between(12, 17)), ("evening", h.between(18, 23)), ("night", h < 6))}
    own = {f"{p}_messages": F.count_if(F.col("provider") == p) for p in providers} | {f"{p}_conversations": F.count_distinct(F.when(F.col("provider") == p, F.col("conversation"))) for p in providers}
    return _daily(
        s["assistant_messages"], by, "ts", total_messages=_n(), user_messages=F.count_if(user), assistant_messages=F.count_if(bot), tool_calls=F.count_if(F.col("role") == "tool") + F.coalesce(F.sum("tools"), F.lit(0)), conversations=F.count_distinct("conversation"),
        models_used=F.count_distinct("model"), messages_with_attachments=F.count_if("attached"), avg_user_message_length=long(user), avg_assistant_response_length=long(bot), **own, **parts,
    )


def ranked_context(df: DataFrame, when: str, item: str, weight: Column, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, date, items): the k items of a day with the greatest weight (an aggregate), as item:weight in order (ties by item): contacts, applications, domains of the day."""
    per = df.filter(F.col(item).isNotNull()).groupBy(*by, F.to_date(when).alias("date"), F.col(item).cast("string").alias("item")).agg(weight.cast("long").alias("w"))
    first = per.withColumn("p", F.row_number().over(Window.partitionBy(*by, "date").orderBy(F.desc_nulls_last("w"), "item"))).filter(F.col("p") <= k)
    return first.groupBy(*by, "date").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "item", "w"))), lambda x: F.concat_ws(":", x["item"], x["w"].cast("string"))).alias("items"))
