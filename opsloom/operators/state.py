"""Keyed state as tables: upserts, lookups, sweeps and the outcomes of state machines over ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return state.join(new.select(key), key, "left_anti").unionByName(new)


def update(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Set what changes has, and isn't null, for keys that state has."""
    renamed = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key))
    joined = state.join(renamed, key, "left")
    return joined.select(key, *(F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in joined.columns else c for c in state.columns if c != key))


def unreferenced(files: DataFrame, used: DataFrame, key: str, older_than: Column, modified: str) -> DataFrame:
    return files.filter(F.col(modified) < older_than).join(used.select(key).distinct(), key, "left_anti")


def due(queue: DataFrame, now: Column, most_attempts: int = 3) -> DataFrame:
    return queue.filter(F.col("status").isin("queued", "held") & (F.col("attempts") < most_attempts) & (F.col("slot_at") <= now))


def lapsed(pending: DataFrame, now: Column, hours: int) -> Column:
    return F.col("created_at") < now - F.expr(f"INTERVAL {hours} HOURS")


def first_decision(events: DataFrame, key: str, verb: str, at: str, event_id: str, verbs: list[str]) -> DataFrame:
    """The first event of each key whose verb decides; later ones change nothing. One aggregate, so events
    combine before the shuffle."""
    deciding = events.filter(F.col(verb).isin(verbs))
    return deciding.groupBy(key).agg(F.min_by(F.struct(verb, at, event_id), F.struct(at, event_id)).alias("d")).select(key, "d.*")


#: (phase, event) -> phase of a weekly cycle; other pairs leave the phase as it is.
WEEK_TURNS = (
    ("drafting", "drafted", "text_review"),
    ("text_review", "resolved", "image_gen"),
    ("image_gen", "rendered", "final_review"),
    ("final_review", "confirmed", "scheduled"),
)
OPEN_PHASES = ("drafting", "text_review", "image_gen", "final_review")


#: (phase, event) -> phase of a review: a rewrite request waits for a reply, which reopens the draft, once.
REVIEW_TURNS = (
    ("pending", "approve", "approved"),
    ("pending", "kill", "killed"),
    ("pending", "rewrite", "awaiting"),
    ("awaiting", "reply", "reopened"),
    ("reopened", "approve", "approved again"),
    ("reopened", "kill", "killed again"),
)
#: The same of a week's phases, with what ends an open one.
PHASE_TURNS = WEEK_TURNS + tuple((p, "cancel", "cancelled") for p in OPEN_PHASES) + tuple((p, "lapse", "lapsed") for p in ("text_review", "final_review"))
#: The same of a post: phases hold the number of failed attempts. Configuration and unfinished media hold it
#: without an attempt.
POST_TURNS = tuple(
    turn
    for n in range(3)
    for name in ("queued", "held")[n > 0 :]
    for turn in ((f"{name} {n}", "ok", f"posted {n}"), (f"{name} {n}", "error", f"held {n + 1}" if n < 2 else "failed 3"))
) + tuple(("queued 0", wait, "held 0") for wait in ("config", "not_ready"))


#: Blocks of one level that are composed to one of the next.
FAN_IN = 256


def walk(events: DataFrame, key: str, at: list[str], what: str, turns: tuple, start: str, block: int = 3600) -> DataFrame:
    """(key, phase) of each key with events, after a walk over turns (phase, event, next phase); other pairs of phase and
    event leave the phase as it is. Phases may come back.

    An event is a map from phase to phase, and maps compose in any grouping as long as their order stays. So the events of
    a key are cut into blocks of time (`block` seconds, or units of a number), each a group of its own that becomes one
    small map; FAN_IN blocks in a row are composed to one, and these in the end. Events are read once, whatever the number
    of phases, and a key with any share of them is spread over its blocks. Events that turn nothing aren't
    gathered. at: what orders events, the first being the time; equal ones are ordered by event."""
    phases = list(dict.fromkeys([start, *(p for was, _, will in turns for p in (was, will))]))
    kinds = list(dict.fromkeys(event for _, event, _ in turns))
    maps = [[phases.index({(was, e): will for was, e, will in turns}.get((p, kind), p)) for p in phases] for kind in kinds]
    table = F.array(*(F.array(*map(F.lit, m)) for m in maps))
    code = F.coalesce(*(F.when(F.col(what) == kind, F.lit(i)) for i, kind in enumerate(kinds)))
    time = events.schema[at[0]].dataType
    when = F.col(at[0]).cast("timestamp") if isinstance(time, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(at[0])

    def composed(parts: Column) -> Column:
        """One map of the maps in their order."""
        same = F.array(*(F.lit(i) for i in range(len(phases))))
        return F.aggregate(parts, same, lambda done, m: F.transform(done, lambda p: F.get(m, p)))

    told = events.select(F.col(key).alias("_key"), F.floor(when.cast("double") / block).alias("_block"), F.when(code.isNotNull(), F.struct(*at, code.alias("_code"))).alias("_event"))
    rows = told.groupBy("_key", "_block").agg(F.transform(F.array_sort(F.collect_list("_event")), lambda e: F.get(table, e["_code"])).alias("_maps"))
    rows = rows.select("_key", "_block", composed(F.col("_maps")).alias("_map"))
    for group in (["_key", F.floor(F.col("_block") / FAN_IN).alias("_over")], ["_key"]):
        parts = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_map"))), lambda p: p["_map"])
        rows = rows.groupBy(*group).agg(F.min("_block").alias("_block"), parts.alias("_maps")).withColumn("_map", composed(F.col("_maps"))).drop("_maps", "_over")
    return rows.select(F.col("_key").alias(key), F.get(F.array(*map(F.lit, phases)), F.get("_map", 0)).alias("phase"))


def probed(latency: Column, limit: int = 4000) -> Column:
    """struct(status, latency): what a health probe says that is cut off at the limit, in milliseconds."""
    return F.struct(F.when(latency.isNull() | (latency > limit), "down").otherwise("ok").alias("status"), F.least(F.coalesce(latency, F.lit(limit)), F.lit(limit)).alias("latency"))


def accepted_attempt(attempts: DataFrame, key: str, attempt: str, passed: str, most: int = 3) -> DataFrame:
    """The first attempt that passed, else the last allowed."""
    tried = attempts.filter(F.col(attempt) <= most)
    best = tried.groupBy(key).agg(F.min(F.when(F.col(passed), F.col(attempt))).alias("first_pass"), F.max(attempt).alias("last"))
    return best.select(key, F.coalesce("first_pass", "last").cast("long").alias("attempt"), F.col("first_pass").isNotNull().alias("passed"))


def once_per_day(events: DataFrame, day: Column, at: str, event_id: str) -> DataFrame:
    """The first event of each day."""
    return events.groupBy(day.alias("day")).agg(F.min_by(F.struct(at, event_id), F.struct(at, event_id)).alias("e")).select("day", "e.*")
