"""Reviews as streams: the first deciding event of each draft, daily counts of late events, reminders and lapses that
fire by themselves, and reactions joined to what they react to.

State is one small row per draft, or a small table for a group of items. Rows of a batch are put in event order
inside the state function, since their arrival has none."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
OUT = "draft long, verb string, ts timestamp, event_id long"


def event_stream(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Events as files arrive, with what they mean for a draft."""
    verb = F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "error", "kill").when(F.col("event_type") == "signup", "rewrite").otherwise("ignored")
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(path)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("draft"), verb.alias("verb"))


def _first(keep_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(batches)
        if state.exists or rows.empty:
            return
        best = rows.sort_values(["ts", "event_id"]).iloc[0]
        state.update((str(best["verb"]),))
        decided = int(best["ts"].timestamp() * 1000)
        state.setTimeoutTimestamp(max(decided, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame({"draft": [key[0]], "verb": [best["verb"]], "ts": [best["ts"]], "event_id": [best["event_id"]]})

    return run


def first_decisions(events: DataFrame, verbs: tuple[str, ...] = ("approve", "kill"), keep_days: int = 400, late: str = "400 days") -> DataFrame:
    """The decision of each draft: of the first batch that has one, the earliest in it. What comes in later
    batches changes nothing, though it be earlier by its own time: a decision that was acted on stands. Events
    that are `late` behind the newest are dropped. State is one row for a draft, let go keep_days of event time
    after the decision; by then drafts are archived."""
    deciding = events.filter(F.col("verb").isin(*verbs)).withWatermark("ts", late)
    return deciding.groupBy("draft").applyInPandasWithState(_first(keep_days * 86_400_000), OUT, "verb string", "append", GroupStateTimeout.EventTimeTimeout)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day. A day comes out once, when events that are `late` after its end have come; what comes in
    after that is dropped. The last days stay open."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "verb").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "verb", "n")


#: Stands for a time that isn't known, in ms.
NEVER = 1 << 62
#: Groups that items are dealt to by hash. A stream keeps its number, which is in the state.
GROUPS = 1024
_TIMES = ["opened", "resolved"]


def _first_times(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for an item: its earliest times, and whether it was reminded."""
    return rows.groupby("item", as_index=False, dropna=False, sort=False).agg({"opened": "min", "resolved": "min", "reminded": "max"})


#: Rows of a group that wait at least until they are put together with what is known of its items.
ROWS = 1 << 16


def _together(known: pd.DataFrame | None, batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """What is known of a group's items, with all its new rows. Rows wait until there are as many as known items, so that
    the work is in proportion to the rows, however many batches they come in."""
    held, waiting = [] if known is None else [known], 0
    for rows in batches:
        held.append(rows[["item", *_TIMES]].assign(reminded=False))
        waiting += len(rows)
        if waiting >= max(len(held[0]), ROWS):
            held, waiting = [_first_times(pd.concat(held, ignore_index=True))], 0
    return _first_times(pd.concat(held, ignore_index=True)) if held else None


def _timers(hold: int, ahead: int | None):
    """Of one group of items: what is due by the watermark. All items of a group are worked on as columns."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = None
        if state.exists:
            with pa.ipc.open_stream(state.get[0]) as reader:
                known = reader.read_all().to_pandas()
        if not state.hasTimedOut:
            known = _together(known, batches)
        if known is None or known.empty:
            return
        now = state.getCurrentWatermarkMs()
        opened, resolved = (known[c].to_numpy("int64") for c in _TIMES)
        reminded = known["reminded"].to_numpy(bool)
        is_open = opened < NEVER
        # what was resolved but never opened is let go when its lapse would be due
        lapse = hold + np.where(is_open, opened, resolved)
        fired = []
        if ahead is not None:
            remind = lapse - ahead
            now_due = is_open & ~reminded & (now > remind)
            fired.append(("reminder", now_due & (resolved > remind), remind))
            reminded = reminded | now_due
        over = now > lapse
        fired.append(("lapse", over & is_open & (resolved > lapse), lapse))
        if over.all():
            if state.exists:
                state.remove()
        else:
            due = lapse if ahead is None else np.where(is_open & ~reminded, remind, lapse)
            sink = pa.BufferOutputStream()
            kept = pa.Table.from_pandas(known.assign(reminded=reminded)[~over], schema=_KEPT, preserve_index=False)
            with pa.ipc.new_stream(sink, _KEPT) as writer:
                writer.write_table(kept)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(int(due[~over].min()), now))
        told = [pd.DataFrame({"item": known["item"][which], "what": what, "ms": at[which]}) for what, which, at in fired if which.any()]
        if told:
            yield pd.concat(told, ignore_index=True)

    return run


_KEPT = pa.schema([("item", pa.string()), ("opened", pa.int64()), ("resolved", pa.int64()), ("reminded", pa.bool_())])


def deadlines(events: DataFrame, hold: str, ahead: str | None = None, late: str = "1 day") -> DataFrame:
    """(item, what, at): items that are open too long. events: (item, ts, what), what being open, resolve or anything else;
    item is anything that a cast to text and back keeps. `hold` after an item was opened (by its first such event) a lapse comes
    out, and `ahead` before that a reminder, each once, unless the item was resolved by then. at is when it was due. An item's
    timer fires when the watermark passes, with no event of the item, and is kept over a restart; by then all events up to it
    have come, but for those that are more than `late`, so batches and their order change nothing. Items are dealt to GROUPS by
    hash, whose state is a short row for each item until it lapses; a batch works on the groups that it has events or
    timers of, a group's items at once."""
    span = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    kind = events.schema["item"].dataType.simpleString()
    when = lambda what: F.when(F.col("what") == what, F.unix_millis("ts")).otherwise(F.lit(NEVER))
    text = F.col("item").cast("string")
    marked = events.withWatermark("ts", late).select("ts", text.alias("item"), when("open").alias("opened"), when("resolve").alias("resolved"))
    # the filter reads ts, so Spark leaves it behind the watermark, which other events move too
    asked = marked.filter(F.least("opened", "resolved") < NEVER).withColumn("group", F.pmod(F.xxhash64("item"), F.lit(GROUPS)))
    fired = asked.groupBy("group").applyInPandasWithState(
        _timers(span(hold), None if ahead is None else span(ahead)), "item string, what string, ms long", "items binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    return fired.select(F.col("item").cast(kind).alias("item"), "what", F.timestamp_millis("ms").alias("at"))


def reactions_to_posts(posts: DataFrame, reactions: DataFrame, within: str, late: str = "1 day") -> DataFrame:
    """Each reaction (subject, reacted, ...) with the posts (subject, posted, ...) of its subject that came `within` that
    time before it. A reaction without any comes out alone, once no such post can come any more. Both sides are
    held for the bound and the delay only, so state doesn't grow with the streams."""
    p = posts.withWatermark("posted", late).withColumnRenamed("subject", "_subject")
    r = reactions.withWatermark("reacted", late)
    near = (F.col("subject") == F.col("_subject")) & (F.col("posted") <= F.col("reacted")) & (F.col("reacted") <= F.col("posted") + F.expr(f"INTERVAL {within}"))
    return r.join(p, near, "leftOuter").drop("_subject")


def drained(stream: DataFrame, folder: str, name: str | None = None, held: list[int] | None = None) -> DataFrame:
    """Run a stream over all that is there and read what it wrote so far. folder must be shared by all
    executors; with a name, a later run goes on where the last one of that name ended. held gets the rows of
    state after each batch."""
    out = f"{folder}/stream-{name or uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    query = writer.format("parquet").start(f"{out}-rows")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if held is not None:
        held += [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}-rows")
