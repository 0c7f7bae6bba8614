"""Posts in order to a platform's calendar, where each use of a slot closes it, spread over ranges of posts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.allocation import places

#: Posts, and slots, that one task walks, at least; and ranges that all posts, or slots, are dealt to at most.
PER_RANGE = 5000
RANGES = 200


def _starts(key: tuple, lost: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
    """For each range of one platform's posts: the blocks of slots that its walk meets, and how many of the open
    slots of the first one are behind it already (-1: all slots are). lost: _q, n; grid: _b, _c, n."""
    if lost.empty:
        return pd.DataFrame(columns=["platform", "_q", "_from", "_to", "_skip"], dtype=object)
    many, blocks = int(lost["_q"].max()) + 1, int(grid["_b"].max()) + 1 if len(grid) else 0
    behind = np.zeros(many + 1, np.int64)
    behind[lost["_q"].to_numpy() + 1] = lost["n"].to_numpy()
    behind = np.cumsum(behind)
    counts = np.zeros((blocks, many + 1), np.int64)
    np.add.at(counts, (grid["_b"].to_numpy(np.int64), grid["_c"].fillna(many).to_numpy(np.int64)), grid["n"].to_numpy())
    # slots of a block that nobody before range q has as the first ideal, summed over the blocks
    later = np.cumsum(np.cumsum(counts[:, ::-1], axis=1)[:, ::-1], axis=0)
    at, skip = np.zeros(many + 1, np.int64), np.zeros(many + 1, np.int64)
    for q in range(many + 1):
        if behind[q]:
            at[q] = np.searchsorted(later[:, q], behind[q])
            skip[q] = behind[q] - (later[at[q] - 1, q] if at[q] else 0) if at[q] < blocks else -1
    to = np.minimum(at[1:], blocks - 1)
    return pd.DataFrame({"platform": pd.Series([key[0]] * many, dtype=object), "_q": np.arange(many), "_from": at[:-1], "_to": to, "_skip": skip[:-1]})


def _walk(key: tuple, posts: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
    """One range of posts (place, id, own, own_us, _skip) over the slots it meets (idx, us, claim)."""
    posts, slots = posts.sort_values("place"), slots.sort_values("idx")
    index, us, claim = slots["idx"].to_numpy(), slots["us"].to_numpy(), slots["claim"].fillna(np.inf).to_numpy()
    skip = int(posts["_skip"].iat[0]) if len(posts) else 0
    i = skip - 1 if skip >= 0 else len(index)
    reached = np.inf if skip < 0 else index[i] if skip else 0
    got = []
    for post in posts.itertuples():
        if post.own > reached:
            got.append(int(post.own_us))
            continue
        i += 1
        while i < len(index) and claim[i] < post.place:
            i += 1
        reached = index[i] if i < len(index) else np.inf
        got.append(int(us[i]) if i < len(index) else None)
    return pd.DataFrame({"platform": pd.Series([key[0]] * len(posts), dtype=object), "id": posts["id"].to_numpy(object), "us": pd.array(got, "Int64")})


def _numbered(rows: DataFrame, name: str, few: bool, platform: str, seq: str, *then: str) -> DataFrame:
    """Number each platform's rows from 1. One window ranks a platform only where all rows are few."""
    if few:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(platform).orderBy(seq, *then)).cast("long"))
    return places(rows, F.lit(0), seq, platform, then=then).withColumnRenamed("place", name)


def _dealt(placed: DataFrame, held: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Slots, once for each range (_q) whose walk meets them, and posts with the _skip of their range."""
    lost = placed.groupBy("platform", "_q").agg(F.count_if(F.col("own").isNull()).alias("n"))
    grid = held.groupBy("_p", "_b", "_c").agg(F.count("*").alias("n"))
    starts = lost.groupBy("platform").cogroup(grid.groupBy("_p")).applyInPandas(_starts, f"platform {kind}, _q long, _from long, _to long, _skip long")
    met = starts.filter("_from <= _to").select(F.col("platform").alias("_m"), "_q", F.explode(F.sequence("_from", "_to")).alias("_block"))
    slots = held.join(met, F.expr("_p <=> _m AND _b = _block")).filter("_c IS NULL OR _c >= _q")
    skips = starts.selectExpr("platform AS _m", "_q AS _r", "_skip")
    return slots, placed.join(skips, F.expr("platform <=> _m AND _q = _r"))


def assign_in_order(posts: DataFrame, calendar: DataFrame, taken: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """Give each post of a platform, by seq (a whole number, ties by id), its ideal instant if that is open, else the
    first open one; each use closes it. posts: platform, seq, id, ideal; calendar: platform, at (slots ahead); taken:
    platform, at. Returns platform, id, at; at is null once all slots are closed, or without a calendar. A null
    ideal is none; repeated slots are one; null platforms are one platform.

    The first post that has a slot as its ideal holds it, unless it is reached before by posts that fall back, and
    those take slots from the front. So after a post the walk has reached the k-th of the slots that no post so far
    holds as the first, k being the number of posts so far that aren't first for any slot: a count. Counts by range
    of posts and block of slots therefore tell where the walk stands before each range, and the ranges are walked
    by tasks of their own, each over the slots between its start and the next one's. A range's walk meets some three
    times as many slots as it has posts, and two blocks more, however many posts one platform or ideal has."""
    size, length = posts.count(), calendar.count()
    wide, deep = max(per_range, -(-size // RANGES)), max(per_range, -(-length // RANGES))
    placed = _numbered(posts.select("platform", "seq", "id", "ideal"), "place", size <= wide, "platform", "seq", "id")
    placed = placed.withColumn("_q", F.expr(f"(place - 1) div {wide}"))
    # slots have their platform under a name of their own: the calendar may be made from the posts' table
    free = calendar.select(F.col("platform").alias("_p"), "at").filter("at IS NOT NULL").distinct()
    closed = taken.select(F.col("platform").alias("_t"), F.col("at").alias("_at"))
    free = free.join(closed, F.expr("_p <=> _t AND at = _at"), "left_anti").withColumn("us", F.unix_micros("at"))
    free = _numbered(free, "idx", length <= deep, "_p", "us")
    firsts = placed.groupBy("platform", "ideal").agg(F.min("place").alias("claim"))
    held = free.join(firsts, F.expr("_p <=> platform AND at = ideal"), "left")
    held = held.select("_p", "idx", "us", "claim", F.expr(f"(idx - 1) div {deep}").alias("_b"), F.expr(f"(claim - 1) div {wide}").alias("_c"))
    # a post that is the first for a slot, by its place: no join on an ideal that a third of all posts may have
    own = held.filter("claim IS NOT NULL").selectExpr("_p", "claim", "idx AS own", "us AS own_us")
    placed = placed.join(own, F.expr("platform <=> _p AND place = claim"), "left").drop("_p", "claim")

    kinds = {c: posts.schema[c].dataType.simpleString() for c in ("platform", "id")}
    if size <= wide:  # one range a platform, which starts at the calendar's front
        slots, walked = held.withColumn("_q", F.lit(0).cast("long")), placed.withColumn("_skip", F.lit(0).cast("long"))
    else:
        slots, walked = _dealt(placed, held, kinds["platform"])
    slots = slots.select("_p", "_q", "idx", "us", "claim")
    walked = walked.select("platform", "_q", "place", "id", "own", "own_us", "_skip")
    found = walked.groupBy("platform", "_q").cogroup(slots.groupBy("_p", "_q")).applyInPandas(_walk, f"platform {kinds['platform']}, id {kinds['id']}, us long")
    return found.select("platform", "id", F.timestamp_micros("us").alias("at"))
