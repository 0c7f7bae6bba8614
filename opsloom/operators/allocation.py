"""Fair allocation: round robin over groups, wrap-around chunks, calendar slots, ranked lists.

Rankings within a group carry a bound wherever only the first rows of it are asked for, so Spark limits
each group before the shuffle and a group that holds a third of all rows costs no more than others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions import dates


def round_robin(rows: DataFrame, group: str, seq: str, n: int, skip: int = 0) -> DataFrame:
    """One of each group per round, groups in the order of their first row, until n; the first `skip` of each
    group are passed over. Adds pos (from 1)."""
    own = Window.partitionBy(group).orderBy(seq)
    ranked = rows.withColumn("_rn", F.row_number().over(own)).filter(F.col("_rn") <= skip + n)
    firsts = ranked.filter("_rn = 1").select(F.col(group).alias("_g"), F.col(seq).alias("_first"))
    dealt = ranked.filter(F.col("_rn") > skip).join(firsts, F.col(group).eqNullSafe(F.col("_g"))).orderBy("_rn", "_first").limit(n)
    return dealt.withColumn("pos", F.row_number().over(Window.orderBy("_rn", "_first")).cast("long")).drop("_rn", "_g", "_first")


def wrap_chunks(rows: DataFrame, group: str, seq: str, days: int, per_day: int) -> DataFrame:
    """A round robin of days * per_day rows dealt to days in turn, from the start again if it is short."""
    queue = round_robin(rows, group, seq, days * per_day)
    sized = queue.withColumn("_n", F.count("*").over(Window.partitionBy()))
    places = F.explode(F.sequence(F.col("pos") - 1, F.lit(days * per_day - 1).cast("long"), F.col("_n")))
    spread = sized.withColumn("place", places)
    return spread.withColumns({"day": F.expr(f"place div {per_day}").cast("long"), "slot": (F.col("place") % per_day).cast("long")}).drop("_n", "place", "pos")


#: Calendar days whose texts are gathered into one row before they go to all later days.
BLOCK_DAYS = 64


def prior_days(rows: DataFrame, day: str, text: str) -> DataFrame:
    """Each day's list of the texts of all earlier days; a table of days. Days are listed by block, a block meets the lists of
    those before it, and only the days of one block share a window, so no task holds more than a few of the lists that come out."""
    blocked = rows.withColumn("_block", F.expr(f"datediff({day}, DATE'1970-01-01') div {BLOCK_DAYS}"))
    said = lambda rows: F.flatten(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["s"]))
    lists = blocked.filter(F.col(text).isNotNull()).groupBy("_block").agg(said(F.struct(F.col(day).alias("d"), F.array(text).alias("s"))).alias("_said"))
    before = lists.select(F.col("_block").alias("_b"), F.col("_said").alias("_s"))
    blocks = blocked.select("_block").distinct()
    earlier = blocks.join(before, F.col("_b") < F.col("_block")).groupBy("_block").agg(said(F.struct(F.col("_b").alias("d"), F.col("_s").alias("s"))).alias("_earlier"))
    own = Window.partitionBy("_block").orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    listed = blocked.withColumn("_own", F.collect_list(text).over(own)).join(earlier, "_block", "left")
    none = F.array().cast("array<string>")
    return listed.withColumn("before", F.array_join(F.concat(F.coalesce("_earlier", none), "_own"), "|")).drop("_block", "_own", "_earlier")


def slots(days: DataFrame, times: list[str], skip_sundays: bool = True) -> DataFrame:
    """(day, clock, at) of every slot of a table of days, clocks in order."""
    kept = days.filter(dates.weekday(F.col("day")) != 0) if skip_sundays else days
    clocked = kept.withColumn("clock", F.explode(F.array(*map(F.lit, sorted(times)))))
    return clocked.withColumn("at", dates.instant(F.col("day"), F.col("clock")))


def free_slots(days: DataFrame, times: list[str], taken: DataFrame, now: Column, skip_sundays: bool = True) -> DataFrame:
    """Slots of a platform's calendar more than five minutes ahead and not in taken (at)."""
    ahead = slots(days, times, skip_sundays).filter(F.col("at") > now + F.expr("INTERVAL 5 MINUTES"))
    return ahead.join(taken.select("at").distinct(), "at", "left_anti")


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n with pos (from 1)."""
    return rows.orderBy(*order).limit(n).withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long"))


#: Rows that one window task ranks, about, and ranges of scores by which they are dealt.
PER_BLOCK = 5000
RANGES = 200


def places(rows: DataFrame, score: Column, seq: str, *group: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Add place (from 1), best score first, then by seq (a whole number) and the columns `then`, within each group or over all rows.

    Rows are counted by score and block of seq, which is as wide as PER_BLOCK rows take on the whole, so that ids may be
    hashes. Sums of the blocks ahead give each block its base, and only rows of one block are ranked by a
    window. Counts are summed by range of scores first, so neither a score nor a group that a third of all rows share
    meets in one task, nor do the counts of all rows. Spark looks at the table once before, for its size, ids and ranges."""
    keyed = rows.withColumn("_score", score.cast("double"))
    shares = [k / RANGES for k in range(1, RANGES)]
    size = keyed.agg(F.count(seq).alias("n"), F.min(seq).alias("low"), F.max(seq).alias("high"), F.percentile_approx("_score", shares).alias("edges")).first()
    width = max(1, ((size["high"] or 0) - (size["low"] or 0) + 1) // max(1, -(-size["n"] // PER_BLOCK)))
    edges = F.array(*map(F.lit, sorted(set(size["edges"] or [])))).cast("array<double>")
    # null scores come last, in a range of their own
    at = F.when(F.col("_score").isNull(), RANGES).otherwise(F.size(F.filter(edges, lambda e: e > F.col("_score"))))
    keyed = keyed.withColumns({"_range": at, "_block": F.expr(f"(cast({seq} as decimal(38, 0)) - {size['low'] or 0}) div {width}")})
    blocks = [*group, "_range", "_score", "_block"]
    counts = keyed.groupBy(*blocks).agg(F.count("*").alias("_n"))
    before = lambda *keys: Window.partitionBy(*group, *keys).rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy(*group, "_range").agg(F.sum("_n").alias("_all"))
    ranges = ranges.select(*(F.col(c).alias(f"{c}_r") for c in (*group, "_range")), F.coalesce(F.sum("_all").over(before().orderBy("_range")), F.lit(0)).alias("_over"))
    own = F.coalesce(F.sum("_n").over(before("_range").orderBy(F.desc("_score"), "_block")), F.lit(0))
    bases = counts.withColumn("_own", own).join(ranges, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in (*group, "_range")])
    bases = bases.withColumn("_ahead", F.col("_own") + F.col("_over"))
    bases = bases.select(*(F.col(c).alias(f"{c}_b") for c in blocks), "_ahead")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in blocks]
    based = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy(*blocks).orderBy(seq, *then))).join(bases, same)
    return based.withColumn("place", (F.col("_ahead") + F.col("_rn")).cast("long")).select(*rows.columns, "place")


def in_lists(rows: DataFrame, score: str, seq: str, size: int) -> DataFrame:
    """Deal rows, best first, to lists of `size`: list, place, and each list's least score as watermark."""
    ranked = places(rows, F.col(score), seq).withColumn("list", F.expr(f"(place - 1) div {size} + 1").cast("long"))
    marks = ranked.groupBy("list").agg(F.min(score).alias("watermark"))
    return ranked.join(marks, "list")


def first_free(posts: DataFrame, free: DataFrame, seq: str, *group: str) -> DataFrame:
    """Each post of a group gets the first free instant that none before it took; free: (at), the calendar of
    each group, of some dozens. Posts beyond the calendar get none."""
    ranked = places(posts, F.lit(0), seq, *group)
    order = free.withColumn("place", F.row_number().over(Window.orderBy("at")).cast("long"))
    return ranked.join(F.broadcast(order), "place", "left")


def first_of_each(rows: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """The first row of each key. Kept as one aggregate, so repeated rows combine before the shuffle."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.withColumns(dict(zip(names, keys, strict=True)))
    best = keyed.groupBy(*names).agg(F.min_by(F.struct(*rows.columns), order).alias("_row"))
    return best.select("_row.*")


def latest_of_each(rows: DataFrame, key: str, order: Column) -> DataFrame:
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    return best.select("_row.*")


def company_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def phone_key(phone: Column) -> Column:
    return F.right(F.regexp_replace(phone, "[^0-9]", ""), F.lit(10))

