"""Rollups of opportunities, reviews and reports. Aggregates combine on the map side; no operator gathers
rows on the driver. Dimension tables are joined as they come, and Spark broadcasts those it finds small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.numbers import half_up

UNKNOWN = "Unknown"


def money(value: Column | str) -> Column:
    return F.round(F.sum(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0.0))), 2)


def count_if(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("long")


def with_stage(opportunities: DataFrame, stages: DataFrame) -> DataFrame:
    """Stage names by id; unknown ids and null get UNKNOWN."""
    return opportunities.join(stages, "stage_id", "left").withColumn("stage", F.coalesce("stage", F.lit(UNKNOWN)))


def stage_rollup(opportunities: DataFrame, stages: DataFrame) -> DataFrame:
    """(stage, n, value) of open opportunities. Sums run by stage id first, so names are joined to a few rows."""
    by_id = opportunities.filter(F.col("status") == "open").groupBy("stage_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("value"))
    return with_stage(by_id, stages).groupBy("stage").agg(F.sum("n").cast("long").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def snapshot(opportunities: DataFrame, now: Column) -> DataFrame:
    """One row of counts: open, new today (UTC day) and in seven times 24 hours, won and lost in these."""
    week = now - F.expr("INTERVAL 7 DAYS")
    of = lambda s: F.col("status") == s
    return opportunities.agg(
        count_if(of("open")).alias("open_count"),
        F.coalesce(money(F.when(of("open"), F.col("value"))), F.lit(0.0)).alias("total_value"),
        count_if(F.to_date("created") == F.to_date(now)).alias("new_today"),
        count_if(F.col("created") >= week).alias("new_this_week"),
        count_if(of("won") & (F.col("updated") >= week)).alias("won_this_week"),
        count_if(of("lost") & (F.col("updated") >= week)).alias("lost_this_week"),
    )


def counts_by(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name))


def pass_rate(rows: DataFrame, passed: Column, *keys: str) -> DataFrame:
    share = F.avg(passed.cast("int"))
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), count_if(passed).alias("passed"), half_up(share * 100).cast("long").alias("percent"))


def all_of(rows: DataFrame, condition: Column, *keys: str) -> DataFrame:
    """Does the condition hold for every row; true without rows."""
    return rows.groupBy(*keys).agg(F.coalesce(F.bool_and(condition), F.lit(True)).alias("resolved"))


def duplicates(rows: DataFrame, key: str, condition: Column) -> DataFrame:
    """Keys for which the condition holds more than once."""
    return rows.filter(condition).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def listed(rows: DataFrame, keys: list[str | Column], value: str, order: str, name: str = "items") -> DataFrame:
    """Each key's values in order, joined by a bar. A list is one value, so keys have to bound its length: a
    page of a city, not a city."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p["v"]), "|").alias(name))


def backlog_gate(pending: DataFrame, planned: int, cap: int, *keys: str) -> DataFrame:
    """(*keys, backlog, admitted): nothing is admitted if it would pass the cap."""
    return pending.groupBy(*keys).agg(F.count("*").alias("backlog")).withColumn("admitted", F.when(F.col("backlog") + planned > cap, 0).otherwise(planned).cast("long"))
