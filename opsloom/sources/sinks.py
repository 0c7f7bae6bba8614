"""Reports, log lines and notes. Tables that grow by batches are in `ledger`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_report(lines: DataFrame, path: str, line: str = "line", order: str = "ord") -> None:
    """A report's few lines as one text file."""
    lines.orderBy(order).select(F.col(line).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def log_line(at: Column, level: Column, message: Column, **more: Column) -> Column:
    """One JSON log record."""
    return F.to_json(F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), level.alias("level"), message.alias("msg"), *(c.alias(k) for k, c in more.items())))


def alert(body: Column, most: int = 1800) -> Column:
    return F.substring(body, 1, most)


def front_matter(title: Column, day: Column, body: Column) -> Column:
    return F.concat(F.lit("---\ntitle: "), title, F.lit("\ndate: "), F.date_format(day, "yyyy-MM-dd"), F.lit("\n---\n\n"), body)
