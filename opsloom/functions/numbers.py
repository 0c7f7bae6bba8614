"""Numbers and small labels made of them. Halves round up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def currency(x: Column) -> Column:
    """"$" and grouped digits; "$0" for what is no number."""
    return F.when(finite(x), F.concat(F.lit("$"), F.format_number(half_up(x), 0))).otherwise("$0")


def signed_change(now: Column, before: Column) -> Column:
    diff = now - before
    return F.when(diff == 0, "±0").when(diff > 0, F.concat(F.lit("+"), diff.cast("string"))).otherwise(diff.cast("string"))


def to_boolean(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


def to_number(text: Column) -> Column:
    """Empty text is 0; hexadecimal and exponents are read; else null. Null stays null."""
    plain = F.trim(text)
    hexadecimal = F.when(plain.rlike("^0[xX][0-9a-fA-F]{1,15}\\z"), F.conv(F.substr(plain, F.lit(3)), 16, 10).cast("double"))
    number = plain.try_cast("double")
    return F.when(plain == "", 0.0).otherwise(F.coalesce(hexadecimal, F.when(finite(number) & ~plain.rlike("[a-df-zA-DF-Z]"), number)))


def dirty_number(text: Column) -> Column:
    """Of sheet cells: null unless the whole cell is a number."""
    return F.trim(text).try_cast("double")


def headline_size(text: Column, short_canvas: Column) -> Column:
    base = F.when(F.length(text) <= 38, 84).when(F.length(text) <= 64, 68).otherwise(56)
    return F.when(short_canvas, half_up(base * 0.78)).otherwise(base).cast("long")


def uptime(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 3600), F.lit("h "), F.floor(s % 3600 / 60), F.lit("m "), s % 60, F.lit("s"))


def memory(rss: Column, heap: Column) -> Column:
    mb = lambda x: half_up(x / 1048576).cast("string")
    return F.concat(mb(rss), F.lit("MB RSS / "), mb(heap), F.lit("MB heap"))


def tier(score: Column) -> Column:
    return F.when(score >= 7.5, "top-priority").when(score >= 6.5, "strong").when(score >= 5.5, "probe-first").otherwise("low")


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def status_badge(name: Column, status: Column, latency: Column, detail: Column) -> Column:
    dot = F.when(status == "ok", "🟢").when(status == "down", "🔴").otherwise("⚪️")
    took = F.coalesce(F.concat(F.lit(" ("), latency.cast("string"), F.lit("ms)")), F.lit(""))
    return F.concat(dot, F.lit(" "), name, took, F.coalesce(F.concat(F.lit(" — "), F.nullif(detail, F.lit(""))), F.lit("")))
