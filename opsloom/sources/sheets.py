"""Sheets of several makes, read by their headers.

File names don't tell what a sheet holds and columns come in any order, so each file's first line says where its columns
are. Headers are one short row a file, found where the file's first block is read; every other line meets the header of
its file in a join, and its cells are named by it. Four makes (research, import, import with websites, patches) become
one table; cells that a sheet doesn't have are null. Patches are keyed updates: a company's name by the last ten digits of a
phone.

Cells may be quoted, with doubled quotes inside, lines may end in CRLF, and a file may begin with a byte order mark. Blank
lines are left out, as are sheets whose header fits no make. Of a column that a header names twice the first counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions import text as X
from opsloom.sources.records import sheet_kind

#: A line has this many cells at most.
CELLS = 32
COLUMNS = (
    "first_name", "last_name", "company_name", "phone", "email", "website", "address", "city", "state", "postal_code", "tags", "notes",
    "google_rating", "review_count", "years_in_business", "employee_count_estimate", "outreach_angle", "niche", "score",
)
#: Other names of columns.
SAME = {"business_name": "company_name"}


def cells(line: Column) -> Column:
    """array<string> of a CSV line."""
    names = [f"c{k}" for k in range(CELLS)]
    read = F.from_csv(line, ", ".join(f"{n} string" for n in names), {"escape": '"', "mode": "PERMISSIVE"})
    return X.let(read, lambda r: F.array(*(r[n] for n in names)))


def column_names(header: Column) -> Column:
    """array<string>: the columns that a header names, in our own names."""
    plain = F.transform(cells(header), lambda c: F.regexp_replace(F.lower(F.trim(c)), "[ _-]+", "_"))
    return F.transform(plain, lambda c: F.coalesce(*(F.when(c == other, name) for other, name in SAME.items()), c))


def read_sheets(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, place, kind, one column for each of COLUMNS) of all rows of all sheets; place orders a file's rows."""
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), F.regexp_replace("value", "^﻿|\r$", "").alias("line")).filter(F.trim("line") != "")
    # the first block of each file is at 0; its lines are in order within their task
    heads = lines.filter("place.block = 0").groupBy("file").agg(F.min_by("line", "place").alias("header"))
    heads = heads.select(F.col("file").alias("_file"), "header", sheet_kind(F.col("header")).alias("kind"), column_names(F.col("header")).alias("_names"))
    rows = lines.join(heads.filter("kind <> 'unknown'"), F.col("file") == F.col("_file")).filter("line <> header")
    rows = rows.withColumn("_cells", cells(F.col("line")))
    named = lambda c: F.get("_cells", F.array_position("_names", F.lit(c)).cast("int") - 1)
    return rows.select("file", "place", "kind", *(F.when(F.array_contains("_names", c), F.nullif(F.trim(named(c)), F.lit(""))).alias(c) for c in COLUMNS))


def phone_key(phone: Column) -> Column:
    """The last ten digits; null with fewer."""
    digits = F.right(F.regexp_replace(phone, "[^0-9]", ""), F.lit(10))
    return F.when(F.length(digits) == 10, digits)


def patched(sheets: DataFrame) -> DataFrame:
    """Leads of all makes with phone_key, their names replaced where a patch has the phone; of several patches of a
    phone the last one counts, by file and place. Patches themselves are left out."""
    keyed = sheets.withColumn("phone_key", phone_key(F.col("phone")))
    last = keyed.filter("kind = 'patch' AND phone_key IS NOT NULL AND company_name IS NOT NULL")
    last = last.groupBy(F.col("phone_key").alias("_key")).agg(F.max_by("company_name", F.struct("file", "place")).alias("_name"))
    leads = keyed.filter("kind <> 'patch'").join(last, F.col("phone_key") == F.col("_key"), "left")
    return leads.withColumns({"company_name": F.coalesce("_name", "company_name"), "patched": F.col("_name").isNotNull()}).drop("_key", "_name")
