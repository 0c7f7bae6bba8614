"""Sheets by header, and lists against earlier lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.operators import allocation as A
from opsloom.operators import priors
from opsloom.plans import bindings as B
from opsloom.plans.workflow_queries import shared_folder
from opsloom.sources import connectors, ledger, sheets

#: Headers of the four makes, and for each which of a lead's cells are under them.
MAKES = (
    ("first_name,last_name,company_name,phone,email,website,google_rating,review_count,years_in_business,employee_count_estimate,city,outreach_angle,niche,score", (None, None, "name", "phone", None, None, None, None, None, None, "city", None, None, "score")),
    ("First Name,Last Name,Business Name,Email,Phone,Address,City,State,Postal Code,Tags,Notes", (None, None, "name", None, "phone", None, "city", None, None, None, None)),
    ("Phone,Notes,Website,Company Name,City,Postal Code", ("phone", None, None, "name", "city", None)),
    ("Company Name,Phone", ("patch", "patched")),
)
PER_SHEET = 40


def _sheets(spark, sf):
    """Customers as sheets of 40 lines: by turns of three makes, then a patch for the third one's phones."""
    k = F.col("seq")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    phone = lambda n: F.concat(F.lit("(702) "), F.lpad((n % 10_000_000).cast("string"), 7, "0"))
    said = {
        "name": quoted(F.concat("name", F.lit(', "Inc"'))),
        "phone": phone(k),
        "city": F.col("city"),
        "score": F.col("score").cast("string"),
        "patch": quoted(F.concat(F.lit("New, "), "name")),
        "patched": phone(k - PER_SHEET),
    }
    line = lambda made: F.concat_ws(",", *(F.lit("") if c is None else said[c] for c in made))
    leads = B.leads(spark, sf).withColumn("page", F.floor(k / PER_SHEET).cast("long"))
    kind = F.col("page") % len(MAKES)
    pick = lambda values: F.coalesce(*(F.when(kind == i, v) for i, v in enumerate(values)))
    lines = leads.select("page", k, pick([line(made) for _, made in MAKES]).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\r\n")
    head: Column = pick([F.lit(h) for h, _ in MAKES])
    pages = lines.groupBy("page").agg(body.alias("body"))
    folder = shared_folder(spark)
    connectors.write_bundle(pages.select(F.lit("sheet.csv").alias("name"), F.concat(head, F.lit("\r\n"), "body", F.lit("\r\n")).alias("content")), folder)
    return sheets.read_sheets(spark, f"{folder}/files")


def s18_by_header(spark, sf):
    return _sheets(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count("city").alias("cities"), F.count("score").alias("scores"), F.min("company_name").alias("first_name"))


def j10_patched_leads(spark, sf):
    return sheets.patched(_sheets(spark, sf)).select("kind", "company_name", "phone_key", "city", "patched")


LISTS = 3


def w13_prior_lists(spark, sf):
    """Parts as leads in three lists, of which none repeats a lead of an earlier one."""
    k = F.col("p_partkey")
    phone = F.concat(F.lit("(702) 555-"), F.lpad((k % 7).cast("string"), 4, "0"))
    key = F.concat_ws("|", A.company_key(F.col("p_name")), A.phone_key(phone))
    rows = B.read(spark, sf, "part").select("p_partkey", key.alias("key"), F.col("p_retailprice").alias("score"))
    schema = T.StructType([T.StructField("list", T.LongType()), *rows.schema.fields, T.StructField("watermark", T.DoubleType())])
    book = ledger.Ledger(spark, shared_folder(spark), schema)
    for n in range(LISTS):
        book.append(priors.next_list(book.rows(), rows.filter(k % LISTS == n), "key", ["p_partkey"], "score", n), n)
    return book.rows().select("list", "p_partkey", "watermark")


_PAGES = f"p AS (SELECT *, seq // {PER_SHEET} AS page, seq // {PER_SHEET} % 4 AS kind FROM l)"
_KINDS = "CASE kind WHEN 0 THEN 'research' WHEN 1 THEN 'import' WHEN 2 THEN 'import-12' ELSE 'patch' END"
_NAMED = """CASE WHEN kind = 3 THEN 'New, ' || name ELSE name || ', "Inc"' END"""

ORACLES = {
    "s18_by_header": f"""WITH {B.SQL_LEADS}, {_PAGES} SELECT {_KINDS} AS kind, count(*) AS n, count(CASE WHEN kind < 3 THEN city END) AS cities, count(CASE WHEN kind = 0 THEN score END) AS scores, min({_NAMED}) AS first_name FROM p GROUP BY p.kind""",
    "j10_patched_leads": f"""WITH {B.SQL_LEADS}, {_PAGES}
        SELECT {_KINDS.replace('kind WHEN', 'p.kind WHEN')} AS kind, CASE WHEN n.seq IS NOT NULL THEN 'New, ' || n.name ELSE p.name || ', "Inc"' END AS company_name, '702' || lpad(CAST(p.seq % 10000000 AS VARCHAR), 7, '0') AS phone_key, p.city, n.seq IS NOT NULL AS patched
        FROM p LEFT JOIN p n ON n.kind = 3 AND p.seq = n.seq - {PER_SHEET} WHERE p.kind < 3""",
    "w13_prior_lists": f"""WITH r AS (SELECT p_partkey, p_partkey % {LISTS} AS list, p_retailprice AS score, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || '|' || p_partkey % 7 AS key FROM part),
        k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY list, p_partkey) = 1)
        SELECT list, p_partkey, min(score) OVER (ORDER BY list RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS watermark FROM k""",
}
QUERIES = {k: globals()[k] for k in ORACLES}
