"""Texts against rules that are rows of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import rulebook
from opsloom.plans import bindings as B


def _rules(spark, sf):
    """A rule for each benchmark passage that begins with two plain words: these words in a row."""
    first = F.regexp_extract_all("text", F.lit("^[A-Za-z]+ [A-Za-z]+"), F.lit(0))
    rows = B.read(spark, sf, "benchmark").select(F.col("item_id").alias("rule_id"), F.get(first, 0).alias("said")).filter("said is not null")
    return rows.select("rule_id", rulebook.phrase(F.split("said", " ")).alias("pattern"))


def _docs(spark, sf):
    return B.read(spark, sf, "documents").select("doc_id", "text")


def j09_rule_table(spark, sf):
    return rulebook.rule_hits(_docs(spark, sf), "doc_id", "text", _rules(spark, sf))


def f04_blocked_by_rules(spark, sf):
    return rulebook.blocked(_docs(spark, sf), "doc_id", "text", _rules(spark, sf))


def a16_counts_by_rule(spark, sf):
    return rulebook.counts(_docs(spark, sf), "doc_id", "text", _rules(spark, sf))


_HITS = r"""
p AS (SELECT item_id AS rule_id, '(?i)' || replace(regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+'), ' ', '[ \n]+') AS pattern FROM benchmark WHERE regexp_matches(text, '^[A-Za-z]+ [A-Za-z]+')),
h AS (SELECT doc_id, rule_id, CAST(len(regexp_extract_all(text, pattern)) AS BIGINT) AS hits FROM documents CROSS JOIN p),
j AS (SELECT * FROM h WHERE hits > 0)
"""

ORACLES = {
    "j09_rule_table": f"WITH {_HITS} SELECT doc_id, rule_id, hits FROM j",
    "f04_blocked_by_rules": f"WITH {_HITS} SELECT doc_id, min(rule_id) AS blocked_by FROM documents LEFT JOIN j USING (doc_id) GROUP BY doc_id",
    "a16_counts_by_rule": f"WITH {_HITS} SELECT rule_id, CAST(coalesce(sum(hits), 0) AS BIGINT) AS n, count(hits) AS texts FROM p LEFT JOIN j USING (rule_id) GROUP BY rule_id",
}
QUERIES = {k: globals()[k] for k in ORACLES}
