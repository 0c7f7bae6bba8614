"""op13: exact dedup against plain Python, with and without the filter, and its edges."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from opsloom.llm import exact
from tests.llm.brute import documents

SCHEMA = "doc_id long, text string, keep_id string, _row int, kept string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def wanted(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    said = []
    for text, ids in groups.items():
        last = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0))):
            said.append((i, last, len(ids), k == len(ids) - 1, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(said, key=str)


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("most", [exact.MOST_BITS, 64, 4], ids=["filter", "crowded filter", "no filter"])
def test_equals_plain_python(spark, monkeypatch, most):
    monkeypatch.setattr(exact, "MOST_BITS", most)
    rng = random.Random(most)
    texts = ["", None, "Äpfel", "äpfel", "A b", "a B", "K", "K", "İ", "x" * 200_000, *(f"only {k}" for k in range(5))]
    rows = [(k if k % 9 else None, rng.choice(texts)) for k in range(12)] + [(3, "A b"), (3, "a b"), (3, "a b"), (None, "a b"), (None, None)]
    assert found(exact.verdicts(made(spark, rows))) == wanted(rows)


def test_large_groups_meet_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact, "FEW_ROWS", 10)
    rows = [(k, "Same" if k % 2 else f"text {k // 4}") for k in range(200)]
    assert found(exact.verdicts(made(spark, rows))) == wanted(rows)


def test_documents(spark, sf):
    assert found(exact.op13_exact_dedup(spark, sf)) == wanted(documents(spark, sf))


def test_survivors_are_whole_rows(spark):
    rows = [(1, "a", "p", 1, "q"), (2, "A", "r", 2, "s"), (None, "a", None, None, None), (4, "b", "t", 3, "u"), (5, None, "v", 4, "w"), (6, "", "x", 5, "y"), (6, "", "x", 5, "y")]
    left = exact.dedup(spark.createDataFrame(rows, SCHEMA))
    assert left.columns == ["doc_id", "text", "keep_id", "_row", "kept"]
    assert sorted(map(tuple, left.collect())) == [rows[1], rows[3], rows[6]]


def test_empty_table(spark):
    assert exact.verdicts(made(spark, [])).collect() == [] and exact.dedup(made(spark, [])).collect() == []


def test_filter_lets_every_copy_through(spark):
    """No copy is missed, and of 20,000 single texts few are called possible copies."""
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    copies = rows.limit(500)
    every = rows.unionByName(copies)
    bits = exact.filter_bits(20_500)
    flags = exact.flagged(every, "key", exact.twice_filter(every, "key", bits), bits).groupBy("_maybe").count().collect()
    n = {r["_maybe"]: r["count"] for r in flags}
    assert n[True] >= 1000 and n[True] - 1000 < 0.03 * 20_000
    twice = {r["key"] for r in copies.collect()}
    let_through = exact.flagged(every, "key", exact.twice_filter(every, "key", bits), bits).filter("_maybe").select("key").distinct().collect()
    assert twice <= {r["key"] for r in let_through}


def test_only_possible_copies_are_shuffled(spark, sf):
    """The plan has no Python, and no exchange carries texts."""
    plan = exact.op13_exact_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
    assert "text#" not in plan


@pytest.mark.parametrize("rows,bits", [(0, 1 << 16), (1 << 12, 1 << 16), (1 << 20, 1 << 24), (exact.MOST_BITS // 4, exact.MOST_BITS), (exact.MOST_BITS // 4 + 1, None)])
def test_filter_size_is_bounded(rows, bits):
    assert exact.filter_bits(rows) == bits
