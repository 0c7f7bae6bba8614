"""op11: hard negatives against brute force, the bounds, and edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.llm import negatives

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, is_anchor):
    """rows: (id, label, vector), each once."""
    rows = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, label, v in rows]
    said = []
    for a, label, v in rows:
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, other, w in rows if i != a]
        for p, positive, _ in sorted(s for s in scored if s[2])[:5]:
            window = sorted(s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p)
            said += [(a, positive, k, i, -p, -s) for k, (s, i, _) in enumerate(window[:5], 1)]
    return sorted(said)


def mined(df, every=10, **more):
    found = negatives.mine(df, F.col("vec_id") % every == 0, F.col("label"), **more)
    return sorted(tuple(r[c] for c in COLUMNS) for r in found.collect())


def rows_of(seed, n, labels, length=6, kinds=None):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(length)] for _ in range(kinds or n)]
    return [(k, rng.randrange(labels), [float(np.float32(x + (0 if kinds else rng.gauss(0, 0.1)))) for x in centres[k % len(centres)]]) for k in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


@pytest.mark.parametrize("n,labels,length,kinds", [(300, 3, 6, None), (200, 2, 5, 4), (60, 60, 7, None), (80, 1, 3, None), (7, 2, 2, None)], ids=["usual", "copies that tie", "single labels", "one label", "few"])
def test_equals_brute_force(spark, monkeypatch, n, labels, length, kinds):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", (40, 64))
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", (4, 8))
    rows = rows_of(n, n, labels, length, kinds)
    assert mined(table(spark, rows)) == brute(rows, lambda i: i % 10 == 0)


def test_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = sorted(tuple(r[c] for c in COLUMNS) for r in negatives.op11_hard_negatives(spark, sf).collect())
    assert found == brute(rows, lambda i: i % 100 == 0) and found


def test_bad_codebooks_change_nothing(spark, monkeypatch):
    """Bounds hold whatever the centres are."""
    monkeypatch.setattr(negatives, "codebooks", lambda x: np.random.default_rng(1).normal(size=(-(-x.shape[1] // negatives.WIDTH), negatives.CENTRES, negatives.WIDTH)) * 1000)
    rows = rows_of(5, 150, 2)
    assert mined(table(spark, rows)) == brute(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("size", [1, 1e-9, 1e6])
def test_bounds_hold(size):
    rng = np.random.default_rng(4)
    x = np.floor(256 * size * rng.normal(size=(500, 9))).astype(np.int64)
    x[:5] = -x[5:10]
    books = negatives.codebooks(x[::3])
    codes, left = negatives.encoded(x, books)
    assert codes.shape == (500, 5) and codes.dtype == np.uint8
    low, high = negatives.table_scores(x[:40], codes, left, books)
    true = x @ x[:40].T
    assert (low <= true).all() and (true <= high).all()


def test_most_rows_are_left_out(spark):
    """Of vectors like the real ones the codes leave few to be scored."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64)) / 8
    df = table(spark, [(k, k % 4, v.tolist()) for k, v in enumerate(x)])
    found = negatives.mine(df, F.col("vec_id") % 400 == 0, F.col("label")).agg(F.avg("scored"), F.max("scored")).first()
    assert found[0] < 0.1 * 4000


def test_odd_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = rows_of(8, 40, 2, 3)
    bad = [(50, None, [1.0, 1.0, 1.0]), (60, 1, None), (70, 1, [1.0, None, 1.0]), (80, 1, [nan, 1.0, 1.0]), (90, 1, [inf, 1.0, 1.0]), (100, 1, [1.0, 1.0]), (110, 1, []), (None, 1, [1.0, 1.0, 1.0]), (120, 1, [3e38, 1.0, 1.0])]
    assert mined(table(spark, good + bad)) == brute(good, lambda i: i % 10 == 0)


def test_repeated_rows(spark):
    """A row that repeats whole counts once; with another label or vector it is a row of its own."""
    rows = rows_of(9, 40, 2, 3)
    other = [(5, 1 - rows[5][1], rows[5][2]), (6, rows[6][1], rows[7][2]), (20, rows[20][1], rows[3][2])]
    assert mined(table(spark, rows + rows[:7] + rows[10:11] + other)) == brute(rows + other, lambda i: i % 10 == 0)


def test_clashing_columns_and_empty_tables(spark):
    rows = rows_of(10, 30, 2, 3)
    df = table(spark, rows).withColumns({"block": F.lit("x"), "q": F.lit(1), "codes": F.lit(2), "chunk": F.lit(3), "anchor_id": F.lit(4), "score": F.lit(0)})
    assert mined(df) == brute(rows, lambda i: i % 10 == 0)
    assert mined(df.limit(0)) == [] and mined(table(spark, [(1, 1, None)])) == []
