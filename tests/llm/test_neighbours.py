"""Learned partitions on clustered vectors, with rows outside the sample, and on two levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.llm import neighbours


def clustered(n, clusters, seed=3, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size)) * 4
    return centres[np.arange(n) % clusters] + rng.normal(size=(n, size)) * 0.6


def recall(x, found, k):
    hits = 0
    for q, own in found.groupby("query_id"):
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(len(x)), -score))[:k]) & set(own.vec_id))
    return hits / (found.query_id.nunique() * k)


def searched(spark, x, k=20):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    return neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=k).toPandas()


def test_clustered_vectors_are_routed(spark, monkeypatch):
    """Ten clusters: recall of 0.9 with at most a third of the parts, most rows outside the sample."""
    monkeypatch.setattr(neighbours, "MOST_SAMPLE", 1500)
    monkeypatch.setattr(neighbours, "ROWS_PER_PART", 300)
    x = clustered(6000, 10)
    found = searched(spark, x)
    assert found.query_id.nunique() == 300 and found.parts.iloc[0] == 16
    assert found.probes.iloc[0] <= found.parts.iloc[0] / 3
    assert recall(x, found, 20) >= 0.9


@pytest.mark.parametrize("queries", [20_000, 7])
def test_two_levels(spark, monkeypatch, queries):
    """Four parts, each cut again: few of the final parts are searched, by several tasks a block too."""
    for name, value in (("MOST_PARTS", 4), ("ROWS_PER_PART", 100), ("MOST_SAMPLE", 1500), ("BLOCK_VALUES", 1 << 12), ("QUERIES", queries)):
        monkeypatch.setattr(neighbours, name, value)
    x = clustered(4000, 12)
    found = searched(spark, x, 10)
    assert 8 < found.parts.iloc[0] <= 16 and found.probes.iloc[0] <= found.parts.iloc[0] / 2
    assert recall(x, found, 10) >= 0.9
    assert not found.duplicated(["query_id", "vec_id"]).any() and (found.groupby("query_id")["rank"].max() == 10).all()


def test_probabilities_of_both_levels():
    rng = np.random.default_rng(0)
    router = neighbours.Router(rng.normal(size=(5, 3)), rng.normal(size=3), {1: (rng.normal(size=(5, 4)), rng.normal(size=4))})
    p = np.exp(router.logs(rng.normal(size=(7, 5))))
    assert router.parts == 6 == p.shape[1] and np.allclose(p.sum(1), 1)


def test_recall_with_rows_outside_the_sample(spark, monkeypatch):
    """On the given vectors, whose neighbours are hardly clustered, with an eighth of them in the sample."""
    monkeypatch.setattr(neighbours, "MOST_SAMPLE", 512)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.stack(rows.orderBy("vec_id").toPandas().embedding).astype(np.float64)
    found = neighbours.nearest(rows, F.col("vec_id") % 20 == 0).toPandas()
    ids = sorted(r["vec_id"] for r in rows.select("vec_id").collect())
    assert ids == list(range(ids[0], ids[0] + len(ids)))
    found[["query_id", "vec_id"]] -= ids[0]
    assert recall(x, found, 20) >= 0.9


def test_long_vectors_whose_products_cancel(spark):
    """What a matrix product rounds away is far more than what parts the scores."""
    x = clustered(900, 5)
    x[:, 0] = 2.0**26
    x[:, 3] = np.where(np.arange(900) % 2, 2.0**26, -(2.0**26))
    found = searched(spark, x, 10).sort_values(["query_id", "rank"])
    assert found.query_id.nunique() == 45
    for q, own in found.groupby("query_id"):
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(900), -score))[:10]
        assert own.vec_id.tolist() == best.tolist() and own.score.tolist() == score[best].tolist()
