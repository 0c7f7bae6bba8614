"""Approximate nearest neighbours by learned partitions, on two levels.

On a bounded sample: a graph of nearest neighbours, cut into balanced parts by recursive spectral
bisection (each cut at the median of the second eigenvector), and a softmax classifier that learns, for
a vector, the parts of its neighbours. Where MOST_PARTS parts would still hold more than ROWS_PER_PART
rows each, every part is cut again in the same way, by a sample and a classifier of its own, so there are up to
MOST_PARTS * MOST_PARTS parts in the end, and a part's probability is the product of both levels. Every row is
indexed in its most probable part. A query goes to its most probable parts - as many as reach RECALL of
the true neighbours on the sample - and is reranked there by inner product in double precision.

Rows are searched in blocks of about BLOCK_VALUES components: small parts share one, parts with many rows,
such as copies of one vector, are dealt to several; a block that more than QUERIES queries go to is searched by
several tasks. A block gives a query its k best of all the parts in it, and the best of all blocks are
ranked together. Scores are summed in the same order wherever a row lies, so copies tie exactly and ties
go to the smaller id.

Vectors that are null, zero, without components, hold null or non-finite components or have another
length than most, and rows without id, take no part. Rows that repeat an id and vector count once; a
query never finds its own id. With fewer candidates than k, all that were found are returned. A table of
fewer than 2 * ROWS_PER_PART rows has one part, so its search is exact. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsloom.llm.common import read, stored

MOST_SAMPLE = 4096
ROWS_PER_PART = 500
MOST_PARTS = 64
DEGREE = 10
#: Aimed at on the sample; the promise is 0.9.
RECALL = 0.95
TRIALS = 256
BLOCK_VALUES = 1 << 20
QUERIES = 20_000


def sound(vector: str) -> Column:
    """Is every component a finite number and some of them not 0?"""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """For each row its nearest others by angle, in blocks of rows."""
    unit, near = _unit(x), []
    for at in range(0, len(x), 512):
        close = unit[at : at + 512] @ unit.T
        close[np.arange(len(close)), np.arange(at, at + len(close))] = -np.inf
        near.append(np.argpartition(-close, min(degree, len(x) - 1) - 1, axis=1)[:, :degree])
    return np.concatenate(near)


def balanced_parts(near: np.ndarray, parts: int) -> np.ndarray:
    """The graph's rows in `parts` (a power of two) parts whose sizes differ by a few."""
    n = len(near)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    rng = np.random.default_rng(2)
    for _ in range(parts.bit_length() - 1):
        inside = part[a] == part[b]
        u, v = a[inside], b[inside]
        degree = np.maximum(np.bincount(u, minlength=n), 1)
        value, sizes = rng.normal(size=n), np.bincount(part)
        for _ in range(60):
            # a lazy random walk within each part; taking out the mean leaves its slowest direction
            value = (value + np.bincount(u, value[v], n) / degree) / 2
            value -= (np.bincount(part, value) / sizes)[part]
            value /= np.sqrt(np.bincount(part, value**2) / sizes)[part] + 1e-12
        order = np.lexsort((value, part))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        part = 2 * part + (rank >= (sizes // 2)[part])
    return part


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _logs(unit: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = unit @ weights + bias
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def fit_parts(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut a sample into balanced parts and fit the classifier: weights and bias."""
    weights, bias = np.zeros((x.shape[1], parts)), np.zeros(parts)
    if parts == 1:
        return weights, bias
    near = neighbour_graph(x)
    part = balanced_parts(near, parts)
    aim = np.eye(parts)[part] * 0.5 + np.eye(parts)[part[near]].mean(1) * 0.5
    unit, step_w, step_b = _unit(x), np.zeros_like(weights), np.zeros(parts)
    for _ in range(300):
        error = (softmax(unit @ weights + bias) - aim) / len(x)
        step_w = 0.9 * step_w - 20.0 * (unit.T @ error + 1e-5 * weights)
        step_b = 0.9 * step_b - 20.0 * error.sum(0)
        weights, bias = weights + step_w, bias + step_b
    return weights, bias


def parts_for(rows: int, sample: int) -> int:
    """How many parts (a power of two) so many rows are cut into by a sample of this size."""
    parts = 1
    while parts < MOST_PARTS and 2 * parts * ROWS_PER_PART <= rows and 2 * parts * 4 * DEGREE <= sample:
        parts *= 2
    return parts


@dataclass
class Router:
    """Classifiers of both levels; below holds weights and bias for each part that is cut again. Final parts
    are numbered through. probes: how many of them a query goes to."""

    weights: np.ndarray
    bias: np.ndarray
    below: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    probes: int = 1

    @property
    def parts(self) -> int:
        return sum(len(self.below[k][1]) if k in self.below else 1 for k in range(len(self.bias)))

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of the final parts."""
        unit = _unit(x)
        top = _logs(unit, self.weights, self.bias)
        if not self.below:
            return top
        return np.concatenate([top[:, k : k + 1] + (_logs(unit, *self.below[k]) if k in self.below else 0.0) for k in range(top.shape[1])], axis=1)

    def tune(self, x: np.ndarray, k: int) -> None:
        """Find how many parts a query needs on a sample."""
        self.probes = 1
        if self.parts == 1:
            return
        home = np.concatenate([self.logs(x[at : at + 256]).argmax(1) for at in range(0, len(x), 256)])
        trial = np.unique(np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int))
        score = x[trial] @ x.T
        score[np.arange(len(trial)), trial] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        rank = np.argsort(np.argsort(-self.logs(x[trial]), axis=1, kind="stable"), axis=1)
        asked = np.sort(np.take_along_axis(rank, home[best], axis=1).ravel())
        self.probes = int(asked[min(asked.size - 1, int(np.ceil(RECALL * asked.size)) - 1)]) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def blocks_of(sizes: dict[int, int], rows: int) -> dict[int, list[int]]:
    """The blocks of each part: several parts share one of `rows` rows at most, a larger part has its own."""
    blocks, at, room = {}, -1, 0
    for part, n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        if n > rows:
            many = -(-n // rows)
            blocks[part], at, room = list(range(at + 1, at + 1 + many)), at + many, 0
            continue
        if n > room or at < 0:
            at, room = at + 1, rows
        blocks[part], room = [at], room - n
    return blocks


def _second_level(rows: DataFrame, router: Router, total: int, length: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Classifiers of the parts that hold more than ROWS_PER_PART rows, each fitted by one task on a bounded sample
    of its part."""
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = shared.value.logs(_matrix(batch.column("v"))).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("v"), batch.column("chosen")], ["part", "v", "chosen"])

    # all samples together hold MOST_SAMPLE vectors for each part, give or take the hash, and none more in the end
    every = -(-total // (MOST_SAMPLE * len(router.bias)))
    kind = f"part int, v {rows.schema['v'].dataType.simpleString()}, chosen boolean"
    homed = stored(rows.select("v", (F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).alias("chosen")).mapInArrow(home, kind), "homes")
    sizes = {r["part"]: r["count"] for r in homed.groupBy("part").count().collect()}  # MOST_PARTS rows at most

    wanted, most = {part: parts_for(n, MOST_SAMPLE) for part, n in sizes.items()}, MOST_SAMPLE

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        x = np.unique(_matrix(table.column("v").combine_chunks()), axis=0)
        x = x[np.random.default_rng(1).permutation(len(x))[:most]]
        part = key[0].as_py()
        parts = wanted[part]
        while parts > 1 and parts * 4 * DEGREE > len(x):
            parts //= 2
        weights, bias = fit_parts(x, parts)
        return pa.table({"part": pa.array([part], pa.int32()), "weights": [weights.tobytes()], "bias": [bias.tobytes()]})

    found = homed.filter("chosen").groupBy("part").applyInArrow(learn, "part int, weights binary, bias binary").collect()
    made = {r["part"]: (np.frombuffer(r["weights"]).reshape(length, -1), np.frombuffer(r["bias"])) for r in found}
    return {k: m for k, m in made.items() if len(m[1]) > 1}


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found, with probes (parts it was sent to) of parts."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), is_query.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & sound("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length, total = (sizes[0]["n"], sizes[0]["count"]) if sizes else (1, 0)
    rows = rows.filter(F.size("v") == length)
    every = -(-total // MOST_SAMPLE) or 1
    # a bounded sample: MOST_SAMPLE vectors, give or take the hash
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("v").distinct().toPandas()["v"]
    x = np.array(sorted(map(tuple, sample)), np.float64).reshape(-1, length)
    router = Router(*fit_parts(x, parts_for(total, len(x))))
    if len(router.bias) == MOST_PARTS and total >= 2 * MOST_PARTS * ROWS_PER_PART:
        router.below = _second_level(rows, router, total, length)
    router.tune(x, k)
    shared = spark.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                z = router.logs(_matrix(batch.column("v")))
                order = np.argsort(-z, axis=1, kind="stable")[:, : router.probes].astype(np.int32)
                asks = [o if q else None for o, q in zip(order.tolist(), batch.column("asks").to_pylist(), strict=True)]
                made = [pa.array(z.argmax(1).astype(np.int32)), pa.array(asks, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *made], ["vec_id", "v", "part", "goes"])

    kind = f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, v {vectors.schema[vector].dataType.simpleString()}, part int, goes array<int>"
    routed = stored(rows.mapInArrow(route, kind), "routed")
    sizes = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}  # MOST_PARTS ** 2 rows at most
    placed = [(part, own[0], len(own)) for part, own in blocks_of(sizes, max(1, BLOCK_VALUES // length)).items()]
    blocks = stored(spark.createDataFrame(placed, "part int, first int, many int"), "blocks")
    index = routed.select(F.col("vec_id").alias("own_id"), F.col("v").alias("w"), F.col("part").alias("own")).join(blocks.withColumnRenamed("part", "own"), "own")
    index = index.withColumn("block", F.col("first") + F.pmod(F.xxhash64("own_id"), F.col("many")).cast("int")).drop("first", "many")
    asked = routed.filter(F.col("goes").isNotNull()).select(F.col("vec_id").alias("query_id"), "v", F.explode("goes").alias("part")).join(blocks, "part")
    asked = asked.withColumn("block", F.explode(F.sequence("first", F.col("first") + F.col("many") - 1))).drop("first", "many")
    tasks = stored(asked.groupBy("block").agg(F.expr(f"cast(count(*) div {QUERIES} + 1 as int)").alias("tasks")), "search-tasks")
    queries = asked.join(tasks, "block").withColumn("task", F.pmod(F.xxhash64("query_id"), F.col("tasks")).cast("int")).drop("tasks")
    index = index.join(tasks, "block").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")

    def search(asked: pa.Table, indexed: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and indexed.num_rows:
            indexed = indexed.sort_by("own_id")
            ids, part = indexed.column("own_id").to_numpy(), indexed.column("own").to_numpy()
            at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            ids, part, base = ids[at], part[at], _matrix(indexed.column("w").combine_chunks())[at]
            query_ids, first, which = np.unique(asked.column("query_id").to_numpy(), return_index=True, return_inverse=True)
            whole = _matrix(asked.column("v").combine_chunks())[first]
            here, place = np.unique(part, return_inverse=True)
            goes = asked.column("part").to_numpy()
            known = np.isin(goes, here)
            open_ = np.zeros((len(query_ids), len(here)), bool)
            open_[which[known], np.searchsorted(here, goes[known])] = True
            norms = np.sqrt(np.einsum("ij,ij->i", base, base))
            for start in range(0, len(query_ids), 256):
                about = np.where(open_[start : start + 256][:, place], whole[start : start + 256] @ base.T, -np.inf)
                for i, line in enumerate(about):
                    name, vec = query_ids[start + i], whole[start + i]
                    line[ids == name] = -np.inf
                    # what may be among the best, whatever the rounding, which goes with the lengths and not with the product;
                    # then each score summed in one order
                    slack = (vec.size + 8) * np.finfo(float).eps * np.linalg.norm(vec) * norms
                    edge = np.partition(line - slack, -k)[-k] if line.size > k else -np.inf
                    near = np.flatnonzero((line + slack >= edge) & (line > -np.inf)) if np.isfinite(edge) else np.flatnonzero(line > -np.inf)
                    exact = (base[near] * vec).sum(axis=1)
                    best = np.lexsort((ids[near], -exact))[:k]
                    out.append((np.full(best.size, name, np.int64), ids[near][best].astype(np.int64), exact[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    found = queries.groupBy("block", "task").cogroup(index.groupBy("block", "task")).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.lit(router.probes).alias("probes"), F.lit(router.parts).alias("parts"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
