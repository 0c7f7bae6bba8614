"""Hard-negative mining by product quantisation with stored residual norms.

Vectors are those of whole numbers, floor(256 * component). A codebook for every WIDTH dimensions, fitted on a bounded
sample, turns each row into one code a subspace, stored with the norm of what the codes leave out, its
residual. For an anchor, tables hold its product with each code's centre; a row's table entries add up to
a score that is off by the anchor's norm times the row's residual norm at most, as the product of two vectors
is bounded by that of their norms. So each row has a score that it surely reaches and one that it surely
doesn't pass; whoever can't be among the results by these is left out, and the others are scored exactly
in whole numbers. Every result is exact, whatever the codebooks are; they bear on speed alone.

Two searches, both in tasks for a block of rows and a block of anchors: the best rows of an anchor's own label
are its positives; then, for each positive, the best rows of other labels whose score lies in the window
below the positive's. Every task gives a few rows for each anchor or window, which are ranked together. Rows are dealt
to blocks by the hash of their id, so a label may hold any share of the rows.

Vectors that are null, without components, hold null or non-finite components or have another length than most,
rows without id or label, and rows whose whole numbers have a squared norm of 2**55 or more (components of some 700,000,
of which 100 times the score wouldn't fit in a long) take no part. Rows that repeat an id, label and vector
count once; with another label or vector they are rows of their own, but no row is a positive or negative of an anchor
with its id. Ties go to the smaller id. A negative positive score has an empty window. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsloom.llm.common import read, stored

SCALE = 256
WIDTH = 2
CENTRES = 256
MOST_SAMPLE = 4096
#: Rows and anchors that one task may hold; with less input blocks are smaller, so that there are some.
BLOCK_ROWS = (4096, 131_072)
BLOCK_ANCHORS = (1024, 32_768)
BLOCKS = 64
#: So many anchors are scored against a block at once.
STEP = 32


def padded(x: np.ndarray) -> np.ndarray:
    """Rows of whole subspaces: (rows, subspaces, WIDTH)."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH))).reshape(len(x), -1, WIDTH)


def codebooks(sample: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Centres of each subspace by k-means: (subspaces, centres, WIDTH)."""
    parts, rng = padded(sample.astype(np.float64)), np.random.default_rng(3)
    books = []
    for own in parts.transpose(1, 0, 2):
        kinds = np.unique(own, axis=0)
        centres = kinds[rng.permutation(len(kinds))[:CENTRES]]
        for _ in range(rounds):
            code = nearest_centre(own, centres)
            many = np.bincount(code, minlength=len(centres))
            sums = np.stack([np.bincount(code, column, len(centres)) for column in own.T], axis=1)
            centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres)
        books.append(np.pad(centres, ((0, CENTRES - len(centres)), (0, 0)), mode="edge"))
    return np.stack(books)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def encoded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, subspaces) and norms of the residuals, rounded up."""
    parts = padded(x.astype(np.float64))
    codes = np.stack([nearest_centre(parts[:, m], books[m]) for m in range(len(books))], axis=1).astype(np.uint8)
    left = parts - books[np.arange(len(books)), codes]
    return codes, np.sqrt((left**2).sum((1, 2))) * (1 + 1e-9) + 1e-9


def table_scores(anchors: np.ndarray, codes: np.ndarray, residuals: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores (rows, anchors) that a row surely reaches and surely doesn't pass."""
    tables = np.einsum("amw,mkw->mka", padded(anchors.astype(np.float64)), books)
    score = np.zeros((len(codes), len(anchors)))
    for table, code in zip(tables, codes.T, strict=True):
        score += table[code]
    off = residuals[:, None] * np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
    # what the sums of doubles may be off
    off += 1e-9 * (1 + np.abs(score) + off)
    # entries of different sign may cancel, so the rounding is that of their sizes
    off += 1e-12 * np.abs(tables).max(1).sum(0)
    return score - off, score + off


class Block:
    """A block of rows: each once, sorted by id."""

    def __init__(self, rows: pa.Table, books: np.ndarray):
        rows = rows.sort_by([("vec_id", "ascending"), ("label", "ascending")])
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        q = matrix(rows.column("q").combine_chunks())
        if (ids[1:] == ids[:-1]).any():
            seen = {(i, label, v.tobytes()): at for at, (i, label, v) in enumerate(zip(ids.tolist(), labels.tolist(), q, strict=True))}
            at = np.array(sorted(seen.values()))
            rows, ids, labels, q = rows.take(at), ids[at], labels[at], q[at]
        self.ids, self.labels, self.q, self.books = ids, labels, q, books
        codes = b"".join(rows.column("codes").to_pylist())
        self.codes = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
        self.residuals = rows.column("residual").to_numpy()

    def best(self, anchor_id: int, q: np.ndarray, near: np.ndarray, k: int, low=None, high=None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best of these rows by exact score, in a window if one is given, and how many were scored."""
        score = self.q[near] @ q
        fits = self.ids[near] != anchor_id
        if high is not None:
            fits &= (100 * score >= low) & (100 * score <= high)
        near, score, tried = near[fits], score[fits], len(near)
        order = np.lexsort((self.ids[near], -score))[:k]
        return self.ids[near][order], score[order], tried

    def positives(self, anchors: pa.Table, k: int) -> Iterator[tuple]:
        labels, ids = anchors.column("label").to_numpy(), anchors.column("anchor_id").to_numpy()
        keys, q = anchors.column("anchor_key").to_numpy(), matrix(anchors.column("q").combine_chunks())
        for label in np.unique(labels):
            own = np.flatnonzero(self.labels == label)
            asked = np.flatnonzero(labels == label)
            for at in range(0, asked.size if own.size else 0, STEP):
                some = asked[at : at + STEP]
                least, most = table_scores(q[some], self.codes[own], self.residuals[own], self.books)
                for j, a in enumerate(some.tolist()):
                    low, high = least[:, j], most[:, j]
                    # one more than k, as the anchor itself may be among them
                    edge = np.partition(low, -k - 1)[-k - 1] if own.size > k else -np.inf
                    found, score, tried = self.best(ids[a], q[a], own[high >= edge], k)
                    for vec_id, s in zip(found.tolist(), score.tolist(), strict=True):
                        yield int(ids[a]), int(keys[a]), vec_id, s, tried

    def negatives(self, anchors: pa.Table, k: int, percent: int) -> Iterator[tuple]:
        labels, ids = anchors.column("label").to_numpy(), anchors.column("anchor_id").to_numpy()
        keys, q, wanted = anchors.column("anchor_key").to_numpy(), matrix(anchors.column("q").combine_chunks()), anchors.column("wanted").to_pylist()
        for at in range(0, len(ids), STEP):
            least, most = table_scores(q[at : at + STEP], self.codes, self.residuals, self.books)
            for a in range(at, min(at + STEP, len(ids))):
                low, high = least[:, a - at], most[:, a - at]
                other = (self.labels != labels[a]) & (self.ids != ids[a])
                for w in wanted[a]:
                    top = w["score"]
                    if top < 0:
                        continue
                    floor = percent * top / 100
                    may = other & (high >= floor - 1) & (low <= top + 1)
                    sure = low[other & (low >= floor + 1) & (high <= top - 1)]
                    if sure.size > k:
                        may &= high >= np.partition(sure, -k)[-k]
                    found, score, tried = self.best(ids[a], q[a], np.flatnonzero(may), k, percent * top, 100 * top)
                    for vec_id, s in zip(found.tolist(), score.tolist(), strict=True):
                        yield int(ids[a]), int(keys[a]), w["place"], w["vec_id"], top, vec_id, s, tried


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def whole_numbers(vectors: DataFrame, label: Column, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, q) of the rows that take part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & label.isNotNull() & (F.size(vector) > 0) & good)
    exact = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    norm = F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(2.0)))
    # floor gives the largest long for what is larger still, so this filter comes out right beyond longs too
    rows = rows.filter(norm < float(1 << 55)).select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), exact.alias("q"))
    sizes = rows.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("q") == (sizes[0]["n"] if sizes else 1))


def _blocks(rows: int, bounds: tuple[int, int]) -> int:
    """Into how many blocks so many rows are dealt."""
    least, most = bounds
    return -(-rows // min(most, max(least, rows // BLOCKS))) or 1


def mine(vectors: DataFrame, is_anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), with scored: rows scored exactly for the
    window in the block that gave the row. is_anchor: a condition on vec_id."""
    spark = vectors.sparkSession
    rows = stored(whole_numbers(vectors, label, vec_id, vector), "whole-numbers")
    total = rows.count()
    every = -(-total // MOST_SAMPLE) or 1
    order = F.xxhash64(F.lit(3), "q")
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("q").distinct().orderBy(order, "q").limit(MOST_SAMPLE).toPandas()["q"]
    if not len(sample):  # so few rows that the hash took none
        sample = rows.select("q").distinct().orderBy(order, "q").limit(MOST_SAMPLE).toPandas()["q"]
    books = codebooks(np.array(sample.tolist(), np.int64)) if len(sample) else np.zeros((1, CENTRES, WIDTH))
    shared = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                codes, left = encoded(matrix(batch.column("q")), shared.value)
                made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], ["vec_id", "label", "q", "codes", "residual"])

    asked = rows.withColumnRenamed("vec_id", vec_id).filter(is_anchor).distinct().withColumnRenamed(vec_id, "anchor_id")
    anchors = stored(asked.withColumn("anchor_key", F.xxhash64("anchor_id", "label", "q")), "anchors")
    blocks, chunks = _blocks(total, BLOCK_ROWS), _blocks(anchors.count(), BLOCK_ANCHORS)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    index = stored(placed.drop("block").mapInArrow(encode, "vec_id long, label long, q array<long>, codes binary, residual double"), "codes")
    index = index.withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), "chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))})

    def dealt(asked: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("anchor_id", "anchor_key"), F.lit(chunks)).cast("int")
        return asked.withColumns({"chunk": own, "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})

    def searched(asked: DataFrame, schema: str, find) -> DataFrame:
        names = [field.split()[0] for field in schema.split(", ")]

        def run(asked: pa.Table, own: pa.Table) -> pa.Table:
            found = list(find(Block(own, shared.value), asked)) if asked.num_rows and own.num_rows else []
            return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(len(names))], names)

        keys = ("block", "chunk")
        return dealt(asked).groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(run, schema)

    found = searched(anchors, "anchor_id long, anchor_key long, vec_id long, score long, scored long", lambda block, asked: block.positives(asked, positives))
    best = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "vec_id")
    ranked = stored(found.withColumn("place", F.row_number().over(best).cast("long")).filter(F.col("place") <= positives).drop("scored"), "positives")
    wanted = ranked.groupBy("anchor_id", "anchor_key").agg(F.collect_list(F.struct("place", "vec_id", "score")).alias("wanted"))
    schema = "anchor_id long, anchor_key long, place long, positive_id long, positive_score long, negative_id long, negative_score long, scored long"
    found = searched(anchors.join(wanted, ["anchor_id", "anchor_key"]), schema, lambda block, asked: block.negatives(asked, negatives, percent))
    best = Window.partitionBy("anchor_id", "anchor_key", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "scored")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    shifted = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(read(spark, sf_dir, "embeddings"), vec_id % 100 == 0, shifted).drop("scored")


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS alike, CAST(list_dot_product(a.q, o.q) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 100 * score BETWEEN 80 * positive_score AND 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
