"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words are hashed to BUCKETS rows; each has a fixed sparse random index vector, and its word vector is
the sum of the index vectors of its neighbours over all documents, scaled to length 1. Shapes
(case, digits, symbols, repetition of the word before) are words of their own. A document is the mean
of its word vectors beside the mean of its shape vectors. A network of two layers in numpy gives a
logit, and a temperature fitted on rows kept from its training makes it a probability.

Word vectors need no labels. The network is fitted on labelled rows only, MOST_TRAINING documents at most, chosen by hash of their id, and never
on those whose crc32(id) mod 5 is 0; every document is scored, whole. Null and empty texts score what
the network gives for a document without words. Very long texts are pooled in pieces of some hundred
kilobytes, cut at white space, whose sums are added; a word at a cut has the neighbours of its own piece. Rows without label take no part in fitting; of a
document labelled twice the larger label counts, and of the texts of a repeated id the one with the smallest hash. With labels of one kind, or none, every score is the
share of label 1 (1 without labels). Repeated rows score alike. Columns named like an output are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.bytewords import Words, groups, words_of
from opsloom.llm.common import read, row_slices, stored

BUCKETS = 1 << 15
SHAPES = 64
SIZE = 48
NEIGHBOURS = 2
MOST_TRAINING = 8000
FOLDS = 5
HIDDEN = 32
THRESHOLD = 0.3
#: Documents are pooled about so many bytes at a time.
_STEP = 1 << 19
#: Rows of the word vectors that are added up together.
_ROWS = 32
#: Tasks that sum what texts say about word vectors; with fewer splits, as many as there are splits.
PARTIALS = 1 << 13


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _index_vectors() -> np.ndarray:
    """Four entries of 1 or -1 in each row."""
    rng = np.random.default_rng(5)
    rows = np.zeros((BUCKETS + SHAPES, SIZE), np.float32)
    at = rng.integers(0, SIZE, (len(rows), 4))
    np.put_along_axis(rows, at, rng.choice(np.array([-1, 1], np.float32), at.shape), 1)
    return rows


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word's row and its shape's row."""
    if not w.start.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = w.hashes()
    raw = w.raw
    kinds = (
        (raw >= 0x41) & (raw <= 0x5A),
        (raw >= 0x61) & (raw <= 0x7A) | (raw >= 0x80),
        (raw >= 0x30) & (raw <= 0x39),
        (raw >= 0x21) & (raw < 0x80) & ~((raw >= 0x30) & (raw <= 0x39)) & ~((raw | 0x20) >= 0x61) & (raw != 0x2C) & (raw != 0x2E),
    )
    shape = np.zeros(h.size, np.int64)
    for k, kind in enumerate(kinds):
        so_far = np.concatenate([[0], np.cumsum(kind)])
        shape |= ((so_far[w.start + w.length] - so_far[w.start]) > (k == 0)).astype(np.int64) << k
    # upper case counts from two letters on, so that a sentence's first word is like others
    again = np.zeros(h.size, bool)
    again[1:] = h[1:] == h[:-1]
    firsts = w.first[:-1]
    again[firsts[firsts < h.size]] = False
    shape |= again.astype(np.int64) << 4 | (w.length <= 2).astype(np.int64) << 5
    return (h % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + shape


class Context:
    """What texts say about word vectors, as whole numbers: for each word the entries of its neighbours' index
    vectors and counts of its neighbours' shapes, for each shape counts of its neighbours' shapes. Neighbours are
    mutual, so the words around a shape are the shapes around words, read the other way."""

    def __init__(self) -> None:
        self.index = _index_vectors()
        entries = np.argsort(self.index[:BUCKETS] == 0, axis=1, kind="stable")[:, :4]
        # an index vector with fewer than four entries has zeros among these
        self.places, self.signs = entries.astype(np.int32), np.take_along_axis(self.index[:BUCKETS], entries, 1)
        self.words = np.zeros((BUCKETS, SIZE))
        self.shapes_of_words = np.zeros((BUCKETS, SHAPES))
        self.shapes = np.zeros((SHAPES, SHAPES))

    def add(self, texts: list[str | None]) -> None:
        for _, held in groups(texts, _STEP):
            self._add(held)

    def _add(self, texts: list[str]) -> None:
        w = words_of(texts)
        word, shape = _tokens(w)
        word, shape = word.astype(np.int32), (shape - BUCKETS).astype(np.int32)
        text = np.repeat(np.arange(len(w.first) - 1, dtype=np.int32), np.diff(w.first))
        left = [np.flatnonzero(text[step:] == text[:-step]) for step in range(1, NEIGHBOURS + 1)]
        right = [at + step for step, at in enumerate(left, 1)]
        # each of two neighbours is the one, and the other one's neighbour
        one, other = np.concatenate([*left, *right]), np.concatenate([*right, *left])
        self.shapes += _counts(shape[one] * SHAPES + shape[other], self.shapes.shape)
        self.shapes_of_words += _counts(word[one] * SHAPES + shape[other], self.shapes_of_words.shape)
        near = word[other]
        self.words += _counts((word[one][:, None] * SIZE + self.places[near]).ravel(), self.words.shape, self.signs[near].ravel())

    def sums(self) -> np.ndarray:
        """A row for each word and each shape."""
        words, shapes = self.index[:BUCKETS].astype(float), self.index[BUCKETS:].astype(float)
        return np.concatenate([self.words + self.shapes_of_words @ shapes, self.shapes_of_words.T @ words + self.shapes @ shapes])


def _counts(at: np.ndarray, shape: tuple[int, int], weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(at, weights, shape[0] * shape[1]).reshape(shape)


def word_vectors(texts: DataFrame, text: str) -> np.ndarray:
    """Sums of neighbours over all texts, added up by slices of rows; each vector of length 1. Splits are read
    by PARTIALS tasks at most, so what is shuffled has a bound: PARTIALS tables of some 6 MB."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = None
        for whole in batches:
            for batch in row_slices(whole, text, _STEP):
                context = context or Context()
                context.add(batch.column(text).to_pylist())
        if context:
            yield slices(context.sums())

    def slices(sums: np.ndarray) -> pa.RecordBatch:
        """Of the rows that aren't zero, each slice's places and sums."""
        used = np.flatnonzero(sums.any(1))
        found = np.split(used, np.flatnonzero(np.diff(used // _ROWS)) + 1) if used.size else []
        at = [rows.astype(np.int32).tobytes() for rows in found]
        parts = [sums[rows].astype(np.float32).tobytes() for rows in found]
        return pa.RecordBatch.from_arrays([pa.array([rows[0] // _ROWS for rows in found], pa.int32()), pa.array(at, pa.binary()), pa.array(parts, pa.binary())], ["slice", "rows", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sums are of whole numbers, so their order doesn't matter
        sums = np.zeros((BUCKETS + SHAPES, SIZE))
        for batch in batches:
            for at, part in zip(batch.column("rows").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                sums[np.frombuffer(at, np.int32)] += np.frombuffer(part, np.float32).reshape(-1, SIZE)
        yield slices(sums)

    kind = "slice int, rows binary, sums binary"
    # each slice is added up by one task, as it is read
    found = texts.select(text).coalesce(PARTIALS).mapInArrow(partial, kind).repartition("slice").mapInArrow(total, kind).collect()
    vectors = np.zeros((BUCKETS + SHAPES, SIZE), np.float32)
    for r in found:
        vectors[np.frombuffer(r["rows"], np.int32)] = np.frombuffer(r["sums"], np.float32).reshape(-1, SIZE)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row for each text: mean word vector and mean shape vector."""
    sums, many = np.zeros((len(texts), 2 * SIZE)), np.zeros(len(texts), np.int64)
    for owners, held in groups(texts, _STEP):
        w = words_of(held)
        counts = np.diff(w.first)
        full = np.flatnonzero(counts)
        if not full.size:
            continue
        whose = np.array(owners)[full]
        np.add.at(many, whose, counts[full])
        for k, rows in enumerate(_tokens(w)):
            np.add.at(sums[:, k * SIZE : (k + 1) * SIZE], whose, np.add.reduceat(vectors[rows], w.first[full], axis=0))
    return (sums / np.maximum(many, 1)[:, None]).astype(np.float32)


@dataclass
class Network:
    """Standardised input, one hidden layer, a logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 80) -> Network:
    """Adam on the log loss over four fifths; the temperature by the rest."""
    rng = np.random.default_rng(3)
    x, y = x.astype(np.float64), y.astype(np.float64)
    order = rng.permutation(len(y))
    kept, train = order[: len(y) // 5], order[len(y) // 5 :]
    if len(set(y[train])) < 2:
        train = order
    a, t = x[train], y[train]
    net = Network(a.mean(0), a.std(0) + 1e-6, rng.normal(0, 1, (x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(t.mean() / (1 - t.mean()))))
    z = (a - net.mean) / net.scale
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(t)), max(1, len(t) // 64)):
            hidden = np.tanh(z[part] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-(hidden @ weights[2] + weights[3][0]))) - t[part]) / len(part)
            back = error[:, None] * weights[2] * (1 - hidden**2)
            slopes = [z[part].T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ error + 1e-4 * weights[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    if len(kept):
        logit, said = net.logits(x[kept]), y[kept]
        loss = lambda temp: np.logaddexp(0, np.where(said == 1, -1, 1) * logit / temp).mean()
        net.temperature = min(np.geomspace(0.5, 8, 60), key=loss)
    return net


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[np.ndarray, Network | None, float]:
    """Word vectors, network (None without labels of both kinds) and the share of label 1."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    every = -(-known.count() // MOST_TRAINING) or 1
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    # the choice is bounded (MOST_TRAINING ids, give or take the hash), so it may be broadcast
    held = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    # of a repeated id the text with the smallest hash, so that reruns learn from the same ones
    rows = stored(held.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).repartition(8, "doc_id"), "quality-training")
    vectors = word_vectors(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text", _STEP):
                means = pooled(batch.column("text").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([m.tobytes() for m in means], pa.binary())], ["doc_id", "quality", "means"])

    schema = T.StructType([rows.schema["doc_id"], rows.schema["quality"], T.StructField("means", T.BinaryType())])
    found = sorted(rows.mapInArrow(pool, schema).collect(), key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in found])
    share = float(y.mean()) if len(y) else 1.0
    if not 0 < share < 1:
        return vectors, None, share
    return vectors, fit(np.stack([np.frombuffer(r["means"], np.float32) for r in found]), y), share


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs with score (double)."""
    vectors, net, share = train(docs, labels, text)
    fields = [f for f in docs.schema.fields if f.name.lower() != "score"]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, text, _STEP):
                table, judge = shared.value
                scores = judge.scores(pooled(batch.column(text).to_pylist(), table)) if judge else np.full(batch.num_rows, share)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(scores, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
