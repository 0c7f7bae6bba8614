"""Documents to token ids in five stages; each works on all that the one before kept.

Stages take (spark, docs, sf_dir) and return the columns of documents, the last one its own. Between
stages documents are written as Parquet in the shared folder and read again. Every case that a stage's
operator defines (nulls, empty and long texts, repeated rows, empty tables) holds for the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import bpe, jaccard, lines, mixing, quality
from opsloom.llm.common import read, stored

#: SQL cannot express the classifier, the similarity join or the tokenizer; tests hold run() against
#: brute force instead.
ORACLE_SQL = None


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """These columns, and the whole row beside them, out of reach of what an operator adds."""
    return docs.select(*columns, F.struct(*(F.col(c) for c in docs.columns)).alias("_row"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    scored = quality.score_quality(docs.withColumnRenamed("score", "_score"), read(spark, sf_dir, "labels"))
    return scored.filter(F.col("score") >= quality.THRESHOLD).drop("score").withColumnRenamed("_score", "score").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; one that had no others goes."""
    cleaned = lines.dedup_lines(_packed(docs, "doc_id", "source", "text"))
    cleaned = cleaned.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(F.col("_row.n_chars"))
    return cleaned.select(*(changed.get(c, F.col(f"_row.{c}")).alias(c) for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near duplicates connect, the one with the smallest id; all without id. A document whose
    id several rows have is kept with all its texts, each set of shingles once: of rows with an equal one, that with
    the least hash of its text, then of the whole row."""
    groups = jaccard.jaccard_rows(docs.select("doc_id", "text"))
    firsts = groups.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id", "s1", "s2").agg(F.min("key").alias("_key")).select("doc_id", "_key")
    keyed = docs.select("doc_id", jaccard.text_key("text"), F.xxhash64(*docs.columns).alias("_hash"), F.struct(*docs.columns).alias("_row"))
    kept = keyed.join(firsts, ["doc_id", "_key"], "left_semi").groupBy("doc_id", "_key").agg(F.min_by("_row", "_hash").alias("_row"))
    return kept.select("_row.*").unionByName(docs.filter(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix serves, in its order."""
    return mixing.mix(_packed(docs, "doc_id", "source", "text")).select("_row.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    decoded = bpe.encode(docs.select("doc_id", "source", "text"), decoded=True)
    return decoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
