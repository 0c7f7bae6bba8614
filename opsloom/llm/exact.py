"""Exact dedup behind a Bloom filter, in DataFrame functions alone.

Texts are equal when they are identical after lower-casing A-Z only; null counts as empty. Of equal texts
the row with the largest id stays.

Two passes. The first turns each text into its SHA-256 and sets HASHES bits of a Bloom filter for it; a second
filter keeps the bits that more than one row has set. Both are sparse: the first is counts by bit, combined
before they are shuffled, the second 64-bit words of the bits that were set twice, of BITS_PER_ROW bits for
each row and MOST_BITS at most, so it has a proven bound (MOST_BITS / 64 words) and is broadcast. The second
pass looks each row up where it lies: a row of which some bit was set once only has no copy and passes straight
through; the others, copies and some false alarms, are grouped by digest. Beyond MOST_BITS / 4 rows the
filter would let too much through to be worth its while, so all digests are grouped; the result is the same. Texts
themselves are never shuffled for the verdicts, digests are.

A group of any size is one row after the partial aggregate. Rows of very large groups meet their group in a
broadcast of fewer than HEAVY_KEYS rows, the others by shuffle.

Rows without id count as smaller than any id. Of rows that repeat an id and have equal texts one stays: by the
hash of the text as it is, then whichever, which makes no difference to (id, text). Empty tables give empty
tables. The made columns replace input columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.common import FEW_ROWS, HEAVY_KEYS, read, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = 2
BITS_PER_ROW = 16
#: The largest filter: 4 million words, some 70 MB to send and some 250 in memory.
MOST_BITS = 1 << 28


def digest(text: Column) -> Column:
    """Lowercase hex of the SHA-256 of the normalised text."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256)


def filter_bits(rows: int) -> int | None:
    """Size of the filter for so many rows, a power of two; None where none is worth its while."""
    return None if rows > MOST_BITS // 4 else min(MOST_BITS, 1 << max(16, (BITS_PER_ROW * rows - 1).bit_length()))


def _bits(key: Column, bits: int) -> list[Column]:
    """The bits of a digest in a filter of this size."""
    return [F.xxhash64(F.lit(k), key).bitwiseAND(F.lit(bits - 1)) for k in range(HASHES)]


def twice_filter(digests: DataFrame, key: str, bits: int) -> DataFrame:
    """(word, set): the words of the filter that holds what was set by more than one row."""
    hits = digests.select(F.explode(F.array(*_bits(F.col(key), bits))).alias("bit"))
    twice = hits.groupBy("bit").count().filter("count > 1")
    return twice.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set"))


def flagged(rows: DataFrame, key: str, words: DataFrame | None, bits: int | None) -> DataFrame:
    """rows with _maybe: may the digest be that of another row as well?"""
    if words is None:
        return rows.withColumn("_maybe", F.lit(True))
    kept, every = rows.columns, F.lit(True)
    for k, bit in enumerate(_bits(F.col(key), bits)):
        own = F.broadcast(words.select(F.col("word").alias(f"_word{k}"), F.col("set").alias(f"_set{k}")))
        rows = rows.withColumn(f"_bit{k}", bit).join(own, F.shiftright(f"_bit{k}", 6) == F.col(f"_word{k}"), "left")
        every = every & F.coalesce(F.getbit(f"_set{k}", F.col(f"_bit{k}").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return rows.select(*kept, every.alias("_maybe"))


def _first_pass(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame | None, int | None]:
    """The digests of all rows, the filter and its size."""
    own = docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("text_sha256"), F.xxhash64(text).alias("_tie"))
    light = stored(own.withColumn("_row", F.monotonically_increasing_id()), "digests")
    bits = filter_bits(light.count())
    return light, None if bits is None else stored(twice_filter(light, "text_sha256", bits), "twice"), bits


def verdicts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    light, words, bits = _first_pass(docs, text, doc_id)
    rows = flagged(light, "text_sha256", words, bits)
    straight = rows.filter(~F.col("_maybe")).withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    maybe = rows.filter("_maybe").drop("_maybe")
    groups = maybe.groupBy(F.col("text_sha256").alias("_key")).agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "_tie", "_row")).alias("_last"))
    groups = stored(groups, "copies")
    large = groups.filter((F.col("group_size") > FEW_ROWS) & (F.col("group_size") * HEAVY_KEYS > light.count()))
    same = F.col("text_sha256") == F.col("_key")
    met = maybe.join(F.broadcast(large), same).unionByName(
        maybe.join(F.broadcast(large.select("_key")), same, "left_anti").join(groups.join(F.broadcast(large.select("_key")), "_key", "left_anti"), same)
    )
    met = met.withColumns({"keep_id": F.col("_last.doc_id"), "kept": F.col("_row") == F.col("_last._row")})
    made = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return straight.select(*made).unionByName(met.select(*made))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The whole rows of docs that stay. Rows without a possible copy pass straight through; of the others each
    task keeps one row of each digest before anything is shuffled."""
    light, words, bits = _first_pass(docs, text, doc_id)
    whole = docs.select(F.struct(*docs.columns).alias("_whole"), digest(F.col(text)).alias("_key"), F.struct(F.col(doc_id), F.xxhash64(text)).alias("_order"))
    rows = flagged(whole, "_key", words, bits)
    last = rows.filter("_maybe").groupBy("_key").agg(F.max_by("_whole", "_order").alias("_whole"))
    return rows.filter(~F.col("_maybe")).select("_whole.*").unionByName(last.select("_whole.*"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read(spark, sf_dir, "documents"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
