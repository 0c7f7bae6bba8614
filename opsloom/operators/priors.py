"""New lists against all earlier ones.

Every lead of an earlier list sets two bits in a Bloom filter, kept as 64-bit words by list; the filters of all
lists merge by an aggregate. A row with a bit that no list has set is surely new and passes straight through; only the
others, repeats and some false alarms, meet the earlier lists by an exact anti-join. The merged filter has at most
MOST_BITS / 64 words, which bounds what is broadcast; beyond MOST_BITS / 4 earlier leads all rows are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ROW = 16
MOST_BITS = 1 << 27


def bits_for(rows: int) -> int | None:
    """Size of the filter for so many leads, a power of two; None if it wouldn't pay."""
    return None if rows > MOST_BITS // 4 else min(MOST_BITS, 1 << max(12, (BITS_PER_ROW * rows - 1).bit_length()))


def _bits(key: Column, bits: int) -> list[Column]:
    return [F.xxhash64(F.lit(k), key).bitwiseAND(F.lit(bits - 1)) for k in range(2)]


def list_filters(prior: DataFrame, key: str, bits: int, by: str = "list") -> DataFrame:
    """(list, word, set): the filter of each list."""
    hits = prior.select(by, F.explode(F.array(*_bits(F.col(key), bits))).alias("_bit"))
    return hits.groupBy(by, F.shiftright("_bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("set"))


def merged(filters: DataFrame) -> DataFrame:
    """(word, set) of several lists' filters as one."""
    return filters.groupBy("word").agg(F.bit_or("set").alias("set"))


def maybe_known(rows: DataFrame, key: str, words: DataFrame, bits: int) -> DataFrame:
    """rows with _maybe: may an earlier list have the key?"""
    kept, every = rows.columns, F.lit(True)
    for k, bit in enumerate(_bits(F.col(key), bits)):
        own = F.broadcast(words.select(F.col("word").alias(f"_word{k}"), F.col("set").alias(f"_set{k}")))
        rows = rows.withColumn(f"_bit{k}", bit).join(own, F.shiftright(f"_bit{k}", 6) == F.col(f"_word{k}"), "left")
        every = every & F.coalesce(F.getbit(f"_set{k}", F.col(f"_bit{k}").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return rows.select(*kept, every.alias("_maybe"))


def fresh(rows: DataFrame, prior: DataFrame, key: str, by: str = "list") -> DataFrame:
    """The rows whose key no earlier list has. prior: (list, key, ...). Rows without key are new."""
    bits = bits_for(prior.count())
    known = prior.select(F.col(key).alias("_known")).filter("_known IS NOT NULL")
    if bits is None:
        return rows.join(known, F.col(key) == F.col("_known"), "left_anti")
    flagged = maybe_known(rows, key, merged(list_filters(prior.filter(F.col(key).isNotNull()), key, bits, by)), bits)
    new = flagged.filter(~F.col("_maybe") | F.col(key).isNull()).drop("_maybe")
    return new.unionByName(flagged.filter(F.col("_maybe") & F.col(key).isNotNull()).drop("_maybe").join(known, F.col(key) == F.col("_known"), "left_anti"))


def next_list(prior: DataFrame, candidates: DataFrame, key: str, order: list[str], score: str, number: int) -> DataFrame:
    """The next list after those in prior (list, watermark, ...), which should be a table that is read: each key of the
    candidates that no earlier list has, once, by order. watermark: the least score that this or any earlier list
    took, carried on from list to list."""
    firsts = candidates.groupBy(key).agg(F.min_by(F.struct(*candidates.columns), F.struct(*order)).alias("_row")).select("_row.*")
    taken = fresh(firsts, prior, key)
    low = taken.agg(F.min(score).alias("_own")).join(prior.agg(F.min("watermark").alias("_before")))  # one row each
    made = taken.join(F.broadcast(low)).withColumns({"list": F.lit(number).cast("long"), "watermark": F.least("_own", "_before")})
    return made.select(*prior.columns)
