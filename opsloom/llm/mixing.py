"""Mixing sources to target weights by weighted fair queueing.

Sources share a budget of words by weight; none gets more than `repeats` times its size, and what it
would have got beyond that is shared again by weight. Within a source, documents stand in a fixed
shuffled order (by md5 of their id); a copy's virtual start and finish are the source's words before
and after it, divided by the source's target. Long copies of small sources are served in packets of at most
a thousandth of the source's target, each with its own finish, so that a source comes within that of its
target. All packets are sorted by virtual finish, by ranges of virtual time, and their words are added
up until the budget is spent: there the mix is cut. Of the copy that is being served then a part is taken.

Null text has size 0; a null source is a source of its own, the last; null ids stand at the start of
the order; rows with the same id and size share their place in any order, without effect on sums.
Empty tables and sources of size 0 take nothing. The made columns replace input columns of the same
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsloom.llm.common import read, stored, words

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
REPEATS = 2
#: A packet is of at most this part of its source's target, and of one word at least.
PACKETS = 1000
#: Rows of a source that one window task sorts.
ROWS_PER_BUCKET = 5000
#: Sources whose shares (some 50 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, source_rows) -> with target. Windows over all sources sort one short row for each in
    one task, some 50 bytes: ten million sources are half a gigabyte, which spills. Level: the words per unit of weight that sources below their cap get."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("double")
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    caps = ranked.withColumns({"w": weight, "cap": F.lit(float(repeats)) * F.col("source_size")})
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.lit(budget) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    leveled = caps.withColumn("level", level)
    reached = F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(every)
    # levels fall along this order once a source can take its own; that first one is the largest of those
    return leveled.withColumn("target", F.least(F.coalesce(reached, F.lit(float("inf"))) * F.col("w"), "cap")).select("source", "rank", "source_size", "source_rows", "target")


def _queued(rows: DataFrame, shares: DataFrame, few: bool, bases: DataFrame | None = None) -> DataFrame:
    """rows with their source's shares and range of the shuffled order; with the words ahead of each range
    also before, the words of the source ahead of a row."""
    placed = rows.join(F.broadcast(shares) if few else shares, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("_bucket", F.expr("_place * _buckets div 4294967296"))
    if bases is None:
        return placed
    own = Window.partitionBy("_rank", "_bucket").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.withColumn("_within", F.coalesce(F.sum("size").over(own), F.lit(0))).join(bases, ["_rank", "_bucket"])
    return counted.withColumn("before", F.col("_base") + F.col("_within"))


def _packets(queued: DataFrame, repeats: int, horizon: float) -> DataFrame:
    """(_rank, before, copy, begun, words, finish) of each packet that finishes by the horizon. Packets of a
    source begin every _packet words of a copy, so those that matter are its documents and some thousands."""
    copies = queued.filter((F.col("size") > 0) & (F.col("target") > 0)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn("_start", F.col("before") + F.col("copy") * F.col("source_size")).filter(F.col("_start") < F.lit(horizon) * F.col("target"))
    last = F.least(F.expr("(size - 1) div _packet"), F.ceil((F.lit(horizon) * F.col("target") - F.col("_start")) / F.col("_packet")))
    each = copies.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    begun = F.col("_start") + F.col("_k") * F.col("_packet")
    made = each.select("_rank", "before", "copy", "target", begun.alias("begun"), F.least("_packet", F.col("size") - F.col("_k") * F.col("_packet")).alias("words"))
    return made.withColumn("finish", (F.col("begun") + F.col("words")) / F.col("target")).filter(F.col("finish") <= horizon)


def _in_order(packets: DataFrame, blocks: int) -> DataFrame:
    """packets with ahead, the words of those before each by (finish, source, begun), and their block. Blocks
    are ranges of that whole order, so packets of many sources that finish together are in many blocks."""
    ranged = packets.repartitionByRange(blocks, "finish", "_rank", "begun").withColumn("_block", F.spark_partition_id())
    ranged = stored(ranged, "mix-order")
    earlier = F.sum("_held").over(Window.orderBy("_block")) - F.col("_held")
    bases = ranged.groupBy("_block").agg(F.sum("words").alias("_held")).select("_block", earlier.alias("_base"))
    within = F.sum("words").over(Window.partitionBy("_block").orderBy("finish", "_rank", "begun")) - F.col("words")
    return ranged.withColumn("_within", within).join(bases, "_block").withColumn("ahead", F.col("_base") + F.col("_within"))


def _cut(queued: DataFrame, repeats: int, budget: int, ranges: int) -> tuple[int, DataFrame]:
    """Sort packets by (finish, source, begun) in `ranges` ranges of virtual time, and add up their words until
    the budget is spent: the range in which that happens, and what of its packets is taken, by document and
    copy. Only that one range is sorted by row, in blocks of some ROWS_PER_BUCKET packets, however many finish at
    the same time."""
    end = (F.col("before") + F.col("size") + F.col("source_size") * (repeats - 1)) / F.col("target")
    last = queued.filter((F.col("size") > 0) & (F.col("target") > 0)).agg(F.max(end)).first()[0] or 0.0
    horizon = 2.0
    while True:
        packets = _packets(queued, repeats, horizon).withColumn("_range", F.floor(F.col("finish") * ranges))
        sums = stored(packets.groupBy("_range").agg(F.sum("words").alias("words"), F.count("*").alias("packets")), "mix-ranges")
        upto = sums.withColumn("upto", F.sum("words").over(Window.orderBy("_range")))
        over = upto.filter(F.col("upto") > budget).orderBy("_range").first()
        if over or horizon >= last:
            break
        horizon *= 2
    crossed, room, many = (over["_range"], budget - (over["upto"] - over["words"]), over["packets"]) if over else (1 << 62, 0, 0)
    within = _in_order(packets.filter(F.col("_range") == crossed), many // ROWS_PER_BUCKET + 1)
    within = within.withColumn("_taken", F.greatest(F.lit(0), F.least("words", F.lit(room) - F.col("ahead"))))
    parts = within.groupBy("_rank", "before").agg(*(F.sum(F.when(F.col("copy") == k, F.col("_taken")).otherwise(0)).alias(f"_cut{k}") for k in range(repeats)))
    return crossed, stored(parts, "mix-cut")


def schedule(docs: DataFrame, light: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """Add source_size, target, before (words of the source ahead of the document), finish (virtual finish of
    its first copy), served (words of each of its copies ahead of the cut) and taken (of all copies).
    docs: as measured() makes it; light: its (doc_id, source, size, _place), stored, from which the
    shares and the cut come, so that no long column is read or moved for them."""
    kept = [c for c in docs.columns if c.lower() not in MADE and c != "_place"]
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    shares = targets(sizes, weights, budget, repeats)
    packet = F.greatest(F.lit(1), F.floor(F.col("target") / PACKETS)).cast("long")
    shares = shares.select(F.col("source").alias("_source"), F.col("rank").alias("_rank"), "source_size", F.expr(f"source_rows div {ROWS_PER_BUCKET} + 1").alias("_buckets"), "target", packet.alias("_packet"))
    shares = stored(shares, "mix-shares")
    # the shuffled order in equal ranges, so that the words ahead of a row are those of earlier ranges and of its own
    few = shares.count() <= BROADCAST_ROWS
    ahead = Window.partitionBy("_rank").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = _queued(light, shares, few).groupBy("_rank", "_bucket").agg(F.sum("size").alias("_held"))
    bases = stored(bases.select("_rank", "_bucket", F.coalesce(F.sum("_held").over(ahead), F.lit(0)).alias("_base")), "mix-bases")
    queued = stored(_queued(light, shares, few, bases).select("_rank", "before", "size", "source_size", "target", "_packet"), "mix-queue")
    ranges = queued.count() * repeats // ROWS_PER_BUCKET + 1
    total = light.agg(F.sum("size")).first()[0] or 0
    crossed, parts = _cut(queued, repeats, int(budget * total), ranges)

    def served(k: int) -> Column:
        """Words of copy k in the ranges before the one of the cut, and its part there. Packets finish in order."""
        start = F.col("before") + F.lit(k) * F.col("source_size")
        end = lambda i: F.least("size", (i + 1) * F.col("_packet"))
        whole = lambda i: F.floor((start + end(i)) / F.col("target") * ranges) < crossed
        # what lies so far ahead or behind needs no look at its packets
        of_ranges = F.lit(float(crossed)) / ranges * F.col("target") - start
        low = F.greatest(F.lit(0), F.floor(of_ranges / F.col("_packet")) - 2).cast("long")
        high = F.least(F.expr("(size - 1) div _packet"), low + 4)
        near = F.when(low <= high, F.aggregate(F.sequence(low, F.greatest(low, high)), low * F.col("_packet"), lambda a, i: F.when(whole(i), end(i)).otherwise(a)))
        known = F.when(whole(F.expr("(size - 1) div _packet")), F.col("size")).otherwise(F.coalesce(near, F.lit(0)))
        return F.when((F.col("size") > 0) & (F.col("target") > 0), known + F.coalesce(F.col(f"_cut{k}"), F.lit(0))).otherwise(F.lit(0)).cast("long")

    rows = _queued(docs, shares, few, bases)
    rows = rows.join(F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts, ["_rank", "before"], "left")
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target"))
    made = rows.select(*kept, "size", "source_size", "target", "before", finish.alias("finish"), F.array(*(served(k) for k in range(repeats))).alias("served"))
    return made.withColumn("taken", F.aggregate("served", F.lit(0).cast("long"), lambda a, x: a + x))


MADE = ("size", "source_size", "target", "before", "finish", "served", "taken")


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """docs with size and place, and their (doc_id, source, size, _place), stored."""
    kept = [c for c in docs.columns if c.lower() not in MADE]
    place = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix"))), 1, 8), 16, 10).cast("long")
    rows = docs.select(*kept, words(text).alias("size"), place.alias("_place"))
    return rows, stored(rows.select("doc_id", "source", "size", "_place"), "mix-sizes")


def mix(docs: DataFrame, text: str = "text", weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: a row for each copy of which words are taken, whole, in order of virtual finish."""
    plan = schedule(*measured(docs, text), weights, budget, repeats)
    copies = plan.select("*", F.posexplode("served").alias("copy", "words")).filter("words > 0")
    finish = (F.col("before") + F.col("copy") * F.col("source_size") + F.col("size")) / F.col("target")
    return copies.withColumn("finish", finish).orderBy("finish", "source", "doc_id", "copy")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, light = measured(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return schedule(light, light).select("doc_id", "size", "source_size", "target", "taken", "finish")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 8) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(rk - 1) % 3 + 1] AS DOUBLE) AS w, 2.0 * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lvl
  FROM w WINDOW o AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, rk, source_size, least(max(CASE WHEN lvl <= cap / w THEN lvl END) OVER () * w, cap) AS target FROM l),
b AS MATERIALIZED (
  SELECT d.doc_id, t.rk, d.size, t.source_size, CAST(t.target AS DOUBLE) AS target, greatest(1, CAST(floor(t.target / 1000) AS BIGINT)) AS packet,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
         row_number() OVER () AS row_id
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, before + copy * source_size AS start FROM b CROSS JOIN (VALUES (0), (1)) v(copy) WHERE size > 0 AND target > 0),
p AS (SELECT row_id, rk, target, start + k * packet AS begun, least(packet, size - k * packet) AS words
      FROM (SELECT *, unnest(range((size - 1) // packet + 1)) AS k FROM c)),
q AS (SELECT *, CAST(begun + words AS DOUBLE) / target AS finish FROM p),
u AS (SELECT row_id, words, floor(1.5 * (SELECT sum(source_size) FROM s)) - (sum(words) OVER (ORDER BY finish, rk, begun ROWS UNBOUNDED PRECEDING) - words) AS room FROM q),
k AS (SELECT row_id, sum(greatest(0, least(words, room))) AS taken FROM u GROUP BY row_id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CASE WHEN target > 0 THEN CAST(before + size AS DOUBLE) / target END AS finish
FROM b LEFT JOIN k USING (row_id)
"""
