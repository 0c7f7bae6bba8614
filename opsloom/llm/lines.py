"""Line dedup by distinct-site spread.

Each line's sites go into a HyperLogLog sketch per line hash; partial sketches merge by aggregation.
Lines whose estimate is clearly above the threshold are boilerplate; those near it get an exact
distinct count. A boilerplate line stays in the document with the smallest id that has it and goes
from all others. Lines shorter than `min_chars` are never boilerplate.

A line that very many documents have meets its verdict by broadcast, where its rows lie; fewer than HEAVY_KEYS
lines can be such. Other lines are joined by shuffle. The places of a document's lines to remove come
together in one row; its text is then put together from the slices between them.

Null text stays null and has no lines; a null site is a site of its own; with a null id a document
keeps nothing on behalf of others. Rows that repeat an id count as one document. Lines that stay keep
their order. The made columns replace input columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.common import FEW_ROWS, HEAVY_KEYS, join_heavy, read, stored

SITES = 6
MIN_CHARS = 20
#: Sketches of 2**LG_K registers err by 1.6 % (one sigma); estimates within NEAR of the threshold are counted exactly.
LG_K = 12
NEAR = 0.25


def _split(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _long(line: Column, min_chars: int) -> Column:
    return F.length(line) >= min_chars


def line_hashes(docs: DataFrame, text: str, site: str, min_chars: int) -> DataFrame:
    """(doc_id, key, site, line, pos): a row for each line that can be boilerplate; hashes for text, site and
    line, and the line's place in its text."""
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), F.xxhash64(site).alias("site"), F.posexplode(_split(text)).alias("pos", "_line"))
    return rows.filter(_long(F.col("_line"), min_chars)).select("doc_id", "key", "site", F.xxhash64("_line").alias("line"), "pos")


def boilerplate(rows: DataFrame, sites: int = SITES) -> tuple[DataFrame, DataFrame]:
    """(line, keeper) of the lines that at least `sites` sites have, by hash, and of all lines the heavy ones."""
    total = rows.count()
    spread = rows.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc_id").alias("keeper"), F.count("*").alias("n"))
    about = F.hll_sketch_estimate("sketch")
    judged = spread.select("line", "keeper", about.alias("about"), ((F.col("n") > FEW_ROWS) & (F.col("n") * HEAVY_KEYS > total)).alias("heavy"))
    judged = stored(judged.filter((F.col("about") >= sites * (1 - NEAR)) | F.col("heavy")), "line-spread")
    heavy = judged.filter("heavy").select("line")
    near = judged.filter(F.col("about").between(sites * (1 - NEAR), sites * (1 + NEAR))).select("line", "keeper")
    clear = judged.filter(F.col("about") > sites * (1 + NEAR)).select("line", "keeper")
    # sites are made distinct before the shuffle, so a line that many documents have sends few rows
    here = join_heavy(rows.select("line", "site"), near, "line", heavy).groupBy("line", "keeper", "site").agg(F.lit(1).alias("one"))
    exact = here.groupBy("line", "keeper").agg(F.count("*").alias("exact")).filter(F.col("exact") >= sites)
    return stored(clear.unionByName(exact.select("line", "keeper")), "boilerplate"), heavy


def _without(lines: Column, gone: Column) -> Column:
    """Lines but for those at these sorted places: the slices between the places, so each line is copied once."""
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)

    def kept(lines: Column) -> Column:
        ends = F.concat(gone, F.array(F.size(lines)))
        return F.flatten(F.transform(ends, lambda end, i: F.slice(lines, begin(i) + 1, end - begin(i))))

    # a lambda's variable is worked out once, whatever is made of it
    return F.get(F.transform(F.array(lines), kept), 0)


def dedup_lines(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text cleaned, n_lines and n_removed (long)."""
    rows = stored(line_hashes(docs, text, site, min_chars), "lines")
    found, heavy = boilerplate(rows, sites)
    gone = join_heavy(rows.drop("site"), found, "line", heavy).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
    marked = docs.withColumn("_own", F.xxhash64(text)).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")), "left").drop("_id", "_key", "_own")
    touched = F.col("_gone").isNotNull()
    made = marked.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(_split(text))).cast("long"))
    made = made.withColumn("n_removed", F.when(touched, F.size("_gone")).otherwise(0).cast("long"))
    return made.withColumn(text, F.when(touched, F.array_join(_without(_split(text), F.col("_gone")), "\n")).otherwise(F.col(text))).drop("_gone")


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


OP8_SQL = """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS ln FROM documents),
b AS (SELECT ln, min(doc_id) AS keeper FROM l WHERE length(ln) >= 20 GROUP BY ln HAVING count(DISTINCT source) + max(CAST(source IS NULL AS INT)) >= 6),
g AS (SELECT l.doc_id, list(DISTINCT l.ln) AS gone FROM l JOIN b USING (ln) WHERE l.doc_id IS DISTINCT FROM b.keeper GROUP BY l.doc_id),
k AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS all_lines, g.gone,
         list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(g.gone, x)) AS kept
  FROM documents d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(all_lines), 0) AS BIGINT) AS n_lines,
       CAST(CASE WHEN gone IS NULL THEN 0 ELSE len(all_lines) - len(kept) END AS BIGINT) AS n_removed
FROM k
"""
