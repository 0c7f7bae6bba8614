"""How the workload's tables are found in the test tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-07-31 00:00:00"
STAGES = (("1-URGENT", "New"), ("2-HIGH", "Contacted"), ("3-MEDIUM", "Proposal"), ("4-NOT SPECIFIED", "Negotiation"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STAGES), "stage_id string, stage string")


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: O is open, F won, P lost."""
    return opportunities_of(read(spark, sf_dir, "orders"))


def opportunities_of(orders: DataFrame) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "won").otherwise("lost")
    at = F.col("o_orderdate").cast("timestamp")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), status.alias("status"), F.col("o_orderpriority").alias("stage_id"), at.alias("created"), at.alias("updated")
    )


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation as city; the balance makes a score of 0 to 10, one decimal."""
    score = F.floor((F.col("c_acctbal") + 1000) / 110 + 0.5) / 10
    cities = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    return read(spark, sf_dir, "customer").join(cities, "c_nationkey").select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"), "city", score.alias("score"))


def page(size: int, seq: str = "seq") -> Column:
    """Which page of `size` values of seq a row is on. A page is what a list, a sheet or a plan holds, so that no
    value grows with the table."""
    return F.floor(F.col(seq) / size).alias("page")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as drafts; labels make their fate."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("brand"), F.col("lang").alias("channel"))
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    fate = F.when(F.col("quality").isNull(), "pending").when((F.col("quality") == 1) & (F.col("toxic") == 0), "approved").otherwise("killed")
    return docs.join(labels, "doc_id", "left").select("doc_id", "brand", "channel", fate.alias("fate"))


def verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what reviewers do to a draft (the user's id)."""
    verb = F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "error", "kill").when(F.col("event_type") == "signup", "rewrite").otherwise("ignored")
    return read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("draft"), verb.alias("verb"), "value")


def as_text(query: Callable[[SparkSession, str], DataFrame], columns: Sequence[str]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with these columns as text."""
    if not columns:
        return query

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in columns})

    return run


def sql_as_text(sql: str, columns: Sequence[str]) -> str:
    casts = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})" if columns else sql


SQL_OPPORTUNITIES = """
o AS (SELECT o_orderkey AS id, o_totalprice AS value, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'won' ELSE 'lost' END AS status,
             o_orderpriority AS stage_id, o_orderdate AS created, o_orderdate AS updated FROM orders),
st AS (SELECT * FROM (VALUES ('1-URGENT','New'),('2-HIGH','Contacted'),('3-MEDIUM','Proposal'),('4-NOT SPECIFIED','Negotiation')) v(stage_id, stage))
"""
SQL_LEADS = "l AS (SELECT c_custkey AS seq, c_name AS name, n_name AS city, floor((c_acctbal + 1000) / 110 + 0.5) / 10 AS score FROM customer JOIN nation ON c_nationkey = n_nationkey)"
SQL_REVIEWS = """
r AS (SELECT d.doc_id, d.source AS brand, d.lang AS channel,
             CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 AND toxic = 0 THEN 'approved' ELSE 'killed' END AS fate
      FROM documents d LEFT JOIN labels USING (doc_id))
"""
SQL_VERBS = """
e AS (SELECT event_id, ts, user_id AS draft, value,
             CASE event_type WHEN 'click' THEN 'approve' WHEN 'error' THEN 'kill' WHEN 'signup' THEN 'rewrite' ELSE 'ignored' END AS verb FROM events)
"""
