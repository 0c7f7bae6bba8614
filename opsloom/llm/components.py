"""Connected components of a table of links, without gathering any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import heavy, join_heavy, stored


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for each id in a link the smallest id that it reaches. Labels pass along links and
    then jump to their label's label, so a chain of n links takes about log n turns. Each turn is
    written to the shared folder, which cuts lineage. Links with a null end don't count.

    An id with very many links, or a label with very many ids, has its rows where they lie: its label comes
    by broadcast. What passes along links is reduced before it is shuffled."""
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna().filter("u <> v")
    both = stored(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    hubs = heavy(both.groupBy("u").agg(F.count("*").alias("n")), "u", both.count())
    while True:
        heard = join_heavy(both, labels.withColumnRenamed("id", "u"), "u", hubs).groupBy(F.col("v").alias("id")).agg(F.min("component").alias("heard"))
        passed = labels.join(heard, "id").select("id", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        passed = stored(passed, "labels")
        if not passed.filter("was <> component").limit(1).count():
            return labels
        crowds = heavy(passed.groupBy("component").agg(F.count("*").alias("n")), "component", passed.count())
        far = passed.select(F.col("id").alias("component"), F.col("component").alias("far"))
        jumped = join_heavy(passed.select("id", "component"), far, "component", crowds)
        labels = stored(jumped.select("id", F.least("component", "far").alias("component")), "labels")
