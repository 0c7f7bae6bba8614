"""Rankings, allocation, dates and slots over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions import dates as D
from opsloom.functions import numbers as N
from opsloom.operators import allocation as A
from opsloom.operators import slotting
from opsloom.plans import bindings as B


def w01_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return A.round_robin(B.leads(spark, sf), "city", "seq", 40, skip=2).select("pos", "seq", "city")


def w02_wrap_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return A.wrap_chunks(B.leads(spark, sf), "city", "seq", 6, 4).select("day", "slot", "seq", "city")


def w03_top_leads(spark: SparkSession, sf: str) -> DataFrame:
    return A.top(B.leads(spark, sf), 30, F.desc("score"), F.col("seq")).select("pos", "seq", "score")


def _days(spark: SparkSession, start: str, n: int) -> DataFrame:
    return spark.range(n).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))


def w04_sorted_slots(spark: SparkSession, sf: str) -> DataFrame:
    return A.slots(_days(spark, "2001-07-30", 3), ["13:00", "09:00", "17:30"], False).select("day", "clock", "at")


def _taken(spark: SparkSession, sf: str) -> DataFrame:
    """Slots of a week that suppliers hold: mornings, but for one day on which they hold evenings."""
    day = F.date_add(F.lit("2001-07-30").cast("date"), (F.col("s_suppkey") % 7).cast("int"))
    clock = F.when(F.col("s_suppkey") % 7 == 4, "17:30").otherwise("09:00")
    return B.read(spark, sf, "supplier").select(D.instant(day, clock).alias("at"))


def w05_first_free_slot(spark: SparkSession, sf: str) -> DataFrame:
    free = A.free_slots(_days(spark, "2001-07-30", 31), ["13:00", "09:00"], _taken(spark, sf), B.now())
    return free.agg(F.min("at").alias("at"), F.count("*").alias("free"))


def w06_schedule(spark: SparkSession, sf: str) -> DataFrame:
    # plans of ten posts each, whose ideals are mornings that are distinct for the first, and contested later
    day = F.date_add(F.lit("2001-08-06").cast("date"), (F.col("s_suppkey") % 4).cast("int"))
    plan = F.concat(F.lit("plan "), F.floor(F.col("s_suppkey") / 10))
    posts = B.read(spark, sf, "supplier").select(plan.alias("platform"), F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("id"), D.instant(day, F.lit("09:00")).alias("ideal"))
    # each plan has a month's mornings and noons
    month = F.sequence(F.lit("2001-08-06").cast("date"), F.lit("2001-09-05").cast("date"))
    days = posts.select("platform").distinct().select("platform", F.explode(month).alias("day"))
    calendar = A.slots(days, ["09:00", "13:00"]).filter(F.col("at") > B.now()).select("platform", "at")
    taken = spark.createDataFrame([], "platform string, at timestamp")
    return slotting.assign_in_order(posts, calendar, taken).select("platform", "id", "at")


def w06_long_plans(spark: SparkSession, sf: str) -> DataFrame:
    # a plan a priority, whose calendars are the hours at which its orders' events lie and an hour a day beyond; hours of even suppliers are taken
    hour = lambda day, n: F.timestamp_seconds(F.unix_seconds(F.col(day).cast("timestamp")) + 3600 * n)
    orders = B.read(spark, sf, "orders").withColumnRenamed("o_orderpriority", "platform")
    key = F.col("o_orderkey")
    posts = orders.select("platform", key.alias("seq"), key.alias("id"), hour("o_orderdate", F.pmod(key, F.lit(3))).alias("ideal"))
    calendar = orders.select("platform", hour("o_orderdate", F.pmod(F.col("o_custkey"), F.lit(6))).alias("at"))
    taken = orders.filter("o_custkey % 11 = 0").select("platform", hour("o_orderdate", F.lit(1)).alias("at"))
    return slotting.assign_in_order(posts, calendar, taken, per_range=500).select("platform", "id", "at")


def w07_positions(spark: SparkSession, sf: str) -> DataFrame:
    approved = B.reviews(spark, sf).filter("fate = 'approved'")
    return A.places(approved, F.lit(0), "doc_id", "brand").select("doc_id", "brand", F.col("place").alias("pos"))


def w08_prior_days(spark: SparkSession, sf: str) -> DataFrame:
    days = B.opportunities(spark, sf).groupBy(F.to_date("created").alias("day")).agg(F.min("id").cast("string").alias("line"))
    return A.prior_days(days, "day", "line").select("day", "before")


def w09_first_by_prefix(spark: SparkSession, sf: str) -> DataFrame:
    p = B.read(spark, sf, "part").filter(F.lower("p_name").startswith("red"))
    return p.groupBy("p_type").agg(F.min_by("p_name", "p_partkey").alias("first_name"), F.min("p_partkey").alias("first_key"))


def w10_dial_order(spark: SparkSession, sf: str) -> DataFrame:
    return A.places(B.leads(spark, sf), F.col("score"), "seq", "city").select("seq", "city", F.col("place").alias("dial"))


def w11_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return B.leads(spark, sf).groupBy(N.tier(F.col("score")).alias("tier")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


def w12_lists(spark: SparkSession, sf: str) -> DataFrame:
    return A.in_lists(B.leads(spark, sf), "score", "seq", 30).select("list", "place", "seq", "watermark")


def w13_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.read(spark, sf, "part").select("p_partkey", "p_name", F.concat(F.lit("(702) 555-"), F.lpad((F.col("p_partkey") % 7).cast("string"), 4, "0")).alias("phone"))
    kept = A.first_of_each(rows, [A.company_key(F.col("p_name")), A.phone_key(F.col("phone"))], F.col("p_partkey"))
    return kept.select("p_partkey", "p_name")


def w15_first_rule(spark: SparkSession, sf: str) -> DataFrame:
    rules = ("small", "red", "blue")
    hits = F.filter(F.array(*map(F.lit, rules)), lambda r: F.contains(F.col("p_name"), r))
    return B.read(spark, sf, "part").select("p_partkey", F.get(hits, 0).alias("rule"))


def w16_newest_tag(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.read(spark, sf, "events").select(F.col("user_id").alias("contact"), F.col("event_id"), F.col("event_type").alias("tag"))
    return A.latest_of_each(rows, "contact", F.col("event_id")).select("contact", "tag")


def w17_top_five(spark: SparkSession, sf: str) -> DataFrame:
    best = A.top(B.leads(spark, sf), 5, F.desc("score"), F.col("seq"))
    return best.groupBy(N.tier(F.col("score")).alias("tier")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda p: p["name"]), ", ").alias("names"))


def d01_local_day(spark: SparkSession, sf: str) -> DataFrame:
    return B.verbs(spark, sf).groupBy(D.local_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


def d02_weekday(spark: SparkSession, sf: str) -> DataFrame:
    return B.opportunities(spark, sf).groupBy(D.weekday(F.to_date("created")).alias("weekday")).agg(F.count("*").alias("n"))


def d03_instants(spark: SparkSession, sf: str) -> DataFrame:
    days = B.opportunities(spark, sf).select(F.to_date("created").alias("day")).distinct()
    return days.select("day", D.instant(F.col("day"), F.lit("09:00")).alias("at"))


def d05_slot_label(spark: SparkSession, sf: str) -> DataFrame:
    days = B.opportunities(spark, sf).select("created").distinct()
    return days.select("created", D.slot_label(F.col("created") + F.expr("INTERVAL 20 HOURS")).alias("label"))


def d06_next_monday(spark: SparkSession, sf: str) -> DataFrame:
    days = B.opportunities(spark, sf).select(F.to_date("created").alias("day")).distinct()
    return days.select("day", D.next_monday(F.col("day")).alias("monday"))


def d08_deadlines(spark: SparkSession, sf: str) -> DataFrame:
    return B.opportunities(spark, sf).filter("status = 'open'").select("id", D.deadline(F.col("created"), 72).alias("due"), (D.deadline(F.col("created"), 72) - F.expr("INTERVAL 24 HOURS")).alias("reminder"))


def d10_week_days(spark: SparkSession, sf: str) -> DataFrame:
    mondays = B.opportunities(spark, sf).select(D.next_monday(F.to_date("created")).alias("monday")).distinct()
    return mondays.select("monday", F.posexplode(D.week_days(F.col("monday")))).select("monday", F.col("pos").cast("long").alias("n"), F.col("col").alias("day"))


def d11_human_days(spark: SparkSession, sf: str) -> DataFrame:
    return B.opportunities(spark, sf).select(F.to_date("created").alias("day")).distinct().select("day", D.human_day(F.col("day")).alias("label"))


L = B.SQL_LEADS
O = B.SQL_OPPORTUNITIES  # noqa: E741
LA = "AT TIME ZONE 'America/Los_Angeles'"
#: Wall clock -> instant and back, as timestamps without zone.
AT = "timezone('UTC', timezone('America/Los_Angeles', {}))"
TIER = "CASE WHEN score >= 7.5 THEN 'top-priority' WHEN score >= 6.5 THEN 'strong' WHEN score >= 5.5 THEN 'probe-first' ELSE 'low' END"
DAYS = "SELECT CAST(created AS DATE) AS day FROM o GROUP BY 1"

ORACLES = {
    "w01_round_robin": f"""WITH {L}, k AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY seq) AS rn, min(seq) OVER (PARTITION BY city) AS f FROM l)
        SELECT row_number() OVER (ORDER BY rn, f) AS pos, seq, city FROM k WHERE rn > 2 ORDER BY rn, f LIMIT 40""",
    "w02_wrap_chunks": f"""WITH {L}, k AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY seq) AS rn, min(seq) OVER (PARTITION BY city) AS f FROM l),
        q AS (SELECT seq, city, row_number() OVER (ORDER BY rn, f) - 1 AS i, count(*) OVER () AS n FROM k QUALIFY i < 24), p AS (SELECT unnest(range(24)) AS p)
        SELECT CAST(p // 4 AS BIGINT) AS day, CAST(p % 4 AS BIGINT) AS slot, seq, city FROM p JOIN q ON p % n = i""",
    "w03_top_leads": f"WITH {L} SELECT row_number() OVER (ORDER BY score DESC, seq) AS pos, seq, score FROM l ORDER BY score DESC, seq LIMIT 30",
    "w04_sorted_slots": f"SELECT day, clock, {AT.format('CAST(day || chr(32) || clock || chr(58) || 0 || 0 AS TIMESTAMP)')} AS at FROM (SELECT DATE '2001-07-30' + CAST(unnest(range(3)) AS INT) AS day) d CROSS JOIN (VALUES ('13:00'), ('09:00'), ('17:30')) c(clock)",
    "w05_first_free_slot": f"""WITH d AS (SELECT DATE '2001-07-30' + CAST(unnest(range(31)) AS INT) AS day), s AS (SELECT {AT.format("day + CAST(c AS TIME)")} AS at FROM d CROSS JOIN (VALUES ('13:00'), ('09:00')) c(c) WHERE dayofweek(day) <> 0),
        t AS (SELECT {AT.format("DATE '2001-07-30' + CAST(s_suppkey % 7 AS INT) + CASE WHEN s_suppkey % 7 = 4 THEN TIME '17:30' ELSE TIME '09:00' END")} AS at FROM supplier)
        SELECT min(s."at") AS "at", count(*) AS free FROM s WHERE s."at" > TIMESTAMP '2001-07-31 00:05:00' AND s."at" NOT IN (SELECT t."at" FROM t)""",
    "w06_schedule": f"""WITH RECURSIVE c AS (SELECT list(a ORDER BY a) AS cal FROM (SELECT {AT.format("d + t")} AS a FROM (SELECT DATE '2001-08-06' + CAST(unnest(range(31)) AS INT) AS d) CROSS JOIN (VALUES (TIME '09:00'), (TIME '13:00')) v(t) WHERE dayofweek(d) <> 0)),
        p AS (SELECT 'plan ' || s_suppkey // 10 AS platform, s_suppkey AS id, {AT.format("DATE '2001-08-06' + CAST(s_suppkey % 4 AS INT) + TIME '09:00'")} AS ideal, row_number() OVER (PARTITION BY s_suppkey // 10 ORDER BY s_suppkey) AS k FROM supplier),
        r AS (SELECT DISTINCT platform, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS TIMESTAMP) AS got, CAST([] AS TIMESTAMP[]) AS used FROM p
              UNION ALL SELECT platform, k, id, got, list_append(used, got) FROM (
                SELECT r.platform, p.k, p.id, r.used, CASE WHEN list_contains(cal, ideal) AND NOT list_contains(used, ideal) THEN ideal ELSE list_filter(cal, lambda x: NOT list_contains(used, x))[1] END AS got
                FROM r JOIN p ON p.platform = r.platform AND p.k = r.k + 1 CROSS JOIN c))
        SELECT platform, id, got AS "at" FROM r WHERE k > 0""",
    "w06_long_plans": """WITH RECURSIVE o AS (SELECT o_orderpriority AS platform, o_orderkey AS id, o_custkey AS cust, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders),
        f AS (SELECT DISTINCT platform, d + to_hours(cust % 6) AS a FROM o), t AS (SELECT DISTINCT platform, d + INTERVAL 1 HOUR AS a FROM o WHERE cust % 11 = 0),
        c AS (SELECT platform, list(a ORDER BY a) AS cal FROM (SELECT * FROM f EXCEPT SELECT * FROM t) GROUP BY 1),
        p AS (SELECT platform, id, d + to_hours(id % 3) AS ideal, row_number() OVER (PARTITION BY platform ORDER BY id) AS k FROM o),
        r AS (SELECT platform, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS TIMESTAMP) AS got, cal AS left_over FROM c
              UNION ALL SELECT platform, k, id, got, list_filter(left_over, lambda x: x <> got) FROM (
                SELECT r.platform, p.k, p.id, left_over, CASE WHEN list_contains(left_over, ideal) THEN ideal ELSE left_over[1] END AS got FROM r JOIN p ON p.platform = r.platform AND p.k = r.k + 1))
        SELECT platform, id, got AS "at" FROM r WHERE k > 0""",
    "w07_positions": f"WITH {B.SQL_REVIEWS} SELECT doc_id, brand, row_number() OVER (PARTITION BY brand ORDER BY doc_id) AS pos FROM r WHERE fate = 'approved'",
    "w08_prior_days": f"WITH {O}, d AS (SELECT CAST(created AS DATE) AS day, CAST(min(id) AS VARCHAR) AS line FROM o GROUP BY 1) SELECT day, coalesce(string_agg(line, '|') OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM d",
    "w09_first_by_prefix": "SELECT p_type, arg_min(p_name, p_partkey) AS first_name, min(p_partkey) AS first_key FROM part WHERE lower(p_name) LIKE 'red%' GROUP BY p_type",
    "w10_dial_order": f"WITH {L} SELECT seq, city, row_number() OVER (PARTITION BY city ORDER BY score DESC, seq) AS dial FROM l",
    "w11_tiers": f"WITH {L} SELECT {TIER} AS tier, count(*) AS n, min(score) AS low, max(score) AS high FROM l GROUP BY 1",
    "w12_lists": f"WITH {L}, p AS (SELECT seq, score, row_number() OVER (ORDER BY score DESC, seq) AS place FROM l) SELECT CAST((place - 1) // 30 + 1 AS BIGINT) AS list, place, seq, min(score) OVER (PARTITION BY (place - 1) // 30) AS watermark FROM p",
    "w13_dedup": "SELECT min(p_partkey) AS p_partkey, p_name FROM part GROUP BY p_name, p_partkey % 7",
    "w15_first_rule": "SELECT p_partkey, CASE WHEN contains(p_name, 'small') THEN 'small' WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'blue') THEN 'blue' END AS rule FROM part",
    "w16_newest_tag": "SELECT user_id AS contact, arg_max(event_type, event_id) AS tag FROM events GROUP BY 1",
    "w17_top_five": f"WITH {L}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS pos FROM l ORDER BY score DESC, seq LIMIT 5) SELECT {TIER} AS tier, string_agg(name, ', ' ORDER BY pos) AS names FROM t GROUP BY 1",
    "d01_local_day": f"SELECT CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1",
    "d02_weekday": f"WITH {O} SELECT dayofweek(created) AS weekday, count(*) AS n FROM o GROUP BY 1",
    "d03_instants": f"WITH {O}, d AS ({DAYS}) SELECT day, {AT.format('day + TIME ' + chr(39) + '09:00' + chr(39))} AS at FROM d",
    "d05_slot_label": f"""WITH {O}, d AS (SELECT DISTINCT created, timezone('America/Los_Angeles', timezone('UTC', created + INTERVAL 20 HOURS)) AS w FROM o)
        SELECT created, strftime(w, '%a, %b %-d, %-I:%M %p') || CASE WHEN date_diff('hour', created + INTERVAL 20 HOURS, w) = -7 THEN ' PDT' ELSE ' PST' END AS label FROM d""",
    "d06_next_monday": f"WITH {O}, d AS ({DAYS}) SELECT day, CAST(date_trunc('week', day) + INTERVAL 7 DAYS AS DATE) AS monday FROM d",
    "d08_deadlines": f"WITH {O} SELECT id, created + INTERVAL 72 HOURS AS due, created + INTERVAL 48 HOURS AS reminder FROM o WHERE status = 'open'",
    "d10_week_days": f"WITH {O}, m AS (SELECT DISTINCT CAST(date_trunc('week', created) + INTERVAL 7 DAYS AS DATE) AS monday FROM o) SELECT monday, n, CAST(monday + CAST(n AS INT) AS DATE) AS day FROM m CROSS JOIN (SELECT CAST(unnest(range(6)) AS BIGINT) AS n)",
    "d11_human_days": f"WITH {O}, d AS ({DAYS}) SELECT day, strftime(day, '%A, %B %-d') AS label FROM d",
}
#: Columns that hold dates or instants. Both engines return them as text, which is the same everywhere.
DATED = {
    "w04_sorted_slots": ("day", "at"), "w05_first_free_slot": ("at",), "w06_schedule": ("at",), "w06_long_plans": ("at",), "w08_prior_days": ("day",), "d01_local_day": ("day",), "d03_instants": ("day", "at"),
    "d05_slot_label": ("created",), "d06_next_monday": ("day", "monday"), "d08_deadlines": ("due", "reminder"), "d10_week_days": ("monday", "day"), "d11_human_days": ("day",),
}
QUERIES = {k: B.as_text(globals()[k], DATED.get(k, ())) for k in ORACLES}
ORACLES = {k: B.sql_as_text(q, DATED.get(k, ())) for k, q in ORACLES.items()}
