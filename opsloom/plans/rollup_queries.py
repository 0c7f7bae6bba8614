"""Rollups, filters, joins and set operations over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions import numbers as N
from opsloom.functions import text as X
from opsloom.operators import rollups as R
from opsloom.operators import rules, state
from opsloom.plans import bindings as B

BLOCKED = ("theer", "onin the", " und der ")


def a01_stage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return R.stage_rollup(B.opportunities(spark, sf), B.stages(spark))


def a02_pipeline_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return R.snapshot(B.opportunities(spark, sf), B.now())


def a03_fate_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.counts_by(B.reviews(spark, sf), "fate")


def a04_pass_rate(spark: SparkSession, sf: str) -> DataFrame:
    return R.pass_rate(B.reviews(spark, sf), F.col("fate") == "approved", "brand")


def a05_clean_flagged(spark: SparkSession, sf: str) -> DataFrame:
    text = B.read(spark, sf, "documents").select(F.size(rules.long_sentences(F.col("text"), 20)).alias("n"))
    return text.agg(R.count_if(F.col("n") == 0).alias("clean"), R.count_if(F.col("n") > 0).alias("flagged"))


def a06_distinct_cities(spark: SparkSession, sf: str) -> DataFrame:
    return B.leads(spark, sf).groupBy("city").agg(F.min("seq").alias("first_seen"))


def a07_lists(spark: SparkSession, sf: str) -> DataFrame:
    return R.listed(B.leads(spark, sf), ["city", B.page(100)], "name", "seq")


def a08_status_classes(spark: SparkSession, sf: str) -> DataFrame:
    # two of the statuses count as dormant
    return B.opportunities(spark, sf).agg(R.count_if(F.col("status") == "open").alias("active"), R.count_if(F.col("status").isin("won", "lost")).alias("dormant"))


def a10_all_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return R.all_of(B.reviews(spark, sf), F.col("fate") != "pending", "brand")


def a12_rows_per_file(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.size(F.split("text", "\n", -1)).cast("long")
    return B.read(spark, sf, "documents").rollup("source").agg(F.sum(lines).alias("lines"), F.count("*").alias("docs"))


def a13_checks_ok(spark: SparkSession, sf: str) -> DataFrame:
    return B.reviews(spark, sf).agg(R.count_if(F.col("fate") == "approved").alias("ok"), F.count("*").alias("total"))


def a14_backlog_gate(spark: SparkSession, sf: str) -> DataFrame:
    return R.backlog_gate(B.reviews(spark, sf).filter("fate = 'pending'"), 5, 6)


def a15_totals(spark: SparkSession, sf: str) -> DataFrame:
    return B.reviews(spark, sf).groupBy("channel").agg(R.count_if(F.col("fate") == "approved").alias("approved"), R.count_if(F.col("fate") == "killed").alias("killed"))


def a17_city_tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    return B.leads(spark, sf).groupBy("city", N.tier(F.col("score")).alias("tier")).agg(F.count("*").alias("n"))


def a18_duplicate_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return R.duplicates(B.reviews(spark, sf), "brand", F.col("fate") == "approved")


def a19_parse_accounting(spark: SparkSession, sf: str) -> DataFrame:
    kinds = B.read(spark, sf, "events").select(F.try_element_at(F.from_json("props", "map<string,int>"), F.lit("k")).alias("k"))
    return kinds.agg(F.count("*").alias("parsed"), R.count_if(F.col("k").isNull()).alias("skipped"), R.count_if(F.col("k") < 50).alias("entities"), R.count_if(F.col("k") >= 50).alias("relations"))


def f05_blocked_partition(spark: SparkSession, sf: str) -> DataFrame:
    docs = B.read(spark, sf, "documents").select("doc_id", F.concat_ws("\n", "source", "lang", "text").alias("haystack"))
    return docs.select("doc_id", rules.first_block(F.col("haystack"), BLOCKED).alias("pattern"))


def f06_open_recent(spark: SparkSession, sf: str) -> DataFrame:
    week = B.now() - F.expr("INTERVAL 7 DAYS")
    return B.opportunities(spark, sf).filter((F.col("status") == "open") & (F.col("created") >= week)).select("id", "stage_id")


def f09_find_lead(spark: SparkSession, sf: str) -> DataFrame:
    best = B.leads(spark, sf).orderBy(F.desc("score"), "seq").limit(30)
    return best.filter(F.contains(F.lower("name"), F.lit("00001"))).orderBy(F.desc("score"), "seq").limit(1)


def f10_due(spark: SparkSession, sf: str) -> DataFrame:
    queue = B.opportunities(spark, sf).select(
        "id",
        F.when(F.col("status") == "open", "queued").when(F.col("status") == "won", "posted").otherwise("held").alias("status"),
        (F.col("id") % 5).cast("int").alias("attempts"),
        F.col("created").alias("slot_at"),
    )
    return state.due(queue, B.now()).select("id", "status", F.col("attempts").cast("long").alias("attempts"))


def f11_lapsed(spark: SparkSession, sf: str) -> DataFrame:
    pending = B.opportunities(spark, sf).filter("status = 'open'").select("id", F.col("created").alias("created_at"))
    return pending.groupBy(state.lapsed(pending, B.now(), 72).alias("lapsed")).agg(F.count("*").alias("n"))


def f14_image_less(spark: SparkSession, sf: str) -> DataFrame:
    r = B.reviews(spark, sf).withColumn("image", F.when(F.col("doc_id") % 3 > 0, F.concat(F.col("doc_id"), F.lit(".jpg"))))
    return r.filter((F.col("fate") == "approved") & F.col("channel").isin("fr", "de") & F.col("image").isNull()).select("doc_id", "channel")


def f16_valid_requests(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("turn")
    email = F.when(turn == 0, F.concat(F.lit("c"), F.col("conv_id"), F.lit("@mail.example"))).when(turn == 1, F.concat(F.lit("c"), F.col("conv_id"), F.lit("@mail")))
    asked = B.read(spark, sf, "conversations").select(F.col("text").alias("name"), email.alias("email"), F.when(F.col("role") != "assistant", "5550100").alias("phone"))
    faults = rules.request_faults(F.col("name"), F.col("email"), F.col("phone"))
    return asked.groupBy(F.array_join(faults, ", ").alias("faults")).agg(F.count("*").alias("n"))


def f17_private_projection(spark: SparkSession, sf: str) -> DataFrame:
    hook = F.concat("name", F.lit(", mail a"), F.col("seq"), F.lit("@example.org or see www.example.org/"), F.col("seq"), F.lit("  now"))
    return B.leads(spark, sf).select("seq", "city", N.tier(F.col("score")).alias("tier"), X.scrub_identity(F.concat(F.lit("Sam, "), hook)).alias("diagnosis"))


def f18_event_gate(spark: SparkSession, sf: str) -> DataFrame:
    c = B.read(spark, sf, "conversations")
    return c.filter((F.col("role") != "assistant") & (F.length(F.trim("text")) >= 2)).groupBy("role").agg(F.count("*").alias("n"))


def j01_unknown_stage(spark: SparkSession, sf: str) -> DataFrame:
    return R.with_stage(B.opportunities(spark, sf), B.stages(spark)).filter("stage = 'Unknown'").select("id", "stage_id")


def j02_scheduled_or_fate(spark: SparkSession, sf: str) -> DataFrame:
    r = B.reviews(spark, sf)
    slot = B.read(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.min("ts").cast("timestamp").alias("slot_at"))
    said = F.when(F.col("slot_at").isNotNull() & (F.col("fate") == "approved"), "SCHEDULED").otherwise(F.upper("fate"))
    return r.join(slot, "doc_id", "left").select("doc_id", said.alias("shown"))


def j03_grid(spark: SparkSession, sf: str) -> DataFrame:
    days = spark.range(6).withColumnRenamed("id", "day")
    return days.withColumn("platform", F.explode(F.array(*map(F.lit, ("linkedin", "instagram", "facebook"))))).withColumn("place", F.col("day") * 3 + F.array_position(F.array(*map(F.lit, ("linkedin", "instagram", "facebook"))), F.col("platform")) - 1)


def j04_grid_posts(spark: SparkSession, sf: str) -> DataFrame:
    grid = spark.createDataFrame([(0, "tue"), (1, "thu"), (2, "sat"), (3, "sun")], "place long, weekday string")
    day = F.lower(F.date_format(F.col("created"), "EEE"))
    posts = B.opportunities(spark, sf).select("id", day.alias("weekday"))
    return posts.join(grid, "weekday").groupBy("place", "weekday").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def j05_event_lookup(spark: SparkSession, sf: str) -> DataFrame:
    live = B.reviews(spark, sf).filter("fate = 'pending'").select(F.col("doc_id").alias("draft"), "brand")
    return B.verbs(spark, sf).join(live, "draft").groupBy("verb").agg(F.count("*").alias("n"))


def j06_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = B.reviews(spark, sf).select("doc_id", "fate")
    new = B.read(spark, sf, "labels").select("doc_id", F.lit("relabelled").alias("fate"))
    return state.upsert(old, new, "doc_id").groupBy("fate").agg(F.count("*").alias("n"))


def j07_unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    files = B.read(spark, sf, "part").select("p_partkey", (F.to_timestamp(F.lit("2001-06-01")) + F.make_dt_interval(F.col("p_partkey") % 60)).alias("modified"))
    # every line refers to an even key, so parts with odd keys are those that none refers to
    used = B.read(spark, sf, "lineitem").select((F.col("l_partkey") - F.col("l_partkey") % 2).alias("p_partkey"))
    return state.unreferenced(files, used, "p_partkey", B.now() - F.expr("INTERVAL 30 DAYS"), "modified").select("p_partkey")


def j08_missing(spark: SparkSession, sf: str) -> DataFrame:
    need = B.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")).distinct()
    have = B.read(spark, sf, "customer").select((F.col("c_nationkey") - F.col("c_nationkey") % 2).alias("nation")).distinct()
    return need.join(have, "nation", "left_anti").select(F.col("nation").cast("long").alias("nation"))


def j09_rule_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = rules.rule_matches(B.read(spark, sf, "documents"), "doc_id", "text", [("shout", "!!"), ("symbols", "[$%&]{3}"), ("pipe", " \\x7C "), ("license", "[Ll]icense")])
    return found


def j10_keyed_update(spark: SparkSession, sf: str) -> DataFrame:
    queue = B.reviews(spark, sf).select("doc_id", "fate")
    changes = B.read(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.lit("held").alias("fate"))
    return state.update(queue, changes, "doc_id").groupBy("fate").agg(F.count("*").alias("n"))


def u_sets(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.array_distinct(F.transform(F.split(F.lower("text"), " "), lambda w: F.substring(w, 1, 2)))
    kept = F.array(*map(F.lit, ("th", "an", "le", "un", "of")))
    d = B.read(spark, sf, "documents").select("doc_id", asked.alias("a"))
    said = lambda c: F.array_join(F.sort_array(c), ",")
    return d.select("doc_id", said(F.array_intersect("a", kept)).alias("both"), said(F.array_except(kept, F.col("a"))).alias("missing"))


O = B.SQL_OPPORTUNITIES  # noqa: E741
WEEK = "TIMESTAMP '2001-07-31 00:00:00' - INTERVAL 7 DAYS"

ORACLES = {
    "a01_stage_rollup": f"WITH {O} SELECT coalesce(stage, 'Unknown') AS stage, count(*) AS n, round(sum(coalesce(value, 0)), 2) AS value FROM o LEFT JOIN st USING (stage_id) WHERE status = 'open' GROUP BY 1",
    "a02_pipeline_snapshot": f"""WITH {O} SELECT count(*) FILTER (status = 'open') AS open_count, round(coalesce(sum(value) FILTER (status = 'open'), 0), 2) AS total_value,
        count(*) FILTER (CAST(created AS DATE) = DATE '2001-07-31') AS new_today, count(*) FILTER (created >= {WEEK}) AS new_this_week,
        count(*) FILTER (status = 'won' AND updated >= {WEEK}) AS won_this_week, count(*) FILTER (status = 'lost' AND updated >= {WEEK}) AS lost_this_week FROM o""",
    "a03_fate_counts": f"WITH {B.SQL_REVIEWS} SELECT fate, count(*) AS n FROM r GROUP BY fate",
    "a04_pass_rate": f"WITH {B.SQL_REVIEWS} SELECT brand, count(*) AS total, count(*) FILTER (fate = 'approved') AS passed, CAST(floor(avg(CAST(fate = 'approved' AS INT)) * 100 + 0.5) AS BIGINT) AS percent FROM r GROUP BY brand",
    "a05_clean_flagged": r"""WITH s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?][''"]?)\s+', '\1' || chr(10), 'g'), '\n+')) AS s FROM documents),
        f AS (SELECT doc_id, max(CAST(len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')) > 20 AS INT)) AS bad FROM s GROUP BY doc_id)
        SELECT count(*) FILTER (bad = 0) AS clean, count(*) FILTER (bad = 1) AS flagged FROM f""",
    "a06_distinct_cities": f"WITH {B.SQL_LEADS} SELECT city, min(seq) AS first_seen FROM l GROUP BY city",
    "a07_lists": f"WITH {B.SQL_LEADS} SELECT city, seq // 100 AS page, string_agg(name, '|' ORDER BY seq) AS items FROM l GROUP BY city, seq // 100",
    "a08_status_classes": f"WITH {O} SELECT count(*) FILTER (status = 'open') AS active, count(*) FILTER (status IN ('won', 'lost')) AS dormant FROM o",
    "a10_all_resolved": f"WITH {B.SQL_REVIEWS} SELECT brand, bool_and(fate <> 'pending') AS resolved FROM r GROUP BY brand",
    "a12_rows_per_file": "SELECT source, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, count(*) AS docs FROM documents GROUP BY ROLLUP (source)",
    "a13_checks_ok": f"WITH {B.SQL_REVIEWS} SELECT count(*) FILTER (fate = 'approved') AS ok, count(*) AS total FROM r",
    "a14_backlog_gate": f"WITH {B.SQL_REVIEWS} SELECT count(*) AS backlog, CAST(CASE WHEN count(*) + 5 > 6 THEN 0 ELSE 5 END AS BIGINT) AS admitted FROM r WHERE fate = 'pending'",
    "a15_totals": f"WITH {B.SQL_REVIEWS} SELECT channel, count(*) FILTER (fate = 'approved') AS approved, count(*) FILTER (fate = 'killed') AS killed FROM r GROUP BY channel",
    "a17_city_tier_counts": f"WITH {B.SQL_LEADS} SELECT city, CASE WHEN score >= 7.5 THEN 'top-priority' WHEN score >= 6.5 THEN 'strong' WHEN score >= 5.5 THEN 'probe-first' ELSE 'low' END AS tier, count(*) AS n FROM l GROUP BY ALL",
    "a18_duplicate_defaults": f"WITH {B.SQL_REVIEWS} SELECT brand, count(*) AS n FROM r WHERE fate = 'approved' GROUP BY brand HAVING count(*) > 1",
    "a19_parse_accounting": """WITH k AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
        SELECT count(*) AS parsed, count(*) FILTER (k IS NULL) AS skipped, count(*) FILTER (k < 50) AS entities, count(*) FILTER (k >= 50) AS relations FROM k""",
    "f05_blocked_partition": """WITH h AS (SELECT doc_id, concat_ws(chr(10), source, lang, text) AS h FROM documents)
        SELECT doc_id, CASE WHEN regexp_matches(h, '(?i)theer') THEN 'theer' WHEN regexp_matches(h, '(?i)onin the') THEN 'onin the' WHEN regexp_matches(h, '(?i) und der ') THEN ' und der ' END AS pattern FROM h""",
    "f06_open_recent": f"WITH {O} SELECT id, stage_id FROM o WHERE status = 'open' AND created >= {WEEK}",
    "f09_find_lead": f"WITH {B.SQL_LEADS}, b AS (SELECT * FROM l ORDER BY score DESC, seq LIMIT 30) SELECT * FROM b WHERE contains(lower(name), '00001') ORDER BY score DESC, seq LIMIT 1",
    "f10_due": f"WITH {O}, q AS (SELECT id, CASE status WHEN 'open' THEN 'queued' WHEN 'won' THEN 'posted' ELSE 'held' END AS status, id % 5 AS attempts, created FROM o) SELECT id, status, CAST(attempts AS BIGINT) AS attempts FROM q WHERE status IN ('queued', 'held') AND attempts < 3 AND created <= TIMESTAMP '2001-07-31 00:00:00'",
    "f11_lapsed": f"WITH {O} SELECT created < TIMESTAMP '2001-07-31 00:00:00' - INTERVAL 72 HOURS AS lapsed, count(*) AS n FROM o WHERE status = 'open' GROUP BY 1",
    "f14_image_less": f"WITH {B.SQL_REVIEWS} SELECT doc_id, channel FROM r WHERE fate = 'approved' AND channel IN ('fr', 'de') AND doc_id % 3 = 0",
    "f16_valid_requests": """SELECT array_to_string(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'missing name' END, CASE WHEN turn > 1 OR turn < 0 THEN 'missing email' END,
        CASE WHEN role = 'assistant' THEN 'missing phone' END, CASE WHEN turn = 1 THEN 'bad email' END], lambda f: f IS NOT NULL), ', ') AS faults, count(*) AS n FROM conversations GROUP BY 1""",
    "f17_private_projection": f"WITH {B.SQL_LEADS} SELECT seq, city, CASE WHEN score >= 7.5 THEN 'top-priority' WHEN score >= 6.5 THEN 'strong' WHEN score >= 5.5 THEN 'probe-first' ELSE 'low' END AS tier, name || ', mail [their email] or see [their site] now' AS diagnosis FROM l",
    "f18_event_gate": "SELECT role, count(*) AS n FROM conversations WHERE role <> 'assistant' AND length(trim(text)) >= 2 GROUP BY role",
    "j01_unknown_stage": f"WITH {O} SELECT id, stage_id FROM o LEFT JOIN st USING (stage_id) WHERE stage IS NULL",
    "j02_scheduled_or_fate": f"WITH {B.SQL_REVIEWS}, s AS (SELECT user_id AS doc_id, min(ts) AS slot_at FROM events GROUP BY 1) SELECT doc_id, CASE WHEN slot_at IS NOT NULL AND fate = 'approved' THEN 'SCHEDULED' ELSE upper(fate) END AS shown FROM r LEFT JOIN s USING (doc_id)",
    "j03_grid": "SELECT d.day, p.platform, d.day * 3 + p.k AS place FROM (SELECT CAST(unnest(range(6)) AS BIGINT) AS day) d CROSS JOIN (VALUES ('linkedin', 0), ('instagram', 1), ('facebook', 2)) p(platform, k)",
    "j04_grid_posts": f"WITH {O} SELECT CAST(place AS BIGINT) AS place, weekday, count(*) AS n, min(id) AS first_id FROM o JOIN (VALUES (0, 'tue'), (1, 'thu'), (2, 'sat'), (3, 'sun')) g(place, weekday) ON lower(strftime(created, '%a')) = weekday GROUP BY 1, 2",
    "j05_event_lookup": f"WITH {B.SQL_REVIEWS}, {B.SQL_VERBS} SELECT verb, count(*) AS n FROM e JOIN r ON draft = doc_id WHERE fate = 'pending' GROUP BY verb",
    "j06_upsert": f"WITH {B.SQL_REVIEWS}, u AS (SELECT doc_id, fate FROM r WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'relabelled' FROM labels) SELECT fate, count(*) AS n FROM u GROUP BY fate",
    "j07_unreferenced": "SELECT p_partkey FROM part WHERE TIMESTAMP '2001-06-01' + to_days(CAST(p_partkey % 60 AS INT)) < TIMESTAMP '2001-07-31' - INTERVAL 30 DAYS AND p_partkey NOT IN (SELECT l_partkey - l_partkey % 2 FROM lineitem)",
    "j08_missing": "SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS nation FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey - c_nationkey % 2 FROM customer)",
    "j09_rule_matches": "SELECT doc_id, rule_id FROM documents JOIN (VALUES ('shout', '!!'), ('symbols', '[$%&]{3}'), ('pipe', ' [|] '), ('license', '[Ll]icense')) v(rule_id, pattern) ON regexp_matches(text, pattern)",
    "j10_keyed_update": f"WITH {B.SQL_REVIEWS} SELECT CASE WHEN l.toxic = 1 THEN 'held' ELSE fate END AS fate, count(*) AS n FROM r LEFT JOIN labels l USING (doc_id) GROUP BY 1",
    "u_sets": """WITH d AS (SELECT doc_id, list_distinct(list_transform(string_split(lower(text), ' '), lambda w: substr(w, 1, 2))) AS a FROM documents)
        SELECT doc_id, array_to_string(list_sort(list_intersect(a, ['th','an','le','un','of'])), ',') AS both, array_to_string(list_sort(list_filter(['th','an','le','un','of'], lambda w: NOT list_contains(a, w))), ',') AS missing FROM d""",
}
QUERIES = {k: globals()[k] for k in ORACLES}
