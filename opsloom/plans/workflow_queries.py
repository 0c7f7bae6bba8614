"""Ingestion, keyed state, sinks and streams over the bound tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions import dates as D
from opsloom.functions import numbers as N
from opsloom.functions import text as X
from opsloom.operators import state as S
from opsloom.plans import bindings as B
from opsloom.sources import connectors, ledger, markdown, records, sinks
from opsloom.streaming import reviews


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _joined(rows: DataFrame, key: str, order: str, line: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda p: p["l"]), "\n")


def s01_graph(spark, sf):
    k = F.col("c_custkey")
    line = F.when(k % 5 == 0, _say('{"type":"entity","name":"', F.col("c_name"), '","entityType":"T","observations":["a: 1"]}')).when(k % 5 == 1, _say('{"type":"relation","from":"', k, '","to":"x","relationType":"r"}')).when(k % 5 == 2, "{broken").when(k % 5 == 3, '{"type":"_aim","source":"s"}').otherwise("  ")
    return records.graph_lines(B.read(spark, sf, "customer").select(line.alias("value"))).groupBy("kind").agg(F.count("*").alias("n"))


def f03_outcomes(spark, sf):
    p = B.read(spark, sf, "part")
    k = F.col("p_partkey")
    said = F.array(
        _say("brand: b", k % 3), _say("client_name: ", F.when(k % 7 == 0, "").otherwise(F.col("p_name"))), F.lit("client_niche: pool"), F.lit("metric_name: calls"), F.lit("time_window: 30 days: net"),
        _say("metric_value_before:", k % 10), _say("metric_value_after: ", F.when(k % 11 == 0, "many").otherwise(F.col("p_retailprice").cast("string"))), F.lit("verifiable: YES"), _say("shareable: ", F.when(k % 4 == 0, "no").otherwise("1")),
    )
    entities = p.select(_say("e", k).alias("name"), F.lit("ClientOutcome").alias("entityType"), said.alias("observations"))
    return records.client_outcomes(entities, "b1").select("source_entity", "client_name", "time_window", "before", "after")


def _sheets(spark, sf) -> DataFrame:
    row = _say("| ", F.col("seq"), " | ", F.col("name"), " |  ", F.col("score"), " | ", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("city")), " | Sam, mail a@x.example.org on ", F.col("seq"), F.when(F.col("seq") % 10 == 0, " | more |").otherwise(" |"))
    leads = B.leads(spark, sf)
    # a sheet holds a page of a city's leads
    rows = leads.groupBy("city", B.page(100)).agg(_joined(leads, "city", "seq", row).alias("rows"))
    return rows.select("city", "page", _say(F.col("city"), " ", F.col("page")).alias("doc"), _say("# Pool\n| a | b |\n\n## Leads Table\n\nnote\n| # | Company | Score | City | Hook |\n|---|:--|--:|---|---|\n", F.col("rows"), "\n\n| 1 | not | this | table | row |").alias("text"))


def s02_table_scan(spark, sf):
    rows = markdown.table_rows(_sheets(spark, sf))
    return rows.select("doc", "pos", *(F.try_element_at("row", F.lit(k)).alias(k) for k in ("company", "score", "city")), "extra_cells")


def _batches(spark, sf) -> DataFrame:
    """Three pages of a city's leads in one document, each with a table of its own, and a title without one."""
    sheets = _sheets(spark, sf).withColumn("_d", F.floor(F.col("page") / 3))
    pages = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    return sheets.groupBy("city", "_d").agg(pages.alias("pages")).select(_say(F.col("city"), " ", F.col("_d")).alias("doc"), _say(F.array_join("pages", "\n\n"), "\n## Leads Table\nnone yet").alias("text"))


def s02_every_table(spark, sf):
    rows = markdown.all_table_rows(_batches(spark, sf))
    return rows.select("doc", "part", "pos", *(F.try_element_at("row", F.lit(k)).alias(k) for k in ("company", "score", "city")), "extra_cells")


def s04_every_seed(spark, sf):
    return markdown.seeds(_batches(spark, sf), "Nowhere", every=True).select("doc", "part", "pos", "city", "tier", "diagnosis")


def s04_seeds(spark, sf):
    return markdown.seeds(_sheets(spark, sf), "Nowhere").select("doc", "pos", "city", "tier", "diagnosis")


def s05_ranked_leads(spark, sf):
    block = _say("### ", F.col("seq"), ". ", F.col("name"), " — Score: ", F.col("score"), "/10\n\n- **Phone:** (702) ", F.col("seq"), "\n", F.when(F.col("seq") % 2 == 0, '- **Outreach angle:** "say it"\n').otherwise(""))
    leads = B.leads(spark, sf)
    docs = leads.groupBy(_say(F.col("city"), " ", F.floor(F.col("seq") / 100)).alias("doc")).agg(_say("intro\n", _joined(leads, "city", "seq", block)).alias("text"))
    return markdown.ranked_leads(docs).select("doc", "rank", "name", "score", "phone", "owner", "angle")


def s06_sections(spark, sf):
    k = F.col("p_partkey")
    text = _say("top ", k, "\n## One\na\n### sub\n\n## Two\n", F.when(k % 2 == 0, "## One\nagain").otherwise("b"), "\n")
    docs = B.read(spark, sf, "part").select(k.cast("string").alias("doc"), text.alias("text"))
    return markdown.sections(docs).select("doc", "ord", "title", "body")


def s08_brands(spark, sf):
    base = "schema_version: 1\nbrand_key: {k}\ndisplay_name: Brand {k}\nstatus: {{active: true}}\ndefault_brand: {d}\npositioning: {{voice_anchors: [{{path: a, weight: {w}}}]}}\ncadence: {{slot_times: {{linkedin: ['{t}']}}}}\n"
    files = {f"{k}.yaml": base.format(k=k, d=d, w=w, t=t) for k, d, w, t in (("a", "true", 0.5, "09:00"), ("b", "false", 1, "13:30"), ("c", "false", 2, "09:00"), ("d", "false", 1, "25:00"))}
    good, bad = records.brand_rows(spark, files | {"_schema.yaml": "x", "e.yaml": "a: [", "f.yaml": base.format(k="g", d="false", w=1, t="09:00")})
    return good.select(F.col("brand_key").alias("name"), F.array_join(F.col("slot_times")["linkedin"], ",").alias("said")).unionByName(bad.select(F.col("file").alias("name"), F.col("reason").alias("said")))


def s13_row_counts(spark, sf):
    docs = B.read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    return records.inventory(docs, "(?m)^[A-Z][a-z]+\\.").withColumnRenamed("doc", "doc_id")


def s14_samples(spark, sf):
    docs = B.read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    return records.first_samples(docs, "([a-z]+tion)").withColumnRenamed("doc", "doc_id")


def s16_posts(spark, sf):
    k = F.col("p_partkey")
    text = _say("x===linkedin===\nHEADLINE: h", k, "\nBODY: one\ntwo\n===INSTAGRAM===\nHEADLINE: i\nrest ", k, "\n===Facebook===\n", F.when(k % 2 == 0, "BODY: no headline").otherwise("HEADLINE: f\nBODY: g"), "\n===LINKEDIN===\nHEADLINE:\n")
    docs = B.read(spark, sf, "part").select(k.alias("doc"), text.alias("text"))
    return markdown.delimited_posts(docs).withColumnRenamed("doc", "p_partkey")


def s17_state(spark, sf):
    k = F.col("s_suppkey")
    text = _say('{"schemaVersion":1,"records":[{"id":"p', k, '","status":"queued","attempts":', k % 3, '},{"id":"q', k, '","status":"held","attempts":0}]}')
    return records.snapshot_rows(B.read(spark, sf, "supplier").select(text.alias("text")), "id string, status string, attempts bigint")


def s18_sheets(spark, sf):
    k = F.col("c_custkey")
    line = _say('Sam,,"', F.col("c_name"), ', Inc.",(702) 555-', F.lpad(k.cast("string"), 4, "0"), ",,,", F.when(k % 2 == 0, "4.5").otherwise("4.5 / 4.7"), ",", F.when(k % 3 == 0, "999+").otherwise("12"), ",9-9,1-5,Springfield,hook,pest,8.0")
    r = records.research_rows(B.read(spark, sf, "customer").select(line.alias("value")))
    return r.select("company_name", "rating", "reviews", "phone_key", "score")


def t01_first_decision(spark, sf):
    return S.first_decision(B.verbs(spark, sf), "draft", "verb", "ts", "event_id", ["approve", "kill"]).select("draft", "verb", "event_id")


def t02_review_fold(spark, sf):
    verb = F.when(F.col("verb") == "ignored", "reply").otherwise(F.col("verb"))
    walked = S.walk(B.verbs(spark, sf).withColumn("what", verb), "draft", ["ts", "event_id"], "what", S.REVIEW_TURNS, "pending")
    again = F.col("phase").endswith("again") | (F.col("phase") == "reopened")
    status = F.when(F.col("phase") == "reopened", "pending").otherwise(F.substring_index("phase", " ", 1))
    return walked.select("draft", status.alias("status"), again.cast("long").alias("rewrites"))


def t04_week_phases(spark, sf):
    names = F.array(*map(F.lit, ("drafted", "resolved", "rendered", "confirmed", "cancel", "lapse", "noise")))
    event = F.get(names, (F.col("event_id") % 7).cast("int"))
    return S.walk(B.verbs(spark, sf).withColumn("what", event), "draft", ["ts", "event_id"], "what", S.PHASE_TURNS, "drafting")


def t06_posting_fold(spark, sf):
    outcome = F.when(F.col("value") < 4, "ok").when(F.col("value") < 20, "not_ready").when(F.col("value") < 40, "config").otherwise("error")
    walked = S.walk(B.verbs(spark, sf).withColumn("what", outcome), "draft", ["ts", "event_id"], "what", S.POST_TURNS, "queued 0")
    return walked.select("draft", F.substring_index("phase", " ", 1).alias("status"), F.substring_index("phase", " ", -1).cast("long").alias("attempts"))


def t07_daily_once(spark, sf):
    e = B.verbs(spark, sf)
    return S.once_per_day(e, D.local_day(F.col("ts")), "ts", "event_id").select(F.col("day").cast("string").alias("day"), "event_id")


def t08_single_active(spark, sf):
    r = B.reviews(spark, sf).groupBy("brand").agg(F.count_if(F.col("fate") == "pending").alias("open"))
    return r.select("brand", (F.col("open") == 0).alias("may_start"))


def t11_attempts(spark, sf):
    rows = B.verbs(spark, sf).select("draft", (F.row_number().over(_by_draft())).alias("attempt"), (F.col("value") < 10).alias("passed"))
    return S.accepted_attempt(rows, "draft", "attempt", "passed")


def _by_draft():
    from pyspark.sql import Window

    return Window.partitionBy("draft").orderBy("ts", "event_id")


def t14_timeouts(spark, sf):
    # signups never answer; others take 40 ms for each unit of their value
    probe = S.probed(F.when(F.col("verb") != "rewrite", F.floor(F.col("value") * 40)))
    return B.verbs(spark, sf).select("event_id", probe["status"].alias("status"), probe["latency"].cast("long").alias("latency"))


def t15_late_events(spark, sf):
    e = B.verbs(spark, sf)
    first = S.first_decision(e, "draft", "verb", "ts", "event_id", ["approve", "kill"]).select("draft", F.col("ts").alias("decided"), F.col("event_id").alias("by"))
    late = e.filter("verb <> 'ignored'").join(first, "draft").filter((F.col("ts") > F.col("decided")) | ((F.col("ts") == F.col("decided")) & (F.col("event_id") > F.col("by"))))
    return late.groupBy("verb").agg(F.count("*").alias("dropped"))


def k01_snapshot(spark, sf):
    """Two versions of a state, the second made from the first, the newest read back."""
    state = B.reviews(spark, sf).select("doc_id", "fate")
    book = ledger.Ledger(spark, shared_folder(spark), state.schema)
    book.mutate(lambda _: state)
    seen = B.read(spark, sf, "labels").select("doc_id", F.lit("seen").alias("fate"))
    book.mutate(lambda now: S.upsert(now, seen, "doc_id"))
    return book.state().groupBy("fate").agg(F.count("*").alias("n"))


def _entries(opportunities: DataFrame) -> DataFrame:
    return opportunities.select("id", F.col("status").alias("brand"), F.trunc("created", "quarter").cast("string").alias("day"))


def k02_archive(spark, sf):
    """Batches of an archive, one of which comes again."""
    entries = _entries(B.opportunities(spark, sf))
    book = ledger.Ledger(spark, shared_folder(spark), entries.schema)
    for batch in (0, 1, 1):
        book.append(entries.filter(F.col("id") % 2 == batch), batch)
    return book.rows().groupBy("brand").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))


def k02_stream_archive(spark, sf):
    """The same archive, from a stream whose batches are committed once."""
    raw = spark.readStream.schema(B.read(spark, sf, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    entries = _entries(B.opportunities_of(raw))
    folder = shared_folder(spark)
    book = ledger.Ledger(spark, folder, entries.schema)
    for _ in range(2):  # the second run finds nothing new
        book.sink(entries, f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return book.rows().groupBy("brand").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))


def k06_bundle_copy(spark, sf):
    """Documents as files of three kinds; sheets stay behind, the others are copied, read back and compared."""
    kind = F.get(F.array(F.lit("md"), F.lit("yaml"), F.lit("csv")), (F.col("doc_id") % 3).cast("int"))
    files = B.read(spark, sf, "documents").select(F.concat_ws(".", F.col("doc_id").cast("string"), kind).alias("name"), F.col("text").alias("content"))
    folder = shared_folder(spark)
    connectors.write_bundle(files.filter(~F.col("name").endswith(".csv")), folder)
    listed = connectors.bundle_files(spark, folder)
    copied = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/files").select(F.regexp_extract("path", "files/.*", 0).alias("path"), F.sha2("content", 256).alias("copied"))
    both = listed.join(copied, "path", "left").groupBy(F.substring_index("name", ".", -1).alias("kind"))
    return both.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("copied") == F.col("sha256")).alias("intact"))


PAGE = "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string"


def s11_paged(spark, sf):
    """Orders as pages by status and pipeline; of the pages only those of the open, urgent ones are opened."""
    by, folder = ["o_orderstatus", "o_orderpriority"], shared_folder(spark)
    connectors.write_pages(B.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", *by), folder, by)
    pages = connectors.read_pages(spark, folder, by, PAGE).filter("o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
    return pages.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.min("o_orderkey").alias("first_order"))


def k04_messages(spark, sf):
    pieces = B.read(spark, sf, "documents").select("doc_id", F.posexplode(X.chunks(1900)(F.col("text"))).alias("pos", "piece"))
    return pieces.groupBy("doc_id").agg(F.count("*").alias("messages"), F.sum(F.length("piece")).alias("chars"))


def k08_log_lines(spark, sf):
    e = B.verbs(spark, sf)
    return e.select("event_id", sinks.log_line(F.col("ts"), F.when(F.col("verb") == "kill", "warn").otherwise("info"), F.col("verb"), draft=F.col("draft")).alias("line"))


def k11_notes(spark, sf):
    return B.read(spark, sf, "part").select("p_partkey", sinks.front_matter(F.col("p_name"), F.lit("2026-01-02").cast("date"), X.slug(F.col("p_name"))).alias("note"), sinks.alert(F.repeat("p_name", 300)).alias("alert"))


def _events(spark, sf):
    """The table as a stream, be it one file or a folder of files; a path may name either if it holds a pattern."""
    return reviews.event_stream(spark, f"{sf}/{{events}}.parquet", "*")


def t_stream_first_decision(spark, sf):
    stream = reviews.first_decisions(_events(spark, sf))
    return reviews.drained(stream, shared_folder(spark)).select("draft", "verb", "event_id")


def t_stream_daily_counts(spark, sf):
    stream = reviews.daily_counts(_events(spark, sf))
    return reviews.drained(stream, shared_folder(spark)).select(F.col("day").cast("string").alias("day"), "verb", "n")


def _items(spark, sf):
    """What a draft is asked on one day is an item: open from midnight on, resolved when it is approved or killed."""
    e = _events(spark, sf)
    item = F.concat_ws(" ", F.col("draft").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    both = F.array(F.struct(F.date_trunc("day", "ts").alias("ts"), F.lit("open").alias("what")), F.struct("ts", F.when(F.col("verb").isin("approve", "kill"), "resolve").otherwise("seen").alias("what")))
    return e.select(item.alias("item"), F.explode(both).alias("e")).select("item", "e.ts", "e.what")


def t03_lapse_timer(spark, sf):
    fired = reviews.drained(reviews.deadlines(_items(spark, sf), "12 hours"), shared_folder(spark))
    return fired.select("item", "what", F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"))


def t05_reminder_timer(spark, sf):
    fired = reviews.drained(reviews.deadlines(_items(spark, sf), "30 hours", "24 hours"), shared_folder(spark))
    return fired.select("item", "what", F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"))


def s19_reactions_live(spark, sf):
    """Requests to rewrite as posts, approvals and kills as reactions, each a stream."""
    e = lambda: _events(spark, sf)
    posts = e().filter("verb = 'rewrite'").select(F.col("draft").alias("subject"), F.col("ts").alias("posted"), F.col("event_id").alias("post"))
    reactions = e().filter("verb IN ('approve', 'kill')").select(F.col("draft").alias("subject"), F.col("ts").alias("reacted"), F.col("event_id").alias("reaction"), "verb")
    return reviews.drained(reviews.reactions_to_posts(posts, reactions, "36 HOURS"), shared_folder(spark)).select("reaction", "subject", "verb", "post")


def j05_reaction_counts(spark, sf):
    """What each rewrite request was answered with, from the live join; requests without an answer aren't told."""
    live = s19_reactions_live(spark, sf).filter("post IS NOT NULL")
    return live.groupBy("post").agg(F.count_if(F.col("verb") == "approve").alias("approvals"), F.count_if(F.col("verb") == "kill").alias("kills"))


def shared_folder(spark: SparkSession) -> str:
    """A folder's name that all executors see and none has used: under spark.checkpoint.dir, else, if all run on this
    machine, a local one. Spark deletes it when the session ends."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="opsloom-")
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/opsloom-{uuid.uuid4().hex}")
    files = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(own)
    files.deleteOnExit(own)
    return f"{own.toString()}/own"


L, V, R = B.SQL_LEADS, B.SQL_VERBS, B.SQL_REVIEWS
FIRST = "f AS (SELECT draft, arg_min(verb, (ts, event_id)) AS verb, min((ts, event_id)) AS m FROM e WHERE verb IN ('approve', 'kill') GROUP BY draft)"

ORACLES = {
    "s01_graph": "SELECT CASE c_custkey % 5 WHEN 0 THEN 'entity' WHEN 1 THEN 'relation' WHEN 2 THEN 'skipped' ELSE 'header' END AS kind, count(*) AS n FROM customer WHERE c_custkey % 5 < 4 GROUP BY 1",
    "f03_outcomes": "SELECT 'e' || p_partkey AS source_entity, p_name AS client_name, '30 days: net' AS time_window, CAST(p_partkey % 10 AS DOUBLE) AS before, p_retailprice AS after FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 4 <> 0",
    "s02_table_scan": f"WITH {L} SELECT city || ' ' || seq // 100 AS doc, row_number() OVER (PARTITION BY city, seq // 100 ORDER BY seq) - 1 AS pos, name AS company, CAST(score AS VARCHAR) AS score, CASE WHEN seq % 3 = 0 THEN '' ELSE city END AS city, CAST(seq % 10 = 0 AS BIGINT) AS extra_cells FROM l",
    "s02_every_table": f"WITH {L}, p AS (SELECT *, seq // 100 AS page, seq // 300 AS d FROM l) SELECT city || ' ' || d AS doc, dense_rank() OVER (PARTITION BY city, d ORDER BY page) - 1 AS part, row_number() OVER (PARTITION BY city, page ORDER BY seq) - 1 AS pos, name AS company, CAST(score AS VARCHAR) AS score, CASE WHEN seq % 3 = 0 THEN '' ELSE city END AS city, CAST(seq % 10 = 0 AS BIGINT) AS extra_cells FROM p",
    "s04_every_seed": f"WITH {L}, p AS (SELECT *, seq // 100 AS page, seq // 300 AS d FROM l) SELECT city || ' ' || d AS doc, dense_rank() OVER (PARTITION BY city, d ORDER BY page) - 1 AS part, row_number() OVER (PARTITION BY city, page ORDER BY seq) - 1 AS pos, CASE WHEN seq % 3 = 0 THEN 'Nowhere' ELSE city END AS city, 'untiered' AS tier, 'mail [their email] on ' || seq AS diagnosis FROM p",
    "s04_seeds": f"WITH {L} SELECT city || ' ' || seq // 100 AS doc, row_number() OVER (PARTITION BY city, seq // 100 ORDER BY seq) - 1 AS pos, CASE WHEN seq % 3 = 0 THEN 'Nowhere' ELSE city END AS city, 'untiered' AS tier, 'mail [their email] on ' || seq AS diagnosis FROM l",
    "s05_ranked_leads": f"WITH {L} SELECT city || ' ' || seq // 100 AS doc, seq AS rank, name, score || '/10' AS score, '(702) ' || seq AS phone, CAST(NULL AS VARCHAR) AS owner, CASE WHEN seq % 2 = 0 THEN 'say it' END AS angle FROM l",
    "s06_sections": """WITH d AS (SELECT p_partkey AS k FROM part)
        SELECT CAST(k AS VARCHAR) AS doc, CAST(0 AS BIGINT) AS ord, '__header__' AS title, 'top ' || k AS body FROM d
        UNION ALL SELECT CAST(k AS VARCHAR), 1, 'One', CASE WHEN k % 2 = 0 THEN 'again' ELSE 'a' || chr(10) || '### sub' END FROM d
        UNION ALL SELECT CAST(k AS VARCHAR), 2, 'Two', CASE WHEN k % 2 = 0 THEN '' ELSE 'b' END FROM d""",
    "s08_brands": "SELECT * FROM (VALUES ('a', '09:00'), ('b', '13:30'), ('c.yaml', 'weight'), ('d.yaml', 'slot'), ('e.yaml', 'syntax'), ('f.yaml', 'key')) v(name, said)",
    "s13_row_counts": "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^[A-Z][a-z]+\\.')) AS BIGINT) AS n FROM documents",
    "s14_samples": "WITH h AS (SELECT doc_id, regexp_extract_all(text, '[a-z]+tion')[1:3] AS h FROM documents) SELECT doc_id, CAST(unnest(range(len(h))) AS BIGINT) AS pos, unnest(h) AS sample FROM h",
    "s16_posts": """SELECT p_partkey, 'linkedin' AS platform, 'h' || p_partkey AS headline, 'one' || chr(10) || 'two' AS body FROM part UNION ALL SELECT p_partkey, 'instagram', 'i', 'rest ' || p_partkey FROM part
        UNION ALL SELECT p_partkey, 'facebook', 'f', 'g' FROM part WHERE p_partkey % 2 = 1""",
    "s17_state": "SELECT 'p' || s_suppkey AS id, 'queued' AS status, CAST(s_suppkey % 3 AS BIGINT) AS attempts FROM supplier UNION ALL SELECT 'q' || s_suppkey, 'held', 0 FROM supplier",
    "s18_sheets": "SELECT c_name || ', Inc.' AS company_name, CASE WHEN c_custkey % 2 = 0 THEN CAST(4.5 AS DOUBLE) END AS rating, CASE WHEN c_custkey % 3 > 0 THEN CAST(12 AS DOUBLE) END AS reviews, '702555' || lpad(left(CAST(c_custkey AS VARCHAR), 4), 4, '0') AS phone_key, CAST(8 AS DOUBLE) AS score FROM customer",
    "t01_first_decision": f"WITH {V} SELECT draft, arg_min(verb, (ts, event_id)) AS verb, arg_min(event_id, (ts, event_id)) AS event_id FROM e WHERE verb IN ('approve', 'kill') GROUP BY draft",
    "t02_review_fold": f"""WITH {V}, h AS (SELECT draft, list(CASE WHEN verb = 'ignored' THEN 'reply' ELSE verb END ORDER BY ts, event_id) AS h FROM e GROUP BY draft),
        f AS (SELECT draft, list_reduce(list_prepend('pending 0', h), lambda s, v: CASE WHEN s = 'pending 0' AND v = 'rewrite' THEN 'awaiting 0' WHEN s LIKE 'pending %' AND v = 'approve' THEN 'approved' || s[8:] WHEN s LIKE 'pending %' AND v = 'kill' THEN 'killed' || s[8:] WHEN s = 'awaiting 0' AND v = 'reply' THEN 'pending 1' ELSE s END) AS s FROM h)
        SELECT draft, string_split(s, ' ')[1] AS status, CAST(string_split(s, ' ')[2] AS BIGINT) AS rewrites FROM f""",
    "t04_week_phases": f"""WITH {V}, h AS (SELECT draft, list(['drafted', 'resolved', 'rendered', 'confirmed', 'cancel', 'lapse', 'noise'][event_id % 7 + 1] ORDER BY ts, event_id) AS h FROM e GROUP BY draft)
        SELECT draft, list_reduce(list_prepend('drafting', h), lambda s, v: CASE WHEN s = 'drafting' AND v = 'drafted' THEN 'text_review' WHEN s = 'text_review' AND v = 'resolved' THEN 'image_gen' WHEN s = 'image_gen' AND v = 'rendered' THEN 'final_review' WHEN s = 'final_review' AND v = 'confirmed' THEN 'scheduled'
            WHEN s IN ('drafting', 'text_review', 'image_gen', 'final_review') AND v = 'cancel' THEN 'cancelled' WHEN s IN ('text_review', 'final_review') AND v = 'lapse' THEN 'lapsed' ELSE s END) AS phase FROM h""",
    "t06_posting_fold": f"""WITH {V}, o AS (SELECT draft, ts, event_id, CASE WHEN value < 4 THEN 'ok' WHEN value < 40 THEN 'wait' ELSE 'error' END AS o FROM e),
        c AS (SELECT *, count(*) FILTER (o = 'error') OVER w AS errors, count(*) FILTER (o = 'ok') OVER w AS oks FROM o WINDOW w AS (PARTITION BY draft ORDER BY ts, event_id)),
        l AS (SELECT * FROM c WHERE (oks = 0 OR (oks = 1 AND o = 'ok')) AND (errors < 3 OR (errors = 3 AND o = 'error')))
        SELECT draft, CASE WHEN max(oks) > 0 THEN 'posted' WHEN max(errors) >= 3 THEN 'failed' ELSE 'held' END AS status, CAST(max(errors) AS BIGINT) AS attempts FROM l GROUP BY draft""",
    "t07_daily_once": "SELECT CAST(CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS day, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1",
    "t08_single_active": f"WITH {R} SELECT brand, count(*) FILTER (fate = 'pending') = 0 AS may_start FROM r GROUP BY brand",
    "t11_attempts": f"""WITH {V}, a AS (SELECT draft, row_number() OVER (PARTITION BY draft ORDER BY ts, event_id) AS attempt, value < 10 AS passed FROM e),
        b AS (SELECT draft, min(attempt) FILTER (passed) AS f, max(attempt) AS l FROM a WHERE attempt <= 3 GROUP BY draft) SELECT draft, coalesce(f, l) AS attempt, f IS NOT NULL AS passed FROM b""",
    "t14_timeouts": f"""WITH {V}, p AS (SELECT event_id, CASE WHEN verb <> 'rewrite' THEN CAST(floor(value * 40) AS BIGINT) END AS ms FROM e)
        SELECT event_id, CASE WHEN ms IS NULL OR ms > 4000 THEN 'down' ELSE 'ok' END AS status, least(coalesce(ms, 4000), 4000) AS latency FROM p""",
    "t15_late_events": f"WITH {V}, {FIRST} SELECT e.verb, count(*) AS dropped FROM e JOIN f USING (draft) WHERE e.verb <> 'ignored' AND (e.ts, e.event_id) > f.m GROUP BY 1",
    "k01_snapshot": f"WITH {R} SELECT CASE WHEN fate = 'pending' THEN 'pending' ELSE 'seen' END AS fate, count(*) AS n FROM r GROUP BY 1",
    "k02_archive": f"WITH {B.SQL_OPPORTUNITIES} SELECT status AS brand, count(*) AS n, count(DISTINCT date_trunc('quarter', created)) AS days FROM o GROUP BY 1",
    "k02_stream_archive": f"WITH {B.SQL_OPPORTUNITIES} SELECT status AS brand, count(*) AS n, count(DISTINCT date_trunc('quarter', created)) AS days FROM o GROUP BY 1",
    "k06_bundle_copy": "SELECT CASE doc_id % 3 WHEN 0 THEN 'md' ELSE 'yaml' END AS kind, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS intact FROM documents WHERE doc_id % 3 < 2 GROUP BY 1",
    "s11_paged": "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_orderkey) AS first_order FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1",
    "k08_log_lines": f"""WITH {V} SELECT event_id, '{{"t":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","level":"' || CASE WHEN verb = 'kill' THEN 'warn' ELSE 'info' END || '","msg":"' || verb || '","draft":' || draft || '}}' AS line FROM e""",
    "k11_notes": "SELECT p_partkey, '---' || chr(10) || 'title: ' || p_name || chr(10) || 'date: 2026-01-02' || chr(10) || '---' || chr(10) || chr(10) || replace(p_name, ' ', '-') AS note, substr(repeat(p_name, 300), 1, 1800) AS alert FROM part",
    "t_stream_daily_counts": f"WITH {V} SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS day, verb, count(*) AS n FROM e WHERE date_trunc('day', ts) + INTERVAL 2 DAYS <= (SELECT max(ts) FROM e) GROUP BY 1, 2",
}
_ITEMS = f"""WITH {V}, m AS (SELECT epoch_ms(max(ts)) - 86400000 AS mark FROM e),
    i AS (SELECT draft || ' ' || strftime(ts, '%Y-%m-%d') AS item, date_trunc('day', min(ts)) AS opened, min(ts) FILTER (verb IN ('approve', 'kill')) AS resolved FROM e GROUP BY 1)"""


def _fired(what: str, hours: int) -> str:
    return f"""SELECT item, '{what}' AS what, strftime(opened + INTERVAL {hours} HOURS, '%Y-%m-%d %H:%M') AS at FROM i, m
        WHERE mark > epoch_ms(opened + INTERVAL {hours} HOURS) AND (resolved IS NULL OR epoch_ms(resolved) > epoch_ms(opened + INTERVAL {hours} HOURS))"""


ORACLES["t03_lapse_timer"] = f"{_ITEMS} {_fired('lapse', 12)}"
ORACLES["t05_reminder_timer"] = f"{_ITEMS} {_fired('reminder', 6)} UNION ALL {_fired('lapse', 30)}"
_REACTIONS = f"""{V}, p AS (SELECT draft, ts AS posted, event_id AS post FROM e WHERE verb = 'rewrite'), r AS (SELECT draft, ts, event_id AS reaction, verb FROM e WHERE verb IN ('approve', 'kill')),
    m AS (SELECT least((SELECT epoch_ms(max(posted)) FROM p), (SELECT epoch_ms(max(ts)) FROM r)) - 86400000 AS mark)"""
ORACLES["s19_reactions_live"] = f"""WITH {_REACTIONS} SELECT reaction, r.draft AS subject, verb, post FROM r LEFT JOIN p ON p.draft = r.draft AND posted <= ts AND ts <= posted + INTERVAL 36 HOURS
    WHERE post IS NOT NULL OR epoch_ms(ts) < (SELECT mark FROM m)"""
ORACLES["j05_reaction_counts"] = f"""WITH {_REACTIONS} SELECT post, count(*) FILTER (verb = 'approve') AS approvals, count(*) FILTER (verb = 'kill') AS kills
    FROM r JOIN p ON p.draft = r.draft AND posted <= ts AND ts <= posted + INTERVAL 36 HOURS GROUP BY post"""
ORACLES["t_stream_first_decision"] = ORACLES["t01_first_decision"]
QUERIES = {k: globals()[k] for k in (*ORACLES, "k04_messages")}
