"""Drafting, review and publishing as whole flows, and small functions that other queries use as parts."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from opsloom.functions import dates as D
from opsloom.functions import numbers as N
from opsloom.functions import prompts as P
from opsloom.functions import text as X
from opsloom.operators import allocation as A
from opsloom.operators import rollups as R
from opsloom.operators import rules, state
from opsloom.plans import bindings as B
from opsloom.plans.text_queries import DASHES, SANITY, SCAFFOLDING, SPECIFIC
from opsloom.plans.workflow_queries import shared_folder
from opsloom.sources import markdown, records, sinks

BLOCKED = ("theer", "onin the", "([")
VOICE = rules.Voice(structures=[("shout", "[a-z]+!!"), ("broken", "*(")], most_words=10_000, blocked=BLOCKED)
TERMS = ("the", "und", "of", "la")


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _docs(spark, sf):
    return B.read(spark, sf, "documents")


# Sources and sinks


def s03_split_rows(spark, sf):
    k = F.col("p_partkey")
    line = _say(F.when(k % 3 == 0, " | ").when(k % 3 == 1, "|").otherwise(""), "a", k, " | ", F.col("p_name"), F.when(k % 2 == 0, " ||").otherwise(" | "), F.col("p_type"), F.when(k % 5 == 0, " |").otherwise(""))
    return B.read(spark, sf, "part").select("p_partkey", F.array_join(X.table_cells(line), "~").alias("cells"))


def s10_leads_file(spark, sf):
    """Leads written as text files, each read whole."""
    folder = shared_folder(spark)
    B.leads(spark, sf).select(_say("### ", F.col("seq"), ". ", F.col("name")).alias("value")).write.text(folder)
    lines = markdown.read_texts(spark, folder).select(F.explode(markdown.lines_of(F.col("text"))).alias("line")).filter("line <> ''")
    return lines.select(F.regexp_extract("line", r"^### (\d+)\. ", 1).cast("long").alias("seq"), F.regexp_extract("line", r"\. (.*)", 1).alias("name"))


def s21_form_requests(spark, sf):
    """Requests of a form: broken bodies and those with faults are refused, the others get tags."""
    t = F.col("turn")
    body = F.to_json(F.struct(F.col("text").alias("firstName"), F.when(t % 4 > 0, _say("c", F.col("conv_id"), "@mail.example")).alias("email"), F.lit("5550100").alias("phone"), F.col("role").alias("businessType")))
    asked = B.read(spark, sf, "conversations").select("conv_id", "turn", F.when(t % 5 == 4, F.lit("{broken")).otherwise(body).alias("body"))
    parsed = records.form_requests(asked, "body")
    return parsed.select("conv_id", "turn", F.coalesce(F.array_join("tags", ","), F.concat(F.lit("refused: "), F.array_join("faults", ", "))).alias("outcome"))


def k14_alerts(spark, sf):
    body = sinks.alert(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.length(body).cast("long").alias("chars"), F.md5(body).alias("alert"))


# Filters, joins, aggregates


def f04_blocked(spark, sf):
    """Is a text blocked by any pattern? One of the patterns can't be compiled and matches nothing."""
    return _docs(spark, sf).select("doc_id", rules.first_block(F.col("text"), BLOCKED).isNotNull().alias("blocked"))


def f07_created_today(spark, sf):
    return B.opportunities(spark, sf).filter(D.utc_day(F.col("created")) == D.utc_day(B.now())).select("id", "status")


def f08_rolling_week(spark, sf):
    week = B.now() - F.expr("INTERVAL 7 DAYS")
    return B.opportunities(spark, sf).filter((F.col("created") >= week) | ((F.col("status") == "won") & (F.col("updated") >= week))).select("id", "status")


def f20_old_images(spark, sf):
    k = F.col("p_partkey")
    name = _say(F.md5("p_name"), "-", k, F.when(k % 4 == 0, ".png").otherwise(".jpg"))
    modified = F.to_timestamp(F.lit("2001-06-01")) + F.make_dt_interval(k % 60)
    files = B.read(spark, sf, "part").select("p_partkey", name.alias("name"), modified.alias("modified")).filter(F.col("name").endswith(".jpg"))
    used = B.read(spark, sf, "lineitem").select((F.col("l_partkey") - F.col("l_partkey") % 3).alias("p_partkey"))
    return state.unreferenced(files, used, "p_partkey", B.now() - F.expr("INTERVAL 30 DAYS"), "modified").select("p_partkey", "name")


def _calendar(spark, days: int = 31):
    day = F.date_add(F.lit("2001-08-06").cast("date"), F.col("id").cast("int"))
    return A.slots(spark.range(days).select(day.alias("day")), ["09:00", "13:00"])


def j11_taken_slots(spark, sf):
    day = F.date_add(F.lit("2001-08-06").cast("date"), (F.col("s_suppkey") % 5).cast("int"))
    taken = B.read(spark, sf, "supplier").select(D.instant(day, F.lit("09:00")).alias("at"))
    return _calendar(spark).join(taken, "at", "left_semi").select("at")


def j12_registry(spark, sf):
    """What a registry says of each asked number; others are unknown."""
    known = spark.createDataFrame([(i, f"scenario {i}") for i in range(1, 6)], "scenario long, title string")
    asked = B.read(spark, sf, "supplier").select((F.col("s_suppkey") % 9).alias("scenario"))
    return asked.join(F.broadcast(known), "scenario", "left").groupBy(F.coalesce("title", F.lit("unknown")).alias("title")).agg(F.count("*").alias("n"))


def a16_term_counts(spark, sf):
    counts = F.array(*(F.struct(F.lit(t).alias("term"), F.regexp_count("text", F.lit(X.whole_word(t))).alias("n")) for t in TERMS))
    return _docs(spark, sf).select(F.explode(counts).alias("c")).groupBy("c.term").agg(F.sum("c.n").alias("n"))


def u01_failures(spark, sf):
    """All failures of a text as rows, in the order of the checks."""
    voice = rules.Voice(words=[rules.Word("the")], structures=[("shout", "[a-z]+!!")], most_words=10_000)
    return rules.validate(_docs(spark, sf), voice).select("doc_id", F.posexplode("hard").alias("ord", "f")).select("doc_id", F.col("ord").cast("long").alias("ord"), "f.check")


def t03_lapse_sweep(spark, sf):
    """What a sweep leaves pending, by stage, and what it evicts."""
    pending = B.opportunities(spark, sf).filter("status = 'open'").select("stage_id", F.col("created").alias("created_at"))
    gone = state.lapsed(pending, B.now(), 72)
    return pending.groupBy("stage_id").agg(F.count_if(~gone).alias("pending"), F.count_if(gone).alias("evicted"))


def t09_back_pressure(spark, sf):
    return R.backlog_gate(B.reviews(spark, sf).filter("fate = 'pending'"), 3, 30, "brand")


def c16_specificity(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(rules.unspecific(F.col("text"))).cast("long").alias("warnings"))


def c17_week_seeds(spark, sf):
    dealt = A.wrap_chunks(B.leads(spark, sf), "city", "seq", 6, 4)
    lists = dealt.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("slot", "city", "name"))).alias("l"))
    return lists.select("day", X.numbered(F.transform("l", lambda s: _say("(", s["city"], ") ", s["name"]))).alias("lines"))


def c18_graph_scans(spark, sf):
    k = F.col("c_custkey")
    line = F.when(k % 2 == 0, _say('{"type":"entity","name":"', F.col("c_name"), '","entityType":"T","observations":[]}')).otherwise(_say('{"type":"relation","from":"', k, '","to":"', k + 1, '","relationType":"r"}'))
    found = records.graph_lines(B.read(spark, sf, "customer").select(line.alias("value")))
    return found.select("kind", F.coalesce("name", F.concat_ws(">", "from", "to")).alias("item"))


# Small functions


def x03_words(spark, sf):
    return _docs(spark, sf).select("doc_id", X.word_count(F.col("text")).alias("words"))


def x20_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


FLAGS = ("TRUE", "yes", "1", "No", "false", "0", "maybe", "")
NUMBERS = ("", " 12 ", "1e3", "Infinity", "abc", "-4.5", "0x1F", "NaN", "1d")


def x24_booleans(spark, sf):
    said = F.get(F.array(*map(F.lit, FLAGS)), (F.col("event_id") % len(FLAGS)).cast("int"))
    return B.read(spark, sf, "events").select("event_id", N.to_boolean(said).alias("flag"))


def x25_numbers(spark, sf):
    k = F.col("event_id") % (len(NUMBERS) + 1)
    said = F.coalesce(F.get(F.array(*map(F.lit, NUMBERS)), k.cast("int")), F.col("value").cast("string"))
    return B.read(spark, sf, "events").select("event_id", N.to_number(said).alias("number"))


def x27_changes(spark, sf):
    rows = B.read(spark, sf, "lineitem").select(N.signed_change(F.col("l_quantity").cast("long"), F.col("l_linenumber") * 7).alias("change"))
    return rows.groupBy("change").agg(F.count("*").alias("n"))


def x30_one_liners(spark, sf):
    return _docs(spark, sf).select("doc_id", X.one_liner(F.col("text")).alias("line"))


def x31_sizes(spark, sf):
    return _docs(spark, sf).groupBy(N.headline_size(X.headline(F.col("text")), F.col("lang") == "fr").alias("size")).agg(F.count("*").alias("n"))


def x39_urls(spark, sf):
    base = _say("https://", F.lower("s_name"), F.repeat(F.lit("/"), (F.col("s_suppkey") % 4).cast("int")))
    return B.read(spark, sf, "supplier").select("s_suppkey", X.public_url(base, _say(F.col("s_suppkey"), ".jpg")).alias("url"))


def x44_image_names(spark, sf):
    k = F.col("p_partkey")
    name = _say(F.when(k % 3 == 0, F.upper(F.md5("p_name"))).otherwise(F.md5("p_name")), F.when(k % 5 == 0, ".jpeg").otherwise(".jpg"))
    return B.read(spark, sf, "part").select("p_partkey", X.image_token(name).alias("token"))


def x46_kinds(spark, sf):
    kind = X.first_match(F.col("text"), [("$$$", "money"), ("!!", "shout"), ("@", "address"), (" und ", "german")], "plain")
    return _docs(spark, sf).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def d04_shifted_days(spark, sf):
    o = B.opportunities(spark, sf)
    return o.select("id", F.date_add(F.to_date("created"), (F.col("id") % 40 - 20).cast("int")).cast("string").alias("day"))


def d07_utc_days(spark, sf):
    return B.verbs(spark, sf).groupBy(D.utc_day(F.col("ts")).cast("string").alias("day")).agg(F.count("*").alias("n"))


# Prompts and report blocks


def x22_system_prompt(spark, sf):
    k, name = F.col("s_suppkey"), F.col("s_name")
    scenario = F.when(k % 4 > 0, F.repeat(F.lit("pattern of the post. "), (k % 90 * 10).cast("int")))
    made = P.system_prompt(name, F.when(k % 2 == 0, _say("plain, like ", name)), F.when(k % 3 > 0, _say("words of ", name)), F.lit("Banned words: the, und"), _say("scenario ", k % 9), scenario)
    rows = B.read(spark, sf, "supplier").select("s_suppkey", made.alias("m"))
    return rows.select("s_suppkey", F.md5("m.prompt").alias("prompt"), "m.tokens", "m.truncated", F.array_join("m.warnings", ", ").alias("warnings"))


def x42_day_prompt(spark, sf):
    k = F.col("p_partkey")
    before = F.slice(F.array(F.col("p_name"), F.col("p_brand"), F.col("p_type")), F.lit(1), (k % 4).cast("int"))
    asked = P.day_prompt(F.replace("p_name", F.lit(" "), F.lit("_")), _say("1. ", F.col("p_type")), before, F.when(k % 5 == 0, "linkedin"), F.when(k % 5 == 0, _say("[dash_policy] ", k)))
    return B.read(spark, sf, "part").select("p_partkey", asked.alias("prompt"))


def x50_awaiting_action(spark, sf):
    """What is still to be provided, as a checklist; some items always are."""
    k = F.col("s_suppkey")
    items = F.array_compact(
        F.array(F.when(k % 3 == 0, _say("**Library:** `lib/", k, "` is empty.")), F.when(k % 4 == 0, "**Photos:** none."), F.when(k % 2 == 1, "**Logo file:** missing."), F.lit("**Account connections:** to be confirmed."))
    )
    lines = F.transform(items, lambda x: F.concat(F.lit("- [ ] "), x))
    return B.read(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("## Awaiting action\n\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("section"))


def c19_pattern_audit(spark, sf):
    """The table of configured patterns with what each is for, a page of fifty at a time."""
    intent = X.first_match(F.col("p_name"), [("red", "money"), ("blue", "activity"), ("small", "milestones")], "personal context")
    rows = B.read(spark, sf, "part").select("p_partkey", B.page(50, "p_partkey"), "p_name", intent.alias("intent"))
    lists = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "intent"))).alias("l"))
    lines = F.transform("l", lambda r, i: _say("| ", i + 1, " | `", r["p_name"], "` | ", r["intent"], " |"))
    return lists.select("page", F.concat(F.lit("| # | Regex pattern | Intent |\n|---|---|---|\n"), F.array_join(lines, "\n")).alias("audit"))


def c20_brand_lookup(spark, sf):
    """Of asked keys the brand's name, else null, and how many sections its tone file has."""
    k = F.col("s_suppkey")
    brands = B.read(spark, sf, "supplier").select(_say("brand", k).alias("doc"), F.col("s_name").alias("display"), _say("## Voice\nv", k, F.when(k % 2 == 0, "\n## Facts\nf\n").otherwise("")).alias("text"))
    counts = markdown.sections(brands).groupBy("doc").agg(F.count("*").alias("sections"))
    asked = B.read(spark, sf, "part").select("p_partkey", _say("brand", F.col("p_partkey")).alias("doc"))
    known = brands.select("doc", "display").join(counts, "doc")
    return asked.join(known, "doc", "left").select("p_partkey", "display", F.coalesce("sections", F.lit(0)).cast("long").alias("sections"))


# Flows


def c03_rewrite(spark, sf):
    """Killed drafts go back with the reviewer's notes and what was written."""
    killed = B.reviews(spark, sf).filter("fate = 'killed'").select("doc_id", "brand").join(_docs(spark, sf).select("doc_id", "text"), "doc_id")
    asked = P.rewrite_prompt(_say("shorter, and less of ", F.col("brand")), F.col("text"))
    return killed.select("doc_id", F.md5(asked).alias("prompt"), X.token_estimate(asked).alias("tokens"))


def c04_content_batch(spark, sf):
    """Batches of twenty drafts of a brand: the header of each and how many drafts are clean or flagged."""
    checked = rules.validate(_docs(spark, sf), VOICE).groupBy(F.col("source").alias("brand"), B.page(20, "doc_id"))
    counts = checked.agg(F.count("*").alias("posted"), R.count_if(F.col("passed")).alias("clean"), R.count_if(~F.col("passed")).alias("flagged"))
    return counts.withColumn("header", F.concat(F.lit("Content batch - "), F.col("brand"), F.lit("\n"), N.plural(F.col("posted"), "draft")))


def c05_approval_batch(spark, sf):
    """A brand below its cap gets its first three killed drafts posted again: they are pending then."""
    r = B.reviews(spark, sf)
    gate = R.backlog_gate(r.filter("fate = 'pending'"), 3, 30, "brand")
    first = Window.partitionBy("brand").orderBy("doc_id")
    again = r.filter("fate = 'killed'").withColumn("_rn", F.row_number().over(first)).filter("_rn <= 3").drop("_rn").join(gate.filter("admitted > 0"), "brand", "left_semi")
    after = state.upsert(r, again.withColumn("fate", F.lit("pending")).select(*r.columns), "doc_id")
    pending = after.groupBy("brand").agg(R.count_if(F.col("fate") == "pending").alias("pending"))
    posted = again.groupBy("brand").agg(F.count("*").alias("posted"))
    rows = gate.join(posted, "brand", "left").join(pending, "brand")
    return rows.select("brand", "backlog", F.coalesce("posted", F.lit(0)).cast("long").alias("posted"), "pending", (F.col("admitted") == 0).alias("at_cap"))


def c06_approve(spark, sf):
    """Approved texts get their brand's next free slot; scripts of videos get a place in the shoot list."""
    r = B.reviews(spark, sf).filter("fate = 'approved'")
    day = F.date_add(F.lit("2001-08-06").cast("date"), (F.col("s_suppkey") % 5).cast("int"))
    taken = B.read(spark, sf, "supplier").select(D.instant(day, F.lit("09:00")).alias("at")).distinct()
    free = _calendar(spark).join(taken, "at", "left_anti").select("at")
    texts = A.first_free(r.filter("channel <> 'es'"), free, "doc_id", "brand").select("doc_id", "brand", F.col("at").cast("string").alias("slot"), F.lit(None).cast("string").alias("shoot"))
    videos = A.places(r.filter("channel = 'es'"), F.lit(0), "doc_id", "brand").select("doc_id", "brand", F.lit(None).cast("string").alias("slot"), F.col("place").cast("string").alias("shoot"))
    return texts.unionByName(videos)


def c08_variants(spark, sf):
    """A draft and two repairs: stripped, checked by voice, sanity and block rules; the first that passes, else
    the last."""
    t = F.col("text")
    tries = F.array(t, F.regexp_replace(t, "!+", "."), F.regexp_replace(t, "[!$%&*]+", "."))
    drafts = _docs(spark, sf).select("doc_id", F.posexplode(tries).alias("attempt", "text")).withColumn("attempt", F.col("attempt") + 1)
    drafts = drafts.withColumn("text", _say("Sure!\n---\n", F.col("text"), "\nNext move: call"))
    return state.accepted_attempt(rules.checked_variant(drafts, VOICE, 2026), "doc_id", "attempt", "passed", 3)


def c11_round_posts(spark, sf):
    """A week's posts as messages by day: each cut to the channel's limit, its last message the one to react to."""
    post = _say("**", F.upper("lang"), "** `", F.col("doc_id"), "`\n", F.col("text"))
    rows = _docs(spark, sf).select("doc_id", (F.col("doc_id") % 6).alias("day"), X.chunks(1900)(post).alias("m"))
    return rows.select("doc_id", "day", F.size("m").cast("long").alias("messages"), F.md5(F.try_element_at("m", F.lit(-1))).alias("react_key"))


def c12_rewritten_posts(spark, sf):
    """Killed posts get their rewritten body, checked, and are pending again; the others stay as they are."""
    r = B.reviews(spark, sf).select("doc_id", "fate", F.lit(1).alias("attempts"), F.lit(None).cast("boolean").alias("passed"))
    bodies = r.filter("fate = 'killed'").select("doc_id").join(_docs(spark, sf).select("doc_id", F.regexp_replace("text", "!+", "!").alias("text")), "doc_id")
    checked = rules.checked_variant(bodies, VOICE, 2026)
    changes = checked.select("doc_id", F.lit("pending").alias("fate"), F.lit(2).alias("attempts"), "passed")
    return state.update(r, changes, "doc_id").withColumn("attempts", F.col("attempts").cast("long"))


def c13_image_phase(spark, sf):
    """Cards of approved posts that have none: template by channel, type size by headline, a name by content."""
    cards = spark.createDataFrame([("fr", "quote"), ("de", "stat")], "channel string, template string")
    missing = B.reviews(spark, sf).filter((F.col("fate") == "approved") & (F.col("doc_id") % 3 == 0)).join(F.broadcast(cards), "channel")
    posts = missing.join(_docs(spark, sf).select("doc_id", X.headline(F.col("text")).alias("headline")), "doc_id")
    return posts.select("doc_id", "template", N.headline_size(F.col("headline"), F.col("channel") == "de").alias("font"), _say(F.md5("headline"), ".jpg").alias("file"))


L, R_, O, V = B.SQL_LEADS, B.SQL_REVIEWS, B.SQL_OPPORTUNITIES, B.SQL_VERBS  # noqa: E741
NOW = "TIMESTAMP '2001-07-31 00:00:00'"
AT = "timezone('UTC', timezone('America/Los_Angeles', {}))"
CALENDAR = f"(SELECT {AT.format('d + t')} AS at FROM (SELECT DATE '2001-08-06' + CAST(unnest(range(31)) AS INT) AS d) CROSS JOIN (VALUES (TIME '09:00'), (TIME '13:00')) v(t) WHERE dayofweek(d) <> 0)"
MORNING = "DATE '2001-08-06' + CAST(s_suppkey % 5 AS INT) + TIME '09:00'"
TAKEN = f"(SELECT DISTINCT {AT.format(MORNING)} AS at FROM supplier)"
FRENCH = "lang = 'fr'"
SHOUT = "CAST(regexp_matches({t}, '(?i)[a-z]+!!') AS INT) + CAST(contains({t}, '—') AS INT) + CAST(contains({t}, '–') AS INT) + CAST(contains({t}, ' - ') AS INT)"
#: t11 (doc_id, t) of the dash steps -> checked (doc_id, n), how many failures a stripped text has.
CHECKED = f"t AS (SELECT * EXCLUDE (t), t AS text FROM t{len(X.DASH_STEPS)}), {SANITY}, checked AS (SELECT *, {SHOUT.format(t='text')} + len(hard) + CAST(regexp_matches(text, '(?i)theer|onin the') AS INT) AS n FROM sanity)"
HEADLINES = r"""h0 AS (SELECT *, regexp_extract(text, '^[^.!?]+[.!?]') AS s FROM documents), h1 AS (SELECT *, CASE WHEN s = '' THEN substr(text, 1, 90) ELSE trim(s) END AS c FROM h0),
        h AS (SELECT *, CASE WHEN length(c) > 90 THEN substr(c, 1, 87) || '…' ELSE c END AS headline FROM h1)"""
FONT = "CASE WHEN length(headline) <= 38 THEN 84 WHEN length(headline) <= 64 THEN 68 ELSE 56 END"


def _sized(short: str) -> str:
    return f"CAST(CASE WHEN {short} THEN floor({FONT} * 0.78 + 0.5) ELSE {FONT} END AS BIGINT)"


ORACLES = {
    "s03_split_rows": """WITH l AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' | ' WHEN 1 THEN '|' ELSE '' END || 'a' || p_partkey || ' | ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ||' ELSE ' | ' END || p_type || CASE WHEN p_partkey % 5 = 0 THEN ' |' ELSE '' END AS l FROM part)
        SELECT p_partkey, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(trim(l), '^[|]', ''), '[|]$', ''), '|'), lambda c: trim(c)), '~') AS cells FROM l""",
    "s10_leads_file": f"WITH {L} SELECT seq, name FROM l",
    "s21_form_requests": """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'refused: invalid JSON' WHEN trim(coalesce(text, '')) = '' OR turn % 4 = 0 THEN 'refused: ' || array_to_string(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'missing name' END, CASE WHEN turn % 4 = 0 THEN 'missing email' END], lambda x: x IS NOT NULL), ', ')
        ELSE 'request,hot,' || role END AS outcome FROM conversations""",
    "k14_alerts": "SELECT doc_id, length(substr(text, 1, 1800)) AS chars, md5(substr(text, 1, 1800)) AS alert FROM documents",
    "f04_blocked": "SELECT doc_id, regexp_matches(text, '(?i)theer|onin the') AS blocked FROM documents",
    "f07_created_today": f"WITH {O} SELECT id, status FROM o WHERE CAST(created AS DATE) = DATE '2001-07-31'",
    "f08_rolling_week": f"WITH {O} SELECT id, status FROM o WHERE created >= {NOW} - INTERVAL 7 DAYS OR (status = 'won' AND updated >= {NOW} - INTERVAL 7 DAYS)",
    "f20_old_images": f"SELECT p_partkey, md5(p_name) || '-' || p_partkey || '.jpg' AS name FROM part WHERE p_partkey % 4 <> 0 AND TIMESTAMP '2001-06-01' + to_days(CAST(p_partkey % 60 AS INT)) < {NOW} - INTERVAL 30 DAYS AND p_partkey NOT IN (SELECT l_partkey - l_partkey % 3 FROM lineitem)",
    "j11_taken_slots": f'SELECT "at" FROM {CALENDAR} WHERE "at" IN (SELECT "at" FROM {TAKEN})',
    "j12_registry": "SELECT CASE WHEN s_suppkey % 9 BETWEEN 1 AND 5 THEN 'scenario ' || s_suppkey % 9 ELSE 'unknown' END AS title, count(*) AS n FROM supplier GROUP BY 1",
    "a16_term_counts": "SELECT term, CAST(sum(len(regexp_extract_all(text, '(?i)\\b' || term || '\\b'))) AS BIGINT) AS n FROM documents CROSS JOIN (VALUES ('the'), ('und'), ('of'), ('la')) v(term) GROUP BY term",
    "u01_failures": r"""WITH f AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '(?i)\bthe\b') THEN 'banned_words' END, CASE WHEN regexp_matches(text, '(?i)[a-z]+!!') THEN 'banned_structures' END, CASE WHEN contains(text, '—') THEN 'dash_policy' END,
        CASE WHEN contains(text, '–') THEN 'dash_policy' END, CASE WHEN contains(text, ' - ') THEN 'dash_policy' END], lambda x: x IS NOT NULL) AS f FROM documents) SELECT doc_id, CAST(unnest(range(len(f))) AS BIGINT) AS ord, unnest(f) AS "check" FROM f""",
    "t03_lapse_sweep": f"WITH {O} SELECT stage_id, count(*) FILTER (created >= {NOW} - INTERVAL 72 HOURS) AS pending, count(*) FILTER (created < {NOW} - INTERVAL 72 HOURS) AS evicted FROM o WHERE status = 'open' GROUP BY stage_id",
    "t09_back_pressure": f"WITH {R_} SELECT brand, count(*) AS backlog, CAST(CASE WHEN count(*) + 3 > 30 THEN 0 ELSE 3 END AS BIGINT) AS admitted FROM r WHERE fate = 'pending' GROUP BY brand",
    "c16_specificity": f"SELECT doc_id, CAST(NOT {SPECIFIC} AS BIGINT) AS warnings FROM documents",
    "c17_week_seeds": f"""WITH {L}, k AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY seq) AS rn, min(seq) OVER (PARTITION BY city) AS f FROM l),
        q AS (SELECT name, city, row_number() OVER (ORDER BY rn, f) - 1 AS i, count(*) OVER () AS n FROM k QUALIFY i < 24), p AS (SELECT unnest(range(24)) AS p)
        SELECT CAST(p // 4 AS BIGINT) AS day, string_agg((p % 4 + 1) || '. (' || city || ') ' || name, chr(10) ORDER BY p) AS lines FROM p JOIN q ON p % least(24, n) = i GROUP BY 1""",
    "c18_graph_scans": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'entity' ELSE 'relation' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_custkey || '>' || (c_custkey + 1) END AS item FROM customer",
    "x03_words": "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS words FROM documents",
    "x20_tokens": "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents",
    "x24_booleans": f"WITH s AS (SELECT event_id, {list(FLAGS)}[event_id % {len(FLAGS)} + 1] AS s FROM events) SELECT event_id, CASE WHEN lower(s) IN ('true', 'yes', '1') THEN TRUE WHEN lower(s) IN ('false', 'no', '0') THEN FALSE END AS flag FROM s",
    "x25_numbers": f"""WITH s AS (SELECT event_id, value, event_id % {len(NUMBERS) + 1} AS k, trim({list(NUMBERS)}[event_id % {len(NUMBERS) + 1} + 1]) AS s FROM events)
        SELECT event_id, CASE WHEN k = {len(NUMBERS)} THEN value WHEN s = '' THEN 0 WHEN regexp_matches(s, '^0[xX][0-9a-fA-F]+$') THEN CAST(CAST(s AS BIGINT) AS DOUBLE) WHEN regexp_matches(s, '^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$') THEN TRY_CAST(s AS DOUBLE) END AS number FROM s""",
    "x27_changes": "WITH d AS (SELECT CAST(trunc(l_quantity) AS BIGINT) - l_linenumber * 7 AS d FROM lineitem) SELECT CASE WHEN d = 0 THEN '±0' WHEN d > 0 THEN '+' || d ELSE CAST(d AS VARCHAR) END AS change, count(*) AS n FROM d GROUP BY 1",
    "x30_one_liners": r"WITH o AS (SELECT doc_id, text, regexp_extract(text, '^[^.!?\n]+[.!?]') AS o FROM documents) SELECT doc_id, CASE WHEN o = '' THEN substr(text, 1, 80) ELSE trim(o) END AS line FROM o",
    "x31_sizes": f"WITH {HEADLINES} SELECT {_sized(FRENCH)} AS size, count(*) AS n FROM h GROUP BY 1",
    "x39_urls": "SELECT s_suppkey, 'https://' || lower(s_name) || '/images/' || s_suppkey || '.jpg' AS url FROM supplier",
    "x44_image_names": r"WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(md5(p_name)) ELSE md5(p_name) END || CASE WHEN p_partkey % 5 = 0 THEN '.jpeg' ELSE '.jpg' END AS n FROM part) SELECT p_partkey, nullif(regexp_extract(n, '^([0-9a-f]{32})\.jpg$', 1), '') AS token FROM n",
    "x46_kinds": "SELECT CASE WHEN contains(text, '$$$') THEN 'money' WHEN contains(text, '!!') THEN 'shout' WHEN contains(text, '@') THEN 'address' WHEN contains(text, ' und ') THEN 'german' ELSE 'plain' END AS kind, count(*) AS n FROM documents GROUP BY 1",
    "d04_shifted_days": f"WITH {O} SELECT id, CAST(CAST(created AS DATE) + CAST(id % 40 - 20 AS INT) AS VARCHAR) AS day FROM o",
    "d07_utc_days": f"WITH {V} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM e GROUP BY 1",
    "x22_system_prompt": """WITH s AS (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 4 > 0 THEN repeat('pattern of the post. ', s_suppkey % 90 * 10) END AS sc FROM supplier),
        h AS (SELECT *, 'Brand: ' || name || chr(10) || chr(10) || CASE WHEN k % 2 = 0 THEN 'Voice' || chr(10) || 'plain, like ' || name || chr(10) || chr(10) ELSE '' END
            || CASE WHEN k % 3 > 0 THEN 'Examples' || chr(10) || 'words of ' || name ELSE 'Spare examples' || chr(10) || 'Banned words: the, und' END || chr(10) || chr(10) AS head,
            'Stay within the examples.' AS tail FROM s),
        w AS (SELECT *, head || CASE WHEN sc IS NULL THEN '' ELSE 'Scene: scenario ' || k % 9 || chr(10) || sc || chr(10) || chr(10) END || tail AS whole,
            head || 'Scene: scenario ' || k % 9 || chr(10) || substr(sc, 1, CAST(length(sc) // 2 AS INT)) || chr(10) || chr(10) || '(shortened)' || chr(10) || chr(10) || tail AS halved FROM h),
        c AS (SELECT *, ceil(length(whole) / 4.0) > 3000 AND sc IS NOT NULL AS cut FROM w), p AS (SELECT *, CASE WHEN cut THEN halved ELSE whole END AS p FROM c), n AS (SELECT *, CAST(ceil(length(p) / 4.0) AS BIGINT) AS n FROM p)
        SELECT k AS s_suppkey, md5(p) AS prompt, n AS tokens, cut AS truncated, array_to_string(list_filter([CASE WHEN k % 3 = 0 THEN 'references missing' END, CASE WHEN sc IS NULL THEN 'scenario missing' END, CASE WHEN cut THEN 'scenario halved' END,
            CASE WHEN n > 3000 THEN 'over budget' WHEN n > 2500 THEN 'near budget' END], lambda x: x IS NOT NULL), ', ') AS warnings FROM n""",
    "x42_day_prompt": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Faults of the linkedin text' || chr(10) || '[dash_policy] ' || p_partkey || chr(10) || chr(10) ELSE '' END
        || CASE WHEN p_partkey % 4 > 0 THEN 'Already said' || chr(10) || array_to_string(list_transform([p_name, p_brand, p_type][1:p_partkey % 4], lambda s, i: i || ': ' || s), chr(10)) || chr(10) || chr(10) ELSE '' END
        || 'Wanted: 3 texts on ' || p_name || chr(10) || chr(10) || 'Material' || chr(10) || '1. ' || p_type || chr(10) AS prompt FROM part""",
    "x50_awaiting_action": """SELECT s_suppkey, '## Awaiting action' || chr(10) || chr(10) || array_to_string(list_transform(list_filter([CASE WHEN s_suppkey % 3 = 0 THEN '**Library:** `lib/' || s_suppkey || '` is empty.' END, CASE WHEN s_suppkey % 4 = 0 THEN '**Photos:** none.' END,
        CASE WHEN s_suppkey % 2 = 1 THEN '**Logo file:** missing.' END, '**Account connections:** to be confirmed.'], lambda x: x IS NOT NULL), lambda x: '- [ ] ' || x), chr(10)) || chr(10) AS section FROM supplier""",
    "c19_pattern_audit": """WITH r AS (SELECT p_partkey // 50 AS page, p_partkey, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS i, p_name, CASE WHEN contains(p_name, 'red') THEN 'money' WHEN contains(p_name, 'blue') THEN 'activity' WHEN contains(p_name, 'small') THEN 'milestones' ELSE 'personal context' END AS intent FROM part)
        SELECT page, '| # | Regex pattern | Intent |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || i || ' | `' || p_name || '` | ' || intent || ' |', chr(10) ORDER BY i) AS audit FROM r GROUP BY page""",
    "c20_brand_lookup": "SELECT p_partkey, s_name AS display, CAST(CASE WHEN s_suppkey IS NULL THEN 0 WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS sections FROM part LEFT JOIN supplier ON s_suppkey = p_partkey",
    "c03_rewrite": f"""WITH {R_}, p AS (SELECT doc_id, 'Notes' || chr(10) || 'shorter, and less of ' || brand || chr(10) || chr(10) || 'Text' || chr(10) || text AS p FROM r JOIN documents USING (doc_id) WHERE fate = 'killed')
        SELECT doc_id, md5(p) AS prompt, CAST(ceil(length(p) / 4.0) AS BIGINT) AS tokens FROM p""",
    "c04_content_batch": f"""WITH c AS (SELECT source AS brand, doc_id // 20 AS page, {SHOUT.format(t='text')} = 0 AS ok FROM documents)
        SELECT brand, page, count(*) AS posted, count(*) FILTER (ok) AS clean, count(*) FILTER (NOT ok) AS flagged, 'Content batch - ' || brand || chr(10) || count(*) || ' draft' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS header FROM c GROUP BY brand, page""",
    "c05_approval_batch": f"""WITH {R_}, g AS (SELECT brand, count(*) FILTER (fate = 'pending') AS backlog, least(3, count(*) FILTER (fate = 'killed')) AS killed FROM r GROUP BY brand)
        SELECT brand, backlog, CAST(CASE WHEN backlog + 3 > 30 THEN 0 ELSE killed END AS BIGINT) AS posted, CAST(backlog + CASE WHEN backlog + 3 > 30 THEN 0 ELSE killed END AS BIGINT) AS pending, backlog + 3 > 30 AS at_cap FROM g WHERE backlog > 0""",
    "c06_approve": f"""WITH {R_}, a AS (SELECT doc_id, brand, channel = 'es' AS video, row_number() OVER (PARTITION BY brand, channel = 'es' ORDER BY doc_id) AS i FROM r WHERE fate = 'approved'),
        f AS (SELECT "at", row_number() OVER (ORDER BY "at") AS i FROM {CALENDAR} WHERE "at" NOT IN (SELECT "at" FROM {TAKEN}))
        SELECT doc_id, brand, CASE WHEN NOT video THEN CAST("at" AS VARCHAR) END AS slot, CASE WHEN video THEN CAST(i AS VARCHAR) END AS shoot FROM a LEFT JOIN f USING (i)""",
    "c08_variants": f"""WITH s0 AS (SELECT doc_id, attempt, 'Sure!' || chr(10) || '---' || chr(10) || CASE attempt WHEN 1 THEN text WHEN 2 THEN regexp_replace(text, '!+', '.', 'g') ELSE regexp_replace(text, '[!$%&*]+', '.', 'g') END || chr(10) || 'Next move: call' AS t FROM documents CROSS JOIN (VALUES (1), (2), (3)) v(attempt)),
        {SCAFFOLDING}, t0 AS (SELECT * FROM s4), {DASHES}, {CHECKED}
        SELECT doc_id, CAST(coalesce(min(attempt) FILTER (n = 0), 3) AS BIGINT) AS attempt, min(attempt) FILTER (n = 0) IS NOT NULL AS passed FROM checked GROUP BY doc_id""",
    "c12_rewritten_posts": f"""WITH {R_}, s0 AS (SELECT doc_id, regexp_replace(text, '!+', '!', 'g') AS t FROM r JOIN documents USING (doc_id) WHERE fate = 'killed'), {SCAFFOLDING}, t0 AS (SELECT * FROM s4), {DASHES}, {CHECKED}
        SELECT doc_id, CASE WHEN fate = 'killed' THEN 'pending' ELSE fate END AS fate, CAST(CASE WHEN fate = 'killed' THEN 2 ELSE 1 END AS BIGINT) AS attempts, n = 0 AS passed FROM r LEFT JOIN checked USING (doc_id)""",
    "c13_image_phase": f"""WITH {R_}, {HEADLINES} SELECT doc_id, CASE channel WHEN 'fr' THEN 'quote' ELSE 'stat' END AS template, {_sized("channel = 'de'")} AS font, md5(headline) || '.jpg' AS file FROM r JOIN h USING (doc_id) WHERE fate = 'approved' AND doc_id % 3 = 0 AND channel IN ('fr', 'de')""",
}
DATED = {"j11_taken_slots": ("at",)}
QUERIES = {k: B.as_text(globals()[k], DATED.get(k, ())) for k in (*ORACLES, "c11_round_posts")}
ORACLES = {k: B.sql_as_text(q, DATED.get(k, ())) for k, q in ORACLES.items()}
