"""Text functions and rules over documents and over texts made of table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions import numbers as N
from opsloom.functions import text as X
from opsloom.operators import rules as R
from opsloom.plans import bindings as B


def _id() -> Column:
    return F.col("doc_id")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return B.read(spark, sf, "documents")


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def x01_scrub(spark, sf):
    text = _say("Sam, ", F.col("text"), " mail a", _id(), "@b.example.org\n see www.x", _id(), ".com/a  end")
    return _docs(spark, sf).select("doc_id", X.scrub_identity(text).alias("scrubbed"))


def x02_sentences(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(X.sentences(F.col("text")))).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("col").alias("sentence"))


def x04_syllables(spark, sf):
    return X.words_by_syllables(_docs(spark, sf), F.col("text"))


def x05_grade(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", X.word_count(t).alias("words"), F.round(X.reading_grade(t), 6).alias("grade"))


def x06_windows(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(X.context_windows(F.col("text"), "Tion", 10), "|").alias("windows"))


def x07_specific(spark, sf):
    # of four documents three get a marker of another kind behind what they say themselves
    text = _say(F.col("text"), " We saw ", F.when(_id() % 4 == 0, "$ 5").when(_id() % 4 == 1, "12 %").when(_id() % 4 == 2, "Pool pumps").otherwise("poolside reno"), " today")
    return _docs(spark, sf).select("doc_id", X.is_specific(text).alias("specific"))


def x08_strip_dashes(spark, sf):
    text = _say("– lead ", _id(), " – ", _id() + 1, " then two — three. — four, - five follow-up x - y $ – z end— ", F.col("text"), "\n— ", F.col("source"))
    return _docs(spark, sf).select("doc_id", X.strip_dashes(text).alias("stripped"))


def x09_strip_scaffolding(spark, sf):
    text = _say("\nHere's the draft:\n---\n", F.col("text"), "\n\n\n\nlast ", _id(), "\n***\nNext move: call")
    return _docs(spark, sf).select("doc_id", X.strip_scaffolding(text).alias("stripped"))


def x10_sanity(spark, sf):
    text = _say("In ", _id() % 40 + 1990, " and 1998. Data shows it, according to a study", F.when(_id() % 2 == 0, "").otherwise(" Google \"abc\" and"), ". ", F.col("text"))
    hard, soft = R.sanity(text, 2026)
    told = lambda c: F.array_join(F.transform(c, lambda f: f["detail"]), "; ")
    return _docs(spark, sf).select("doc_id", told(hard).alias("hard"), told(soft).alias("soft"))


def x11_banned_words(spark, sf):
    found = R.banned_words(F.col("text"), [R.Word("the"), R.Word("und", hint="conj"), R.Word("of", exception="e")])
    return _docs(spark, sf).select("doc_id", F.array_join(F.transform(found, lambda f: f["detail"]), "; ").alias("details"))


def x12_structures(spark, sf):
    found = R.banned_structures(F.col("text"), [("shout", "[a-z]+!!"), ("symbols", "[$%&]{3}")])
    return _docs(spark, sf).select("doc_id", F.array_join(F.transform(found, lambda f: f["detail"]), "; ").alias("details"))


def x13_dash_policy(spark, sf):
    text = _say("a", F.when(_id() % 2 == 0, " - ").otherwise("-"), "b", F.when(_id() % 3 == 0, "—").otherwise(","), F.when(_id() % 5 == 0, "–").otherwise("."), F.col("text"))
    found = R.dashes(text, "none")
    return _docs(spark, sf).select("doc_id", F.array_join(F.transform(found, lambda f: f["detail"]), "; ").alias("details"))


def x14_long_sentences(spark, sf):
    found = R.long_sentences(F.col("text"), 20)
    return _docs(spark, sf).select("doc_id", F.explode(found).alias("f")).select("doc_id", F.col("f.detail").alias("detail"))


def x15_reading_level(spark, sf):
    return _docs(spark, sf).agg(F.count_if(F.size(R.reading_level(F.col("text"), 12.0)) > 0).alias("above"))


SCENARIOS = [R.Scenario("loud", ["[a-z]+!!"], ["the", "und"], ["past_recap_present_win"])]


def x16_scenarios(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", F.size(R.scenario_hits(t, SCENARIOS)).cast("long").alias("hard"), F.size(R.scenario_hints(t, SCENARIOS)).cast("long").alias("soft"))


VOICE = R.Voice(words=[R.Word("the")], structures=[("shout", "[a-z]+!!")], scenarios=SCENARIOS, most_words=20)


def x17_validate(spark, sf):
    checked = R.validate(_docs(spark, sf), VOICE)
    return checked.select("doc_id", F.size("hard").cast("long").alias("hard"), F.size("soft").cast("long").alias("soft"), "passed")


def x18_feedback(spark, sf):
    checked = R.validate(_docs(spark, sf), R.Voice(structures=[("shout", "[a-z]+!!")], most_words=10_000))
    return checked.select("doc_id", R.feedback(F.col("hard"), F.col("soft"), _id() % 2).alias("feedback"))


def x19_openers(spark, sf):
    text = _say(F.when(_id() % 3 == 0, "Certainly! ").when(_id() % 3 == 1, "Great question, absolutely. ").otherwise("I "), "say ", _id(), " ", F.col("text"))
    return _docs(spark, sf).select("doc_id", X.strip_openers(text).alias("said"))


def x21_budget(spark, sf):
    cut = X.within_budget(F.col("text"), F.substring("text", 1, 30))
    return _docs(spark, sf).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), cut["scenario"].alias("scenario"), cut["status"].alias("status"))


def x23_observations(spark, sf):
    e = B.read(spark, sf, "events")
    said = F.array(_say("kind: ", F.col("event_type")), _say("value:", F.col("value")), F.lit("no colon"), F.lit(" : none"), _say("kind: again:", F.col("user_id")), F.lit("flag: YES"), F.lit("empty:"))
    m = X.observation_map(said)
    return e.select("event_id", m["kind"].alias("kind"), N.to_number(m["value"]).alias("value"), N.to_boolean(m["flag"]).alias("flag"), N.to_number(m["empty"]).alias("empty"), F.size(m).cast("long").alias("n"))


def x26_currency(spark, sf):
    c = B.read(spark, sf, "customer")
    return c.select("c_custkey", N.currency(F.col("c_acctbal")).alias("money"), N.signed_change(F.col("c_custkey") % 5, F.col("c_custkey") % 3).alias("change"))


def x28_chunks(spark, sf):
    pieces = X.chunks(500)(F.col("text"))
    return _docs(spark, sf).withColumn("p", pieces).select("doc_id", F.size("p").cast("long").alias("n"), (F.array_join("p", "") == F.col("text")).alias("whole"), F.array_max(F.transform("p", F.length)).cast("long").alias("longest"))


def x29_headline(spark, sf):
    return _docs(spark, sf).select("doc_id", X.headline(F.col("text")).alias("headline"), X.one_liner(F.col("text")).alias("line"), N.headline_size(X.headline(F.col("text")), _id() % 2 == 0).alias("size"))


def x32_uptime(spark, sf):
    o = B.read(spark, sf, "orders")
    return o.select("o_orderkey", N.uptime(F.col("o_totalprice")).alias("uptime"), N.memory(F.col("o_totalprice") * 1000, F.col("o_totalprice") * 500).alias("memory"))


def x33_slug(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", X.slug(F.col("text")).alias("slug"), X.note_name(F.lit("--"), F.lit("2026-01-02").cast("date")).alias("note"))


def x35_cron(spark, sf):
    c = B.read(spark, sf, "customer")
    value = F.when(F.col("c_custkey") % 3 == 0, _say(F.col("c_custkey") % 60, "  7 * * * America/Los_Angeles")).when(F.col("c_custkey") % 3 == 1, _say(F.col("c_custkey") % 60, " 7 * * *")).otherwise("0 7 * * * local")
    parts = X.cron_parts(value, "UTC")
    return c.select("c_custkey", parts["expr"].alias("expr"), parts["zone"].alias("zone"))


def x36_ids(spark, sf):
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    body = F.when(k % 4 == 0, _say('{"x":"urn:li:person:Ab', key, '"}')).when(k % 4 == 1, _say('{"response_dict":{"sub":"s', key, '"}}')).when(k % 4 == 2, _say('{"data":{"id":"', key, '"},"y":"urn:li:share:', key, '"}')).otherwise(_say('{"deep":[{"creation_id":', k + 100000, "}]}"))
    return B.read(spark, sf, "customer").select("c_custkey", X.person_urn(body).alias("person"), X.share_urn(body).alias("share"), X.graph_id(body).alias("graph"))


def x37_not_ready(spark, sf):
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, "Media is not Ready").when(k % 3 == 1, "error 2207027").otherwise("timeout")
    return B.read(spark, sf, "customer").groupBy(X.media_not_ready(said).alias("wait")).agg(F.count("*").alias("n"))


def x38_ids(spark, sf):
    c = B.read(spark, sf, "customer")
    name = _say(F.md5("c_name"), ".jpg")
    return c.select("c_custkey", X.short_id("wk-", F.col("c_name")).alias("id"), X.public_url(F.lit("https://x.example//"), name).alias("url"), X.image_token(name).alias("token"), X.image_token(F.col("c_name")).alias("none"))


def x40_numbered(spark, sf):
    # a page of a city's leads is a list of 60 at most
    lists = B.leads(spark, sf).groupBy("city", B.page(60)).agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("l"))
    return lists.select("city", "page", X.numbered(F.transform("l", lambda s: _say("(", F.col("city"), ") ", s["name"]))).alias("lines"))


def x43_tags(spark, sf):
    p = B.read(spark, sf, "part")
    niche = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise("  ")
    return p.select("p_partkey", F.array_join(X.tags(["site", "lead"], niche), ",").alias("tags"))


def x45_after_marker(spark, sf):
    return _docs(spark, sf).select("doc_id", X.after_marker(F.col("text"), "the", 100).alias("tail"), X.first_match(F.col("text"), [("!!", "loud"), ("$$$", "symbols"), (" und ", "german")], "plain").alias("kind"))


def x47_lookup(spark, sf):
    names = F.create_map(F.lit("en"), F.lit("English"), F.lit("de"), F.lit("German"))
    d = _docs(spark, sf)
    n = F.count("*")
    return d.groupBy(F.coalesce(F.try_element_at(names, F.col("lang")), F.lit("other")).alias("language")).agg(N.plural(n, "document").alias("said"))


def x48_badges(spark, sf):
    k = F.col("c_custkey")
    status = F.when(k % 3 == 0, "ok").when(k % 3 == 1, "down").otherwise("unknown")
    badge = N.status_badge(F.col("c_name"), status, F.when(k % 2 == 0, k), F.when(k % 5 == 0, "slow").otherwise(""))
    return B.read(spark, sf, "customer").select("c_custkey", badge.alias("badge"))


def x41_pipeline_report(spark, sf):
    """Report text from aggregates: one line per stage, in order."""
    from opsloom.operators.rollups import stage_rollup

    lines = stage_rollup(B.opportunities(spark, sf), B.stages(spark)).withColumn("line", _say("- ", F.col("stage"), ": ", F.col("n"), " (", N.currency(F.col("value")), ")"))
    ordered = lines.agg(F.array_sort(F.collect_list(F.struct("stage", "line"))).alias("l"))
    return ordered.select(F.concat_ws("\n", F.lit("**Pipeline**"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("report"))


def x49_checklist(spark, sf):
    """Conditional checklist of what awaits action, per brand."""
    r = B.reviews(spark, sf).groupBy("brand").agg(F.count_if(F.col("fate") == "pending").alias("p"), F.count_if(F.col("fate") == "killed").alias("k"))
    items = F.array_compact(F.array(F.when(F.col("p") > 0, _say("[ ] review ", F.col("p"))), F.when(F.col("k") > 5, _say("[ ] redo ", F.col("k")))))
    return r.select("brand", F.when(F.size(items) == 0, "nothing").otherwise(F.array_join(items, "; ")).alias("awaiting"))


#: A document's sentences; a word; the syllables of a word.
SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?][''\"]?)\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')".replace('\\"', '"')
WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


def _syllables(w: str) -> str:
    low = f"regexp_replace(lower({w}), '[^a-z]', '', 'g')"
    groups = f"len(regexp_extract_all({low}, '[aeiouy]+'))"
    return f"(CASE WHEN {low} = '' THEN 0 ELSE greatest(1, {groups} - CASE WHEN {low} LIKE '%e' AND {groups} > 1 THEN 1 ELSE 0 END) END)"


HEAD = "FROM documents"
LONG = f"list_filter(list_transform({SENTENCES}, lambda s, i: CASE WHEN len(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '')) > 20 THEN 'sentence ' || i || ' = ' || len(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '')) || ' words (cap 20): \"' || substr(s, 1, 60) || '...\"' END), lambda d: d IS NOT NULL)"
# The same patterns as in opsloom.functions.text and opsloom.operators.rules, in DuckDB's dialect.
RECAP = r"(?i)\b(?:spent|made|been|tried|worked|grinded|grinding)\b.{0,80}\b(?:today|now|finally|just)\b"
SPECIFIC = r"""(regexp_matches(text, '\$\s?\d') OR regexp_matches(text, '\b\d+\s?%') OR regexp_matches(text, '(?i)\b(?:pool|pest|hvac|landscaping|carpet|garage|handyman|cleaning|plumbing|electrical|roofing)\b')
    OR regexp_matches(text, '\b(?:Henderson|Summerlin|Vegas|NLV|Boulder City|Pahrump|Mesquite|Reno|Sparks)\b'))"""
SOFT = f"CAST(regexp_matches(text, '(?i)\\bthe\\b') AS INT) + CAST(regexp_matches(text, '(?i)\\bund\\b') AS INT) + CAST(regexp_matches(text, '{RECAP}') AS INT)"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """A fixed pattern of X in DuckDB's dialect: word boundaries for the lookarounds that stand for them."""
    for look in ("(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"):
        pattern = pattern.replace(look, r"\b")
    return pattern


def _dash_step(pattern: str, becomes: str, raised: bool) -> str:
    replaced = f"regexp_replace(t, {_literal(pattern)}, {_literal(becomes.replace('$', chr(92)))}, 'g')"
    if not raised:
        return replaced
    return f"array_to_string(list_transform(string_split({replaced}, chr(1)), lambda p, i: CASE WHEN i = 1 THEN p ELSE upper(substr(p, 1, 1)) || substr(p, 2) END), '')"


#: t0 (doc_id, t) -> the same after each step; the same fixed values as X.DASH_STEPS.
DASHES = ", ".join(f"t{i + 1} AS (SELECT * REPLACE ({_dash_step(*step)} AS t) FROM t{i})" for i, step in enumerate(X.DASH_STEPS))
TRIMMED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_CHROME = f"({TRIMMED.format('x')} = '' OR regexp_matches(x, {_literal(X.FENCE)}) OR regexp_matches({TRIMMED.format('x')}, {_literal(X.PREAMBLE)}))"
#: s0 (doc_id, t) -> s4 without scaffolding.
SCAFFOLDING = f"""s1 AS (SELECT *, string_split(t, chr(10)) AS l FROM s0),
        s2 AS (SELECT *, list_position(list_transform(l, lambda x: NOT {_CHROME}), true) AS f FROM s1),
        s3 AS (SELECT * EXCLUDE (t, l, f), CASE WHEN coalesce(f, 0) = 0 THEN [] ELSE l[f:] END AS b FROM s2),
        s4 AS (SELECT * EXCLUDE (b, cut), {TRIMMED.format("regexp_replace(array_to_string(list_filter(CASE WHEN cut IS NULL THEN b ELSE b[1:cut] END, lambda x: NOT regexp_matches(x, " + _literal(X.FENCE) + ")), chr(10)), chr(10) || '{3,}', repeat(chr(10), 2), 'g')")} AS t
               FROM (SELECT *, list_max(list_filter(list_transform(b, lambda x, i: CASE WHEN regexp_matches({TRIMMED.format('x')}, {_literal(X.NEXT_MOVE)}) AND i - 1 >= len(b) - 12 THEN i - 1 END), lambda k: k IS NOT NULL)) AS cut FROM s3))"""
_CITED = ", ".join(f"CASE WHEN regexp_matches(text, {_literal(_re2(p))}) THEN {_literal(label + ': ' + chr(34))} || substr(regexp_extract(text, {_literal(_re2(p))}), 1, 60) || '\" — only claims from our own source sheets' END" for p, label in X.CITATIONS)
_YEAR = "'year ' || y || ' referenced (current year is 2026)'"
#: t (doc_id, text) -> sanity (doc_id, hard, soft), lists of details.
SANITY = f"""y1 AS (SELECT *, regexp_extract_all(text, '\\b(?:19|20)\\d{{2}}\\b') AS ys FROM t),
        y2 AS (SELECT *, list_filter(ys, lambda y, i: list_position(ys, y) = i AND y <> '2026') AS other FROM y1),
        sanity AS (SELECT * EXCLUDE (ys, other), list_concat(list_transform(list_filter(other, lambda y: abs(CAST(y AS INT) - 2026) <= 1), lambda y: {_YEAR}), list_filter([{_CITED}], lambda c: c IS NOT NULL)) AS hard,
            list_transform(list_filter(other, lambda y: abs(CAST(y AS INT) - 2026) > 1), lambda y: {_YEAR}) AS soft FROM y2)"""
LOUD = "CAST(regexp_matches(text, '(?i)[a-z]+!!') AS INT)"


ORACLES = {
    "x01_scrub": r"""WITH t AS (SELECT doc_id, 'Sam, ' || text || ' mail a' || doc_id || '@b.example.org' || chr(10) || ' see www.x' || doc_id || '.com/a  end' AS t FROM documents),
        u AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '^[A-Z][a-zA-Z''’.-]+,\s+', ''), '(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b', '[their email]', 'g'),
            '(?i)\b(?:https?://|www\.)\S+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org|biz|info|co|io|us)\b\S*', '[their site]', 'g') AS t FROM t)
        SELECT doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS scrubbed FROM u""",
    "x02_sentences": f"WITH s AS (SELECT doc_id, {SENTENCES} AS s {HEAD}) SELECT doc_id, CAST(unnest(range(len(s))) AS BIGINT) AS pos, unnest(s) AS sentence FROM s",
    "x04_syllables": f"WITH w AS (SELECT unnest({WORDS}) AS w {HEAD}) SELECT CAST({_syllables('w')} AS BIGINT) AS syllables, count(*) AS n FROM w GROUP BY 1",
    "x05_grade": f"WITH w AS (SELECT doc_id, len({WORDS}) AS words, len({SENTENCES}) AS s, CAST(coalesce(list_sum(list_transform({WORDS}, lambda w: {_syllables('w')})), 0) AS BIGINT) AS y {HEAD}) SELECT doc_id, CAST(words AS BIGINT) AS words, round(CASE WHEN s = 0 OR words = 0 THEN 0.0 ELSE CAST(0.39 AS DOUBLE) * (CAST(words AS DOUBLE) / s) + CAST(11.8 AS DOUBLE) * (CAST(y AS DOUBLE) / words) - CAST(15.59 AS DOUBLE) END, 6) AS grade FROM w",
    "x06_windows": """WITH p AS (SELECT doc_id, text, string_split(lower(text), 'tion') AS p FROM documents),
        s AS (SELECT doc_id, text, list_transform(range(1, len(p)), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + 4 * (i - 1) AS BIGINT)) AS s FROM p)
        SELECT doc_id, array_to_string(list_transform(s, lambda a: substr(text, greatest(0, a - 10) + 1, least(length(text), a + 14) - greatest(0, a - 10))), '|') AS windows FROM s""",
    "x07_specific": f"""WITH t AS (SELECT doc_id, text || ' We saw ' || CASE doc_id % 4 WHEN 0 THEN '$ 5' WHEN 1 THEN '12 %' WHEN 2 THEN 'Pool pumps' ELSE 'poolside reno' END || ' today' AS text FROM documents)
        SELECT doc_id, {SPECIFIC} AS specific FROM t""",
    "x08_strip_dashes": f"""WITH t0 AS (SELECT doc_id, '– lead ' || doc_id || ' – ' || (doc_id + 1) || ' then two — three. — four, - five follow-up x - y $ – z end— ' || text || chr(10) || '— ' || source AS t FROM documents), {DASHES}
        SELECT doc_id, t AS stripped FROM t{len(X.DASH_STEPS)}""",
    "x09_strip_scaffolding": f"""WITH s0 AS (SELECT doc_id, chr(10) || 'Here''s the draft:' || chr(10) || '---' || chr(10) || text || repeat(chr(10), 4) || 'last ' || doc_id || chr(10) || '***' || chr(10) || 'Next move: call' AS t FROM documents), {SCAFFOLDING}
        SELECT doc_id, t AS stripped FROM s4""",
    "x10_sanity": f"""WITH t AS (SELECT doc_id, 'In ' || (doc_id % 40 + 1990) || ' and 1998. Data shows it, according to a study' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' Google "abc" and' END || '. ' || text AS text FROM documents), {SANITY}
        SELECT doc_id, array_to_string(hard, '; ') AS hard, array_to_string(soft, '; ') AS soft FROM sanity""",
    "x11_banned_words": r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)\bthe\b')) AS a, len(regexp_extract_all(text, '(?i)\bund\b')) AS b, len(regexp_extract_all(text, '(?i)\bof\b')) AS c,
            string_split(lower(text), 'of') AS p, text FROM documents),
        s AS (SELECT *, list_transform(range(1, len(p)), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + 2 * (i - 1) AS BIGINT)) AS s FROM c),
        w AS (SELECT *, len(list_filter(s, lambda a: NOT contains(lower(substr(text, greatest(0, a - 50) + 1, least(length(text), a + 52) - greatest(0, a - 50))), 'e'))) > 0 AS bad FROM s)
        SELECT doc_id, array_to_string(list_filter([CASE WHEN a > 0 THEN '"the" detected ' || a || 'x' END, CASE WHEN b > 0 THEN '"und" detected ' || b || 'x (pos hint: conj)' END, CASE WHEN c > 0 AND bad THEN '"of" detected ' || c || 'x' END], lambda d: d IS NOT NULL), '; ') AS details FROM w""",
    "x12_structures": """SELECT doc_id, array_to_string(list_filter([
            CASE WHEN regexp_matches(text, '(?i)[a-z]+!!') THEN 'pattern_id="shout" matched: "' || substr(regexp_extract(text, '(?i)[a-z]+!!'), 1, 60) || '"' END,
            CASE WHEN regexp_matches(text, '[$%&]{3}') THEN 'pattern_id="symbols" matched: "' || regexp_extract(text, '[$%&]{3}') || '"' END], lambda d: d IS NOT NULL), '; ') AS details FROM documents""",
    "x13_dash_policy": """WITH t AS (SELECT doc_id, 'a' || CASE WHEN doc_id % 2 = 0 THEN ' - ' ELSE '-' END || 'b' || CASE WHEN doc_id % 3 = 0 THEN '—' ELSE ',' END || CASE WHEN doc_id % 5 = 0 THEN '–' ELSE '.' END || text AS t FROM documents)
        SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(t, '—') THEN 'em-dash (—) detected' END, CASE WHEN contains(t, '–') THEN 'en-dash (–) detected' END,
            CASE WHEN contains(t, ' - ') THEN 'mid-sentence '' - '' detected (use period or comma)' END], lambda d: d IS NOT NULL), '; ') AS details FROM t""",
    "x14_long_sentences": f"WITH s AS (SELECT doc_id, {LONG} AS l {HEAD}) SELECT doc_id, unnest(l) AS detail FROM s",
    "x15_reading_level": f"WITH w AS (SELECT len({WORDS}) AS words, len({SENTENCES}) AS s, CAST(coalesce(list_sum(list_transform({WORDS}, lambda w: {_syllables('w')})), 0) AS BIGINT) AS y {HEAD}) SELECT count(*) FILTER (words > 0 AND 0.39 * (CAST(words AS DOUBLE) / s) + 11.8 * (CAST(y AS DOUBLE) / words) - 15.59 > 12) AS above FROM w",
    "x16_scenarios": f"SELECT doc_id, CAST({LOUD} AS BIGINT) AS hard, CAST({SOFT} AS BIGINT) AS soft {HEAD}",
    "x17_validate": f"""WITH c AS (SELECT doc_id, CAST(regexp_matches(text, '(?i)\\bthe\\b') AS INT) + 2 * {LOUD} + CAST(contains(text, '—') AS INT) + CAST(contains(text, '–') AS INT) + CAST(contains(text, ' - ') AS INT) + len({LONG}) AS hard,
        CAST(NOT {SPECIFIC} AS INT) + {SOFT} AS soft {HEAD}) SELECT doc_id, CAST(hard AS BIGINT) AS hard, CAST(soft AS BIGINT) AS soft, hard = 0 AS passed FROM c""",
    "x18_feedback": f"""WITH d AS (SELECT doc_id, text, regexp_matches(text, '(?i)[a-z]+!!') AS bad, list_filter([CASE WHEN regexp_matches(text, '(?i)[a-z]+!!') THEN '- [banned_structures] pattern_id="shout" matched: "' || substr(regexp_extract(text, '(?i)[a-z]+!!'), 1, 60) || '"' END, CASE WHEN contains(text, '—') THEN '- [dash_policy] em-dash (—) detected' END, CASE WHEN contains(text, '–') THEN '- [dash_policy] en-dash (–) detected' END, CASE WHEN contains(text, ' - ') THEN '- [dash_policy] mid-sentence '' - '' detected (use period or comma)' END], lambda x: x IS NOT NULL) AS h, NOT {SPECIFIC} AS soft FROM documents)
        SELECT doc_id, CASE WHEN len(h) = 0 THEN '' ELSE array_to_string(list_concat(['Draft voice-check FAILED on attempt ' || (doc_id % 2 + 1) || '. Issues:', '', 'Hard failures (must fix):'], h,
            CASE WHEN soft THEN ['', 'Soft warnings (review):', '- [required_per_post] no specificity marker found (dollar / %, named industry, or named neighborhood)'] ELSE [] END,
            ['', 'Regenerate the draft to address all hard failures. Preserve voice, specificity, and the', 'scenario pattern. Do NOT introduce banned words/structures to fix one issue.']), chr(10)) END AS feedback FROM d""",
    "x19_openers": r"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Certainly! ' WHEN 1 THEN 'Great question, absolutely. ' ELSE 'I ' END || 'say ' || doc_id || ' ' || text AS t FROM documents),
        u AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)^certainly[!.,]?\s*', ''), '(?i)^great question[!.,]?\s*', ''), '(?i)^absolutely[!.,]?\s*', ''), '(?i)^of course[!.,]?\s*', '') AS t FROM t)
        SELECT doc_id, regexp_replace(CASE WHEN regexp_matches(t, '^I\b') THEN regexp_replace(t, '^I\s+', 'Look — ') ELSE t END, '^\s+|\s+$', '', 'g') AS said FROM u""",
    "x21_budget": """WITH t AS (SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, substr(text, 1, 30) AS s FROM documents)
        SELECT doc_id, tokens, CASE WHEN tokens > 3000 THEN substr(s, 1, length(s) // 2) ELSE s END AS scenario, CASE WHEN tokens > 3000 THEN 'truncated' WHEN tokens > 2500 THEN 'warned' ELSE 'ok' END AS status FROM t""",
    "x23_observations": "SELECT event_id, 'again:' || user_id AS kind, value, TRUE AS flag, CAST(0 AS DOUBLE) AS empty, CAST(4 AS BIGINT) AS n FROM events",
    "x26_currency": """SELECT c_custkey, '$' || format('{:,}', CAST(floor(c_acctbal + 0.5) AS BIGINT)) AS money, CASE WHEN c_custkey % 5 = c_custkey % 3 THEN '±0' WHEN c_custkey % 5 > c_custkey % 3 THEN '+' || (c_custkey % 5 - c_custkey % 3) ELSE CAST(c_custkey % 5 - c_custkey % 3 AS VARCHAR) END AS change FROM customer""",
    "x29_headline": r"""WITH h AS (SELECT doc_id, text, regexp_extract(text, '^[^.!?]+[.!?]') AS s, regexp_extract(text, '^[^.!?\n]+[.!?]') AS o FROM documents),
        k AS (SELECT *, CASE WHEN s = '' THEN substr(text, 1, 90) ELSE trim(s) END AS c FROM h)
        , h2 AS (SELECT *, CASE WHEN length(c) > 90 THEN substr(c, 1, 87) || '…' ELSE c END AS headline FROM k),
        z AS (SELECT *, CASE WHEN length(headline) <= 38 THEN 84 WHEN length(headline) <= 64 THEN 68 ELSE 56 END AS base FROM h2)
        SELECT doc_id, headline, CASE WHEN o = '' THEN substr(text, 1, 80) ELSE trim(o) END AS line, CAST(CASE WHEN doc_id % 2 = 0 THEN floor(base * 0.78 + 0.5) ELSE base END AS BIGINT) AS size FROM z""",
    "x32_uptime": """WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s, o_totalprice AS p FROM orders)
        SELECT o_orderkey, (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' AS uptime, CAST(floor(p * 1000 / 1048576 + 0.5) AS BIGINT) || 'MB RSS / ' || CAST(floor(p * 500 / 1048576 + 0.5) AS BIGINT) || 'MB heap' AS memory FROM s""",
    "x33_slug": "SELECT doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'untitled') AS slug, '2026-01-02-untitled.md' AS note FROM documents",
    "x35_cron": """SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN '0 7 * * * local' ELSE (c_custkey % 60) || ' 7 * * *' END AS expr, CASE WHEN c_custkey % 3 = 0 THEN 'America/Los_Angeles' ELSE 'UTC' END AS zone FROM customer""",
    "x36_ids": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'urn:li:person:Ab' || c_custkey WHEN 1 THEN 'urn:li:person:s' || c_custkey END AS person, CASE WHEN c_custkey % 4 = 2 THEN 'urn:li:share:' || c_custkey END AS share,
        CASE c_custkey % 4 WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 3 THEN CAST(c_custkey + 100000 AS VARCHAR) END AS graph FROM customer""",
    "x37_not_ready": "SELECT c_custkey % 3 < 2 AS wait, count(*) AS n FROM customer GROUP BY 1",
    "x38_ids": "SELECT c_custkey, 'wk-' || substr(md5(c_name), 1, 4) AS id, 'https://x.example/images/' || md5(c_name) || '.jpg' AS url, md5(c_name) AS token, CAST(NULL AS VARCHAR) AS none FROM customer",
    "x40_numbered": f"WITH {B.SQL_LEADS}, n AS (SELECT *, seq // 60 AS page, row_number() OVER (PARTITION BY city, seq // 60 ORDER BY seq) AS i FROM l) SELECT city, page, string_agg(i || '. (' || city || ') ' || name, chr(10) ORDER BY i) AS lines FROM n GROUP BY city, page",
    "x43_tags": "SELECT p_partkey, 'site,lead' || CASE WHEN p_partkey % 2 = 0 THEN ',' || lower(p_type) ELSE '' END AS tags FROM part",
    "x45_after_marker": """WITH t AS (SELECT doc_id, text, text AS s FROM documents), k AS (SELECT *, instr(s, 'the') AS i FROM t),
        m AS (SELECT *, CASE WHEN i > 0 THEN substr(s, i + 3) END AS r FROM k)
        SELECT doc_id, CASE WHEN i > 0 THEN CASE WHEN instr(r, 'the') > 0 THEN substr(r, 1, instr(r, 'the') - 1) ELSE r END ELSE right(s, 100) END AS tail,
            CASE WHEN contains(text, '!!') THEN 'loud' WHEN contains(text, '$$$') THEN 'symbols' WHEN contains(text, ' und ') THEN 'german' ELSE 'plain' END AS kind FROM m""",
    "x47_lookup": "SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'other' END AS language, count(*) || ' document' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS said FROM documents GROUP BY 1",
    "x48_badges": """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '🟢' WHEN 1 THEN '🔴' ELSE '⚪️' END || ' ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ' (' || c_custkey || 'ms)' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN ' — slow' ELSE '' END AS badge FROM customer""",
    "x41_pipeline_report": f"""WITH {B.SQL_OPPORTUNITIES}, s AS (SELECT coalesce(stage, 'Unknown') AS stage, count(*) AS n, round(sum(value), 2) AS v FROM o LEFT JOIN st USING (stage_id) WHERE status = 'open' GROUP BY 1)
        SELECT '**Pipeline**' || chr(10) || string_agg('- ' || stage || ': ' || n || ' ($' || format('{{:,}}', CAST(floor(v + 0.5) AS BIGINT)) || ')', chr(10) ORDER BY stage) AS report FROM s""",
    "x49_checklist": f"""WITH {B.SQL_REVIEWS}, c AS (SELECT brand, count(*) FILTER (fate = 'pending') AS p, count(*) FILTER (fate = 'killed') AS k FROM r GROUP BY brand)
        SELECT brand, CASE WHEN p = 0 AND k <= 5 THEN 'nothing' ELSE array_to_string(list_filter([CASE WHEN p > 0 THEN '[ ] review ' || p END, CASE WHEN k > 5 THEN '[ ] redo ' || k END], lambda x: x IS NOT NULL), '; ') END AS awaiting FROM c""",
}
QUERIES = {k: globals()[k] for k in (*ORACLES, "x28_chunks")}
