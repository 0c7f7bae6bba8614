"""Operators against greedy loops and folds in plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opsloom.operators import allocation, rollups, rules, slotting, state
from opsloom.plans import registry
from opsloom.sources import markdown, records


def greedy_round_robin(rows, n, skip):
    queues = {}
    for city, seq in rows:
        queues.setdefault(city, []).append(seq)
    queues, out = [q[skip:] for q in queues.values()], []
    while len(out) < n and any(queues):
        for q in queues:
            if q and len(out) < n:
                out.append(q.pop(0))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_round_robin(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abcd"), i) for i in range(rng.randint(1, 30))]
    n, skip = rng.randint(1, 20), rng.randint(0, 3)
    found = allocation.round_robin(spark.createDataFrame(rows, "city string, seq long"), "city", "seq", n, skip)
    assert [r["seq"] for r in found.orderBy("pos").collect()] == greedy_round_robin(rows, n, skip)


def test_wrap_chunks(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "city string, seq long")
    found = allocation.wrap_chunks(rows, "city", "seq", 2, 4).orderBy("day", "slot").collect()
    assert [(r["day"], r["slot"], r["seq"]) for r in found] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 0), (1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 3, 1)]


def test_slots_skip_sundays_and_taken(spark):
    days = spark.range(15).select(F.date_add(F.lit("2026-06-15").cast("date"), F.col("id").cast("int")).alias("day"))
    now = F.lit("2026-06-15 12:00:00").cast("timestamp")
    taken = spark.createDataFrame([(dt.datetime(2026, 6, 15, 16),)], "at timestamp")
    free = [r["at"] for r in allocation.free_slots(days, ["09:00"], taken, now).orderBy("at").collect()]
    assert free[0] == dt.datetime(2026, 6, 16, 16) and len(free) == 12
    assert all((at - dt.timedelta(hours=7)).weekday() != 6 for at in free)


def test_assignment_takes_later_ideals(spark):
    at = [dt.datetime(2026, 6, 15 + i, 16) for i in range(4)]
    posts = spark.createDataFrame([("p", 0, 0, at[0]), ("p", 1, 1, at[0]), ("p", 2, 2, at[1])], "platform string, seq long, id long, ideal timestamp")
    calendar = spark.createDataFrame([("p", a) for a in at], "platform string, at timestamp")
    taken = spark.createDataFrame([], "platform string, at timestamp")
    found = {r["id"]: r["at"] for r in slotting.assign_in_order(posts, calendar, taken).collect()}
    assert found == {0: at[0], 1: at[1], 2: at[2]}


def greedy_slots(posts, calendar, taken):
    closed, out = set(taken), {}
    for platform, _, i, ideal in sorted(posts, key=lambda p: (p[0] or "", p[1], p[2])):
        free = sorted(a for p, a in calendar if p == platform and (p, a) not in closed)
        got = ideal if ideal in free else free[0] if free else None
        closed.add((platform, got))
        out[i] = got
    return out


@pytest.mark.parametrize("seed", range(8))
def test_assignment_over_ranges_of_posts(spark, seed):
    """Few slots and many, hot ideals, ties, slots taken, platforms without a calendar or a name, three posts a range."""
    rng = random.Random(seed)
    start, far = dt.datetime(2026, 6, 15, 16), rng.choice([8, 40, 70])
    platforms = ["a", "a", "a", "b", "none", None]
    at = lambda: start + dt.timedelta(hours=rng.randrange(far) if rng.random() < 0.7 else far - 1)
    posts = [(rng.choice(platforms), rng.randrange(50), i, at() if rng.random() < 0.9 else None) for i in range(80)]
    calendar = [(p, start + dt.timedelta(hours=h)) for p in ("a", "b", None, "c") for h in range(far) if rng.random() < 0.8] * 2
    taken = [(rng.choice(("a", "b")), at()) for _ in range(4)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    found = slotting.assign_in_order(frame(posts, "platform string, seq long, id long, ideal timestamp"), frame(calendar, "platform string, at timestamp"), frame(taken, "platform string, at timestamp"), 3)
    assert {r["id"]: r["at"] for r in found.collect()} == greedy_slots(posts, calendar, taken)


def test_tables_without_rows(spark):
    none = spark.createDataFrame([], "id long, value double, status string, stage_id string, created timestamp, updated timestamp")
    stages = spark.createDataFrame([("1", "New")], "stage_id string, stage string")
    assert rollups.stage_rollup(none, stages).count() == 0
    row = rollups.snapshot(none, F.lit("2026-01-01").cast("timestamp")).first()
    assert row["open_count"] == 0 and row["total_value"] == 0.0
    assert allocation.round_robin(spark.createDataFrame([], "city string, seq long"), "city", "seq", 3).count() == 0
    slots = spark.createDataFrame([], "platform string, at timestamp")
    posts = spark.createDataFrame([], "platform string, seq long, id long, ideal timestamp")
    assert slotting.assign_in_order(posts, slots, slots).count() == 0


def python_review(verbs):
    status, rewrites = "pending", 0
    for v in verbs:
        if status == "pending" and v == "approve":
            status = "approved"
        elif status == "pending" and v == "kill":
            status = "killed"
        elif status == "pending" and v == "rewrite" and rewrites < 1:
            status = "awaiting"
        elif status == "awaiting" and v == "reply":
            status, rewrites = "pending", rewrites + 1
    return status, rewrites


def python_post(outcomes):
    status, attempts = "queued", 0
    for o in outcomes:
        if status not in ("queued", "held"):
            break
        attempts += o == "error"
        status = "posted" if o == "ok" else "failed" if attempts == 3 else "held"
    return status, attempts


def python_week(events):
    phase = "drafting"
    for e in events:
        turns = {(a, b): c for a, b, c in state.WEEK_TURNS}
        if e == "cancel" and phase in state.OPEN_PHASES:
            phase = "cancelled"
        elif e == "lapse" and phase in ("text_review", "final_review"):
            phase = "lapsed"
        else:
            phase = turns.get((phase, e), phase)
    return phase


@pytest.mark.parametrize(
    "turns,start,words,fold,said",
    [
        (state.REVIEW_TURNS, "pending", ["approve", "kill", "rewrite", "reply", "reply"], python_review, lambda p: (p.split()[0].replace("reopened", "pending"), int(p.endswith("again") or p == "reopened"))),
        (state.POST_TURNS, "queued 0", ["ok", "config", "not_ready", "error", "error", "error"], python_post, lambda p: (p.split()[0], int(p.split()[1]))),
        (state.PHASE_TURNS, "drafting", ["drafted", "drafted", "resolved", "rendered", "confirmed", "cancel", "lapse"], python_week, lambda p: p),
    ],
)
def test_walks_are_folds(spark, turns, start, words, fold, said):
    rng = random.Random(1)
    histories = [[rng.choice(words) for _ in range(rng.randint(1, 9))] for _ in range(80)]
    rows = [(k, at // 2, at, what) for k, h in enumerate(histories) for at, what in enumerate(h)]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "draft long, ts long, event_id long, what string")
    found = {r["draft"]: said(r["phase"]) for r in state.walk(events, "draft", ["ts", "event_id"], "what", turns, start).collect()}
    assert found == {k: fold(h) for k, h in enumerate(histories)}


LOOP = (("a", "x", "b"), ("b", "x", "c"), ("c", "x", "a"), ("a", "y", "c"), ("c", "y", "a"), ("b", "z", "a"))


@pytest.mark.parametrize("block,fan_in", [(1, 2), (7, 3), (10_000, 256)])
def test_walks_come_back_to_phases(spark, monkeypatch, block, fan_in):
    """A machine with loops, over long histories cut into blocks; a key without an event that counts stays at the start."""
    monkeypatch.setattr(state, "FAN_IN", fan_in)
    rng, turns, rows, wanted = random.Random(3), {(p, e): n for p, e, n in LOOP}, [], {}
    for k in range(12):
        phase = "a"
        for at in range(rng.choice([1, 5, 150])):
            what = "w" if k == 0 else rng.choice("xyzw")
            phase = turns.get((phase, what), phase)
            rows.append((k, at // 3, at, what))
        wanted[k] = phase
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "draft long, ts long, event_id long, what string")
    walked = state.walk(events, "draft", ["ts", "event_id"], "what", LOOP, "a", block)
    assert {r["draft"]: r["phase"] for r in walked.collect()} == wanted


def test_a_walk_reads_its_events_once(spark, sf):
    for name in ("t02_review_fold", "t04_week_phases", "t06_posting_fold"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("FileScan parquet") == 1 and "Join" not in plan


def test_probes_are_cut_off_at_the_limit(spark):
    rows = spark.createDataFrame([(0,), (4000,), (4001,), (None,)], "ms long")
    assert [tuple(r[0]) for r in rows.select(state.probed(F.col("ms"))).collect()] == [("ok", 0), ("ok", 4000), ("down", 4000), ("down", 4000)]


@pytest.mark.parametrize("block", [3, 5000])
def test_places(spark, block, monkeypatch):
    monkeypatch.setattr(allocation, "PER_BLOCK", block)
    rng = random.Random(4)
    rows = [(i, rng.choice("aaab"), rng.choice([1.0, 2.0, 2.5, None])) for i in range(60)]
    table = spark.createDataFrame(rows, "seq long, city string, score double")
    best = lambda r: (r[2] is None, -(r[2] or 0), r[0])
    found = {r["seq"]: r["place"] for r in allocation.places(table, F.col("score"), "seq").collect()}
    assert found == {r[0]: k for k, r in enumerate(sorted(rows, key=best), 1)}
    found = {r["seq"]: r["place"] for r in allocation.places(table, F.col("score"), "seq", "city").collect()}
    assert found == {r[0]: k for c in "ab" for k, r in enumerate(sorted((r for r in rows if r[1] == c), key=best), 1)}


@pytest.mark.parametrize("gap", [1, 5, 100])
def test_prior_days_are_all_earlier_days(spark, gap):
    """Over weeks, blocks and gaps; days before 1970 too."""
    days = [dt.date(1969, 11, 3) + dt.timedelta(days=gap * k) for k in range(150)]
    rows = [(d, None if k % 7 == 3 else f"t{k}") for k, d in enumerate(days)]
    found = {r["day"]: r["before"] for r in allocation.prior_days(spark.createDataFrame(rows[::-1], "day date, line string"), "day", "line").collect()}
    assert found == {d: "|".join(t for _, t in rows[:k] if t) for k, d in enumerate(days)}


def test_first_free_slots_run_out(spark):
    posts = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "seq long, brand string")
    free = spark.createDataFrame([(dt.datetime(2026, 1, d),) for d in (2, 1)], "at timestamp")
    found = {r["seq"]: r["at"] and r["at"].day for r in allocation.first_free(posts, free, "seq", "brand").collect()}
    assert found == {0: 1, 1: 1, 2: 2, 3: 2, 4: None, 5: None}


def test_bad_patterns_match_nothing(spark):
    rows = spark.createDataFrame([("Some THEER here",), ("x",)], "t string")
    assert [r[0] for r in rows.select(rules.first_block(F.col("t"), ["([", "theer", "*"])).collect()] == ["theer", None]
    assert [r[0] for r in rows.select(rules.first_block(F.col("t"), ["(["])).collect()] == [None, None]
    assert rules.rule_matches(rows.withColumn("k", F.lit(1)), "k", "t", [("bad", "(("), ("good", "THE")]).count() == 1
    assert [len(r[0]) for r in rows.select(rules.banned_structures(F.col("t"), [("bad", "+"), ("good", "here")])).collect()] == [1, 0]


def test_form_requests(spark):
    rows = ['{"firstName":"A","email":"a@b.example","phone":"1","businessType":" Pool "}', '{"firstName":" ","email":"a@b","phone":null}', "{broken", None]
    found = records.form_requests(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, body string"), "body").orderBy("i").collect()
    assert found[0]["tags"] == ["request", "hot", "pool"] and found[0]["faults"] == []
    assert [r["faults"] for r in found[1:]] == [["missing name", "missing phone", "bad email"], ["invalid JSON"], ["invalid JSON"]]


def test_validation_order_and_feedback(spark):
    voice = rules.Voice(words=[rules.Word("leverage", exception="ratio")], structures=[("not_x", "not just .* but")], most_words=5)
    drafts = spark.createDataFrame([("We leverage it – not just a tool but a way of life today.",), ("The leverage ratio.",)], "text string")
    rows = rules.validate(drafts, voice).collect()
    assert [f["check"] for f in rows[0]["hard"]] == ["banned_words", "banned_structures", "dash_policy", "max_sentence_words"]
    assert rows[1]["passed"] and not rows[0]["passed"]


def test_markdown_edges(spark):
    docs = spark.createDataFrame([("a", "no table"), ("b", "## Leads Table\n| Company | Hook |\n| x | y |"), ("c", None), ("d", "## Leads Table")], "doc string, text string")
    assert [(r["doc"], r["row"]) for r in markdown.table_rows(docs).collect()] == [("b", {"company": "x", "hook": "y"})]
    assert markdown.ranked_leads(docs).count() == 0
    assert {r["title"] for r in markdown.sections(docs).collect()} == {"__header__", "Leads Table"}


def test_all_tables_of_a_sheet(spark):
    head = "| Company | City | Hook |\n|---|---|---|\n"
    text = f"# One\r\n## Leads Table\n\n{head}| a | p | x |\n\n## Leads Table\nnone\n# Two\n## Leads Table (more)\n{head}| b | q | y |\n| c | | z |\n## Leads Table"
    docs = spark.createDataFrame([("s", text), ("n", None), ("e", ""), ("t", "no title\n" + head + "| d | r | w |")], "doc string, text string")
    found = [(r["doc"], r["part"], r["pos"], r["row"]["company"]) for r in markdown.all_table_rows(docs).orderBy("doc", "part", "pos").collect()]
    assert found == [("s", 0, 0, "a"), ("s", 2, 0, "b"), ("s", 2, 1, "c")]
    assert [(r["part"], r["city"], r["diagnosis"]) for r in markdown.seeds(docs, every=True).orderBy("part", "pos").collect()] == [(0, "p", "x"), (2, "q", "y"), (2, "Unknown", "z")]
    assert [r["row"]["company"] for r in markdown.table_rows(docs).collect()] == ["a"]


def test_first_line_body_is_an_option(spark):
    docs = spark.createDataFrame([("a", "===LINKEDIN===\nHEADLINE: h\nBODY: one\ntwo")], "doc string, text string")
    assert [markdown.delimited_posts(docs, whole_body=w).first()["body"] for w in (True, False)] == ["one\ntwo", "one"]


def test_state_version_guard(spark):
    good = spark.createDataFrame([('{"schemaVersion":1,"records":[{"id":"a"}]}',)], "text string")
    assert records.snapshot_rows(good, "id string").count() == 1
    with pytest.raises(Exception, match="schema version"):
        records.snapshot_rows(spark.createDataFrame([('{"schemaVersion":2,"records":[{"id":"a"}]}',)], "text string"), "id string").collect()


def test_files_are_read_by_name(spark, tmp_path):
    (tmp_path / "POOL 1.md").write_text("## Leads Table\n| # | Company | City | Hook |\n|--|--|--|--|\n| 1 | C | | Sam, hi |\n")
    (tmp_path / "other.md").write_text("x")
    assert [tuple(r) for r in markdown.seeds(markdown.read_texts(spark, str(tmp_path), "POOL *.md")).select("city", "diagnosis").collect()] == [("Unknown", "hi")]


def test_sheet_kinds(spark):
    rows = ["first_name,google_rating,outreach_angle", "First Name,Business Name,Postal Code", "Company Name,Website,Postal Code", "Phone,Company Name", "x"]
    found = spark.createDataFrame([(r,) for r in rows], "t string").select(records.sheet_kind(F.col("t"))).collect()
    assert [r[0] for r in found] == ["research", "import", "import-12", "patch", "unknown"]
