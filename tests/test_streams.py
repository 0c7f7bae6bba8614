"""Streams over files that come one after the other."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsloom.streaming import reviews

DAY = dt.datetime(2026, 3, 1)


def write(folder, name, rows):
    """rows: (event_id, day, draft, event_type)"""
    frame = pd.DataFrame([(i, DAY + dt.timedelta(days=d), draft, kind, 0.0, "{}") for i, d, draft, kind in rows], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    frame["ts"] = frame["ts"].astype("datetime64[us]")
    frame.to_parquet(folder / name)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def test_decisions_over_three_files_and_a_restart(spark, folder):
    write(folder / "in", "a.parquet", [(1, 3, 7, "click"), (2, 2, 7, "error"), (3, 3, 8, "view")])
    run = lambda: {r["draft"]: (r["verb"], r["event_id"]) for r in reviews.drained(reviews.first_decisions(reviews.event_stream(spark, str(folder / "in"))), str(folder), "d").collect()}
    # within a batch the earliest decides
    assert run() == {7: ("kill", 2)}
    # an earlier one that comes later changes nothing; other drafts are decided as they come
    write(folder / "in", "b.parquet", [(4, 0, 7, "click"), (5, 5, 8, "click"), (6, 4, 9, "signup")])
    assert run() == {7: ("kill", 2), 8: ("approve", 5)}
    write(folder / "in", "c.parquet", [(7, 1, 8, "error"), (8, 9, 9, "error")])
    assert run() == {7: ("kill", 2), 8: ("approve", 5), 9: ("kill", 8)}
    # nothing new, nothing twice
    assert run() == {7: ("kill", 2), 8: ("approve", 5), 9: ("kill", 8)}


def test_days_close_once(spark, folder):
    write(folder / "in", "a.parquet", [(1, 0, 1, "click"), (2, 1, 1, "click"), (3, 3, 1, "click")])
    stream = lambda: reviews.daily_counts(reviews.event_stream(spark, str(folder / "in")))
    run = lambda: {(r["day"].day, r["verb"]): r["n"] for r in reviews.drained(stream(), str(folder), "c").collect()}
    closed = {(1, "approve"): 1, (2, "approve"): 1}
    assert run() == closed
    # day 1 has closed: its late event is dropped, while days that are open still count
    write(folder / "in", "b.parquet", [(4, 0, 1, "click"), (5, 3, 1, "click"), (6, 8, 1, "click")])
    assert run() == closed | {(4, "approve"): 2}


HOUR = 3_600_000


def items_in(spark, folder):
    raw = spark.readStream.schema("item long, ts timestamp_ntz, what string").parquet(str(folder))
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def put(folder, name, rows):
    """rows: (item, hours after DAY, what)"""
    frame = pd.DataFrame([(i, DAY + dt.timedelta(hours=h), what) for i, h, what in rows], columns=["item", "ts", "what"])
    frame["ts"] = frame["ts"].astype("datetime64[us]")
    frame.to_parquet(folder / name)


def due(rows, mark, hold, ahead):
    """What plain Python says is due by the watermark, in hours."""
    said = []
    for item in {i for i, *_ in rows}:
        opened = min((h for i, h, w in rows if i == item and w == "open"), default=None)
        resolved = min((h for i, h, w in rows if i == item and w == "resolve"), default=10**9)
        for what, at in (("reminder", hold - ahead), ("lapse", hold)):
            if opened is not None and mark > opened + at and resolved > opened + at:
                said.append((item, what, DAY + dt.timedelta(hours=opened + at)))
    return sorted(said)


@pytest.mark.parametrize("seed", [1, 2])
def test_reminders_and_lapses_over_files_out_of_order(spark, folder, seed):
    """Three files, a restart after each: what is due comes out once, whatever file its events were in."""
    rng = random.Random(seed)
    rows = []
    for item in range(30):
        opened = rng.randrange(100)
        rows.append((item, opened, "open"))
        if rng.random() < 0.3:
            rows.append((item, opened + rng.randrange(10), "open"))
        if rng.random() < 0.6:
            rows.append((item, opened + rng.randrange(90), "resolve"))
        rows.append((item, rng.randrange(200), "seen"))
    rows.append((99, 60, "resolve"))
    # within the delay of 48 hours files may mix
    late = lambda r: r[1] + rng.randrange(48)
    rows.sort(key=late)
    held, seen = [], []
    for k, part in enumerate((rows[:30], rows[30:60], [*rows[60:], (100, 400, "seen")])):
        put(folder / "in", f"{k}.parquet", part)
        seen += part
        stream = reviews.deadlines(items_in(spark, folder / "in"), "72 hours", "24 hours", "48 hours")
        found = sorted(map(tuple, reviews.drained(stream, str(folder), "d", held).collect()))
        assert found == due(seen, max(h for _, h, _ in seen) - 48, 72, 24)
    # all are done with; no state is left but what watches the newest
    assert {w for _, w, _ in found} == {"reminder", "lapse"} and held[-1] <= 1


def test_timers_of_many_items_share_their_state(spark, folder):
    """3,000 items, some without a name: each is told of once, and state is by group, not by item."""
    names = [None if k == 0 else f"item {k}" for k in range(3000)]
    raw = lambda: spark.readStream.schema("item string, ts timestamp_ntz, what string").parquet(str(folder / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    held = []
    run = lambda: reviews.drained(reviews.deadlines(raw(), "10 hours", "4 hours", "1 hour"), str(folder), "m", held).collect()
    put(folder / "in", "a.parquet", [(n, k % 5, "open") for k, n in enumerate(names)] + [(names[7], 3, "resolve")])
    assert run() == [] and 0 < max(held) <= reviews.GROUPS
    put(folder / "in", "b.parquet", [(names[8], 12, "resolve"), ("late", 40, "seen")])
    found = [(r["item"], r["what"]) for r in run()]
    assert sorted(map(str, found)) == sorted(str((n, what)) for k, n in enumerate(names) for what in ("reminder", "lapse") if k != 7 and (k, what) != (8, "lapse"))
    assert held[-1] == 0


def test_rows_of_a_group_in_many_batches_are_worked_on_in_proportion(monkeypatch):
    """600,000 rows of 200,000 items in 300 batches: rows wait until they are as many as the items that are known."""
    batches = [pd.DataFrame({"item": [str((k * 2000 + i) % 200_000) for i in range(2000)], "opened": k, "resolved": reviews.NEVER}) for k in range(300)]
    looked, own = [], reviews._first_times
    monkeypatch.setattr(reviews, "_first_times", lambda rows: looked.append(len(rows)) or own(rows))

    class State:
        exists = hasTimedOut = False
        getCurrentWatermarkMs = lambda self: 250
        update = setTimeoutTimestamp = lambda self, what: None

    told = pd.concat(reviews._timers(200, None)((0,), iter(batches), State()))
    # an item is first opened by one of the first 100 batches; those of the first 50 are due
    assert sorted(zip(told["item"].astype(int), told["ms"], strict=True)) == [(i, i // 2000 + 200) for i in range(100_000)]
    assert sum(looked) < 4 * 600_000


def test_events_in_a_folder_of_files_are_all_read(spark, sf, tmp_path):
    """A table of many files gives what the same table in one file gives."""
    from opsloom.plans import workflow_queries as queries

    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for query in (queries.t05_reminder_timer, queries.t03_lapse_timer, queries.t_stream_daily_counts):
        found, wanted = (sorted(map(tuple, query(spark, str(d)).collect())) for d in (tmp_path, sf))
        assert found == wanted and found


def test_reactions_meet_their_posts_as_they_come(spark, folder):
    """Posts and reactions in three files out of order; those without a post come out when the bound has passed."""
    (folder / "posts").mkdir()
    rng = random.Random(5)
    posts = [(rng.randrange(6), rng.randrange(300)) for _ in range(40)]
    reactions = [(rng.randrange(8), rng.randrange(300)) for _ in range(80)]

    def stream():
        p, r = (items_in(spark, folder / name) for name in ("posts", "in"))
        return reviews.reactions_to_posts(
            p.select(F.col("item").alias("subject"), F.col("ts").alias("posted")), r.select(F.col("item").alias("subject"), F.col("ts").alias("reacted")), "10 HOURS", "24 hours"
        )

    def wanted(until):
        p, r = ([x for x in rows if x[1] < until] for rows in (posts, reactions))
        mark = min(max(h for _, h in rows) for rows in (p, r)) - 24
        said = []
        for s, h in r:
            near = [at for i, at in p if i == s and at <= h <= at + 10]
            said += [(s, h, at) for at in near] or ([(s, h, None)] if h < mark else [])
        return sorted(said, key=str)

    held = []
    hours = lambda t: None if t is None else int((t - DAY).total_seconds() // 3600)
    for k in range(3):
        for name, rows in (("posts", posts), ("in", reactions)):
            put(folder / name, f"{k}.parquet", [(s, h, "x") for s, h in rows if k * 100 <= h < k * 100 + 100][::-1])
        found = reviews.drained(stream(), str(folder), "r", held).collect()
        assert sorted(((r["subject"], hours(r["reacted"]), hours(r["posted"])) for r in found), key=str) == wanted(k * 100 + 100)
    # of 120 rows those of the last day and the bound are held
    assert held[-1] < 40
