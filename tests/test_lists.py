"""Sheets by header and patches; new lists against earlier ones."""

import random

from pyspark.sql import functions as F

from opsloom.operators import allocation, priors
from opsloom.sources import sheets

FILES = {
    # named against what they hold
    "patch.csv": "﻿First Name,Last Name,Business Name,Email,Phone,Address,City,State,Postal Code,Tags,Notes\r\nAnn,Lee,\"Lee, \"\"Sons\"\"\",,(702) 555-0001,,Reno,NV,,\"a,b\",\r\n\r\n,,Two,,702-555-0002,,,,,,x\r\n",
    "import 2.csv": "Phone,Company Name\r\n702 555 0001,Lee & Sons\r\n7025550003,Three B\r\n12,Short\r\n7025550003,Three C\r\n",
    "research.txt": "score,company_name,phone,google_rating,outreach_angle,review_count\n8.0,Three,+1 702 555 0003,4.5 / 4.7,hook,999+\n6.5,\"Four\",,,,\n",
    "POOL.csv": "Notes,Website,Company Name,Phone,Postal Code,City\nn,w.example.org,Five,5550005,89101,Mesquite\n",
    "other.csv": "a,b\n1,2\n",
    "empty.csv": "",
}


def test_sheets_are_read_by_their_headers(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
    rows = sheets.read_sheets(spark, str(tmp_path))
    found = {(r["kind"], r["company_name"]): r for r in rows.collect()}
    assert sorted(k for k, _ in found) == ["import", "import", "import-12", "patch", "patch", "patch", "patch", "research", "research"]
    lee = found["import", 'Lee, "Sons"']
    assert (lee["first_name"], lee["city"], lee["tags"], lee["score"], lee["notes"]) == ("Ann", "Reno", "a,b", None, None)
    assert found["import", "Two"]["notes"] == "x" and found["import", "Two"]["city"] is None
    assert (found["research", "Three"]["score"], found["research", "Three"]["google_rating"]) == ("8.0", "4.5 / 4.7")
    assert (found["import-12", "Five"]["website"], found["import-12", "Five"]["postal_code"]) == ("w.example.org", "89101")
    leads = {(r["kind"], r["company_name"], r["phone_key"], r["patched"]) for r in sheets.patched(rows).collect()}
    assert leads == {
        ("import", "Lee & Sons", "7025550001", True),
        ("import", "Two", "7025550002", False),
        ("research", "Three C", "7025550003", True),
        ("research", "Four", None, False),
        ("import-12", "Five", None, False),
    }


def test_a_sheet_of_many_blocks(spark, tmp_path):
    """One file cut into many tasks still has one header."""
    (tmp_path / "big.csv").write_text("Phone,Company Name\n" + "".join(f"702555{k:04},Company {k}\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        rows = sheets.read_sheets(spark, str(tmp_path))
        assert rows.filter("company_name = concat('Company ', cast(substring(phone, 7) as int))").count() == 5000 == rows.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_three_lists_repeat_no_lead(spark, tmp_path):
    rng = random.Random(2)
    kind = "list long, seq long, key string, score double, watermark double"
    lists, seen, low = [], set(), 100.0
    for n in range(3):
        rows = [(n * 1000 + k, rng.choice([None, *(f"k{rng.randrange(300)}" for _ in range(9))]), float(rng.randrange(100))) for k in range(200)]
        table = spark.createDataFrame(rows, "seq long, key string, score double")
        made = [tuple(r) for r in priors.next_list(spark.createDataFrame(lists, kind), table, "key", ["seq"], "score", n).collect()]
        firsts = {}
        for seq, key, score in rows:
            firsts.setdefault(key, (seq, score))
        wanted = {(seq, key, score) for key, (seq, score) in firsts.items() if key is None or key not in seen}
        low = min(low, *(s for *_, s in wanted))
        assert {r[1:4] for r in made} == wanted and {(r[0], r[4]) for r in made} == {(n, low)}
        seen |= {key for _, key, _ in wanted}
        lists += made


def test_most_new_leads_pass_the_filter(spark):
    prior = spark.range(5000).select((F.col("id") % 3).alias("list"), F.sha1(F.col("id").cast("string")).alias("key"))
    rows = spark.range(4000, 14_000).select(F.sha1(F.col("id").cast("string")).alias("key"))
    bits = priors.bits_for(5000)
    words = priors.merged(priors.list_filters(prior, "key", bits))
    maybe = priors.maybe_known(rows, "key", words, bits).filter("_maybe").count()
    assert 1000 <= maybe < 1000 + 0.05 * 9000
    assert priors.fresh(rows, prior, "key").count() == 9000
    assert priors.bits_for(priors.MOST_BITS) is None


def test_places_of_hashed_ids_and_shared_scores(spark, monkeypatch):
    """Ids anywhere in 64 bits, and scores that many share, null ones last."""
    monkeypatch.setattr(allocation, "PER_BLOCK", 4)
    monkeypatch.setattr(allocation, "RANGES", 5)
    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), rng.choice([None, 1.0, 1.0, 2.5, -3.0, float(k)])) for k, i in enumerate(sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(120)}))]
    rows += [(-(1 << 63), "a", 1.0), ((1 << 63) - 1, "b", 1.0)]
    table = spark.createDataFrame(rows, "seq long, city string, score double")
    best = lambda r: (r[2] is None, -(r[2] or 0), r[0])
    found = {r["seq"]: r["place"] for r in allocation.places(table, F.col("score"), "seq").collect()}
    assert found == {r[0]: k for k, r in enumerate(sorted(rows, key=best), 1)}
    found = {r["seq"]: r["place"] for r in allocation.places(table, F.col("score"), "seq", "city").collect()}
    assert found == {r[0]: k for c in "ab" for k, r in enumerate(sorted((r for r in rows if r[1] == c), key=best), 1)}
