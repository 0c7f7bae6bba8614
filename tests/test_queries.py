"""Every registered query of the library proper, against its SQL or, where there is none, plain Python."""

import hashlib
from pathlib import Path

import pytest

from opsloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(name, spark, sf, duck, same):
    same(registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df())


def test_checked_drafts_of_odd_texts(spark, tmp_path):
    import duckdb

    odd = [
        None,
        "",
        "in 2025, 2026 and 2027",
        "studies show, and according to the data",
        "w " * 15 + "— " + "w " * 10,
        "on - " + "w " * 19,
        "Here's the draft:\n---\nw\nNext move: w\nw",
        "onin \t the",
        "onin\tthe",
        "w " * 20 + "\u00a0",
        "w " * 19 + "w\x0bw",
        "o\u017f!!",
        "\u212a!!",
        "\u0131!!",
        "Wow!! The theer.\x01a",
    ]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = {r[0]: r for r in con.execute(registry.ORACLES["c01_checked_drafts"]).fetchall()}
    assert {r["doc_id"]: tuple(r) for r in registry.QUERIES["c01_checked_drafts"](spark, str(tmp_path)).collect()} == wanted


def pieces(text, limit, least=200):
    out = []
    while len(text) > limit:
        line = text[: limit + 1].rfind("\n")
        cut = line if line > least else limit
        out.append(text[:cut])
        text = text[cut:]
    return out + [text] if text or not out else out


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def by_id(query, spark, sf):
    return {r["doc_id"]: tuple(r)[1:] for r in query(spark, sf).collect()}


def test_queries_of_pieces(spark, sf):
    texts = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    q = registry.QUERIES
    cut = {i: pieces(t, 500) for i, (t, _) in texts.items()}
    assert by_id(q["x28_chunks"], spark, sf) == {i: (len(p), True, max(map(len, p))) for i, p in cut.items()}
    cut = {i: pieces(t, 1900) for i, (t, _) in texts.items()}
    assert by_id(q["k04_messages"], spark, sf) == {i: (len(p), len(texts[i][0])) for i, p in cut.items()}
    assert by_id(q["w14_react_target"], spark, sf) == {i: (md5(p[-1]),) for i, p in cut.items()}
    cut = {i: pieces(f"**{lang.upper()}** `{i}`\n{t}", 1900) for i, (t, lang) in texts.items()}
    assert by_id(q["c11_round_posts"], spark, sf) == {i: (i % 6, len(p), md5(p[-1])) for i, p in cut.items()}


def test_files(spark, sf):
    wanted = sorted((p.name, p.stat().st_size) for p in Path(sf).rglob("*.parquet") if p.is_file())
    assert [tuple(r) for r in registry.QUERIES["s12_files"](spark, sf).collect()] == wanted


def test_all_queries_without_sql_are_held_against_something():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"x28_chunks", "k04_messages", "w14_react_target", "c11_round_posts", "s12_files"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
