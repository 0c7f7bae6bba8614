"""Copies of a text take part in the similarity join once."""

import random

import pytest

from opsloom.llm import common, components, jaccard, lines
from tests.llm import brute


def test_copies_have_one_head(spark, monkeypatch):
    kept, stored = {}, jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, tag: kept.setdefault(tag, stored(df, tag)) if tag == "heads" else stored(df, tag))
    passage = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join(passage)) for i in range(50, 250)] + [(i, " ".join(passage).upper()) for i in range(20, 50)]
    rows += [(i, " ".join([*passage[:-1], f"end{i % 3}"])) for i in range(300, 330)] + [(400, "one two three four five six")]
    table = spark.createDataFrame(rows + [rows[30]] * 20, "doc_id long, text string").repartition(5)
    found = jaccard.jaccard_components(table)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == brute.components(rows, 5, 80)
    assert found.count() == len(rows) + 20
    assert sorted(r["doc_id"] for r in kept["heads"].select("doc_id").collect()) == [20, 300, 301, 302, 400]


def test_a_row_that_repeats_has_one_head(spark, monkeypatch):
    kept, stored = {}, jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, tag: kept.setdefault(tag, stored(df, tag)) if tag == "heads" else stored(df, tag))
    text = " ".join(f"w{k}" for k in range(80))
    other = [(i, " ".join(f"o{i}x{k}" for k in range(30))) for i in range(2, 40)]
    # an id with a common text and one of its own: the common text is held by id 1 alone
    table = spark.createDataFrame([(1, text)] * 100 + [(i, text) for i, _ in other] + other, "doc_id long, text string").repartition(5)
    assert jaccard.jaccard_components(table).count() == table.count()
    assert sorted(r["doc_id"] for r in kept["heads"].select("doc_id").collect()) == list(range(1, 40))


@pytest.mark.parametrize("few,keys", [(0, 20_000), (3, 4), (10**6, 20_000)])
def test_heavy_keys_change_nothing(spark, monkeypatch, few, keys):
    """Components of hubs and crowds, and lines that all documents have: all heavy, some heavy, none."""
    for module in (common, lines):
        monkeypatch.setattr(module, "FEW_ROWS", few)
        monkeypatch.setattr(module, "HEAVY_KEYS", keys)
    rng = random.Random(6)
    links = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + rng.randrange(40)) for _ in range(50)] + [(59, 130)]
    found = {r["id"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    ends = {x for p in links for x in p if p[0] != p[1]}
    assert found == {x: 0 if x < 200 else 200 for x in ends}
    common_line, rare = "a line that every document has", "a line that a few sites have"
    rows = [(i, f"{common_line}\nown line of number {i} here\n{rare if i < 7 else ''}", f"s{i % 9}") for i in range(40)]
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, text, _ in rows:
        assert kept[i] == (text if i == 0 else "\n".join(x for x in text.split("\n") if x not in (common_line, rare)))
