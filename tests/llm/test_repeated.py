"""The similarity join where ids repeat with other texts, and where very many texts are nearly linked."""

import random

import pytest

import corpus_pipeline
from opsloom.llm import jaccard
from tests.llm.brute import row_components

WORDS = [f"w{k}" for k in range(400)]


def found(df):
    return sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str)


def test_links_of_an_id_are_those_of_all_its_texts(spark):
    a, b = " ".join(WORDS[:40]), " ".join(WORDS[100:140])
    rows = [(5, a), (5, b), (3, b), (9, a)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == [(3, 36, 3), (5, 36, 3), (5, 36, 3), (9, 36, 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_ids_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(160):
        base = WORDS[k % 8 * 40 :][:40]
        for _ in range(rng.choice((0, 1, 1, 4))):
            base = base[:]
            base[rng.randrange(len(base))] = rng.choice(WORDS)
        text = rng.choice(["", None, " ".join(base), " ".join(base), " ".join(base), "one two"])
        rows.append((rng.choice([None, *range(60), *range(60)]), text))
    rows += rows[:9]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(row_components(rows, 5, 80), key=str)


def test_stage_keeps_every_text_of_a_repeated_id(spark):
    x, y, z = ("".join(f"{c}{k} " for k in range(30)) for c in "xyz")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, x, "a", "s", 1), (1, y, "b", "t", 2), (1, y.upper(), "b", "t", 2), (1, y, "b", "t", 2), (2, y, "c", "u", 3), (3, z, None, None, None), (3, z, "d", None, None), (None, x, "e", "v", 4), (4, None, None, None, None), (4, "", None, None, None)]
    kept = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, schema), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    again = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows[::-1], schema).repartition(3), "")
    left = sorted(map(tuple, kept.collect()), key=str)
    assert left == sorted(map(tuple, again.collect()), key=str)
    assert sorted((r[0], (r[1] or "").lower()) for r in left if r[0] is not None) == [(1, x), (1, y), (3, z), (4, "")]
    assert [r for r in left if r[0] is None] == [rows[7]]


def family(n, words, changed, seed=7):
    """Texts of one template, each with some words of its own, spread so that each costs five shingles."""
    rng = random.Random(seed)
    for k in range(n):
        own = list(words)
        for at in range(7, len(own), len(own) // changed):
            own[at] = f"own{k}x{rng.random()}"
        yield k, " ".join(own)


@pytest.mark.parametrize("changed,alike", [(7, False), (6, True)])
def test_a_family_that_is_nearly_linked(spark, monkeypatch, changed, alike):
    """1,200 texts of one template: 400 words, of which 7 differ in each, so that they are alike to 0.84, or 6. Nothing but links leaves the search, and each set is moved some times, not once a pair."""
    rows, stored, sizes = list(family(1200, WORDS, changed)), jaccard.stored, {}

    def counted(df, tag):
        kept = stored(df, tag)
        sizes[tag] = kept.count()
        return kept

    monkeypatch.setattr(jaccard, "stored", counted)
    percent = 85
    shared = 396 - 5 * len(range(7, 400, 400 // changed))
    assert (100 * shared >= percent * (2 * 396 - shared)) == alike
    groups = {r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    assert len(groups) == (1 if alike else 1200)
    assert max(sizes.values()) <= 4 * 1200
