"""Rules as rows, against plain regular expressions."""

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from opsloom.functions import text as X
from opsloom.operators import rulebook


@pytest.mark.parametrize(
    "pattern,need",
    [
        ("abc", ("abc",)),
        ("(?i)Ab+c", ("ab",)),
        ("ab?cde", ("cde",)),
        ("ab{0,3}c", ("a",)),
        ("ab{2}c", ("ab",)),
        ("cat|horse", ("cat", "horse")),
        ("cat|", None),
        ("(?:cat|horse)s?", ("cat", "horse")),
        ("(cat)?dog", ("dog",)),
        (r"\d+", None),
        (r"\$\s?\d", ("$",)),
        (r"\Qa.b\E+c", ("a.b",)),
        ("[a-z[0-9]]x[\\]]yz", ("yz",)),
        ("(?=longer)ab", ("ab",)),
        ("(?<!longer)ab", ("ab",)),
        ("(?<name>abc)d", ("abc",)),
        ("(?i:abc)d", ("abc",)),
        ("(?x) a b", None),
        ("(?iu)straße", None),
        (r"\x41bc", None),
        ("a{,2}", None),
        ("(ab", None),
        ("[]a]b", None),
        ("", None),
        (X.whole_word("C++"), ("c++",)),
    ],
)
def test_literals(pattern, need):
    assert rulebook.literals(pattern) == need


ATOMS = st.sampled_from(["a", "B", "c", "ab", r"\.", r"\d", "[ab]", ".", "(?:ab|c)", "(a)", "(?=a)", "(b|)", "^", r"\b"])
PIECES = st.tuples(ATOMS, st.sampled_from(["", "", "", "?", "*", "+", "{2}", "{0,1}", "??", "+?"]))


@given(st.lists(PIECES, min_size=1, max_size=5), st.booleans(), st.text("abABc.1 ", max_size=12))
def test_no_match_lacks_its_literals(pieces, any_case, text):
    pattern = ("(?i)" if any_case else "") + "".join(a + (q if a not in ("^", r"\b", "(?=a)") else "") for a, q in pieces)
    need = rulebook.literals(pattern)
    if need is not None and re.search(pattern, text):
        assert any(x in rulebook.lowered(text) for x in need)


@pytest.mark.parametrize("chars", [rulebook.BLOCK_CHARS, 40_000], ids=["one block", "several blocks"])
def test_ten_thousand_rules(spark, monkeypatch, chars):
    monkeypatch.setattr(rulebook, "BLOCK_CHARS", chars)
    rng = random.Random(1)
    words = ["".join(rng.choices("abcde", k=rng.randint(3, 6))) for _ in range(4000)]
    rules = [(k, rng.choice([rf"(?i)(?<![a-z]){w}(?![a-z])", rf"{w}\s+[a-z]+ed", f"{w}|{w[::-1]}x", rf"{w}+$"])) for k, w in enumerate(rng.choices(words, k=10_000))]
    rules += [(10_000, r"\d{3}"), (10_001, "(broken"), (10_002, None), rules[0]]
    texts = [(k, " ".join(rng.choices([*words, "42", "1234", "Rated"], k=30)).replace("a", rng.choice("aA"), 3)) for k in range(40)] + [(40, None), (41, "")]
    table = spark.createDataFrame(rules, "rule_id long, pattern string")
    found = rulebook.rule_hits(spark.createDataFrame(texts, "doc long, body string"), "doc", "body", table)
    compiled = [(k, re.compile(p)) for k, p in dict(rules).items() if p and p != "(broken"]
    wanted = {(d, k, n) for d, t in texts if t is not None for k, p in compiled if (n := len(p.findall(t)))}
    assert set(map(tuple, found.collect())) == wanted and any(k == 10_000 for _, k, _ in wanted)
    small = rulebook.rule_hits(spark.createDataFrame(texts, "doc long, body string"), "doc", "body", table.filter("rule_id < 5"))
    if chars > 40_000:
        lines = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
        assert lines(found) == lines(small)


def test_no_rules(spark):
    texts = spark.createDataFrame([(1, "a")], "doc long, body string")
    none = spark.createDataFrame([], "rule_id long, pattern string")
    assert rulebook.rule_hits(texts, "doc", "body", none).collect() == []
    assert [tuple(r) for r in rulebook.blocked(texts, "doc", "body", none).collect()] == [(1, None)]
    assert rulebook.counts(texts, "doc", "body", none).collect() == []
