"""Long and hostile texts and pages: equal results, in time that grows with their length."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opsloom.llm import bytewords, jaccard, language, quality, secrets
from tests.llm import brute

HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
MARKUP = st.lists(st.sampled_from(["<", ">", "<!--", "-->", "<script", "<SCRIPT x>", "</script>", "</script >", "</style", "<style>", "a", " ", "</p>", "html", "-", "lang='de'"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(MARKUP)
def test_visible_is_what_the_patterns_leave(page):
    assert language.visible(page) == HIDDEN.sub(" ", page)


@pytest.mark.parametrize("part", ["<script x", "<meta a ", "<html lang ", "<!-- ", "<style>", "</script ", "<", "<meta content-language "])
def test_hostile_pages_take_little_time(part):
    page = part * ((1 << 20) // len(part))
    began = time.process_time()
    language.visible(page)
    language.declared(page)
    assert time.process_time() - began < 5


def test_declared():
    cases = {
        '<html lang="FR">': "fr",
        "<p><html x lang = de-AT>": "de",
        '<meta http-equiv="Content-Language" content="es">': "es",
        '<html><meta name=x content="en"><meta http-equiv=content-language content=it>': "it",
        "<html": "",
        "<meta content='de'>": "",
        "": "",
    }
    assert {p: language.declared(p) for p in cases} == cases


@pytest.mark.parametrize("line", ["password = hunter2x\n", "client_id = bob7 Zx8kQ92mmPq0TTyu1 ", "https://h.example/x Zx8kQ92mmPq0TTyu1 ", "AKIA" + "A1" * 8 + " " + "0a" * 12 + " "])
def test_texts_full_of_findings_take_little_time(line):
    text = line * ((1 << 20) // len(line))
    began = time.process_time()
    assert len(secrets.scan(text)) > 1000
    assert time.process_time() - began < 8


def all_pairs(text, reach=None):
    """Linking by looking at every pair within every paragraph."""
    reach = len(text) if reach is None else reach
    base = secrets.base_spans(text)
    identity = [m.span() for m in secrets._IDENTITY.finditer(text)]
    partners = {*identity, *(m.span() for m in secrets._ENDPOINT.finditer(text)), *((s, e) for s, e, k in base if k == "access")}
    mixed = [m.span() for m in secrets._WEAK.finditer(text) if m[0].lower() != m[0] and m[0].upper() != m[0]]
    weak = [(s, e) for s, e in mixed if all(e <= a or b <= s for a, b, _ in base)]
    strong = {*weak, *((s, e) for s, e, k in base if k != "access")}
    cuts = [0, *(m.end() for m in re.finditer(r"\n\s*\n", text)), len(text) + 1]
    scope = lambda at: max(c for c in cuts if c <= at)
    meets = lambda a, others: any((b[1] <= a[0] or a[1] <= b[0]) and scope(a[0]) == scope(b[0]) and b[0] <= a[1] + reach and b[1] >= a[0] - reach for b in others)
    found = base + [(*w, "linked") for w in weak if meets(w, partners)] + [(*i, "identity") for i in identity if meets(i, strong)]
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2]), s[1]))


PARTS = ["client_id = bob7", "user_name: ann.lee", "Zx8kQ92mmPq0TTyu1", "https://api.example.com/v1", "me@mail.example.org", "AKIA" + "Q7" * 8, "password: hunter2", "0a" * 12, "\n\n", "\n \n", " " * 90, " " * 199, " ", "word ", "https://x.example/Zx8kQ92mmPq0TTyu1"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map(" ".join), st.sampled_from([None, None, 0, 7, 200]))
def test_links_are_those_of_all_pairs(text, reach):
    assert secrets.scan(text, reach) == all_pairs(text, reach)


def test_links_in_documents(spark, sf):
    for _, text in brute.documents(spark, sf):
        assert secrets.scan(text) == all_pairs(text)


def test_pieces_have_the_words_of_the_text():
    rng = random.Random(1)
    text = "".join(rng.choice(["ab", "c", " ", "\n", "é", "\t", "日本"]) for _ in range(5000))
    for most in (1, 7, 100, 10_000):
        parts = list(bytewords.pieces(text, most))
        assert [w for p in parts for w in p.encode().split()] == text.encode().split()
    assert list(bytewords.pieces("x" * 100, 10)) == ["x" * 100] and list(bytewords.pieces("", 10)) == [""]


def test_long_texts_give_what_short_steps_give(monkeypatch):
    texts = [" ".join(f"w{i % 37}x{i % 11}" for i in range(3000)), "", None, "one two", "a b c d e f g"]
    vectors = np.random.default_rng(0).normal(size=(quality.BUCKETS + quality.SHAPES, quality.SIZE)).astype(np.float32)
    whole, sets = quality.pooled(texts, vectors), jaccard.shingle_sets(texts, 5)
    monkeypatch.setattr(quality, "_STEP", 500)
    monkeypatch.setattr(jaccard, "_STEP", 500)
    assert np.allclose(quality.pooled(texts, vectors)[:, : quality.SIZE], whole[:, : quality.SIZE], atol=1e-5)
    assert all(np.array_equal(a, b) for a, b in zip(sets, jaccard.shingle_sets(texts, 5), strict=True))
    assert [len(s) for s in sets] == [len(brute.shingles(t, 5)) for t in texts]
