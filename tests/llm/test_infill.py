"""op12: fill-in-middle against a plain regular expression, round trips and edges."""

import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from opsloom.llm import infill
from tests.llm.brute import documents


def plainly(text, doc_id):
    """(n, form, prefix_chars, middle_chars, output) by a regular expression."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, said = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(said[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


PIECES = st.lists(st.sampled_from(["a", "Zz", "é", "ſ", "K", "[", "`", "@", "{", " ", "\n", "\r\n", "\0", "😀", "<", "<P", "P>", "<M", "S>", ">", "M>", "<S>", "́"]), max_size=12).map("".join)


@given(PIECES | st.text(), st.integers(-(1 << 63), (1 << 63) - 1) | st.none())
def test_equals_regular_expression_and_comes_back(text, doc_id):
    made = infill.cut(text, doc_id)
    assert (made.n, made.form, made.prefix_chars, made.middle_chars, made.output) == plainly(text, doc_id)
    assert infill.rebuild(made.output, made.form) == text


def test_documents(spark, sf):
    texts = dict(documents(spark, sf))
    forms = set()
    for r in infill.op12_fill_in_middle(spark, sf).collect():
        n, form, prefix, middle, output = plainly(texts[r["doc_id"]], r["doc_id"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_rows_that_are_odd(spark):
    rows = [(1, None, "x", 9), (1, None, "x", 9), (None, "a b", "y", 8), (2, "", None, None), (3, "<P> a", "z", 7), (4, "word " * 1_000_000, "w", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, extra int")
    made = infill.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = sorted(infill.restored(made).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(found) == 6
    for r in found:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plainly(r["text"], r["doc_id"])
        assert r["restored"] == (r["text"] or "")
    assert {r["extra"] for r in found} == {9, 8, None, 7, 6}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.restored(infill.fill_in_middle(docs)).collect() == []


@pytest.mark.parametrize("rate,first,forms", [(0, 20, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})])
def test_shares(rate, first, forms):
    assert {infill.cut("some text", k, rate=rate, suffix_first=first).form for k in range(50)} == forms
