"""Rules as rows: texts against a table of patterns of any length.

Most patterns can't match without some literal. An automaton over these literals reads each text once, however many
rules there are, and names the few rules that are worth trying; only these meet the text, by a join with the
rules, and there the pattern itself decides. Rules are cut into blocks of about BLOCK_CHARS characters, by hash; one
block at a time is sent to all tasks, so what is sent is bounded, and texts are read once a block. The plan has the
same size whatever the number of rules.

Patterns are Java's. A pattern in which no literal can be found (only classes, or syntax that isn't looked into) is tried
on every text. Patterns that don't compile and null ones match nothing, nor does anything match in a null text; rules that repeat
count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.functions import text as X

#: Characters of patterns that one block holds, about.
BLOCK_CHARS = 4_000_000

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Escapes that stand for a class, a place or a control character; others of a letter aren't looked into.
_CLASSES = frozenset("dDwWsSbBAzZGhHvVRntrfae123456789")


class _Unclear(Exception):
    """The pattern has syntax that isn't looked into."""


def lowered(text: str) -> str:
    """In small letters, A-Z only, as patterns in any case compare them."""
    return text.translate(_LOWER)


def literals(pattern: str) -> tuple[str, ...] | None:
    """Literals, in small letters, one of which each match must hold; None if none are found."""
    try:
        need, end = _alternatives(pattern, 0)
        return None if end < len(pattern) else need
    except (_Unclear, IndexError):
        return None


def _alternatives(p: str, i: int) -> tuple[tuple[str, ...] | None, int]:
    options = []
    while True:
        need, i = _sequence(p, i)
        options.append(need)
        if i >= len(p) or p[i] != "|":
            break
        i += 1
    if None in options:
        return None, i
    return tuple(dict.fromkeys(x for o in options for x in o)), i


def _sequence(p: str, i: int) -> tuple[tuple[str, ...] | None, int]:
    """What a sequence needs: its longest run of plain characters, or what a group of it needs, whichever is longer."""
    found: list[tuple[str, ...]] = []
    run = ""
    while i < len(p) and p[i] not in "|)":
        plain, group, i = _item(p, i)
        optional, repeated, i = _quantifier(p, i)
        if plain and group is None:
            run += plain[:-1] + ("" if optional else plain[-1])
            if not repeated:
                continue
        if run:
            found.append((lowered(run),))
        run = ""
        if group and not optional:
            found.append(group)
    if run:
        found.append((lowered(run),))
    return max(found, key=lambda need: min(map(len, need)), default=None), i


def _item(p: str, i: int) -> tuple[str, tuple[str, ...] | None, int]:
    """(plain characters, what a group needs, where the next item begins)."""
    c = p[i]
    if c == "\\":
        d = p[i + 1]
        if d == "Q":
            end = p.find("\\E", i + 2)
            end = len(p) if end < 0 else end
            return p[i + 2 : end], None, end + 2
        if d.isalnum():
            if d not in _CLASSES:
                raise _Unclear
            return "", None, i + 2
        return d, None, i + 2
    if c == "[":
        return "", None, _after_class(p, i)
    if c == "(":
        return "", *_group(p, i)
    if c in "^$.":
        return "", None, i + 1
    if c in "*+?{":
        raise _Unclear
    return c, None, i + 1


def _after_class(p: str, i: int) -> int:
    depth = 0
    while True:
        if p[i] == "\\":
            if p[i + 1] == "Q":
                raise _Unclear
            i += 1
        elif p[i] == "[":
            if p[i + 1 : i + 2] == "]" or p[i + 1 : i + 3] == "^]":
                raise _Unclear
            depth += 1
        elif p[i] == "]":
            depth -= 1
        i += 1
        if not depth:
            return i


def _group(p: str, i: int) -> tuple[tuple[str, ...] | None, int]:
    opening = re.compile(r"\((?:\?(?:(?P<look><?[=!])|[:>]|<[A-Za-z][A-Za-z0-9]*>|(?P<flags>[a-zA-Z]*(?:-[a-zA-Z]+)?)(?P<end>[:)])))?").match(p, i)
    if p.startswith("(?", i) and opening.end() == i + 1:
        raise _Unclear
    if set(opening["flags"] or "") & set("xuU"):
        raise _Unclear
    if opening["end"] == ")":
        return None, opening.end()
    need, end = _alternatives(p, opening.end())
    if p[end] != ")":
        raise _Unclear
    return None if opening["look"] else need, end + 1


def _quantifier(p: str, i: int) -> tuple[bool, bool, int]:
    """(may the item be left out, is there a quantifier, where the next item begins)."""
    found = re.compile(r"(?:[*+?]|\{(\d+)(?:,\d*)?\})[?+]?").match(p, i)
    if not found:
        if p[i : i + 1] == "{":
            raise _Unclear
        return False, False, i
    return p[i] in "*?" or found[1] is not None and int(found[1]) == 0, True, found.end()


def candidates(needs: list[tuple[str, ...] | None]):
    """A pandas UDF text -> array<int>: which of these rules are worth trying on it, by their places in the list."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        places: dict[str, list[int]] = {}
        for k, need in enumerate(needs):
            for literal in need or ():
                places.setdefault(literal, []).append(k)
        always = [k for k, need in enumerate(needs) if need is None]
        automaton = ahocorasick.Automaton()
        for literal in places:
            automaton.add_word(literal, literal)
        if places:
            automaton.make_automaton()

        def tried(text: str | None) -> list[int]:
            if text is None:
                return []
            held = {literal for _, literal in automaton.iter(lowered(text))} if places else set()
            return sorted({*always, *(k for literal in held for k in places[literal])})

        for texts in batches:
            yield texts.map(tried)

    return run


def blocks_of(rules: DataFrame, rule_id: str, pattern: str) -> Iterator[list[tuple]]:
    """The rules (id, pattern) that compile, in blocks of bounded size."""
    rules = rules.select(F.col(rule_id).alias("rule_id"), F.col(pattern).alias("pattern")).filter("pattern is not null").distinct()
    # an id and a place in lists take some room as well
    size = rules.agg(F.sum(F.length("pattern") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    for b in range(blocks):
        own = rules.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b).orderBy("rule_id", "pattern").collect()
        good = set(X.valid_patterns(sorted({r["pattern"] for r in own})))
        yield [(r["rule_id"], r["pattern"]) for r in own if r["pattern"] in good]


def rule_hits(texts: DataFrame, key: str, text: str, rules: DataFrame, rule_id: str = "rule_id", pattern: str = "pattern") -> DataFrame:
    """(key, rule_id, hits) of each text and rule that match: how often, without overlaps."""
    spark = texts.sparkSession
    kind = T.StructType([T.StructField("_rule", T.IntegerType()), T.StructField("rule_id", rules.schema[rule_id].dataType), T.StructField("_pattern", T.StringType())])
    found = None
    for block in blocks_of(rules, rule_id, pattern):
        if not block:
            continue
        table = spark.createDataFrame([(k, *rule) for k, rule in enumerate(block)], kind)
        tried = texts.select(F.col(key).alias(key), F.col(text).alias("_text"), F.explode(candidates([literals(p) for _, p in block])(F.col(text))).alias("_rule"))
        hits = tried.join(F.broadcast(table), "_rule").select(key, "rule_id", F.regexp_count("_text", F.col("_pattern")).cast("long").alias("hits"))
        hits = hits.filter("hits > 0")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], T.StructType([texts.schema[key], kind["rule_id"], T.StructField("hits", T.LongType())]))
    return found


def blocked(texts: DataFrame, key: str, text: str, rules: DataFrame, rule_id: str = "rule_id", pattern: str = "pattern") -> DataFrame:
    """(key, blocked_by) of every text: the first rule, by id, that matches it, or null."""
    first = rule_hits(texts, key, text, rules, rule_id, pattern).groupBy(key).agg(F.min("rule_id").alias("blocked_by"))
    return texts.select(key).join(first, key, "left")


def counts(texts: DataFrame, key: str, text: str, rules: DataFrame, rule_id: str = "rule_id", pattern: str = "pattern") -> DataFrame:
    """(rule_id, n, texts) of every rule: how often it matches, and in how many texts."""
    found = rule_hits(texts, key, text, rules, rule_id, pattern).groupBy("rule_id").agg(F.sum("hits").alias("n"), F.count("*").alias("texts"))
    every = rules.select(F.col(rule_id).alias("rule_id")).distinct().join(found, "rule_id", "left")
    return every.select("rule_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("texts", F.lit(0)).alias("texts"))


def phrase(words: Column) -> Column:
    """The pattern of words in a row, in any case, with any blanks or line ends between."""
    return F.concat(F.lit("(?i)"), F.array_join(words, "[ \\n]+"))
