"""Column functions against plain Python and stated cases."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from opsloom.functions import dates, numbers, prompts, text
from opsloom.plans import registry


def values(spark, column, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


def test_dashes(spark):
    cases = {
        "2–3 and 20 — 30": "2-3 and 20-30",
        "– lead": "- lead",
        "stop. — next": "stop. Next",
        "one — two": "one. Two",
        "x - y": "x. Y",
        "a, — b": "a, b",
        "end—": "end, ",
        "follow-up": "follow-up",
    }
    assert values(spark, text.strip_dashes(F.col("t")), list(cases)) == list(cases.values())


@pytest.mark.parametrize("f", ["strip_dashes", "strip_scaffolding"])
def test_stripping_again_changes_nothing(spark, sf, f):
    fn = getattr(text, f)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("Sure!\n---\n"), "text", F.lit(" a — b\nNext move: x")).alias("t"))
    assert docs.filter(fn(fn(F.col("t"))) != fn(F.col("t"))).count() == 0


def test_scaffolding(spark):
    cases = {"Here's the draft:\n\n---\nBody\n\n\n\nmore\n***\nNext move: call": "Body\n\nmore", "": "", "---\n\n": "", "Next move first\nline": ""}
    assert values(spark, text.strip_scaffolding(F.col("t")), list(cases)) == list(cases.values())


def test_scrub(spark):
    cases = {"Sam, mail a@x.org or  www.x.org/now": "mail [their email] or [their site]", "plain  text": "plain text", "see https://a.b/c ok": "see [their site] ok"}
    assert values(spark, text.scrub_identity(F.col("t")), list(cases)) == list(cases.values())


def test_openers(spark):
    cases = {"Certainly! Yes": "Yes", "Of course, great question. I go": "great question. I go", "I go": "Look — go", "It is": "It is"}
    assert values(spark, text.strip_openers(F.col("t")), list(cases)) == list(cases.values())


def test_chunks_join_to_the_text(spark):
    rows = ["", "a" * 2500, ("x" * 300 + "\n") * 12, "short"]
    for whole, pieces in zip(rows, values(spark, text.chunks(1000)(F.col("t")), rows), strict=True):
        assert "".join(pieces) == whole and all(len(p) <= 1000 for p in pieces)
    assert values(spark, text.chunks(1000)(F.col("t")), rows)[2][0].endswith("x")


def test_slug(spark):
    rows = ["Hello, World!", "--", "É à", "x" * 80]
    plain = [re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", r.lower()))[:60] or "untitled" for r in rows]
    assert values(spark, text.slug(F.col("t")), rows) == plain


def test_numbers(spark):
    rows = ["", "1e3", "0x10", "Infinity", "NaN", "x", " 7 ", None]
    assert values(spark, numbers.to_number(F.col("t")), rows) == [0.0, 1000.0, 16.0, None, None, None, 7.0, None]
    assert values(spark, numbers.currency(F.col("t").try_cast("double")), ["1234.5", "NaN", "-0.5"]) == ["$1,235", "$0", "$0"]
    assert values(spark, numbers.headline_size(F.col("t"), F.lit(True)), ["a" * 38, "a" * 64, "a" * 65]) == [66, 53, 44]


def test_observation_map(spark):
    rows = spark.createDataFrame([(["k: a: b", "none", " : x", "k:c", "e:"],)], "o array<string>")
    assert rows.select(text.observation_map(F.col("o"))).first()[0] == {"k": "c", "e": ""}


def test_bad_patterns_are_left_out(spark):
    assert text.valid_patterns(["a+", "(", "[z"]) == ["a+"]


def test_syllables_of_a_text_are_those_of_its_words(spark, sf):
    rows = ["coffee the e ee a bee co-op rhythm Apple's Élan é1 naïve eye ae aee bcd-e e-bcde", "", "  ", "12 34 ...", "queue\tme\nbe  table"]
    per_word = F.aggregate(text.tokens(F.col("t")), F.lit(0).cast("long"), lambda a, w: a + text.syllables(w))
    docs = spark.createDataFrame([(r,) for r in rows], "t string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("text").alias("t")))
    assert docs.filter(text.syllable_count(F.col("t")) != per_word).count() == 0
    assert docs.filter(text.word_count(F.col("t")) != F.size(text.tokens(F.col("t")))).count() == 0


def test_words_by_syllables_in_blocks(spark, sf, monkeypatch):
    """Against syllables() of each word, for texts that are cut into blocks or share one; no pattern is tried on a word."""
    rng = random.Random(9)
    odd = ["e", "E", "a", "y", "b", "Z", "K", "İ", "ſ", "é", "😀", "'", "-", "1", " ", "\t", "\n", "\x0b", "\f", "\r", "\x1c", "\u00a0", "\u2028", "\x00"]
    rows = ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", " \n", "12 ...", "e" * 5000, "be " * 5000, "be\n" * 5000]
    made = spark.createDataFrame([(r,) for r in rows], "t string").repartition(3)
    told = lambda found: {r["syllables"]: r["n"] for r in found.collect()}
    for docs in (made, spark.read.parquet(f"{sf}/documents.parquet").select(F.col("text").alias("t"))):
        words = docs.select(F.explode(text.tokens(F.col("t"))).alias("w"))
        wanted = told(words.groupBy(text.syllables(F.col("w")).alias("syllables")).agg(F.count("*").alias("n")))
        for size in (40, 1000, 1 << 20):
            monkeypatch.setattr(text, "BLOCK", size)
            assert told(text.words_by_syllables(docs, F.col("t"))) == wanted
    plan = registry.QUERIES["x04_syllables"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "lower" in plan and not any(step in plan.lower() for step in ("regexp", "split", "generate"))
    for rest in ([None], ["", " "]):
        assert told(text.words_by_syllables(spark.createDataFrame([(r,) for r in rest], "t string"), F.col("t"))) == {}


def test_exceptions_nearby(spark):
    """Against the windows around each occurrence."""
    rng = random.Random(2)
    rows = ["".join(rng.choice(["of", "OF", "e", "x", "ratio", "\n", " " * 20, "offe", "é"]) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    docs = spark.createDataFrame([(r,) for r in rows], "t string")
    for term, exception in (("of", "e"), ("of", "ratio"), ("Of", "ff")):
        near = F.transform(text.context_windows(F.col("t"), term), F.lower)
        broken = F.exists(near, lambda w: ~F.contains(w, F.lit(exception)))
        assert docs.filter(broken != text.lacks_nearby(F.col("t"), term, exception)).count() == 0


def test_prompts(spark):
    rows = [("a", "v", None, "f", "t", "s" * 13_000), ("b", None, "r", "f", "t", None)]
    table = spark.createDataFrame(rows, "brand string, voice string, refs string, fallback string, title string, scenario string")
    made = prompts.system_prompt(*(F.col(c) for c in ("brand", "voice", "refs", "fallback", "title", "scenario")))
    first, second = (r["m"] for r in table.select(made.alias("m")).orderBy("brand").collect())
    assert first["truncated"] and first["warnings"] == ["references missing", "scenario halved"] and "s" * 6500 + "\n\n(sh" in first["prompt"] and "s" * 6501 not in first["prompt"]
    assert second["warnings"] == ["scenario missing"] and "Voice\n" not in second["prompt"] and second["tokens"] == -(-len(second["prompt"]) // 4)


def test_context_windows(spark):
    assert values(spark, text.context_windows(F.col("t"), "ab", 2), ["xxABxxxxab", "none"]) == [["xxABxx", "xxab"], []]


def test_dates(spark):
    days = spark.createDataFrame([(dt.date(2026, 6, 15),), (dt.date(2026, 6, 14),), (dt.date(2026, 12, 1),)], "d date")
    rows = days.select(dates.next_monday(F.col("d")), dates.instant(F.col("d"), F.lit("09:00")).cast("string"), dates.slot_label(dates.instant(F.col("d"), F.lit("09:00"))), dates.weekday(F.col("d"))).collect()
    assert [tuple(r) for r in rows] == [
        (dt.date(2026, 6, 22), "2026-06-15 16:00:00", "Mon, Jun 15, 9:00 AM PDT", 1),
        (dt.date(2026, 6, 15), "2026-06-14 16:00:00", "Sun, Jun 14, 9:00 AM PDT", 0),
        (dt.date(2026, 12, 7), "2026-12-01 17:00:00", "Tue, Dec 1, 9:00 AM PST", 2),
    ]


#: The patterns as they are meant, some of which take a square of time or a deep stack.
PLAIN_EMAIL = r"(?i)(?<![A-Za-z0-9_])[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}(?![A-Za-z0-9_])"
PLAIN_SITE = r"(?i)(?<![A-Za-z0-9_])(?:https?://|www\.)\S+|(?<![A-Za-z0-9_])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org|biz|info|co|io|us)(?![A-Za-z0-9_])\S*"


def plain_dashes(t):
    for pattern, becomes, raised in text.DASH_STEPS:
        becomes = becomes.replace("$", "\\").replace("\u0001", "")
        t = re.sub(pattern, (lambda m, b=becomes: m.expand(b)[:-1] + m.expand(b)[-1].upper()) if raised else becomes, t)
    return t


def odd_texts(pieces, n, longest=14, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(pieces, k=rng.randint(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("plain,quick,becomes", [(PLAIN_EMAIL, text.EMAIL, "#"), (PLAIN_SITE, text.SITE, "$1#")], ids=["email", "site"])
def test_quick_patterns_match_the_same(spark, plain, quick, becomes):
    pieces = ["a", "b1", "com", "org", "io", "net", ".", ".", "-", "_", "@", "@", " ", "www.", "http://", "é", "%", "Co", "..", "+"]
    df = spark.createDataFrame([(t,) for t in odd_texts(pieces, 20_000)], "t string")
    wrong = df.filter(F.regexp_replace("t", plain, "#") != F.regexp_replace("t", quick, becomes)).collect()
    assert not wrong


def test_quick_dashes_are_the_same(spark):
    rows = odd_texts(["a", "B", "7", " ", "  ", "\t", "—", "–", "-", "- ", " -", ".", "!", ",", ":", "\n"], 5000)
    for t, found in zip(rows, values(spark, text.strip_dashes(F.col("t")), rows), strict=True):
        assert found == plain_dashes(t), t


def test_trimmed_edges(spark):
    rows = odd_texts([" ", "\t", "\n", "a", "b"], 2000)
    assert values(spark, F.regexp_replace("t", text.EDGES, ""), rows) == values(spark, F.regexp_replace("t", r"^\s+|\s+\z", ""), rows)


def test_trimmed(spark):
    rows = odd_texts([" ", "\t", "\n", "\r", "\x0b", "\f", "\u0085", "\u00a0", "a", "b"], 2000)
    assert values(spark, text.trimmed(F.col("t")), rows) == values(spark, F.regexp_replace("t", r"^\s+|\s+\z", ""), rows)


@pytest.mark.parametrize(("f", "most"), [("strip_scaffolding", 5), ("strip_dashes", 5), ("syllable_count", 3.5)])
def test_time_against_one_plain_pass(spark, f, most):
    """Two megabytes of prose in lines take a few times as long as leaving out what isn't a letter."""
    line = "The quiet engine moves along a valley of stones, made by rivers\n"
    rows = spark.range(2000).select(F.concat(F.lit("Sure!\n--- — x - y\n"), F.repeat(F.lit(line), 16), F.col("id")).alias("t")).repartition(1).localCheckpoint()

    def seconds(made):
        took = []
        for _ in range(4):
            began = time.time()
            rows.select(made.alias("x")).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took[1:])

    assert seconds(getattr(text, f)(F.col("t"))) < most * seconds(F.regexp_replace(F.lower("t"), r"[^a-z\s]", ""))


@pytest.mark.parametrize("unit", ["a.", "a_b-", " ", "\t-", "Next move: go\n", "— ", "a@", "a.b@c.", "-", "\n", "x \n"])
@pytest.mark.parametrize("f", ["scrub_identity", "strip_dashes", "strip_scaffolding", "sentences", "strip_openers"])
def test_a_megabyte_of_anything(spark, f, unit):
    """Neither the square of a run nor a stack that ends the JVM."""
    began = time.time()
    row = spark.range(1).select(F.concat(F.lit("x"), F.repeat(F.lit(unit), (1 << 20) // len(unit)), F.lit("!y")).alias("t"))
    assert row.select(F.length(getattr(text, f)(F.col("t")).cast("string"))).first()[0] is not None
    assert time.time() - began < 15
