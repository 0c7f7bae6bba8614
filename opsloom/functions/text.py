"""Text functions over columns, built from Spark's own expressions but for two (chunks, words_by_syllables).

Lengths count code points. Word boundaries are ASCII ones, written as lookarounds, because Java's own
depend on Unicode classes. Null text gives null unless a function says otherwise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and word lists that results depend on, compared as they are.
VOCATIVE = r"^[A-Z][a-zA-Z'’.-]+,\s+"
DOMAINS = "com|net|org|biz|info|co|io|us"
SPECIFIC = (
    r"\$\s?\d",
    r"(?<![A-Za-z0-9_])\d+\s?%",
    r"(?i)(?<![A-Za-z0-9_])(?:pool|pest|hvac|landscaping|carpet|garage|handyman|cleaning|plumbing|electrical|roofing)(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])(?:Henderson|Summerlin|Vegas|Las Vegas|North Las Vegas|NLV|Boulder City|Pahrump|Mesquite|Reno|Sparks)(?![A-Za-z0-9_])",
)
CITATIONS = (
    (r"(?i)(?<![A-Za-z0-9_])(?:stud(?:y|ies)|report|survey|research)\s+(?:show|shows|showed|found|says|say|suggests?|proves?|confirms?)(?![A-Za-z0-9_])", "cites a study/report"),
    (r"(?i)(?<![A-Za-z0-9_])according to (?:a |the |one |recent )?(?:stud(?:y|ies)|reports?|surveys?|research|data|statistics)(?![A-Za-z0-9_])", "according-to citation"),
    (r"(?i)(?<![A-Za-z0-9_])google\s+[\"'“][^\"'”]{3,}[\"'”]\s+and(?![A-Za-z0-9_])", "points readers at a search to find data"),
    (r"(?i)(?<![A-Za-z0-9_])(?:the )?data (?:backs|shows|proves|confirms)(?![A-Za-z0-9_])", "vague data claim"),
)
OPENERS = ("certainly", "great question", "absolutely", "of course")
FENCE = r"^\s*[-_*]{3,}\s*$"
PREAMBLE = r"(?i)^(here'?s (the|your|a|an) .{0,40}[:.]?|sure[.!,]?|got it[.!,]?)$"
NEXT_MOVE = r"(?i)^(\*\*)?\s*next move\s*:?"
NOT_READY = r"(?i)not (?:available|ready|finished)|2207027|media.{0,20}process"
#: The rewrites of long dashes and spaced hyphens, in their order: what is looked for, what it becomes, and
#: whether the letter behind the mark is raised.
DASH_STEPS = (
    (r"(\d)[ \t]*[—–][ \t]*(\d)", "$1-$2", False),
    (r"(\d)[ \t]+-[ \t]+(\d)", "$1-$2", False),
    (r"(?m)^([ \t]*)[—–][ \t]*", "$1- ", False),
    (r"([.!?])[ \t]*[—–][ \t]*([a-z])", "$1 \u0001$2", True),
    (r"([.!?])[ \t]+-[ \t]+([a-z])", "$1 \u0001$2", True),
    (r"([.!?,:;])[ \t]*[—–][ \t]*", "$1 ", False),
    (r"([.!?,:;])[ \t]+-[ \t]+", "$1 ", False),
    (r"[ \t]*[—–][ \t]*([a-zA-Z])", ". \u0001$1", True),
    (r"(\S)[ \t]+-[ \t]+([a-zA-Z])", "$1. \u0001$2", True),
    (r"[ \t]*[—–][ \t]*", ", ", False),
    (r"[ \t]{2,}", " ", False),
)
# End of the fixed values.

_MARK = "\u0001"

# The following take time in proportion to a text, whatever it is, and no stack: a run is entered where it begins, and
# loops give nothing back. All starts within a run have the same end, so the first one speaks for all.

#: A run of what may stand before the @ begins behind anything else, or one mark behind the match before.
EMAIL = r"(?i)(?:(?<![a-z0-9._%+-])|(?<=\G[.%+-]))[a-z0-9._%+-]++@[a-z0-9.-]+\.[a-z]{2,}(?![A-Za-z0-9_])"
#: From a chain of labels with dots between, up to the first that is a top-level domain, on to the next white space. A
#: chain begins where no label or dotted label ends; behind an underscore its first word is no part of it ($1).
_CHAIN = rf"[a-z0-9-]++(?:(?!\.(?:{DOMAINS})(?![A-Za-z0-9_]))\.[a-z0-9-]++)*+\.(?:{DOMAINS})(?![A-Za-z0-9_])\S*+"
SITE = rf"(?i)(?<![A-Za-z0-9_])(?:https?://|www\.)\S++|(?:(?<![a-z0-9_-])(?<![a-z0-9-]\.)|(?<=_)([a-z0-9]*+(?:-?\.|-)))(?=[a-z0-9-]){_CHAIN}"
#: Steps that start with blanks, entered where a run of them begins, or behind the match before.
_BLANKS = r"[ \t]*"
_AT_RUN = r"(?=[ \t—–])(?:(?<![ \t])|\G)[ \t]*+"
#: A step that starts with any visible sign is entered at the blank behind it, which must not be the end of the match before.
_SIGN, _BEHIND_SIGN = r"(\S)[ \t]+-[ \t]+", r"(?=[ \t])(?<=\S)(?!\G)[ \t]++-[ \t]++"
#: White space at both ends.
EDGES = r"^\s+|(?<!\s)\s++\z"
#: White space, as \\s has it.
WHITE = " \t\n\x0b\f\r"


#: White space within a line, and what $ lets follow at its end.
_GAP, _LINE_END = r"[ \t\x0B\f\r]*+", r"[\u0085\u2028\u2029]?"
_FENCE_LINE = rf"\n{_GAP}[-_*]{{3,}}+{_GAP}{_LINE_END}(?=\n)"
_INTRODUCTION = rf"(?:here'?s (?:the|your|a|an) (?={_GAP}\S).{{0,40}}[:.]?|sure[.!,]?|got it[.!,]?)"
_WRAP_LINE = rf"{_GAP}(?:[-_*]{{3,}}+{_GAP}{_LINE_END}|{_INTRODUCTION}{_LINE_END}{_GAP})?"
#: Lines at the start that wrap a draft: blank ones, fences (FENCE) and introductions (PREAMBLE).
_WRAPPING = rf"(?i)\A(?:{_WRAP_LINE}\n)*+(?:{_WRAP_LINE}\z)?"


def whole_word(term: str) -> str:
    """Java pattern of a literal term between ASCII word boundaries, in any case."""
    body = "".join("\\" + c if c in r"\.[]{}()*+?^$|-" else c for c in term)
    return f"(?i)(?<![A-Za-z0-9_]){body}(?![A-Za-z0-9_])"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once; an expression named twice in a lambda is worked out twice."""
    return F.get(F.transform(F.array(value), use), 0)


def trimmed(text: Column) -> Column:
    """Without white space at both ends; no pattern has to look at what is between."""
    return F.btrim(text, F.lit(WHITE))


def scrub_identity(text: Column) -> Column:
    """Drop a leading name, e-mail addresses and sites; white space in one."""
    text = F.regexp_replace(text, VOCATIVE, "")
    text = F.regexp_replace(text, EMAIL, "[their email]")
    text = F.regexp_replace(text, SITE, "$1[their site]")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def table_cells(line: Column) -> Column:
    """Cells of a pipe row, without the outer pipes, trimmed."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), "^\\x7C", ""), "\\x7C\\z", "")
    return F.transform(F.split(inner, "\\x7C", -1), lambda c: F.trim(c))


def sentences(text: Column) -> Column:
    """array<string>: split after . ! ? and an optional quote, and at line ends."""
    # looks back from white space only; line ends within what follows a sentence belong to it
    pieces = F.split(text, "(?=\\s)(?:(?<=[.!?]['\"]?)\\s+|\n+)", -1)
    return F.array_remove(F.transform(pieces, trimmed), "")


def tokens(text: Column) -> Column:
    """White-space separated words."""
    return F.array_remove(F.split(text, r"\s+", -1), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def syllables(word: Column) -> Column:
    """Vowel groups, a silent last e left out; 0 without letters, else 1 at least."""

    def count(letters: Column) -> Column:
        groups = F.regexp_count(letters, F.lit("[aeiouy]+"))
        return F.when(letters == "", 0).when(letters.endswith("e"), let(groups, lambda g: F.greatest(F.lit(1), g - F.when(g > 1, 1).otherwise(0)))).otherwise(F.greatest(F.lit(1), groups))

    return let(F.regexp_replace(F.lower(word), "[^a-z]", ""), count).cast("long")


def syllable_count(text: Column) -> Column:
    """Sum of syllables() over the words of a text. What isn't a letter or white space is left out; an e that ends a word
    is set apart, other vowels are all written a, and runs of vowels become one. A word then has as many syllables as it
    has a, or one if it has none: its last e counts only where it stands alone."""
    letters = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^a-z\s]+", ""), F.lit(" "))
    for blank in WHITE[1:]:
        letters = F.replace(letters, F.lit(blank), F.lit(" "))
    letters = F.replace(letters, F.lit("e "), F.lit("E "))
    for vowel in "eiouy":
        letters = F.replace(letters, F.lit(vowel), F.lit("a"))
    letters = F.replace(F.regexp_replace(letters, "a{2,}", "a"), F.lit("aE"), F.lit("E"))
    counted = lambda t: F.length(t) - F.length(F.replace(t, F.lit("a"), F.lit(""))) + F.regexp_count(t, F.lit(" [^a ]++(?= )"))
    return let(letters, counted).cast("long")


#: What a byte of lower-case text is to syllables(): white space, a consonant, a vowel, an e, or a sign that is left out.
_SPACE, _CONSONANT, _VOWEL, _E = b" \x01\x02\x03"
_KINDS = bytes(_SPACE if chr(b) in WHITE else _E if b == ord("e") else _VOWEL if chr(b) in "aiouy" else _CONSONANT if ord("a") <= b <= ord("z") else 0 for b in range(256))
#: Bytes that are looked at together.
BLOCK = 1 << 20


def _kinds(texts: Iterable[bytes], size: int) -> Iterator[bytes]:
    """The bytes of many texts as kinds, in blocks of about that size, cut between words."""
    held, n = [], 0
    for text in (*texts, None):
        if text is not None:
            held.append(text)
            n += len(text) + 1
        if n >= size or text is None:
            kinds, at = b" ".join(held).translate(_KINDS), 0
            while at < len(kinds):
                end = kinds.find(_SPACE, at + size)
                end = len(kinds) if end < 0 else end
                yield kinds[at:end]
                at = end
            held, n = [], 0


def _by_syllables(kinds: bytes) -> np.ndarray:
    """How many words have 0, 1, 2 ... syllables, as syllables() has them."""
    all_bytes = np.frombuffer(b" " + kinds + b" ", np.uint8)
    inside = all_bytes != _SPACE
    words = np.count_nonzero(inside[1:] & ~inside[:-1])
    letters = all_bytes[all_bytes != 0]
    inside, vowel = letters != _SPACE, (letters == _VOWEL) | (letters == _E)
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    last = np.flatnonzero(inside[:-1] & ~inside[1:])
    if not len(first):
        return np.array([words])
    groups = np.add.reduceat(np.append(False, vowel[1:] & ~vowel[:-1]).astype(np.int32), first)
    counts = np.bincount(np.maximum(1, groups - (letters[last] == _E)))
    counts[0] = words - len(first)
    return counts


def words_by_syllables(docs: DataFrame, text: Column) -> DataFrame:
    """(syllables, n): how many words of all texts have how many syllables(). Bytes of many texts are looked at together,
    and of each batch only the counts leave its task; a pattern for each word took most of the time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            told = Counter()
            for kinds in _kinds(rows["text"].dropna(), BLOCK):
                counts = _by_syllables(kinds)
                found = np.flatnonzero(counts)
                told.update(dict(zip(found.tolist(), counts[found].tolist(), strict=True)))
            yield pd.DataFrame({"syllables": list(told), "n": list(told.values())}, dtype="int64")

    lower = docs.select(F.lower(text).cast("binary").alias("text"))
    return lower.mapInPandas(run, "syllables long, n long").groupBy("syllables").agg(F.sum("n").alias("n"))


def reading_grade(text: Column) -> Column:
    """Flesch-Kincaid grade; 0 for empty text."""

    def grade(words: Column, n_sentences: Column) -> Column:
        value = 0.39 * (words / n_sentences) + 11.8 * (syllable_count(text) / words) - 15.59
        return F.when((n_sentences == 0) | (words == 0), 0.0).otherwise(value)

    return let(word_count(text), lambda words: let(F.size(sentences(text)), lambda n: grade(words, n)))


def context_windows(text: Column, term: str, width: int = 50) -> Column:
    """What surrounds each non-overlapping occurrence of a literal term, in any case. Offsets come from
    the lengths of what lies between occurrences."""
    n = len(term)
    between = F.split(F.lower(text), "\\Q" + term.lower() + "\\E", -1)
    gaps = F.slice(between, F.lit(1), F.size(between) - 1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    walked = F.aggregate(
        gaps,
        empty,
        lambda a, g: F.struct((a["at"] + F.length(g) + n).alias("at"), F.concat(a["starts"], F.array(a["at"] + F.length(g))).alias("starts")),
        lambda a: a["starts"],
    )
    begin = lambda s: F.greatest(F.lit(0), s - width)
    return F.transform(walked, lambda s: F.substr(text, begin(s) + 1, F.least(F.length(text), s + n + width) - begin(s)))


def lacks_nearby(text: Column, term: str, exception: str, width: int = 50) -> Column:
    """Does a literal term occur, in any case, without the exception within `width` of it? One search: at a
    term, what starts up to `width` before it, or ends up to `width` after it, mustn't be the exception."""
    n, e = len(term), "\\Q" + exception.lower() + "\\E"
    after = n + width - len(exception)
    later = rf"(?!.{{0,{after}}}{e})" if after >= 0 else ""
    return F.lower(text).rlike(rf"(?s)(?=\Q{term.lower()}\E)(?<!(?={e}).{{1,{width}}}){later}")


def is_specific(text: Column, patterns: Sequence[str] = SPECIFIC) -> Column:
    """Does any marker (amount, percentage, industry, place) occur? Industries and places are a business's own."""
    found = text.rlike(patterns[0])
    for pattern in patterns[1:]:
        found = found | text.rlike(pattern)
    return found


def _raise_after(text: Column, pattern: str, keep: str) -> Column:
    """Replace pattern by keep and its last group with a capital: that group is put behind a mark, and the
    first letter of what follows each mark is raised."""
    pieces = F.split(F.regexp_replace(text, pattern, keep), _MARK, -1)
    raised = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))))
    return F.array_join(raised, "")


def strip_dashes(text: Column) -> Column:
    """Rewrite long dashes and spaced hyphens: ranges keep a hyphen, bullets become hyphens, the rest
    becomes sentence breaks or commas. The order of rewrites matters."""

    def rewritten(text: Column) -> Column:
        for pattern, becomes, raised in DASH_STEPS:
            pattern = _AT_RUN + pattern.removeprefix(_BLANKS) if pattern.startswith(_BLANKS + "[—–]") else pattern
            if pattern.startswith(_SIGN):
                pattern, becomes = _BEHIND_SIGN + pattern.removeprefix(_SIGN), becomes.removeprefix("$1").replace("$2", "$1")
            text = _raise_after(text, pattern, becomes) if raised else F.regexp_replace(text, pattern, becomes)
        return text

    # no step looks beyond a line, and most lines have nothing to rewrite
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(r"[—–]|[ \t]-[ \t]|[ \t]{2}"), rewritten(x)).otherwise(x))
    return F.array_join(lines, "\n")


def strip_scaffolding(text: Column) -> Column:
    """Leave out what wraps a draft: leading blanks, fences and introductions; from a "next move" line near
    the end on; fences anywhere. Only the last 12 lines, which can hold that mark, are looked at one by one."""

    def ended(tail: Column) -> Column:
        """Lines of the tail up to the last mark."""
        marks = F.transform(tail, lambda x, i: F.when(trimmed(x).rlike(NEXT_MOVE), i))
        return let(F.array_max(marks), lambda cut: F.when(cut.isNull(), tail).otherwise(F.slice(tail, F.lit(1), cut)))

    def kept(body: Column) -> Column:
        tail = F.substring_index(body, "\n", -12)
        return let(tail, lambda tail: F.concat(F.lit("\n"), F.left(body, F.length(body) - F.length(tail)), F.array_join(let(F.split(tail, "\n", -1), ended), "\n"), F.lit("\n")))

    body = F.substr(text, F.length(F.regexp_extract(text, _WRAPPING, 0)) + 1)
    return trimmed(F.regexp_replace(F.regexp_replace(let(body, kept), _FENCE_LINE, ""), r"\n{3,}", "\n\n"))


def strip_openers(text: Column) -> Column:
    """Leave out flattering openers, one after the other; an I that starts the text gives way."""
    for opener in OPENERS:
        text = F.regexp_replace(text, rf"(?i)^{opener}[!.,]?\s*", "")
    text = F.when(text.rlike(r"^I(?![A-Za-z0-9_])"), F.regexp_replace(text, r"^I\s+", "Look — ")).otherwise(text)
    return trimmed(text)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def within_budget(prompt: Column, scenario: Column, hard: int = 3000, warn: int = 2500) -> Column:
    """struct(scenario, status): beyond the hard budget the scenario is halved."""
    n = token_estimate(prompt)
    half = F.substr(scenario, F.lit(1), F.floor(F.length(scenario) / 2).cast("int"))
    status = F.when(n > hard, "truncated").when(n > warn, "warned").otherwise("ok")
    return F.struct(F.when(n > hard, half).otherwise(scenario).alias("scenario"), status.alias("status"))


def observation_map(observations: Column) -> Column:
    """map<string,string> of "key: value" texts: split at the first colon, trimmed; no key, no entry; the
    last of equal keys counts."""
    said = F.filter(observations, lambda o: F.instr(o, ":") > 0)
    pairs = F.transform(said, lambda o: F.struct(F.trim(F.substring_index(o, ":", 1)).alias("k"), F.trim(F.substr(o, F.instr(o, ":") + 1)).alias("v")))

    def as_map(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        last = lambda name: F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"]
        return let(names, lambda ns: F.map_from_arrays(ns, F.transform(ns, lambda name: last(name))))

    return let(F.filter(pairs, lambda p: p["k"] != ""), as_map)


def chunks(limit: int = 1900, least: int = 200):
    """A pandas UDF text -> array<string>: greedy pieces of at most `limit`, cut before the last line end if
    that leaves more than `least`. Where a piece ends depends on the one before, so this is a fold."""

    def cut(text: str) -> list[str]:
        at, out = 0, []
        while len(text) - at > limit:
            line = text.rfind("\n", at, at + limit + 1)
            end = line if line > at + least else at + limit
            out.append(text[at:end])
            at = end
        return [*out, text[at:]] if at < len(text) or not out else out

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else cut(t))

    return run


def headline(body: Column) -> Column:
    """First sentence, or the first 90; 87 and an ellipsis if it is longer."""
    sentence = F.regexp_extract(body, r"^[^.!?]+[.!?]", 0)
    said = F.when(sentence == "", F.substring(body, 1, 90)).otherwise(F.trim(sentence))
    return F.when(F.length(said) > 90, F.concat(F.substring(said, 1, 87), F.lit("…"))).otherwise(said)


def one_liner(body: Column) -> Column:
    """First sentence within the first line, or the first 80."""
    sentence = F.regexp_extract(body, r"^[^.!?\n]+[.!?]", 0)
    return F.when(sentence == "", F.substring(body, 1, 80)).otherwise(F.trim(sentence))


def slug(title: Column, most: int = 60) -> Column:
    words = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+\\z", "")
    return F.coalesce(F.nullif(F.substring(words, 1, most), F.lit("")), F.lit("untitled"))


def note_name(title: Column, day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("-"), slug(title), F.lit(".md"))


def cron_parts(value: Column, default: str) -> Column:
    """struct(expr, zone): a last token with a slash, of six or more, is the zone."""
    parts = tokens(value)
    last = F.try_element_at(parts, F.lit(-1))
    zoned = (F.size(parts) >= 6) & F.contains(last, F.lit("/"))
    expr = F.when(zoned, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")).otherwise(F.trim(value))
    return F.struct(expr.alias("expr"), F.when(zoned, last).otherwise(default).alias("zone"))


def person_urn(body: Column) -> Column:
    """The URN named anywhere in a JSON answer, else made from its id fields."""
    named = F.nullif(F.regexp_extract(body, r"urn:li:person:[A-Za-z0-9_-]+", 0), F.lit(""))
    inner = F.coalesce(F.get_json_object(body, "$.response_dict"), body)
    own = F.coalesce(*(F.nullif(F.get_json_object(inner, f"$.{k}"), F.lit("")) for k in ("author_id", "sub", "id")))
    return F.coalesce(named, F.concat(F.lit("urn:li:person:"), own))


def share_urn(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, r"urn:li:(?:share|ugcPost|activity):[A-Za-z0-9_-]+", 0), F.lit(""))


def graph_id(body: Column) -> Column:
    """A numeric id of a JSON answer: of its id fields, else the first long one anywhere."""
    inner = F.coalesce(F.get_json_object(body, "$.response_dict"), F.get_json_object(body, "$.data"), body)
    own = F.coalesce(*(F.get_json_object(inner, f"$.{k}") for k in ("id", "creation_id", "user_id")))
    anywhere = F.nullif(F.regexp_extract(body, r'"(?:id|creation_id)"\s*:\s*"?(\d{5,})"?', 1), F.lit(""))
    return F.coalesce(F.when(own.rlike(r"^\d+\z"), own), anywhere)


def media_not_ready(error: Column) -> Column:
    return error.rlike(NOT_READY)


def short_id(prefix: str, key: Column, digits: int = 4) -> Column:
    """A stable id: prefix and the first digits of the key's md5."""
    return F.concat(F.lit(prefix), F.substring(F.md5(key), 1, digits))


def public_url(base: Column, file: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+\\z", ""), F.lit("/images/"), file)


def numbered(items: Column) -> Column:
    """Lines "1. ..." of an array."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def tags(fixed: list[str], niche: Column) -> Column:
    return F.array_compact(F.array(*map(F.lit, fixed), F.nullif(F.lower(F.trim(niche)), F.lit(""))))


def after_marker(text: Column, marker: str, most: int = 2000) -> Column:
    """What follows the marker, else the end of the text."""
    return F.coalesce(F.get(F.split(text, "\\Q" + marker + "\\E", 3), 1), F.right(text, F.lit(most)))


def first_match(text: Column, cases: list[tuple[str, str]], default: str) -> Column:
    """Label of the first literal that the text contains."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in cases), F.lit(default))


def image_token(name: Column) -> Column:
    """The 32 hex digits of a stored image's name, else null."""
    return F.nullif(F.regexp_extract(name, r"^([0-9a-f]{32})\.jpg\z", 1), F.lit(""))


def valid_patterns(patterns: Sequence[str]) -> list[str]:
    """Those that Java can compile; a rule with a bad pattern is left out, not an error."""
    compiler, good = SparkSession.active()._jvm.java.util.regex.Pattern, []
    for p in patterns:
        try:
            compiler.compile(p)
            good.append(p)
        except Exception:  # noqa: BLE001  whatever Java says of the pattern
            continue
    return good
