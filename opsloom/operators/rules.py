"""Text rules as data: each rule becomes a column expression, so texts are checked where they lie and no
text meets a rule by a join. A failure is struct(check, detail); checks give arrays of them in rule order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions import text as X

FAILURE = "array<struct<check:string,detail:string>>"
# This pattern, and below the texts of failures and of feedback, are compared as they are.
RECAP = r"(?i)(?<![A-Za-z0-9_])(?:spent|made|been|tried|worked|grinded|grinding)(?![A-Za-z0-9_]).{0,80}(?<![A-Za-z0-9_])(?:today|now|finally|just)(?![A-Za-z0-9_])"


@dataclass
class Word:
    term: str
    exception: str | None = None
    hint: str | None = None


@dataclass
class Scenario:
    name: str
    patterns: Sequence[str] = ()
    keywords: Sequence[str] = ()
    structures: Sequence[str] = ()


@dataclass
class Voice:
    """Rules of one brand."""

    words: Sequence[Word] = ()
    structures: Sequence[tuple[str, str]] = ()
    scenarios: Sequence[Scenario] = ()
    dash_policy: str = "none"
    most_words: int = 20
    reading_level: float | None = None
    blocked: Sequence[str] = field(default_factory=tuple)


def failure(check: str, detail: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), detail.alias("detail"))


def _said(cases: list[Column]) -> Column:
    """Those of the cases that aren't null."""
    return F.array_compact(F.array(*cases)).cast(FAILURE) if cases else F.array().cast(FAILURE)


def _excerpt(text: Column, pattern: str) -> Column:
    return F.substring(F.regexp_extract(text, pattern, 0), 1, 60)


def _any_case(pattern: str) -> str:
    return pattern if pattern.startswith("(?i)") else f"(?i){pattern}"


def usable(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """(name, pattern) in any case, without those whose pattern doesn't compile."""
    cased = [(name, _any_case(p)) for name, p in rules]
    good = set(X.valid_patterns([p for _, p in cased]))
    return [(name, p) for name, p in cased if p in good]


def banned_words(text: Column, words: Sequence[Word]) -> Column:
    cases = []
    for w in words:
        pattern = X.whole_word(w.term)
        hits = F.regexp_count(text, F.lit(pattern))
        broken = hits > 0
        if w.exception:
            broken = broken & X.lacks_nearby(text, w.term, w.exception)
        note = F.concat(F.lit(f'"{w.term}" detected '), hits.cast("string"), F.lit("x" + (f" (pos hint: {w.hint})" if w.hint else "")))
        cases.append(F.when(broken, failure("banned_words", note)))
    return _said(cases)


def banned_structures(text: Column, structures: Sequence[tuple[str, str]]) -> Column:
    cases = []
    for name, p in usable(structures):
        cases.append(F.when(text.rlike(p), failure("banned_structures", F.concat(F.lit(f'pattern_id="{name}" matched: "'), _excerpt(text, p), F.lit('"')))))
    return _said(cases)


def dashes(text: Column, policy: str) -> Column:
    if policy != "none":
        return _said([])
    cases = (("—", "em-dash (—) detected"), ("–", "en-dash (–) detected"), (" - ", "mid-sentence ' - ' detected (use period or comma)"))
    return _said([F.when(F.contains(text, F.lit(mark)), failure("dash_policy", F.lit(note))) for mark, note in cases])


def long_sentences(text: Column, most: int) -> Column:
    def judged(s: Column, i: Column) -> Column:
        note = lambda n: F.concat(F.lit("sentence "), (i + 1).cast("string"), F.lit(" = "), n.cast("string"), F.lit(f' words (cap {most}): "'), F.substring(s, 1, 60), F.lit('..."'))
        return X.let(X.word_count(s), lambda n: F.when(n > most, failure("max_sentence_words", note(n))))

    return F.array_compact(F.transform(X.sentences(text), judged)).cast(FAILURE)


def reading_level(text: Column, most: float | None) -> Column:
    if most is None:
        return _said([])
    grade = X.reading_grade(text)
    note = F.concat(F.lit("Flesch-Kincaid grade "), F.format_string("%.1f", grade), F.lit(f" exceeds cap {most:g}"))
    return _said([F.when(grade > most, failure("reading_level_max", note))])


def unspecific(text: Column) -> Column:
    return _said([F.when(~X.is_specific(text), failure("required_per_post", F.lit("no specificity marker found (dollar / %, named industry, or named neighborhood)")))])


def scenario_hits(text: Column, scenarios: Sequence[Scenario]) -> Column:
    cases = []
    for s in scenarios:
        for name, p in usable([(s.name, p) for p in s.patterns]):
            cases.append(F.when(text.rlike(p), failure("banned_scenarios", F.concat(F.lit(f'scenario_id="{name}" regex matched: "'), _excerpt(text, p), F.lit('"')))))
    return _said(cases)


def scenario_hints(text: Column, scenarios: Sequence[Scenario]) -> Column:
    cases = []
    for s in scenarios:
        for k in s.keywords:
            cases.append(F.when(text.rlike(X.whole_word(k)), failure("banned_scenarios", F.lit(f'scenario_id="{s.name}" keyword_trigger="{k}" found (manual review)'))))
        if "past_recap_present_win" in s.structures:
            note = F.lit(f'scenario_id="{s.name}" structural="past_recap_present_win" possibly matched (manual review)')
            cases.append(F.when(text.rlike(RECAP), failure("banned_scenarios", note)))
    return _said(cases)


def sanity(text: Column, year: int) -> tuple[Column, Column]:
    """(hard, soft): years beside the current one and unverifiable citations; other years."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])(?:19|20)\d{2}(?![A-Za-z0-9_])"), F.lit(0)))
    other = F.filter(found, lambda y: y.cast("int") != year)
    near = lambda y: F.abs(y.cast("int") - year) <= 1
    told = lambda y: failure("date_sanity", F.concat(F.lit("year "), y, F.lit(f" referenced (current year is {year})")))
    cited = [
        F.when(text.rlike(p), failure("unverifiable_citation", F.concat(F.lit(f'{label}: "'), _excerpt(text, p), F.lit('" — only claims from our own source sheets'))))
        for p, label in X.CITATIONS
    ]
    hard = F.concat(F.transform(F.filter(other, near), told).cast(FAILURE), _said(cited))
    return hard, F.transform(F.filter(other, lambda y: ~near(y)), told).cast(FAILURE)


def validate(drafts: DataFrame, voice: Voice, text: str = "text") -> DataFrame:
    """drafts with hard, soft and passed; checks in a fixed order."""
    t = F.col(text)
    hard = F.concat(
        banned_words(t, voice.words),
        banned_structures(t, voice.structures),
        dashes(t, voice.dash_policy),
        long_sentences(t, voice.most_words),
        reading_level(t, voice.reading_level),
        scenario_hits(t, voice.scenarios),
    )
    checked = drafts.withColumns({"hard": hard, "soft": F.concat(unspecific(t), scenario_hints(t, voice.scenarios))})
    return checked.withColumn("passed", F.size("hard") == 0)


def feedback(hard: Column, soft: Column, attempt: Column) -> Column:
    """What a rewrite is told; empty without hard failures."""
    line = lambda f: F.concat(F.lit("- ["), f["check"], F.lit("] "), f["detail"])
    block = lambda title, items: F.when(F.size(items) > 0, F.concat(F.array(F.lit(""), F.lit(title)), F.transform(items, line))).otherwise(F.array().cast("array<string>"))
    opening = F.array(F.concat(F.lit("Draft voice-check FAILED on attempt "), (attempt + 1).cast("string"), F.lit(". Issues:")))
    closing = F.array(
        F.lit(""),
        F.lit("Regenerate the draft to address all hard failures. Preserve voice, specificity, and the"),
        F.lit("scenario pattern. Do NOT introduce banned words/structures to fix one issue."),
    )
    lines = F.concat(opening, block("Hard failures (must fix):", hard), block("Soft warnings (review):", soft), closing)
    return F.when(F.size(hard) == 0, "").otherwise(F.array_join(lines, "\n"))


def first_block(haystack: Column, patterns: Sequence[str]) -> Column:
    """The first pattern, in rule order, that the text matches in any case; null if none does. A pattern that
    doesn't compile matches nothing."""
    none = F.lit(None).cast("string")
    return F.coalesce(*(F.when(haystack.rlike(p), F.lit(name)) for name, p in usable([(p, p) for p in patterns])), none)


def rule_matches(texts: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, rule_id) for each rule that a text matches: one pass over each text, then its matches. Patterns are
    as given in case; those that don't compile match nothing."""
    good = set(X.valid_patterns([p for _, p in rules]))
    hits = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(name)) for name, p in rules if p in good), F.lit(None).cast("string")))
    return texts.select(key, F.explode(hits).alias("rule_id"))


def checked_variant(drafts: DataFrame, voice: Voice, year: int, text: str = "text") -> DataFrame:
    """drafts with text stripped of scaffolding (and dashes, if the policy says none), failures of voice, sanity
    and block rules in that order, and passed."""
    stripped = X.strip_scaffolding(F.col(text))
    stripped = X.strip_dashes(stripped) if voice.dash_policy == "none" else stripped
    checked = validate(drafts.withColumn(text, stripped), voice, text)
    leaked = _said([F.when(first_block(F.col(text), voice.blocked).isNotNull(), failure("kg_leak_guard", F.lit("matched kg_blocked_patterns")))])
    failures = F.concat("hard", sanity(F.col(text), year)[0], leaked)
    return checked.withColumn("failures", failures).drop("hard", "soft").withColumn("passed", F.size("failures") == 0)


def request_faults(name: Column, email: Column, phone: Column) -> Column:
    """Why a form's request is refused: missing fields in order, then an address without a host; empty if it's
    good. White space alone is missing."""
    missing = lambda c: c.isNull() | (F.trim(c) == "")
    cases = [F.when(missing(c), F.lit(f"missing {n}")) for n, c in (("name", name), ("email", email), ("phone", phone))]
    shaped = F.when(~missing(email) & ~email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"), F.lit("bad email"))
    return F.array_compact(F.array(*cases, shaped))
