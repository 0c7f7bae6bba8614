"""Texts put together of ordered blocks. A block that is null is left out; blocks are joined by line ends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom.functions import text as X


def blocks(*parts: Column | str) -> Column:
    return F.array_join(F.array_compact(F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))), "\n")


def block(title: Column | str, body: Column) -> Column:
    """Title, body and an empty line; null without a body."""
    return F.concat(F.lit(title) if isinstance(title, str) else title, F.lit("\n"), body, F.lit("\n"))


@dataclass(frozen=True)
class Wording:
    """What is said around the values; {} stands for one. A business brings its own."""

    opening: str = "Brand: {}\n"
    voice: str = "Voice"
    examples: str = "Examples"
    spare: str = "Spare examples"
    scene: str = "Scene: {}"
    closing: str = "Stay within the examples."
    shortened: str = "\n\n(shortened)"
    faults: str = "Faults of the {} text\n{}\n"
    day: str = "{}: {}"
    earlier: str = "Already said\n{}\n"
    wanted: str = "Wanted: 3 texts on {}\n"
    material: str = "Material"
    notes: str = "Notes"
    text: str = "Text"


PLAIN = Wording()


def filled(template: str, *values: Column) -> Column:
    """The template with the values in the place of each {}; null if one is."""
    first, *others = template.split("{}")
    return F.concat(F.lit(first), *(part for value, after in zip(values, others, strict=True) for part in (value, F.lit(after))))


def system_prompt(brand: Column, voice: Column, references: Column, fallback: Column, title: Column, scenario: Column, hard: int = 3000, warn: int = 2500, say: Wording = PLAIN) -> Column:
    """struct(prompt, tokens, truncated, warnings) of a brand's blocks: its voice, its references, else what the
    fallback says, the scenario, and a closing rule. Beyond the hard budget the scenario is halved."""

    def made(shown: Column) -> Column:
        given = F.coalesce(block(say.examples, references), block(say.spare, fallback))
        return blocks(filled(say.opening, brand), block(say.voice, voice), given, block(filled(say.scene, title), shown), say.closing)

    half = F.concat(F.substr(scenario, F.lit(1), F.floor(F.length(scenario) / 2).cast("int")), F.lit(say.shortened))

    def budgeted(whole: Column) -> Column:
        over = (X.token_estimate(whole) > hard) & scenario.isNotNull()

        def told(prompt: Column) -> Column:
            n = X.token_estimate(prompt)
            warnings = F.array_compact(
                F.array(
                    F.when(references.isNull(), F.lit("references missing")),
                    F.when(scenario.isNull(), F.lit("scenario missing")),
                    F.when(over, F.lit("scenario halved")),
                    F.when(n > hard, F.lit("over budget")).when(n > warn, F.lit("near budget")),
                )
            )
            return F.struct(prompt.alias("prompt"), n.alias("tokens"), over.alias("truncated"), warnings.alias("warnings"))

        return X.let(F.when(over, made(half)).otherwise(whole), told)

    return X.let(made(scenario), budgeted)


def day_prompt(theme: Column, seeds: Column, before: Column, failed: Column, failures: Column, say: Wording = PLAIN) -> Column:
    """What a day's posts are asked for with: what failed last time, what earlier days said (an array), the
    theme and the raw material (numbered lines)."""
    days = F.transform(before, lambda s, i: filled(say.day, (i + 1).cast("string"), s))
    prior = F.when(F.size(before) > 0, filled(say.earlier, F.array_join(days, "\n")))
    asked = filled(say.wanted, F.replace(theme, F.lit("_"), F.lit(" ")))
    return blocks(filled(say.faults, failed, failures), prior, asked, block(say.material, seeds))


def rewrite_prompt(notes: Column, previous: Column, say: Wording = PLAIN) -> Column:
    return blocks(block(say.notes, notes), say.text, previous)
