"""Language identification of pages by fusing evidence, Bayes' way.

Four kinds of evidence are added up as logarithms: the likelihood of the page's text under byte-trigram
models, the language that the markup declares, the language that the address names (a country's label
at the end of the host, or a language code as first path segment), and a prior for the host. What a
declaration or an address suffix is worth is measured: how often each occurs with each language by text
alone, by grouped aggregation. Host priors are smoothed hierarchically: a host's counts towards those of
its domain, a domain's towards those of all pages; a page's own text is left out of all three.

Trigram models are fitted on texts with known language, MOST_TRAINING at most, chosen by hash; every page
is judged on its whole text. Trigrams of one text depend on each other, so its likelihood counts as that
of EFFECTIVE trigrams at most.

Null or empty markup leaves the text without weight; a null URL has an empty host; a declaration that is
missing or unknown counts as a kind of its own. Ties go to the language that is first by name. Without
texts of known language, lang is null. A very long page takes time in proportion, and
memory for its text alone, in one task. Repeated pages count repeatedly in the statistics and get equal
results. Columns named like an output are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.common import STEP_BYTES, read, row_slices, stored

BUCKETS = 1 << 14
MOST_TRAINING = 4000
EFFECTIVE = 40.0
#: Weight of the level above, in pages.
SMOOTH = 5.0
#: Country labels at the end of a host and the language they speak for.
COUNTRIES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
_UNSEEN = re.compile(r"<(script|style)\b", re.I)
_CLOSE = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style")}
_TAG = re.compile(r"<(html|meta)\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
_NAMES = re.compile("content-language", re.I)
_CONTENT = re.compile(r"content\s*=\s*[\"']?([A-Za-z]+)", re.I)
_MULTIPLIER = np.uint32(2654435761)


def visible(page: str) -> str:
    """A page's text without markup, scripts and styles. One scan from left to right: what an end was looked for
    in vain for isn't looked for again, so hostile markup takes no more time than other."""
    shown, at, missing = [], 0, set()
    while (tag := page.find("<", at)) >= 0:
        shown.append(page[at:tag])
        at = -1
        if page.startswith("<!--", tag) and "comment" not in missing:
            end = page.find("-->", tag + 4)
            at = end + 3 if end >= 0 else -1
            missing |= {"comment"} if end < 0 else set()
        elif (kind := _UNSEEN.match(page, tag)) and (name := kind[1].lower()) not in missing:
            close = _CLOSE[name].search(page, kind.end())
            at = close.end() if close else -1
            missing |= set() if close else {name}
        if at < 0:
            at = page.find(">", tag) + 1
            if not at:
                shown[-1] += page[tag:]
                break
    else:
        shown.append(page[at:])
    return html.unescape(" ".join(shown))


def declared(page: str) -> str:
    """The language code that the markup declares, in lower case; else empty. Each tag is read once, to its end."""
    at = 0
    while tag := _TAG.search(page, at):
        at = page.find(">", tag.end())
        inside = page[tag.end() : at if at >= 0 else len(page)]
        if tag[1].lower() == "html":
            said = _LANG.search(inside)
        else:
            names = _NAMES.search(inside)
            said = _CONTENT.search(inside, names.end()) if names else None
        if said:
            return said[1].lower()
        if at < 0:
            break
    return ""


def trigram_counts(text: str) -> np.ndarray:
    """How often each bucket has a byte trigram of the lower-cased text."""
    raw, counts = np.frombuffer(text.lower().encode(), np.uint8), np.zeros(BUCKETS, np.int64)
    for at in range(0, raw.size - 2, STEP_BYTES):
        b = raw[at : at + STEP_BYTES + 2].astype(np.uint32)
        counts += np.bincount((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * _MULTIPLIER >> np.uint32(32 - 14), minlength=BUCKETS)
    return counts


def fit(texts: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and, for each, the log probability of each bucket; counts are added up per language."""
    known = texts.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    every = -(-known.count() // MOST_TRAINING) or 1
    chosen = known.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, k in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                counts[k] = counts.get(k, 0) + trigram_counts(t)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c.astype(np.int64).tobytes() for c in counts.values()], pa.binary())], ["lang", "counts"])

    def total(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": parts["lang"].iloc[:1], "counts": [sum(np.frombuffer(c, np.int64) for c in parts["counts"]).tobytes()]})

    kind = "lang string, counts binary"
    found = chosen.mapInArrow(partial, kind).groupBy("lang").applyInPandas(total, kind).collect()  # a row per language
    found = sorted((r["lang"], np.frombuffer(r["counts"], np.int64)) for r in found)
    if not found:
        return [], np.zeros((0, BUCKETS))
    counts = np.stack([c for _, c in found]) + 0.5
    return [k for k, _ in found], np.log(counts / counts.sum(1, keepdims=True))


def text_evidence(pages: DataFrame, languages: list[str], model: np.ndarray, markup: str) -> DataFrame:
    """Replace markup by declared and said (array<double>: log likelihoods by language, 0 without text)."""
    fields = [f for f in pages.schema.fields if f.name != markup]
    schema = T.StructType([*fields, T.StructField("declared", T.StringType()), T.StructField("said", T.ArrayType(T.DoubleType()))])
    shared = pages.sparkSession.sparkContext.broadcast(model.T.copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for batch in row_slices(whole, markup):
                declarations, said = [], []
                for page in batch.column(markup).to_pylist():
                    counts = trigram_counts(visible(page or ""))
                    said.append((counts @ table * min(1.0, EFFECTIVE / max(1, counts.sum()))).tolist())
                    declarations.append(declared(page or ""))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(declarations), pa.array(said, pa.list_(pa.float64()))], schema.names)

    return pages.mapInArrow(run, schema)


def named(url: str) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and the language code that the address names, else empty."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(text, "://([^/?#:]*)", 1))
    segment = F.lower(F.regexp_extract(text, "://[^/?#]*/([A-Za-z]{2})(?:[/?#_-]|$)", 1))
    label = F.substring_index(host, ".", -1)
    pairs = [x for pair in COUNTRIES.items() for x in map(F.lit, pair)]
    return host, F.substring_index(host, ".", -2), F.when(segment != "", segment).otherwise(F.coalesce(F.element_at(F.create_map(*pairs), label), F.lit("")))


def _posterior(logs: Column) -> Column:
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, texts: DataFrame, url: str = "url", markup: str = "html") -> DataFrame:
    """pages without markup, with declared, named, text_lang, lang, confidence."""
    languages, model = fit(texts)
    host, domain, code = named(url)
    extra = {"host", "domain", "declared", "named", "text_lang", "lang", "confidence", "said", "alone"}
    kept = [c for c in pages.columns if c.lower() not in extra and c != markup]
    rows = text_evidence(pages.select(*kept, markup).withColumns({"host": host, "domain": domain, "named": code}), languages, model, markup)
    if not languages:
        none = F.lit(None).cast("string")
        return rows.withColumns({"text_lang": none, "lang": none, "confidence": F.lit(None).cast("double")}).select(*kept, "declared", "named", "text_lang", "lang", "confidence")
    rows = stored(rows.withColumn("alone", _posterior(F.col("said"))), "language-text")
    n = len(languages)
    sums = [F.sum(F.col("alone")[k]).alias(f"_{k}") for k in range(n)]

    def counts(*key: str) -> DataFrame:
        """Expected pages by language for each value of key; partial sums are taken before the shuffle."""
        return rows.groupBy(*key).agg(*sums).select(*key, F.array(*(f"_{k}" for k in range(n))).alias("c"))

    world = rows.agg(*sums).select(F.array(*(F.coalesce(F.col(f"_{k}"), F.lit(0.0)) for k in range(n))).alias("c")).first()["c"]
    lit = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    hosts = counts("host", "domain").join(counts("domain").withColumnRenamed("c", "_of_domain"), "domain").select("host", F.col("c").alias("_of_host"), "_of_domain")
    own = F.col("alone")

    def others(c: Column) -> Column:
        """Counts without the page itself, or a host's only page would vote for what it says already."""
        return F.transform(c, lambda x, i: F.greatest(F.lit(0.0), x - F.get(own, i)))

    smooth = lambda c, above: F.transform(c, lambda x, i: (x + SMOOTH * F.get(above, i)) / (size(c) + SMOOTH))

    def worth(key: str) -> DataFrame:
        """log P(value | language) of each value of key; a value's share among all pages is its base."""
        table = counts(key)
        weight = F.lit(float(max(1.0, sum(world))))
        return table.select(key, F.transform("c", lambda x, i: F.log((x + SMOOTH * size(F.col("c")) / weight) / (F.get(lit(world), i) + SMOOTH))).alias(f"{key}_worth"))

    joined = rows.join(hosts, "host", "left").join(worth("declared"), "declared", "left").join(worth("named"), "named", "left")
    joined = joined.withColumn("_world", F.transform(others(lit(world)), lambda x: (x + 1.0) / (size(others(lit(world))) + n)))
    joined = joined.withColumn("_domain_prior", smooth(others(F.col("_of_domain")), F.col("_world")))
    joined = joined.withColumn("_host_prior", smooth(others(F.col("_of_host")), F.col("_domain_prior")))
    logs = F.transform("said", lambda x, i: x + F.log(F.get("_host_prior", i)) + F.get("declared_worth", i) + F.get("named_worth", i))
    judged = joined.withColumn("_p", _posterior(logs))
    names = F.array(*map(F.lit, languages))
    best = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    spoken = F.exists("said", lambda x: x != 0)
    return judged.select(*kept, "declared", "named", F.when(spoken, best(F.col("alone"))).alias("text_lang"), best(F.col("_p")).alias("lang"), F.array_max("_p").alias("confidence"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return identify(pages, read(spark, sf_dir, "documents").select("text", "lang")).drop("url")
