"""Language identification against the same fusion in plain Python, and text alone on documents kept from fitting."""

import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from opsloom.llm import language


def said_of(page, model):
    counts = language.trigram_counts(language.visible(page or ""))
    return [float(x) for x in model @ counts * min(1.0, language.EFFECTIVE / max(1, counts.sum()))]


def posterior(logs):
    top = max(logs)
    weights = [math.exp(x - top) for x in logs]
    return [w / sum(weights) for w in weights]


def fused(pages, languages, model):
    """page_id -> (language, confidence)."""
    n, rows = len(languages), []
    for i, url, page in pages:
        host = (re.search("://([^/?#:]*)", url or "") or [None, ""])[1].lower()
        segment = (re.search("://[^/?#]*/([A-Za-z]{2})(?:[/?#_-]|$)", url or "") or [None, ""])[1].lower()
        named = segment or language.COUNTRIES.get(host.split(".")[-1], "")
        said = said_of(page, model)
        rows.append((i, host, ".".join(host.split(".")[-2:]), named, language.declared(page or ""), said, posterior(said)))
    counts = [defaultdict(lambda: [0.0] * n) for _ in range(4)]
    world = [0.0] * n
    for _, host, domain, named, declared, _, alone in rows:
        world = [a + b for a, b in zip(world, alone, strict=True)]
        for table, key in zip(counts, (host, domain, named, declared), strict=True):
            table[key] = [a + b for a, b in zip(table[key], alone, strict=True)]
    smooth = lambda c, above: [(x + language.SMOOTH * a) / (sum(c) + language.SMOOTH) for x, a in zip(c, above, strict=True)]
    out = {}
    for i, host, domain, named, declared, said, alone in rows:
        others = lambda c: [max(0.0, x - a) for x, a in zip(c, alone, strict=True)]  # noqa: B023, E731
        all_others = others(world)
        prior = [(x + 1) / (sum(all_others) + n) for x in all_others]
        prior = smooth(others(counts[0][host]), smooth(others(counts[1][domain]), prior))
        logs = [s + math.log(p) for s, p in zip(said, prior, strict=True)]
        for table, key in ((counts[2], named), (counts[3], declared)):
            share = sum(table[key]) / max(1.0, sum(world))
            logs = [x + math.log((c + language.SMOOTH * share) / (w + language.SMOOTH)) for x, c, w in zip(logs, table[key], world, strict=True)]
        p = posterior(logs)
        out[i] = (languages[p.index(max(p))], max(p))
    return out


def test_fusion(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    odd = [(900, None, None), (901, "http://x.de/", ""), (902, "http://only.example.fr/es/", "<html lang=zz><p>the the</p>"), (903, "nothing", "<p>und der die das</p>")]
    pages = pages.unionByName(spark.createDataFrame(odd, pages.schema))
    languages, model = language.fit(texts)
    wanted = fused([tuple(r) for r in pages.collect()], languages, model)
    found = {r["page_id"]: (r["lang"], r["confidence"]) for r in language.identify(pages, texts).collect()}
    assert found.keys() == wanted.keys()
    for i, (lang, confidence) in found.items():
        assert lang == wanted[i][0] and math.isclose(confidence, wanted[i][1], rel_tol=1e-6), i


def test_a_page_doesn_t_vote_for_itself(spark, sf):
    """Of a host with one page the prior is what the other pages say, whatever its own text."""
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang")
    languages, model = language.fit(texts)
    words = {k: texts.filter(F.col("lang") == k).first()["text"][:60].replace("<", " ") for k in languages}
    rows = [(k, f"http://h{k}.example/x", f"<p>{words[name]}</p>") for k, name in enumerate(languages * 3)]
    rows += [(99, "http://alone.example/x", f"<p>{words[languages[0]]}</p>")]
    schema = "page_id long, url string, html string"
    found = {r["page_id"]: r for r in language.identify(spark.createDataFrame(rows, schema), texts).collect()}
    wanted = fused(rows, languages, model)
    assert all(math.isclose(found[i]["confidence"], c, rel_tol=1e-6) for i, (_, c) in wanted.items())
    repeated = language.identify(spark.createDataFrame(rows + rows[:1], schema), texts).filter("page_id = 0").select("lang", "confidence")
    assert repeated.count() == 2 and repeated.distinct().count() == 1


def test_text_alone_on_documents_kept_from_fitting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    fold = F.pmod(F.xxhash64("text"), F.lit(4))
    languages, model = language.fit(docs.filter(fold > 0))
    held = [r for r in docs.filter(fold == 0).collect() if len(r["text"]) > 100]
    right = sum(languages[int(np.argmax(said_of(r["text"].replace("<", " "), model)))] == r["lang"] for r in held)
    assert len(held) > 100 and right / len(held) > 0.95
