"""Registered queries of the subpackage: those with SQL against it, the others against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from opsloom.llm import bpe, jaccard, neighbours, registry
from tests.llm.brute import components, documents


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_its_sql(name, spark, sf, duck, same):
    same(registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df())


def test_secrets_base(spark, sf):
    kinds = ("assign", "access", "hex")
    for r in registry.QUERIES["op2_secret_links"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        t, found = r["text"], []
        for m in re.finditer(r"(?a:(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", t):
            found += [(m.start(), 0, m.end())] if len(m[1]) >= 6 else []
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        said = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in found) for i in range(3)]


def test_url_rules(spark, sf):
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    for r in registry.QUERIES["op3_url_filter"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"), "page_id").collect():
        rest = r["url"].partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fit = [k for k in rules if (f".{host}").endswith("." + k.partition("/")[0]) and path.startswith("/" + k.partition("/")[2])]
        best = max(fit, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host.lower(), path, best)
        assert r["verdict"] == rules[best] if best else r["verdict"] in ("allow", "block")


def test_gif_payloads(spark, sf):
    texts = dict(documents(spark, sf))
    rows = registry.QUERIES["op4_gif_media"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, sf, n, percent):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs.select("doc_id", "text"), n=n, percent=percent).collect()}
    assert found == components(documents(spark, sf), n, percent)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = registry.QUERIES["op6_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = scored[scored.held_out]
    assert set(held.doc_id) == {d for d in scored.doc_id if zlib.crc32(str(d).encode()) % 5 == 0}
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.95
    assert (held.predicted == held.quality).mean() > 0.95
    assert scored.score.between(0, 1).all()


def test_neighbour_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(np.float64)
    found = neighbours.op7_neighbours(spark, sf).toPandas().sort_values(["query_id", "rank"])
    hits = 0
    for q, own in found.groupby("query_id"):
        i = int(np.flatnonzero(ids == q)[0])
        score = (x * x[i]).sum(1)
        assert np.array_equal(own.score.to_numpy(), score[np.searchsorted(ids, own.vec_id)])
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        score[i] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & set(own.vec_id))
    assert found.query_id.nunique() == (ids % 20 == 0).sum()
    assert hits / len(found) >= 0.9


def test_bpe_is_what_tiktoken_says(spark, sf):
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    texts = dict(documents(spark, sf))
    for r in registry.QUERIES["op9_byte_bpe"](spark, sf).collect():
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        place = [k for k, c in enumerate(texts[r["doc_id"]]) for _ in c.encode()]
        ends = np.cumsum([len(own.decode_single_token_bytes(i)) for i in ids]).tolist()
        starts = [place[e] for e in [0, *ends[:-1]]] if ids else []
        said = " ".join(map(str, starts)) + "," + " ".join(str(place[e - 1] + 1) for e in ends)
        assert r["offsets_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_languages_of_pages(spark, sf):
    rows = registry.QUERIES["op1_language"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count() and all(r["lang"] for r in rows)


def without_boilerplate(rows):
    """doc_id -> text without lines of 20 characters or more that six sites have, but for the first document's."""
    sites, keeper = {}, {}
    for d, source, text in rows:
        for line in text.split("\n"):
            if len(line) >= 20:
                sites.setdefault(line, set()).add(source)
                keeper[line] = min(d, keeper.get(line, d))
    gone = lambda d, line: len(sites.get(line, ())) >= 6 and keeper[line] != d
    return {d: "\n".join(line for line in text.split("\n") if not gone(d, line)) for d, _, text in rows}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, rows = docs.toPandas(), stage(spark, docs, sf)
        after = rows.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == docs.columns
        if name == "quality classifier":
            score = {r["doc_id"]: r["score"] for r in registry.QUERIES["op6_quality"](spark, sf).collect()}
            assert sorted(after.doc_id) == sorted(d for d in before.doc_id if score[d] >= 0.3)
            known = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
            good = set(known.doc_id[known.quality == 1]) & set(before.doc_id)
            assert len(good & set(after.doc_id)) >= 0.95 * len(good)
        if name == "line dedup":
            wanted = without_boilerplate(list(zip(before.doc_id, before.source, before.text, strict=True)))
            assert dict(zip(after.doc_id, after.text, strict=True)) == {d: t for d, t in wanted.items() if t.strip() or t == dict(zip(before.doc_id, before.text, strict=True))[d]}
            assert (after.n_chars == after.text.str.len()).all()
        if name == "n-gram Jaccard join":
            wanted = components(list(zip(before.doc_id, before.text, strict=True)), 5, 80)
            assert sorted(after.doc_id) == sorted({c for _, c in wanted.values()})
        if name == "mixing sources to target weights":
            assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.value_counts().max() <= 2
        docs = spark.createDataFrame(after, docs.schema) if rows.columns == docs.columns else rows
    decoded = {r["doc_id"]: r["decoded_sha256"] for r in docs.collect()}
    assert decoded == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in zip(before.doc_id, before.text, strict=True)}
    assert corpus_pipeline.run(spark, sf).count() == len(after)
