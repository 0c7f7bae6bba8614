"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from opsloom.llm import bpe, bytewords, components, gif, jaccard, language, lines, mixing, neighbours, quality, secrets, urls
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33),
    (1, "one two three four five six seven", "en", "a", 33),
    (2, "one two three four five six seven", "en", None, 33),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (None, "one two three four five six seven", "en", "b", 33),
    (5, "  \t\n ", "de", "b", 5),
    (6, "short", "de", "c", 5),
    (7, LONG, "en", "c", len(LONG)),
    (8, LONG.replace("word7x7 ", ""), "en", "c", len(LONG)),
    (9, "é" * 50 + " 🔄   <|endoftext|>", "fr", "a", 60),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    names = ("size", "before", "taken", "target", "score", "ids", "secrets", "media", "n_bytes", "frames", "samples", "fault", "n_lines", "n_removed", "bucket", "rank", "component")
    return docs.withColumns({n: F.lit("x") for n in names})


LABELS = "doc_id long, quality int, toxic int"


def test_secrets(docs, none, clashing):
    assert secrets.find_secrets(docs).count() == len(ROWS) and secrets.find_secrets(none).count() == 0
    assert dict(secrets.find_secrets(clashing).dtypes)["secrets"].startswith("array")
    cases = {
        "password: hunter2": [(0, 17, "assign")],
        "Token=abc token='abcdef'": [(10, 23, "assign")],
        "AKIA" + "A1" * 8: [(0, 20, "access")],
        "AKIA" + "A1" * 7: [],
        "x" + "0a" * 12: [(1, 25, "hex")],
        "Zx8kQ92mmPq0TTyu1 alone": [],
        "client_id = bob7 then Zx8kQ92mmPq0TTyu1": [(0, 16, "identity"), (22, 39, "linked")],
        "client_id = bob7\n\nZx8kQ92mmPq0TTyu1": [],
        "client_id = bob7" + " " * 300 + "Zx8kQ92mmPq0TTyu1": [],
        "ſecret: abcdefgh": [],
    }
    assert {t: secrets.scan(t) for t in cases} == cases


def test_urls(spark):
    rows = [(1, None), (1, None), (2, "no scheme"), (3, "http://A.Example.com/en/x?y=1#z"), (4, "https://"), (5, "http://x.net/es/\nline"), (6, "http://" + "a" * 20_000 + ".org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    found = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert (found[1]["host"], found[1]["path"], found[1]["rule"], found[1]["verdict"]) == ("", "", None, "allow")
    assert (found[3]["host"], found[3]["path"], found[3]["rule"], found[3]["verdict"]) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert found[5]["rule"] == "net/es/" and urls.judge(pages).count() == len(rows)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_learn_from_labels(spark):
    rows = [(f"http://{'bad-' * (i % 2)}host{i}.example/{i}", i % 2) for i in range(400)]
    labels = spark.createDataFrame(rows, "url string, blocked int")
    pages = spark.createDataFrame([(1, "http://bad-host999.example/3"), (2, "http://host998.example/3")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels=labels).collect()} == {1: "block", 2: "allow"}


def test_gif_operators(docs, none, clashing):
    for table in (docs, clashing):
        rows = gif.media_columns(gif.store_texts(table)).collect()
        for r, own in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(ROWS, key=lambda r: (r[0] is None, r[0])), strict=True):
            assert r["samples"].rstrip(b" ") == (own[1] or "").encode().rstrip(b" ") and len(r["samples"]) % 192 == 0
            assert sum(f["height"] for f in r["frames"]) * 192 == len(r["samples"]) > 0
            assert [f["shown_cs"] for f in r["frames"]] == [10 * k for k in range(len(r["frames"]))]
    assert gif.media_columns(gif.store_texts(none)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 4))
def test_lzw_round_trip(data, times):
    data = data * times
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_lzw_deferred_clear():
    """A full table without a clear stays at 12 bits."""
    rng = random.Random(4)
    data = bytes(rng.randrange(256) for _ in range(6000))
    codes, table, prefix = [256], {bytes([i]): i for i in range(256)}, b""
    following = 258
    for b in data:
        if prefix + bytes([b]) in table:
            prefix += bytes([b])
            continue
        codes.append(table[prefix])
        if following < 4096:
            table[prefix + bytes([b])] = following
            following += 1
        prefix = bytes([b])
    codes += [table[prefix], 257]
    bits, known, width = [], 258, 9
    for k, c in enumerate(codes):
        bits += [(c >> i) & 1 for i in range(width)]
        known += k >= 2
        width = min(12, max(9, known.bit_length()))
    stream = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    assert gif.lzw_decode(stream, 8, len(data)) == data


def test_gif_known_image():
    """A published example: ten by ten, four colours."""
    code = bytes.fromhex("8C2D99872A1CDC33A00275EC95FAA8DE608C04914C01")
    assert gif.lzw_decode(code, 2, 100)[:12] == bytes([1] * 5 + [2] * 5 + [1, 1])


@pytest.mark.parametrize("disposal,after", [(1, 5), (2, 0), (3, 3)])
def test_gif_disposal_and_transparency(disposal, after):
    palette = bytes(i for i in range(256) for _ in range(3))

    def frame(index, size, dispose, clear=None):
        body = gif.lzw_encode(bytes([index] * (size * size)))
        control = bytes([dispose << 2 | (clear is not None), 7, 0, clear or 0])
        return b"\x21\xf9\x04" + control + b"\0\x2c\0\0\0\0" + bytes([size, 0, size, 0, 0]) + b"\x08" + bytes([len(body)]) + body + b"\0"

    data = b"GIF89a\4\0\4\0\xf7\0\0" + palette + frame(3, 4, 1) + frame(5, 2, disposal) + frame(9, 4, 1, clear=9) + b"\x3b"
    frames = list(gif.read_gif(data))
    assert [f.delay_cs for f in frames] == [7, 7, 7]
    assert frames[1].canvas[0, 0, 0] == 5 and frames[1].canvas[3, 3, 0] == 3
    assert frames[2].canvas[0, 0, 0] == after and frames[2].canvas[3, 3, 0] == 3
    assert frames[0].histogram().sum() == 16


def test_jaccard(docs, none, clashing):
    for table in (docs, clashing):
        rows = jaccard.jaccard_components(table).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in rows) == sorted(
            (str(i), len(brute.shingles(t, 5)), {2: 1, 8: 7, None: 1}.get(i, i)) for i, t, *_ in ROWS
        )
    assert jaccard.jaccard_components(none).count() == 0


@pytest.mark.parametrize("segment,crowded", [(50, 2), (50, 0.2), (400, 0.5), (2_000_000, 2)])
def test_jaccard_groups_that_barely_link(spark, segment, crowded, monkeypatch):
    """Chains, stars and near misses, also with classes cut into segments, and these into blocks."""
    monkeypatch.setattr(jaccard, "SEGMENT_SHINGLES", segment)
    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    rng, rows = random.Random(7), []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(rng.choice([12, 60, 150]))]
        for _ in range(30):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    rows += ["the same passage of some length that many share " + " ".join(f"u{k}x{j}" for j in range(8)) for k in range(20)]
    rows += [" ".join(f"c{j}" for j in range(k, k + 60)) for k in range(0, 40, 2)]
    rows += ["a b", "A  b", "a", "b c d e"]
    table = list(enumerate(rows))
    rng.shuffle(table)
    for n, percent in ((4, 85), (5, 80)):
        found = jaccard.jaccard_components(spark.createDataFrame(table, "doc_id long, text string"), n=n, percent=percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.components(table, n, percent)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), max_size=120), min_size=1, max_size=12), st.integers(1, 8))
def test_divide_skip(lists, least):
    lists = [np.unique(np.array(x, np.int64)) for x in lists]
    counts = np.bincount(np.concatenate(lists), minlength=401)
    assert np.array_equal(np.sort(jaccard.divide_skip(lists, least)), np.flatnonzero(counts >= least))


def test_words_are_those_of_the_contract():
    texts = ["Ab  cd", "", None, " x\ty\x0b AB \x1c z q ", "É"]
    w = bytewords.words_of(texts)
    assert np.diff(w.first).tolist() == [len((t or "").encode().split()) for t in texts]
    h = w.hashes()
    assert h[0] == h[4] and len(set(h.tolist())) == len(h) - 1


def test_connected(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7), (200, None)]
    found = {r["id"]: r["component"] for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p if x is not None}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in pairs:
        if b is not None and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert found == {x: root(x) for a, b in pairs if b is not None and a != b for x in (a, b)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(spark, docs, none, clashing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)] + [(1, None, 0), (None, 1, 0)], LABELS)
    for table in (docs, clashing):
        rows = quality.score_quality(table, labels).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert quality.score_quality(none, labels).count() == 0
    assert {r["score"] for r in quality.score_quality(docs, spark.createDataFrame([], LABELS)).collect()} == {1.0}


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 7), 0.5]) for i in range(60)] + [(60, None), (80, [0.0, 0.0, 0.0]), (100, [nan, 1.0, 1.0]), (120, [inf, 1.0, 1.0]), (140, [None, 1.0, 1.0]), (160, []), (180, [1.0]), (None, [1.0, 1.0, 1.0]), (20, [1.0, 6.0, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=5).collect()
    assert {r["query_id"] for r in found} == {0, 20, 40}
    for q in (0, 40):
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["score"] for r in own] == sorted((r["score"] for r in own), reverse=True)
        assert all(a["vec_id"] < b["vec_id"] for a, b in zip(own, own[1:], strict=False) if a["score"] == b["score"])
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert neighbours.nearest(few, F.col("vec_id") == 0, k=5).count() == 2
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).count() == 0


def test_many_copies_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_VALUES", 150)
    rows = [(i, [0.1, 0.2, 0.3] if i % 3 else [float(i % 5), 1.0, 0.3]) for i in range(600)]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=20).toPandas()
    for q, own in found.groupby("query_id"):
        score = {i: sum(a * b for a, b in zip(v, rows[q][1], strict=True)) for i, v in rows if i != q}
        assert own.sort_values("rank").vec_id.tolist() == sorted(score, key=lambda i: (-round(score[i], 9), i))[:20]


def test_balanced_parts():
    x = np.random.default_rng(0).normal(size=(500, 8))
    sizes = np.bincount(neighbours.balanced_parts(neighbours.neighbour_graph(x), 8))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 4


def test_lines(spark, docs, none, clashing):
    assert lines.dedup_lines(docs).count() == len(ROWS) and lines.dedup_lines(none).count() == 0
    assert lines.dedup_lines(clashing).count() == len(ROWS)
    shared = "a line that is long enough to count"
    rows = [(i, f"{shared}\nown line number {i} of this text\n{shared}", f"s{i}") for i in range(7)] + [(7, "short\nx", "s0"), (8, None, "s1"), (9, "", None)]
    found = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found[0]["text"] == rows[0][1] and found[3]["text"] == "own line number 3 of this text"
    assert [found[i]["n_removed"] for i in range(10)] == [0, 2, 2, 2, 2, 2, 2, 0, 0, 0]
    assert found[8]["text"] is None and found[9]["n_lines"] == 1
    fewer = lines.dedup_lines(spark.createDataFrame(rows[:5], "doc_id long, text string, source string"))
    assert fewer.filter("n_removed > 0").count() == 0


def test_bpe(docs, none, clashing):
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    for table in (docs, clashing):
        encoded = bpe.encode(table, offsets=True)
        for r in bpe.decode(encoded).unionByName(bpe.encode(table, offsets=True, decoded=True)).collect():
            t = r["text"] or ""
            assert r["ids"] == own.encode_ordinary(t) and r["decoded"].decode() == t
            assert len(r["char_start"]) == len(r["ids"]) and all(a < b for a, b in zip(r["char_start"], r["char_end"], strict=True))
            covered = {k for a, b in zip(r["char_start"][:500], r["char_end"][:500], strict=True) for k in range(a, b)}
            assert covered == set(range(len(covered)))
    assert bpe.decode(bpe.encode(none)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(blacklist_categories=["Cs"]), max_size=40))
def test_bpe_any_text(text):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(bpe.RANKS)
    global OWN
    if "OWN" not in globals():
        OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    ids = bpe._built(path).encode(text).tolist()
    assert ids == OWN.encode_ordinary(text) and bpe.decode_ids(ids, bpe.token_table(path)) == text.encode()


def library_offsets(texts):
    """What the library itself says of offsets, with its own splitting and byte mapping."""
    import public_tokenizers
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    built = bpe._built(public_tokenizers.path(bpe.RANKS))
    whole = Tokenizer(built.model)
    split = pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated")
    whole.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return [whole.encode(t, add_special_tokens=False) for t in texts]


def test_bpe_offsets_are_the_library_s(docs):
    import public_tokenizers

    built = bpe._built(public_tokenizers.path(bpe.RANKS))
    texts = [r[1] for r in ROWS if r[1]] + ["日本語のテキスト 🤷🏽‍♀️ zażółć", "a\u0301 é ñ", "  two  spaces \n\n x"]
    for text, said in zip(texts, library_offsets(texts), strict=True):
        ids = built.encode(text)
        assert said.ids == ids.tolist()
        assert [tuple(map(int, s)) for s in zip(*built.char_spans(text, ids), strict=True)] == said.offsets


def test_byte_table_is_reversed():
    back = bpe.char_bytes()
    assert sorted(back.values()) == list(range(256)) and all(back[c] == b for b, c in bpe.byte_chars().items())
    import public_tokenizers

    path = public_tokenizers.path(bpe.RANKS)
    assert all(bpe.token_table(path)[i] == token for token, i in bpe.read_ranks(path).items())
    halves = bpe._built(path).encode("🤷").tolist()
    assert len(halves) > 1 and bpe.decode_ids(halves, bpe.token_table(path)).decode() == "🤷"


def plain_targets(sizes):
    """Reshare what is above the caps until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)


def plain_queue(rows, wanted, repeats=2):
    """Taken words of each row by sorting all packets of all copies."""
    order = sorted(rows, key=lambda r: (int(hashlib.md5(f"{'' if r[0] is None else r[0]}:mix".encode()).hexdigest()[:8], 16), r[0] or 0, len(r[1].split())))
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    before, packets = dict.fromkeys(names, 0), []
    size = {s: sum(len(t.split()) for _, t, o in rows if o == s) for s in names}
    for i, t, s in order:
        n, packet = len(t.split()), max(1, int(wanted[s] // 1000))
        for copy in range(repeats):
            for k in range(0, n, packet):
                begun, words = before[s] + copy * size[s] + k, min(packet, n - k)
                packets.append(((begun + words) / wanted[s], names.index(s), begun, words, i))
        before[s] += n
    taken, left = dict.fromkeys((i for i, *_ in rows), 0), int(1.5 * sum(size.values()))
    for *_, words, i in sorted(packets):
        taken[i] += min(words, left)
        left -= min(words, left)
    return taken


@pytest.mark.parametrize("rows_per_range", [5000, 40])
def test_mixing(spark, docs, none, clashing, monkeypatch, rows_per_range):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", rows_per_range)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "ä", "c", None])) for i in range(300)] + [(i, "x " * 5, "big") for i in range(300, 700)] + [(700, "y " * 9000, "long")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = mixing.schedule(*mixing.measured(table)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    wanted = plain_targets(sizes)
    for s, n in sizes.items():
        own = [r for r in plan if r["source"] == s]
        assert own[0]["source_size"] == n and own[0]["target"] == pytest.approx(wanted[s])
        assert abs(sum(r["taken"] for r in own) - wanted[s]) <= 2 + wanted[s] / 500
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    assert sum(r["taken"] for r in plan) == int(1.5 * sum(sizes.values()))
    assert {r["doc_id"]: r["taken"] for r in plan} == plain_queue(rows, {r["source"]: r["target"] for r in plan})
    for table_ in (docs, none, clashing):
        assert mixing.schedule(*mixing.measured(table_)).count() == table_.count()
    assert mixing.mix(none).count() == 0
    order = [r["finish"] for r in mixing.mix(table).collect()]
    assert order == sorted(order)


def test_mixing_where_many_sources_finish_together(spark, monkeypatch):
    """One document a source, all capped: all finish at virtual time 1, where the budget ends."""
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 200)
    seen, in_order = [], mixing._in_order
    monkeypatch.setattr(mixing, "_in_order", lambda packets, blocks: seen.append(in_order(packets, blocks)) or seen[-1])
    rows = [(i, "w " * 30, f"host{i}") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.schedule(*mixing.measured(table)).collect()
    assert {r["doc_id"]: r["taken"] for r in plan} == plain_queue(rows, {r["source"]: r["target"] for r in plan})
    sizes = [r["count"] for r in seen[0].groupBy("_block").count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * 200


def test_language(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang")
    rows = [(1, None, None), (1, None, None), (2, "http://x.de/", ""), (3, "http://x.org/fr/1", "<html lang='FR'><script>the and</script><p>"), (4, "bad", "<p>" + LONG + "</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("clash"))
    found = {r["page_id"]: r for r in language.identify(pages, texts).collect()}
    assert len(found) == 4 and found[3]["declared"] == "fr" and found[3]["named"] == "fr" and found[2]["named"] == "de"
    assert found[1]["text_lang"] is None and found[1]["lang"] is not None
    assert language.identify(pages.limit(0), texts).count() == 0
    assert language.identify(pages, texts.limit(0)).filter("lang is not null").count() == 0
    assert language.visible("<p>a<!-- x --><style>b</style>&amp;c</p>").split() == ["a", "&c"]


def test_pipeline_stages(spark, docs, none, sf):
    extra = docs.withColumns({"size": F.lit(1), "score": F.lit("x"), "ids": F.lit(2)})
    for table in (docs, none, extra):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, table, sf)
            rows.count()
            if stage is not corpus_pipeline.to_tokens:
                assert rows.columns == table.columns
    assert corpus_pipeline.keep_one_of_each_group(spark, docs, sf).filter("doc_id = 1").count() == 1
