"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Each text's set holds 64-bit hashes of its distinct n-word shingles (words lower-cased in A-Z). Texts
link when intersection * 100 >= percent * union; the join gives every document its set's size and the
smallest id that it reaches by links.

How a link is found. All sets share one order of shingles: frequent ones (counted over all texts) last,
else by hash. For a set x, let need(x) = ceil(percent * |x| / 100), the least overlap of a link. Any two
linked sets share at least slack shingles among their first |x| - need(x) + slack; these heads are the
short inverted lists, and what is left of a set are its long ones. Sets of like size form a class, such
that partners are in the same class or the next smaller one; a class with many sets is cut, by shingle
hash, into segments, some of which has its share of the slack. A segment that holds much more than others,
as one does whose list is of a shingle that a great many sets have, is cut by set as well: its rows are dealt
to blocks, and each pair of blocks is searched by a task of its own. In each segment DivideSkip runs for each
set: the longest of its lists are set aside, the others heap-merged, and candidates that occur often
enough are probed in the long lists by binary search. A candidate must also have a fitting size and pass
a bound on the overlap by parity bitmaps, which never refuses a link. Last, the rest of a set is probed,
by binary search again, in the candidate's whole set.

Nothing emits all pairs of a group of copies, or of texts that are nearly linked. One row stands for all with an
equal set, the one of the smallest id; only it has a head and is searched for, and the others get its component. Of
a set with more than FEW candidates only the closest is checked first. Where candidates in other components are left,
the whole sets of both are brought to the segment's task, once each, and checked there; only links leave
it. Only components matter, so a pair within one is never checked.

Null and empty texts have empty sets and link with nothing, not even one another. Rows that repeat an
id are one document if their texts have equal sets; otherwise the id's links are those of all its
texts. A row without id takes part in no link; its component is that of a row with an id and an equal
set, else null. A text is held by one task alone; a very long one is hashed in pieces, and then takes some
50 bytes for each of its words. Empty tables give empty tables.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.bytewords import groups, mixed, words_of
from opsloom.llm.common import read, row_slices, stored
from opsloom.llm.components import connected

_U = np.uint64
#: Texts are cut into shingles about so many bytes at a time.
_STEP = 1 << 19
#: A shingle counts as frequent from this many texts on of those that hold COUNTED shingles together; the
#: most frequent of all are remembered. This bears on speed alone.
COUNTED = 1_000_000
FREQUENT = 8
MOST_FREQUENT = 200_000
#: Head shingles that one segment's inverted lists hold, about.
SEGMENT_SHINGLES = 1_000_000
#: A segment of more than this many times as much is cut into blocks of sets.
CROWDED = 2
#: So many candidates of a set are all checked at once.
FEW = 3
#: Ids that are broadcast to read their texts again; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than n words, the whole text's as one."""
    hashes, first = [], np.zeros(len(texts) + 1, np.int64)
    for owners, held in groups(texts, _STEP):
        w = words_of(held)
        hashes.append(w.hashes())
        np.add.at(first, np.array(owners) + 1, np.diff(w.first))
    h, first = np.concatenate(hashes) if hashes else np.zeros(0, _U), np.cumsum(first)
    grams = np.zeros(max(0, h.size - n + 1), _U)
    with np.errstate(over="ignore"):
        for k in range(n):
            grams += h[k : h.size - n + 1 + k] * _U(0x9E3779B97F4A7C15 + 2 * k * 0x1D8E4E27C47D124F & (1 << 64) - 1 | 1)
    grams = mixed(grams)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            sets.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            short = _U(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    short = mixed(np.array([short * _U(0x9E3779B97F4A7C15) + x]))[0]
            sets.append(np.array([short], _U))
        else:
            sets.append(np.zeros(0, _U))
    return sets


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce(s).view(np.int64)), int(mixed(s * _U(0xD6E8FEB86659FD93)).sum(dtype=_U).view(np.int64))


def need(size, percent: int):
    """The least overlap with any set that links to one of this size."""
    return -(-percent * size // 100)


def slack(size):
    """How many shingles linked heads must share; more make longer heads and fewer candidates."""
    return 1 + size // 20


def linked(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap) and overlap > 0


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of shingles that fall on each bit. Two bitmaps differ in at most as many bits
    as their sets differ in shingles."""
    hits = np.bincount((tokens >> _U(20) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(hits.astype(np.uint8)).view(np.uint64)


def bitmap_bits(size: int) -> int:
    return 1 << max(6, min(16, max(1, 2 * size - 1).bit_length()))


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of `words` 64-bit words out of a larger one; parities add up."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def divide_skip(lists: list[np.ndarray], least: int) -> np.ndarray:
    """Members of at least `least` of these sorted lists of distinct numbers, sorted. The longest lists
    are probed by binary search; the others are merged by heap, or by sorting where they are long."""
    if least <= 1:
        return np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < least:
        return np.zeros(0, np.int64)
    aside = min(least - 1, max(0, int(least / (0.1 * math.log2(len(lists[-1]) + 1) + 1))))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    if sum(map(len, short)) <= 256:
        found, counts, last = [], [], None
        for x in heapq.merge(*(s.tolist() for s in short)):
            if x == last:
                counts[-1] += 1
            else:
                found.append(x)
                counts.append(1)
                last = x
        kinds, count = np.array(found, np.int64), np.array(counts, np.int64)
    else:
        kinds, count = np.unique(np.concatenate(short), return_counts=True)
    for i, probed in enumerate(long):
        still = count + len(long) - i >= least
        kinds, count = kinds[still], count[still]
        at = np.minimum(np.searchsorted(probed, kinds), len(probed) - 1)
        count = count + (probed[at] == kinds)
    return kinds[count >= least]


def size_classes(percent: int) -> np.ndarray:
    """Least size of each class: a set's partners that aren't larger are in its class or the one before."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(max(least[-1] + 1, (least[-1] - 1) * 100 // percent + 1))
    return np.array(least)


class _Segment:
    """The inverted lists of one segment of a class, and searches in them by the sets of this class and the
    next larger one."""

    def __init__(self, rows: pa.Table, percent: int):
        # by size, then signature, then id: a set looks for partners among those before it
        rows = rows.sort_by([(c, "ascending") for c in ("size", "s1", "s2", "doc_id")])
        s1, s2 = (rows.column(c).to_numpy() for c in ("s1", "s2"))
        self.rows = rows = rows.take(np.flatnonzero(np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])))
        self.percent, self.size, self.bits = percent, rows.column("size").to_numpy(), rows.column("bits").to_pylist()
        # a task for two blocks looks for pairs between them alone
        self.block = rows.column("block").to_numpy() if rows.column("low")[0].as_py() != rows.column("high")[0].as_py() else None
        self.indexed = pc.sum(pc.invert(rows.column("larger"))).as_py()
        heads = [np.frombuffer(t, np.uint32) for t in rows.column("tokens").to_pylist()]
        counts = np.array([h.size for h in heads], np.int64)
        tokens = np.concatenate(heads)
        order = np.argsort(tokens, kind="stable").astype(np.int32)
        tokens = tokens[order]
        self.begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.many = np.diff(self.begin, append=tokens.size)
        self.postings = np.repeat(np.arange(rows.num_rows, dtype=np.int32), counts)[order]
        self.list_of = np.empty(tokens.size, np.int32)
        self.list_of[order] = np.repeat(np.arange(self.begin.size, dtype=np.int32), self.many)
        self.first = np.concatenate([[0], np.cumsum(counts)])

    def searches(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(set, its candidates before it, in how many bits they differ)."""
        lowest = np.searchsorted(self.size, need(self.size, self.percent))
        head = self.size - need(self.size, self.percent) + slack(self.size)
        shares = slack(need(self.size, self.percent))
        useful = np.concatenate([[0], np.cumsum(self.many[self.list_of] > 1)])
        useful = useful[self.first[1:]] - useful[self.first[:-1]]
        # a segment's share of the slack is that of the head it has
        own = np.diff(self.first)
        least = np.maximum(1, -(-own * shares // head))
        for i in np.flatnonzero(useful >= least).tolist():
            below, lists = min(i, self.indexed), []
            for k in self.list_of[self.first[i] : self.first[i + 1]].tolist():
                if self.many[k] > 1:
                    post = self.postings[self.begin[k] : self.begin[k] + self.many[k]]
                    a, b = np.searchsorted(post, (lowest[i], below))
                    if a < b:
                        lists.append(post[a:b])
            if len(lists) < least[i]:
                continue
            found = divide_skip(lists, int(least[i]))
            if self.block is not None:
                found = found[self.block[found] != self.block[i]]
            if found.size:
                both = self.size[i] + self.size[found]
                apart = self._apart(i, found)
                # sets differ in |x| + |y| - 2 * overlap, and a link overlaps in percent / (100 + percent) of the sum
                fits = apart <= both - 2 * -(-self.percent * both // (100 + self.percent))
                if fits.any():
                    yield i, found[fits], apart[fits]

    def _apart(self, i: int, others: np.ndarray) -> np.ndarray:
        mine, out = np.frombuffer(self.bits[i], np.uint64), np.empty(others.size, np.int64)
        length = np.array([len(self.bits[j]) for j in others.tolist()]) // 8
        for words in np.unique(length).tolist():
            at = np.flatnonzero(length == words)
            theirs = np.frombuffer(b"".join(self.bits[j] for j in others[at].tolist()), np.uint64)
            small = min(words, mine.size)
            theirs = np.bitwise_xor.reduce(theirs.reshape(at.size, -1, small), axis=1)
            out[at] = np.bitwise_count(theirs ^ folded(mine, small)).sum(1)
        return out


def _first_pairs(rows: pa.Table, percent: int) -> pa.Table:
    """Candidate pairs (a, b) of one segment: all of a set if they are few, else the closest; and sets (a, null) with
    others left."""
    segment = _Segment(rows, percent)
    ids = segment.rows.column("doc_id").combine_chunks()
    a, b, unfinished = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(ids), bool)
    for i, found, apart in segment.searches():
        chosen = found
        if found.size > FEW:
            chosen = found[[apart.argmin()]]
            unfinished[i] = unfinished[found] = True
        a.append(np.full(chosen.size, i))
        b.append(chosen)
    still = np.flatnonzero(unfinished)
    first = ids.take(pa.array(np.concatenate([*a, still])))
    second = pa.concat_arrays([ids.take(pa.array(np.concatenate(b))), pa.nulls(still.size, ids.type)])
    return pa.table([first, second], ["a", "b"])


def _across(segment: _Segment) -> Iterator[tuple[int, np.ndarray]]:
    """(set, its candidates in other components)."""
    component = pc.rank(segment.rows.column("component"), tiebreaker="dense").to_numpy()
    for i, found, _ in segment.searches():
        found = found[component[found] != component[i]]
        if found.size:
            yield i, found


def _sets_to_check(rows: pa.Table, percent: int) -> pa.Table:
    """The sets of one task that have candidates in other components, or are such."""
    segment = _Segment(rows, percent)
    wanted = np.zeros(segment.rows.num_rows, bool)
    for i, found in _across(segment):
        wanted[i] = wanted[found] = True
    return segment.rows.filter(pa.array(wanted)).select([*TASK, "doc_id", "s1", "s2"])


def _checked_links(rows: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) between components, of whole sets; at most one for each two components."""
    segment = _Segment(rows, percent)
    ids = segment.rows.column("doc_id").combine_chunks()
    sets = [np.frombuffer(x, _U) for x in segment.rows.column("shingles").to_pylist()]
    component = pc.rank(segment.rows.column("component"), tiebreaker="dense").to_numpy()
    links, known = [], set()
    for i, found in _across(segment):
        for at in _runs(np.array([sets[j].size for j in found.tolist()])):
            some = found[at]
            theirs, sizes = [sets[j] for j in some.tolist()], segment.size[some]
            flat = np.concatenate(theirs)
            hit = sets[i][np.minimum(np.searchsorted(sets[i], flat), sets[i].size - 1)] == flat
            overlap = np.add.reduceat(hit, np.cumsum([0, *map(len, theirs[:-1])]))
            for j in some[100 * overlap >= percent * (segment.size[i] + sizes - overlap)].tolist():
                key = (component[i], component[j])
                if key not in known:
                    known.add(key)
                    links.append((i, j))
    a, b = (pa.array([x[k] for x in links], pa.int64()) for k in (0, 1))
    return pa.table([ids.take(a), ids.take(b)], ["a", "b"])


def _runs(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[slice]:
    """Slices of about so many shingles."""
    begin, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield slice(begin, k)
            begin, held = k, 0
        held += n
    yield slice(begin, len(sizes))


#: What names a task of the search.
TASK = ("class", "segment", "low", "high")


def summaries(docs: DataFrame, text: str, n: int) -> DataFrame:
    """(doc_id, key, size, s1, s2, hot): hash of each text, size and signature of its set; rows of null size
    have instead shingles that many texts share, and in how many."""
    hot_kind = T.ArrayType(T.StructType([T.StructField("token", T.LongType()), T.StructField("texts", T.LongType())]))
    longs = [T.StructField(c, T.LongType()) for c in ("key", "size", "s1", "s2")]
    schema = T.StructType([docs.schema["doc_id"], *longs, T.StructField("hot", hot_kind)])
    arrow_hot = pa.list_(pa.struct([("token", pa.int64()), ("texts", pa.int64())]))

    def hot(held: list[np.ndarray]) -> list[dict]:
        if not held:
            return []
        kinds, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= FREQUENT
        return [{"token": t, "texts": c} for t, c in zip(kinds[often].view(np.int64).tolist(), counts[often].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, kind = [], 0, None
        for whole in batches:
            for batch in row_slices(whole, text, _STEP):
                sets, kind = shingle_sets(batch.column(text).to_pylist(), n), batch.schema.field("doc_id").type
                held += sets
                many += sum(s.size for s in sets)
                sizes = pa.array([s.size for s in sets], pa.int64())
                s1, s2 = np.array([signature(s) for s in sets], np.int64).reshape(-1, 2).T
                none = pa.nulls(batch.num_rows, arrow_hot)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_key"), sizes, pa.array(s1), pa.array(s2), none], schema.names)
                if many >= COUNTED:
                    yield said(hot(held), kind)
                    held, many = [], 0
        if kind is not None:
            yield said(hot(held), kind)

    def said(found: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        nothing = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([pa.nulls(1, kind), nothing, nothing, nothing, nothing, pa.array([found], arrow_hot)], schema.names)

    return docs.select("doc_id", text, text_key(text)).mapInArrow(run, schema)


def text_key(text: str) -> Column:
    """With the id it names a row, but for repeats of the whole row."""
    return F.xxhash64(text).alias("_key")


def one_of_each(known: DataFrame) -> DataFrame:
    """(s1, s2, size, rep, key): of the rows with an equal set the one with the smallest id."""
    first = known.filter("size > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("size").alias("size"), F.min(F.struct("doc_id", "key")).alias("first"))
    return first.select("s1", "s2", "size", F.col("first.doc_id").alias("rep"), F.col("first.key").alias("key"))


def representatives(docs: DataFrame, text: str, alike: DataFrame) -> DataFrame:
    """The rows of docs that alike names; a row that repeats whole may stay more than once."""
    named = alike.select(F.col("rep").alias("doc_id"), F.col("key").alias("_key"))
    return docs.select("doc_id", text, text_key(text)).join(named.hint("shuffle_hash"), ["doc_id", "_key"], "left_semi")


def heads(docs: DataFrame, text: str, n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray], segments: dict[int, int]) -> DataFrame:
    """(targets, segment, doc_id, size, s1, s2, bits, tokens): a row for each part of a text's head. targets: the
    classes in which the part searches, its own and the next smaller one, and whether it is of the larger.
    frequent: shingles (sorted) and their counts; segments: how many a class has, if not one."""
    target = T.StructType([T.StructField("class", T.IntegerType()), T.StructField("larger", T.BooleanType())])
    fields = [
        T.StructField("targets", T.ArrayType(target)),
        T.StructField("segment", T.IntegerType()),
        docs.schema["doc_id"],
        *(T.StructField(c, T.LongType()) for c in ("size", "s1", "s2")),
        *(T.StructField(c, T.BinaryType()) for c in ("bits", "tokens")),
    ]
    shared = docs.sparkSession.sparkContext.broadcast((*frequent, segments))
    classes = size_classes(percent)

    def rows(doc_id, s: np.ndarray, s1: int, s2: int, tokens: np.ndarray, counts: np.ndarray, segments: dict[int, int]) -> Iterator[tuple]:
        size = s.size
        at = np.minimum(np.searchsorted(tokens, s), max(0, tokens.size - 1))
        often = np.where(tokens[at] == s, counts[at], 0) if tokens.size else np.zeros(size, np.int64)
        head = s[np.argsort(often, kind="stable")[: size - need(size, percent) + slack(size)]]
        bits, own = bitmap(s, bitmap_bits(size)), int(np.searchsorted(classes, size, "right")) - 1
        cuts: dict[int, list[dict]] = {}
        for kind in (own, own - 1)[: 1 + (own > 0)]:
            cuts.setdefault(segments.get(kind, 1), []).append({"class": kind, "larger": kind < own})
        for cut, targets in cuts.items():
            part = mixed(head) >> _U(40)
            part %= _U(cut)
            for k in np.unique(part).tolist():
                mine = (head[part == _U(k)] & _U(0xFFFFFFFF)).astype(np.uint32)
                # with many segments a set has many rows, so what goes with each is in proportion to its share
                words = min(bits.size, 1 << (mine.size.bit_length() - 1))
                yield targets, k, doc_id, size, s1, s2, folded(bits, words).tobytes(), mine.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, segments = shared.value
        done = set()  # a row that repeats whole has one head here
        for whole in batches:
            for batch in row_slices(whole, text, _STEP):
                sets = shingle_sets(batch.column(text).to_pylist(), n)
                named = zip(batch.column("doc_id").to_pylist(), sets, strict=True)
                found = []
                for i, s in named:
                    if s.size and i is not None and (key := (i, *signature(s))) not in done:
                        done.add(key)
                        found += rows(i, s, *key[1:], tokens, counts, segments)
                if found:
                    id_kind, long = batch.schema.field("doc_id").type, pa.int64()
                    types = [pa.list_(pa.struct([("class", pa.int32()), ("larger", pa.bool_())])), pa.int32(), id_kind, long, long, long, pa.binary(), pa.binary()]
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select("doc_id", text).mapInArrow(run, T.StructType(fields))


def in_blocks(rows: DataFrame) -> DataFrame:
    """Add block, low and high: a row for each task of its segment. Segments that aren't crowded have one block;
    in others a row goes to the tasks of its own block with each block."""
    held = F.octet_length("tokens") / 4
    loads = rows.groupBy("class", "segment").agg(F.sum(held).alias("load")).filter(F.col("load") > CROWDED * SEGMENT_SHINGLES)
    crowded = stored(loads.select("class", "segment", F.ceil(2 * F.col("load") / (CROWDED * SEGMENT_SHINGLES)).cast("int").alias("blocks")), "crowded")
    dealt = rows.join(crowded, ["class", "segment"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "s1"), F.col("blocks")).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"low": F.least("block", "_with"), "high": F.greatest("block", "_with")}).drop("blocks", "_with")


def whole_sets(docs: DataFrame, text: str, n: int, ids: DataFrame) -> DataFrame:
    """(doc_id, s1, s2, shingles) of the texts of these ids (_id), each set of an id once."""
    ids = stored(ids.distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", text).join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_id"), "left_semi")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, text, _STEP):
                sets = shingle_sets(batch.column(text).to_pylist(), n)
                s1, s2 = np.array([signature(s) for s in sets], np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s1), pa.array(s2), pa.array([s.tobytes() for s in sets], pa.binary())], schema.names)

    return texts.mapInArrow(run, schema).dropDuplicates(["doc_id", "s1", "s2"])


def verified(docs: DataFrame, text: str, n: int, percent: int, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = sorted((np.frombuffer(x, _U), np.frombuffer(y, _U)), key=len)
                overlap = int((y[np.minimum(np.searchsorted(y, x), y.size - 1)] == x).sum()) if x.size else 0
                stays.append(linked(overlap, x.size, y.size, percent))
            yield batch.select(["a", "b"]).filter(pa.array(stays))

    sets = whole_sets(docs, text, n, pairs.select(F.col("a").alias("_id")).union(pairs.select("b")))
    whole = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    whole = whole.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return whole.select("a", "b", "x", "y").mapInArrow(probe, pairs.select("a", "b").schema).distinct()


def repeated_ids(known: DataFrame, alike: DataFrame) -> DataFrame:
    """Links (a, b) between an id that has several sets and the ids that stand for them."""
    own = known.filter("size > 0 and doc_id is not null")
    several = own.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("_l"), F.max(F.struct("s1", "s2")).alias("_m")).filter("_l <> _m").select("doc_id")
    sets = own.join(several, "doc_id", "left_semi").select("doc_id", "s1", "s2").distinct()
    links = sets.join(alike.select("s1", "s2", "rep"), ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return links.filter("a <> b")


def jaccard_rows(docs: DataFrame, text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, key, s1, s2, n_shingles, component_id) of every row of docs: key is that of the text, s1 and s2 that of
    its set."""
    id_kind = docs.schema["doc_id"].dataType
    every = stored(summaries(docs, text, n), "summaries")
    known = every.filter(F.col("size").isNotNull()).drop("hot")
    hot = every.filter(F.col("size").isNull()).select(F.explode("hot").alias("h")).groupBy("h.token").agg(F.sum("h.texts").alias("texts"))
    # a list of MOST_FREQUENT entries at most
    hot = hot.orderBy(F.desc("texts"), "token").limit(MOST_FREQUENT).toPandas()
    hot["token"] = hot["token"].to_numpy(np.int64).view(_U)
    hot = hot.sort_values("token")
    classes = size_classes(percent).tolist()
    place = F.size(F.filter(F.array(*map(F.lit, classes)), lambda c: c <= F.col("size"))) - 1
    load = F.sum(F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 + F.floor(F.col("size") / 20))
    alike = stored(one_of_each(known), "alike")
    loads = alike.groupBy(place.alias("class")).agg(load.alias("load")).collect()  # a row per class of sizes
    segments = {r["class"]: -(-int(r["load"]) // SEGMENT_SHINGLES) for r in loads if r["load"] > SEGMENT_SHINGLES}
    table = stored(heads(representatives(docs, text, alike), text, n, percent, (hot["token"].to_numpy(), hot["texts"].to_numpy(np.int64)), segments), "heads")
    pair = T.StructType([T.StructField("a", id_kind), T.StructField("b", id_kind)])

    def dealt(heads: DataFrame) -> DataFrame:
        rows = heads.withColumn("target", F.explode("targets")).drop("targets").withColumns({"class": F.col("target.class"), "larger": F.col("target.larger")})
        return in_blocks(rows.drop("target"))

    found = stored(dealt(table).groupBy(*TASK).applyInArrow(lambda rows: _first_pairs(rows, percent), pair), "pairs")
    links = stored(verified(docs, text, n, percent, found.filter("b is not null").distinct()).unionByName(repeated_ids(known, alike)), "links")
    labels = connected(links)
    still = stored(found.filter("b is null").select(F.col("a").alias("doc_id")).distinct(), "unfinished")
    if still.limit(1).count():
        own = labels.select(F.col("id").alias("doc_id"), "component")
        rows = table.join(still, "doc_id", "left_semi").join(own, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        rows = stored(dealt(rows), "searched")
        named = T.StructType([rows.schema[c] for c in (*TASK, "doc_id", "s1", "s2")])
        wanted = stored(rows.groupBy(*TASK).applyInArrow(lambda rows: _sets_to_check(rows, percent), named), "to-check")
        sets = whole_sets(docs, text, n, wanted.select(F.col("doc_id").alias("_id")))
        rows = rows.join(wanted, [*TASK, "doc_id", "s1", "s2"], "left_semi").join(sets, ["doc_id", "s1", "s2"])
        more = rows.groupBy(*TASK).applyInArrow(lambda rows: _checked_links(rows, percent), pair)
        labels = connected(links.unionByName(stored(more, "more-links")))
    named = alike.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    named = named.select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    return known.join(named, ["s1", "s2"], "left").select(
        "doc_id",
        "key",
        "s1",
        "s2",
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def jaccard_components(docs: DataFrame, text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    return jaccard_rows(docs, text, n, percent).select("doc_id", "n_shingles", "component_id")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)
