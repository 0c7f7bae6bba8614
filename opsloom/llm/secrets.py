"""Secret scan with multipart credential linking.

Base findings are assignments to a secret-like name, access identifiers and long hex strings. The
method then looks for credentials in several parts: access identifiers (AKIA ids, user or client id
assignments), secrets (unlabelled mixed strings, and the base findings) and endpoints (hosts in
URLs, e-mail domains). A part on its own is weak. Within a scope - a paragraph, that is, text between
blank lines - parts are interval-joined: a weak secret is reported as `linked` when an identifier or
an endpoint lies in its scope beside it and, as the complement, an identifier is reported as
`identity` when a secret does. The scope is the bound, however long it is; a `reach` in code points can be
asked for beside it. Base findings stay whatever the join says. The combinations
that count are secret with identifier (a key pair, a login) and secret with endpoint (a token and where it
is used), for each gives a usable credential; identifier with endpoint is an address, two secrets are two
parts of one role, so neither counts.

The join never leaves a document, so it is a sweep over that document's sorted parts, each looked up by
binary search; nothing is shuffled, and a long text full of parts takes time in proportion. Null and empty texts
have no findings; repeated rows give repeated results; whole texts are scanned. Columns named like an output are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.common import read, row_slices

#: The order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "identity", "linked")

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so those of fewer than 24 characters needn't be matched to be dropped.
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTITY = re.compile(r"((?i:client|account|user|access)[_-]?(?i:id|name))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})", re.ASCII)
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.ASCII)
#: Unlabelled strings that may be secrets: 16 or more characters with a digit, and letters of both cases.
_WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}", re.ASCII)
_BLANK = re.compile(r"\n\s*\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of base findings, ends exclusive, by start and kind."""
    found: list[Span] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class _Intervals:
    """Intervals of one role. None crosses a blank line, so one that ends inside a scope lies in it."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(set(spans))
        self.starts = [s for s, _ in spans]
        self.ends = sorted(e for _, e in spans)
        self.furthest = list(accumulate((e for _, e in spans), max))

    def overlap(self, start: int, end: int) -> bool:
        """Does one share a place with [start, end)?"""
        i = bisect_left(self.starts, end)
        return i > 0 and self.furthest[i - 1] > start

    def near(self, start: int, end: int, low: int, high: int) -> bool:
        """Does another one lie inside [low, high), beside [start, end)? The next on either side tells."""
        after, before = bisect_left(self.starts, end), bisect_right(self.ends, start)
        return after < len(self.starts) and self.starts[after] < high or before > 0 and self.ends[before - 1] > low


def linked_spans(text: str, base: list[Span], reach: int | None = None) -> list[Span]:
    """What co-occurring parts add to the base findings; with a reach, of parts at most so far apart."""
    identity = [(m.start(), m.end()) for m in _IDENTITY.finditer(text)] if ("id" in text.lower() or "name" in text.lower()) else []
    endpoint = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)] if ("://" in text or "@" in text) else []
    access = [(s, e) for s, e, k in base if k == "access"]
    strong = [(s, e) for s, e, k in base if k != "access"]
    if not (identity or endpoint or access):
        return []
    known = _Intervals([(s, e) for s, e, _ in base])
    weak = [(m.start(), m.end()) for m in _WEAK.finditer(text) if m[0].lower() != m[0] and m[0].upper() != m[0] and not known.overlap(m.start(), m.end())]
    if not weak and not (identity and strong):
        return []
    cuts = [0, *(m.end() for m in _BLANK.finditer(text)), len(text) + 1]
    partners, secrets = _Intervals(identity + access + endpoint), _Intervals(strong + weak)

    def scope(start: int, end: int) -> tuple[int, int]:
        i = bisect_left(cuts, start + 1) - 1
        if reach is None:
            return cuts[i], cuts[i + 1]
        return max(cuts[i], start - reach - 1), min(cuts[i + 1], end + reach + 1)

    found = [(s, e, "linked") for s, e in weak if partners.near(s, e, *scope(s, e))]
    found += [(s, e, "identity") for s, e in identity if secrets.near(s, e, *scope(s, e))]
    return found


def scan(text: str, reach: int | None = None) -> list[Span]:
    """All findings of a text, by start, then kind."""
    base = base_spans(text)
    return sorted(base + linked_spans(text, base, reach), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(docs: DataFrame, text: str = "text", reach: int | None = None) -> DataFrame:
    """docs with secrets: array<struct<kind, start, end>>, by start, then kind. Parts link within a paragraph, or
    only within reach of one another, if one is given."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    made = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [f for f in docs.schema.fields if f.name.lower() != "secrets"]
    schema = T.StructType([*fields, T.StructField("secrets", made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, text):
                rows = [[{"kind": k, "start": s, "end": e} for s, e, k in scan(t or "", reach)] for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(rows, pa.list_(item))], schema.names)

    return docs.mapInArrow(run, schema)


def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("secrets", lambda x: x["kind"].isin("assign", "access", "hex"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("secrets")).alias("spans"),
        (count("linked") + count("identity")).alias("n_linked"),
    )
