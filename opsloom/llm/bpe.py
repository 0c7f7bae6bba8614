"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is split by the vocabulary's pattern; each piece is mapped from bytes to the printable
characters of byte-level vocabularies and merged by the library's BPE model. Pieces repeat, so a
bounded dictionary per Arrow stream keeps what the model said of each. Decoding reverses the byte table
over the vocabulary's strings, so that each character of a token gives back its byte; a character split
over tokens comes together when their bytes are joined. Offsets count code points; tokens that share a
split character all span it, as the library's own offsets do.

Null text counts as empty and gives no tokens; repeated rows give repeated results; an empty table
gives an empty table. Columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.common import read, row_slices

RANKS = "byte_bpe_50k.tiktoken"

#: Pieces kept in a task's dictionary before it starts afresh.
MOST_PIECES = 200_000

#: Below this code point a text is split by an equal pattern that the standard library runs faster.
_LOW = 0x250


@cache
def byte_chars() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that were merged last into token: what its bytes become under the lower ranks."""
    parts, own = [bytes([b]) for b in token], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if rank >= own:
            raise ValueError(f"no merges lead to the token {token!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def _classes() -> tuple[str, str, str]:
    def of(test) -> str:
        return "".join(f"\\u{c:04x}" for c in range(_LOW) if test(chr(c)))

    # of the low white space, str.isspace also takes the separators U+001C-U+001F; \s of the pattern doesn't
    space = of(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")
    return of(lambda c: unicodedata.category(c)[0] == "L"), of(lambda c: unicodedata.category(c)[0] == "N"), space


@cache
def vocabulary(path: str) -> dict[str, int]:
    """Token -> id as the library's model holds it: a printable character for each byte."""
    chars = byte_chars()
    return {"".join(chars[b] for b in token): rank for token, rank in read_ranks(path).items()}


def char_bytes() -> dict[str, int]:
    """The byte table reversed: printable character -> byte."""
    return {c: b for b, c in byte_chars().items()}


@cache
def token_table(path: str) -> list[bytes]:
    """What each id decodes to: its token's characters by the reversed byte table; once per Python worker and path."""
    tokens, back = vocabulary(path), char_bytes()
    table = [b""] * (max(tokens.values()) + 1)
    for token, rank in tokens.items():
        table[rank] = bytes([back[c] for c in token])
    return table


def decode_ids(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids])


class _Pieces(dict):
    """Ids of pieces, as the bytes of 32-bit numbers; asks for those that it doesn't hold."""

    def __init__(self, ask):
        super().__init__()
        self.ask = ask

    def __missing__(self, piece: str) -> bytes:
        ids = self.ask(piece)
        if len(self) >= MOST_PIECES:
            self.clear()
        if len(piece) <= 256:
            self[piece] = ids
        return ids


class ByteBPE:
    """Encoder for one rank file; built once per Python worker and path."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        from tokenizers.models import BPE

        ranks, chars = read_ranks(path), byte_chars()
        self.token_bytes = token_table(path)
        self.lengths = np.array([len(t) for t in self.token_bytes])
        name = {token: "".join(chars[b] for b in token) for token in ranks}
        merged = sorted((t for t in ranks if len(t) > 1), key=ranks.get)
        merges = [(name[a], name[b]) for a, b in (_halves(t, ranks) for t in merged)]
        self.model = BPE(vocab=vocabulary(path), merges=merges)
        self.pattern = regex.compile(pattern)
        self.low = None
        if pattern == public_tokenizers.PATTERN:
            letter, number, space = _classes()
            self.low = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
            self.high = re.compile(f"[^\\u0000-\\u{_LOW - 1:04x}]")
        self.table = {b: c for b, c in chars.items()}
        self.known = _Pieces(self._piece)

    def pieces(self, text: str) -> list[str]:
        if self.low and not self.high.search(text):
            return self.low.findall(text)
        return self.pattern.findall(text)

    def _piece(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))
        return np.array([t.id for t in tokens], np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.pieces(text))), np.int32)

    def char_spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and the one after the last of each token; tokens that share a split
        character all span it."""
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        at = np.cumsum(lead) - 1
        ends = np.cumsum(self.lengths[ids])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return at[starts], at[ends - 1] + 1


_BUILT: dict[str, ByteBPE] = {}


def _built(path: str) -> ByteBPE:
    if path not in _BUILT:
        _BUILT[path] = ByteBPE(path)
    return _BUILT[path]


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate([np.asarray(r, kind.to_pandas_dtype()) for r in rows]) if len(rows) else []
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, kind))


def _with(df: DataFrame, *fields: T.StructField) -> T.StructType:
    made = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in made] + list(fields))


def encode(docs: DataFrame, text: str = "text", ranks: str | None = None, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """Add ids (array<int>) and, if asked, char_start and char_end (array<int>, code points) and decoded
    (binary), as decode() does, without a second pass through Python."""
    path = ranks or public_tokenizers.path(RANKS)
    array = T.ArrayType(T.IntegerType(), False)
    more = [T.StructField(n, array) for n in ("ids", *(("char_start", "char_end") if offsets else ()))]
    more += [T.StructField("decoded", T.BinaryType())] * decoded
    schema = _with(docs, *more)
    keep = [f.name for f in schema.fields if f.name not in {m.name for m in more}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _built(path)
        for whole in batches:
            for batch in row_slices(whole, text):
                texts = [t or "" for t in batch.column(text).to_pylist()]
                ids = [bpe.encode(t) for t in texts]
                made = [_lists(ids, pa.int32())]
                if offsets:
                    spans = [bpe.char_spans(t, i) if i.size else ([], []) for t, i in zip(texts, ids, strict=True)]
                    made += [_lists([s[k] for s in spans], pa.int32()) for k in (0, 1)]
                if decoded:
                    made.append(pa.array([decode_ids(i.tolist(), bpe.token_bytes) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """Add decoded (binary): the bytes of the tokens, joined."""
    path = ranks or public_tokenizers.path(RANKS)
    schema = _with(encoded, T.StructField("decoded", T.BinaryType()))
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                rows = [decode_ids(i or [], table) for i in batch.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, pa.binary())], schema.names)

    return encoded.mapInArrow(run, schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, their offsets and their decoding, as digests."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return encode(docs, offsets=True, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.sha2(F.concat_ws(",", joined("char_start"), joined("char_end")), 256).alias("offsets_sha256"),
    )
