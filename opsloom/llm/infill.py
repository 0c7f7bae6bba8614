"""Fill-in-middle: texts cut into prefix, middle and suffix, with the middle moved to the end.

Each text is decoded to an array of UTF-32 code points. Letters A-Z and a-z are one class; a unit begins at
every point that isn't a letter following a letter, so the boundaries are where neighbouring classes say so, found
by flatnonzero. Two ranks, drawn by the SHA-256 of the document's id, pick the boundaries; the pieces
between them are sliced from the array and encoded again.

A text that holds a mark can't be rebuilt and stays plain, as empty ones do and a share of all others. Null counts as
empty. Nothing is random: the same id and text give the same cut; a row without id draws as the empty id does.
Rows that repeat each get their own result. A very long text is held by one task, at some ten bytes a
code point. Made columns replace input columns of the same names; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.common import read, row_slices

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many are cut; of those so many with the suffix first.
RATE = 90
SUFFIX_FIRST = 20
MADE = (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))


@dataclass(frozen=True)
class Cut:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def draws(doc_id, seed: str) -> list[int]:
    """Four numbers of 32 bits for an id."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[at : at + 8], 16) for at in range(0, 32, 8)]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where the units of an array of code points begin, and its end."""
    # 32 is all that tells a letter from its capital
    letter = ((points | 32) >= ord("a")) & ((points | 32) <= ord("z"))
    begins = np.ones(points.size + 1, bool)
    begins[1:-1] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins[: points.size + 1]) if points.size else np.zeros(1, np.int64)


def cut(text: str | None, doc_id, seed: str = "1", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> Cut:
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    edges = boundaries(points)
    n = edges.size - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= rate or any(m in text for m in MARKS):
        return Cut(n, "plain", None, None, text)
    first, second = edges[sorted((h1 % (n + 1), h2 % (n + 1)))].tolist()
    prefix, middle, suffix = (piece.tobytes().decode("utf-32-le") for piece in (points[:first], points[first:second], points[second:]))
    p, s, m = MARKS
    if h4 % 100 < suffix_first:
        return Cut(n, "spm", first, second - first, f"{s}{suffix}{p}{prefix}{m}{middle}")
    return Cut(n, "psm", first, second - first, f"{p}{prefix}{s}{suffix}{m}{middle}")


def rebuild(output: str, form: str) -> str:
    """The text that an output of this form was made of."""
    if form == "plain":
        return output
    p, s, m = MARKS
    pieces, middle = output.split(m, 1)
    if form == "spm":
        suffix, prefix = pieces.removeprefix(s).split(p, 1)
    else:
        prefix, suffix = pieces.removeprefix(p).split(s, 1)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = "1", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars (code points, null if plain) and output."""
    names = {name for name, _ in MADE}
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    own = docs.select(*(F.col(f.name) for f in kept), F.col(doc_id).alias("_fim_id"), F.col(text).alias("_fim_text"))
    schema = T.StructType([*kept, *(T.StructField(name, kind) for name, kind in MADE)])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "_fim_text"):
                pairs = zip(batch.column("_fim_text").to_pylist(), batch.column("_fim_id").to_pylist(), strict=True)
                made = [cut(t, i, seed, rate, suffix_first) for t, i in pairs]
                columns = [pa.array([getattr(c, name) for c in made], kind) for (name, _), kind in zip(MADE, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], schema.names)

    return own.mapInArrow(run, schema)


def restored(rows: DataFrame, output: str = "output", form: str = "form", into: str = "restored") -> DataFrame:
    """rows with the texts that their outputs were made of, in the column `into`."""
    kept = [f for f in rows.schema.fields if f.name.lower() != into.lower()]
    schema = T.StructType([*kept, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, output):
                pairs = zip(batch.column(output).to_pylist(), batch.column(form).to_pylist(), strict=True)
                said = pa.array([rebuild(o, f) for o, f in pairs], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), said], schema.names)

    return rows.mapInArrow(run, schema)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    made = restored(rows).withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2("restored", 256)})
    return made.drop("output", "restored")


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
n AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM n),
p AS (
  SELECT *, array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle,
         array_to_string(list_slice(units, b + 1, n), '') AS suffix
  FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
