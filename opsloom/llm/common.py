"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever an operator counts or splits words.
WORD = r"[^\x20\x09-\x0D]+"

#: Keys that a table of heavy keys may hold, so that it can be broadcast whatever the input.
HEAVY_KEYS = 20_000

#: So many rows of a key may always meet in one task.
FEW_ROWS = 2000

#: Bytes of text that one step of a Python operator holds as numpy arrays.
STEP_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, by whatever file system the folder is on."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, one of our own, if all run on
    this machine; else there is none that all could see, which is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="opsloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here, and a lost
    executor costs nothing that was written. Spark deletes the folder when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def heavy(counts: DataFrame, key: str, total: int, n: str = "n") -> DataFrame | None:
    """Of a table (key, n) the keys that hold more than FEW_ROWS rows and more than 1 / HEAVY_KEYS of all; so there are
    fewer than HEAVY_KEYS, which pass through the driver. None if there are none."""
    found = counts.filter((F.col(n) > FEW_ROWS) & (F.col(n) * HEAVY_KEYS > total)).select(key)
    rows = found.collect()
    return counts.sparkSession.createDataFrame(rows, found.schema) if rows else None


def join_heavy(rows: DataFrame, table: DataFrame, key: str, keys: DataFrame | None) -> DataFrame:
    """rows joined to a table with a row for each key at most. The rows of heavy keys stay where they are and
    meet a broadcast part of the table, of fewer than HEAVY_KEYS rows; of any other key so few rows are left
    that they may meet in one task."""
    if keys is None:
        return rows.join(table, key)
    few = F.broadcast(keys)
    light = rows.join(few, key, "left_anti").join(table, key)
    return rows.join(F.broadcast(table.join(few, key, "left_semi")), key).unionByName(light)


def row_slices(batch: pa.RecordBatch, text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about `most` bytes of the column text, one row at least."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def words(text: str = "text"):
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
