"""Ledgers, paged sources and bundles: repeats, second writers, crashes."""

import hashlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.sources import connectors, ledger

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("who", T.StringType())])


def rows(spark, *ids, who="a"):
    return spark.createDataFrame([(i, who) for i in ids], SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_batch_counts_once(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path), SCHEMA)
    assert ids(book.rows()) == [] and book.newest() == -1
    assert book.append(rows(spark, 1, 2), 0) and book.append(rows(spark, 3), 1)
    assert not book.append(rows(spark, 1, 2), 0) and not ledger.Ledger(spark, f"file://{tmp_path}/", SCHEMA).append(rows(spark, 9), 1)
    assert ids(book.rows()) == [1, 2, 3]


def test_a_writer_that_dies_before_its_manifest_leaves_nothing(spark, tmp_path, monkeypatch):
    book = ledger.Ledger(spark, str(tmp_path), SCHEMA)

    def died(*_):
        raise OSError("gone")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(ledger.Ledger, "_claim", died)
        book.append(rows(spark, 1), 0)
    assert len(list((tmp_path / "data").iterdir())) == 1 and ids(book.rows()) == []
    assert book.append(rows(spark, 1), 0) and ids(book.rows()) == [1]
    book.forget(5)
    assert len(list((tmp_path / "data").iterdir())) == 1 and ids(book.rows()) == [1]


def test_twenty_five_interleaved_writers(spark, tmp_path):
    """Each adds its row to the state; none is lost, though several start from the same one."""
    add = lambda i: ledger.Ledger(spark, str(tmp_path), SCHEMA).mutate(lambda now: now.unionByName(rows(spark, i)))
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(add, range(25)))
    book = ledger.Ledger(spark, str(tmp_path), SCHEMA)
    assert ids(book.state()) == list(range(25)) and sorted(versions) == list(range(25))
    book.forget(2)
    assert ids(book.state()) == list(range(25)) and len(list((tmp_path / "manifests").iterdir())) == 2


def test_a_stream_that_breaks_off_and_starts_again(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for k in range(3):
        rows(spark, 2 * k, 2 * k + 1).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    book = ledger.Ledger(spark, f"{tmp_path}/book", SCHEMA)
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda: book.sink(stream, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    put, calls = ledger.Ledger._put, []

    def breaks(self, df, number):
        calls.append(number)
        done = put(self, df, number)
        if number == 1 and calls.count(1) == 1:
            raise OSError("after the commit, before the checkpoint")
        return done

    with monkeypatch.context() as m:
        m.setattr(ledger.Ledger, "_put", breaks)
        with pytest.raises(PySparkException):
            run()
        run()
    assert ids(book.rows()) == list(range(6))


def test_only_matching_pages_are_opened(spark, tmp_path):
    table = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("status"), (F.col("id") % 2).cast("string").alias("pipeline"))
    connectors.write_pages(table.coalesce(1), str(tmp_path / "pages"), ["status", "pipeline"], 5)
    read = lambda: connectors.read_pages(spark, str(tmp_path / "pages"), ["status", "pipeline"], "k long, status string, pipeline string")
    assert sorted(map(tuple, read().collect())) == sorted(map(tuple, table.collect()))
    some = read().filter("status = '1' AND pipeline IN ('0', '9') AND k > 40")
    assert ids(some.withColumnRenamed("k", "id")) == [k for k in range(41, 100) if k % 6 == 4]
    # 16 rows in pages of 5
    assert some.rdd.getNumPartitions() == 4 and read().rdd.getNumPartitions() == 24
    assert read().filter("status = 'none'").collect() == []


def test_bundles(spark, tmp_path):
    files = [(f"f{k}.md", bytes([k]) * k) for k in range(20)] + [("twice", b"x"), ("twice", b"x"), ("none", None)]
    connectors.write_bundle(spark.createDataFrame(files, "name string, content binary").repartition(3), str(tmp_path))
    listed = connectors.bundle_files(spark, str(tmp_path)).collect()
    assert sorted((r["name"], r["size"], r["sha256"]) for r in listed) == sorted((n, len(c or b""), hashlib.sha256(c or b"").hexdigest()) for n, c in files)
    assert all((tmp_path / r["path"]).read_bytes() == dict(files)[r["name"]] or r["name"] == "none" for r in listed)


def test_a_bundle_that_fails_leaves_nothing(spark, tmp_path):
    bad = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error("broken")).otherwise("x").alias("content")).repartition(4)
    with pytest.raises(PySparkException):
        connectors.write_bundle(bad, str(tmp_path))
    assert not (tmp_path / "manifest.json").exists()
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
