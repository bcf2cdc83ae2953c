"""Stored tables that can be changed, and the catalog on top of them."""

import glob

from pyspark.sql import functions as F

from sparkboard.sources import store
from sparkboard.sources.buckets import Table


def files(path):
    return {f.split("/__upload=")[0].rsplit("=", 1)[1] + "/" + f.rsplit("/", 1)[1] for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def messages(spark, n=2000):
    return spark.range(n).selectExpr("id % 100 AS session_id", "id AS turn", "concat('m', id) AS text")


def test_a_retried_write_leaves_the_rows_once(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", "session_id", messages(spark).schema, buckets=8)
    assert table.read().count() == 0
    for _ in range(2):
        table.append(messages(spark), "one")
    table.append(messages(spark, 100), "two")
    assert table.read().count() == 2100
    assert table.read().columns == ["session_id", "turn", "text"]


def test_deleting_sessions_rewrites_their_buckets_alone(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", "session_id", messages(spark).schema, buckets=16)
    table.append(messages(spark), "one")
    before = files(table.path)
    gone = spark.createDataFrame([(3,), (70,), (None,), (12345,)], "id long")
    hit = {str(r[0]) for r in gone.dropna().select(table._bucket(F.col("id"))).collect()}
    table.delete(gone)
    after = files(table.path)
    assert {f.split("/")[0] for f in before ^ after} <= hit and before != after
    assert {r[0] for r in table.read().select("session_id").distinct().collect()} == set(range(100)) - {3, 70}
    assert table.read().count() == 2000 - 40
    # All rows of a bucket may go; an empty list of keys changes nothing.
    table.delete(messages(spark).select("session_id"))
    assert table.read().count() == 0 and files(table.path) == set()
    table.append(messages(spark, 10))
    table.delete(gone.where("false"))
    assert table.read().count() == 10


def test_a_lookup_opens_one_bucket(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", "session_id", messages(spark).schema, buckets=16)
    table.append(messages(spark), "one")
    found = table.lookup(42)
    assert sorted(r["turn"] for r in found.collect()) == list(range(42, 2000, 100))
    assert len(found.inputFiles()) > 1  # the scan's folder before pruning
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan or "PartitionFilters: [(__bucket" in plan
    read = [m for m in plan.splitlines() if "FileScan" in m]
    assert len(read) == 1


def test_the_catalog_is_compacted_without_losing_the_newest(spark, tmp_path):
    catalog = store.Catalog(spark, f"{tmp_path}/c", buckets=4)
    columns = spark.createDataFrame([(0, "a", "text", 5)], "ordinal int, name string, type string, row_count long")
    for k in range(3):
        record = store.dataset_record(spark, columns, f"f{k}.csv", "d1", session_id="s", location=f"at{k}")
        catalog.add(record.withColumn("created_at", F.expr(f"timestamp'2024-01-0{k + 1} 00:00:00'")), f"u{k}")
    catalog.add(store.dataset_record(spark, columns, "g.csv", "d2", session_id="s").withColumn("created_at", F.expr("timestamp'2024-01-02 00:00:00'")), "v")
    for _ in range(2):
        assert catalog.dataset("d1").head()["location"] == "at2"
        assert catalog.session("s").head()["location"] == "at2"
        assert catalog.dataset("nobody").count() == 0
        catalog.compact()
    assert catalog.records().count() == 2 and len(files(catalog.by_dataset.path)) <= 4


def test_keys_may_be_null_and_rows_lack_no_column(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", "k", spark.createDataFrame([], "k string, v int").schema)
    table.append(spark.createDataFrame([(None, 1), ("", 2), ("a=b/c", 3)], "k string, v int"))
    assert {tuple(r) for r in table.read().collect()} == {(None, 1), ("", 2), ("a=b/c", 3)}
    assert table.lookup("a=b/c").head()["v"] == 3
    try:
        table.append(spark.createDataFrame([("x",)], "k string"))
    except ValueError as error:
        assert "no column v" in str(error)
    else:
        raise AssertionError
