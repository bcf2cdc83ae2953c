import json

import pytest
from pyspark.sql import functions as F

from sparkboard.sources import csv, scratch, store


def write(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_quotes_commas_line_breaks_and_missing_values(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'Id,Note\n1,"a, ""b"""\n2,"two\nlines"\n3,NA\n4,\n5\n')
    df = csv.read_csv(spark, path)
    assert df.columns == ["id", "note"]
    assert rows(df) == [("1", 'a, "b"'), ("2", "two\nlines"), ("3", None), ("4", None), ("5", None)]


def test_latin1_header_and_value(spark, tmp_path):
    path = write(tmp_path, "a.csv", "Größe,x\nÜ,1\n".encode("latin-1"))
    df = csv.read_csv(spark, path)
    assert df.columns == ["größe", "x"] and rows(df) == [("Ü", "1")]


def test_utf8_with_replacement_character_stays_utf8(spark, tmp_path):
    path = write(tmp_path, "a.csv", "x\né�\n")
    assert rows(csv.read_csv(spark, path)) == [("é�",)]


def test_each_file_has_its_own_encoding(spark, tmp_path):
    write(tmp_path, "a.csv", "x,y\nÜ,1\n".encode("latin-1"))
    write(tmp_path, "b.csv", "x,y\nÜ,2\n")
    write(tmp_path, "c.csv", 'x,y\n"Ü\nÜ",3\n')
    df = csv.read_csv(spark, str(tmp_path), row_number=True).orderBy("row_number")
    assert rows(df) == [("Ü", "1", 1), ("Ü", "2", 2), ("Ü\nÜ", "3", 3)]


def test_header_alone(spark, tmp_path):
    path = write(tmp_path, "a.csv", "Id,Note\n")
    upload = store.upload_csv(spark, path, str(tmp_path / "store"))
    assert upload.rows.count() == 0 and upload.record.head()["row_count"] == 0
    assert [c["type"] for c in upload.record.head()["columns"]] == ["numeric", "numeric"]
    with pytest.raises(ValueError):
        csv.read_csv(spark, write(tmp_path, "empty.csv", ""))


def test_carriage_returns_blank_lines_and_a_byte_order_mark(spark, tmp_path):
    path = write(tmp_path, "a.csv", b"\xef\xbb\xbfId,x\r\n1,a\r\n\r\n2, b \r\n")
    df = csv.read_csv(spark, path)
    assert df.columns == ["id", "x"] and rows(df) == [("1", "a"), ("2", " b ")]


def test_too_many_cells_fail(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a,b\n1,"x,y"\n1,2,3\n')
    with pytest.raises(Exception, match="more than 2 cells"):
        csv.read_csv(spark, path).collect()


def test_named_reading_needs_no_look_at_the_lines(spark, tmp_path):
    path = write(tmp_path, "a.csv", "a,b\n1,2\n")
    assert rows(csv.read_csv(spark, path, encoding="UTF-8", multiline=False)) == [("1", "2")]


def test_row_numbers_over_many_blocks(spark, tmp_path):
    text = "n,pad\n" + "".join(f"{i},{'x' * (i % 37)}\n" for i in range(1, 20001))
    write(tmp_path, "a.csv", text)
    write(tmp_path, "b.csv", "n,pad\n20001,\n20002,y\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = csv.read_csv(spark, str(tmp_path), row_number=True)
        assert df.count() == 20002
        assert df.filter(F.col("n").cast("long") != F.col("row_number")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("setting, value", [
    ("spark.sql.files.maxPartitionBytes", "4096"), ("spark.sql.leafNodeDefaultParallelism", "3"),
])
def test_row_numbers_do_not_depend_on_splits(spark, tmp_path, setting, value):
    place = str(tmp_path / "rows")
    spark.range(20_000).repartitionByRange(7, "id").sortWithinPartitions("id").write.option("parquet.block.size", 4096).parquet(place)
    path = write(tmp_path, "a.csv", "n\n" + "".join(f"{i}\n" for i in range(20_000)))
    numbered = csv.with_row_number(spark.read.parquet(place))
    read = csv.read_csv(spark, path, row_number=True)
    spark.conf.set(setting, value)
    try:
        assert numbered.filter(F.col("row_number") == F.col("id") + 1).count() == 20_000
        assert read.filter(F.col("row_number") == F.col("n").cast("long") + 1).count() == 20_000
    finally:
        spark.conf.unset(setting)


def test_columns_named_like_row_numbers_are_kept(spark, tmp_path):
    path = write(tmp_path, "a.csv", "Row Number,x\n70,1\n80,2\n")
    upload = store.upload_csv(spark, path, str(tmp_path / "store"), "d")
    assert upload.record.head()["column_count"] == 2
    assert rows(upload.rows.orderBy("row_number").select("row_number_1", "x", "row_number")) == [(70, 1, 1), (80, 2, 2)]
    with pytest.raises(ValueError, match="row_number"):
        csv.with_row_number(upload.rows)


def test_files_with_columns_in_another_order_are_read_by_name(spark, tmp_path):
    write(tmp_path, "a.csv", "x,y\n1,2\n")
    write(tmp_path, "b.csv", "y,x\n20,10\n")
    for kinds in ({}, {"encoding": "UTF-8", "multiline": False}):
        assert sorted(rows(csv.read_csv(spark, str(tmp_path), **kinds).select("x", "y"))) == [("1", "2"), ("10", "20")]
    write(tmp_path, "c.csv", "x,z\n5,6\n")
    with pytest.raises(ValueError, match="different columns"):
        csv.read_csv(spark, str(tmp_path))


def test_an_upload_can_be_repeated(spark, tmp_path):
    place = str(tmp_path / "store")
    first = store.upload_csv(spark, write(tmp_path, "a.csv", "x\n1\n2\n"), place, "d")
    again = store.upload_csv(spark, write(tmp_path, "b.csv", "x\n7\n8\n9\n"), place, "d")
    catalog = store.catalog_of(spark, place).records()
    assert store.lookup(catalog, "d").count() == 1 and store.lookup(catalog, "d").head()["row_count"] == 3
    assert sorted(r["x"] for r in store.read_uploaded(spark, place, "d").collect()) == [7, 8, 9]
    assert first.rows.count() == 2 and again.rows.count() == 3


def test_a_column_named_dataset_id_is_stored(spark, tmp_path):
    df = spark.createDataFrame([("own", 1)], "dataset_id string, x int")
    store.write_dataset(df, str(tmp_path), F.lit("d"))
    assert rows(store.read_dataset(spark, str(tmp_path), "d").select("dataset_id", "x")) == [("own", 1)]


def test_rows_as_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(store.rows_as_json(df).head()[0]) == {"a": 1, "b": None}


def test_upload(spark, tmp_path):
    path = write(
        tmp_path, "My Sales.v2.csv",
        "CustomerID,Order Date,Amt,Flag,Empty,Region\n1,01/02/2024,1.50,True,,N\n"
        "2,13/02/2024,2.25,False,,N\n3,,,,,N\n",
    )
    place = str(tmp_path / "store")
    first = store.upload_csv(spark, path, place, "d1", owner="u", session_id="s")
    store.upload_csv(spark, path, place, "d2", owner="u", session_id="s")
    record = first.record.head()
    assert (record["dataset_name"], record["row_count"], record["column_count"]) == ("my_sales.v2", 3, 6)
    assert [(c["name"], c["type"]) for c in record["columns"]] == [
        ("customer_id", "numeric"), ("order_date", "datetime"), ("amt", "numeric"),
        ("flag", "numeric"), ("empty", "numeric"), ("region", "categorical"),
    ]
    assert first.rows.count() == 3
    assert {f.name: f.dataType.simpleString() for f in first.rows.schema} == {
        "customer_id": "bigint", "order_date": "timestamp_ntz", "amt": "decimal(3,2)",
        "flag": "boolean", "empty": "double", "region": "string", "row_number": "bigint",
    }
    catalog = store.catalog_of(spark, place).records()
    assert store.latest_of_session(catalog, "s").head()["dataset_id"] == "d2"
    assert store.latest_per_session(catalog).head()["dataset_id"] == "d2"
    assert store.lookup(catalog, "nobody").count() == 0


@pytest.mark.parametrize("dataset_id", ["plain-1", "a/b: 100% [x] {y}?=*", "ö 'q'"])
def test_datasets_of_different_columns_share_a_store(spark, tmp_path, dataset_id):
    place = str(tmp_path / "rows")
    store.write_dataset(spark.range(3).toDF("a"), place, dataset_id)
    store.write_dataset(spark.createDataFrame([("x", 1.5)], "b string, c double"), place, "other")
    assert store.read_dataset(spark, place, dataset_id).columns == ["a"]
    assert store.read_dataset(spark, place, dataset_id).count() == 3
    assert rows(store.read_dataset(spark, place, "other")) == [("x", 1.5)]
    # Written by column, the folders have the same names.
    by_column = str(tmp_path / "by_column")
    store.write_dataset(spark.range(3).toDF("a"), by_column, F.lit(dataset_id))
    assert store.read_dataset(spark, by_column, dataset_id).count() == 3


def test_shared_folder_is_the_one_the_session_names(spark):
    assert scratch.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch.new_path(spark, "x") != scratch.new_path(spark, "x")
