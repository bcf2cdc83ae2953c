"""The dataset store: rows by dataset, one catalog record per dataset, rows as JSON documents."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkboard.functions.naming import dataset_name
from sparkboard.functions.values import nan_to_null
from sparkboard.operators.profile import cast_by_profile, merged_parts, profile, profile_of_parts, profile_parts
from sparkboard.sources.buckets import Table
from sparkboard.sources.csv import read_csv_once
from sparkboard.sources.scratch import discard, materialize

COLUMNS_TYPE = "array<struct<name:string,type:string>>"


def rows_as_json(df: DataFrame, name: str = "data") -> DataFrame:
    """Each row as one JSON document; nulls stay in it as `null`."""
    document = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return df.select(document.alias(name))


_FOLDER = "__dataset"


def _dataset_folder(path: str, dataset_id: str) -> str:
    return f"{path}/{_FOLDER}={hashlib.sha256(dataset_id.encode()).hexdigest()}"


def write_dataset(df: DataFrame, path: str, dataset_id: str | Column) -> None:
    """Append rows under their dataset id; each dataset has a folder (a digest of its id) and a schema of its own.

    A column as id writes rows of several datasets which have the same columns. All columns are kept.
    """
    if isinstance(dataset_id, str):
        df.write.mode("append").parquet(_dataset_folder(path, dataset_id))
    else:
        if _FOLDER in df.columns:
            raise ValueError(f"a column cannot be named {_FOLDER}")
        named = F.sha2(F.coalesce(dataset_id.cast("string"), F.raise_error(F.lit("a row without a dataset id"))), 256)
        df.withColumn(_FOLDER, named).write.mode("append").partitionBy(_FOLDER).parquet(path)


def read_dataset(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """The rows of one dataset; the folders of others are not opened."""
    return spark.read.parquet(_dataset_folder(path, dataset_id))


def dataset_record(
    spark: SparkSession,
    columns: DataFrame,
    file_name: str,
    dataset_id: str,
    owner: str = "anonymous",
    session_id: str | None = None,
    location: str | None = None,
) -> DataFrame:
    """The catalog record of a dataset, from its profile (`operators.profile.profile`)."""
    in_order = F.array_sort(F.collect_list(F.struct("ordinal", "name", "type")))
    return columns.agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).cast("int").alias("column_count"),
        F.transform(in_order, lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type")))
        .alias("columns"),
    ).select(
        F.lit(dataset_id).alias("dataset_id"),
        dataset_name(F.lit(file_name)).alias("dataset_name"),
        F.lit(owner).alias("owner_uid"),
        F.lit(session_id or dataset_id).alias("session_id"),
        "row_count",
        "column_count",
        "columns",
        F.current_timestamp().alias("created_at"),
        F.lit(location).cast("string").alias("location"),
    )


def lookup(datasets: DataFrame, dataset_id: str) -> DataFrame:
    """The record of one dataset, the newest if it was uploaded again: no row or one."""
    mine = datasets.filter(F.col("dataset_id") == F.lit(dataset_id))
    return latest_per_session(mine, "dataset_id", "created_at", "location")


def latest_per_session(
    datasets: DataFrame, session: str = "session_id", created: str = "created_at", id: str = "dataset_id"
) -> DataFrame:
    """The newest record of every session; of equal times, the one with the larger id."""
    newest = F.max_by(F.struct("*"), F.struct(created, id)).alias("newest")
    return datasets.groupBy(F.col(session).alias("__session")).agg(newest).select("newest.*")


def latest_of_session(datasets: DataFrame, session_id: str) -> DataFrame:
    """The newest record of one session."""
    mine = datasets.filter(F.col("session_id") == F.lit(session_id))
    return mine.orderBy(F.desc("created_at"), F.desc("dataset_id")).limit(1)


RECORD = T.StructType([
    T.StructField("dataset_id", T.StringType()), T.StructField("dataset_name", T.StringType()),
    T.StructField("owner_uid", T.StringType()), T.StructField("session_id", T.StringType()),
    T.StructField("row_count", T.LongType()), T.StructField("column_count", T.IntegerType()),
    T.StructField("columns", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))),
    T.StructField("created_at", T.TimestampType()), T.StructField("location", T.StringType()),
])


#: The parts of profiles (`operators.profile.profile_parts`), by dataset.
PARTS = T.StructType([
    T.StructField("dataset_id", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("non_null", T.LongType()),
    T.StructField("kinds", T.IntegerType()), T.StructField("whole", T.IntegerType()), T.StructField("places", T.IntegerType()),
    T.StructField("distinct", T.BinaryType()),
])


@dataclass(frozen=True)
class Catalog:
    """The records of a store, dealt by dataset and, a second time, by session, so that either lookup opens one bucket."""

    spark: SparkSession
    path: str
    buckets: int = 64

    @property
    def by_dataset(self) -> Table:
        return Table(self.spark, f"{self.path}/by_dataset", "dataset_id", RECORD, self.buckets)

    @property
    def by_session(self) -> Table:
        return Table(self.spark, f"{self.path}/by_session", "session_id", RECORD, self.buckets)

    def add(self, records: DataFrame, upload_id: str | None = None) -> None:
        """Add records; with an upload id, adding them again changes nothing."""
        written = materialize(records, "records")
        for table in (self.by_session, self.by_dataset):
            table.append(written, upload_id)
        discard(written)

    def dataset(self, dataset_id: str) -> DataFrame:
        """The newest record of a dataset: no row or one."""
        return latest_per_session(self.by_dataset.lookup(dataset_id), "dataset_id", "created_at", "location")

    def session(self, session_id: str) -> DataFrame:
        """The newest record of a session: no row or one."""
        return latest_of_session(self.by_session.lookup(session_id), session_id)

    def records(self) -> DataFrame:
        return self.by_dataset.read()

    @property
    def parts(self) -> Table:
        return Table(self.spark, f"{self.path}/profile_parts", "dataset_id", PARTS, self.buckets)

    def add_profile(self, dataset_id: str, rows: DataFrame, upload_id: str) -> None:
        """Take rows appended to a dataset into its profile: they alone are read, and once per upload id."""
        self.parts.append(profile_parts(rows).select(F.lit(dataset_id).alias("dataset_id"), "*"), upload_id)

    def profile(self, dataset_id: str, all_null: str = "text") -> DataFrame:
        """The profile of all rows of a dataset that `add_profile` has seen; no row for an unknown dataset."""
        return profile_of_parts(merged_parts(self.parts.lookup(dataset_id)), all_null)

    def compact(self) -> None:
        """Many small files to one a bucket. Of a dataset uploaded again the newest record stays; sessions keep all."""
        self.by_dataset.compact([F.desc("created_at"), F.desc_nulls_last("location")])
        self.by_session.compact()


def catalog_of(spark: SparkSession, store: str) -> Catalog:
    return Catalog(spark, f"{store.rstrip('/')}/catalog")


def read_uploaded(spark: SparkSession, store: str, dataset_id: str) -> DataFrame:
    """The rows of an uploaded dataset, as its record says."""
    record = catalog_of(spark, store).dataset(dataset_id).head()
    if record is None:
        raise ValueError(f"no dataset {dataset_id!r} in {store}")
    return spark.read.parquet(record["location"])


@dataclass(frozen=True)
class Upload:
    """What an upload leaves behind: typed rows, the profile of the columns, the catalog record."""

    rows: DataFrame
    columns: DataFrame
    record: DataFrame


def upload_csv(
    spark: SparkSession,
    path: str,
    store: str,
    dataset_id: str | None = None,
    file_name: str | None = None,
    owner: str = "anonymous",
    session_id: str | None = None,
    encoding: str = "auto",
    multiline: bool | str = "auto",
) -> Upload:
    """CSV to a stored dataset: clean names, types found from all values, typed Parquet rows.

    Without an id the dataset gets a new one. Every upload has a folder of its own, and its record is
    what makes it count: uploaded again, an id stands for the newer rows, and an upload which failed for none.
    """
    dataset_id = dataset_id or str(uuid.uuid4())
    text = read_csv_once(spark, path, encoding, multiline)
    columns = profile(text.drop("row_number"), all_null="numeric")
    rows = nan_to_null(cast_by_profile(text, columns))
    location = f"{store.rstrip('/')}/rows/{uuid.uuid4().hex}"
    rows.write.parquet(location)
    name = file_name or path.rstrip("/").rsplit("/", 1)[-1]
    record = dataset_record(spark, columns, name, dataset_id, owner, session_id, location)
    catalog = catalog_of(spark, store)
    catalog.add(record, location.rsplit("/", 1)[-1])
    return Upload(spark.read.parquet(location), columns, catalog.dataset(dataset_id))
