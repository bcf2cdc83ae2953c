"""Stored tables that can be changed: rows dealt to buckets by a key, each upload in a folder of its own.

A table is a folder `__bucket=…/__upload=…/` of Parquet files. A row's bucket follows from the hash of its
key, so a lookup by key opens one bucket, and a change rewrites the buckets of its keys alone. An upload
writes its folders again when it is repeated, so a retried write leaves its rows once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from sparkboard.functions.values import quoted
from sparkboard.sources.scratch import discard, materialize

BUCKET, UPLOAD = "__bucket", "__upload"
OWN = (BUCKET, UPLOAD)


@dataclass(frozen=True)
class Table:
    """A stored table: where it is, the key its rows are dealt by, and into how many buckets.

    The number of buckets belongs to the table: it is chosen once, by the size the table will reach. Keys are
    compared as text; a null key has a bucket like any other. One writer at a time changes a table.
    """

    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    buckets: int = 64

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _folders(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _scan(self) -> DataFrame:
        _, path, files = self._folders()
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType()), T.StructField(UPLOAD, T.StringType())])
        if not files.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def _write(self, rows: DataFrame) -> None:
        # Only the folders which get rows are replaced. A bucket is written by one task unless it is large.
        rows.select(*[quoted(n) for n in self.schema.names], *OWN).repartition(*OWN).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(*OWN).parquet(self.path)

    def append(self, rows: DataFrame, upload_id: str | None = None) -> None:
        """Add rows. The same upload id again replaces what that upload wrote: a retry leaves the rows once.

        A retry has to bring the same keys; folders of buckets it brings no row for stay.
        """
        missing = [n for n in self.schema.names if n not in rows.columns]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}")
        typed = rows.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        self._write(typed.withColumns({BUCKET: self._bucket(quoted(self.key)), UPLOAD: F.lit(upload_id or uuid.uuid4().hex)}))

    def read(self) -> DataFrame:
        return self._scan().drop(*OWN)

    def lookup(self, *keys: str | int) -> DataFrame:
        """The rows of these keys; other buckets are not opened."""
        return self._of(self._scan(), keys).drop(*OWN)

    def _of(self, scan: DataFrame, keys: Sequence[str | int]) -> DataFrame:
        texts = [F.lit(str(k)) for k in keys]
        # Constants, folded while the query is planned: they prune the folders.
        return scan.where(F.col(BUCKET).isin(*[self._bucket(t) for t in texts])).where(quoted(self.key).cast("string").isin(*texts))

    def delete(self, keys: DataFrame) -> None:
        """Delete the rows whose key is in the first column of `keys`. Only the buckets of these keys are rewritten.

        A delete which was interrupted may be repeated. Keys nobody has and null keys change nothing.
        """
        gone = materialize(keys.select(F.col(keys.columns[0]).cast("string").alias("__gone")).dropna().distinct(), "gone-keys")
        hit = [r[0] for r in gone.select(self._bucket(F.col("__gone"))).distinct().collect()]  # at most one per bucket
        if hit:
            touched = self._scan().where(F.col(BUCKET).isin(hit))
            self._replace(touched, touched.join(gone, quoted(self.key).cast("string") == F.col("__gone"), "left_anti"))
        discard(gone)

    def compact(self, newest: Sequence[Column] | None = None) -> None:
        """Rewrite every bucket as one upload; with `newest`, only the first row of each key in that order stays."""
        everything = self._scan()
        kept = everything
        if newest is not None:
            first = Window.partitionBy(quoted(self.key)).orderBy(*newest)
            kept = kept.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        self._replace(everything, kept.withColumn(UPLOAD, F.lit(f"compacted-{uuid.uuid4().hex}")))

    def _replace(self, before: DataFrame, after: DataFrame) -> None:
        """Put the rows of `after` in the place of the folders that `before` was read from."""
        old = {(r[0], r[1]) for r in before.select(*OWN).distinct().collect()}  # one row per folder
        # Read before it is overwritten.
        kept = materialize(after, "kept-rows")
        new = {(r[0], r[1]) for r in kept.select(*OWN).distinct().collect()}
        if new:
            self._write(kept)
        jvm, _, files = self._folders()
        for bucket, upload in old - new:
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={bucket}/{UPLOAD}={upload}"), True)
        discard(kept)
