"""Small tables made on the driver, and written tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small table of known rows, whose size the planner knows and can broadcast by."""
    arrow = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.table(columns, schema=arrow), schema)


LOCAL_FOLDER = "sparkboard.local.folder"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; on a local session without one, a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(LOCAL_FOLDER, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder which all executors share")
    folder = tempfile.mkdtemp(prefix="sparkboard-")
    spark.conf.set(LOCAL_FOLDER, folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet."""
    return f"{shared_folder(spark).rstrip('/')}/sparkboard/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The result does not depend on the executors which computed it, it is computed once however
    often it is used, and the planner knows its size: a small one is broadcast, a large one is not.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table of `materialize` which nothing reads any more; others are left alone."""
    written = getattr(df, "written_at", None)
    if written:
        session = df.sparkSession._jsparkSession
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(written)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)
