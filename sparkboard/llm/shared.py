"""Written tables between steps, and the columns operators take."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkboard.sources.scratch import new_path

SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def column(name: str) -> Column:
    """A column by its plain name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def valid_text(name: str) -> Column:
    """A column as text for Python: bytes which are not UTF-8 (a Spark string may hold any) become U+FFFD."""
    return F.make_valid_utf8(column(name).cast("string"))


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores behind it as keep it apart from those taken, whatever their case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table written to the folder all executors share and read back.

    Lost executors cost nothing that is written, later plans start here, and the planner knows the size.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `saved` that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(conf).delete(path, True)


def smallest_hash(df: DataFrame, keys: list[str], rows: int, of: int) -> DataFrame:
    """A bounded sample which depends on the rows alone: those with the smallest hashes of the keys.

    `of` is about how many rows there are. Rows whose hash is far from the smallest are left out first, so
    that all tasks together send about twice the sample; only if too few are left (the hashes of many equal
    rows lie together) are all looked at. Rows with equal keys count once.
    """
    hashed = df.withColumn("__hash", F.xxhash64(*[column(k) for k in keys]))
    share = 2.0 * rows / max(of, 1) + 1e-6
    order = ["__hash", *[column(k) for k in keys]]
    if share < 0.5:
        near = hashed.where(F.col("__hash") < int(-(2**63) + share * 2**64))
        picked = near.dropDuplicates(keys).orderBy(*order).limit(rows)
        if picked.count() == rows:
            return picked.drop("__hash")
    return hashed.dropDuplicates(keys).orderBy(*order).limit(rows).drop("__hash")


def most_frequent(counts: DataFrame, key: str, size: int) -> list:
    """The (key, n) rows of the largest counts, the largest first, at most `size`, on the driver.

    Counts are cut between ranges of an eighth of a power of two, so that no task sends more than what is
    asked for: fewer rows come where a whole range does not fit any more.
    """
    ranged = counts.withColumn("__range", F.floor(F.log2("n") * 8).cast("int"))
    least, left = None, size
    for r in ranged.groupBy("__range").count().orderBy(F.desc("__range")).collect():  # at most 504 rows
        left -= r["count"]
        if left < 0:
            break
        least = r["__range"]
    if least is None:
        return []
    found = ranged.where(F.col("__range") >= least).select(key, "n").collect()
    return sorted(found, key=lambda r: (-r["n"], bytes(r[key])))


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shipped(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, and texts in small batches.

    A batch is bounded by its bytes (4 MB, unless the session says otherwise than Spark does), so that long
    texts take no more of a worker's memory than short ones.
    """
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    context = spark.sparkContext
    if getattr(context, "_sparkboard_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # The driver's own file: addPyFile copies it to the executors.
    archive = os.path.join(tempfile.mkdtemp(prefix="sparkboard-code-"), "sparkboard_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(archive)
    context._sparkboard_shipped = True
