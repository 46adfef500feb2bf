"""Shared helpers: tables in the shared folder, word and text expressions."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but these six ASCII white-space bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Arrow batches of texts stay small, on either side; a session's own values are left alone.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is not installed but run from a checkout; bound Arrow batches."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or a local one where that is unset and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tilewright/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, lost executors cost nothing.

    The shuffle files of the query that is written are given up at its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, label), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tilewright_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote, once nothing that is still to run reads it."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tilewright_path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names: what an operator adds replaces a column of the same name."""
    gone = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in gone])


def fresh(df: DataFrame, name: str) -> str:
    """A name like this that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def give_back() -> None:
    """Let the system have what a Python worker has freed; workers live on between tasks."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def with_columns(df: DataFrame, run, fields: list[T.StructField]) -> DataFrame:
    """df with the columns that run adds to its Arrow batches, behind its own; columns of any names travel under plain ones."""
    plain, new = [f"c{k}" for k in range(len(df.columns))], [f"r{k}" for k in range(len(fields))]
    schema = [*(T.StructField(n, f.dataType) for n, f in zip(plain, df.schema.fields, strict=True)), *(T.StructField(n, f.dataType) for n, f in zip(new, fields, strict=True))]

    def whole(batches):
        yield from run(batches)
        give_back()

    return df.toDF(*plain).mapInArrow(whole, T.StructType(schema)).toDF(*df.columns, *(f.name for f in fields))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
