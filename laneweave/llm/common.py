"""Helpers shared by the corpus operators: input columns, staged tables, folds."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch; texts are long, so batches are kept short.
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20
#: Bytes of a table for which those made from it get a file each, and the least number of files they may have.
FILE_OF_BYTES, LEAST_FILES = 4 << 20, 8

_local_dirs: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the text that one Arrow batch carries."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Only where the session names none (a single-machine run, such as a test)
    a temporary folder stands in for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        holder = tempfile.TemporaryDirectory(prefix="laneweave-")
        atexit.register(holder.cleanup)
        _local_dirs[app] = f"file://{holder.name}"
    return _local_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/laneweave/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path.getParent())
    fs.deleteOnExit(hadoop_path)
    return path


def staged(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no earlier stage, and what
    follows reads the rows as often as it likes. ``files`` bounds the number of
    files (and so the tasks of the last stage), for tables of few rows in many
    partitions: on local paths Hadoop starts processes for each file it writes.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_beside(table: DataFrame) -> int:
    """Files for staged tables that are made from ``table``, by its bytes as Spark estimates them (of a staged one: those of its files)."""
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(LEAST_FILES, int(str(size)) // FILE_OF_BYTES)


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus`` (null where the id is null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """True for the fold that no model learns from; null ids are never learned from."""
    return F.coalesce(fold(column, modulus) == remainder, F.lit(True))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
