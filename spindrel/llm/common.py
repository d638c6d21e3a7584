"""What the operators of this subpackage share: the shared folder, written tables, safe columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Folders written by this session, for :func:`purge`.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where none is named, a local session (as in tests) gets a folder of this machine; a cluster
    is refused, since its executors would not see that folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.conf.get("spark.master", "") or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spindrel-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    A lost executor then costs at most the tasks since this table, and nothing is kept on
    an executor's own disk.  The folders stay until :func:`purge` since results are lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spindrel/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    # The shuffle files and plans behind it are of no more use; Spark drops them when collected.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Remove the tables written so far.  Call it once the results have been stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(column: str = "doc_id"):
    """crc32 of an id written as text, unsigned.  A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def id_key(docs: DataFrame, column: str = "doc_id") -> Column:
    """An id to group and order by: whole numbers as longs, all else as text; never null, so null
    ids must be told apart besides."""
    whole = isinstance(docs.schema[column].dataType, IntegralType)
    return F.coalesce(F.col(f"`{column}`").cast("bigint" if whole else "string"), F.lit(0).cast("bigint") if whole else F.lit(""))
