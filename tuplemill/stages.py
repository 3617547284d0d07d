"""Materialised steps: a table that is read more than once is written to the shared folder first."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-stages-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Local sessions without that setting use a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _local_folder(spark.sparkContext.applicationId)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str, dense: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back; ``dense`` takes more time to make it smaller."""
    path = shared_path(df.sparkSession, name)
    (df.write.option("compression", "zstd") if dense else df.write).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.settled_path = path
    return back


@contextmanager
def joined_where_dealt(spark: SparkSession):
    """Meanwhile, joins of tables that are both dealt by some of the join's columns don't deal them by all of these again, and
    buckets are read as such below unions too."""
    names = ["spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.sources.bucketing.autoBucketedScan.enabled"]
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "false")
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def bucketed(df: DataFrame, name: str, by: str, *order: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``by``, sorted by it and ``order``, and read back as a table that ``forget`` drops.

    There are as many buckets as shuffles have parts: rows that are dealt by ``by`` make a file each, and later groupings and joins by
    it, and by more if ``joined_where_dealt``, take the rows from where they are.
    """
    spark = df.sparkSession
    path, table = shared_path(spark, name), f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.options(compression="zstd", path=path).bucketBy(parts, by).sortBy(by, *order).saveAsTable(table)
    back = spark.table(table)
    back.settled_path, back.settled_table = path, table
    return back


def forget(*tables: DataFrame) -> None:
    """Removes materialised tables that nothing will read again; what was made from them must be written by now."""
    for df in tables:
        spark = df.sparkSession
        if hasattr(df, "settled_table"):
            spark.sql(f"DROP TABLE {df.settled_table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
