"""Readers for the parquet test tables.

Every read is lazy and plain: Catalyst prunes columns and pushes filters into
the scan, and how files are split is left to ``spark.sql.files.*``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """Size and time of change of each table (a file or a folder), so that a
    session sees that its inputs were replaced."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in BASE_TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            status = fs.getFileStatus(path)
            out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def table_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Size of a table's files (one file or a folder)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def read_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> dict[str, DataFrame]:
    return {name: read_table(spark, sf_dir, name) for name in names}
