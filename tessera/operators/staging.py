"""Materialise an intermediate result that several jobs read.

Spark inlines a DataFrame into every plan that uses it, so a shared input
(the cleaned transactions, the order history) would be recomputed per use.
``stage`` writes it once as parquet under the session's checkpoint folder and
returns a reader over the files: lineage is cut (a lost executor re-reads
files instead of re-running the joins), and later readers still get column
pruning and filter pushdown. Results are memoised per (session, key) so jobs
of one run share them.

``stage_by`` also keeps the rows of a key in one bucket, so that groupings and
windows by that key read them without a shuffle.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.slices import SLICE_ROWS
from tessera.session import checkpoint_dir

_STAGED: dict[tuple, DataFrame] = {}
_PATHS: dict[tuple, str] = {}
_TABLES: dict[str, str] = {}  # path -> its table in the session's catalog


def stage(df: DataFrame, key: tuple, enabled: bool = True) -> DataFrame:
    """Write ``df`` once per ``key`` and return a DataFrame over the files."""
    if not enabled:
        return df
    spark: SparkSession = df.sparkSession
    memo = (id(spark), spark.conf.get("spark.app.id", "")) + tuple(key)
    if memo in _STAGED:
        return _STAGED[memo]
    path = f"{checkpoint_dir(spark)}/tessera-stage/{'-'.join(map(str, key[:1]))}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    staged = spark.read.parquet(path)
    _STAGED[memo] = staged
    _PATHS[memo] = path
    return staged


def stage_by(
    df: DataFrame, key: tuple, by: str, buckets: int, enabled: bool = True, hot_rows: int = SLICE_ROWS
) -> DataFrame:
    """``stage`` in ``buckets`` buckets of the column ``by``.

    A bucket is read by one task. That is wrong where one value of ``by`` has
    more than ``hot_rows`` rows: then the same files are read as plain ones,
    split by size, and groupings combine map-side as usual. The values are
    counted from the files, within the buckets."""
    if not enabled:
        return df
    spark: SparkSession = df.sparkSession
    memo = (id(spark), spark.conf.get("spark.app.id", "")) + tuple(key)
    if memo in _STAGED:
        return _STAGED[memo]
    name = f"{key[0]}-{uuid.uuid4().hex}"
    path, table = f"{checkpoint_dir(spark)}/tessera-stage/{name}", f"tessera_stage_{name.replace('-', '_')}"
    rows = df.repartition(buckets, by).write.format("parquet").mode("error").bucketBy(buckets, by)
    _PATHS[memo], _TABLES[path] = path, table
    rows.option("path", path).saveAsTable(table)
    staged = spark.table(table)
    if staged.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).take(1):
        staged = spark.read.schema(staged.schema).parquet(path)
    _STAGED[memo] = staged
    return staged


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the checkpoint folder and read it back, without a
    memo; ``release`` deletes it with the staged tables."""
    spark: SparkSession = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tessera-stage/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    _PATHS[(id(spark), spark.conf.get("spark.app.id", ""), name, path)] = path
    return spark.read.schema(df.schema).parquet(path)


def clear_memo() -> None:
    """Forget staged tables (their files stay)."""
    _STAGED.clear()
    _PATHS.clear()
    _TABLES.clear()


@atexit.register
def _release_at_exit() -> None:
    """The end of the driver's Python, while its session still runs."""
    session = SparkSession.getActiveSession() if _PATHS else None
    if session is not None:
        with contextlib.suppress(Exception):  # a stopped session has nothing to delete with
            release(session)


def release(spark: SparkSession) -> None:
    """End of a run: delete the tables this session staged, so that shared
    storage does not keep a copy of every run's intermediates."""
    app = (id(spark), spark.conf.get("spark.app.id", ""))
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for memo, path in list(_PATHS.items()):
        if memo[:2] != app:
            continue
        if path in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(conf).delete(hpath, True)
        _PATHS.pop(memo, None)
        _STAGED.pop(memo, None)
