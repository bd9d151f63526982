"""Session construction and the few session-level settings the jobs rely on."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job assumes. They are SQL confs, so they can be applied to a
# session that somebody else built (the driver's, a notebook's).
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.exchange.reuse": "true",
    # texts can be long: batches for Python are bounded in rows and in bytes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_session(
    master: str | None = None,
    app_name: str = "tessera",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session for tests and the benchmark. On a cluster, pass master=None and
    let spark-submit decide; ``shuffle_partitions`` should then be sized so one
    shuffle partition holds roughly 128-256 MB at the target scale."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SQL_DEFAULTS)
    conf.update(
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
        }
    )
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    for key, value in SQL_DEFAULTS.items():
        spark.conf.set(key, value)
    ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once per application),
    wherever they were started from."""
    root, app = Path(__file__).parent, spark.sparkContext.applicationId
    if app in _SHIPPED or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="tessera-py-")) / "tessera-package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir`` or the
    context's checkpoint directory.

    Where neither is set, a local master (tests) gets a private folder; on a
    cluster that is an error, as each executor would write to its own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
