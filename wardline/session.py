"""Session settings the package relies on, and the shared folder for written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session-level settings, valid on a running session too.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_CONF` to ``spark`` and return it. A local session gets as many shuffle
    tasks as it has cores; on a cluster that number stays as configured there."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    if in_one_process(spark):
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def in_one_process(spark: SparkSession) -> bool:
    """Whether the executor is a thread of the driver, which makes a machine's folders shared ones."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def local_session(app: str = "wardline", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session spark-submit gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A machine-local folder is made up only for a local master, where it *is* shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not in_one_process(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="wardline-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark)}/wardline-{name}-{uuid.uuid4().hex}"

