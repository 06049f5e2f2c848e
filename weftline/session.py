"""Session and tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution. On a cluster, use the session that is there."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("weftline")
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for k, v in {**fixed, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Bytes of a batch of rows that Python workers get at most (a row more, where one alone has more).
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it (on a cluster: the same path, or --py-files), and
    bound the batches that they get by bytes: rows are pages and texts of any length."""
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not size.rstrip("b").isdigit() or int(size.rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its timestamps in the session's zone, UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors see, in ``spark.checkpoint.dir``; where that is unset, on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or "file://" + os.path.join(tempfile.gettempdir(), "weftline-scratch")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """What tells whether a table has changed: when its folder did, its bytes and its files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    held = system.getContentSummary(where)
    return system.getFileStatus(where).getModificationTime(), held.getLength(), held.getFileCount()
