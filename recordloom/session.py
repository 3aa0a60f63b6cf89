"""Session factory and the one place that decides where intermediate tables live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "recordloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and last-wins map merging; `conf` overrides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, a temporary one on a single machine, and an error on a cluster."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root
    root = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        root = tempfile.mkdtemp(prefix="recordloom-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir()


#: Narrow rows of a partition of an intermediate table.
NARROW_ROWS = 500_000


def parts_of(spark: SparkSession, rows: int) -> int:
    """Partitions for an intermediate table of that many narrow rows: two a core, so that all have work, and more as it grows."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // NARROW_ROWS))


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut lineage through reliable storage, so a lost executor costs a reread and not a recomputation.  parts: files at most; small tables in many files cost more to open than to read."""
    checkpoint_root(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written intermediate table, inside the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
