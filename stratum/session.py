"""Session construction and the shared scratch folder.

On a cluster the scratch folder is whatever ``spark.checkpoint.dir`` names
(a shared file system); without that setting a non-local session is refused,
since a folder of one machine would lose rows there.  Only local sessions
(tests) get a temporary folder of their own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": os.environ.get("STRATUM_DRIVER_MEMORY", "12g"),
}


def get_session(master: str | None = None, app: str = "stratum", **conf) -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None and not conf:
        return active
    b = SparkSession.builder.appName(app)
    master = master or os.environ.get("STRATUM_MASTER")
    if master or not SparkConf().contains("spark.master"):  # a submitted master stays
        b = b.master(master or "local[*]")
    for k, v in {**_LOCAL_CONF, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session; if it is unset, a local
    session gets a fresh folder, registered as the checkpoint dir, and any other
    is refused.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # pragma: no cover - connect sessions have no sparkContext
            d = None
    if not d and not spark.conf.get("spark.master", "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="stratum-ckpt-")
        try:
            spark.sparkContext.setCheckpointDir(d)
        except Exception:  # pragma: no cover - connect sessions have no sparkContext
            pass
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # some deployments reject setting core confs at runtime
            pass
    else:
        try:
            if spark.sparkContext.getCheckpointDir() is None:
                spark.sparkContext.setCheckpointDir(d)
        except Exception:  # pragma: no cover - connect sessions have no sparkContext
            pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new unique path under the scratch folder."""
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss; never localCheckpoint)."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)
