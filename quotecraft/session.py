"""SparkSession construction and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for every job in this library.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quotecraft", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``spark.sql.shuffle.partitions`` to the data (AQE coalesces small ones).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "8g")   # local mode: the driver runs the tasks
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, as the cluster names it.

    Read from the context's checkpoint dir or ``spark.checkpoint.dir``.  Only
    when neither is set -- local runs and tests -- a private folder is made and
    registered as the checkpoint dir, so later calls agree.  Sessions without
    a SparkContext (Spark Connect) use the configuration value.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- Spark Connect: no context on the client
        sc = None
    path = sc.getCheckpointDir() if sc is not None else None
    if not path:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            master = spark.conf.get("spark.master", "") or ""
            if not re.fullmatch(r"local(\[[^\]]*\])?", master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share; "
                                   f"master {master!r} has no use for a folder of this machine")
            path = tempfile.mkdtemp(prefix="quotecraft-")
        if sc is not None:
            sc.setCheckpointDir(path)
            path = sc.getCheckpointDir() or path
    return path


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh location under the shared folder for one written table."""
    base = shared_dir(spark)
    sep = "" if base.endswith("/") else "/"
    return f"{base}{sep}tables/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for local-only helpers (tests)."""
    return path[5:] if path.startswith("file:") else path


__all__ = ["get_session", "shared_dir", "new_table_path", "local_path"]
