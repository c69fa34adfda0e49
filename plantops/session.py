"""Session defaults.

AQE is on so that shuffle partitions are coalesced at runtime, sort-merge
joins are turned into broadcast joins only when the *measured* side is small,
and skewed join partitions are split.  The checkpoint folder is read from the
session (``spark.checkpoint.dir``); a private one is only created when the
session does not name one, which is the local/test case.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str | None = None, app: str = "plantops",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Uses ``spark.checkpoint.dir`` when the session names one.  When it is
    unset, a local session (tests) gets a fresh private folder; on a cluster
    that would not be shared, so it raises.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="plantops-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


#: folder of the innermost open :func:`run_folder`; threads start without one
_run: ContextVar[str | None] = ContextVar("plantops_run", default=None)


@contextmanager
def run_folder(spark: SparkSession):
    """A scope for what the operators stage: rows written once to the shared
    folder by calls inside it lie in one new folder, which is removed at the
    end, after an exception too.  Results must be written or collected inside.
    Frames that calls inside return, or an ``Erp`` first built inside keeps, read
    that folder and can't be used afterwards.
    Without a scope staged rows stay until the owner of the shared folder
    removes them.  A store (:mod:`plantops.sources.store`) outlives the scope."""
    folder = sub_dir(checkpoint_dir(spark), f"plantops-run-{uuid.uuid4().hex}")
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)
        remove(spark, folder)


def staging(spark: SparkSession, label: str) -> str:
    """A new path for rows to stage: in the open :func:`run_folder`, else
    directly in the shared folder."""
    return sub_dir(_run.get() or checkpoint_dir(spark), f"plantops-{label}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder if it is there, on whatever file system it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def sub_dir(base: str, *parts: str) -> str:
    if "://" in base:
        return "/".join([base.rstrip("/"), *parts])
    return os.path.join(base, *parts)
