"""Session construction and shared-storage helpers.

Library code never picks a storage location of its own: scratch data goes
below the folder the cluster names in ``spark.checkpoint.dir``. Only where that
setting is absent in a local session (tests, the smoke driver) is one made.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes
# (broadcast when a side turns out small, split skewed partitions, coalesce
# tiny shuffle partitions); the time zone is pinned so that timestamp
# arithmetic is the same on every executor.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, app: str = "basketry",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (not used on a cluster)."""
    cpus = int(cpus or os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("BASKETRY_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_job_conf(spark: SparkSession) -> None:
    """Apply the per-session SQL settings to a session made elsewhere."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)


_local_dirs: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder for derived tables: ``spark.checkpoint.dir``, else the
    checkpoint folder the application has set. Only a single-process local
    session gets a temporary folder instead; on a cluster a missing setting is
    an error, because executors would write to their own disks."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
    return _local_dirs.setdefault(spark.sparkContext.applicationId, "") or _local_dir(spark)


def _local_dir(spark: SparkSession) -> str:
    d = tempfile.mkdtemp(prefix="basketry-")
    _local_dirs[spark.sparkContext.applicationId] = d
    return d


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/basketry-scratch/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder for a derived table."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's derived tables. Results that were not written
    elsewhere can't be read afterwards."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
