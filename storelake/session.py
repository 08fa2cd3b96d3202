"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every session of ours runs with.  Sizes that depend on the data
# volume (shuffle partitions, file split size) are left to the caller or the
# cluster defaults; AQE coalesces and splits shuffle partitions at runtime.
_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "storelake", extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with our base settings."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001 - remote sessions have no SparkContext
        pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system every executor can reach); leaving it unset there is an error.
    Only a local master, where driver and executors are one process, gets a
    scratch folder of our own, removed when the process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        _set_rdd_checkpoint_dir(spark, configured)
        return configured
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share "
                         f"(master is {master!r})")
    local = tempfile.mkdtemp(prefix="storelake-ckpt-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", local)
    _set_rdd_checkpoint_dir(spark, local)
    return local


def _set_rdd_checkpoint_dir(spark: SparkSession, path: str) -> None:
    """Point ``DataFrame.checkpoint()`` at ``path`` where a SparkContext is
    reachable (classic sessions); remote sessions use the server's setting."""
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:  # noqa: BLE001 - no SparkContext in remote sessions
        pass


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing path under the shared checkpoint folder for a
    written table (the writer creates it)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str = "stage"):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    return a DataFrame reading it back.

    This cuts the lineage like ``checkpoint()`` but computes the plan once
    (an RDD checkpoint of an unpersisted plan runs it twice: once for the
    count, once for the write), survives lost executors (the files are on the
    shared folder) and gives the planner exact sizes for the next joins.
    ``discard`` deletes it again.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


@contextmanager
def settings(spark: SparkSession, **conf):
    """Run the actions inside with these SQL settings (``__`` for a dot), then restore the old ones."""
    names = {k.replace("__", "."): str(v) for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


ROWS_PER_TASK = 1 << 20        # rows that a task of a large shuffle gets: 100 to 350 MB of sorts and joins
TASK_READ = "16m"              # shuffled (compressed) bytes that AQE gives one task


def size_shuffles(spark: SparkSession, rows: int, usual: dict[str, str | None]) -> None:
    """Let the number of shuffle tasks follow the rows of a job's largest table, so that the memory of a task does
    not.  ``usual`` holds the session's own settings; a job of few rows runs with them."""
    chosen = dict(usual)
    if rows > ROWS_PER_TASK:
        chosen = {SHUFFLE_TASKS: str(max(int(usual[SHUFFLE_TASKS]), -(-rows // ROWS_PER_TASK))), ADVISORY_SIZE: TASK_READ}
    for k, v in chosen.items():
        if v is None:
            spark.conf.unset(k)
        elif spark.conf.get(k) != v:
            spark.conf.set(k, v)


SHUFFLE_TASKS, ADVISORY_SIZE = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def local_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as tasks can open it themselves, None if it is not on a (shared, mounted) local file system."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote sessions have no SparkContext
        return None
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(sc._jsc.hadoopConfiguration())
    if system.getUri().getScheme() != "file":
        return None
    return system.makeQualified(target).toUri().getPath()


def discard(*tables) -> None:
    """Delete tables that ``materialize`` returned and that no later plan reads;
    other DataFrames are left alone."""
    for df in tables:
        path = vars(df).pop("_scratch_path", None)
        if path is not None:
            delete_folder(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    It does so when the driver's JVM collects the plans that wrote them, which may be long after a
    multi-round job is done with them.  For jobs that write large shuffles step by step.
    """
    gc.collect()                 # plans that only dead Python objects hold
    try:
        spark.sparkContext._jvm.java.lang.System.gc()
    except Exception:  # noqa: BLE001 - remote sessions have no SparkContext; the server collects on its own
        pass


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system (whatever Hadoop file system its path names)."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote sessions have no SparkContext: the folder stays until the shared one goes
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
