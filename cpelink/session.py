"""Session and shared-storage helpers.

Every job reads its shared scratch location from the session
(``spark.checkpoint.dir``). A local directory is created only under a local
master without that setting, which happens in tests and local benches.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "cpelink") -> SparkSession:
    """Session for tests and local benches (no UI, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Cluster-shared folder for written intermediate tables.

    Reads the session's ``spark.checkpoint.dir``. Only a local master (tests,
    benches: driver and tasks share one machine) gets a private folder when
    the setting is absent; on any other master an unset folder is an error,
    because a machine-local folder would scatter the rows over the executors.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not conf_dir:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        # the setting itself cannot be changed in a running session; the context remembers the folder
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cpelink-ckpt-"))
        conf_dir = spark.sparkContext.getCheckpointDir()
    return conf_dir


#: Application -> thread -> intermediate folders in the order they were made.
_WRITTEN: dict[str, dict[int, list[str]]] = {}


def _held(spark: SparkSession) -> list[str]:
    """Folders that this thread has made in this application."""
    return _WRITTEN.setdefault(spark.sparkContext.applicationId, {}).setdefault(threading.get_ident(), [])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder (never reused).

    The path is remembered until ``release_scratch`` or the end of the
    application removes it.
    """
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        atexit.register(_release_at_exit, spark, app)
    _held(spark).append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_count(spark: SparkSession) -> int:
    """How many intermediate folders this thread holds; a mark for ``release_scratch``."""
    return len(_held(spark))


def release_scratch(spark: SparkSession, since: int | None = None, keep: int = 0) -> int:
    """Remove intermediate tables, once the DataFrames built on them have been written out.

    Without ``since`` all of the application go; with it those that this thread
    has made from the mark on, but for the newest ``keep``. Returns how many.
    """
    if since is None:
        paths = [p for held in _WRITTEN.pop(spark.sparkContext.applicationId, {}).values() for p in held]
    else:
        held = _held(spark)
        end = max(since, len(held) - keep)
        paths, held[since:end] = held[since:end], []
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def _release_at_exit(spark: SparkSession, app: str) -> None:
    try:
        if spark.sparkContext.applicationId == app and spark.sparkContext._jsc is not None:
            release_scratch(spark)
    except Exception:  # the JVM may be gone already; its folder then stays for the cluster's own clean-up
        _WRITTEN.pop(app, None)


def materialize(df: DataFrame, name: str = "stage", compression: str = "snappy") -> DataFrame:
    """Cut lineage of a reused intermediate by writing it as a Parquet table.

    The rows are computed once, written below the session's shared
    checkpoint folder and read back, so the source (e.g. a large inventory)
    is scanned once even when the result feeds several joins; the planner
    then sees the real file size for its broadcast decision, and a lost
    executor re-reads the table instead of recomputing from raw inputs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``cpelink`` importable in the Python workers (once per application).

    The package is zipped on the driver and registered with ``addPyFile``,
    which distributes it to every executor like ``--py-files`` would.
    """
    import zipfile

    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    # Code staging on the driver (like --py-files), not data: Spark serves the
    # file to every executor from the driver, so no executor reads this path.
    zpath = os.path.join(tempfile.mkdtemp(prefix="cpelink-pyfiles-"), "cpelink.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("cpelink", os.path.relpath(full, pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
