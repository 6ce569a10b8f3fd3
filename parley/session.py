"""Session construction and shared-folder helpers.

Library code never picks a master: on a cluster the session comes from
``spark-submit``.  ``build_session`` is for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(
    master: str | None = None,
    app_name: str = "parley",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session tuned for columnar scans, AQE and Arrow transfer."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.caseSensitive": "false",
        "spark.driver.memory": "16g",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and read it from there."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like ``cut_lineage``, but
    compressed, for wide rows."""
    path = scratch_path(df.sparkSession, "tables", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a
    shared, fault-tolerant folder there).  Only when it is unset and the master
    is local — tests and local runs — a fallback is installed: the given folder,
    or a fresh temporary one.  On a cluster an unset folder is an error, since
    executors would each write to their own disk.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not fallback and not _is_local(spark):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = fallback or tempfile.mkdtemp(prefix="parley-ckpt-")
    os.makedirs(folder, exist_ok=True)
    spark.sparkContext.setCheckpointDir(folder)
    try:
        spark.conf.set(CHECKPOINT_CONF, folder)
    except Exception:  # core confs may be read-only at runtime
        pass
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder."""
    return "/".join([checkpoint_root(spark), *parts])


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``parley`` importable on every executor's Python workers.

    Functions that run in Python workers (stateful stream handlers, batched
    predict UDFs) are imported there by module name, so the package is zipped
    once per SparkContext and added with ``addPyFile`` — the programmatic twin
    of ``spark-submit --py-files``.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="parley-pkg-")
    archive = os.path.join(folder, "parley.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _dirs, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    _SHIPPED.add(app)
