"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "attrix") -> SparkSession:
    """Session for tests and the bench (local mode, UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ATTRIX_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the setting names a folder that the driver and every executor
    share, and it is used as is.  Without it a cluster session raises: files
    that executors write to their own disks are invisible to later readers.
    Only a local master, where all tasks run in this process, gets a private
    temporary folder.
    """
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not context.getCheckpointDir():
            context.setCheckpointDir(current)
        return current
    current = context.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    current = tempfile.mkdtemp(prefix="attrix-ckpt-")
    spark.conf.set("spark.checkpoint.dir", current)
    context.setCheckpointDir(current)
    return current


def ship_code(spark: SparkSession) -> None:
    """Give the workers this package, once a context: sent as a zip by Spark
    itself, so it needs no folder that driver and executors share."""
    context = spark.sparkContext
    if getattr(context, "_attrix_code", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(prefix="attrix-code-"), "attrix_code.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                if os.path.basename(folder) == "__pycache__":
                    continue
                # without entries of their own, folders without __init__.py can't be imported from a zip
                z.write(folder, os.path.join("attrix", os.path.relpath(folder, root)) if folder != root else "attrix")
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("attrix", os.path.relpath(full, root)))
        context.addPyFile(path)
    context._attrix_code = True


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared checkpoint folder, deleted when the session's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/attrix-materialized/{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside leave no shuffle files behind: Spark removes them when the
    job ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df, label: str = "frame", **options):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return a reader over it.  Used where a frame is read several times (cut
    points, kernel branches): it cuts lineage, so an executor loss re-reads
    the files instead of replaying the upstream joins.  The files go when the
    session's JVM ends.  ``options`` are those of the writer."""
    path = shared_path(df.sparkSession, label)
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
