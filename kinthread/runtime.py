"""The session: code on the executors, the shared folder, stored tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Prepare a session, once: send this package to the executors, and bound Arrow batches.

    A cluster has no shared code folder. Rows here are whole texts, and a batch
    is held by the JVM and by Python at once: BATCH_ROWS rows instead of Spark's
    default, unless the session sets another number.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    if spark.conf.get(_BATCH_CONF) == "10000":
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="kinthread-"), "kinthread.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session has none and runs in local mode (tests) a temporary
    folder of this machine becomes the checkpoint folder; on a cluster, whose
    machines share no temporary folder, its lack is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="kinthread-checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Scratch paths not removed yet, with the session that made them.
_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed by ``release`` or when the session's Python ends."""
    path = f"{shared_dir(spark)}/kinthread-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark writes."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> int:
    """Remove all scratch tables made so far; returns how many.

    For long sessions, between queries: DataFrames made before and not yet
    written or collected can't be read after.
    """
    count = 0
    while _SCRATCH:
        try:
            remove(*_SCRATCH.pop())
            count += 1
        except Exception:  # the session may be gone already
            pass
    return count


atexit.register(release)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs the reread of its files only, and
    whatever uses the table twice computes it once. Columnar and compressed, so
    smaller than a checkpoint of rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
