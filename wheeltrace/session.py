"""Session helpers: a tuned builder for local use and durable intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cores: int | str = 8, app: str = "wheeltrace") -> SparkSession:
    """Single-machine session used by tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        # small test data: keep enough tasks for the cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is used only when that is
    unset *and* the session is a single local JVM; on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    # local[...] runs in one process; local-cluster[...] has executors of its own, like any cluster
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="wheeltrace-")
    return _LOCAL_ROOTS[app]


def scratch_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return os.path.join(scratch_root(spark), "wheeltrace", spark.sparkContext.applicationId)


def release(spark: SparkSession) -> None:
    """Delete the application's intermediate tables; results that still read them become invalid."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def size_in_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate; for a written table that is its file size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def materialize(df: DataFrame, name: str = "step", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage so that a lost executor re-reads files instead of replaying the history, keeps
    column pruning for later readers, and gives the optimiser real sizes to plan with. Readers of a table that is
    partitioned by some columns open only the files of the values they ask for.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
