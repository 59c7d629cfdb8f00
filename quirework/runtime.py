"""Session helpers shared by every operator: shipping the package, spreading scans, checkpoint folders."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors (once per application); the zip is served by the driver."""
    context = spark.sparkContext
    if not getattr(context, "_quirework_shipped", False):
        folder = tempfile.mkdtemp(prefix="quirework-")
        target = os.path.join(folder, "quirework_pkg.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(_PACKAGE.rglob("*.py")):
                out.write(path, str(Path(_PACKAGE.name) / path.relative_to(_PACKAGE)))
        context.addPyFile(target)
        context._quirework_shipped = True
    return spark


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A test table as a DataFrame, reduced to the named columns so that the scan reads nothing else."""
    frame = ship(spark).read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Give Python stages at least one partition per core.

    A scan of many files already has them and is left alone (no shuffle); only a scan with fewer partitions
    than cores - one small file - is repartitioned.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores, *keys) if keys else frame.repartition(cores)


def scan_bytes(frame: DataFrame) -> int:
    """The optimizer's estimate of a frame's size, which is that of the files where it comes from a scan, 0 where it isn't known; nothing is run."""
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 62 else 0


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster shares.

    ``spark.checkpoint.dir`` of the session is used where set; where it is unset, a folder of this machine in local mode only, and an error on a cluster.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quirework-checkpoint-"))
    return frame.checkpoint(eager=True)
