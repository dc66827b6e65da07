"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, through Spark's own file distribution.

    Workers do not search the driver's folders for modules. The archive is made on the driver and copied to the
    executors by Spark.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="sleuthflow-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as held:
        for source in sorted(package.rglob("*.py")):
            held.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """What the operators rely on: UTC days, adaptive execution, this package on the workers, small Arrow batches.

    Texts differ in length by orders of magnitude, so batches to Python workers are bounded by bytes.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, or a temporary one in local mode."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    if context.applicationId not in _local_scratch:
        folder = tempfile.mkdtemp(prefix="sleuthflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_scratch[context.applicationId] = folder
    return _local_scratch[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below one folder per application, which can be removed as a whole when it has ended."""
    return f"{scratch_dir(spark)}/sleuthflow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Remove the intermediate tables of this application; results that are still to be read from them must be
    written first. True if there was something to remove."""
    return remove(spark, f"{scratch_dir(spark)}/sleuthflow-{spark.sparkContext.applicationId}")


def remove(spark: SparkSession, folder: str) -> bool:
    """Remove a folder of intermediate tables. True if there was something to remove."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back.

    For a table that feeds several branches (its scan and shuffle then run once, and each branch reads
    only its own columns) and for cutting lineage in loops. The files survive lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
