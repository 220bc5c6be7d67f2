"""Session helpers: local sessions, table reads, reliable checkpoints."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of an application, once.

    Functions that run there name it; a worker may not have it on its path.
    Nothing happens where the package itself came in an archive.
    """
    context = spark.sparkContext
    home = Path(__file__).resolve().parent
    if context.applicationId in _SHIPPED or not home.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="folioscope-")) / "folioscope.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, Path(home.name, file.relative_to(home)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "folioscope") -> SparkSession:
    """A session for one machine; clusters bring their own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, as a lazy Parquet scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``checkpoint()`` writes to.

    The cluster names a shared folder in ``spark.checkpoint.dir``; only where
    that is unset (tests on one machine) a temporary folder is made.
    """
    ship(spark)
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="folioscope-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(named)
    return named


def checkpoint(frame: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with files that outlive any executor."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=eager)


def spread(frame: DataFrame) -> DataFrame:
    """A scan over all cores where its files make fewer than half as many tasks as there are cores.

    For plain scans before heavy work in Python.  A scan with enough tasks, as
    any large one has, is returned as it is, so large inputs are not shuffled.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if 2 * frame.rdd.getNumPartitions() < cores else frame


def materialize(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared checkpoint folder: for rows that are read more than once.

    Smaller than a checkpoint (columns are compressed) and read with column
    pruning.  The table is removed when this driver ends.
    """
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session or the folder is gone already
        pass
