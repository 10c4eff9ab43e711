"""Session helpers: import path of Python workers, the shared folder and rows written there, a local session for tests."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LONGEST = "spark.sql.codegen.hugeMethodLimit"


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers and a checkpoint folder known.

    The folder named by ``spark.checkpoint.dir`` is used as it is. Where it is unset, a temporary one is taken in
    local mode (tests); on a cluster its executors would not share it, so that is an error. Generated methods of over 8,000 bytes,
    which HotSpot never compiles (features over many lags), are split, unless the session was started with another limit.
    """
    if not spark.sparkContext.getConf().contains(_LONGEST):
        spark.conf.set(_LONGEST, "8000")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir", "") and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="boutlog-ckpt-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for rows between jobs."""
    return prepare(spark).sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows go to the shared folder, so a lost executor costs no recomputation."""
    prepare(df.sparkSession)
    out = df.checkpoint(eager=True)
    # what the rows were made from is no longer reachable: let Spark's cleaner free its shuffle files and older checkpoints now
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again: lineage is cut, columns are compressed and pruned.

    The shuffle files of the job that writes them are removed when it ends; discard() removes the rows.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(folder)
    out._stored_in = folder
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the rows of stored() frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_in)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def dealt(df: DataFrame, *keys: str, part_bytes: int = 1 << 20) -> DataFrame:
    """df dealt by keys, with a part for each ``part_bytes`` of the files that it is read from, so a part does not grow with them; by Spark's own number if it is read from none."""
    spark = df.sparkSession
    hadoop, conf, size = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf(), 0
    for file in df.inputFiles():
        path = hadoop.Path(spark._jvm.java.net.URI(file))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return df.repartition(-(-size // part_bytes), *keys) if size else df.repartition(*keys)


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
