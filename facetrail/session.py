"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "facetrail", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session with the settings the operators expect (UTC clock, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FACETRAIL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names in ``spark.checkpoint.dir``, else the one the context has.

    Only a local master gets a folder of its own where neither is set (tests, laptops), which goes with the process; on a
    cluster that is an error, as a folder of the driver's machine is not there for the executors."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on the master {master}")
    named = tempfile.mkdtemp(prefix="facetrail-ckpt-")
    atexit.register(shutil.rmtree, named, True)
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once as a table of the shared folder and read back: the lineage ends there, a lost executor costs
    nothing of it, and its size is known to the planner, which broadcasts it only below its own threshold."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/facetrail-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._facetrail_path = path
    return out


def _folder(df: DataFrame):
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df._facetrail_path)
    return path.getFileSystem(conf), path


def written_bytes(df: DataFrame) -> int:
    """Size of what ``cut`` has written."""
    fs, path = _folder(df)
    return fs.getContentSummary(path).getLength()


def forget(df: DataFrame) -> None:
    """Deletes what ``cut`` has written; the frame and all that is made from it can't be read any more."""
    fs, path = _folder(df)
    fs.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows over as many partitions as the session shuffles into, or has cores: for stages that cost much CPU a row, whose
    few bytes would otherwise be brought together into few tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)
