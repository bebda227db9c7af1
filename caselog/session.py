"""Session helpers: shared scratch folder and tables that cut a long plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/checkpoints"  # of a local session that names none: its executors are this machine


def local_session(cores: int | str = "*", **conf) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("caselog")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", LOCAL_FOLDER)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by `spark.checkpoint.dir`.

    A cluster must name it. A local session that does not uses `LOCAL_FOLDER`.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return LOCAL_FOLDER


_WRITTEN: list[str] = []


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder; `clear_scratch` removes it."""
    root = f"{shared_folder(spark).rstrip('/')}/caselog-{uuid.uuid4().hex}"
    _WRITTEN.append(root)
    return f"{root}/{name}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` as a parquet table in the shared folder and go on from there.

    Used where a result is read several times, so that a lost executor costs a
    re-read and not a second pass. Later reads prune columns and know the size.
    The rows have no order.
    """
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables of this process; results not yet read are lost."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
