"""Session helpers: a local factory for tests and benches, tables of a data folder, durable cuts of lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "lumenframe", **conf: str) -> SparkSession:
    """A local session with the settings the queries assume (UTC, AQE, Arrow). Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("LUMENFRAME_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder (one Parquet file or folder a table)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` (a plain scan), dealt to all cores if it has fewer pieces than there are: one small file is one task, whatever
    its text costs. Scans of as many pieces as cores, so all large ones, are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir`` (or ``setCheckpointDir`` has set). Only a local
    session, whose tasks all run on this machine, gets a temporary one; elsewhere a missing setting is an error."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not wanted:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, wanted, ignore_errors=True)
    context.setCheckpointDir(wanted)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again: lineage is cut as by ``cut``, but the rows
    are compressed and each reader takes only the columns that it asks for. ``forget`` removes these tables."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TABLES: list[str] = []


def forget(spark: SparkSession) -> int:
    """Remove all tables that ``stored`` wrote in this process; their readers must have ended. Gives their number."""
    jvm, gone = spark.sparkContext._jvm, len(_TABLES)
    while _TABLES:
        path = jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut; survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
