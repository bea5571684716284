"""Session settings the engine is written for. A cluster brings its own session; nothing here overrides one."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # the place in the code of every column expression is looked up otherwise, which costs more than building it
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("annolytics")
    for key, value in CONF.items():
        builder = builder.config(key, value)
    spark = (builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.driver.memory", memory).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a fresh local one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="annolytics-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df):
    """``df`` from a reliable checkpoint in the shared folder: what follows neither plans nor computes it again, and a lost
    executor costs a read, not the whole history."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df):
    """``df`` as a Parquet table in the shared folder: cuts the lineage like ``cut_lineage``, in columns and compressed, which for
    wide rows of texts is a fraction of a checkpoint's bytes. The partitioning is not kept."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
