"""Tables that cut a plan: computed once, kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df written below spark.checkpoint.dir and read back. Where that is unset, a session on one machine takes a temporary
    folder; on a cluster, whose machines would not see it, that is an error."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="tidelens-")
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_MADE: list[str] = []


def remove_settled(spark: SparkSession) -> None:
    """Deletes the tables that settled() has written for this driver; results that are not yet stored need them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)
