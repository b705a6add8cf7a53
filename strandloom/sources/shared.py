"""Tables written once in the folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master without it gets a temporary folder of its own."""
    app = spark.sparkContext.applicationId
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _LOCAL.get(app)
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, and kept when executors are lost.  It goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` in some tasks for each core and at least the session's shuffle partitions, for work that costs far more than moving them.

    By keys they are not sorted for it, so a task that reads many large rows holds none of them.
    """
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
