"""Tables of intermediate steps in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gritstone.graph.scratch", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset: {master} needs a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-gritstone-")
        spark.conf.set("gritstone.graph.scratch", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``cut_lineage`` wrote and nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if path.rpartition("/")[2].startswith("round-"):
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
