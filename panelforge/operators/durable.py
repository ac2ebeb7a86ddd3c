"""Small tables that several steps of one study read, written once: a cut in the lineage that survives lost executors,
and that ends with the study instead of holding memory."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or the context's checkpoint folder. In local mode the
    one process sees the warehouse folder too; a cluster that names no folder is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"
    raise ValueError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")


class Store:
    """Tables written by one study."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __call__(self, frame: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/study-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def discard(self) -> int:
        """Deletes the tables and says how many; frames that still read them fail afterwards."""
        count = 0
        while self.paths:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            count += bool(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
        return count
