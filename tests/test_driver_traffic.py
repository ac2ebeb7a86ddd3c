"""What the driver gets does not follow the length of a panel."""

import re

from pyspark.sql import functions as F

from panelforge.operators import fourier, panel
from panelforge.plans.design import Design
from panelforge.sources.panels import Panel


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_matrices_are_read_in_few_tasks(spark):
    """Beyond one chunk of positions a cached plan had a partition for each shuffle partition."""
    length = 70_000
    rows = spark.range(2 * length).select(
        F.timestamp_seconds(F.floor(F.col("id") / 2) * 3600).alias("ts"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("asset"), (1 + F.abs(F.hash("id") % 1000)).cast("double").alias("price")
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        design = Design(spark, Panel(rows, ("A", "B")))
        assert design.matrices == (length - 1) // 10
        assert design.series.rows.rdd.getNumPartitions() <= 16
        design.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_tables_are_what_is_broadcast(spark):
    stamps = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 86_400).alias("ts"))
    series = spark.range(1000).select(F.lit("z").alias("series"), F.col("id").alias("pos"), F.col("id").cast("double").alias("value"))
    # a name that is known when the plan is made, as the indicator's is
    orders = series.groupBy("series").agg(F.avg("value").alias("mean"), F.lit(0.1).alias("d"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only what the code names
    try:
        plans = [physical(panel.with_positions(stamps)), physical(fourier.innovations(series, orders, 1000))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for plan in plans:
        sides = re.findall(r"Broadcast(?:HashJoin|NestedLoopJoin).*(BuildLeft|BuildRight)", plan)
        assert sides and set(sides) == {"BuildRight"}
