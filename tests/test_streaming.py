from datetime import datetime, timedelta

import numpy as np

from panelforge.streaming.blocks import streaming_block_covariances


def test_blocks_from_a_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    r = rng.standard_normal((125, 2))
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=i + 1), r[i].tolist()) for i in range(125)]
    spark.createDataFrame(rows, "ts timestamp, r array<double>").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, r array<double>").parquet(str(tmp_path / "in"))
    made = streaming_block_covariances(stream, ("A", "B"), 30, "0 minutes")
    query = made.writeStream.outputMode("append").format("memory").queryName("blocks").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("select * from blocks order by ts").collect()
    assert len(got) == 4
    for k, row in enumerate(got):
        assert np.allclose(row["m"], np.cov(r[k * 30 : k * 30 + 30].T).ravel()) and row["ts"] == datetime(2024, 1, 1) + timedelta(minutes=30 * (k + 1))
