import datetime as dt

from panelforge.plans.queries import QUERIES


def test_every_event_type_is_kept(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1), f"type{k:03d}", 1.0 + k) for k in range(70)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["events_panel"](spark, str(tmp_path)).select("asset").distinct().count() == 70
