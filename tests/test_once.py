from datetime import datetime

from pyspark.sql import functions as F

from strandframe import session
from strandframe.plans.base import once


def test_rows_of_one_id_once(spark, tmp_path):
    at = lambda d: datetime(2026, 1, d)
    rows = [(1, "a", at(3)), (1, "a", at(1)), (2, "b", at(2)), (2, "b", at(2)), (3, "c", None), (3, "c", at(1)), (None, "d", at(1)), (None, "d", at(2)), (4, None, None)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "id int, v string, loaded_at timestamp").repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    want = [(None, "d"), (1, "a"), (2, "b"), (3, "c"), (4, None)]
    assert sorted(map(tuple, once(df, "id").select("id", "v").collect()), key=str) == sorted(want, key=str)
    assert once(df, "id").columns == ["id", "v", "loaded_at"]
    assert once(df.where(F.col("v") == "a"), "id").first()["loaded_at"] == at(1)
    assert sorted(map(tuple, once(df.drop("loaded_at"), "id").collect()), key=str) == sorted(want, key=str)
    assert once(df.limit(0).where("false"), "id").count() == 0


def test_sides_are_measured_before_a_broadcast(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).write.parquet(path)
    df = spark.read.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        assert session.measured(df) is df
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10)
        plan = lambda x: spark.range(10).join(x, "id")._jdf.queryExecution().optimizedPlan().toString()
        assert "broadcast" in plan(session.measured(df)).lower()
        session.BROADCAST_ROWS, kept = 999, session.BROADCAST_ROWS
        try:
            assert "broadcast" not in plan(session.measured(df)).lower() and session.measured(df).count() == 1000
        finally:
            session.BROADCAST_ROWS = kept
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
