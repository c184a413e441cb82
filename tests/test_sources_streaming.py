import pytest
from pyspark.sql import functions as F

from millrace.operators.base import RID, OperatorError
from millrace.sources.tables import scan, write
from millrace.streaming.windows import count_windows, time_statistics


def test_csv_order_projection_and_sources(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("k,v\n1,a\n2,b\n3,c\n")
    b.write_text("v,k\nd,4\ne,5\n")
    df = scan(spark, str(a), [str(b)], source_column="src", columns=["v"], filters=[("k", ">=", 2)])
    assert [r["v"] for r in df.orderBy(RID).collect()] == ["b", "c", "d", "e"]
    assert [r["v"] for r in scan(spark, str(a), max_rows=2).collect()] == ["a", "b"]
    (tmp_path / "c.csv").write_text("k,w\n1,a\n")
    with pytest.raises(OperatorError):
        scan(spark, str(a), [str(tmp_path / "c.csv")])


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") * 2).alias("w")).write.parquet(f"{tmp_path}/t.parquet")
    df = scan(spark, f"{tmp_path}/t.parquet", columns=["w"], filters=[("id", ">", 990)])
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,990)]" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 9
    write(df, f"{tmp_path}/out", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["w"]


def test_streams(spark, tmp_path):
    rows = [(i % 2, f"2024-01-01 00:{i:02d}:00", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "g long, t string, x double").select("g", F.to_timestamp("t").alias("t"), "x")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = count_windows(stream, "g", "t", "x", 5, 5).writeStream.format("memory").queryName("cw").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("cw").where("series = '0'").orderBy("start").collect()
    assert [r["start"] for r in got] == [0, 5, 10, 15] and got[0]["mean"] == 4.0
    q = time_statistics(stream, "g", "t", "x", "10 minutes").writeStream.format("memory").queryName("ts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("ts").count() == 8
