from oxyframe.streaming import trailing


def test_trailing_mean(spark, tmp_path):
    spark.createDataFrame([("a", float(i), float(i)) for i in range(6)], "s string, t double, x double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, t double, x double").parquet(str(tmp_path / "in"))
    q = trailing.trailing_mean(stream, "s", "t", "x", 3).writeStream.format("memory").queryName("trail").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["mean"] for r in spark.table("trail").orderBy("time").collect()] == [0, 0.5, 1, 2, 3, 4]
