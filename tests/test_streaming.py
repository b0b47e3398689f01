from swathly.streaming import monitor

SF = "/root/testdata/sf0.001"


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_windows_equal_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    batch = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts as timestamp) as ts", "value", "user_id")
    batch.write.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).parquet(str(src))
    got = run(spark, monitor.error_windows(stream, "ts", "value", "1 day", "1 hour"), "windows", tmp_path, "complete")
    want = batch.groupBy("ts").count().selectExpr("sum(count)").first()[0]
    assert got.selectExpr("sum(n)").first()[0] == want and got.where("rmse + 1e-9 < mean_error").count() == 0


def test_repeats_are_dropped(spark, tmp_path):
    src = tmp_path / "twice"
    batch = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts as timestamp) as ts", "event_id")
    batch.union(batch).write.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).parquet(str(src))
    assert run(spark, monitor.first_epochs(stream, "ts", "event_id", "60 days"), "firsts", tmp_path).count() == batch.count()
