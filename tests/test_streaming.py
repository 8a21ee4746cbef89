from sieveline.operators import filters
from sieveline.plans.config import FilterSpec
from sieveline.streaming.filters import stream_words, windowed_words


def test_stream_builds_the_batch_filter(spark, tmp_path):
    f = filters.params(spark, [FilterSpec("r", "rational", 700, 2.6)])
    items = spark.createDataFrame([("r", str(i)) for i in range(90)], "filter_id string, item string")
    items.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = stream_words(stream, f).writeStream.format("memory").queryName("words").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    got = {tuple(r) for r in spark.table("words").select("filter_id", "word_no", "word").collect()}
    assert got == {tuple(r) for r in filters.build(items, f).collect()}


def test_windows(spark, tmp_path):
    f = filters.params(spark, [FilterSpec("r", "rational", 700, 2.0)])
    rows = [("r", str(i), f"2024-01-01 0{i % 3}:10:00") for i in range(30)]
    items = spark.createDataFrame(rows, "filter_id string, item string, t string").selectExpr("filter_id", "item", "to_timestamp(t) AS t")
    items.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    q = windowed_words(stream, f, "t", "1 hour", "1 day").writeStream.format("memory").queryName("windowed").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    assert spark.table("windowed").select("window").distinct().count() == 3
