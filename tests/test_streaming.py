"""Streams over files against the same counts in a batch."""

from pyspark.sql import functions as F

from plumbline.streaming import duplicates


def _stream(spark, tmp_path):
    rows = [(f"2026-01-01 0{h}:00:00", k) for h in range(4) for k in ("a", "b", "a")]
    df = spark.createDataFrame(rows, "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def _run(stream, spark, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_windowed_counts(spark, tmp_path):
    df, stream = _stream(spark, tmp_path)
    got = _run(duplicates.windowed_counts(stream, "t", "k"), spark, "counts", "complete")
    want = df.groupBy(F.window("t", "1 hour"), "k").count()
    assert sorted((r["window"]["start"], r["k"], r["n"]) for r in got.collect()) == sorted((r["window"]["start"], r["k"], r["count"]) for r in want.collect())


def test_first_seen(spark, tmp_path):
    _, stream = _stream(spark, tmp_path)
    got = _run(duplicates.first_seen(stream, "t", "k"), spark, "firsts", "append")
    assert sorted(r["k"] for r in got.collect()) == ["a", "b"]
