from __future__ import annotations

from pyspark.sql import functions as F

from gridwise.streaming.ingest import daily_series

SF = "/root/testdata/sf0.001"


def test_stream_gives_the_days_of_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(3):  # three files in order of time
        day = F.floor((F.dayofyear("ts") - 1) / 10)
        events.filter(day == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = daily_series(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.subject, r.unit, r.day): round(r.y, 6) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    expected = {(r.subject, r.unit, r.day): round(r.y, 6) for r in daily_series(events).collect()}
    assert got and all(expected[k] == v for k, v in got.items())
    assert len(got) >= 0.9 * sum(d.timetuple().tm_yday < 28 for _, _, d in expected)
