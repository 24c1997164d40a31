"""Daily series from a stream of events, for tables that are filled while they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_series(events: DataFrame, late: str = "1 day") -> DataFrame:
    """subject, unit, day and y (sum of values) of each kind of event and user, from a stream (or a table) of ts, user_id, event_type and value.

    Events that come later than `late` behind the newest are left out; a day is given out once it can change no more.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    sums = timed.groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("subject"), F.col("user_id").alias("unit")).agg(F.sum("value").alias("y"))
    return sums.select("subject", "unit", F.to_date("w.start").alias("day"), "y")
