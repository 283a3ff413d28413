"""The silence detector's log as a source: ordered start and end events to intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
EVENT = rf"silence_(start|end):\s*({NUMBER})(?:\s*\|\s*silence_duration:\s*({NUMBER}))?"


def parse_silence_log(logs: DataFrame) -> DataFrame:
    """(media_id, silence_index, start, end, error) of logs (media_id, log, duration).

    A start goes with the end that follows; an end without one is recovered from
    its reported duration; a last start is closed by the recording's duration.
    ``error`` names what can't be paired, and the row's times may then be null.
    """
    pick = lambda k: F.regexp_extract_all("log", F.lit(EVENT), F.lit(k))
    events = logs.select("media_id", "duration", F.posexplode(F.arrays_zip(pick(1).alias("kind"), pick(2).alias("t"), pick(3).alias("d"))).alias("pos", "e"))
    events = events.select("media_id", "duration", "pos", "e.kind", F.expr("try_cast(e.t AS double)").alias("t"), F.expr("try_cast(e.d AS double)").alias("d"))
    by = Window.partitionBy("media_id").orderBy("pos")
    near = events.withColumns({"before": F.lag("kind").over(by), "opened": F.lag("t").over(by), "after": F.lead("kind").over(by)})
    paired, last = F.col("before") == "start", F.col("after").isNull()
    rows = near.where((F.col("kind") == "end") | last | (F.col("after") == "start"))
    start = F.when(F.col("kind") == "start", F.col("t")).when(paired, F.col("opened")).otherwise(F.col("t") - F.col("d"))
    end = F.when(F.col("kind") == "end", F.col("t")).when(last, F.col("duration"))
    error = (
        F.when((F.col("kind") == "start") & ~last, "consecutive_starts").when(F.col("kind").eqNullSafe("start") & F.col("duration").isNull(), "open_without_duration")
        .when(F.col("end").isNotNull() & F.col("start").isNull(), "orphan_end").when(F.col("end") < F.col("start"), "end_before_start")
    )
    out = rows.withColumns({"start": start, "end": end}).withColumn("error", error)
    return out.select("media_id", (F.row_number().over(by) - 1).alias("silence_index"), "start", "end", "error")


def render_silence_log(silences: DataFrame) -> DataFrame:
    """(media_id, duration, log) of (media_id, duration, silence_index, start, end), to the microsecond."""
    us = lambda x: F.bround(x * 1e6).cast("bigint")
    fixed = lambda n: F.concat(F.floor(n / 1_000_000).cast("string"), F.lit("."), F.lpad((n % 1_000_000).cast("string"), 6, "0"))
    s, e = us(F.col("start")), us(F.col("end"))
    line = F.concat(F.lit("silence_start: "), fixed(s), F.lit("\nsilence_end: "), fixed(e), F.lit(" | silence_duration: "), fixed(e - s))
    items = F.array_sort(F.collect_list(F.struct("silence_index", line.alias("t"))))
    return silences.groupBy("media_id").agg(F.first("duration").alias("duration"), F.array_join(F.transform(items, lambda x: x["t"]), "\n").alias("log"))
