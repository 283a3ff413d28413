"""Sinks: plans, transcripts, subtitles and summaries as JSON and text, one directory a recording, published as a whole.

Files are written by Spark's committers under a pending path of the target's
store and renamed into place once all of them are there, so a failure leaves
what was published before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plan_json(edits: DataFrame) -> DataFrame:
    """(media_id, json) of an edit list, times in microseconds."""
    us = lambda n: F.bround(F.col(n) * 1e6).cast("bigint").alias(f"{n}_us")
    items = F.array_sort(F.collect_list(F.struct(us("start"), us("end"), "action", "reason", "silence_index")))
    rows = edits.groupBy("media_id").agg(items.alias("edits"))
    total = lambda action: F.aggregate(F.filter("edits", lambda e: e["action"] == action), F.lit(0).cast("bigint"), lambda a, e: a + e["end_us"] - e["start_us"])
    return rows.select("media_id", F.to_json(F.struct(total("keep").alias("kept_us"), total("remove").alias("removed_us"), "edits")).alias("json"))


def corrections_json(corrected: DataFrame) -> DataFrame:
    """(media_id, json): what the corrections of a recording did to each chunk."""
    chunk = F.struct("chunk_id", "source_text", "text", "occurrences", "conflicts")
    return corrected.groupBy("media_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks")).select("media_id", F.to_json(F.struct(F.lit(True).alias("canonical_transcript_unchanged"), "chunks")).alias("json"))


def rules_json(verdicts: DataFrame) -> DataFrame:
    """(media_id, json): accepted rules, and how many proposals went for which reason."""
    rule = F.struct("rule_id", "scope_id", "original", "replacement", "matched_occurrences", "replacement_observed_count", "similarity")
    accepted = F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), rule)))
    reasons = F.collect_list("reason")
    counted = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("reasons")), lambda r: F.struct(r, F.size(F.filter("reasons", lambda x: x == r)))))
    rows = verdicts.groupBy("media_id").agg(accepted.alias("rules"), reasons.alias("reasons"))
    return rows.select("media_id", F.to_json(F.struct("rules", counted.alias("rejected"))).alias("json"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(documents: dict[str, DataFrame], path: str, text: Column | str = "text") -> None:
    """Write each named table (media_id, text) as text under path/name/media_id=…, all or nothing.

    Every table is written below a pending path first; only then do they take
    the place of what was there, one rename a name.
    """
    spark = next(iter(documents.values())).sparkSession
    pending = f"{path.rstrip('/')}/.pending-{uuid.uuid4().hex}"
    fs, top = _fs(spark, pending)
    try:
        for name, rows in documents.items():
            value = F.col(text) if isinstance(text, str) else text  # a writer ends each text with a line feed of its own
            rows.select("media_id", F.regexp_replace(value, r"\n\z", "").alias("value")).write.partitionBy("media_id").text(f"{pending}/{name}")
        for name in documents:
            _, target = _fs(spark, f"{path.rstrip('/')}/{name}")
            fs.delete(target, True)
            if not fs.rename(_fs(spark, f"{pending}/{name}")[1], target):
                raise OSError(f"{name} could not be published")
    finally:
        fs.delete(top, True)
