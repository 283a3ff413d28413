"""Transcripts and manifests as sources: JSON text in a table or in files, one document a row."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = "array<struct<start: double, end: double, word: string, probability: double>>"
TRANSCRIPT = f"struct<segments: array<struct<id: int, start: double, end: double, text: string, words: {WORDS}>>>"
MANIFEST = "struct<source: struct<name: string, fingerprint: string>, status: string, stages: map<string, struct<state: string, updated_at: string>>, outputs: map<string, string>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, document): whole files as text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def transcripts(rows: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, error, segments) of (key, document): text that is no transcript, or has no segments, is named in ``error``."""
    told = F.from_json("document", TRANSCRIPT)["segments"]
    return rows.select(key, F.when(F.coalesce(F.size(told), F.lit(0)) <= 0, "no_segments").alias("error"), told.alias("segments"))


def transcript_segments(rows: DataFrame, key: str = "media_id") -> DataFrame:
    """(media_id, pos, id, start, end, text, words) of readable transcripts, in their order."""
    found = transcripts(rows, key).where("error IS NULL").select(F.col(key).alias("media_id"), F.posexplode("segments").alias("pos", "s"))
    return found.select("media_id", "pos", F.coalesce("s.id", "pos").alias("id"), "s.start", "s.end", "s.text", "s.words")


def recognised(segments: DataFrame) -> DataFrame:
    """Segments of a recogniser as the engine takes them: those without text go, and ids are dense again."""
    text = F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    kept = segments.withColumn("text", text).where("text <> ''")
    return kept.withColumn("id", F.row_number().over(Window.partitionBy("media_id").orderBy("pos")) - 1)


def manifests(rows: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, fingerprint, status, subtitles_state, has_subtitled) of (key, document); a manifest that can't be read has the status unknown."""
    m = F.from_json("document", MANIFEST)
    named = rows.select(key, m.alias("m"))
    return named.select(
        key, F.col("m.source.fingerprint").alias("fingerprint"), F.coalesce("m.status", F.lit("unknown")).alias("status"), F.try_element_at("m.stages", F.lit("subtitles"))["state"].alias("subtitles_state"),
        F.coalesce(F.map_contains_key("m.outputs", F.lit("subtitled")), F.lit(False)).alias("has_subtitled"),
    )


#: Names of older configurations, and what they are now (None: nothing).
RENAMED = {("subtitles", "alignment_chunk_seconds"): ("subtitles", "correction_scope_seconds"), ("subtitles", "aligner_model"): None}


def overlaid(defaults: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    """The defaults with what is given put over them, section by section; old names count as the new ones, which come first."""
    out, given = deepcopy(defaults), deepcopy(given)
    for (section, old), new in RENAMED.items():
        if isinstance(given.get(section), dict) and old in given[section]:
            value = given[section].pop(old)
            if new is not None:
                given.setdefault(new[0], {}).setdefault(new[1], value)

    def put(base: dict[str, Any], more: dict[str, Any]) -> None:
        for k, v in more.items():
            if isinstance(base.get(k), dict) and isinstance(v, dict):
                put(base[k], v)
            else:
                base[k] = v

    put(out, given)
    return out
