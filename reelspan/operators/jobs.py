"""Jobs: identities of sources and configurations, reuse of finished jobs, stages and gates."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.text import safe_stem

#: Bytes at either end of a file that count for its identity.
SAMPLE = 1 << 20
#: Changes whenever full jobs have to be made anew.
REVISION = "1"
OPERATIONS = ("plan", "edit_only", "full")


def config_fingerprint(config: dict[str, Any], operation: str = "full", subtitles: bool = False) -> str:
    """The identity of what a configuration means for an operation: sections that don't touch it don't count."""
    if operation not in OPERATIONS:
        raise ValueError(f"operation must be one of {OPERATIONS}")
    sections = set(config) if operation == "full" else {"silence", "video"}
    sections -= set() if subtitles or operation != "full" else {"subtitles"}
    told = {"config": {k: config[k] for k in sections}, "operation": operation, "subtitles_requested": subtitles} | ({"pipeline_revision": REVISION} if operation == "full" else {})
    return hashlib.sha256(json.dumps(told, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def source_fingerprint(path: Column, size: Column, modified_ns: Column, head: Column, tail: Column) -> Column:
    """The identity of a file: its place, size and time, and SAMPLE bytes of its beginning and, where it is longer, its end."""
    text = lambda x: F.encode(x.cast("string"), "UTF-8")
    zero = F.unhex(F.lit("00"))
    parts = [text(path), zero, text(size), zero, text(modified_ns), zero, head, F.when(size > SAMPLE, tail).otherwise(F.unhex(F.lit("")))]
    return F.sha2(F.concat(*parts), 256)


def fingerprinted(files: DataFrame) -> DataFrame:
    """(path, fingerprint) of Spark's binaryFile source; times there are whole microseconds."""
    ns = F.unix_micros("modificationTime") * 1000
    head, tail = F.substring("content", 1, SAMPLE), F.expr(f"substring(content, greatest(1, octet_length(content) - {SAMPLE - 1}), {SAMPLE})")
    return files.select("path", source_fingerprint(F.col("path"), F.col("length"), ns, head, tail).alias("fingerprint"))


def job_id(name: Column, fingerprint: Column, config: Column) -> Column:
    return F.concat_ws("-", safe_stem(name), F.substring(fingerprint, 1, 10), F.substring(config, 1, 8))


def lookup(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """The requests (job_id, fingerprint, plan_only, subtitles, force) with ``outcome``: run, cached or an error.

    jobs: (job_id, fingerprint, status, subtitles_state, has_subtitled).
    """
    known = jobs.select("job_id", F.col("fingerprint").alias("old"), "status", "subtitles_state", "has_subtitled")
    rows = requests.join(known, "job_id", "left")
    finished = F.col("status") == F.when(F.col("plan_only"), "planned").otherwise("complete")
    whole = F.coalesce((F.col("subtitles_state") == "complete") & F.col("has_subtitled"), F.lit(False))
    outcome = (
        F.when(F.col("old").isNull() | F.col("force"), "run").when(F.col("old") != F.col("fingerprint"), "error_other_source").when(finished & F.col("subtitles") & ~whole, "error_no_subtitles")
        .when(finished, "cached").otherwise(F.concat(F.lit("error_"), F.coalesce("status", F.lit("unknown"))))
    )
    return rows.select(*requests.columns, outcome.alias("outcome"))


def stage_states(events: DataFrame) -> DataFrame:
    """(media_id, stage, state, updated_at) of stage events (media_id, stage, state, at): the latest of each stage; a failed job's running stages have failed with it.

    The stage ``job`` stands for the job itself.
    """
    latest = events.groupBy("media_id", "stage").agg(F.max(F.struct("at", "state")).alias("e")).select("media_id", "stage", "e.state", F.col("e.at").alias("updated_at"))
    own = Window.partitionBy("media_id")
    failed_at = F.max(F.when((F.col("stage") == "job") & (F.col("state") == "failed"), F.col("updated_at"))).over(own)
    fails = failed_at.isNotNull() & (F.col("state") == "running")
    return latest.select("media_id", "stage", F.when(fails, "failed").otherwise(F.col("state")).alias("state"), F.when(fails, failed_at).otherwise(F.col("updated_at")).alias("updated_at"))


def disk_needed(size: Column, seconds: Column, subtitles: Column) -> Column:
    """Bytes that must be free before a job: the source's copies and its audio, five GiB at least."""
    return F.greatest(F.lit(5 << 30), F.ceil(size * F.when(subtitles, 3).otherwise(2) + 32_000 * seconds)).cast("bigint")


def same_length(a: Column, b: Column, tolerance: float = 1.0) -> Column:
    """Whether two durations are as near as the subtitled copy must be to the edited one."""
    return F.abs(a - b) <= tolerance
