"""Media probes (JSON) as a source: duration, tracks and whether the media can be edited."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "format struct<duration: string>, streams array<struct<codec_type: string, codec_name: string, duration: string>>"


def read_probes(probes: DataFrame) -> DataFrame:
    """(media_id, duration, n_video, n_audio, usable) of (media_id, probe).

    The duration is the first positive one of the container and then the
    tracks, else 0. Usable media have video, audio and a duration; text that is
    no JSON, or null, has none.
    """
    p = F.from_json("probe", SCHEMA)
    rows = probes.select("media_id", p["format"]["duration"].alias("whole"), F.coalesce(p["streams"], F.from_json(F.lit("[]"), "array<struct<codec_type: string, codec_name: string, duration: string>>")).alias("tracks"))
    number = lambda x: x.try_cast("double")
    lengths = F.filter(F.transform(F.concat(F.array("whole"), F.transform("tracks", lambda t: t["duration"])), number), lambda x: (x > 0) & ~F.isnan(x))
    count = lambda kind: F.size(F.filter("tracks", lambda t: t["codec_type"] == kind)).cast("bigint")
    out = rows.select("media_id", F.coalesce(F.get(lengths, F.lit(0)), F.lit(0.0)).alias("duration"), count("video").alias("n_video"), count("audio").alias("n_audio"))
    return out.withColumn("usable", (F.col("duration") > 0) & (F.col("n_video") > 0) & (F.col("n_audio") > 0))
