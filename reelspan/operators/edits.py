"""Edit planning: silences to an audited list of kept and removed spans, one recording per media_id.

A recording's rows meet in one exchange on media_id; every step is a window or
a row-local expression over it. Silences are disjoint after merging, so slices
of the timeline come from each silence and the gap before it, without a join
of slices and silences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.text import fixed_micros
from reelspan.params import SilenceParams




def merge_silences(silences: DataFrame, p: SilenceParams = SilenceParams()) -> DataFrame:
    """(media_id, duration, silence_index, start, end): clipped to the recording, near ones merged, in order."""
    clipped = silences.select("media_id", "duration", F.greatest(F.lit(0.0), "start").alias("start"), F.least("duration", "end").alias("end")).where(F.col("end") - F.col("start") > p.time_epsilon)
    by = Window.partitionBy("media_id").orderBy("start", "end")
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reached.isNull() | (F.col("start") > reached + p.merge_gap + p.time_epsilon), 1).otherwise(0)
    island = clipped.withColumn("new", new).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("media_id", "island").agg(F.first("duration").alias("duration"), F.min("start").alias("start"), F.max("end").alias("end")).select("media_id", "duration", (F.col("island") - 1).cast("int").alias("silence_index"), "start", "end")


def removals(merged: DataFrame, p: SilenceParams = SilenceParams()) -> DataFrame:
    """The merged silences with ``eligible`` and the span to remove (null: none)."""
    length = F.col("end") - F.col("start")
    eligible = length + p.time_epsilon >= p.min_silence
    at_start, at_end = F.col("start") <= p.time_epsilon, F.col("end") >= F.col("duration") - p.time_epsilon
    plain, padded, inner = max(p.target_silence, p.min_keep), max(p.target_silence, p.edge_padding, p.min_keep), max(p.target_silence, 2 * p.edge_padding, p.min_keep)
    half = F.least(F.lit(inner), length) / 2
    low = F.when(at_start & at_end, F.col("start") + plain).when(at_start, F.col("start")).when(at_end, F.col("start") + padded).otherwise(F.col("start") + half)
    high = F.when(at_end, F.col("end")).when(at_start, F.col("end") - padded).otherwise(F.col("end") - half)
    use = eligible & (high - low > p.time_epsilon)
    return merged.withColumns({"eligible": eligible, "cut_start": F.when(use, low), "cut_end": F.when(use, high)})


def edit_list(silences: DataFrame, media: DataFrame | None = None, p: SilenceParams = SilenceParams()) -> DataFrame:
    """(media_id, duration, start, end, action, reason, silence_index): the whole timeline, exactly once.

    media: (media_id, duration), to include recordings without any silence.
    """
    cut = removals(merge_silences(silences, p), p)
    by = Window.partitionBy("media_id").orderBy("start")
    placed = cut.withColumns({"before": F.coalesce(F.lag("end").over(by), F.lit(0.0)), "last": F.lead("start").over(by).isNull()})
    piece = lambda a, b, action, reason, index="silence_index": F.struct(a.alias("start"), b.alias("end"), F.lit(action).alias("action"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), (F.col(index) if index else F.lit(None).cast("int")).alias("silence_index"))
    has = F.col("cut_start").isNotNull()
    whole = F.when(F.col("eligible"), "silence_kept").otherwise("short_silence")
    slices = F.array(
        piece(F.col("before"), F.col("start"), "keep", "content", None),
        F.when(~has, piece(F.col("start"), F.col("end"), "keep", whole)),
        F.when(has, piece(F.col("start"), F.col("cut_start"), "keep", "retained_silence")),
        F.when(has, piece(F.col("cut_start"), F.col("cut_end"), "remove", "compressed_silence")),
        F.when(has, piece(F.col("cut_end"), F.col("end"), "keep", "retained_silence")),
        F.when(F.col("last"), piece(F.col("end"), F.col("duration"), "keep", "content", None)),
    )
    out = placed.select("media_id", "duration", F.explode(slices).alias("e")).where(F.col("e").isNotNull()).select("media_id", "duration", "e.*")
    if media is not None:
        silent = media.join(cut.select("media_id").distinct(), "media_id", "left_anti")
        out = out.unionByName(silent.select("media_id", "duration", F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.lit("keep").alias("action"), F.lit("content").alias("reason"), F.lit(None).cast("int").alias("silence_index")))
    return out.where(F.col("end") - F.col("start") > p.time_epsilon)


def coalesced(edits: DataFrame, action: str, p: SilenceParams = SilenceParams()) -> DataFrame:
    """(media_id, start, end): touching spans of one action joined."""
    chosen = edits.where(F.col("action") == action)
    by = Window.partitionBy("media_id").orderBy("start")
    new = F.when(F.col("start") <= F.lag("end").over(by) + p.time_epsilon, 0).otherwise(1)
    island = chosen.withColumn("new", new).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("media_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def plan_totals(edits: DataFrame) -> DataFrame:
    length = F.col("end") - F.col("start")
    return edits.groupBy("media_id").agg(F.first("duration").alias("duration"), F.count("*").alias("n_edits"), F.sum(F.when(F.col("action") == "keep", length).otherwise(0.0)).alias("kept"), F.sum(F.when(F.col("action") == "remove", length).otherwise(0.0)).alias("removed"))


def timestamp_shifts(keeps: DataFrame) -> DataFrame:
    """Kept spans with ``shift``: the seconds that are cut before each of them."""
    by = Window.partitionBy("media_id").orderBy("start")
    gap = F.col("start") - F.coalesce(F.lag("end").over(by), F.lit(0.0))
    return keeps.withColumn("gap", F.when(gap > 1e-6, gap).otherwise(0.0)).withColumn("shift", F.sum("gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))


def edited_times(points: DataFrame, keeps: DataFrame) -> DataFrame:
    """(media_id, t, t_out): source times on the edited timeline, of the points that are kept.

    The kept span of a point is the last that starts at or before it: one sort of both together, no range join.
    """
    shifted = timestamp_shifts(keeps)
    both = shifted.select("media_id", F.col("start").alias("t"), F.lit(0).alias("kind"), "end", "shift").unionByName(points.select("media_id", "t", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("double").alias("shift")))
    by = Window.partitionBy("media_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"until": F.last("end", True).over(by), "cut": F.last("shift", True).over(by)})
    return seen.where("kind = 1 AND t < until").select("media_id", "t", (F.col("t") - F.col("cut")).alias("t_out"))


def filter_graph(keeps: DataFrame) -> DataFrame:
    """(media_id, graph): the renderer's expression that selects the kept spans and closes the gaps between them."""
    by = Window.partitionBy("media_id").orderBy("start")
    rows = keeps.withColumn("gap", F.col("start") - F.lag("end").over(by))
    start, end, gap = (fixed_micros(F.col(n)) for n in ("start", "end", "gap"))
    keep = F.concat(F.lit("gte(t,"), start, F.lit(")*lt(t,"), end, F.lit(")"))
    move = F.concat(F.lit("gte(T,"), start, F.lit(")*"), gap)
    parts = F.array_sort(F.collect_list(F.struct("start", keep.alias("keep"), F.when(F.col("gap") > 1e-6, move).alias("move"))))
    grouped = rows.groupBy("media_id").agg(parts.alias("p"))
    chosen, moved = F.array_join("p.keep", "+"), F.array_join("p.move", "+")
    pts = F.when(moved == "", F.lit("PTS-STARTPTS")).otherwise(F.concat(F.lit("PTS-STARTPTS-("), moved, F.lit(")/TB")))
    track = lambda tag, kind, out: [F.lit(f"[0:{tag}:0]{kind}select='"), chosen, F.lit(f"',{kind}setpts='"), pts, F.lit(f"'[{out}]")]
    return grouped.select("media_id", F.concat(*track("v", "", "vout"), F.lit(";\n"), *track("a", "a", "aout"), F.lit("\n")).alias("graph"))


def uncut(keeps: DataFrame, durations: DataFrame) -> DataFrame:
    """(media_id, uncut): whether one kept span is the whole recording, so that its streams can be copied."""
    spans = keeps.groupBy("media_id").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    whole = (F.col("n") == 1) & (F.col("start") <= 1e-4) & (F.col("end") >= F.col("duration") - 1e-3)
    return spans.join(durations, "media_id").select("media_id", whole.alias("uncut"))
