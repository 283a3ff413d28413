"""Transcript segments: readable blocks, prompt windows and rendered documents, per recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.text import clock, each, normalized, timestamp

#: Fixed output: the notice under the title of a transcript.
NOTICE = "Automatically transcribed locally; wording may contain recognition errors."
#: Fixed values of the layout: section and gap seconds, least and most characters, most seconds.
SECTION, GAP, LEAST, MOST, SECONDS = 300, 2.5, 300, 700, 60


def strict_time(x: Column, name: str) -> Column:
    """The time, or an error where it is no finite number."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{name} of a segment must be finite")).cast("double")).otherwise(x)


def readable(segments: DataFrame, *more: str) -> DataFrame:
    """Segments with some text: normalised, times clamped. A time that is not finite is an error."""
    start, end = (strict_time(F.col(n), n) for n in ("start", "end"))
    low = F.greatest(F.lit(0.0), F.coalesce(start, F.lit(0.0)))
    return segments.select("media_id", "pos", low.alias("start"), F.greatest(low, F.coalesce(end, low)).alias("end"), normalized(F.col("text")).alias("text"), *more).where("text <> ''")


def readable_blocks(segments: DataFrame) -> DataFrame:
    """(media_id, block_index, section_start, start, end, text): greedy paragraphs, anchored on their first segment.

    The fold keeps where blocks begin and the present block's text; texts are put together once.
    """
    rows = readable(segments).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "pos", "text"))).alias("s"))
    line = "regexp_replace(concat(a.line, ' ', x.text), ' ([,.;:!?])', '$1')"
    section = f"cast(floor(x.start / {SECTION}) AS bigint)"
    fold = F.expr(
        f"""
        aggregate(s, named_struct('i', 0, 'b', cast(array() AS array<int>), 'section', -1L, 'from', 0D, 'until', 0D, 'line', '', 'last', ''), (a, x) ->
          if(a.i = 0 OR {section} <> a.section OR x.start - a.until >= {GAP} OR length(a.line) + 1 + length(x.text) > {MOST} OR x.end - a.from > {SECONDS}
             OR (length(a.line) >= {LEAST} AND a.last rlike '[.!?]["\\')\\\\]]?$'),
            named_struct('i', a.i + 1, 'b', concat(a.b, array(a.i)), 'section', {section}, 'from', x.start, 'until', x.end, 'line', x.text, 'last', x.text),
            named_struct('i', a.i + 1, 'b', a.b, 'section', a.section, 'from', a.from, 'until', x.end, 'line', {line}, 'last', x.text)),
          a -> a.b)
        """
    )
    blocks = each(rows.withColumn("b", fold), ["media_id", "s", "b"], "b", ("block_index", "i"))
    part = F.expr("slice(s, i + 1, coalesce(get(b, block_index + 1), size(s)) - i)")
    return blocks.select("media_id", "block_index", part.alias("p")).select(
        "media_id", "block_index", (F.floor(F.col("p")[0]["start"] / SECTION) * SECTION).cast("bigint").alias("section_start"), F.col("p")[0]["start"].alias("start"),
        F.element_at("p", -1)["end"].alias("end"), F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), " "), " ([,.;:!?])", "$1").alias("text"),
    )


def prompt_windows(segments: DataFrame, least: int = 300, most: int = 12) -> DataFrame:
    """(media_id, id, start, end, text, char_count, segment_count): time buckets of a width that fits the recording."""
    rows = readable(segments).withColumn("duration", F.max("end").over(Window.partitionBy("media_id")))
    width = F.greatest(F.lit(least), F.ceil(F.col("duration") / most / 60) * 60).cast("bigint")
    placed = rows.withColumn("width", width).withColumn("bucket", F.least(F.floor(F.col("start") / F.col("width")), F.lit(most - 1)).cast("bigint"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "pos", "text")))
    grouped = placed.groupBy("media_id", "bucket").agg(F.first("width").alias("width"), F.first("duration").alias("duration"), F.count("*").alias("segment_count"), normalized(F.array_join(F.transform(ordered, lambda x: x["text"]), " ")).alias("text"))
    return grouped.select(
        "media_id", F.row_number().over(Window.partitionBy("media_id").orderBy("bucket")).alias("id"), (F.col("bucket") * F.col("width")).cast("double").alias("start"),
        F.least((F.col("bucket") + 1) * F.col("width"), "duration").alias("end"), "text", F.length("text").cast("bigint").alias("char_count"), "segment_count",
    )


def _joined(rows: DataFrame, part, order: str, by: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("t"))))
    return rows.groupBy("media_id").agg(F.array_join(F.transform(items, lambda x: x["t"]), by).alias("text"))


def render_srt(segments: DataFrame) -> DataFrame:
    """Subtitle text per recording, in input order; blank segments leave gaps in the numbers."""
    n = F.row_number().over(Window.partitionBy("media_id").orderBy("pos"))
    text = F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    rows = segments.withColumn("n", n).withColumn("text", text).where("text <> ''")
    part = F.concat(F.col("n").cast("string"), F.lit("\n"), timestamp(F.col("start"), True), F.lit(" --> "), timestamp(F.col("end"), True), F.lit("\n"), F.col("text"))
    return _joined(rows, part, "pos", "\n\n").select("media_id", F.concat("text", F.lit("\n")).alias("srt"))


def prompt_lines(segments: DataFrame) -> DataFrame:
    text = F.trim(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " "))
    rows = segments.withColumn("text", text).where("text <> ''")
    return _joined(rows, F.concat(F.lit("["), timestamp(F.col("start")), F.lit("] "), F.col("text")), "pos", "\n").select("media_id", F.col("text").alias("prompt"))


def render_windows(windows: DataFrame) -> DataFrame:
    part = F.concat(F.lit('<window id="'), F.col("id").cast("string"), F.lit('" time="'), clock(F.col("start")), F.lit("-"), clock(F.col("end")), F.lit('">\n'), F.col("text"), F.lit("\n</window>"))
    return _joined(windows, part, "id", "\n\n").select("media_id", F.col("text").alias("prompt"))


def render_markdown(segments: DataFrame, title: str) -> DataFrame:
    """The transcript as Markdown: a heading for each section, a paragraph for each block."""
    section = F.col("section_start").cast("double")
    heading = F.concat(F.lit("## "), clock(section), F.lit("–"), clock(section + SECTION), F.lit("\n\n"))
    by = Window.partitionBy("media_id").orderBy("block_index")
    before = F.lag("section_start").over(by)
    head = F.when(before.isNull(), heading).when(before != F.col("section_start"), F.concat(F.lit("\n"), heading)).otherwise(F.lit(""))
    rows = readable_blocks(segments).withColumn("part", F.concat(head, F.lit("**["), clock(F.col("start")), F.lit("]** "), F.col("text"), F.lit("\n")))
    top = f"# Transcript — {title}\n\n> {NOTICE}\n\n"
    return _joined(rows, F.col("part"), "block_index", "\n").select("media_id", F.concat(F.lit(top), F.regexp_replace("text", r"(?U)\s+$", ""), F.lit("\n")).alias("markdown"))
