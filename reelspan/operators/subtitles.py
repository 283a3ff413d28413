"""Subtitles: correction chunks, cues and subtitle documents, per recording.

Chunks are greedy and anchored on their first member. A recording's segments
meet in one exchange, in order, and its chunks are made in Arrow batches: a walk
over segments says where they begin, and tokens are placed as whole columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reelspan.functions.batches import whole_groups
from reelspan.functions.text import ass_text, ass_time, balanced_lines, each, timestamp
from reelspan.operators.cues import CLOSING, OPENING, build_cues
from reelspan.operators.segments import _joined, readable
from reelspan.operators.tokens import LEAST_SECONDS, TOKEN, WORD_CHARACTER, token_arrays

__all__ = ["build_cues", "chunk_number", "chunk_tokens", "correction_chunks", "subtitle_ass", "subtitle_srt", "words_of_chunks", "words_of_tokens"]

#: Tokens of a chunk as a column.
PLACED = "array<struct<source_id: string, token_index: bigint, text: string, char_start: int, char_end: int, start: double, end: double, timing_source: string, probability: double>>"

#: Segments of a packed chunk as a column.
PARTS = "array<struct<pos: bigint, start: double, end: double, n: int>>"

#: Fixed format of the styled subtitle document.
ASS_HEADER = """[Script Info]
ScriptType: v4.00+
PlayResX: 1920
PlayResY: 1080
WrapStyle: 2
ScaledBorderAndShadow: yes

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,DejaVu Sans,52,&H00FFFFFF,&H000000FF,&H00000000,&H80000000,-1,0,0,0,100,100,0,0,1,3,1,2,48,48,54,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"""


def _written(segments: DataFrame) -> DataFrame:
    """Readable segments, a recording's in one partition, with their tokens as written; times are still to be divided. Texts are exchanged, as tokens take more room."""
    rows = readable(segments).where(F.col("text").rlike(WORD_CHARACTER)).repartition("media_id")
    return rows.select("media_id", "pos", "start", "end", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tokens"))


def _padded(numbers: np.ndarray, width: int) -> pa.Array:
    if len(numbers) and numbers.min() < 0:
        return pa.array([f"{x:0{width}d}" for x in numbers.tolist()], pa.string())
    return pc.utf8_lpad(pa.array(numbers).cast(pa.string()), width, "0")


def _source_ids(pos: np.ndarray, at: np.ndarray) -> pa.Array:
    return pc.cast(pc.binary_join_element_wise("s", _padded(pos.astype(np.int64), 6), ":t", _padded(at, 4), ""), pa.string())


def _marks(texts: pa.Array, marks: str, last: bool) -> np.ndarray:
    """Which texts have one of the marks as their first or last character."""
    edge = pc.utf8_slice_codeunits(texts, -1, None) if last else pc.utf8_slice_codeunits(texts, 0, 1)
    return np.asarray(pc.is_in(edge, pa.array(list(marks))))


def _first_segments(media: np.ndarray, start: np.ndarray, end: np.ndarray, most: float) -> np.ndarray:
    """Which segments begin a chunk: the first of a recording, and those that end too late after the chunk's first."""
    low, high = np.rint(start * 1e6).tolist(), np.rint(end * 1e6).tolist()
    new = np.append(True, media[1:] != media[:-1])
    begin = 0.0
    for i, fresh in enumerate(new.tolist()):
        if fresh or high[i] - begin > most:
            new[i], begin = True, low[i]
    return new


def _chunks(whole: pa.Table, most: float, schema: pa.Schema) -> pa.RecordBatch:
    """The chunks of whole recordings, whose segments come in order."""
    whole = whole.combine_chunks()
    column = lambda n: whole.column(n).chunk(0)
    start, end, pos = (np.asarray(column(n)) for n in ("start", "end", "pos"))
    media, lists = column("media_id"), column("tokens")
    each_ = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), each_)
    at = np.arange(len(row)) - np.repeat(np.cumsum(each_) - each_, each_)
    if pa.types.is_struct(flat.type):
        text, begins, ends, kind, known = (flat.field(n) for n in ("text", "start", "end", "timing_source", "probability"))
    else:  # evenly divided
        text, length = pc.replace_substring(flat, " ", ""), np.maximum(LEAST_SECONDS, end - start)[row]
        begins, ends = (pa.array(start[row] + length * i / each_[row]) for i in (at, at + 1))
        kind, known = pa.repeat("segment_interpolation", len(row)), pa.nulls(len(row), pa.float64())
    code = media.dictionary_encode(null_encoding="encode").indices.to_numpy()
    new = _first_segments(code, start, end, most)
    chunk = np.cumsum(new) - 1  # of each segment
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(new)) - 1
    n = np.bincount(chunk, weights=each_).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)])  # where each chunk's tokens begin
    own = chunk[row]
    # a space before or after these marks goes from a line, and two of its tokens would be one
    joined = _marks(text, CLOSING, False)[1:] | _marks(text, OPENING, True)[:-1]
    if (joined & (own[1:] == own[:-1])).any():
        raise ValueError("a chunk's line has not the tokens that went into it")
    kept = schema.field(len(schema) - 1)
    if kept.name == "parts":
        offsets, items = np.append(head, len(new)), [pa.array(pos.astype(np.int64)), pa.array(start), pa.array(end), pa.array(each_.astype(np.int32))]
    else:
        size = np.asarray(pc.utf8_length(text)).astype(np.int64)
        reach = np.concatenate([[0], np.cumsum(size + 1)])
        place = reach[:-1] - reach[first[:-1]][own]
        index = np.arange(len(row)) - first[:-1][own]
        offsets, items = first, [_source_ids(pos[row], at), pa.array(index), text, pa.array(place.astype(np.int32)), pa.array((place + size).astype(np.int32)), begins, ends, kind, known]
    items = pa.StructArray.from_arrays(items, fields=list(kept.type.value_type))
    number = np.arange(len(head)) - np.maximum.accumulate(np.where(np.append(True, code[head][1:] != code[head][:-1]), np.arange(len(head)), 0))
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), text), " ")
    return pa.RecordBatch.from_arrays(
        [
            media.take(pa.array(head)), pc.binary_join_element_wise("c", _padded(number + 1, 3), ""), pa.array(start[head]), pa.array(end[tail]),
            line, pa.array((tail - head + 1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items, type=kept.type),
        ],
        schema=schema,
    )


def line_tokens(text: pa.Array) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """The tokens of chunks' lines, and where they begin and end in them, one after the other."""
    lists = pc.split_pattern(text, " ")
    n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    size = np.asarray(pc.utf8_length(lists.flatten())).astype(np.int64)
    reach = np.concatenate([[0], np.cumsum(size + 1)])
    begins = reach[:-1] - np.repeat(reach[np.cumsum(n) - n], n)
    return lists, begins, begins + size


def packed_tokens(text: pa.Array, parts: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """How many tokens chunks have that keep ``parts``, and the tokens, one after the other, as ``correction_chunks`` tells them."""
    lists, begins, ends = line_tokens(text)
    pos, start, end, n = (np.asarray(x) for x in parts.flatten().flatten())
    n = n.astype(np.int64)
    part = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
    length = np.maximum(LEAST_SECONDS, end - start)[part]
    low, high = (pa.array(start[part] + length * i / n[part]) for i in (at, at + 1))
    return np.asarray(pc.list_value_length(lists)).astype(np.int64), {
        "source_ids": _source_ids(pos[part], at), "words": lists.flatten(), "char_starts": pa.array(begins), "char_ends": pa.array(ends),
        "starts": low, "ends": high, "timing_sources": pa.repeat("segment_interpolation", len(part)),
    }


def correction_chunks(segments: DataFrame, seconds: float = 120.0, packed: bool = False) -> DataFrame:
    """(media_id, chunk_id, start, end, text, n_segments, tokens): greedy chunks; a longer segment is one by itself.

    The text is the tokens as a line, and a token's place is that in this text.
    It is an error if the line doesn't have the tokens that went into it. Lengths
    are compared in whole microseconds: 1059.2 to 1179.2 is 120 seconds, not more.
    Packed chunks have ``parts`` in place of tokens, where times are evenly
    divided: the segments' places, times and numbers of tokens, from which and the
    text the tokens are made again in a small part of their room.
    """
    if not 30 <= seconds <= 150:
        raise ValueError("seconds must be from 30 to 150")
    given = "words" in segments.columns
    parts = token_arrays(segments).repartition("media_id") if given else _written(segments)
    kind = parts.schema["media_id"].dataType.simpleString()
    schema = f"media_id {kind}, chunk_id string, start double, end double, text string, n_segments int, " + (f"parts {PARTS}" if packed and not given else f"tokens {PLACED}")
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    most = float(round(seconds * 1e6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, "media_id"):
            yield _chunks(whole, most, arrow)

    ordered = parts.sortWithinPartitions("media_id", "start", "end", "pos", "tokens")
    return ordered.mapInArrow(run, schema)


def chunk_tokens(chunks: DataFrame) -> DataFrame:
    """A row for each token of the chunks."""
    return each(chunks, ["media_id", "chunk_id"], "tokens", ("t",)).select("media_id", "chunk_id", "t.*")


def chunk_number(chunk_id: Column) -> Column:
    """Chunk ids in order, beyond c999 too."""
    return F.substring(chunk_id, 2, 20).cast("int")


def words_of_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens as words for cues, in the order of segments and tokens."""
    return tokens.select("media_id", F.struct("pos", "token_index").alias("sequence"), "start", "end", "text")


def words_of_chunks(tokens: DataFrame) -> DataFrame:
    """Tokens of chunks as words for cues, in the order of chunks and tokens."""
    return tokens.select("media_id", F.struct(chunk_number(F.col("chunk_id")).alias("chunk"), "token_index").alias("sequence"), "start", "end", "text")


def subtitle_srt(cues: DataFrame) -> DataFrame:
    """(media_id, srt): cues numbered without gaps, long ones on two lines."""
    part = F.concat((F.col("cue_index") + 1).cast("string"), F.lit("\n"), timestamp(F.col("start"), True), F.lit(" --> "), timestamp(F.col("end"), True), F.lit("\n"), balanced_lines(F.col("text")))
    return _joined(cues, part, "cue_index", "\n\n").select("media_id", F.concat("text", F.lit("\n")).alias("srt"))


def subtitle_ass(cues: DataFrame) -> DataFrame:
    """(media_id, ass): the styled subtitle document."""
    part = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start")), F.lit(","), ass_time(F.col("end")), F.lit(",Default,,0,0,0,,"), ass_text(F.col("text")))
    return _joined(cues, part, "cue_index", "\n").select("media_id", F.concat(F.lit(ASS_HEADER + "\n"), "text", F.lit("\n")).alias("ass"))


