"""Cues of subtitles from timed words: where each possible cue would end is computed for all words at once, and a recording's cues follow from there."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.functions.text import SPACE, tight

#: Fixed values of cues: gap, most seconds, most characters, most words, least seconds of a sentence, least display.
CUE_GAP, CUE_SECONDS, CUE_CHARS, CUE_WORDS, CUE_SENTENCE, CUE_DISPLAY = 0.65, 6.0, 78, 16, 1.0, 1.0
#: Fixed values of overlaps: the least cue, the distance between cues, and how much later a cue starts that only cuts the one before.
CUE_LEAST, CUE_APART, CUE_LATER = 0.05, 0.02, 0.08
#: Fixed marks: no space goes before closing or after opening ones; a sentence ends with a stop and at most one quote or bracket.
CLOSING, OPENING, STOPS, QUOTES = ",.;:!?%])", "[(", ".!?", "\"')]"


class Words:
    """The words of a recording in order, with what their joining needs."""

    def __init__(self, start: np.ndarray, end: np.ndarray, text: list[str], ids: list[list[str]]):
        self.start, self.end, self.text, self.ids, self.n = start, end, text, ids, len(text)
        head, tail = [t[0] for t in text], [t[-1] for t in text]
        before = ["", *tail[:-1]]
        self.space = np.array([h not in CLOSING and b not in OPENING for h, b in zip(head, before, strict=True)], np.int64)
        self.reach = np.concatenate([[0], np.cumsum(np.array([len(t) for t in text], np.int64) + self.space)])
        ends = lambda t: t[-1] in STOPS or (len(t) > 1 and t[-1] in QUOTES and t[-2] in STOPS)
        self.stops = np.array([ends(t) for t in text])
        # a lone quote ends the sentence of the word that it joins
        self.stops_with = self.stops | np.array([len(t) == 1 and t in QUOTES and b in STOPS and b != "" for t, b in zip(text, before, strict=True)]) & (self.space == 0)

    def nexts(self) -> np.ndarray:
        """For each word, the word after the cue that would begin with it."""
        first = np.arange(self.n)
        out = np.full(self.n, -1)
        gap = np.append(np.inf, self.start[1:] - self.end[:-1])
        for k in range(1, CUE_WORDS + 1):
            open_ = np.flatnonzero(out < 0)
            at = first[open_] + k
            over = at >= self.n
            e = np.minimum(at, self.n - 1)
            sentence = (self.stops if k == 1 else self.stops_with)[e - 1 + over] & (self.end[e - 1 + over] - self.start[open_] >= CUE_SENTENCE)
            length = self.reach[e + 1] - self.reach[open_] - self.space[open_]
            done = over | sentence | (gap[e] >= CUE_GAP) | (self.end[e] - self.start[open_] > CUE_SECONDS) | (length > CUE_CHARS) | (k == CUE_WORDS)
            out[open_[done]] = at[done]
        return out

    def cues(self) -> list[tuple[float, float, str, list[str]]]:
        """The cues by words alone, each held to its least and most length."""
        after, firsts, at = self.nexts().tolist(), [], 0
        while at < self.n:
            firsts.append(at)
            at = after[at]
        out = []
        for a, b in pairwise([*firsts, self.n]):
            line = self.text[a] + "".join((" " if s else "") + t for s, t in zip(self.space[a + 1 : b], self.text[a + 1 : b], strict=True))
            begin = float(self.start[a])
            out.append((max(0.0, begin), min(begin + CUE_SECONDS, max(begin + CUE_LEAST, float(self.end[b - 1]))), line, [i for own in self.ids[a:b] for i in own]))
        return out


def line_of(*parts: str) -> str:
    """Lines joined as words are."""
    out = parts[0]
    for p in parts[1:]:
        out += p if p[0] in CLOSING or out[-1] in OPENING else f" {p}"
    return out


def apart(cues: list[tuple]) -> list[tuple]:
    """Cues that don't overlap. One that starts in another cuts it if it starts clearly later; else it goes into it, or after it where the line would be too long."""
    if all(b[0] >= a[1] for a, b in pairwise(cues)):
        return cues
    out = cues[:1]
    for start, end, text, ids in cues[1:]:
        s, e, t, own = out[-1]
        if start < e and start <= s + CUE_LATER:
            line = line_of(t, text)
            if len(line) <= CUE_CHARS:
                out[-1] = (s, min(s + CUE_SECONDS, max(e, end)), line, [*own, *ids])
                continue
            start = e + CUE_APART
            end = min(start + CUE_SECONDS, max(start + CUE_LEAST, end))
        elif start < e:
            out[-1] = (s, max(s + CUE_LEAST, start - CUE_APART), t, own)
        out.append((start, end, text, ids))
    return out


def shown(cues: list[tuple]) -> list[tuple]:
    """Cues as long as they are displayed: not into the next one, and CUE_DISPLAY at least where there is room."""
    start, end = (np.array([c[k] for c in cues]) for k in (0, 1))
    until = np.minimum(start + CUE_SECONDS, np.append(start[1:] - CUE_APART, np.inf))
    end = np.maximum(np.minimum(end, until), np.minimum(start + CUE_DISPLAY, until))
    return [(s, e, t, ids) for s, e, (_, _, t, ids) in zip(start.tolist(), end.tolist(), cues, strict=True)]


SCHEMA = "media_id bigint, cue_index int, start double, end double, text string, correction_ids array<string>"
KINDS = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.string())]


def build_cues(words: DataFrame) -> DataFrame:
    """(media_id, cue_index, start, end, text, correction_ids) of words (media_id, sequence, start, end, text[, correction_ids]).

    Blank words and those without a finite start are dropped; an end that is no
    number or before the start counts as the start, an infinite one drops the
    word. A recording's words meet in one exchange; a task holds one recording's.
    """
    text = tight(F.trim(F.regexp_replace("text", SPACE, " ")))
    start = F.coalesce("start", F.lit(0.0))
    given = F.coalesce("end", start)
    end = F.when(F.isnan(given) | (given < start), start).otherwise(given)
    ids = F.coalesce("correction_ids", F.array().cast("array<string>")) if "correction_ids" in words.columns else F.array().cast("array<string>")
    clean = words.where(F.col("media_id").isNotNull()).select(F.col("media_id").cast("bigint").alias("media_id"), "sequence", start.alias("start"), end.alias("end"), text.alias("text"), ids.alias("ids"))
    finite = lambda n: ~F.isnan(n) & (F.abs(n) < float("inf"))
    clean = clean.where((F.length("text") > 0) & finite("start") & finite("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts)
            media = np.asarray(whole.column("media_id"))
            first = np.flatnonzero(np.append(True, media[1:] != media[:-1]))
            start, end = np.asarray(whole.column("start")), np.asarray(whole.column("end"))
            text, ids, out = whole.column("text").to_pylist(), whole.column("ids").to_pylist(), []
            for a, b in pairwise([*first.tolist(), len(media)]):
                cues = shown(apart(Words(start[a:b], end[a:b], text[a:b], ids[a:b]).cues()))
                out += [(media[a], i, *c) for i, c in enumerate(cues)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            media = np.asarray(batch.column("media_id"))
            cut = int(np.flatnonzero(media != media[-1])[-1]) + 1 if media[0] != media[-1] else 0  # where the last recording begins
            if held and (cut or held[-1].column("media_id")[-1].as_py() != media[0]):
                yield made([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield made([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield made(held)

    ordered = clean.repartition("media_id").sortWithinPartitions("media_id", "sequence", "start").drop("sequence")
    return ordered.mapInArrow(run, SCHEMA)
