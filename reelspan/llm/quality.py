r"""Quality rules: characters inside repeated n-grams and lines, by rolling hashes.

A text's words are `[^\x20\x09-\x0D]+`. For each n in LENGTHS, a rolling
polynomial hash over word codes gives every n-word window of a text in one
numpy pass; windows whose hash occurs twice or more in the same text are
duplicates, and the characters of the words inside them are counted once. As an
(n+1)-gram repeats only where both its n-grams do, each length looks only at
what the length before has left. Nothing is shuffled: a row's result depends on
that row alone.

Null and empty texts have no words and fail the base rule (fewer than 50
words). Very long texts are taken whole, alone in their block. Repeated rows
get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelspan.llm.common import NOT_SPACE, U64, Roller, Words, covered, mix, pieces, repeated, sums

#: The window lengths measured, with the largest share of word characters that may lie in duplicates, in percent.
LENGTHS = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 50
    max_dup_line_char_percent: int = 30
    max_ngram_percent: tuple[tuple[int, int], ...] = tuple(LENGTHS.items())


SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(column: pa.Array, rules: QualityRules) -> dict[str, np.ndarray]:
    words = Words(column, NOT_SPACE)
    rows, offsets = len(words.offsets) - 1, words.offsets
    lead = (words.data & 0xC0) != 0x80
    out = {"n_words": words.counts, "n_symbols": sums(SYMBOL[words.data], offsets), "word_chars": sums(lead & NOT_SPACE[words.data], offsets)}
    chars_before = np.zeros(len(lead) + 1, np.int64)
    np.cumsum(lead, out=chars_before[1:])
    size = chars_before[words.ends] - chars_before[words.starts]
    # windows, three words first
    row, n = words.rows, len(words)
    codes = mix(words.ids().astype(U64) + U64(1))
    roll, salt = Roller(codes), mix(row.astype(U64) + U64(77))
    alive = np.arange(n)
    for width in (3, *(k for k, _ in rules.max_ngram_percent)):
        alive = alive[alive + width <= n]
        alive = alive[row[alive] == row[alive + width - 1]] if len(alive) else alive
        twice = repeated(roll.at(alive, width) ^ salt[alive])
        starts = alive[twice]
        hit = covered(starts, width, n)
        if width == 3:
            out["n_repeat_words"] = sums(hit, words.first)
        else:
            out[f"dup_chars_{width}"] = sums(hit * size, words.first)
        alive = starts
    # lines: the piece between two line feeds; equal to an earlier one of the same text, and with a word
    breaks = np.flatnonzero(words.data == 10)
    begins, ends, line_row = lines_of(words.data, offsets, breaks)
    some = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, begins)
    begins, ends, line_row = begins[some], ends[some], line_row[some]
    text = Roller(mix(words.data.astype(U64) + U64(0x51ED27)))
    key = mix(text.at(begins, ends - begins) + (ends - begins).astype(U64)) ^ mix(line_row.astype(U64) + U64(77))
    later = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key, kind="stable")
        later[order[1:]] = key[order][1:] == key[order][:-1]
    first_line = np.searchsorted(line_row, np.arange(rows + 1))
    inside = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=inside[1:])
    line_chars = inside[np.searchsorted(words.starts, ends)] - inside[np.searchsorted(words.starts, begins)]
    return out | {"n_lines": np.diff(first_line), "n_dup_lines": sums(later, first_line), "dup_line_chars": sums(later * line_chars, first_line)}


def lines_of(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every line; a text has one line more than line feeds."""
    per_row = np.diff(np.searchsorted(breaks, offsets)) + 1
    row = np.repeat(np.arange(len(per_row)), per_row)
    at = np.cumsum(per_row)
    ends, begins = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    last = np.zeros(len(row), bool)
    last[at - 1] = True
    ends[last], ends[~last] = offsets[1:], breaks
    first = np.zeros(len(row), bool)
    first[at - per_row] = True
    begins[first], begins[~first] = offsets[:-1], breaks + 1
    return begins, ends, row


def verdict(m: dict[str, np.ndarray], rules: QualityRules) -> tuple[np.ndarray, np.ndarray]:
    base_failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
    bad = 100 * m["n_symbols"] > rules.max_symbol_percent * m["word_chars"]
    bad |= 100 * m["n_dup_lines"] > rules.max_dup_line_percent * m["n_lines"]
    bad |= 100 * m["dup_line_chars"] > rules.max_dup_line_char_percent * m["word_chars"]
    for k, most in rules.max_ngram_percent:
        bad |= 100 * m[f"dup_chars_{k}"] > most * m["word_chars"]
    return base_failed, ~base_failed & ~bad


def quality_columns(rules: QualityRules) -> list[str]:
    return [*MEASURES, "n_lines", "dup_line_chars", *(f"dup_chars_{k}" for k, _ in rules.max_ngram_percent)]


def measure_quality(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns of each row with its counts, base_failed and kept."""
    names = quality_columns(rules)
    kept = docs.select(*carry, *([text] if text not in carry else []))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema] + [f"{n} bigint" for n in names] + ["base_failed boolean", "kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                m = measure(part.column(text), rules)
                failed, good = verdict(m, rules)
                columns = [part.column(c) for c in carry] + [pa.array(m[n], pa.int64()) for n in names] + [pa.array(failed), pa.array(good)]
                yield pa.RecordBatch.from_arrays(columns, names=[*carry, *names, "base_failed", "kept"])

    return kept.mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """The rows that the rules keep, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                _, good = verdict(measure(part.column(text), rules), rules)
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
