r"""Suffix-array dedup by run-length indexes: bytes inside strings of ``length`` bytes that also start elsewhere.

Texts count as UTF-8 bytes; matches stay inside a document. Each window of
``length`` bytes belongs to its minimizer (the least hash of a GRAM-byte
substring in it), so equal windows have equal minimizers at equal offsets, and
only windows of one minimizer need comparing. Per stretch of windows with one
minimizer, a task emits a few numbers. Minimizers met once are done. Stretches
whose whole content is met twice or more are repeats, known without their
text. What remains is fetched: two pieces for each stretch, keyed by a core
that all windows of the piece contain, so equal windows meet in one shard.

A shard's pieces, with separators, become a run-compressed Burrows-Wheeler
transform with the suffix positions of run heads and run ends as samples. The
matching statistics of the shard against itself (the longest match of each
position anywhere else) stream from these samples: at a run head or end the
match with the suffix next in order is measured, and from there it shrinks by
one per position until the next sample. Positions with ``length`` or more start
a repeated window. Minimizers met in more than HOT different stretches don't
fit one shard; their windows are keyed by hashes one by one instead.

Null and empty texts have no bytes. Identical repeated rows are each other's
repeats. Keys are 64-bit hashes (128 for stretches); nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import U64, Roller, mix, pieces, row_key, stored, text_bytes
from reelspan.llm.suffix import byte_suffix_array

LENGTH, GRAM, HOT, SHARD = 200, 32, 4096, 900_000
#: A stretch packs its width into ten bits.
MOST_WIDTH = 1024


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of x[i : i + width], for all whole windows, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    block = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


@dataclass
class Stretches:
    """Maximal stretches of window starts [low, high] with one minimizer, by byte positions in their row."""

    row: np.ndarray
    gram: np.ndarray
    content: np.ndarray
    low: np.ndarray
    high: np.ndarray
    at: np.ndarray


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Stretches:
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return Stretches(none, none, none, none, none, none)
    codes = mix(np.arange(256, dtype=U64) + U64(0x51ED27))[data]
    roll = Roller(codes)
    n = len(data) - gram + 1
    h = mix((roll.prefix[gram:] - roll.prefix[:n]) * roll.down[:n])
    bits = U64(max(1, int(n).bit_length()))
    least = sliding_min((h >> bits << bits) | np.arange(n, dtype=U64), length - gram + 1)
    where = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
    each = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(each)), each)
    start = np.repeat(offsets[:-1] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    if not len(start):
        return Stretches(none, none, none, none, none, none)
    at = where[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(first[1:], len(start)) - 1
    low, high, at, row = start[first], start[last], at[first], row[first]
    content = mix(roll.at(low, high - low + length) + mix(((at - low) * 1_000_003 + high - low).astype(U64)))
    base = offsets[row]
    return Stretches(row, h[at].view(np.int64), content.view(np.int64), low - base, high - base, at - base)


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of pieces of bytes, with samples at run heads and ends.

    heads and ends are suffix positions where runs begin and end; head_match and
    end_match the lengths that the suffix there shares with the one before or
    after it in order. Suffixes are ordered beyond the longest piece, so all
    matches inside pieces are decided. The separator 0xFF is in no UTF-8.
    """

    def __init__(self, parts: list[bytes]):
        size = np.array([len(p) for p in parts])
        self.begin = np.cumsum(size + 1) - size - 1
        self.stop = self.begin + size
        data = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
        n = len(data)
        most = int(size.max()) + 1
        sa = byte_suffix_array(data, most)
        bwt = data[sa - 1]  # separators differ, so each is a run of its own
        first = np.flatnonzero(np.concatenate([[True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0xFF)]))
        last = np.append(first[1:], n) - 1
        self.symbols, self.lengths, self.n = bwt[first], last - first + 1, n
        self.heads, self.ends = sa[first], sa[last]
        before, after = sa[np.maximum(first - 1, 0)], sa[np.minimum(last + 1, n - 1)]
        self.head_match = np.where(first > 0, _common(data, self.heads, before, most), 0)
        self.end_match = np.where(last < n - 1, _common(data, self.ends, after, most), 0)

    def matching_statistics(self) -> np.ndarray:
        """For each position, the length of its longest match at any other position; no match goes beyond its piece."""
        most = np.maximum(self._stream(self.heads, self.head_match), self._stream(self.ends, self.end_match))
        return np.minimum(most, np.repeat(self.stop, np.diff(np.append(self.begin, self.n))) - np.arange(self.n))

    def _stream(self, at: np.ndarray, match: np.ndarray) -> np.ndarray:
        source = np.zeros(self.n, np.int64)
        source[at] = at
        np.maximum.accumulate(source, out=source)
        value = np.zeros(self.n, np.int64)
        value[at] = match
        return np.maximum(value[source] - (np.arange(self.n) - source), 0)


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, as far as ``most``."""
    n = len(data)
    text = np.concatenate([data, np.full(8, 0xFF, np.uint8)])
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    word = np.lib.stride_tricks.sliding_window_view(text, 8)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        fits = np.maximum(x, y) < n
        live, x, y = live[fits], x[fits], y[fits]
        same = word[x] == word[y]
        run = np.where(same.all(1), 8, same.argmin(1))
        out[live] += run
        live = live[(run == 8) & (out[live] < most)]
    return out


def _fingerprints(rows: DataFrame, length: int, gram: int, whole: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                s = stretches(*text_bytes(part.column("text")), length, gram)
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(s.gram)], names=["gram"])
                    continue
                pos = s.low << 20 | (s.high - s.low) << 10 | (s.at - s.low)
                yield pa.RecordBatch.from_arrays([pa.array(s.gram), pa.array(s.content), part.column("rk").take(pa.array(s.row)), pa.array(pos)], names=["gram", "content", "rk", "pos"])

    return rows.select("rk", "text").mapInArrow(run, "gram bigint, content bigint, rk bigint, pos bigint") if whole else rows.select("text").mapInArrow(run, "gram bigint")


def _shards(parts: DataFrame, length: int, most: int = SHARD) -> DataFrame:
    """(rk, s, e) of repeated windows in pieces (core, rk, base, done, body), through an index of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size, current = 0, None

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            index = RunLengthIndex([r[3] for r in rows])
            start = np.flatnonzero(index.matching_statistics() >= length)
            piece = np.searchsorted(index.begin, start, "right") - 1
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(start) > length) | (np.diff(piece) > 0)])) if len(start) else start
            last = np.append(cut[1:], len(start)) - 1 if len(start) else start
            which = piece[cut] if len(start) else start
            low, high = (start[cut] - index.begin[which], start[last] - index.begin[which] + length) if len(start) else (start, start)
            base, rk, done = (np.array([r[k] for r in rows]) for k in (1, 0, 2))
            keep = ~done[which].astype(bool)
            which, low, high = which[keep], low[keep], high[keep]
            return pa.RecordBatch.from_arrays([pa.array(rk[which], pa.int64()), pa.array(base[which] + low, pa.int64()), pa.array(base[which] + high, pa.int64())], names=["rk", "s", "e"])

        for batch in batches:
            for core, *rest in zip(*(batch.column(c).to_pylist() for c in ("core", "rk", "base", "done", "body")), strict=True):
                if core != current:
                    if len(group) > 1:
                        held += group
                        size += sum(len(r[3]) for r in group)
                        if size >= most:
                            yield solve(held)
                            held, size = [], 0
                    group, current = [], core
                group.append(tuple(rest))
        if len(group) > 1:
            held += group
        if held:
            yield solve(held)

    return parts.repartition("core").sortWithinPartitions("core").mapInArrow(run, "rk bigint, s bigint, e bigint")


def _by_window(parts: DataFrame, length: int) -> DataFrame:
    """The same for very frequent minimizers: every window by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("body"))
            each = np.diff(offsets) - length + 1
            row = np.repeat(np.arange(len(each)), each)
            start = np.repeat(offsets[:-1] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            roll = Roller(mix(data.astype(U64) + U64(0x51ED27)))
            s = pa.array(np.asarray(batch.column("base"))[row] + start - offsets[row])
            yield pa.RecordBatch.from_arrays([pa.array(roll.at(start, length).view(np.int64)), batch.column("core").take(pa.array(row)), batch.column("rk").take(pa.array(row)), s], names=["wh", "core", "rk", "s"])

    parts = stored(parts, "hot-pieces")
    often = parts.groupBy("core").count().where("count > 1").select("core")
    windows = parts.join(often, "core", "left_semi").mapInArrow(run, "wh bigint, core bigint, rk bigint, s bigint")
    windows = stored(windows, "hot-windows")
    twice = windows.groupBy("wh", "core").count().where("count > 1").select("wh", "core")
    return windows.join(twice, ["wh", "core"], "left_semi").select("rk", "s", (F.col("s") + length).alias("e"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(rk, s, e): byte ranges of rows (rk, text) that lie in repeated windows; they may overlap and repeat."""
    often = stored(_fingerprints(rows, length, gram, False).groupBy("gram").count().where("count > 1").select("gram"), "grams")
    met = stored(_fingerprints(rows, length, gram, True).join(often, "gram", "left_semi"), "stretches")
    kinds = stored(met.groupBy("gram", "content").agg(F.count("*").alias("n"), F.min(F.struct("rk", "pos")).alias("x")).select("gram", "content", "n", "x.rk", "x.pos"), "kinds")
    low, reach, off = F.shiftright("pos", 20), F.shiftright("pos", 10).bitwiseAND(F.lit(1023)), F.col("pos").bitwiseAND(F.lit(1023))
    known = met.join(kinds.where("n > 1").select("gram", "content"), ["gram", "content"], "left_semi").select("rk", low.alias("s"), (low + reach + length).alias("e"))
    various = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_ = kinds.join(various, "gram").where("n = 1 OR kinds > 1").select("rk", "kinds", (F.col("n") > 1).alias("done"), low.alias("low"), (low + reach).alias("high"), (low + off).alias("at"))
    half = (length - gram) // 2
    piece = lambda cls, lo, hi, core: (
        f"named_struct('lo', {lo}, 'hi', {hi}, 'core', xxhash64({cls}, substring(bin, cast({core} + 1 as int), {half + gram})))"
    )
    right = piece(0, f"greatest(low, at - {half - 1})", "least(high, at)", "at")
    left = piece(1, "low", f"least(high, at - {half})", f"at - {half}")
    cut = (
        rows.join(open_, "rk").withColumn("bin", F.col("text").cast("binary"))
        .select("rk", "kinds", "done", "bin", F.explode(F.expr(f"filter(array({right}, {left}), p -> p.lo <= p.hi)")).alias("p"))
        .select(F.col("p.core").alias("core"), "rk", "kinds", F.col("p.lo").alias("base"), "done", F.expr(f"substring(bin, cast(p.lo + 1 as int), cast(p.hi - p.lo + {length} as int))").alias("body"))
    )
    spans = known.unionByName(_shards(cut.where(F.col("kinds") <= hot).drop("kinds"), length))
    if not various.where(F.col("kinds") > hot).isEmpty():
        spans = spans.unionByName(_by_window(cut.where(F.col("kinds") > hot).drop("kinds"), length))
    return spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (merged byte ranges removed) and kept (the bytes that are left), a row for each row of docs."""
    if not 0 < gram <= length < gram + MOST_WIDTH:
        raise ValueError(f"length must be from gram to less than gram + {MOST_WIDTH}")
    rows = docs.select(F.col(doc_id), row_key(doc_id, text).alias("rk"), F.col(text).alias("text")).repartition("rk")
    spans = repeated_spans(docs.select(row_key(doc_id, text).alias("rk"), F.coalesce(text, F.lit("")).alias("text")), length, gram, hot)
    gone = spans.groupBy("rk").agg(F.collect_set(F.struct("s", "e")).alias("spans")).withColumnRenamed("rk", "__rk")
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                data, offsets = text_bytes(part.column("text"))
                kept, merged = [], []
                for k, ranges in enumerate(part.column("spans").to_pylist()):
                    own = data[offsets[k] : offsets[k + 1]]
                    if not ranges:
                        kept.append(own.tobytes())
                        merged.append([])
                        continue
                    s, e = (np.array([r[c] for r in ranges]) for c in "se")
                    step = np.bincount(s, minlength=len(own) + 1) - np.bincount(e, minlength=len(own) + 1)
                    inside = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
                    kept.append(own[~inside].tobytes())
                    merged.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(np.diff(offsets)), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=[doc_id, "n_bytes", "spans", "kept"])

    joined = rows.join(gone, F.col("rk") == F.col("__rk"), "left").select(doc_id, "text", "spans")
    return joined.mapInArrow(run, f"`{doc_id}` {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
