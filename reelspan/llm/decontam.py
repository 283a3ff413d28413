r"""Benchmark decontamination: an FM-index for each shard of training text, searched for the benchmark's phrases.

A phrase is a window of ``width`` consecutive words of an item (or the whole
item, if it is shorter). Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the
text with A-Z lower-cased. A task cuts its documents into shards of
SHARD_BYTES. Text that no phrase can touch is left out of a shard's index: words
that no phrase has, and runs in which neighbouring words are never neighbours
in a phrase, or that are shorter than the shortest phrase. What remains, with
separators between the runs, gets a suffix array, a wavelet matrix over its
Burrows-Wheeler transform and sampled suffix positions; all phrases are
searched backwards at once, occurrences are located, and hits merge into
spans. All of that is exact.

The benchmark is the stated query set. It is read in blocks of at most about
BLOCK_LIMIT bytes of text (single larger items aside), and only a block is ever
on the driver or broadcast. Further blocks are further steps over the same
rows, without a shuffle.

Null and empty texts have no words and no hits; items without words have no
phrases; items with a null id mark words, but are not listed. Equal items are
all listed. Repeated rows get equal results. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import ALNUM, Words, covered, pieces
from reelspan.llm.suffix import FMIndex

WIDTH = 10
SHARD_BYTES = 8 << 20
BLOCK_LIMIT = 4 << 20
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Phrases:
    """The windows of a block of items: their words, the windows by length, and the items of each."""

    def __init__(self, ids: pa.Array, texts: pa.Array, width: int = WIDTH):
        words = Words(texts, ALNUM, lower=True)
        coded = words.array().dictionary_encode()
        self.words = coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        count = words.counts
        self.windows: list[tuple[int, np.ndarray]] = []
        owners: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        for length in np.unique(np.minimum(count[count > 0], width)):
            own = np.flatnonzero(np.minimum(count, width) == length)
            each = count[own] - length + 1
            start = np.repeat(words.first[own] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            rows, of = np.unique(code[start[:, None] + np.arange(length)], axis=0, return_inverse=True)
            self.windows.append((int(length), rows))
            owners.append((of.ravel() + at, np.repeat(own, each)))
            at += len(rows)
        self.count = at
        window = np.concatenate([w for w, _ in owners]) if owners else np.zeros(0, np.int64)
        item = np.concatenate([i for _, i in owners]) if owners else np.zeros(0, np.int64)
        pair = np.unique(np.stack([window, item], 1), axis=0) if len(window) else np.zeros((0, 2), np.int64)
        named = np.asarray(pc.is_valid(ids))[pair[:, 1]] if len(pair) else np.zeros(0, bool)
        pair = pair[named]
        self.items = ids
        self.item = pair[:, 1]
        self.first = np.searchsorted(pair[:, 0], np.arange(at + 1))
        self.shortest = min((n for n, _ in self.windows), default=0)
        self.singles = np.unique(np.concatenate([r[:, 0] for n, r in self.windows if n == 1] or [np.zeros(0, np.int64)]))
        self.shortest_pair = min((n for n, _ in self.windows if n > 1), default=0)
        neighbours = [np.stack([r[:, k], r[:, k + 1]], 1) for n, r in self.windows for k in range(n - 1)]
        self.pairs = np.unique(np.concatenate(neighbours) @ np.array([len(self.words), 1])) if neighbours else np.zeros(0, np.int64)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are hit, and distinct (row, item) pairs."""
        n, row = len(words), words.rows
        none = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not n or not self.count:
            return none
        code = pc.index_in(words.array(), value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        chained = np.zeros(n, bool)  # with the word before
        if len(self.pairs):
            k = np.flatnonzero((code[1:] >= 0) & (code[:-1] >= 0) & (row[1:] == row[:-1])) + 1
            key = code[k - 1] * len(self.words) + code[k]
            found = np.searchsorted(self.pairs, key)
            chained[k] = self.pairs[np.minimum(found, len(self.pairs) - 1)] == key
        head = np.flatnonzero(~chained)
        length = np.diff(np.append(head, n))
        use = np.repeat((length >= self.shortest_pair) & (length > 1) if self.shortest_pair else np.zeros(len(head), bool), length)
        if len(self.singles):
            use |= np.isin(code, self.singles)
        at = np.flatnonzero(use)
        if not len(at):
            return none
        # one symbol for each word in the shard, 1 between runs
        new = np.ones(len(at), bool)
        new[1:] = ~((at[1:] == at[:-1] + 1) & chained[at[1:]])
        symbols, seq = np.unique(code[at], return_inverse=True)
        place = np.arange(len(at)) + np.cumsum(new)
        text = np.ones(place[-1] + 1, np.int64)
        text[place] = seq + 2
        origin = np.zeros(len(text), np.int64)
        origin[place] = at
        index = FMIndex(text, len(symbols) + 2)
        to_symbol = np.zeros(len(self.words), np.int64)
        to_symbol[symbols] = np.arange(len(symbols)) + 2
        hit, pairs, done = np.zeros(n, bool), [], 0
        for width, windows in self.windows:
            rows = to_symbol[windows]
            possible = np.flatnonzero(rows.min(axis=1) > 0)
            lo, hi = index.search(rows[possible])
            each = hi - lo
            window = np.repeat(possible + done, each)
            found = index.locate(np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(each.sum()))
            done += len(windows)
            start = origin[found]
            if len(start):
                hit |= covered(np.unique(start), width, n)
                pairs.append(np.stack([row[start], window], 1))
        if not pairs:
            return none
        pairs = np.unique(np.concatenate(pairs), axis=0)
        each = np.diff(self.first)[pairs[:, 1]]
        item = self.item[np.repeat(self.first[pairs[:, 1]] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        both = np.unique(np.stack([np.repeat(pairs[:, 0], each), item], 1), axis=0)
        return hit, both[:, 0], both[:, 1]


def blocks(benchmark: DataFrame, item: str, text: str, limit: int = BLOCK_LIMIT) -> Iterator[pa.Table]:
    """The benchmark in parts of about ``limit`` bytes each."""
    total = benchmark.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 16)).first()[0] or 0
    n = -(-total // limit)
    for k in range(n):
        chosen = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
        yield (chosen.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else chosen).toArrow()


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", width: int = WIDTH, limit: int = BLOCK_LIMIT, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, n_words, n_hit, items (sorted strings) and spans (merged code point ranges to remove)."""
    spark = docs.sparkSession
    keep = list(dict.fromkeys([doc_id, *carry]))
    df = docs.select(*keep, F.col(text).alias("__text"))
    parts = blocks(benchmark, item, text if text in benchmark.columns else "text", limit)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    fields = f"{kinds}, __text string, n_words bigint, __hit array<bigint>, items array<string>"
    first = True
    for part in parts:
        phrases = Phrases(part.column("item").combine_chunks(), part.column("text").combine_chunks(), width)
        df = df.mapInArrow(_step(spark.sparkContext.broadcast(phrases), keep, first), fields)
        first = False
    if first:
        df = df.mapInArrow(_step(spark.sparkContext.broadcast(Phrases(pa.array([], pa.string()), pa.array([], pa.string()), width)), keep, True), fields)
    return df.mapInArrow(_finish(keep), f"{kinds}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>")


def _step(shared, keep: list[str], first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in batches:
            for part in pieces(batch, "__text", SHARD_BYTES):
                words = Words(part.column("__text"), ALNUM, lower=True)
                hit, row, item = phrases.hits(words)
                at = np.flatnonzero(hit)
                local = at - words.first[words.rows[at]] if len(at) else at
                hits = _lists(words.rows[at] if len(at) else at, pa.array(local, pa.int64()), part.num_rows)
                items = _lists(row, phrases.items.take(pa.array(item)), part.num_rows)
                if not first:
                    hits = _joined(part.column("__hit"), hits)
                    items = _joined(part.column("items"), items)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [*keep, "__text"]), pa.array(words.counts), hits, items], names=[*keep, "__text", "n_words", "__hit", "items"])

    return run


def _lists(row: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def _joined(a: pa.Array, b: pa.Array) -> pa.Array:
    if not len(b.values):
        return a
    return pa.array([sorted({*x, *y}) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], a.type)


def _finish(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text", SHARD_BYTES):
                n, hits = part.num_rows, part.column("__hit")
                each = np.diff(np.asarray(hits.offsets))
                row = np.repeat(np.arange(n), each)
                local = np.asarray(hits.flatten())
                spans = [[] for _ in range(n)]
                items = part.column("items")
                if len(local):
                    some = np.flatnonzero(each)
                    words = Words(part.column("__text").take(pa.array(some)), ALNUM, lower=True)
                    at = words.first[np.searchsorted(some, row)] + local
                    new = np.ones(len(at), bool)
                    new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
                    lead = np.zeros(len(words.data) + 1, np.int64)
                    np.cumsum((words.data & 0xC0) != 0x80, out=lead[1:])
                    begin = np.flatnonzero(new)
                    last = np.append(begin[1:], len(at)) - 1
                    base = lead[words.offsets[:-1]][np.searchsorted(some, row[begin])]
                    for r, s, e in zip(row[begin].tolist(), (lead[words.starts[at[begin]]] - base).tolist(), (lead[words.ends[at[last]]] - base).tolist(), strict=True):
                        spans[r].append({"start": s, "end": e})
                    items = pa.array([sorted(x) if x else [] for x in items.to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), part.column("n_words"), pa.array(each, pa.int64()), items, pa.array(spans, SPANS)], names=[*keep, "n_words", "n_hit", "items", "spans"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", width: int = WIDTH, limit: int = BLOCK_LIMIT) -> DataFrame:
    """The rows without any hit, all columns unchanged."""
    for part in blocks(benchmark, item, "text", limit):
        phrases = Phrases(part.column("item").combine_chunks(), part.column("text").combine_chunks(), width)
        docs = docs.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(phrases), text), docs.schema)
    return docs


def _filter(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, SHARD_BYTES):
                words = Words(part.column(text), ALNUM, lower=True)
                hit, _, _ = shared.value.hits(words)
                clean = np.ones(part.num_rows, bool)
                clean[words.rows[hit]] = False
                yield part.filter(pa.array(clean))

    return run
