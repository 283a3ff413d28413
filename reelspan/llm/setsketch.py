r"""MinHash near-dedup with SetSketch registers: banded, jointly estimated, verified on full sets.

A document's set is its distinct shingles of ``width`` words `[^\x20\x09-\x0D]+`
with A-Z lower-cased (the whole sequence, if it has fewer; nothing without
words). Register i keeps max over the set of floor(1 - log_base(h_i)), with h_i
exponential with rate ``rate``, truncated to 0 .. limit. This is a monotone
function of the least uniform hash, so the minima are taken first; sketches of
parts merge by the maximum of each register. Bands of ``rows`` registers are
bucket keys: at similarity 0.85 a pair shares none of 21 bands of 3 with
probability 2e-9.

Texts with equal sets are one class, known by a 128-bit digest of the set, so
groups of copies cost one row. Buckets are first searched by stars: each member
is paired with the bucket's least id, so a bucket makes as many pairs as rows.
Pairs whose joint maximum-likelihood similarity is far below the threshold go;
for the others the full sets are compared exactly. Verified links give
components. Buckets of three or more that still hold different components are
then compared inside, set against set, in one place: they return only links
that join components, so a group of near copies returns fewer links than rows,
and no link between components is lost to the choice of pivots.

Null and empty texts have an empty set and are linked with nothing. A row with
a null id is linked with nothing and kept. Texts that share an id may share a node
of the graph; each row gets the component of its own text. The id is an integer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import NOT_SPACE, U64, Roller, Words, mix, pieces, stored
from reelspan.llm.graph import components


@dataclass(frozen=True)
class SketchRules:
    width: int = 5
    percent: int = 80
    base: float = 1.001
    rate: float = 20.0
    limit: int = 65535
    bands: int = 21
    rows: int = 3
    #: Pairs with an estimate this much below the threshold are not verified: over five standard errors of 63 registers.
    margin: float = 0.25

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each row, sorted, one row after the other; and where each row begins."""
    words = Words(column, NOT_SPACE, lower=True)
    roll, count = Roller(words.codes()), words.counts
    each = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    total = int(each.sum())
    begin = np.cumsum(each) - each
    start = np.repeat(words.first[:-1] - begin, each) + np.arange(total)
    span = np.repeat(np.minimum(count, width), each)
    keys = mix(roll.at(start, span) + span.astype(U64))
    parts = [np.unique(keys[a : a + n]) for a, n in zip(begin.tolist(), each.tolist(), strict=True)]
    first = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=first[1:])
    return (np.concatenate(parts) if parts else keys), first


def registers(keys: np.ndarray, first: np.ndarray, rules: SketchRules) -> np.ndarray:
    """The sketch of each row's set, uint16; zeros for an empty set."""
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, rules.registers), np.uint16)
    if not len(some):
        return out
    seeds = mix(np.arange(1, 2 * rules.registers + 1, dtype=U64) * U64(0x632BE59BD9B4E019))
    at = first[some]
    least = np.empty((len(some), rules.registers), U64)
    for i in range(rules.registers):
        least[:, i] = np.minimum.reduceat((keys ^ seeds[2 * i]) * (seeds[2 * i + 1] | U64(1)), at)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) * 2.0**-64) / rules.rate
    out[some] = np.clip(np.floor(1.0 - np.log(np.maximum(h, 1e-300)) / np.log(rules.base)), 0, rules.limit).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def joint_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float = 1.001, steps: int = 200) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows) with known set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1.0 - u
    most = np.minimum(u / v, v / u)
    j = most * np.linspace(0.0, 1.0, steps)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)
    up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    level = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1.0 - up - down, 1e-12))
    return j[np.arange(len(j)), level.argmax(1)]


def sketch(docs: DataFrame, doc_id: str, text: str, rules: SketchRules) -> DataFrame:
    """(id, n, k1, k2, regs, bands) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                keys, first = shingles(part.column("text"), rules.width)
                regs, n = registers(keys, first, rules), np.diff(first)
                total = lambda x: np.concatenate([[U64(0)], np.cumsum(x)])[first[1:]] - np.concatenate([[U64(0)], np.cumsum(x)])[first[:-1]]
                k1, k2 = total(mix(keys + U64(11))), total(mix(keys + U64(12345)))
                bands = np.zeros((len(n), rules.bands), U64)
                for k in range(rules.bands):
                    for r in range(rules.rows):
                        bands[:, k] = mix(bands[:, k] + regs[:, k * rules.rows + r].astype(U64) + U64(k * 1_000_003 + r + 1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * rules.bands, pa.int32()), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array([r.tobytes() for r in regs], pa.binary()), lists], names=["id", "n", "k1", "k2", "regs", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id bigint, n bigint, k1 bigint, k2 bigint, regs binary, bands array<bigint>")


def _estimates(pairs: DataFrame, rules: SketchRules) -> DataFrame:
    """(a, b, est) of (a, b, n_a, n_b, regs_a, regs_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, rules.registers) for c in ("regs_a", "regs_b"))
                n_a, n_b = (np.asarray(part.column(c), np.float64) for c in ("n_a", "n_b"))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(joint_similarity(a, b, n_a, n_b, rules.base))], names=["a", "b", "est"])

    return pairs.mapInArrow(run, "a bigint, b bigint, est double")


def _sets(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, rules: SketchRules) -> DataFrame:
    """(node, keys): the full set of each wanted document, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                keys, first = shingles(part.column("text"), rules.width)
                sets = [keys[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["node", "keys"])

    wanted = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(nodes.withColumnRenamed("node", "id"), "id", "left_semi")
    return wanted.mapInArrow(run, "node bigint, keys binary")


def _verified(pairs: DataFrame, sets: DataFrame, rules: SketchRules) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("keys_a"), batch.column("keys_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if 100 * min(len(p), len(q)) < rules.percent * max(len(p), len(q)):
                    good.append(False)
                    continue
                both = np.sort(np.concatenate([p, q]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(common > 0 and 100 * common >= rules.percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    a = sets.select(F.col("node").alias("a"), F.col("keys").alias("keys_a"))
    b = sets.select(F.col("node").alias("b"), F.col("keys").alias("keys_b"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "keys_a", "keys_b").mapInArrow(run, "a bigint, b bigint")


def _within(buckets: DataFrame, rules: SketchRules) -> DataFrame:
    """Links (a, b) between different components of a bucket, from rows (key, rep, comp, keys): enough to connect all that are linked.

    All sets of a bucket are compared here, by counts of common shingles in
    blocks; only links that join two components are returned. Members that
    have too many shingles to themselves to be linked with any other go first.
    """

    def solve(rep: list, comp: list, sets: list) -> list[tuple]:
        n = np.array([len(x) for x in sets])
        token, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), n)
        often = np.bincount(code) > 1
        both = np.bincount(owner[often[code]], minlength=len(sets))
        live = np.flatnonzero(100 * both >= rules.percent * n)
        if len(live) < 2 or len({comp[i] for i in live}) < 2:
            return []
        spot = np.full(len(sets), -1)
        spot[live] = np.arange(len(live))
        use = often[code] & (spot[owner] >= 0)
        column = np.cumsum(often)[code[use]] - 1
        row = spot[owner[use]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = column[-1] + 1
        size, parent = n[live], {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        out, label = [], [comp[i] for i in live]
        for low in range(0, len(live), 512):  # a stripe of rows against all from there on
            high = min(low + 512, len(live))
            common = np.zeros((high - low, len(live) - low), np.float32)
            for c in range(0, width, 2048):
                part = slice(*np.searchsorted(column, [c, c + 2048]))
                dense = np.zeros((len(live) - low, min(2048, width - c)), np.float32)
                inside = row[part] >= low
                dense[row[part][inside] - low, column[part][inside] - c] = 1
                common += dense[: high - low] @ dense.T
            linked = 100 * common >= rules.percent * (size[low:high, None] + size[None, low:] - common)
            for x, y in zip(*(k + low for k in np.nonzero(np.triu(linked, 1))), strict=True):
                p, q = root(label[x]), root(label[y])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append(tuple(sorted((rep[live[x]], rep[live[y]]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, ([], [], [])
        found: list[tuple] = []
        for batch in batches:
            for key, rep, comp, keys in zip(*(batch.column(c).to_pylist() for c in ("key", "rep", "comp", "keys")), strict=True):
                if key != current:
                    if len(set(held[1])) > 1:
                        found += solve(*held)
                    current, held = key, ([], [], [])
                for x, y in zip(held, (rep, comp, np.frombuffer(keys, U64)), strict=True):
                    x.append(y)
        if len(set(held[1])) > 1:
            found += solve(*held)
        a, b = zip(*sorted(set(found)), strict=True) if found else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return buckets.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: SketchRules = SketchRules()) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable) and kept, a row for each row of docs."""
    rows = stored(sketch(docs, doc_id, text, rules), "sketches")
    named = rows.where("id IS NOT NULL AND n > 0")
    classes = stored(named.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.min(F.struct("id", "regs", "bands")).alias("x")).select("k1", "k2", "n", "rep", "x.regs", "x.bands"), "classes")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    members = stored(banded.join(shared, "key", "left_semi"), "buckets")
    nodes = members.select(F.col("rep").alias("node")).distinct()
    known = stored(classes.select("rep", "n", "regs").join(nodes, F.col("rep") == F.col("node"), "left_semi"), "known")
    sets = stored(_sets(docs, nodes, doc_id, text, rules), "sets")
    pivot = members.groupBy("key").agg(F.min("rep").alias("a"))
    pairs = members.select("key", F.col("rep").alias("b")).join(pivot, "key").where("a <> b").select("a", "b").distinct()
    a = known.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a"))
    b = known.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b"))
    sized = pairs.join(a, "a").join(b, "b").where(F.expr(f"100 * least(n_a, n_b) >= {rules.percent} * greatest(n_a, n_b)"))
    likely = _estimates(sized.select("a", "b", "n_a", "n_b", "regs_a", "regs_b"), rules).where(F.col("est") >= rules.percent / 100 - rules.margin)
    links = stored(_verified(likely, sets, rules), "links")
    comps = components(links, "components-a")
    # a bucket of two is decided; larger ones may hold links besides those of their pivot
    placed = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.count("*").alias("m")).where("c < d AND m > 2").select("key")
    inner = placed.join(mixed, "key", "left_semi").join(sets.withColumnRenamed("node", "rep"), "rep")
    more = stored(_within(inner.select("key", "rep", "comp", "keys"), rules), "more-links")
    if not more.isEmpty():
        comps = components(links.unionByName(more), "components-b")
    rep_comp = comps.withColumnsRenamed({"node": "rep", "comp": "component"})
    label = classes.select("k1", "k2", "n", "rep").join(rep_comp, "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "n", "k1", "k2").join(label, ["k1", "k2", "n"], "left")
    component = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
