r"""Line dedup by winnowing over line hashes, with DataFrame functions alone.

Lines are the pieces between line feeds; those without a character outside
`[\x20\x09-\x0D]` are blank, take no part in runs and stay. Every ``run``
neighbouring lines of a document form a window, and a window selects its least
line hash as fingerprint, so two equal windows select the same one: no repeated
run of that length can hide. Fingerprints that occur at one place only are
dropped by a join of positions. Around the others, matches extend both ways:
each window that selected the fingerprint is keyed by all its lines, and windows
with equal keys are equal runs. The first in (doc_id, position) order stays;
the lines of every later one go, so longer repeats go as unions of their
windows. Windows are made in one pass over the texts and kept as a table. With ``words``, runs of fewer lines form windows too once they have that
many words, so a repeat goes if it has ``run`` lines or ``words`` words, and a
document of one or two lines takes part. No pairs are made: a group of copies costs its number of rows.

Rows are known by doc_id and a hash of the text. Identical repeated rows are
one document in two places and get the same result; equal texts under different
ids are copies, of which the first keeps its lines. Null texts are one blank
line. Hashes are 64 bits a line and 128 a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import row_key, stored

RUN = 3
WORD = r"[^\\x20\\x09-\\x0D]"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _windows(docs: DataFrame, doc_id: str, text: str, run: int, words: int | None) -> DataFrame:
    """Every window of non-blank lines: its document, start, line numbers, fingerprint and key."""
    count = "0" if words is None else f"size(regexp_extract_all(l, '{WORD}+', 0))"
    x = f"filter(transform(split(coalesce({_quoted(text)}, ''), '\\n', -1), (l, i) -> named_struct('i', i, 'h', xxhash64(l), 'n', {count}, 'word', l rlike '{WORD}')), x -> x.word)"
    of = lambda n: f"if(size(x) >= {n}, transform(sequence(0, size(x) - {n}), s -> named_struct('s', s, 'w', slice(x, s + 1, {n}))), array())"
    short = [] if words is None else [f"filter({of(n)}, e -> aggregate(e.w, 0, (a, y) -> a + y.n) >= {words})" for n in range(1, run)]
    # the lines are bound as a lambda's variable: as a column they would be made again for each window
    every = F.expr(f"transform(array({x}), x -> concat({', '.join([*short, of(run)])}))[0]")
    # an outer explode, as the optimizer tests what a plain one takes, and so makes it twice
    cut = docs.select(F.col(doc_id).alias("d"), row_key(text).alias("r"), F.explode_outer(every).alias("e")).where("e IS NOT NULL")
    hashes = F.expr("transform(e.w, y -> y.h)")
    # lines of a repeated row are one place, not two
    return cut.select("d", "r", F.col("e.s").alias("s"), F.expr("transform(e.w, y -> y.i)").alias("at"), F.array_min(hashes).alias("fp"), F.xxhash64(hashes).alias("k1"), F.xxhash64(F.size("e.w"), F.reverse(hashes)).alias("k2"))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, words: int | None = None) -> DataFrame:
    """(d, r, gone): for documents with later repeats, the line numbers to delete."""
    windows = stored(_windows(docs, doc_id, text, run, words), "windows")  # read three times
    place = F.struct("d", "r", "s")
    often = windows.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("fp")
    near = windows.join(often, "fp", "left_semi")
    first = near.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("k1", "k2", "first")
    later = near.join(first, ["k1", "k2"]).where(F.struct("d", "r", "s") > F.col("first"))
    return later.groupBy("d", "r").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("at")))).alias("gone"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, words: int | None = None) -> DataFrame:
    """All rows and columns, with ``line_gone`` (numbers of deleted lines), ``line_total`` and ``line_kept`` (the text that is left) in place of columns so named."""
    gone = repeated_lines(docs, doc_id, text, run, words).withColumnsRenamed({"d": "__d", "r": "__r", "gone": "__gone"})
    # the row's own columns travel as one, so that none can clash with those used here
    keyed = docs.select(F.struct("*").alias("__row"), F.col(doc_id).alias("__id"), row_key(text).alias("__hash"))
    joined = keyed.join(gone, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__hash") == F.col("__r")), "left")
    own = F.col("__row")[text]
    lines = F.split(F.coalesce(own, F.lit("")), "\n", -1)
    cut = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), lines))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(__lines) - 1), __gone), i -> __lines[i]), '\n')")
    total = F.length(F.regexp_replace(F.coalesce(own, F.lit("")), "[^\n]+", "")) + 1
    carried = [F.col("__row")[c].alias(c) for c in docs.columns if c not in ("line_gone", "line_total", "line_kept")]
    return cut.select(*carried, F.coalesce("__gone", F.expr("cast(array() AS array<int>)")).alias("line_gone"), total.cast("long").alias("line_total"), F.when(F.col("__gone").isNull(), own).otherwise(kept).alias("line_kept"))
