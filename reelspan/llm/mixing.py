"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions alone.

A source's rows, shuffled by the digest of their key, form blocks of ``block``
rows. Weights become whole quotas q over a period of Q = sum(q) slots; a share
of less than one slot counts as one, so ``resolution`` has to fit the least weight. Block k
of a source is released at slot floor(k * Q / q) and due by ceil((k + 1) * Q /
q); in each slot, the released block with the earliest deadline goes next (equal
deadlines: the first source by name). As the quotas use the period fully, no
slot stays empty and no deadline is missed, so until a source runs out, its
share of any prefix is less than one block from its target. One period decides
all: its schedule has Q rows, however many rows there are, and repeats.
Every row keeps its slot when other sources have run out: nothing is dropped
or repeated, and slots of exhausted sources are simply missing.

Ranks inside a source come from 4096 bins of the digest (counts, running
offsets, row numbers inside a bin), so a source with a third of all rows is
spread over tasks. A null source counts as '', a null key as ''. Equal keys are
ordered among themselves in any way. The number of sources is a dimension of
the schedule (one array on one task); it is meant for up to some thousands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, RESOLUTION, BIN_DIGITS = 8, 1000, 3
OWN = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")


def quotas(counts: DataFrame, weights: DataFrame | None = None, resolution: int = RESOLUTION) -> DataFrame:
    """(source, q): whole shares of about ``resolution`` slots, 1 at least; 0 for a source without weight.

    counts: (source, n). weights: (source, weight); by default the square root of n.
    """
    if weights is None:
        weighed = counts.select("source", F.floor(F.sqrt(F.col("n").cast("double")) * 1000).alias("w"))
    else:
        given = weights.select(F.coalesce("source", F.lit("")).alias("source"), F.ceil(F.col("weight") * 1_000_000).alias("w"))
        weighed = counts.select("source").join(given, "source", "left").fillna(0, ["w"])
    total = weighed.agg(F.sum("w").alias("total"))
    return weighed.crossJoin(F.broadcast(total)).select("source", F.when(F.col("w") > 0, F.greatest(F.lit(1).cast("bigint"), F.expr(f"({resolution} * w) div total"))).otherwise(0).alias("q"))


def schedule(quota: DataFrame) -> DataFrame:
    """(source, q, period, j, at): the slot of each source's j-th block inside a period, by earliest deadline first."""
    one = quota.where("q > 0").agg(F.sort_array(F.collect_list(F.struct("source", "q"))).alias("s")).select("s", F.expr("aggregate(s, 0L, (a, x) -> a + x.q)").alias("period"))
    fold = F.expr(
        """
        aggregate(
          sequence(0L, period - 1),
          named_struct('c', transform(s, x -> 0L), 'out', cast(array() AS array<struct<i: int, j: bigint, at: bigint>>)),
          (acc, t) -> transform(
            array(array_min(transform(s, (x, i) -> if(acc.c[i] < x.q AND (acc.c[i] * period) div x.q <= t,
              named_struct('d', ((acc.c[i] + 1) * period + x.q - 1) div x.q, 'i', i), named_struct('d', 9223372036854775807L, 'i', i))))),
            b -> named_struct('c', transform(acc.c, (k, i) -> if(i = b.i, k + 1, k)), 'out', array_append(acc.out, named_struct('i', b.i, 'j', acc.c[b.i], 'at', t)))
          )[0],
          acc -> acc.out
        )"""
    )
    return one.where("size(s) > 0").select("s", "period", F.explode(fold).alias("e")).select(F.expr("s[e.i].source").alias("source"), F.expr("s[e.i].q").alias("q"), "period", F.col("e.j").alias("j"), F.col("e.at").alias("at"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, key: str = "doc_id", source: str = "source", block: int = BLOCK, resolution: int = RESOLUTION) -> DataFrame:
    """All rows and columns, with ``mix_block``, ``mix_release``, ``mix_deadline``, ``mix_slot`` and ``mix_place`` (in its block) in place of columns so named.

    The mixture's order is (mix_slot, mix_place). Rows of a source without weight are no part of it: their release, deadline and slot are null.
    """
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    # the row's own columns travel as one, so that none can clash with those used here
    keyed = docs.select(F.struct("*").alias("__row"), F.col(key).alias("__key"), name.alias("__source"), digest.alias("__digest"), F.substring(digest, 1, BIN_DIGITS).alias("__bin"))
    bins = docs.select(name.alias("__source"), F.substring(digest, 1, BIN_DIGITS).alias("__bin")).groupBy("__source", "__bin").agg(F.count("*").alias("n"))
    before = bins.select("__source", "__bin", (F.sum("n").over(Window.partitionBy("__source").orderBy("__bin")) - F.col("n")).alias("__before"))
    quota = quotas(bins.groupBy(F.col("__source").alias("source")).agg(F.sum("n").alias("n")), weights, resolution)
    # quota + resolution rows at most
    plan = F.broadcast(schedule(quota).withColumnsRenamed({"source": "__source", "q": "__q", "period": "__period", "j": "__j", "at": "__at"}))
    size = F.broadcast(quota.select(F.col("source").alias("__source"), F.col("q").alias("__quota")))
    rank = F.row_number().over(Window.partitionBy("__source", "__bin").orderBy("__digest", "__key"))
    ranked = keyed.withColumn("__rank", rank.cast("long") - 1).join(before, ["__source", "__bin"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    placed = ranked.join(size, "__source", "left").withColumn("mix_block", F.expr(f"__rank div {block}")).withColumn("__j", F.expr("if(__quota > 0, mix_block % __quota, null)")).join(plan, ["__source", "__j"], "left")
    base = "(mix_block div __q) * __period"
    return placed.select(
        *(F.col("__row")[c].alias(c) for c in docs.columns if c not in OWN), "mix_block", F.expr(f"{base} + (__j * __period) div __q").alias("mix_release"),
        F.expr(f"{base} + ((__j + 1) * __period + __q - 1) div __q").alias("mix_deadline"), F.expr(f"{base} + __at").alias("mix_slot"), F.expr(f"__rank % {block}").alias("mix_place"),
    )
