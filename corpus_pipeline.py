"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before
has kept, and returns them with the columns of ``documents``; the last adds its
schedule. Each stage is written as Parquet and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import stored, table
from reelspan.llm.decontam import drop_contaminated
from reelspan.llm.linededup import dedup_lines
from reelspan.llm.mixing import mix_sources
from reelspan.llm.quality import QualityRules, keep_good
from reelspan.llm.setsketch import near_duplicates


#: At 25 % of symbols, the limit that op1's SQL states, rows of fragments between pipes pass.
RULES = QualityRules(max_symbol_percent=10)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs, RULES)


LINE_WORDS = 50


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of three lines or of 50 words go; so does a document of which nothing but white space is left."""
    done = dedup_lines(docs, words=LINE_WORDS)
    cut = F.size("line_gone") > 0
    left = done.where(~cut | F.col("line_kept").rlike("[^\\x20\\x09-\\x0D]"))
    return left.withColumn("n_chars", F.when(cut, F.length("line_kept").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col("line_kept")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id, and one row of those that are equal in id and text.

    Texts without words are no duplicates of others; rows without an id are one only of those with an equal text.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    left = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")
    return left.withColumns({"__h1": F.xxhash64("text"), "__h2": F.xxhash64(F.lit(7), "text")}).dropDuplicates(["doc_id", "__h1", "__h2"]).drop("__h1", "__h2")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any phrase of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each with its slot in the mixture of sources."""
    return mix_sources(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: The stages' SQL is not chained here; tests/llm/test_pipeline.py holds single stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
