"""Summary responses: contracts of the two stages, their combination, quality, targets met and rendered documents.

A contract is one CASE over a parsed response: the first part that fails names
the ``reason``, and null means that the response holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions.text import english_words

#: Fixed values of the contract: fields of each stage, paragraphs and least words of the English one.
ENGLISH, CHINESE = ("title_en", "overview_en", "completion_marker"), ("title_zh_tw", "overview_zh_tw", "completion_marker")
PARAGRAPHS_MIN, PARAGRAPHS_MAX, WORDS_MIN = 8, 24, 1000
#: Fixed output: headings and labels of the two languages.
LABELS = {"en": ("## Overview", "Source", "Local model"), "zh_tw": ("## 詳細摘要", "來源", "本機模型")}


def has_latin(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def has_chinese(text: Column) -> Column:
    """Whether any character is of the unified ideographs and their first extension."""
    return text.rlike("[㐀-鿿]")


def _visible(text: Column) -> Column:
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def _kind(field: str) -> Column:
    """What JSON holds in a field: its first character tells a string from a list."""
    return F.substring(F.trim(F.get_json_object("response", f"$.{field}")), 1, 1)


def _parsed(responses: DataFrame, title: str, overview: str, fields: tuple[str, ...]) -> DataFrame:
    """keys, the marker, the title and the paragraphs of (…, response); null where they are missing or of another kind."""
    raw = F.from_json("response", f"{title} string, {overview} string, completion_marker string")
    # a value read as a string keeps its quotes only in the raw text, so its kind is read from there
    kind = lambda f: F.regexp_extract("response", rf'"{f}"\s*:\s*(["\[{{tfn0-9-])', 1)
    rows = responses.withColumn("r", raw).withColumn("keys", F.json_object_keys("response"))
    items = F.from_json("r." + overview, "array<string>")
    # a list of other things than text reads as text too; only quotes begin text
    strings = F.regexp_extract_all("r." + overview, F.lit(r'"(?:[^"\\]|\\.)*"'), F.lit(0))
    plain = (kind(overview) == "[") & (F.size(strings) == F.size(items)) & ~F.exists(items, lambda x: x.isNull())
    return rows.select(
        *responses.columns, F.sort_array("keys").alias("keys"), F.when(kind("completion_marker") == '"', F.col("r.completion_marker")).alias("marker"),
        F.when(kind(title) == '"', F.col(f"r.{title}")).alias("title"), F.when(plain | (F.trim(f"r.{overview}") == "[]"), items).alias("overview"),
    )


def _shape(fields: tuple[str, ...]) -> Column:
    """The checks that both stages share."""
    return (
        F.when(F.col("keys").isNull(), "malformed_json").when(F.col("keys") != F.array(*(F.lit(f) for f in sorted(fields))), "wrong_fields")
        .when(F.coalesce(F.col("marker") != "complete", F.lit(True)), "not_complete").when(F.coalesce(~_visible(F.col("title")), F.lit(True)), "blank_title")
        .when(F.col("overview").isNull() | F.exists("overview", lambda x: ~_visible(x)), "blank_overview")
    )


def total_words(paragraphs: Column) -> Column:
    return F.aggregate(F.transform(paragraphs, english_words), F.lit(0).cast("bigint"), lambda a, n: a + n)


def english_contract(responses: DataFrame) -> DataFrame:
    """(…, title_en, overview_en, reason) of (…, response): the first stage's text, and why it doesn't hold."""
    rows = _parsed(responses, *ENGLISH[:2], ENGLISH)
    n = F.size("overview")
    reason = (
        _shape(ENGLISH).when((n < PARAGRAPHS_MIN) | (n > PARAGRAPHS_MAX), "paragraph_count").when(~has_latin(F.col("title")) | F.exists("overview", lambda x: ~has_latin(x)), "not_latin")
        .when(total_words(F.col("overview")) < WORDS_MIN, "too_few_words")
    )
    return rows.select(*(c for c in responses.columns if c != "response"), F.col("title").alias("title_en"), F.col("overview").alias("overview_en"), reason.alias("reason"))


def translation_contract(responses: DataFrame) -> DataFrame:
    """(…, title_zh_tw, overview_zh_tw, reason) of (…, response, paragraph_count): the second stage's text, paragraph by paragraph."""
    rows = _parsed(responses, *CHINESE[:2], CHINESE)
    reason = (
        _shape(CHINESE).when(F.size("overview") != F.col("paragraph_count"), "paragraph_count").when(~has_chinese(F.col("title")) | F.exists("overview", lambda x: ~has_chinese(x)), "not_chinese")
    )
    return rows.select(*(c for c in responses.columns if c not in ("response", "paragraph_count")), F.col("title").alias("title_zh_tw"), F.col("overview").alias("overview_zh_tw"), reason.alias("reason"))


def combined(english: DataFrame, translation: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, title, overview): both languages of the recordings whose two stages hold."""
    a = english.where("reason IS NULL").select(key, "title_en", "overview_en")
    b = translation.where("reason IS NULL").select(key, "title_zh_tw", "overview_zh_tw")
    return a.join(b, key).select(key, F.struct(F.col("title_en").alias("en"), F.col("title_zh_tw").alias("zh_tw")).alias("title"), F.struct(F.col("overview_en").alias("en"), F.col("overview_zh_tw").alias("zh_tw")).alias("overview"))


def paragraph_pairs(summaries: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, place, en, zh_tw): aligned paragraphs."""
    pairs = F.arrays_zip(F.col("overview.en").alias("en"), F.col("overview.zh_tw").alias("zh_tw"))
    return summaries.select(key, F.posexplode(pairs).alias("place", "p")).select(key, "place", "p.*")


def quality(summaries: DataFrame) -> DataFrame:
    """The summaries with overview_count, english_visible_word_count and ``reason``; there is no upper bound here."""
    en, zh = F.col("overview.en"), F.col("overview.zh_tw")
    reason = (
        F.when(en.isNull() | zh.isNull(), "not_bilingual").when((F.size(en) < PARAGRAPHS_MIN) | (F.size(en) != F.size(zh)), "paragraph_count").when(~F.coalesce(has_latin(F.col("title.en")), F.lit(False)), "english_title")
        .when(~F.coalesce(has_chinese(F.col("title.zh_tw")), F.lit(False)), "chinese_title").when(F.exists(en, lambda x: ~has_latin(x)), "english_paragraph").when(F.exists(zh, lambda x: ~has_chinese(x)), "chinese_paragraph")
        .when(total_words(en) < WORDS_MIN, "too_few_words")
    )
    return summaries.withColumns({"overview_count": F.size(en).cast("bigint"), "english_visible_word_count": total_words(en), "reason": reason})


def targets_met(rows: DataFrame) -> DataFrame:
    """summary_length_target_met and summary_paragraph_target_met; both ranges include their ends."""
    return rows.withColumns({
        "summary_length_target_met": F.col("english_visible_word_count").between(F.col("words_min"), F.col("words_max")),
        "summary_paragraph_target_met": F.col("overview_count").between(F.col("groups_min"), F.col("groups_max")),
    })


def summary_markdown(summaries: DataFrame, language: str, source: Column, model: Column, key: str = "media_id") -> DataFrame:
    """(key, markdown): the summary in one language."""
    if language not in LABELS:
        raise ValueError("language must be en or zh_tw")
    heading, source_label, model_label = LABELS[language]
    about = F.concat(F.lit(f"_{source_label}: "), source, F.lit(f" · {model_label}: "), model, F.lit("_"))
    whole = F.concat(F.lit("# "), F.col(f"title.{language}"), F.lit("\n\n"), about, F.lit(f"\n\n{heading}\n\n"), F.array_join(F.col(f"overview.{language}"), "\n\n"))
    return summaries.select(key, F.concat(F.regexp_replace(whole, r"(?U)[\s\x1c-\x1f]+$", ""), F.lit("\n")).alias("markdown"))


def shared_context(needed: Column, output: Column, context: int = 65536) -> Column:
    """One context for both stages: what the stage needs, with room for a second output of the same size."""
    reserve = F.ceil((2 * output + 4096) / 2048) * 2048
    return F.least(F.lit(context), F.greatest(needed, reserve)).cast("bigint")


def optional_sum(*parts: Column) -> Column:
    """The whole sum of the parts that are numbers, null if none is."""
    known = F.filter(F.array(*(p.cast("double") for p in parts)), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x).cast("bigint"))
