"""Tokens of transcript text and their times: every step is local to a row, so nothing is exchanged."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from reelspan.functions.text import each, normalized, once, running
from reelspan.operators.segments import readable

#: Fixed values of timing: how far a word may start before its predecessor, and the least length of a segment.
STEP_BACK, LEAST_SECONDS = 0.05, 0.01
WORD_CHARACTER = r"[\p{L}\p{N}_]"
#: A token of normalised text: a word with a word character, and the words without one that follow it.
TOKEN = r"[^ ]*[\p{L}\p{N}_][^ ]*(?: [^ \p{L}\p{N}_]+(?![^ ]))*"


def token_spans(text: Column) -> Column:
    """The tokens (text, char_start, char_end) of normalised text as an array.

    A word without a word character is joined to the token before it (whose end
    moves, while its text has no space), or dropped where there is none.
    """

    def placed(written: Column) -> Column:
        # tokens are one space apart, so starts are running lengths, counted from what is dropped in front
        total = F.aggregate(written, F.lit(0), lambda n, t: n + F.length(t) + 1)
        starts = running(F.transform(written, lambda t: F.length(t) + 1), F.length(text) + 1 - total)
        token = lambda t, at: F.struct(F.replace(t, F.lit(" "), F.lit("")).alias("text"), at.alias("char_start"), (at + F.length(t)).alias("char_end"))
        return F.zip_with(written, F.slice(starts, F.lit(1), F.size(written)), token)

    return once(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), placed)


def folded(text: str) -> str:
    """Letters, digits and apostrophes of the compatibility form, without case."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum() or c in "'’")


@pandas_udf(ArrayType(StringType()))
def _keys(lists: pd.Series) -> pd.Series:
    return lists.map(lambda words: None if words is None else [folded(w or "") for w in words])


def token_keys(words: Column) -> Column:
    """The key of each word of an array. ASCII needs no Python: only rows with other characters are sent there."""
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(F.coalesce(w, F.lit(""))), "[^a-z0-9']", ""))
    other = F.exists(words, lambda w: F.coalesce(w, F.lit("")).rlike(r"[^\x00-\x7F]"))
    return F.when(other, _keys(F.when(other, words))).otherwise(plain)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def valid_words(rows: DataFrame) -> DataFrame:
    """``words`` with a key and finite times in order, clipped to the segment; none at all if one starts clearly before its predecessor."""
    given = F.coalesce("words", F.expr("cast(array() AS array<struct<start: double, end: double, word: string, probability: double>>)"))
    keyed = rows.withColumn("words", given).withColumn("keys", token_keys(F.transform("words", lambda w: w["word"])))
    both = F.zip_with("words", "keys", lambda w, k: F.struct(w["start"].alias("s"), w["end"].alias("e"), k.alias("key"), w["probability"].alias("p")))
    timed = F.filter(both, lambda w: _finite(w["s"]) & _finite(w["e"]) & (w["e"] >= w["s"]) & (w["key"] != ""))
    inside = lambda x, low: F.least(F.col("end"), F.greatest(low, x))
    clipped = F.transform(timed, lambda w: F.struct(inside(w["s"], F.col("start")).alias("s"), inside(w["e"], inside(w["s"], F.col("start"))).alias("e"), w["key"].alias("key"), w["p"].alias("p")))

    def in_order(ws: Column) -> Column:
        late = lambda i: F.get(ws, i)["s"] + STEP_BACK < F.get(ws, i - 1)["s"]
        return F.when((F.size(ws) > 1) & F.exists(F.sequence(F.lit(1), F.size(ws) - 1), late), F.slice(ws, 1, 0)).otherwise(ws)

    # bound: as columns of their own, the words would be put into the steps, and made again for each
    return keyed.withColumn("valid", once(clipped, in_order)).drop("words", "keys")


def _tiers(segments: DataFrame) -> DataFrame:
    """Readable segments with their tokens, valid words, the words of each token (``own``) and the kind of timing."""
    spoken = readable(segments, "words").where(F.col("text").rlike(WORD_CHARACTER))
    rows = valid_words(spoken).withColumn("tokens", token_spans(F.col("text"))).withColumn("keys", token_keys(F.transform("tokens", lambda t: t["text"])))
    known = F.transform("valid", lambda w: w["key"])
    kind = F.when(F.size("valid") == 0, "interpolated").when(F.col("keys") == known, "words").when(F.array_join("keys", "") == F.array_join(known, ""), "reconciled").otherwise("interpolated")
    # where each token's key begins in the whole key, and the word that each character of it belongs to
    begins = running(F.transform("keys", lambda k: F.length(k)))
    owner = F.flatten(F.transform("valid", lambda w, j: F.array_repeat(j, F.length(w["key"]))))
    # a token without any key has no words of its own, and then none of the segment's do
    rows = rows.withColumn("kind", F.when((kind == "reconciled") & F.array_contains("keys", ""), "interpolated").otherwise(kind))
    near = F.col("kind") == "reconciled"
    rows = rows.withColumn("at", F.when(near, begins)).withColumn("owner", F.when(near, owner))
    inside = lambda i: F.slice("valid", F.get("owner", F.get("at", i)) + 1, F.get("owner", F.get("at", i + 1) - 1) - F.get("owner", F.get("at", i)) + 1)
    rows = rows.withColumn("own", F.when(near, F.transform("tokens", lambda t, i: inside(i))))
    return rows


def token_arrays(segments: DataFrame) -> DataFrame:
    """(media_id, pos, start, end, tokens) of readable segments; a token has its text, place, times, timing source and probability.

    segments: (media_id, pos, start, end, text) and, where recognised words are
    known, ``words`` (start, end, word, probability). Tokens take the times of
    words with the same keys one by one; else, where the keys say the same as a
    whole, of the words whose stretch of key they overlap; else they divide the
    segment (of LEAST_SECONDS at least) evenly.
    """
    if "words" not in segments.columns:
        rows = readable(segments).where(F.col("text").rlike(WORD_CHARACTER)).withColumn("tokens", token_spans(F.col("text")))
        none = F.lit(None).cast("array<struct<s: double, e: double, key: string, p: double>>")
        rows = rows.withColumns({"kind": F.lit("interpolated"), "valid": none, "own": F.array(none)})
    else:
        rows = _tiers(segments)
    n, length = F.size("tokens"), F.greatest(F.lit(LEAST_SECONDS), F.col("end") - F.col("start"))
    even = lambda i: F.col("start") + length * i / n
    own = lambda i: F.get("own", i)
    known_p = lambda ws: F.transform(F.filter(ws, lambda w: w["p"].isNotNull()), lambda w: w["p"])
    mean = lambda ps: F.when(F.size(ps) > 0, F.aggregate(ps, F.lit(0.0), lambda a, p: a + p) / F.size(ps))

    def time(t: Column, i: Column) -> Column:
        exact, near = F.col("kind") == "words", F.col("kind") == "reconciled"
        return F.struct(
            i.cast("bigint").alias("token_index"), t["text"].alias("text"), t["char_start"].cast("bigint").alias("char_start"), t["char_end"].cast("bigint").alias("char_end"),
            F.when(exact, F.get("valid", i)["s"]).when(near, own(i)[0]["s"]).otherwise(even(i)).alias("start"),
            F.when(exact, F.get("valid", i)["e"]).when(near, F.element_at(own(i), -1)["e"]).otherwise(even(i + 1)).alias("end"),
            F.when(exact, "whisper_word").when(near, "whisper_reconciled").otherwise("segment_interpolation").alias("timing_source"),
            F.when(exact, F.get("valid", i)["p"]).when(near, mean(known_p(own(i)))).alias("probability"),
        )

    return rows.select("media_id", "pos", "start", "end", F.transform("tokens", time).alias("tokens"))


def source_id(pos: Column, token_index: Column) -> Column:
    return F.format_string("s%06d:t%04d", pos.cast("bigint"), token_index.cast("bigint"))


def timed_tokens(segments: DataFrame) -> DataFrame:
    """A row for each token of ``token_arrays``, with its source_id."""
    named = each(token_arrays(segments), ["media_id", "pos"], "tokens", ("t",)).select("media_id", "pos", "t.*")
    return named.withColumn("source_id", source_id(F.col("pos"), F.col("token_index")))


def timing_counts(tokens: DataFrame) -> DataFrame:
    """(media_id, timing_source, n)."""
    return tokens.groupBy("media_id", "timing_source").agg(F.count("*").alias("n"))


def lossless_text(segments: DataFrame) -> DataFrame:
    """(media_id, text): all readable text of a recording as one normalised line."""
    rows = readable(segments).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "pos", "text"))).alias("s"))
    return rows.select("media_id", normalized(F.array_join(F.transform("s", lambda x: x["text"]), " ")).alias("text"))
