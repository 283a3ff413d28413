"""Recordings' tables made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def silences_from_events(events: DataFrame) -> DataFrame:
    """(media_id, start, end, duration): a user's events as pauses of a recording, an hour read as a second."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    own = Window.partitionBy("media_id")
    timed = events.select(F.col("user_id").alias("media_id"), us.alias("us"), "value").withColumn("start", (F.col("us") - F.min("us").over(own)) / F.lit(3.6e9))
    return timed.select("media_id", "start", (F.col("start") + F.col("value") / 25.0).alias("end"), (F.max("start").over(own) + 5.0).alias("duration"))


def segments_from_documents(docs: DataFrame, rate: int = 5) -> DataFrame:
    """(media_id, pos, start, end, text): a document's lines as timed segments, all times whole milliseconds.

    A line lasts its characters over ``rate`` seconds; pauses are 0.4 s, after every seventh line 3 s.
    """
    lines = docs.select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    ms = F.expr(f"(cast(length(text) as bigint) * 1000) div {rate}")
    step = ms + F.when(F.col("pos") % 7 == 6, 3000).otherwise(400)
    before = F.coalesce(F.sum(step).over(Window.partitionBy("media_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("ms", before).select("media_id", "pos", (F.col("ms") / 1000.0).alias("start"), ((F.col("ms") + ms) / 1000.0).alias("end"), "text")


def words_of_segments(segments: DataFrame) -> DataFrame:
    """The segments with recognised ``words`` made from their text, in four ways by position.

    0: its words, evenly timed in whole milliseconds; 1: two words in one each;
    2: none; 3: its words in the times of the reverse order.
    """
    text = F.trim(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " "))
    rows = segments.withColumn("ws", F.split(text, " ")).withColumn("n_words", F.size("ws"))
    ws, n = F.col("ws"), F.col("n_words")
    low, length = F.bround(F.col("start") * 1000).cast("bigint"), F.bround((F.col("end") - F.col("start")) * 1000).cast("bigint")
    at = lambda i: (low + F.floor(length * i / n)) / F.lit(1000.0)
    word = lambda s, e, w, i: F.struct(s.alias("start"), e.alias("end"), w.alias("word"), (F.lit(0.5) + (i % 5) / 10).alias("probability"))
    plain = F.transform(ws, lambda w, i: word(at(i), at(i + 1), w, i))
    doubled = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")), lambda k: word(at(2 * k), at(F.least(2 * k + 2, n)), F.concat(F.get(ws, 2 * k), F.coalesce(F.get(ws, 2 * k + 1), F.lit(""))), k))
    turned = F.transform(ws, lambda w, i: word(at(n - 1 - i), at(n - i), w, i))
    way = F.col("pos") % 4
    return rows.withColumn("words", F.when(way == 0, plain).when(way == 1, doubled).when(way == 3, turned)).drop("ws", "n_words")


def responses_of_candidates(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """(media_id, response): proposals of every kind, made from a recording's mined candidates and the first words of its chunks."""
    k = F.substring("candidate_id", 2, 9).cast("int")
    o = F.col("original")
    changed = F.when(k % 6 == 0, F.concat(o, F.lit("s"))).when(k % 6 == 1, F.upper(o)).when(k % 6 == 2, o).when(k % 6 == 3, F.reverse(o)).when(k % 6 == 4, F.concat(F.substring(o, 1, 2), F.lit("x"), F.substring(o, 3, 40))).otherwise(F.concat(o, F.lit(" a b c")))
    named = F.when(k % 11 == 10, "t999").otherwise(F.col("candidate_id"))
    document = candidates.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), named.alias("candidate_id"), changed.alias("replacement")))).alias("d"))
    token = F.get("tokens", F.lit(0))["text"] if "tokens" in chunks.columns else F.substring_index("text", " ", 1)
    first = F.regexp_replace(token, r"^\p{P}+|\p{P}+$", "")
    n = F.substring("chunk_id", 2, 9).cast("int")
    scope = F.when(n % 5 == 4, "c000").otherwise(F.col("chunk_id"))
    local = chunks.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct(n.alias("k"), scope.alias("scope_id"), first.alias("original"), F.when(n % 2 == 1, F.concat(first, F.lit("X2"))).otherwise(F.initcap(first)).alias("replacement")))).alias("l"))
    rows = local.join(document, "media_id", "left")
    pick = lambda xs, *names: F.transform(xs, lambda x: F.struct(*(x[c].alias(c) for c in names)))
    none = F.expr("cast(array() AS array<struct<k: int, candidate_id: string, replacement: string>>)")
    return rows.select("media_id", F.to_json(F.struct(pick(F.coalesce("d", none), "candidate_id", "replacement").alias("document_rules"), pick(F.col("l"), "scope_id", "original", "replacement").alias("local_rules"))).alias("response"))


def summary_responses(docs: DataFrame) -> DataFrame:
    """(media_id, english, translation): responses of both stages made from documents; by doc_id, some break a rule of the contract."""
    k = F.col("doc_id")
    docs = docs.withColumn("text", F.substring(F.regexp_replace("text", r"[^A-Za-z0-9 .,]", " "), 1, 900))
    paragraphs = F.when(k % 7 == 0, 7).when(k % 7 == 1, 25).otherwise(8 + k % 5)
    overview = F.transform(F.sequence(F.lit(1), paragraphs.cast("int")), lambda i: F.concat(F.lit("Part "), i.cast("string"), F.lit(": "), F.substring("text", 1, 900)))
    chinese = F.transform(F.sequence(F.lit(1), F.when(k % 5 == 2, paragraphs + 1).otherwise(paragraphs).cast("int")), lambda i: F.concat(F.when((k % 5 == 3) & (i == 2), F.lit("Teil ")).otherwise(F.lit("段落")), i.cast("string")))
    marker = F.when(k % 11 == 5, "partial").otherwise("complete")
    title = F.when(k % 13 == 6, " ").when(k % 13 == 7, "一二三").otherwise(F.concat(F.lit("Recording "), k.cast("string")))
    json = lambda t, o, names: F.to_json(F.struct(t.alias(names[0]), o.alias(names[1]), marker.alias("completion_marker")))
    english = F.when(k % 17 == 8, "no JSON").when(k % 17 == 9, F.lit('{"title_en": "x"}')).otherwise(json(title, overview, ("title_en", "overview_en")))
    return docs.select(k.alias("media_id"), english.alias("english"), json(F.concat(F.lit("錄影"), k.cast("string")), chinese, ("title_zh_tw", "overview_zh_tw")).alias("translation"), paragraphs.cast("int").alias("paragraph_count"))
