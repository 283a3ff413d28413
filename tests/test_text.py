import hashlib
import re

from pyspark.sql import functions as F

from reelspan.functions import text as T
from reelspan.operators import segments as S
from reelspan.plans.registry import QUERIES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_timestamps(spark):
    assert one(spark, T.timestamp(F.lit(3661.1))) == "01:01:01.100"
    assert one(spark, T.timestamp(F.lit(1.25), True)) == "00:00:01,250"
    assert one(spark, T.ass_time(F.lit(-1.0))) == "0:00:00.00"


def test_targets(spark):
    t = T.summary_targets(F.lit(6457), F.lit(11))
    assert one(spark, F.array(*t.values())) == [1300, 1800, 13, 18]
    t = T.summary_targets(F.lit(9424), F.lit(12))
    assert one(spark, F.array(*t.values())) == [1900, 2600, 16, 22]
    assert [one(spark, T.output_budget(F.lit(w), c)) for w, c in ((1600, 16384), (4000, 16384), (2600, 8192))] == [8192, 10240, 8192]


def blocks(spark, rows):
    df = spark.createDataFrame([(1, i, float(a), float(b), t) for i, (a, b, t) in enumerate(rows)], "media_id long, pos int, start double, end double, text string")
    return df, S.readable_blocks(df).orderBy("block_index").collect()


def test_blocks(spark):
    assert len(blocks(spark, [(0, 2, "a b"), (4.5, 5, "c")])[1]) == 2
    assert [b.section_start for b in blocks(spark, [(299, 299.5, "x"), (300, 301, "y")])[1]] == [0, 300]
    assert len(blocks(spark, [(0, 1, "a" * 240), (1, 2, "b" * 240), (2, 3, "c" * 240)])[1]) == 2
    assert len(blocks(spark, [(0, 1, "a" * 160), (1, 2, "b" * 160 + "."), (2, 3, "c")])[1]) == 2


def test_windows(spark):
    df, _ = blocks(spark, [(60 * i, 60 * i + 60, "w") for i in range(240)])
    w = S.prompt_windows(df).orderBy("id").collect()
    assert len(w) <= 12 and w[0].segment_count == 20
    df, _ = blocks(spark, [(300 * i, 300 * i + 1, "w") for i in range(13)])
    assert S.prompt_windows(df).count() <= 12


def test_srt_numbers_have_gaps(spark):
    df, _ = blocks(spark, [(0, 1, "a"), (1, 2, " "), (2, 3, "b")])
    assert S.render_srt(df).first().srt == "1\n00:00:00,000 --> 00:00:01,000\na\n\n3\n00:00:02,000 --> 00:00:03,000\nb\n"


def test_every_document_is_measured(spark, tmp_path):
    rows = [(1, "en", "plain C++ and it's x."), (2, "en", "caf\u00e9 \u00e9lan \u2013 na\u00efve co-op\u2013x, a\u0301b"), (3, "fr", "d\u00e9j\u00e0 vu 2\u00b2 \u65e5a"), (4, "de", None), (5, None, "")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.tokens, r.sha256, r.english_words) for r in QUERIES["document_measures"](spark, str(tmp_path)).collect()}
    words = lambda t: len(re.findall(r"\b[A-Za-z0-9][A-Za-z0-9_./+#'-]*\b", t))
    assert got == {i: (max(1, int(len(t or "") / 2.8)), hashlib.sha256((t or "").encode()).hexdigest(), words(t or "")) for i, _, t in rows}


def test_balanced_lines_of_any_length(spark):
    """Against every cut; the text of 20,000 words, whose cuts were each joined anew before, ends in time."""
    import random
    import time

    rng = random.Random(3)
    texts = [" ".join("x" * rng.randint(1, 9) for _ in range(n)) for n in [1, 2, 3, 8, 9, 10, 12, 15, 15, 20, 40, 20000]] + ["", "é" * 50, f"{'a' * 21}  {'b' * 21}\t{'c' * 21} "]

    def wanted(text):
        words = text.split()
        if len(text) <= 42 or len(words) < 2:
            return text
        total, left, best = len(" ".join(words)), -1, None
        for i, w in enumerate(words[:-1], 1):
            left += len(w) + 1
            right = total - left - 1
            key = (max(0, left - 42) + max(0, right - 42), abs(left - right), i)
            best = min(best or key, key)
        return " ".join(words[: best[2]]) + "\n" + " ".join(words[best[2] :])

    began = time.time()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", T.balanced_lines(F.col("t"))).collect())
    assert time.time() - began < 60
    assert got == {i: wanted(t) for i, t in enumerate(texts)}
