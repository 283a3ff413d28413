import math

import pytest

from reelspan.operators import subtitles as U
from reelspan.operators import tokens as K
from reelspan.operators.cues import Words, apart, shown

SEGMENTS = "media_id long, pos int, start double, end double, text string"


def test_tokens(spark):
    rows = [(1, 0, 5.0, 7.0, " two   words "), (1, 1, 8.0, 9.0, "- a — b !"), (2, 0, 0.0, 0.0, None), (2, 1, 1.0, 1.0, "x"), (2, 2, 3.0, 4.0, "— !")]
    got = [(r.media_id, r.pos, r.token_index, r.text, r.char_start, r.char_end, r.start, r.end) for r in K.timed_tokens(spark.createDataFrame(rows, SEGMENTS)).orderBy("media_id", "pos", "token_index").collect()]
    assert got[:2] == [(1, 0, 0, "two", 0, 3, 5.0, 6.0), (1, 0, 1, "words", 4, 9, 6.0, 7.0)]
    assert [r[3:6] for r in got[2:4]] == [("a—", 2, 5), ("b!", 6, 8)]
    assert got[4][3] == "x" and got[4][7] == pytest.approx(1.01) and len(got) == 5


def test_long_texts_have_right_places(spark):
    text = " ".join(f"w{i}" for i in range(700))
    for r in K.timed_tokens(spark.createDataFrame([(1, 0, 0.0, 700.0, text)], SEGMENTS)).collect():
        assert text[r.char_start : r.char_end] == r.text and r.start == pytest.approx(r.token_index)


def test_timing_tiers(spark):
    nan = math.nan
    rows = [
        (1, 0, 2.0, 4.0, "Two words", [(2.1, 2.7, " Two", 0.5), (2.8, 3.8, " words", 0.7)]),
        (1, 1, 0.0, 2.0, "ROS 2 works.", [(0.2, 0.8, "ROS2", 0.4), (0.9, 1.5, "works.", None)]),
        (1, 2, 5.0, 7.0, "two words", None),
        (1, 3, 0.0, 2.0, "b a", [(1.0, 1.5, "b", 0.5), (0.2, 0.6, "a", 0.5)]),  # back in time
        (1, 4, 0.0, 2.0, "Straße x", [(-1.0, 0.5, "STRASSE", 0.5), (nan, 1.0, "no", 0.5), (None, 1.0, "no", 0.5), (0.5, 9.0, "x", 0.5), (1.0, 0.9, "no", 0.5), (1.0, 1.1, "...", 0.5)]),
        (1, 5, 0.0, 2.0, "other words", [(0.0, 1.0, "some", 0.5)]),
    ]
    schema = SEGMENTS + ", words array<struct<start: double, end: double, word: string, probability: double>>"
    got = {}
    for r in K.timed_tokens(spark.createDataFrame(rows, schema)).orderBy("pos", "token_index").collect():
        got.setdefault(r.pos, []).append((r.source_id, r.start, r.end, r.timing_source, r.probability))
    assert got[0] == [("s000000:t0000", 2.1, 2.7, "whisper_word", 0.5), ("s000000:t0001", 2.8, 3.8, "whisper_word", 0.7)]
    assert [g[1:] for g in got[1]] == [(0.2, 0.8, "whisper_reconciled", 0.4), (0.2, 0.8, "whisper_reconciled", 0.4), (0.9, 1.5, "whisper_reconciled", None)]
    assert [g[1:4] for g in got[2]] == [(5.0, 6.0, "segment_interpolation"), (6.0, 7.0, "segment_interpolation")]
    assert {g[3] for g in got[3]} == {g[3] for g in got[5]} == {"segment_interpolation"}
    assert [g[1:4] for g in got[4]] == [(0.0, 0.5, "whisper_word"), (0.5, 2.0, "whisper_word")]
    with pytest.raises(Exception, match="finite"):
        K.timed_tokens(spark.createDataFrame([(1, 0, nan, 1.0, "x")], SEGMENTS)).collect()


def test_chunks(spark):
    rows = [(1, 0, 0.0, 12.0, "a"), (1, 1, 12.0, 28.0, "b ."), (1, 2, 29.0, 55.0, "c"), (2, 0, 0.0, 500.0, "long"), (2, 1, 500.0, 501.0, "d"), (2, 2, 501.0, 502.0, "—")]
    got = [tuple(r)[:6] for r in U.correction_chunks(spark.createDataFrame(rows, SEGMENTS), 30).orderBy("media_id", "chunk_id").collect()]
    assert got == [(1, "c001", 0.0, 28.0, "a b.", 2), (1, "c002", 29.0, 55.0, "c", 1), (2, "c001", 0.0, 500.0, "long", 1), (2, "c002", 500.0, 501.0, "d", 1)]
    tokens = U.chunk_tokens(U.correction_chunks(spark.createDataFrame(rows, SEGMENTS), 30)).where("media_id = 1").orderBy("chunk_id", "token_index").collect()
    assert [(t.text, t.char_start, t.char_end, t.source_id) for t in tokens] == [("a", 0, 1, "s000000:t0000"), ("b.", 2, 4, "s000001:t0000"), ("c", 0, 1, "s000002:t0000")]
    with pytest.raises(ValueError):
        U.correction_chunks(spark.createDataFrame([], SEGMENTS), 10)


def test_chunks_of_just_the_length(spark):
    """In doubles 128.8 - 8.8 is more than 120."""
    rows = [(1, 0, 8.8, 28.8, "a"), (1, 1, 28.8, 128.8, "b"), (2, 0, 8.8, 28.8, "a"), (2, 1, 28.8, 128.801, "b")]
    got = U.correction_chunks(spark.createDataFrame(rows, SEGMENTS)).select("media_id", "n_segments").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 1), (2, 1)]


def cues(words):
    import numpy as np

    start, end, text = zip(*words, strict=True)
    return [list(c[:3]) for c in shown(apart(Words(np.array(start), np.array(end), list(text), [[] for _ in text]).cues()))]


def test_cues_limits():
    got = cues([(i * 0.32, i * 0.32 + 0.3, f"word{i}") for i in range(30)])
    assert " ".join(c[2] for c in got) == " ".join(f"word{i}" for i in range(30))
    assert all(c[1] - c[0] <= 6 + 1e-9 and len(c[2]) <= 78 for c in got)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_cues_breaks():
    assert [c[2] for c in cues([(0, 0.6, "One"), (0.6, 1.2, "two."), (1.2, 1.5, "three"), (2.2, 2.5, "("), (2.5, 2.55, "four"), (2.55, 2.6, ")")])] == ["One two.", "three", "(four)"]
    assert [c[2] for c in cues([(1.0, 1.1, "first"), (0.97, 1.2, "second")])] == ["first second"]
    assert cues([(5.0, 5.1, "x")]) == [[5.0, 6.0, "x"]]
    # cues that begin together join while they fit, and a late overlap is trimmed
    assert [c[2] for c in cues([(0.0, 2.0, "a."), (0.05, 1.0, "b")])] == ["a. b"]
    assert [c[:2] for c in cues([(0.0, 2.0, "a."), (1.0, 3.0, "b.")])] == [[0.0, 0.98], [1.0, 3.0]]
    # too long to join: the later one moves back
    assert [c[:2] for c in cues([(0.0, 2.0, "a" * 50 + "."), (0.05, 3.0, "b" * 50)])] == [[0.0, 2.0], [2.02, 3.02]]  # shown for a second at least
    # a lone quote ends the sentence that it joins
    assert [c[2] for c in cues([(0.0, 1.0, "Stop."), (1.0, 2.0, "now.")])] == ["Stop.", "now."]


def test_cues_are_those_of_one_word_at_a_time():
    """Against the rules applied word by word to joined lines."""
    import random
    import re

    rng = random.Random(3)
    for _ in range(60):
        t, words = 0.0, []
        for _ in range(rng.randrange(1, 60)):
            d = rng.choice([0.1, 0.3, 1.2])
            words.append((t, t + d, rng.choice(["word", "a", "end.", "(", ")", "%", "longerword" * 3, "quote.)", "x,", "!"])))
            t += d + rng.choice([0, 0.1, 0.7])
        line = lambda ws: re.sub(r"([\[(]) +", r"\1", re.sub(r" +([,.;:!?%\])])", r"\1", " ".join(w[2] for w in ws)))
        expected, now = [], []
        for w in words:
            if now and (w[0] - now[-1][1] >= 0.65 or w[1] - now[0][0] > 6 or len(line([*now, w])) > 78 or len(now) == 16):
                expected, now = [*expected, line(now)], []
            now = [*now, w]
            if re.search(r"[.!?][\"')\]]?$", line(now)) and w[1] - now[0][0] >= 1:
                expected, now = [*expected, line(now)], []
        expected += [line(now)] if now else []
        assert [c[2] for c in cues(words)] == expected


def test_documents(spark):
    rows = [(1, 2, 2.0, 3.0, "{b}"), (1, 1, 0.0, 1.0, "a."), (1, 3, float("nan"), 4.0, "n"), (1, 4, 3.1, 3.2, " "), (None, 1, 0.0, 1.0, "q"), (2, 1, 0.0, 0.5, "z")]
    cues = U.build_cues(spark.createDataFrame(rows, "media_id long, sequence int, start double, end double, text string"))
    srt = {r.media_id: r.srt for r in U.subtitle_srt(cues).collect()}
    assert srt == {1: "1\n00:00:00,000 --> 00:00:01,000\na.\n\n2\n00:00:02,000 --> 00:00:03,000\n{b}\n", 2: "1\n00:00:00,000 --> 00:00:01,000\nz\n"}
    ass = {r.media_id: r.ass for r in U.subtitle_ass(cues).collect()}
    assert ass[1].endswith("Dialogue: 0,0:00:00.00,0:00:01.00,Default,,0,0,0,,a.\nDialogue: 0,0:00:02.00,0:00:03.00,Default,,0,0,0,,\\{b\\}\n")
    assert U.build_cues(spark.createDataFrame([], "media_id long, sequence int, start double, end double, text string")).count() == 0


def test_every_cue_is_balanced(spark, tmp_path):
    from reelspan.plans.registry import QUERIES

    text = " ".join(f"word{i}" for i in range(90))
    spark.createDataFrame([(1, text, "en", "a", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    cues = {r.cue_index: r.text for r in QUERIES["subtitle_cues"](spark, str(tmp_path)).collect()}
    lines = {r.cue_index: r.lines for r in QUERIES["balanced_cues"](spark, str(tmp_path)).collect()}
    assert {i: x.replace("\n", " ") for i, x in lines.items()} == cues and sum(map(len, cues.values())) > 78
    assert "word89" in " ".join(cues.values()) and all("\n" in x for i, x in lines.items() if len(cues[i]) > 42)
