import random

from pyspark.sql import functions as F

from reelspan.functions.text import fixed_micros
from reelspan.operators.edits import filter_graph
from reelspan.operators.subtitles import PLACED
from reelspan.operators.terms import candidates, term_counts, term_occurrences
from reelspan.sources.probe import read_probes


def test_filter_graph(spark):
    df = spark.createDataFrame([(1, 0.0, 1.5), (1, 3.0, 4.0), (2, 0.0, 2.0)], "media_id long, start double, end double")
    got = {r.media_id: r.graph for r in filter_graph(df).collect()}
    assert got[1].split("\n")[0] == "[0:v:0]select='gte(t,0.000000)*lt(t,1.500000)+gte(t,3.000000)*lt(t,4.000000)',setpts='PTS-STARTPTS-(gte(T,3.000000)*1.500000)/TB'[vout];"
    assert got[2] == "[0:v:0]select='gte(t,0.000000)*lt(t,2.000000)',setpts='PTS-STARTPTS'[vout];\n[0:a:0]aselect='gte(t,0.000000)*lt(t,2.000000)',asetpts='PTS-STARTPTS'[aout]\n"


def test_fixed_micros(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(0, 10_000), 7) for _ in range(2000)] + [i / 128 + 5 / 10**7 for i in range(500)] + [0.0000005, 1.0000015, 0.5, 0.0, 1 / 3, 99_999.9999996]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed_micros(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == ["%.6f" % r.v for r in got]


def test_probes(spark):
    rows = [
        (1, '{"format": {"duration": "12.5"}, "streams": [{"codec_type": "video"}, {"codec_type": "audio", "duration": "3"}]}'), (2, '{"format": {"duration": "N/A"}, "streams": [{"codec_type": "audio", "duration": "3"}]}'),
        (3, '{"streams": [{"codec_type": "video"}, {"codec_type": "audio", "duration": "-1"}]}'), (4, "no json"), (5, None), (6, "{}"),
    ]
    got = {r[0]: tuple(r[1:]) for r in read_probes(spark.createDataFrame(rows, "media_id long, probe string")).collect()}
    assert got == {1: (12.5, 1, 1, True), 2: (3.0, 0, 1, False), 3: (0.0, 1, 1, False), 4: (0.0, 0, 0, False), 5: (0.0, 0, 0, False), 6: (0.0, 0, 0, False)}


def test_terms(spark):
    said = [(1, "c001", "LOS runs on LOS, R O S and Cube Bars."), (1, "c002", "The LOS. Cube Bars again (R O S) with C++ 9"), (2, "c001", "plain words")]
    rows = []
    for media, chunk, text in said:
        at, tokens = 0, []
        for i, w in enumerate(text.split(" ")):
            tokens.append((f"s:{i}", i, w, at, at + len(w), 0.0, 1.0, "x", 0.5 if w == "LOS" else None))
            at += len(w) + 1
        rows.append((media, chunk, text, tokens))
    chunks = spark.createDataFrame(rows, f"media_id long, chunk_id string, text string, tokens {PLACED}")
    found = term_occurrences(chunks)
    got = {r.form: r for r in term_counts(found).collect()}
    count = {f: (r.occurrence_count, r.scope_count) for f, r in got.items()}
    assert count["LOS"] == (3, 2) and count["R O S"] == (2, 2) and count["Cube Bars"] == (2, 2) and count["C++"] == (1, 1)
    assert "plain" not in got and "LOS, R" not in got and got["LOS"].average_probability == 0.5 and got["C++"].average_probability is None
    best = {r.original: r for r in candidates(found, 8).where("media_id = 1").collect()}
    assert best["LOS"].candidate_id == "t001" and [c.scope_id for c in best["LOS"].contexts] == ["c001", "c001", "c002"] and "R O S" in [v.text for v in best["LOS"].near_variants]
