"""Rules are judged, applied, projected and audited; summary contracts, jobs and sinks. Expected values are stated by hand."""

import json
import os

import pytest
from pyspark.sql import functions as F

from reelspan import sinks
from reelspan.functions.similarity import similarity
from reelspan.operators import corrections as C
from reelspan.operators import jobs as J
from reelspan.operators import subtitles as U
from reelspan.operators import summaries as Y
from reelspan.sources import documents as D

SEGMENTS = "media_id long, pos int, start double, end double, text string"
CANDIDATES = "media_id long, candidate_id string, original string, occurrence_count long"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(1, 0, 0.0, 4.0, "LOS starts LOS.com LOS-based Cube Bars works."), (1, 1, 100.0, 104.0, "LOS ends. R O S works"), (1, 2, 200.0, 203.0, "motor runs RViz")]
    return U.correction_chunks(spark.createDataFrame(rows, SEGMENTS), 30).persist()


def judged(spark, chunks, response, cap=32):
    known = spark.createDataFrame([(1, "t001", "LOS", 2), (1, "t002", "C++", 3), (1, "t003", "Cube Bars", 1)], CANDIDATES)
    answers = spark.createDataFrame([(1, json.dumps(response))], "media_id long, response string")
    return C.judged(C.proposals(answers), chunks, known, cap)


def test_judging(spark, chunks):
    document = [("t001", "ROS"), ("t009", "X"), ("t002", "C#"), ("t003", "CubeMars"), ("t001", "RDS")]
    local = [("c001", "Cube Bars", "CubeMars"), ("c009", "LOS", "ROS"), ("c001", "", "x"), ("c003", "motor", "rotor"), ("c002", "R O S", "ROS"), ("c001", "LOS-b", "ROS-b"), ("c003", "RViz", "QQQQ9")]
    response = {"document_rules": [{"candidate_id": a, "replacement": b} for a, b in document], "local_rules": [None] + [{"scope_id": a, "original": b, "replacement": c} for a, b, c in local]}
    got = {r.ord: (r.reason, r.rule_id, r.matched_occurrences) for r in judged(spark, chunks, response).collect()}
    assert got[0] == (None, "r001", 2) and got[1][0] == "unknown_candidate" and got[2][0] == "no_exact_match" and got[3][0] == "unsafe_document_scope" and got[4][0] in ("duplicate", "low_similarity")
    assert got[5][0] == "invalid_object" and got[6] == (None, "r002", 1) and got[7][0] == "unknown_scope" and got[8][0] == "invalid_text" and got[9][0] == "unsafe_local_scope"
    assert got[10] == (None, "r003", 1) and got[11][0] == "no_exact_match" and got[12][0] == "low_similarity"
    capped = {r.ord: r.reason for r in judged(spark, chunks, response, 1).collect()}
    assert capped[0] is None and capped[1] == "unknown_candidate" and capped[6] == capped[9] == "safety_cap" and capped[5] == "invalid_object"
    assert {r.reason: r.n for r in C.rejections(judged(spark, chunks, response)).collect()}["accepted_local"] == 2
    assert similarity("C++", "C#") == 0.0 and similarity("", "x") == 0.0 and similarity("ＲＯＳ", "ros") == 1.0


def test_applying_and_delivery(spark, chunks):
    rules = spark.createDataFrame(
        [(1, "document", "LOS", "ROS", "r001", 2), (1, "c002", "LOS", "RQS", "r002", 1), (1, "c001", "Cube Bars", "CubeMars", "r003", 1), (1, "c003", "RViz", "a", "r004", 1), (1, "c003", "RViz", "b", "r005", 1), (1, "document", "motor", "rotor", "r006", 1)],
        "media_id long, scope_id string, original string, replacement string, rule_id string, matched_occurrences long",
    )
    done = C.apply_rules(chunks, rules)
    got = {r.chunk_id: r for r in done.collect()}
    assert got["c001"].text == "ROS starts LOS.com LOS-based CubeMars works." and got["c002"].text == "RQS ends. R O S works"
    assert got["c003"].text == "rotor runs RViz" and got["c003"].conflicts == [["r004", "r005"]] and got["c001"].occurrences[1].occurrence_id == "c001:o0002"
    for r in got.values():
        assert all(r.source_text[o.char_start : o.char_end] == o.original for o in r.occurrences)
    display = C.display_words(done)
    words = [w.text for w in display.orderBy("chunk_id", "first").collect()]
    assert words[:5] == ["ROS", "starts", "LOS.com", "LOS-based", "CubeMars"] and words[-3:] == ["rotor", "runs", "RViz"]
    merged = display.where("text = 'CubeMars'").first()
    assert len(merged.source_ids) == 2 and merged.start < merged.end and merged.correction_ids == ["c001:o0002"]
    cues = U.build_cues(C.words_of_display(display))
    audit = {r.rule_id: r for r in C.delivery_audit(done, display, cues, rules).collect()}
    assert (audit["r001"].selected, audit["r001"].projected, audit["r001"].delivered) == (1, 1, 1) and audit["r004"].selected == 0 and all(r.exactly_once for r in audit.values())
    lost = C.delivery_audit(done, display, cues.withColumn("correction_ids", F.array().cast("array<string>")), rules)
    with pytest.raises(Exception, match="exactly once"):
        C.assert_delivered(lost).collect()
    assert C.apply_rules(chunks, rules.limit(0)).where("text <> source_text").count() == 0


def test_contracts(spark):
    words = " ".join(["word"] * 130)
    good = {"title_en": "T", "overview_en": [words] * 8, "completion_marker": "complete"}
    cases = [good, good | {"extra": 1}, good | {"completion_marker": "x"}, good | {"title_en": " "}, good | {"overview_en": [words] * 7}, good | {"overview_en": [words] * 7 + [3]}, good | {"overview_en": [words] * 7 + ["1 2"]}, good | {"overview_en": ["word"] * 8}, good | {"title_en": 5}]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(99, "{"), (100, None)], "media_id long, response string")
    got = {r.media_id: r.reason for r in Y.english_contract(rows).collect()}
    assert [got[i] for i in range(9)] == [None, "wrong_fields", "not_complete", "blank_title", "paragraph_count", "blank_overview", "not_latin", "too_few_words", "blank_title"]
    assert got[99] == got[100] == "malformed_json"
    zh = {"title_zh_tw": "題", "overview_zh_tw": ["段"] * 8, "completion_marker": "complete"}
    both = spark.createDataFrame([(0, json.dumps(zh), 8), (1, json.dumps(zh), 9), (2, json.dumps(zh | {"title_zh_tw": "x"}), 8)], "media_id long, response string, paragraph_count int")
    told = Y.translation_contract(both)
    assert {r.media_id: r.reason for r in told.collect()} == {0: None, 1: "paragraph_count", 2: "not_chinese"}
    whole = Y.combined(Y.english_contract(rows), told)
    assert Y.quality(whole).first().reason is None and Y.paragraph_pairs(whole).count() == 8
    assert Y.summary_markdown(whole, "zh_tw", F.lit("a.mp4"), F.lit("m")).first().markdown.startswith("# 題\n\n_來源: a.mp4 · 本機模型: m_\n\n## 詳細摘要\n\n段\n\n")


def test_jobs_and_sinks(spark, tmp_path):
    config = {"silence": {"a": 1}, "video": {"b": 2}, "subtitles": {"c": 3}, "summary": {"d": 4}}
    assert J.config_fingerprint(config, "plan") == J.config_fingerprint(config | {"summary": {}}, "plan") != J.config_fingerprint(config)
    assert J.config_fingerprint(config) == J.config_fingerprint(config | {"subtitles": {}}) != J.config_fingerprint(config, subtitles=True)
    assert D.overlaid({"subtitles": {"correction_scope_seconds": 120, "x": 1}}, {"subtitles": {"alignment_chunk_seconds": 60, "aligner_model": "m"}}) == {"subtitles": {"correction_scope_seconds": 60, "x": 1}}
    (tmp_path / "a.bin").write_bytes(b"x" * 10)
    prints = [J.fingerprinted(spark.read.format("binaryFile").load(str(tmp_path / "a.bin"))).first().fingerprint for _ in range(2)]
    assert prints[0] == prints[1] and len(prints[0]) == 64
    bad = D.transcripts(spark.createDataFrame([(1, "{}"), (2, "no"), (3, '{"segments": [{"start": 0, "end": 1, "text": "x"}]}')], "media_id long, document string"))
    assert {r.media_id: r.error for r in bad.collect()} == {1: "no_segments", 2: "no_segments", 3: None}
    out = str(tmp_path / "out")
    for text in ("first", "second"):
        sinks.publish({"srt": spark.createDataFrame([(1, text), (2, text)], "media_id long, text string")}, out)
    assert sorted(os.listdir(out)) == ["srt"] and {r.value for r in spark.read.text(f"{out}/srt", wholetext=True).collect()} == {"second\n"}
    with pytest.raises(Exception):  # noqa: B017
        sinks.publish({"srt": spark.createDataFrame([(1, "third")], "media_id long, text string"), "md": spark.range(1).selectExpr("id AS media_id", "raise_error('x') AS text")}, out)
    assert sorted(os.listdir(out)) == ["srt"] and {r.value for r in spark.read.text(f"{out}/srt", wholetext=True).collect()} == {"second\n"}
