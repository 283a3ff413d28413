from reelspan.sources.silence_log import parse_silence_log


def parse(spark, log, duration):
    df = spark.createDataFrame([(1, log, duration)], "media_id long, log string, duration double")
    return [(r.start, r.end, r.error) for r in parse_silence_log(df).orderBy("silence_index").collect()]


def test_pairs_and_open_start(spark):
    assert parse(spark, "silence_start: 1.25\nx silence_end: 3.5 | silence_duration: 2.25\nsilence_start: 8.0", 10.0) == [(1.25, 3.5, None), (8.0, 10.0, None)]


def test_orphan_end(spark):
    assert parse(spark, "silence_end: 5.0 | silence_duration: 1.75", None) == [(3.25, 5.0, None)]


def test_errors(spark):
    assert parse(spark, "silence_start: 8.0", None)[0][2] == "open_without_duration"
    assert parse(spark, "silence_end: 5.0", None)[0][2] == "orphan_end"
    assert parse(spark, "silence_start: 1\nsilence_start: 2\nsilence_end: 3", None)[0][2] == "consecutive_starts"
    assert parse(spark, "silence_start: 8.0", 7.0)[0][2] == "end_before_start"
    assert parse(spark, "", 7.0) == []
