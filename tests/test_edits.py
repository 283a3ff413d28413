import pytest

from reelspan.operators import edits as E
from reelspan.params import SilenceParams


def plan(spark, duration, silences, p):
    rows = [(1, float(a), float(b), float(duration)) for a, b in silences]
    df = spark.createDataFrame(rows, "media_id long, start double, end double, duration double")
    media = spark.createDataFrame([(1, float(duration))], "media_id long, duration double")
    edits = E.edit_list(df, media, p)
    spans = lambda a: [(round(r.start, 6), round(r.end, 6)) for r in E.coalesced(edits, a, p).orderBy("start").collect()]
    return [r.reason for r in edits.orderBy("start").collect()], spans("keep"), spans("remove")


P0 = SilenceParams(1, 2, 0.25, 0.5, 0.05)


@pytest.mark.parametrize(
    ("duration", "silences", "p", "removed"),
    [
        (12, [], P0, []),
        (20, [(5, 15)], P0, [(6, 14)]),
        (10, [(0, 4), (7, 10)], SilenceParams(1, 1, 0.25, 0.5, 0), [(0, 3), (8, 10)]),
        (10, [(0, 10)], SilenceParams(1, 1.5, 0.25, 0.5, 0), [(1.5, 10)]),
        (12, [(6.03, 7), (5, 6)], SilenceParams(1.5, 0.4, 0.1, 0.2, 0.05), [(5.2, 6.8)]),
        (10, [(4, 4.5)], P0, []),
        (12, [(4, 8)], SilenceParams(0.5, 0.1, 0.2, 1, 0), [(4.5, 7.5)]),
        (10, [(-2, 2), (9, 12)], SilenceParams(0.5, 0.5, 0.1, 0.1, 0), [(0, 1.5), (9.5, 10)]),
    ],
)
def test_removed(spark, duration, silences, p, removed):
    _, keep, remove = plan(spark, duration, silences, p)
    assert remove == removed
    assert sum(b - a for a, b in keep + remove) == pytest.approx(duration)


def test_reasons(spark):
    assert plan(spark, 20, [(5, 15)], P0)[0] == ["content", "retained_silence", "compressed_silence", "retained_silence", "content"]
    assert plan(spark, 10, [(4, 4.5)], P0)[0] == ["content", "short_silence", "content"]


def test_params():
    with pytest.raises(ValueError):
        SilenceParams(time_epsilon=0)
    with pytest.raises(ValueError):
        SilenceParams(min_silence=float("nan"))
