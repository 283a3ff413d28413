"""The stages of the pipeline on small cases."""

import random

import corpus_pipeline as P
from reelspan.llm.linededup import _windows, dedup_lines, repeated_lines

rng = random.Random(4)


def prose(n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_fragments_between_pipes_go(spark):
    clean = prose(120)
    junk = " | ".join(f"item{i}" for i in range(120))  # 15 % symbols
    docs = spark.createDataFrame([(1, clean), (2, junk)], "doc_id long, text string")
    assert [r.doc_id for r in P.quality_rules(spark, docs, "").collect()] == [1]


def test_short_runs_of_many_words_go(spark):
    lines = [prose(rng.choice([5, 30, 60])) for _ in range(12)]
    docs = {i: [rng.choice(lines) if rng.random() < 0.6 else prose(9) for _ in range(rng.choice([1, 2, 5]))] for i in range(60)}
    docs |= {100: lines[:2], 101: lines[:2], 102: [prose(50)], 103: [prose(49)]}
    docs |= {104: docs[102], 105: docs[103]}
    first, gone = {}, {i: set() for i in docs}
    for i in sorted(docs):
        for n in (1, 2, 3):
            for s in range(len(docs[i]) - n + 1):
                run = tuple(docs[i][s : s + n])
                if (n == 3 or sum(len(x.split()) for x in run) >= 50) and first.setdefault(run, (i, s)) != (i, s):
                    gone[i] |= set(range(s, s + n))
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string")
    assert {r.doc_id: set(r.line_gone) for r in dedup_lines(df, words=50).collect()} == gone
    assert gone[104] == {0} and not gone[105] and gone[101]
    left = {r.doc_id for r in P.line_dedup(spark, df.selectExpr("*", "length(text) AS n_chars"), "").collect()}
    assert left == {i for i in docs if len(gone[i]) < len(docs[i])}


def test_lines_are_made_once(spark):
    """Windows come from a kept table and its plan names the text's lines once: made again for each window, long documents cost the square of their lines."""
    lines = [f"line {i}" for i in range(3000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["x", *lines[1000:2000]]))], "doc_id long, text string")
    for words in (None, 50):
        gone = repeated_lines(df, words=words)
        assert "split(" not in gone._jdf.queryExecution().optimizedPlan().toString()
        assert _windows(df, "doc_id", "text", 3, words)._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
        assert [(r.d, r.gone) for r in gone.collect()] == [(2, list(range(1, 1001)))]


def test_one_row_of_a_group_stays(spark):
    base, other = prose(200).split(), prose(200)
    near = " ".join(["changed", *base[1:]])
    rows = [(5, " ".join(base)), (5, " ".join(base)), (3, near), (9, " ".join(base)), (7, other), (None, other), (None, other), (None, None), (None, None), (11, None), (12, ""), (13, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rep", "2 AS comp")
    left = P.near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == sorted([(3, near), (7, other), (-1, other), (-1, ""), (11, ""), (12, ""), (13, "")])
    assert P.near_dedup(spark, docs.limit(0), "").count() == 0


def test_stages_in_order(spark, tmp_path):
    """run() keeps clean documents, and what the stages are there for goes."""
    clean = {i: "\n".join(prose(40) for _ in range(4)) for i in range(40)}
    phrase = prose(30)
    lines = clean[4].split("\n")
    near = "\n".join(["other " + lines[0][6:], lines[1], "other " + lines[2][6:], lines[3]])  # no equal run of three lines or 50 words
    docs = clean | {100: clean[3], 101: near, 102: clean[5] + "\n" + phrase, 103: "x " * 300, 104: " | ".join(f"i{k}" for k in range(120))}
    spark.createDataFrame([(i, t, "en", "hot" if i % 3 else "b", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, phrase)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(clean) and {r.doc_id: r.text for r in got} == clean
    assert len({(r.mix_slot, r.mix_place) for r in got}) == len(got)
