"""Small cases: nulls, empty and repeated rows, ties, empty tables, clashing columns; brute force where SQL has no form."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.llm.chat import format_conversations, parse_chat, read_back
from reelspan.llm.decontam import drop_contaminated, find_contamination
from reelspan.llm.linededup import dedup_lines
from reelspan.llm.mixing import mix_sources
from reelspan.llm.passages import find_passages
from reelspan.llm.quality import keep_good, measure_quality
from reelspan.llm.rlbwt import RunLengthIndex, remove_repeats
from reelspan.llm.setsketch import SketchRules, joint_similarity, near_duplicates, registers
from reelspan.llm.suffix import FMIndex
from reelspan.llm.template import Template, TemplateError, escape, unescape
from reelspan.llm.tokencount import attribute, count_tokens, encoder
from reelspan.llm.warc import page_of, read_records, record_id, write_archives

random.seed(5)
VOCAB = ["w" + str(i) for i in range(400)]
LONG = [" ".join(random.choice(VOCAB) for _ in range(120)) for _ in range(6)]
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, LONG[0], "a"), (4, LONG[0], "b"), (4, LONG[0], "b"), (5, LONG[1] + "\n" + LONG[2][:300], None), (6, "x\n" + LONG[2][:300] + " é😀", "b"),
    (7, LONG[3].replace("w1 ", "zz ", 1), "c"), (8, LONG[3], "c"), (None, LONG[4], "c"), (9, "a", "c"), (10, "l1 x\nl2 y\nl3 z\nq", "c"), (11, "p\nl1 x\nl2 y\nl3 z", "c"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("rank", F.lit(1)).withColumn("n", F.lit("clash")).withColumn("spans", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, empty):
    rows = measure_quality(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r.base_failed for r in rows if r.doc_id in (1, 2, 9, 10))
    assert all(r.kept for r in rows if r.doc_id == 3)
    assert keep_good(docs).columns == docs.columns
    assert measure_quality(empty).count() == 0


def test_mixing_stays_within_a_block(spark, docs, empty):
    assert mix_sources(docs).count() == len(ROWS) and mix_sources(empty).count() == 0
    big = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    slots = mix_sources(big, block=4, resolution=100).select("source", "mix_slot", "mix_release", "mix_deadline").distinct().collect()
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in slots)
    assert len({r.mix_slot for r in slots}) == len(slots)


def test_mixing_weights_and_names(spark):
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int")).alias("source"), F.lit("x").alias("mix_slot"), F.lit("y").alias("__bin"), F.lit("z").alias("n"))
    weights = spark.createDataFrame([("a", 0.75), ("b", 0.25), ("c", 0.0)], "source string, weight double")
    out = mix_sources(rows, weights, block=2, resolution=4)
    assert out.columns == ["doc_id", "source", "__bin", "n", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place"]
    got = out.collect()
    assert len(got) == 600 and all((r.mix_slot is None) == (r.source in "cd") for r in got)
    first = [r.source for r in sorted((r for r in got if r.mix_slot is not None), key=lambda r: (r.mix_slot, r.mix_place))][:96]
    assert first.count("a") == 72 and all(abs(first[:k].count("a") - 0.75 * k) <= 2 for k in range(97))
    none = mix_sources(rows, spark.createDataFrame([("a", 0.0)], weights.schema)).collect()
    assert len(none) == 600 and all(r.mix_slot is None for r in none)


def test_fm_index():
    seq = np.array([random.randint(2, 5) for _ in range(500)])
    index = FMIndex(seq, 6)
    patterns = np.array([[2, 3, 4], [5, 5, 5], [2, 2, 3]])
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns.tolist(), lo, hi, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(498) if seq[i : i + 3].tolist() == p]


@pytest.mark.parametrize("limit", [4 << 20, 60])
def test_decontamination(spark, docs, empty, limit):
    words = LONG[0].split()
    bench = spark.createDataFrame([(1, " ".join(words[20:35])), (2, "Q " + " ".join(words[20:30]).upper()), (3, "é😀"), (4, None), (5, "."), (None, "l2 y")], "item_id long, text string")
    got = {r.doc_id: r for r in find_contamination(docs, bench, limit=limit).collect()}
    assert got[3].n_hit == 15 and got[3].items == ["1"] or got[3].items == ["1", "2"]
    text = dict(ROWS_BY_ID)[3]
    assert [text[s.start : s.end] for s in got[3].spans] == [" ".join(words[20:35])]
    assert got[6].items == ["3"] and got[10].n_hit == 2 and got[10].items == [] and got[1].n_words == 0
    assert drop_contaminated(docs, bench, limit=limit).count() == len(ROWS) - 6
    assert drop_contaminated(docs, bench.limit(0)).count() == len(ROWS) and find_contamination(empty, bench).count() == 0


ROWS_BY_ID = [(r[0], r[1]) for r in ROWS]


def test_template():
    t = Template("{% for m in messages %}{% if 1 == 1 %}[{{ m.role + '!' }}]{% endif %}{% generation %}{{ m['text'] | upper }}{% endgeneration %}{% if loop.last %}{{ 'e' + 'nd' }}{% endif %}{% endfor %}")
    text, spans = t.render(messages=[{"role": "a", "text": "x"}, {"role": "b", "text": "yz"}])
    assert text == "[a!]X[b!]YZend" and [text[a:b] for a, b in spans] == ["X", "YZ"]
    for bad in ("{% if x %}", "{{ x() }}", "{% import os %}", "{{ x.__class__.mro() }}", "{% endfor %}", "{{ }}"):
        with pytest.raises(TemplateError):
            Template(bad)
    for s in ("<|im_end|>", "\\<|", "<\\|", "\\\\", "<", "<<||>", ""):
        assert unescape(escape(s)) == s and "<|" not in escape(s)


def test_chat(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (2, 0, None, "x\ny"), (2, 0, None, "x\ny"), (None, 0, "assistant", "é😀")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in format_conversations(turns).collect()}
    assert parse_chat(out[1].formatted) == [("user", ""), ("assistant", "b<|im_end|>")] and len(parse_chat(out[2].formatted)) == 2
    back = {r.conv_id: r for r in read_back(format_conversations(turns)).collect()}
    assert back[None].loss_chars == 2 and back[1].loss_sha256 == hashlib.sha256(b"b<|im_end|>").hexdigest()
    assert format_conversations(turns.limit(0)).count() == 0
    odd = [("us\ner", "hi"), ("a\\n\n\\", "<|im_end|>\n\\n"), ("\n", "")]
    said = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(odd)], "conv_id long, turn long, role string, text string")
    assert parse_chat(format_conversations(said).first().formatted) == odd


def test_tokens(docs, empty):
    rows = count_tokens(docs).collect()
    coder, _ = encoder()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
    assert total[5] == len(coder.encode_ordinary(dict(ROWS_BY_ID)[5])) and total[1] == total[2] == 0
    assert count_tokens(empty).count() == 0
    ends, tile = np.array([3, 6, 10]), np.array([4, 5, 10])
    assert attribute(ends, tile, "majority")[0].tolist() == [0, 0, 2] and attribute(ends, tile, "last")[0].tolist() == [0, 2, 2]


def test_lines(docs, empty):
    got = {(r.doc_id): r for r in dedup_lines(docs).collect()}
    assert got[10].line_gone == [] and got[11].line_gone == [1, 2, 3] and got[11].line_kept == "p"
    assert got[1].line_kept is None and dedup_lines(empty).count() == 0 and dedup_lines(docs).count() == len(ROWS)
    clash = docs.selectExpr("doc_id", "text", "1 AS line_kept", "2 AS __d", "3 AS __hash", "4 AS d")
    again = {(r.doc_id): r for r in dedup_lines(clash).collect()}
    assert again[11].line_kept == "p" and again[11]["__d"] == 2 and again[11].d == 4


def test_passages(docs, empty):
    pairs = {(r.doc_id, r.match_doc_id) for r in find_passages(docs).collect()}
    assert {(4, 3), (6, 5), (8, 7)} <= pairs and not any(1 in p or 9 in p for p in pairs)
    assert find_passages(empty).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u1", "same"), (2, "u\r\n2", "same"), (3, None, None), (-4, "u4", ""), (5, "u5", "é😀"), (None, "u6", "é😀")], "page_id long, url string, html string")
    got = {r.page_id: r for r in read_records(write_archives(pages), payload=True).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and bytes(got[2].payload) == b"same" and got[1].payload_bytes == 4
    assert got[-4].refers_to == 3 and got[None].refers_to == 5 and bytes(got[5].payload).decode() == "é😀"
    assert [page_of(record_id(x)) for x in (0, -1, None, 2**62)] == [0, -1, None, 2**62]
    assert read_records(write_archives(pages.limit(0))).count() == 0
    # one payload in most rows, a very long one, repeated rows, null ids, a column that clashes with the digest's
    many = spark.range(3000).selectExpr("if(id % 500 = 499, null, id) AS page_id", "'u' AS url", "if(id % 3 > 0, 'hot', concat('p', id div 6)) AS html", "1 AS sha1", "2 AS refers_to", "3 AS n")
    many = many.unionByName(many.where("page_id = 7")).unionByName(many.where("page_id = 7").withColumn("page_id", F.lit(9999)).withColumn("html", F.expr("repeat('long é ', 1000000)")))
    rows = many.select("page_id", "html").collect()
    keep = {}
    for r in rows:
        keep[r.html] = max(keep.get(r.html, -1), -1 if r.page_id is None else r.page_id)
    expected = sorted((-1 if r.page_id is None else r.page_id, len(r.html.encode()), keep[r.html] if r.page_id != keep[r.html] and keep[r.html] >= 0 else -1) for r in rows)
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, -1 if r.refers_to is None else r.refers_to) for r in read_records(write_archives(many)).collect()) == expected


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        inside = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                inside[i : i + length] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~inside]))
    return out


@pytest.mark.parametrize("hot", [4096, 0])
def test_repeats(docs, empty, hot):
    got = sorted((r.doc_id or -1, bytes(r.kept)) for r in remove_repeats(docs, hot=hot).collect())
    assert got == sorted((r[0] or -1, k) for r, k in zip(ROWS, brute_repeats([r[1] for r in ROWS], 200), strict=True))
    assert remove_repeats(empty).count() == 0


def test_run_length_index():
    base = bytes(random.choice(b"ab") for _ in range(60))
    parts = [base[i : i + 25] for i in (0, 3, 10, 11, 30)] + [b"zz" * 9]
    index = RunLengthIndex(parts)
    ms = index.matching_statistics()
    for begin, p in zip(index.begin, parts, strict=True):
        for o in range(len(p)):
            best = next((n for n in range(len(p) - o, 0, -1) if sum(q[i : i + n] == p[o : o + n] for q in parts for i in range(len(q) - n + 1)) > 1), 0)
            assert ms[begin + o] == best


def test_near_duplicates(spark, docs, empty):
    got = [(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs, rules=SketchRules(3, 85)).collect()]
    assert len(got) == len(ROWS) and got.count((4, 3, False)) == 2
    assert (8, 7, False) in got and (1, 1, True) in got and (None, None, True) in got and (6, 6, True) in got
    assert near_duplicates(empty).count() == 0
    # a chain through a centre that is not the least id
    words = [f"c{i}" for i in range(200)]
    variants = [(i, " ".join(w if k not in range(9 * i, 9 * i + 4) else f"v{i}_{k}" for k, w in enumerate(words))) for i in range(1, 12)] + [(50, " ".join(words))]
    df = spark.createDataFrame(variants, "doc_id long, text string")
    sets = {i: {tuple(re.findall(r"\S+", t)[k : k + 3]) for k in range(198)} for i, t in variants}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: r.component_id for r in near_duplicates(df, rules=SketchRules(3, 85)).collect()} == label


def test_sketch_estimates():
    rules = SketchRules()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(x[:2000]), np.sort(x[400:2400])
    regs = registers(np.concatenate([a, b]), np.array([0, 2000, 4000]), rules)
    assert abs(joint_similarity(regs[:1], regs[1:], np.array([2000.0]), np.array([2000.0]))[0] - 1600 / 2400) < 0.2
