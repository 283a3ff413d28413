"""Every query of the engine over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan import sinks
from reelspan.functions import text as T
from reelspan.operators import corrections as C
from reelspan.operators import edits as E
from reelspan.operators import jobs as J
from reelspan.operators import segments as S
from reelspan.operators import subtitles as U
from reelspan.operators import summaries as Y
from reelspan.operators import terms as M
from reelspan.operators import tokens as K
from reelspan.sources import documents as D
from reelspan.sources.adapters import responses_of_candidates, segments_from_documents, silences_from_events, summary_responses, table, words_of_segments
from reelspan.sources.probe import read_probes
from reelspan.sources.silence_log import parse_silence_log, render_silence_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def us(*names: str) -> list:
    return [T.micros(F.col(n)).alias(f"{n}_us") for n in names]


def _silences(spark, d):
    return silences_from_events(table(spark, d, "events"))


def _edits(spark, d):
    return E.edit_list(_silences(spark, d))


def _segments(spark, d):
    return segments_from_documents(table(spark, d, "documents"))


# independent SQL: boundaries of the timeline, slices between them, a silence for each slice's midpoint
_PLAN = """
WITH ev AS (SELECT user_id AS media_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9::DOUBLE AS s, value FROM events),
sil AS (SELECT media_id, s AS start_, s + value / 25.0::DOUBLE AS end_, max(s) OVER (PARTITION BY media_id) + 5.0::DOUBLE AS duration FROM ev),
clip AS (SELECT media_id, duration, greatest(0.0::DOUBLE, start_) AS s, least(duration, end_) AS e FROM sil),
reach AS (SELECT *, max(e) OVER (PARTITION BY media_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM clip WHERE e - s > 1e-6::DOUBLE),
isl AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 0.08::DOUBLE + 1e-6::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reach),
merged AS (SELECT media_id, (island - 1)::INT AS idx, any_value(duration) AS duration, min(s) AS s, max(e) AS e FROM isl GROUP BY media_id, island),
flags AS (SELECT *, e - s + 1e-6::DOUBLE >= 1.2::DOUBLE AS eligible, s <= 1e-6::DOUBLE AS ts, e >= duration - 1e-6::DOUBLE AS te FROM merged),
cand AS (SELECT *, CASE WHEN ts AND te THEN s + 0.35::DOUBLE WHEN ts THEN s WHEN te THEN s + 0.35::DOUBLE ELSE s + least(0.35::DOUBLE, e - s) / 2 END AS cs,
  CASE WHEN te THEN e WHEN ts THEN e - 0.35::DOUBLE ELSE e - least(0.35::DOUBLE, e - s) / 2 END AS ce FROM flags),
rem AS (SELECT media_id, idx, duration, s, e, eligible, CASE WHEN eligible AND ce - cs > 1e-6::DOUBLE THEN cs END AS cs, CASE WHEN eligible AND ce - cs > 1e-6::DOUBLE THEN ce END AS ce FROM cand),
bounds AS (SELECT media_id, 0.0::DOUBLE AS t FROM rem UNION SELECT media_id, duration FROM rem UNION SELECT media_id, s FROM rem UNION SELECT media_id, e FROM rem
  UNION SELECT media_id, cs FROM rem WHERE cs IS NOT NULL UNION SELECT media_id, ce FROM rem WHERE ce IS NOT NULL),
slices AS (SELECT media_id, t AS a, lead(t) OVER (PARTITION BY media_id ORDER BY t) AS b FROM bounds),
mid AS (SELECT media_id, a, b, (a + b) / 2 AS m FROM slices WHERE b - a > 1e-6::DOUBLE),
named AS (SELECT mid.media_id, a, b, rem.idx, CASE WHEN rem.cs <= m AND m < rem.ce THEN 'remove' ELSE 'keep' END AS action,
  CASE WHEN rem.idx IS NULL THEN 'content' WHEN rem.cs <= m AND m < rem.ce THEN 'compressed_silence' WHEN NOT eligible THEN 'short_silence' WHEN rem.cs IS NULL THEN 'silence_kept' ELSE 'retained_silence' END AS reason
  FROM mid LEFT JOIN rem ON mid.media_id = rem.media_id AND rem.s <= m AND m < rem.e),
step AS (SELECT *, CASE WHEN lag(action) OVER o = action AND lag(reason) OVER o = reason AND lag(idx) OVER o IS NOT DISTINCT FROM idx AND a <= lag(b) OVER o + 1e-6::DOUBLE THEN 0 ELSE 1 END AS new FROM named WINDOW o AS (PARTITION BY media_id ORDER BY a)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM step),
edits AS (SELECT media_id, min(a) AS a, max(b) AS b, any_value(action) AS action, any_value(reason) AS reason, any_value(idx) AS idx FROM runs GROUP BY media_id, g)
"""
_US = lambda x: f"round_even(({x}) * 1e6::DOUBLE, 0)::BIGINT"
_SPANS = lambda action: f"""{_PLAN}, own AS (SELECT *, CASE WHEN a <= lag(b) OVER (PARTITION BY media_id ORDER BY a) + 1e-6::DOUBLE THEN 0 ELSE 1 END AS fresh FROM edits WHERE action = '{action}'),
grp AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS k FROM own),
spans AS (SELECT media_id, min(a) AS a, max(b) AS b FROM grp GROUP BY media_id, k)"""  # noqa: E731
_SHIFT = _SPANS("keep") + """, gaps AS (SELECT *, CASE WHEN a - coalesce(lag(b) OVER (PARTITION BY media_id ORDER BY a), 0.0::DOUBLE) > 1e-6::DOUBLE THEN a - coalesce(lag(b) OVER (PARTITION BY media_id ORDER BY a), 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS gap FROM spans),
shifts AS (SELECT media_id, a, b, sum(gap) OVER (PARTITION BY media_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS shift FROM gaps)"""


@query(_PLAN + f"SELECT media_id, count(*) AS n_edits, round_even(sum(b - a) FILTER (action = 'keep') * 1e3::DOUBLE, 0)::BIGINT AS kept_ms, round_even(coalesce(sum(b - a) FILTER (action = 'remove'), 0) * 1e3::DOUBLE, 0)::BIGINT AS removed_ms FROM edits GROUP BY media_id")
def edit_plan_totals(spark, d):
    t = E.plan_totals(_edits(spark, d))
    return t.select("media_id", "n_edits", F.bround(F.col("kept") * 1e3).cast("bigint").alias("kept_ms"), F.bround(F.col("removed") * 1e3).cast("bigint").alias("removed_ms"))


@query(_PLAN + f"SELECT media_id, idx AS silence_index, {_US('s')} AS start_us, {_US('e')} AS end_us FROM merged")
def silence_merge(spark, d):
    return E.merge_silences(_silences(spark, d)).select("media_id", "silence_index", *us("start", "end"))


@query(_PLAN + f"SELECT media_id, idx AS silence_index, eligible, coalesce({_US('cs')}, -1) AS cut_start_us, coalesce({_US('ce')}, -1) AS cut_end_us FROM rem")
def silence_removals(spark, d):
    return E.removals(E.merge_silences(_silences(spark, d))).select("media_id", "silence_index", "eligible", *us("cut_start", "cut_end")).fillna(-1)


@query(_PLAN + f"SELECT media_id, {_US('a')} AS start_us, {_US('b')} AS end_us, action, reason, coalesce(idx, -1) AS silence_index FROM edits")
def edit_list(spark, d):
    return _edits(spark, d).select("media_id", *us("start", "end"), "action", "reason", F.coalesce("silence_index", F.lit(-1)).alias("silence_index"))


@query(_PLAN + "SELECT action, reason, count(*) AS n FROM edits GROUP BY action, reason")
def edit_reason_histogram(spark, d):
    return _edits(spark, d).groupBy("action", "reason").agg(F.count("*").alias("n"))


@query(_SPANS("keep") + f"SELECT media_id, {_US('a')} AS start_us, {_US('b')} AS end_us FROM spans")
def edit_keep_spans(spark, d):
    return E.coalesced(_edits(spark, d), "keep").select("media_id", *us("start", "end"))


@query(_SPANS("remove") + f"SELECT media_id, {_US('a')} AS start_us, {_US('b')} AS end_us FROM spans")
def edit_remove_spans(spark, d):
    return E.coalesced(_edits(spark, d), "remove").select("media_id", *us("start", "end"))


@query(_SHIFT + " SELECT media_id, round_even(a * 1e3::DOUBLE, 0)::BIGINT AS start_ms, round_even(shift * 1e3::DOUBLE, 0)::BIGINT AS shift_ms FROM shifts")
def timestamp_shifts(spark, d):
    s = E.timestamp_shifts(E.coalesced(_edits(spark, d), "keep"))
    return s.select("media_id", F.bround(F.col("start") * 1e3).cast("bigint").alias("start_ms"), F.bround(F.col("shift") * 1e3).cast("bigint").alias("shift_ms"))


@query(_SHIFT + """, pts AS (SELECT media_id, s + 2.5::DOUBLE AS t FROM ev)
SELECT p.media_id, round_even(t * 1e3::DOUBLE, 0)::BIGINT AS t_ms, round_even((t - shift) * 1e3::DOUBLE, 0)::BIGINT AS t_out_ms FROM pts p JOIN shifts k ON p.media_id = k.media_id AND k.a <= t AND t < k.b""")
def time_map(spark, d):
    points = _silences(spark, d).select("media_id", (F.col("start") + 2.5).alias("t"))
    m = E.edited_times(points, E.coalesced(_edits(spark, d), "keep"))
    return m.select("media_id", F.bround(F.col("t") * 1e3).cast("bigint").alias("t_ms"), F.bround(F.col("t_out") * 1e3).cast("bigint").alias("t_out_ms"))


_SEG = """
WITH ls AS (SELECT doc_id AS media_id, string_split(text, chr(10)) AS ls FROM documents),
ln AS (SELECT media_id, unnest(ls) AS text, (generate_subscripts(ls, 1) - 1)::INT AS pos FROM ls),
tm AS (SELECT *, (length(text) * 1000) // 5 AS ms, coalesce(sum((length(text) * 1000) // 5 + CASE WHEN pos % 7 = 6 THEN 3000 ELSE 400 END) OVER (PARTITION BY media_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM ln),
seg AS (SELECT media_id, pos, off AS s, off + ms AS e, text FROM tm),
rd AS (SELECT media_id, pos, s, e, regexp_replace(trim(regexp_replace(text, '[\\s\\x1c-\\x1f]+', ' ', 'g')), ' +([,.;:!?])', '\\1', 'g') AS t FROM seg),
ok AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY s, e, pos) AS rn FROM rd WHERE t <> '')
""".replace("\\\\", "\\")
_TS = lambda ms, sep=".": f"printf('%02d:%02d:%02d{sep}%03d', ({ms}) // 3600000, ({ms}) % 3600000 // 60000, ({ms}) % 60000 // 1000, ({ms}) % 1000)"
_CLOCK = lambda ms: f"printf('%02d:%02d:%02d', ({ms}) // 3600000, ({ms}) % 3600000 // 60000, ({ms}) % 60000 // 1000)"


@query(_SEG + "SELECT media_id, pos, s AS start_ms, e AS end_ms, t AS text FROM ok")
def normalized_segments(spark, d):
    r = S.readable(_segments(spark, d))
    return r.select("media_id", "pos", T.millis(F.col("start")).alias("start_ms"), T.millis(F.col("end")).alias("end_ms"), "text")


@query(_SEG.replace("WITH", "WITH RECURSIVE", 1) + r""",
b AS (SELECT media_id, rn, 0 AS k, s AS fs, e AS le, t AS txt, t AS last, s // 300000 * 300 AS section FROM ok WHERE rn = 1
  UNION ALL
  SELECT media_id, rn, CASE WHEN brk THEN k + 1 ELSE k END, CASE WHEN brk THEN s ELSE fs END, e, CASE WHEN brk THEN t ELSE regexp_replace(txt || ' ' || t, ' ([,.;:!?])', '\1', 'g') END, t, CASE WHEN brk THEN s // 300000 * 300 ELSE section END
  FROM (SELECT o.media_id, o.rn, o.s, o.e, o.t, b.k, b.fs, b.txt, b.section, o.s // 300000 * 300 <> b.section OR o.s / 1000.0::DOUBLE - b.le / 1000.0::DOUBLE >= 2.5::DOUBLE OR length(b.txt) + 1 + length(o.t) > 700 OR o.e / 1000.0::DOUBLE - b.fs / 1000.0::DOUBLE > 60::DOUBLE
    OR (length(b.txt) >= 300 AND regexp_matches(b.last, '[.!?]["'')\]]?$')) AS brk FROM b JOIN ok o ON o.media_id = b.media_id AND o.rn = b.rn + 1)),
blocks AS (SELECT media_id, k AS block_index, max(section) AS section_start, max(fs) AS start_ms, max(le) AS end_ms, arg_max(txt, rn) AS text FROM b GROUP BY media_id, k)
SELECT media_id, block_index, section_start, start_ms, end_ms, text FROM blocks""")
def readable_blocks(spark, d):
    b = S.readable_blocks(_segments(spark, d))
    return b.select("media_id", "block_index", "section_start", T.millis(F.col("start")).alias("start_ms"), T.millis(F.col("end")).alias("end_ms"), "text")


_WIN = _SEG + """,
wd AS (SELECT *, max(e) OVER (PARTITION BY media_id) AS dur FROM ok),
wb AS (SELECT *, greatest(300, (ceil(dur / 1000.0::DOUBLE / 12 / 60) * 60)::BIGINT) AS w FROM wd),
wk AS (SELECT *, least(s // (1000 * w), 11) AS bucket FROM wb),
wg AS (SELECT media_id, bucket, any_value(w) AS w, any_value(dur) AS dur, count(*) AS segment_count, regexp_replace(string_agg(t, ' ' ORDER BY s, e, pos), ' +([,.;:!?])', '\\1', 'g') AS text FROM wk GROUP BY media_id, bucket),
win AS (SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY bucket))::INT AS id, bucket * w * 1000 AS start_ms, least((bucket + 1) * w * 1000, dur) AS end_ms, text, length(text) AS char_count, segment_count FROM wg)
""".replace("\\\\", "\\")


@query(_WIN + "SELECT * FROM win")
def prompt_windows(spark, d):
    w = S.prompt_windows(_segments(spark, d))
    return w.select("media_id", "id", T.millis(F.col("start")).alias("start_ms"), T.millis(F.col("end")).alias("end_ms"), "text", "char_count", "segment_count")


@query(_WIN + f""" SELECT media_id, string_agg('<window id="' || id || '" time="' || {_CLOCK('start_ms')} || '-' || {_CLOCK('end_ms')} || '">' || chr(10) || text || chr(10) || '</window>', chr(10) || chr(10) ORDER BY id) AS prompt FROM win GROUP BY media_id""")
def window_prompt(spark, d):
    return S.render_windows(S.prompt_windows(_segments(spark, d)))


@query(_SEG + f""", n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY pos) AS n FROM seg), st AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM n)
SELECT media_id, string_agg(n || chr(10) || {_TS('s', ',')} || ' --> ' || {_TS('e', ',')} || chr(10) || x, chr(10) || chr(10) ORDER BY pos) || chr(10) AS srt FROM st WHERE x <> '' GROUP BY media_id""")
def render_srt(spark, d):
    return S.render_srt(_segments(spark, d))


@query(_SEG + f""", p AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM seg)
SELECT media_id, string_agg('[' || {_TS('s')} || '] ' || x, chr(10) ORDER BY pos) AS prompt FROM p WHERE x <> '' GROUP BY media_id""")
def prompt_lines(spark, d):
    return S.prompt_lines(_segments(spark, d))


_BLOCKS = SQL["readable_blocks"].rpartition("SELECT media_id, block_index")[0]


@query(_BLOCKS + rf""", h AS (SELECT *, lag(section_start) OVER (PARTITION BY media_id ORDER BY block_index) AS before, {_CLOCK('section_start * 1000')} || '–' || {_CLOCK('(section_start + 300) * 1000')} AS span, {_CLOCK('start_ms')} AS clock FROM blocks),
l AS (SELECT *, CASE WHEN before IS NULL THEN '## ' || span || chr(10) || chr(10) WHEN before <> section_start THEN chr(10) || '## ' || span || chr(10) || chr(10) ELSE '' END || '**[' || clock || ']** ' || text || chr(10) AS part FROM h)
SELECT media_id, '# Transcript — documents' || chr(10) || chr(10) || '> Automatically transcribed locally; wording may contain recognition errors.' || chr(10) || chr(10) || regexp_replace(string_agg(part, chr(10) ORDER BY block_index), '\s+$', '') || chr(10) AS markdown FROM l GROUP BY media_id""")
def transcript_markdown(spark, d):
    return S.render_markdown(_segments(spark, d), "documents")


@query(f"SELECT event_id, {_TS('round_even(value * 1000, 0)::BIGINT')} AS plain, {_TS('round_even(value * 1000, 0)::BIGINT', ',')} AS srt, printf('%d:%02d:%02d.%02d', c // 360000, c % 360000 // 6000, c % 6000 // 100, c % 100) AS ass FROM (SELECT event_id, value * 37.0::DOUBLE AS value, round_even(value * 37.0::DOUBLE * 100, 0)::BIGINT AS c FROM events)")
def timestamps(spark, d):
    v = table(spark, d, "events").select("event_id", (F.col("value") * 37.0).alias("v"))
    return v.select("event_id", T.timestamp(F.col("v")).alias("plain"), T.timestamp(F.col("v"), True).alias("srt"), T.ass_time(F.col("v")).alias("ass"))


@query("SELECT doc_id, greatest(1, floor(length(coalesce(text, '')) / 2.8::DOUBLE))::BIGINT AS tokens, sha256(coalesce(text, '')) AS sha256 FROM documents")
def text_measures(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", T.prompt_tokens(text).alias("tokens"), F.sha2(text, 256).alias("sha256"))


@query()
def document_measures(spark, d):
    """The measures of every document with its English words, which letters of any script bound: SQL has no such boundary."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", T.prompt_tokens(text).alias("tokens"), F.sha2(text, 256).alias("sha256"), T.english_words(text).alias("english_words"))


@query("""SELECT page_id, CASE WHEN s = '' THEN 'video' ELSE s END AS stem FROM (SELECT page_id, trim(regexp_replace(url, '[^\\p{L}\\p{N}_\\-]', '_', 'g'), '_') AS s FROM pages)""")
def safe_stem(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_stem(F.col("url")).alias("stem"))


_TARGETS = """
WITH w AS (SELECT doc_id, n_chars AS words, n_chars % 13 AS wins FROM documents),
a AS (SELECT *, ceil(0.20::DOUBLE * words / 100)::BIGINT * 100 AS lo, ceil(0.27::DOUBLE * words / 100)::BIGINT * 100 AS hi FROM w),
b AS (SELECT *, least(2200, greatest(1200, lo)) AS wmin FROM a), c AS (SELECT *, least(2600, greatest(wmin + 400, hi)) AS wmax FROM b),
g AS (SELECT *, greatest(10, least(18, greatest(wins + 2, round_even(wmin / 120.0::DOUBLE, 0)::BIGINT))) AS gmin FROM c),
t AS (SELECT doc_id, words, wmin AS words_min, wmax AS words_max, gmin AS groups_min, greatest(gmin + 4, least(22, ceil(wmax / 100.0::DOUBLE)::BIGINT)) AS groups_max FROM g),
o AS (SELECT *, least(16384, greatest(8192, ceil((2 * words_max + 1024) / 2048.0::DOUBLE)::BIGINT * 2048)) AS output, greatest(1, floor(words / 2.8::DOUBLE))::BIGINT AS est FROM t),
x AS (SELECT *, CASE WHEN est <= 65536 - output - 1024 THEN least(65536, greatest(8192, ceil((est + output + 1024) / 2048.0::DOUBLE)::BIGINT * 2048)) END AS context FROM o)
"""


@query(_TARGETS + "SELECT doc_id, words_min::BIGINT AS words_min, words_max::BIGINT AS words_max, groups_min::BIGINT AS groups_min, groups_max::BIGINT AS groups_max, output::BIGINT AS output, context::BIGINT AS context, round_even((18 + 4.2::DOUBLE * context / 8192 + 4) * 1000, 0)::BIGINT AS memory_mib FROM x")
def summary_sizing(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("words"), (F.col("n_chars") % 13).alias("wins"))
    t = w.withColumns(T.summary_targets(F.col("words"), F.col("wins"))).withColumn("output", T.output_budget(F.col("words_max")))
    t = t.withColumn("context", T.stage_context(T.prompt_tokens_of(F.col("words")), F.col("output")))
    return t.select("doc_id", "words_min", "words_max", "groups_min", "groups_max", "output", "context", F.bround(T.memory_gib(F.col("context")) * 1000).cast("bigint").alias("memory_mib"))


@query("""WITH w AS (SELECT conv_id, turn, role, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM conversations WHERE text IS NOT NULL), x AS (SELECT conv_id, turn, role, ws, array_to_string(ws, ' ') AS t FROM w),
c AS (SELECT conv_id, turn, role, list_min(list_transform(range(1, len(ws)), lambda i: {'o': greatest(0, length(array_to_string(ws[:i], ' ')) - 42) + greatest(0, length(array_to_string(ws[i + 1:], ' ')) - 42),
  'd': abs(length(array_to_string(ws[:i], ' ')) - length(array_to_string(ws[i + 1:], ' '))), 'l': array_to_string(ws[:i], ' '), 'r': array_to_string(ws[i + 1:], ' ')})) AS m, t, len(ws) AS n FROM x)
SELECT conv_id, turn, role, CASE WHEN length(t) <= 42 OR n < 2 THEN t ELSE m.l || chr(10) || m.r END AS lines FROM c""")
def balanced_lines(spark, d):
    """The texts of conversations on two lines each."""
    t = table(spark, d, "conversations").where("text IS NOT NULL").withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    return t.select("conv_id", "turn", "role", T.balanced_lines(F.col("text")).alias("lines"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS f FROM documents), t AS (SELECT DISTINCT f, regexp_replace(f, '[^\\p{L}]', '', 'g') AS l FROM w)
SELECT f AS form FROM t WHERE length(l) > 0 AND ((length(l) >= 2 AND NOT regexp_matches(l, '[^\\p{Lu}]')) OR regexp_matches(f, '\\p{Nd}') OR regexp_matches(substr(f, 2), '\\p{Lu}') OR regexp_matches(f, '[+/#_.\\-]'))""")
def technical_forms(spark, d):
    forms = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("form")).distinct()
    return forms.where(T.technical_shape(F.col("form")))


@query("""SELECT user_id AS media_id, event_type AS stage, count(*) AS n_events, arg_max(event_id, ts) AS latest_event, greatest(5368709120, 2 * max(event_id) + 32000 * count(*))::BIGINT AS disk_bytes FROM events GROUP BY user_id, event_type""")
def job_latest_state(spark, d):
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("media_id"), F.col("event_type").alias("stage"))
    return g.agg(F.count("*").alias("n_events"), F.max_by("event_id", "ts").alias("latest_event"), F.greatest(F.lit(5368709120), 2 * F.max("event_id") + 32000 * F.count("*")).cast("bigint").alias("disk_bytes"))


@query(_PLAN + f"SELECT media_id, idx AS silence_index, {_US('s')} AS start_us, {_US('e')} AS end_us, 0::BIGINT AS n_errors FROM merged")
def silence_log_parse(spark, d):
    parsed = parse_silence_log(render_silence_log(E.merge_silences(_silences(spark, d))))
    return parsed.select("media_id", "silence_index", *us("start", "end"), F.col("error").isNotNull().cast("bigint").alias("n_errors"))


@query(_SPANS("keep") + """, parts AS (SELECT *, a - lag(b) OVER (PARTITION BY media_id ORDER BY a) AS gap FROM spans),
g AS (SELECT media_id, string_agg(printf('gte(t,%.6f)*lt(t,%.6f)', a, b), '+' ORDER BY a) AS chosen, string_agg(printf('gte(T,%.6f)*%.6f', a, gap), '+' ORDER BY a) FILTER (gap > 1e-6::DOUBLE) AS moved FROM parts GROUP BY media_id),
h AS (SELECT *, CASE WHEN moved IS NULL THEN 'PTS-STARTPTS' ELSE 'PTS-STARTPTS-(' || moved || ')/TB' END AS pts FROM g)
SELECT media_id, '[0:v:0]select=''' || chosen || ''',setpts=''' || pts || '''[vout];' || chr(10) || '[0:a:0]aselect=''' || chosen || ''',asetpts=''' || pts || '''[aout]' || chr(10) AS graph FROM h""")
def filter_graph(spark, d):
    return E.filter_graph(E.coalesced(_edits(spark, d), "keep"))


_TOKENS = _SEG + r""",
wl AS (SELECT media_id, pos, s, e, string_split(t, ' ') AS ws FROM ok),
wu AS (SELECT media_id, pos, s, e, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM wl),
wp AS (SELECT *, sum(length(w) + 1) OVER o - 1 AS char_end, sum(CASE WHEN regexp_matches(w, '[\p{L}\p{N}_]') THEN 1 ELSE 0 END) OVER o AS token FROM wu WINDOW o AS (PARTITION BY media_id, pos ORDER BY k ROWS UNBOUNDED PRECEDING)),
tk AS (SELECT media_id, pos, token, s, e, string_agg(w, '' ORDER BY k) AS text, min(char_end - length(w)) AS char_start, max(char_end) AS char_end FROM wp WHERE token > 0 GROUP BY media_id, pos, token, s, e),
tn AS (SELECT *, max(token) OVER (PARTITION BY media_id, pos) AS n, greatest(0.01::DOUBLE, e / 1000.0::DOUBLE - s / 1000.0::DOUBLE) AS len FROM tk)
"""


@query(_TOKENS + "SELECT media_id, pos, (token - 1)::BIGINT AS token_index, text, char_start::BIGINT AS char_start, char_end::BIGINT AS char_end, floor((s / 1000.0::DOUBLE + len * (token - 1) / n) * 1000 + 1e-6::DOUBLE)::BIGINT AS start_ms, floor((s / 1000.0::DOUBLE + len * token / n) * 1000 + 1e-6::DOUBLE)::BIGINT AS end_ms FROM tn")
def source_tokens(spark, d):
    t = K.timed_tokens(_segments(spark, d))
    ms = lambda n: F.floor(F.col(n) * 1000 + 1e-6).cast("bigint").alias(f"{n}_ms")
    return t.select("media_id", "pos", "token_index", "text", "char_start", "char_end", ms("start"), ms("end"))


_TIGHT = lambda x: r"regexp_replace(regexp_replace(#, ' +([,.;:!?%\])])', '\1', 'g'), '([\[(]) +', '\1', 'g')".replace("#", x)
_CHUNKS = _TOKENS.replace("WITH", "WITH RECURSIVE", 1) + rf""",
has AS (SELECT ok.media_id, ok.pos, ok.s, ok.e, row_number() OVER (PARTITION BY ok.media_id ORDER BY ok.s, ok.e, ok.pos) AS rn FROM ok SEMI JOIN tk ON ok.media_id = tk.media_id AND ok.pos = tk.pos),
b AS (SELECT media_id, rn, 0 AS k, s AS fs FROM has WHERE rn = 1
  UNION ALL
  SELECT o.media_id, o.rn, CASE WHEN o.e - b.fs > 120000 THEN k + 1 ELSE k END, CASE WHEN o.e - b.fs > 120000 THEN o.s ELSE b.fs END FROM b JOIN has o ON o.media_id = b.media_id AND o.rn = b.rn + 1),
part AS (SELECT b.media_id, b.k, b.rn, has.s, has.e, has.pos FROM b JOIN has ON has.media_id = b.media_id AND has.rn = b.rn),
lines AS (SELECT part.media_id, part.k, {_TIGHT("string_agg(tk.text, ' ' ORDER BY part.rn, tk.token)")} AS text FROM part JOIN tk ON tk.media_id = part.media_id AND tk.pos = part.pos GROUP BY part.media_id, part.k),
ch AS (SELECT media_id, k, printf('c%03d', k + 1) AS chunk_id, min(s) AS start_ms, arg_max(e, rn) AS end_ms, count(*) AS n_segments FROM part GROUP BY media_id, k),
chunks AS (SELECT ch.*, lines.text FROM ch JOIN lines ON ch.media_id = lines.media_id AND ch.k = lines.k)
"""


@query(_CHUNKS + "SELECT media_id, chunk_id, start_ms, end_ms, text, n_segments FROM chunks")
def correction_chunks(spark, d):
    c = U.correction_chunks(_segments(spark, d))
    return c.select("media_id", "chunk_id", T.millis(F.col("start")).alias("start_ms"), T.millis(F.col("end")).alias("end_ms"), "text", F.col("n_segments").cast("bigint").alias("n_segments"))


def _cues(spark, d):
    return U.build_cues(U.words_of_tokens(K.timed_tokens(_segments(spark, d))))


@query()
def subtitle_cues(spark, d):
    return _cues(spark, d).select("media_id", "cue_index", *us("start", "end"), "text")


@query()
def balanced_cues(spark, d):
    """The lines of every cue."""
    return _cues(spark, d).select("media_id", "cue_index", T.balanced_lines(F.col("text")).alias("lines"))


@query()
def subtitle_srt(spark, d):
    return U.subtitle_srt(_cues(spark, d))


@query()
def subtitle_ass(spark, d):
    return U.subtitle_ass(_cues(spark, d))


_FORM = r"regexp_replace(trim({}), '^\p{{P}}+|\p{{P}}+$', '', 'g')".format
_CLOSED = "regexp_matches({}, '[.!?,;:]$')".format


@query(_CHUNKS + rf""",
cl AS (SELECT media_id, chunk_id, string_split(text, ' ') AS ws FROM chunks),
cu AS (SELECT media_id, chunk_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM cl),
cp AS (SELECT *, sum(CASE WHEN regexp_matches(w, '[\p{{L}}\p{{N}}_]') THEN 1 ELSE 0 END) OVER (PARTITION BY media_id, chunk_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS token FROM cu),
ck AS (SELECT media_id, chunk_id, token, string_agg(w, '' ORDER BY k) AS t, string_agg(w, ' ' ORDER BY k) AS r FROM cp WHERE token > 0 GROUP BY media_id, chunk_id, token),
g1 AS (SELECT media_id, chunk_id, 1 AS width, r AS txt, [t] AS ps FROM ck),
g2 AS (SELECT a.media_id, a.chunk_id, 2, a.r || ' ' || b.r, [a.t, b.t] FROM ck a JOIN ck b ON a.media_id = b.media_id AND a.chunk_id = b.chunk_id AND b.token = a.token + 1 WHERE NOT {_CLOSED('a.t')}),
g3 AS (SELECT a.media_id, a.chunk_id, 3, a.r || ' ' || b.r || ' ' || c.r, [a.t, b.t, c.t] FROM ck a JOIN ck b ON a.media_id = b.media_id AND a.chunk_id = b.chunk_id AND b.token = a.token + 1
  JOIN ck c ON a.media_id = c.media_id AND a.chunk_id = c.chunk_id AND c.token = a.token + 2 WHERE NOT {_CLOSED('a.t')} AND NOT {_CLOSED('b.t')}),
g AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3),
f AS (SELECT media_id, chunk_id, width, {_FORM('txt')} AS form, list_transform(ps, lambda p: {_FORM('p')}) AS ps FROM g),
x AS (SELECT *, regexp_replace(form, '[^\p{{L}}]', '', 'g') AS l FROM f WHERE length(form) <= 40)
SELECT media_id, form, count(*)::BIGINT AS occurrence_count, count(DISTINCT chunk_id) AS scope_count FROM x
WHERE length(l) > 0 AND ((length(l) >= 2 AND NOT regexp_matches(l, '[^\p{{Lu}}]')) OR regexp_matches(form, '\p{{Nd}}') OR regexp_matches(substr(form, 2), '\p{{Lu}}') OR regexp_matches(form, '[+/#_.\-]'))
  AND (width = 1 OR len(list_filter(ps, lambda p: NOT regexp_matches(p, '^[A-Z0-9]$'))) = 0 OR len(list_filter(ps, lambda p: NOT regexp_matches(p, '^\p{{Lu}}.+$'))) = 0)
GROUP BY media_id, form""")
def term_counts(spark, d):
    return M.term_counts(M.term_occurrences(U.correction_chunks(_segments(spark, d)))).select("media_id", "form", "occurrence_count", "scope_count")


@query("""SELECT event_id AS media_id, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 5 <> 0 THEN value * 2 ELSE 0 END AS duration, 1::BIGINT AS n_video, (event_id % 2)::BIGINT AS n_audio,
event_id % 2 = 1 AND CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 5 <> 0 THEN value * 2 ELSE 0 END > 0 AS usable FROM events""")
def media_probes(spark, d):
    e = table(spark, d, "events").withColumn("id", F.col("event_id"))
    whole = F.when(F.col("id") % 3 == 0, F.col("value").cast("string")).otherwise("N/A")
    track = lambda kind, length: F.struct(kind.alias("codec_type"), length.alias("duration"))
    kind = F.when(F.col("id") % 2 == 1, "audio").otherwise("data")
    streams = F.array(track(F.lit("video"), F.lit("-1")), track(kind, F.when(F.col("id") % 5 != 0, (F.col("value") * 2).cast("string"))))
    return read_probes(e.select(F.col("id").alias("media_id"), F.to_json(F.struct(F.struct(whole.alias("duration")).alias("format"), streams.alias("streams"))).alias("probe")))


def _timed(spark, d):
    return words_of_segments(_segments(spark, d))


# words by position: single, in pairs, none, in reverse times; keys of letters and digits tell the tier
_TIMED = _TOKENS + r""",
base AS (SELECT media_id, pos, s, e, e - s AS ms, string_split(t, ' ') AS ws, len(string_split(t, ' ')) AS n FROM ok),
given AS (
  SELECT media_id, pos, s, e, k, ws[k] AS w, s + (ms * (k - 1)) // n AS a, s + (ms * k) // n AS b, 0.5::DOUBLE + ((k - 1) % 5) / 10.0::DOUBLE AS p FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM base WHERE pos % 4 = 0)
  UNION ALL SELECT media_id, pos, s, e, k, ws[2 * k - 1] || coalesce(ws[2 * k], ''), s + (ms * (2 * k - 2)) // n, s + (ms * least(2 * k, n)) // n, 0.5::DOUBLE + ((k - 1) % 5) / 10.0::DOUBLE FROM (SELECT *, unnest(range(1, (n + 1) // 2 + 1)) AS k FROM base WHERE pos % 4 = 1)
  UNION ALL SELECT media_id, pos, s, e, k, ws[k], s + (ms * (n - k)) // n, s + (ms * (n - k + 1)) // n, 0.5::DOUBLE + ((k - 1) % 5) / 10.0::DOUBLE FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM base WHERE pos % 4 = 3)),
keyed AS (SELECT *, lower(regexp_replace(w, '[^\p{L}\p{N}''’]', '', 'g')) AS key FROM given),
good AS (SELECT *, row_number() OVER v AS i, coalesce(sum(length(key)) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(length(key)) OVER (v ROWS UNBOUNDED PRECEDING) AS hi, lag(a) OVER v AS before FROM keyed WHERE key <> '' WINDOW v AS (PARTITION BY media_id, pos ORDER BY k)),
gate AS (SELECT media_id, pos, count(*) AS n_words, string_agg(key, ' ' ORDER BY i) AS keys, string_agg(key, '' ORDER BY i) AS whole FROM good GROUP BY media_id, pos HAVING NOT bool_or(coalesce(a / 1000.0::DOUBLE + 0.05::DOUBLE < before / 1000.0::DOUBLE, false))),
tkk AS (SELECT *, lower(regexp_replace(text, '[^\p{L}\p{N}''’]', '', 'g')) AS key FROM tn),
tkp AS (SELECT *, coalesce(sum(length(key)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(length(key)) OVER (o ROWS UNBOUNDED PRECEDING) AS hi FROM tkk WINDOW o AS (PARTITION BY media_id, pos ORDER BY token)),
said AS (SELECT media_id, pos, string_agg(key, ' ' ORDER BY token) AS keys, string_agg(key, '' ORDER BY token) AS whole, bool_or(key = '') AS gap FROM tkp GROUP BY media_id, pos),
tier AS (SELECT said.media_id, said.pos, CASE WHEN gate.keys = said.keys THEN 'whisper_word' WHEN gate.whole = said.whole AND NOT gap THEN 'whisper_reconciled' ELSE 'segment_interpolation' END AS timing_source FROM said LEFT JOIN gate ON said.media_id = gate.media_id AND said.pos = gate.pos),
met AS (SELECT t.media_id, t.pos, t.token, arg_min(g.a, g.i) AS a, arg_max(g.b, g.i) AS b, avg(g.p) AS p FROM tkp t JOIN tier r ON t.media_id = r.media_id AND t.pos = r.pos JOIN good g ON g.media_id = t.media_id AND g.pos = t.pos
  AND CASE WHEN r.timing_source = 'whisper_word' THEN g.i = t.token WHEN r.timing_source = 'whisper_reconciled' THEN g.hi > t.lo AND g.lo < t.hi ELSE false END GROUP BY 1, 2, 3),
timed AS (SELECT t.media_id, t.pos, t.token, t.text, r.timing_source, coalesce(m.a::DOUBLE, (s / 1000.0::DOUBLE + len * (t.token - 1) / n) * 1000) AS x, coalesce(m.b::DOUBLE, (s / 1000.0::DOUBLE + len * t.token / n) * 1000) AS y, m.p
  FROM tkp t JOIN tier r ON t.media_id = r.media_id AND t.pos = r.pos LEFT JOIN met m ON m.media_id = t.media_id AND m.pos = t.pos AND m.token = t.token)
"""


@query(_TIMED + "SELECT media_id, printf('s%06d:t%04d', pos, token - 1) AS source_id, text, timing_source, floor(x + 1e-3::DOUBLE)::BIGINT AS start_ms, floor(y + 1e-3::DOUBLE)::BIGINT AS end_ms, round_even(coalesce(p, -1) * 1e4::DOUBLE, 0)::BIGINT AS probability_e4 FROM timed")
def word_timing(spark, d):
    ms = lambda n: F.floor(F.col(n) * 1000 + 1e-3).cast("bigint").alias(f"{n}_ms")
    return K.timed_tokens(_timed(spark, d)).select("media_id", "source_id", "text", "timing_source", ms("start"), ms("end"), F.bround(F.coalesce("probability", F.lit(-1.0)) * 1e4).cast("bigint").alias("probability_e4"))


@query(_TIMED + "SELECT media_id, timing_source, count(*) AS n FROM timed GROUP BY media_id, timing_source")
def timing_sources(spark, d):
    return K.timing_counts(K.timed_tokens(_timed(spark, d)))


@query(_SEG + r"SELECT media_id, regexp_replace(string_agg(t, ' ' ORDER BY s, e, pos), ' +([,.;:!?])', '\1', 'g') AS text FROM ok GROUP BY media_id")
def lossless_text(spark, d):
    return K.lossless_text(_segments(spark, d))


@query(_CHUNKS + "SELECT media_id, chunk_id, count(*) AS n_tokens, bool_and(true) AS same FROM part JOIN tk ON tk.media_id = part.media_id AND tk.pos = part.pos JOIN ch USING (media_id, k) GROUP BY media_id, chunk_id".replace("SELECT media_id, chunk_id, count", "SELECT ch.media_id, ch.chunk_id, count").replace("GROUP BY media_id, chunk_id", "GROUP BY ch.media_id, ch.chunk_id").replace("JOIN ch USING (media_id, k)", "JOIN ch ON ch.media_id = part.media_id AND ch.k = part.k"))
def chunk_token_check(spark, d):
    """Chunks have the tokens of their segments: the line is split anew and compared."""
    c = U.correction_chunks(_segments(spark, d))
    again = K.token_spans(F.col("text"))
    return c.select("media_id", "chunk_id", F.size("tokens").cast("bigint").alias("n_tokens"), (F.transform(again, lambda t: t["text"]) == F.transform("tokens", lambda t: t["text"])).alias("same"))


@query(_SPANS("keep") + ", w AS (SELECT media_id, max(duration) AS duration FROM rem GROUP BY media_id) SELECT spans.media_id, count(*) = 1 AND min(a) <= 1e-4::DOUBLE AND max(b) >= max(duration) - 1e-3::DOUBLE AS uncut FROM spans JOIN w ON spans.media_id = w.media_id GROUP BY spans.media_id")
def uncut_media(spark, d):
    silences = _silences(spark, d)
    return E.uncut(E.coalesced(E.edit_list(silences), "keep"), silences.select("media_id", "duration").distinct())


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '[A-Za-z]') AS latin, regexp_matches(coalesce(text, ''), '[㐀-鿿]') AS chinese FROM documents")
def scripts(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", Y.has_latin(t).alias("latin"), Y.has_chinese(t).alias("chinese"))


@query(_TARGETS + "SELECT doc_id, least(65536, greatest(context, ceil((2 * output + 4096) / 2048.0::DOUBLE)::BIGINT * 2048))::BIGINT AS context FROM x WHERE context IS NOT NULL")
def shared_contexts(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("words"), (F.col("n_chars") % 13).alias("wins"))
    t = w.withColumns(T.summary_targets(F.col("words"), F.col("wins"))).withColumn("output", T.output_budget(F.col("words_max")))
    t = t.withColumn("context", T.stage_context(T.prompt_tokens_of(F.col("words")), F.col("output"))).where("context IS NOT NULL")
    return t.select("doc_id", Y.shared_context(F.col("context"), F.col("output")).alias("context"))


@query("SELECT l_orderkey, l_linenumber, abs(l_quantity - l_tax * 100) <= 1.0::DOUBLE AS same, greatest(5368709120, ceil(l_extendedprice * 1e6::DOUBLE * CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 2 END + 32000 * l_quantity))::BIGINT AS disk_bytes FROM lineitem")
def job_gates(spark, d):
    """The gate on durations and the disk needed, over prices as sizes and quantities as seconds."""
    l = table(spark, d, "lineitem")
    return l.select("l_orderkey", "l_linenumber", J.same_length(F.col("l_quantity"), F.col("l_tax") * 100).alias("same"), J.disk_needed(F.col("l_extendedprice") * 1e6, F.col("l_quantity"), F.col("l_linenumber") % 2 == 0).alias("disk_bytes"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN NULL ELSE trunc(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice / 4 END)::BIGINT END AS total FROM orders""")
def optional_sums(spark, d):
    o = table(spark, d, "orders")
    part = lambda k, x: F.when(F.col("o_orderkey") % k != 0, x)
    return o.select("o_orderkey", Y.optional_sum(part(3, F.col("o_totalprice")), part(5, F.col("o_totalprice") / 4)).alias("total"))


def _mined(spark, d):
    # all are read several times
    chunks = U.correction_chunks(_segments(spark, d), packed=True).persist(StorageLevel.DISK_ONLY)
    return chunks, M.candidates(M.term_occurrences(chunks).persist(StorageLevel.DISK_ONLY)).persist(StorageLevel.DISK_ONLY)


@query()
def term_candidates(spark, d):
    return _mined(spark, d)[1]


_OCCURRENCES = SQL["term_counts"].rpartition("SELECT media_id, form, count(*)")[0]


@query()
def term_contexts(spark, d):
    return M.term_contexts(M.term_occurrences(U.correction_chunks(_segments(spark, d))))


def _verdicts(spark, d):
    chunks, mined = _mined(spark, d)
    return chunks, C.judged(C.proposals(responses_of_candidates(mined, chunks)), chunks, mined).persist(StorageLevel.DISK_ONLY)


@query()
def rule_verdicts(spark, d):
    return _verdicts(spark, d)[1]


@query()
def rule_rejections(spark, d):
    return C.rejections(_verdicts(spark, d)[1])


def _corrected(spark, d):
    chunks, verdicts = _verdicts(spark, d)
    rules = C.accepted_rules(verdicts)
    return rules, C.apply_rules(chunks, rules)


@query()
def corrected_chunks(spark, d):
    return _corrected(spark, d)[1].select("media_id", "chunk_id", "source_text", "text", F.size("occurrences").alias("n_occurrences"), F.size("conflicts").alias("n_conflicts"))


@query()
def rule_applications(spark, d):
    return C.rule_applications(_corrected(spark, d)[1])


@query()
def display_words(spark, d):
    return C.display_words(_corrected(spark, d)[1]).select("media_id", "chunk_id", "first", F.size("source_ids").alias("n_tokens"), *us("start", "end"), "text", "source_text", "timing_source", F.array_join("correction_ids", ",").alias("correction_ids"))


@query()
def delivery_audit(spark, d):
    rules, corrected = _corrected(spark, d)
    # read three times; the words are made again from what they take
    corrected = corrected.select("media_id", "chunk_id", "source_text", "occurrences", "parts").persist(StorageLevel.DISK_ONLY)
    display = C.display_words(corrected)
    return C.delivery_audit(corrected, display, U.build_cues(C.words_of_display(display)), rules)


_REPLIES = r"""
WITH t AS (SELECT doc_id AS k, regexp_replace(text, '[^A-Za-z0-9 .,]', ' ', 'g') AS x FROM documents),
p AS (SELECT *, CASE WHEN k % 7 = 0 THEN 7 WHEN k % 7 = 1 THEN 25 ELSE 8 + k % 5 END AS n FROM t),
r AS (SELECT k, n, CASE WHEN k % 13 = 6 THEN ' ' WHEN k % 13 = 7 THEN '一二三' ELSE 'Recording ' || k END AS title, list_transform(range(1, n + 1), lambda i: 'Part ' || i || ': ' || substr(x, 1, 900)) AS en,
  CASE WHEN k % 5 = 2 THEN n + 1 ELSE n END AS m, k % 11 = 5 AS partial, k % 17 = 8 AS broken, k % 17 = 9 AS short FROM p),
c AS (SELECT *, list_transform(range(1, m + 1), lambda i: CASE WHEN k % 5 = 3 AND i = 2 THEN 'Teil ' ELSE '段落' END || i) AS zh, list_sum(list_transform(en, lambda e: len(regexp_extract_all(e, '\b[A-Za-z0-9][A-Za-z0-9_./+#''-]*\b')))) AS words FROM r),
v AS (SELECT *, CASE WHEN broken THEN 'malformed_json' WHEN short THEN 'wrong_fields' WHEN partial THEN 'not_complete' WHEN title = ' ' THEN 'blank_title' WHEN n < 8 OR n > 24 THEN 'paragraph_count' WHEN title = '一二三' THEN 'not_latin' WHEN words < 1000 THEN 'too_few_words' END AS reason,
  CASE WHEN partial THEN 'not_complete' WHEN m <> n THEN 'paragraph_count' WHEN k % 5 = 3 THEN 'not_chinese' END AS other FROM c),
g AS (SELECT k, title, en, zh, n, words, 'Kn' AS model FROM v WHERE reason IS NULL AND other IS NULL)
"""


def _replies(spark, d):
    r = summary_responses(table(spark, d, "documents").where("text IS NOT NULL"))
    # kept, as filters on reasons would otherwise be computed below, with all that they read
    english = Y.english_contract(r.select("media_id", F.col("english").alias("response"))).persist(StorageLevel.DISK_ONLY)
    return english, Y.translation_contract(r.select("media_id", F.col("translation").alias("response"), "paragraph_count")).persist(StorageLevel.DISK_ONLY)


@query(_REPLIES + "SELECT k AS media_id, coalesce(reason, 'holds') AS english, coalesce(other, 'holds') AS translation FROM v")
def summary_contracts(spark, d):
    english, translation = _replies(spark, d)
    named = lambda rows, name: rows.select("media_id", F.coalesce("reason", F.lit("holds")).alias(name))
    return named(english, "english").join(named(translation, "translation"), "media_id")


@query(_REPLIES + "SELECT k AS media_id, unnest(range(0, n))::INT AS place, unnest(en) AS en, unnest(zh) AS zh_tw FROM g")
def summary_pairs(spark, d):
    return Y.paragraph_pairs(Y.combined(*_replies(spark, d)))


@query(_REPLIES + ", a AS (SELECT *, least(2200, greatest(1200, ceil(0.20::DOUBLE * words / 100)::BIGINT * 100)) AS wmin FROM g), b AS (SELECT *, least(2600, greatest(wmin + 400, ceil(0.27::DOUBLE * words / 100)::BIGINT * 100)) AS wmax, greatest(10, least(18, greatest(n + 2, round_even(wmin / 120.0::DOUBLE, 0)::BIGINT))) AS gmin FROM a) SELECT k AS media_id, n::BIGINT AS overview_count, words::BIGINT AS english_visible_word_count, 'good' AS reason, words BETWEEN wmin AND wmax AS summary_length_target_met, n BETWEEN gmin AND greatest(gmin + 4, least(22, ceil(wmax / 100.0::DOUBLE)::BIGINT)) AS summary_paragraph_target_met FROM b")
def summary_quality(spark, d):
    q = Y.quality(Y.combined(*_replies(spark, d)))
    t = Y.targets_met(q.withColumns(T.summary_targets(F.col("english_visible_word_count"), F.col("overview_count"))))
    return t.select("media_id", "overview_count", "english_visible_word_count", F.coalesce("reason", F.lit("good")).alias("reason"), "summary_length_target_met", "summary_paragraph_target_met")


def _markdown_sql(heading: str, source: str, model: str, title: str, paragraphs: str) -> str:
    return _REPLIES + rf"SELECT k AS media_id, regexp_replace('# ' || {title} || chr(10) || chr(10) || '_{source}: ' || k || ' · {model}: ' || model || '_' || chr(10) || chr(10) || '{heading}' || chr(10) || chr(10) || array_to_string({paragraphs}, chr(10) || chr(10)), '\s+$', '') || chr(10) AS markdown FROM g"


@query(_markdown_sql(*Y.LABELS["en"], "title", "en"))
def summary_markdown_en(spark, d):
    return Y.summary_markdown(Y.combined(*_replies(spark, d)), "en", F.col("media_id").cast("string"), F.lit("Kn"))


@query(_markdown_sql(*Y.LABELS["zh_tw"], "'錄影' || k", "zh"))
def summary_markdown_zh(spark, d):
    return Y.summary_markdown(Y.combined(*_replies(spark, d)), "zh_tw", F.col("media_id").cast("string"), F.lit("Kn"))


@query("""SELECT event_id AS job_id, CASE WHEN event_id % 6 = 0 OR event_id % 9 = 0 THEN 'run' WHEN event_id % 7 = 0 THEN 'error_other_source' WHEN st = (CASE WHEN event_id % 4 = 1 THEN 'planned' ELSE 'complete' END)
  THEN CASE WHEN event_id % 4 = 2 AND event_id % 10 <> 0 THEN 'error_no_subtitles' ELSE 'cached' END ELSE 'error_' || st END AS outcome FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'planned' WHEN 1 THEN 'complete' ELSE 'failed' END AS st FROM events)""")
def job_lookup(spark, d):
    """Requests against manifests, both made from events; the manifests are read from JSON."""
    e, k = table(spark, d, "events"), F.col("event_id")
    requests = e.select(k.alias("job_id"), F.sha2(k.cast("string"), 256).alias("fingerprint"), (k % 4 == 1).alias("plan_only"), (k % 4 == 2).alias("subtitles"), (k % 9 == 0).alias("force"))
    status = F.when(k % 3 == 0, "planned").when(k % 3 == 1, "complete").otherwise("failed")
    source = F.struct(F.when(k % 7 == 0, "other").otherwise(F.sha2(k.cast("string"), 256)).alias("fingerprint"))
    stages, outputs = F.create_map(F.lit("subtitles"), F.struct(F.lit("complete").alias("state"))), F.when(k % 10 == 0, F.create_map(F.lit("subtitled"), F.lit("subtitled.mp4")))
    written = e.where(k % 6 != 0).select(k.alias("job_id"), F.to_json(F.struct(source.alias("source"), status.alias("status"), stages.alias("stages"), outputs.alias("outputs"))).alias("document"))
    return J.lookup(requests, D.manifests(written)).select("job_id", "outcome")


@query("""WITH l AS (SELECT user_id, event_type, arg_max(event_id, ts) AS id, max(ts) AS seen FROM events GROUP BY user_id, event_type),
s AS (SELECT user_id, CASE WHEN event_type = t THEN 'job' ELSE event_type END AS stage, CASE id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'complete' ELSE 'failed' END AS state, seen FROM l, (SELECT min(event_type) AS t FROM events)),
f AS (SELECT *, max(seen) FILTER (stage = 'job' AND state = 'failed') OVER (PARTITION BY user_id) AS broke FROM s)
SELECT user_id AS media_id, stage, CASE WHEN broke IS NOT NULL AND state = 'running' THEN 'failed' ELSE state END AS state, epoch_us(CASE WHEN broke IS NOT NULL AND state = 'running' THEN broke ELSE seen END) AS updated_us FROM f""")
def stage_states(spark, d):
    e = table(spark, d, "events")
    least = e.agg(F.min("event_type").alias("least"))  # one row
    state = F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "complete").otherwise("failed")
    rows = e.join(F.broadcast(least)).select(F.col("user_id").alias("media_id"), F.when(F.col("event_type") == F.col("least"), "job").otherwise(F.col("event_type")).alias("stage"), state.alias("state"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return J.stage_states(rows).withColumnRenamed("updated_at", "updated_us")


@query(_SEG + "SELECT media_id, pos::INT AS pos, (row_number() OVER (PARTITION BY media_id ORDER BY pos) - 1)::INT AS id, s AS start_ms, e AS end_ms, t AS text FROM ok")
def transcript_scan(spark, d):
    """Transcripts as JSON, read back, without blank segments and with dense ids."""
    s = _timed(spark, d)
    whole = s.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("pos").alias("id"), "start", "end", "text", "words").alias("s")))).alias("x"))
    documents = whole.select("media_id", F.to_json(F.struct(F.transform("x", lambda x: x["s"]).alias("segments"))).alias("document"))
    r = D.recognised(D.transcript_segments(documents))
    return r.select("media_id", "pos", "id", T.millis(F.col("start")).alias("start_ms"), T.millis(F.col("end")).alias("end_ms"), T.normalized(F.col("text")).alias("text"))


@query(_PLAN + f""", x AS (SELECT *, {_US('a')} AS a_us, {_US('b')} AS b_us FROM edits)
SELECT media_id, '{{"kept_us":' || coalesce(sum(b_us - a_us) FILTER (action = 'keep'), 0)::BIGINT || ',"removed_us":' || coalesce(sum(b_us - a_us) FILTER (action = 'remove'), 0)::BIGINT || ',"edits":[' ||
string_agg('{{"start_us":' || a_us || ',"end_us":' || b_us || ',"action":"' || action || '","reason":"' || reason || '"' || coalesce(',"silence_index":' || idx, '') || '}}', ',' ORDER BY a_us, b_us) || ']}}' AS json FROM x GROUP BY media_id""")
def plan_documents(spark, d):
    return sinks.plan_json(_edits(spark, d))


@query()
def correction_documents(spark, d):
    """What corrections did, and the rules behind it, as JSON."""
    chunks, verdicts = _verdicts(spark, d)
    return sinks.corrections_json(C.apply_rules(chunks, C.accepted_rules(verdicts))).join(sinks.rules_json(verdicts).withColumnRenamed("json", "rules"), "media_id", "left")
