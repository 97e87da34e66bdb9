"""Queries of text functions, alignment and scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align as A
from . import fixtures as X

CAST = ("user", "assistant")
MAIN = ("user",)


def matches(spark, d):
    return A.align(X.lines(spark, d), X.preds(spark, d))


def judged(spark, d):
    return A.judged(matches(spark, d)[0], CAST)


_KEY = r"regexp_replace(replace(text, '\N', ''), '[\s\x{00A0}\x{3000}]+', '', 'g')"
MATCH = rf"""g AS (SELECT *, {_KEY} AS key FROM lines),
p AS (SELECT *, {_KEY} AS key FROM preds),
sole AS (SELECT media_id, start_ms, end_ms, key, max(pid) AS pid FROM p GROUP BY ALL HAVING count(*) = 1),
fst AS (SELECT media_id, start_ms, end_ms, key, min(idx) AS idx FROM g GROUP BY ALL),
exact AS (SELECT media_id, idx, pid, 'exact_timestamp_text' AS method FROM fst JOIN sole USING (media_id, start_ms, end_ms, key)),
g2 AS (SELECT * FROM g WHERE (media_id, idx) NOT IN (SELECT (media_id, idx) FROM exact)),
p2 AS (SELECT * FROM p WHERE (media_id, pid) NOT IN (SELECT (media_id, pid) FROM exact)),
uniq AS (SELECT a.media_id, a.idx, b.pid, 'unique_text_time_overlap' AS method FROM
  (SELECT * FROM g2 QUALIFY count(*) OVER (PARTITION BY media_id, key) = 1) a JOIN (SELECT * FROM p2 QUALIFY count(*) OVER (PARTITION BY media_id, key) = 1) b
  ON a.media_id = b.media_id AND a.key = b.key AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms),
g3 AS (SELECT * FROM g2 WHERE (media_id, idx) NOT IN (SELECT (media_id, idx) FROM uniq)),
cand AS (SELECT a.media_id, a.idx, b.pid, (least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) / greatest(1, least(a.end_ms - a.start_ms, b.end_ms - b.start_ms)) AS ratio,
         abs(a.start_ms + a.end_ms - b.start_ms - b.end_ms) AS apart, abs(length(a.key) - length(b.key)) AS len
  FROM g3 a JOIN p b ON a.media_id = b.media_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms
   AND (a.key = b.key OR (b.key <> '' AND contains(a.key, b.key)) OR (a.key <> '' AND contains(b.key, a.key)))),
struc AS (SELECT media_id, idx, pid, 'structural_text_containment_overlap' AS method FROM cand QUALIFY row_number() OVER (PARTITION BY media_id, idx ORDER BY ratio DESC, apart, len, pid) = 1),
fnd AS (SELECT * FROM exact UNION ALL SELECT * FROM uniq UNION ALL SELECT * FROM struc),
m AS (SELECT l.media_id, l.idx, l.start_ms, l.end_ms, l.speaker, l.text, fnd.pid, coalesce(fnd.method, 'unmatched') AS method, preds.speaker AS pred_speaker, preds.confidence
  FROM lines l LEFT JOIN fnd ON fnd.media_id = l.media_id AND fnd.idx = l.idx LEFT JOIN preds ON preds.media_id = fnd.media_id AND preds.pid = fnd.pid),
j AS (SELECT *, {_KEY} AS key, CASE WHEN starts_with(speaker, 'NONSPEECH') THEN 'NONSPEECH' WHEN speaker IN ('user', 'assistant') THEN speaker ELSE 'OTHER' END AS target,
        CASE WHEN starts_with(speaker, 'NONSPEECH') THEN 'nonspeech' WHEN speaker IN ('user', 'assistant') THEN 'canonical' ELSE 'other' END AS kind, coalesce(pred_speaker, 'UNMATCHED') AS predicted FROM m),
jj AS (SELECT *, predicted = target AS ok FROM j)"""
_ALL = (X.LINES, X.PREDS, MATCH)


def _score(body):
    return X.query(*_ALL) + "\n" + body


def j6(spark, d):
    return matches(spark, d)[0].select("media_id", "idx", "pid", "method", "pred_speaker", "confidence")


def j12(spark, d):
    return matches(spark, d)[1].select("media_id", "pid", "speaker")


def a9(spark, d):
    return A.slices(judged(spark, d), MAIN)


def _slice(name, on):
    return f"SELECT '{name}' AS slice, count(*) FILTER (WHERE ({on}) AND ok) AS correct, count(*) FILTER (WHERE {on}) AS total, CASE WHEN count(*) FILTER (WHERE {on}) > 0 THEN count(*) FILTER (WHERE ({on}) AND ok) / count(*) FILTER (WHERE {on}) END AS accuracy FROM jj"


_CRY = r"regexp_matches(key, '^[ぁ-んァ-ンーっッ~～…\.・!！?？、, ]{1,12}$') OR (length(key) <= 5 AND NOT regexp_matches(key, '[一-龯A-Za-z0-9]'))"
A9 = _score("\nUNION ALL ".join([_slice("overall", "TRUE"), _slice("canonical", "kind = 'canonical'"), _slice("main", "target = 'user'"), _slice("other", "kind = 'other'"), _slice("nonspeech", "kind = 'nonspeech'"), _slice("combination", "FALSE"), _slice("short", "length(key) <= 5"), _slice("interjection", _CRY)]))


def a10(spark, d):
    return A.per_speaker(judged(spark, d), CAST)


A10 = _score("""SELECT label, support, tp, fp, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN support > 0 THEN tp / support END AS recall
FROM (SELECT label, count(*) FILTER (WHERE target = label) AS support, count(*) FILTER (WHERE target = label AND ok) AS tp, count(*) FILTER (WHERE NOT (target = label AND ok) AND predicted = label AND target <> label) AS fp
      FROM jj, (VALUES ('user'), ('assistant'), ('OTHER'), ('NONSPEECH')) v(label) GROUP BY label)""")


def a11(spark, d):
    return A.calibration(judged(spark, d))


A11 = _score("""SELECT confidence, n, correct, nominal, correct / n AS accuracy, n * abs(correct / n - nominal) / known AS ece_part, (correct * (nominal - 1) ** 2 + (n - correct) * nominal ** 2) / known AS brier_part
FROM (SELECT *, sum(CASE WHEN nominal IS NOT NULL THEN n END) OVER () AS known FROM
  (SELECT confidence, count(*) AS n, count(*) FILTER (WHERE ok) AS correct, CASE confidence WHEN 'high' THEN CAST(0.9 AS DOUBLE) WHEN 'mid' THEN CAST(0.6 AS DOUBLE) WHEN 'low' THEN CAST(0.3 AS DOUBLE) END AS nominal FROM jj WHERE pid IS NOT NULL GROUP BY confidence))""")


def a12(spark, d):
    return A.alignment_summary(*matches(spark, d))


A12 = _score("""SELECT method, count(*) AS n FROM m GROUP BY method
UNION ALL SELECT 'unmatched_predictions', count(*) FROM preds WHERE (media_id, pid) NOT IN (SELECT (media_id, pid) FROM fnd)
UNION ALL SELECT 'used_predictions', count(DISTINCT (media_id, pid)) FROM fnd""")


def a13(spark, d):
    return A.confusion(judged(spark, d))


def a13_swaps(spark, d):
    return A.swaps(judged(spark, d), [("user", "assistant"), ("assistant", "OTHER")])


def t4(spark, d):
    j = judged(spark, d)
    e = A.error_sample(j, F.when(F.col("predicted") == "UNMATCHED", "missing").otherwise(F.col("target")), ["missing", "user", "OTHER", "assistant"], 40)
    return e.select("media_id", "idx", "bucket", "target", "predicted")


T4 = _score("""SELECT media_id, idx, bucket, target, predicted FROM (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY media_id, idx) AS turn, list_position(['missing', 'user', 'OTHER', 'assistant'], bucket) AS bo
  FROM (SELECT *, CASE WHEN predicted = 'UNMATCHED' THEN 'missing' ELSE target END AS bucket FROM jj WHERE NOT ok)) WHERE bo > 0 ORDER BY turn, bo LIMIT 40""")


def j15(spark, d):
    """Predictions' inputs by pid: unknown, a cast name, another, blank, nonspeech; every third is tagged and so not locked."""
    said = F.element_at(F.array(*map(F.lit, ("?", "user", "system", "", "NONSPEECH"))), (F.col("pid") % 5 + 1).cast("int"))
    preds = X.preds(spark, d).withColumns({"input_speaker": said, "tags": F.when(F.col("pid") % 3 == 0, F.array(F.lit("MULTI"))).otherwise(F.array().cast("array<string>"))})
    found = A.align(X.lines(spark, d), preds)[0]
    final = A.judged(found.withColumn("pred_speaker", F.when(F.col("idx") % 3 == 0, F.col("speaker")).otherwise(F.col("pred_speaker"))), CAST)
    return A.compare_policies(A.judged(found, CAST), final, CAST)


J15 = _score("""SELECT count(*) AS total, count(*) FILTER (WHERE predicted <> q) AS changed, count(*) FILTER (WHERE NOT ok AND q = target) AS fixed, count(*) FILTER (WHERE ok AND q <> target) AS broken,
  count(*) FILTER (WHERE k = target) AS locked_correct, count(*) FILTER (WHERE k <> predicted) AS locked_changed, count(*) FILTER (WHERE k <> predicted AND NOT ok AND k = target) AS locked_fixed, count(*) FILTER (WHERE k <> predicted AND ok AND k <> target) AS locked_broken
FROM (SELECT *, CASE WHEN idx % 3 = 0 THEN speaker ELSE predicted END AS q, CASE WHEN pid % 3 <> 0 AND pid % 5 = 1 THEN 'user' WHEN pid % 3 <> 0 AND pid % 5 = 2 THEN 'OTHER' ELSE predicted END AS k FROM jj)""")


def j16(spark, d):
    tagged = lambda df, on: df.withColumn("tags", F.when(on, F.array(F.lit("MULTI"))).otherwise(F.array().cast("array<string>")))
    a = tagged(X.lines(spark, d), F.col("idx") % 4 == 0).withColumn("source_entries", F.array("idx"))
    b = X.preds(spark, d).withColumnRenamed("pid", "idx")
    b = tagged(b, (F.col("idx") % 4 == 0) & (F.col("idx") % 12 != 0)).withColumn("source_entries", F.array(F.when(F.col("idx") % 11 == 0, 0).otherwise(F.col("idx"))))
    return A.diff_cues(a, b, source=True)


J16 = X.query(X.LINES, X.PREDS + """
SELECT * FROM (SELECT coalesce(x.media_id, y.media_id) AS media_id, coalesce(x.idx, y.pid) AS idx,
       CASE WHEN y.pid IS NULL THEN 'only in first' WHEN x.idx IS NULL THEN 'only in second' WHEN x.start_ms <> y.start_ms OR x.end_ms <> y.end_ms THEN 'time' WHEN x.speaker IS DISTINCT FROM y.speaker THEN 'speaker'
            WHEN x.idx % 12 = 0 THEN 'tags' WHEN x.text <> y.text THEN 'text' WHEN x.idx % 11 = 0 THEN 'source' END AS difference
FROM lines x FULL OUTER JOIN preds y ON x.media_id = y.media_id AND x.idx = y.pid) WHERE difference IS NOT NULL""")


def samples(spark, d):
    """Clusters over embeddings: the label is gold, a coarse function of a coordinate the cluster; every fifth is long."""
    e = X.table(spark, d, "embeddings")
    cluster = F.when(F.col("vec_id") % 11 == 0, "UNKNOWN").otherwise(F.concat(F.lit("C"), ((F.col("label") + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0)) % 5).cast("string")))
    return e.select(F.when(F.col("vec_id") % 2 == 0, "one").otherwise("two").alias("method"), F.when(F.col("vec_id") % 5 == 0, "long").otherwise("short").alias("stage"), F.col("label").cast("string").alias("gold"), cluster.alias("predicted"))


def a17(spark, d):
    return A.score_clusters(samples(spark, d))[1]


def a17_clusters(spark, d):
    return A.score_clusters(samples(spark, d))[0]


def a17_gates(spark, d):
    metrics = A.score_clusters(samples(spark, d))[1]
    return A.gates(metrics, "one", "two", purity=0.2).unionByName(A.gates(metrics, "two", "one", accuracy=0.1))


A17 = """WITH s AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'one' ELSE 'two' END AS method, CASE WHEN vec_id % 5 = 0 THEN 'long' ELSE 'short' END AS stage, CAST(label AS VARCHAR) AS gold,
  CASE WHEN vec_id % 11 = 0 THEN 'UNKNOWN' ELSE 'C' || CAST((label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 5 AS VARCHAR) END AS predicted FROM embeddings),
b AS (SELECT method, predicted, gold AS mapped FROM (SELECT method, predicted, gold, count(*) AS n FROM s WHERE stage = 'long' AND predicted <> 'UNKNOWN' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY method, predicted ORDER BY n DESC, gold) = 1),
x AS (SELECT s.*, coalesce(b.mapped = s.gold, FALSE) AS ok FROM s LEFT JOIN b USING (method, predicted)),
c AS (SELECT method, count(*) FILTER (WHERE stage = 'long' AND ok) AS long_right, count(*) FILTER (WHERE stage = 'long') AS n_long, count(*) FILTER (WHERE stage = 'short' AND ok) AS short_right, count(*) FILTER (WHERE stage = 'short') AS n_short,
  count(*) FILTER (WHERE stage = 'short' AND predicted = 'UNKNOWN') AS short_unknown FROM x GROUP BY method)
SELECT *, CASE WHEN n_long > 0 THEN long_right / n_long END AS purity, CASE WHEN n_short > 0 THEN short_right / n_short END AS accuracy, CASE WHEN n_short > 0 THEN short_unknown / n_short END AS unknown_rate FROM c"""
A17C = A17.split(",\nb AS")[0] + """,
v AS (SELECT method, predicted AS cluster, gold, count(*) AS n FROM s WHERE stage = 'long' AND predicted <> 'UNKNOWN' GROUP BY ALL)
SELECT method, cluster, arg_min(gold, (-n, gold)) AS gold_speaker, sum(n) AS samples, max(n) / sum(n) AS purity FROM v GROUP BY method, cluster"""
A17G = f"""WITH m AS ({A17}), p AS (SELECT a.*, b.accuracy AS base, CASE a.method WHEN 'two' THEN 0.2 ELSE 0.95 END AS lp, CASE a.method WHEN 'two' THEN 0.85 ELSE 0.1 END AS la FROM m a JOIN m b ON a.method <> b.method)
SELECT *, long_purity AND short_accuracy AND short_unknown AND improvement AS passed FROM
 (SELECT method, accuracy - base AS short_accuracy_gain, purity >= lp AS long_purity, accuracy >= la AS short_accuracy, unknown_rate <= 0.30 AS short_unknown, accuracy - base >= 0.05 AS improvement FROM p)"""


def combined(spark, d):
    """Every seventh gold cue is said by two."""
    m = matches(spark, d)[0]
    return A.judged(m.withColumn("speaker", F.when(F.col("idx") % 7 == 0, "user&assistant").otherwise(F.col("speaker"))), CAST)


def a13_combinations(spark, d):
    return A.combination_detail(combined(spark, d))


def a13_predicted_on(spark, d):
    return A.predicted_on(judged(spark, d), [("user", "assistant"), ("system", "user"), ("nobody", "user")])


def p1(spark, d):
    c = X.cues(spark, d)
    srt, ass = T.srt_time(F.col("start_ms") - 500), T.ass_time(F.col("end_ms"))
    return c.select("media_id", "idx", srt.alias("srt"), T.srt_ms(srt).alias("srt_ms"), ass.alias("ass"), T.ass_ms(ass).alias("ass_ms"))


P1 = X.query(X.CUES, """t AS (SELECT media_id, idx, greatest(start_ms - 500, 0) AS s, CAST(round_even(end_ms / 10.0, 0) AS BIGINT) AS cs FROM cues)
SELECT media_id, idx, printf('%02d:%02d:%02d,%03d', s // 3600000, s // 60000 % 60, s // 1000 % 60, s % 1000) AS srt, s AS srt_ms,
       printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS ass, cs * 10 AS ass_ms FROM t""")


def p2(spark, d):
    s = X.styled(spark, d)
    return s.select("event_index", T.clean_text(F.col("text")).alias("clean"), *[v.alias(k) for k, v in T.ass_flags(F.col("text")).items()])


P2 = X.query(X.STYLED + rf"""
SELECT event_index, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(translate(regexp_replace(text, '\{{[^}}]*\}}', '', 'g'), chr(8206) || chr(8207) || chr(8234) || chr(8235) || chr(8236) || chr(8237) || chr(8238) || chr(65279), ''), '\h', ' '), '\\N|\n'), lambda x: {X.sql_strip('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^[~ \x{{3000}}]*[♪♫♬]')), '\N') AS clean,
       regexp_matches(text, '(?i)\\p(bo)?[1-9]') AS drawing, regexp_matches(text, '(?i)\\(pos|move)\(') AS positioned, regexp_matches(text, '(?i)\\k[fo]?[0-9]') AS karaoke, regexp_matches(text, '(?i)\\an[789]([^0-9]|$)') AS top
FROM styled""")


def p6(spark, d):
    return X.lines(spark, d).select("media_id", "idx", T.match_key(F.col("text")).alias("key"), T.short_text(T.match_key(F.col("text"))).alias("short"))


P6 = X.query(X.LINES + f"\nSELECT media_id, idx, {_KEY} AS key, length({_KEY}) <= 5 AS short FROM lines")


def p7(spark, d):
    e = X.cues(spark, d).withColumn("speaker", F.when(F.col("idx") % 5 == 0, F.concat_ws("&", "speaker", F.lit("view"))).otherwise(F.col("speaker")))
    target, accepted, kind = T.gold_target(F.col("speaker"), ("click", "view"))
    return e.select("media_id", "idx", target.alias("target"), F.array_join(F.array_sort(accepted), ",").alias("accepted"), kind.alias("kind"), T.prediction_label(F.col("speaker"), ("click", "view")).alias("label"))


P7 = X.query(X.CUES, """s AS (SELECT media_id, idx, CASE WHEN idx % 5 = 0 THEN speaker || '&view' ELSE speaker END AS speaker FROM cues)
SELECT media_id, idx, CASE WHEN kind = 'nonspeech' THEN 'NONSPEECH' WHEN kind = 'other' THEN 'OTHER' ELSE speaker END AS target,
  CASE kind WHEN 'nonspeech' THEN 'NONSPEECH' WHEN 'other' THEN 'OTHER' WHEN 'canonical' THEN speaker
   ELSE array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(speaker, '&'), lambda x: x IN ('click', 'view')), [speaker, array_to_string(list_reverse(string_split(speaker, '&')), '&')]))), ',') END AS accepted, kind,
  CASE WHEN kind = 'nonspeech' THEN 'NONSPEECH' WHEN kind IN ('canonical', 'combination') OR speaker IN ('?', 'OTHER') THEN speaker ELSE 'OTHER' END AS label
FROM (SELECT *, CASE WHEN starts_with(speaker, 'NONSPEECH') THEN 'nonspeech' WHEN speaker IN ('click', 'view') THEN 'canonical' WHEN contains(speaker, '&') THEN 'combination' ELSE 'other' END AS kind FROM s)""")


def p9(spark, d):
    c = X.cues(spark, d)
    return c.select("media_id", "idx", T.file_name(F.col("start_ms"), F.col("speaker"), F.col("text"), F.col("idx")).alias("name"))


# the speaker, at 30 characters, with runs of characters no file system takes as one _; the first sentence likewise, at 20
P9 = X.query(X.CUES, r"""t AS (SELECT *, CAST(round_even(start_ms / 10.0, 0) AS BIGINT) AS cs, regexp_replace(speaker, '[\\/:*?"<>|]+', '_', 'g') AS who FROM cues)
SELECT media_id, idx, CASE WHEN idx < 10000 THEN lpad(CAST(idx AS VARCHAR), 4, '0') ELSE CAST(idx AS VARCHAR) END || '_' || who || '_' || printf('%d-%02d-%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) || '_' ||
       CASE WHEN text = '' THEN '_' ELSE substring(replace(text, ' ', '_'), 1, 20) END AS name FROM t""")

QUERIES = {"j6_j7_j8_align": j6, "j12_unmatched": j12, "a9_accuracy_slices": a9, "a10_per_speaker": a10, "a11_calibration": a11, "a12_alignment_summary": a12, "a13_confusion": a13, "a13_swaps": a13_swaps, "t4_error_sample": t4, "j15_compare_policies": j15, "j16_diff_cues": j16, "a17_score_clusters": a17, "a17_clusters": a17_clusters, "a17_gates": a17_gates, "a13_combination_detail": a13_combinations, "a13_predicted_on": a13_predicted_on, "p1_time_codecs": p1, "p2_p13_clean_and_flags": p2, "p6_p8_match_key": p6, "p7_labels": p7, "p9_file_name": p9}
ORACLES = {
    "j6_j7_j8_align": _score("SELECT media_id, idx, pid, method, pred_speaker, confidence FROM m"),
    "j12_unmatched": _score("SELECT media_id, pid, speaker FROM preds WHERE (media_id, pid) NOT IN (SELECT (media_id, pid) FROM fnd)"),
    "a9_accuracy_slices": A9, "a10_per_speaker": A10, "a11_calibration": A11, "a12_alignment_summary": A12,
    "a13_confusion": _score("SELECT target, predicted, count(*) AS n FROM jj WHERE NOT ok GROUP BY ALL"),
    "a13_swaps": _score("SELECT a, b, count(*) FILTER (WHERE target = a AND predicted = b) AS a_as_b, count(*) FILTER (WHERE target = b AND predicted = a) AS b_as_a, count(*) FILTER (WHERE ok) AS correct, count(*) AS total FROM jj JOIN (VALUES ('user', 'assistant'), ('assistant', 'OTHER')) v(a, b) ON target IN (a, b) GROUP BY a, b"),
    "t4_error_sample": T4, "j15_compare_policies": J15, "j16_diff_cues": J16, "a17_score_clusters": A17, "a17_clusters": A17C, "a17_gates": A17G,
    "a13_combination_detail": _score("SELECT 'user&assistant' AS speaker, predicted, count(*) AS n FROM jj WHERE idx % 7 = 0 GROUP BY ALL"),
    "a13_predicted_on": _score("SELECT gold, label, count(*) FILTER (WHERE predicted = label) AS given, count(jj.idx) AS total FROM (VALUES ('user', 'assistant'), ('system', 'user'), ('nobody', 'user')) v(gold, label) LEFT JOIN jj ON jj.speaker = gold GROUP BY ALL"), "p1_time_codecs": P1, "p2_p13_clean_and_flags": P2, "p6_p8_match_key": P6, "p7_labels": P7, "p9_file_name": P9,
}
