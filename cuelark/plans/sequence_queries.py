"""Queries of scene, batch, label and profile operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import labels as L
from ..operators import profile as P
from ..operators import sequence as S
from . import fixtures as X
from . import interval_queries


def _lines(spark, d):
    return X.lines(spark, d).withColumn("tags", F.when(F.col("idx") % 4 == 0, F.array(F.lit("MULTI"))).otherwise(F.array().cast("array<string>")))


def cuts(spark, d):
    return X.lines(spark, d).where("idx % 3 = 0").select("media_id", F.col("idx").alias("after_idx"))


def _scenes(spark, d):
    return S.scenes_from_cuts(X.cues(spark, d), X.cues(spark, d).where("src % 4 = 0").select("media_id", F.col("idx").alias("after_idx")))


CUT_SCENES = X.CUES + """,
numbered AS (SELECT *, 1 + coalesce(sum(CASE WHEN src % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS scene_id FROM cues),
cs AS (SELECT media_id, scene_id, min(idx) AS start_idx, max(idx) AS end_idx, greatest(0, min(start_ms) - 1500) AS start_ms, max(end_ms) + 1500 AS end_ms, count(*) AS n_cues FROM numbered GROUP BY ALL)"""
_T = "tg AS (SELECT *, end_ms - start_ms > 20000 OR end_ms - start_ms < 5000 OR n_cues > 6 AS target FROM cs)"


def targets(spark, d):
    s = _scenes(spark, d)
    long = F.col("end_ms") - F.col("start_ms")
    return s.withColumn("target", (long > 20_000) | (long < 5_000) | (F.col("n_cues") > 6))


def f8(spark, d):
    s = _scenes(spark, d).withColumn("confirmed", F.col("scene_id") % 2 == 0)
    return S.refine_target(s, 30_000, 5_000, 8).select("media_id", "scene_id", "target")


F8 = X.query(CUT_SCENES + """
SELECT media_id, scene_id, end_ms - start_ms > 30000 OR n_cues > 8 OR end_ms - start_ms < 5000 OR n_cues = 1 OR (scene_id % 2 <> 0 AND scene_id <> max(scene_id) OVER (PARTITION BY media_id)) AS target FROM cs""")


def w9(spark, d):
    return S.refine_regions(targets(spark, d), 1, 20).select("media_id", "first_scene", "last_scene", "n_cues")


W9 = X.query(CUT_SCENES, _T, """kept AS (SELECT * FROM (SELECT *, max(CASE WHEN target THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY scene_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM tg) WHERE near = 1),
rg AS (SELECT *, scene_id - row_number() OVER (PARTITION BY media_id ORDER BY scene_id) AS region FROM kept),
o AS (SELECT *, row_number() OVER (PARTITION BY media_id, region ORDER BY scene_id) AS rn FROM rg),
walk AS (SELECT media_id, region, rn, scene_id, n_cues, n_cues AS n, CAST(0 AS BIGINT) AS part FROM o WHERE rn = 1
  UNION ALL SELECT o.media_id, o.region, o.rn, o.scene_id, o.n_cues, CASE WHEN w.n + o.n_cues > 20 THEN o.n_cues ELSE w.n + o.n_cues END, CASE WHEN w.n + o.n_cues > 20 THEN w.part + 1 ELSE w.part END
  FROM walk w JOIN o ON o.media_id = w.media_id AND o.region = w.region AND o.rn = w.rn + 1)
SELECT media_id, min(scene_id) AS first_scene, max(scene_id) AS last_scene, sum(n_cues) AS n_cues FROM walk GROUP BY media_id, region, part""")


def w10(spark, d):
    return S.chunk(X.cues(spark, d), 80).groupBy("media_id", "batch_id").agg(F.count("*").alias("n"), F.min("idx").alias("first"))


def w11(spark, d):
    return S.budget_groups(_scenes(spark, d), 60_000, 20, 3).groupBy("media_id", "group_id").agg(F.min("scene_id").alias("first_scene"), F.count("*").alias("n_scenes"), F.sum("n_cues").alias("n_cues"))


_OVER = "(w.n + 1 > 3 OR w.c + o.n_cues > 20 OR w.ms + o.end_ms - o.start_ms > 60000)"
W11 = X.query(CUT_SCENES, "o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY scene_id) AS rn FROM cs)", f"""walk AS (SELECT media_id, rn, scene_id, n_cues, CAST(1 AS BIGINT) AS n, n_cues AS c, end_ms - start_ms AS ms, 0 AS group_id FROM o WHERE rn = 1
  UNION ALL SELECT o.media_id, o.rn, o.scene_id, o.n_cues, CASE WHEN {_OVER} THEN 1 ELSE w.n + 1 END, CASE WHEN {_OVER} THEN o.n_cues ELSE w.c + o.n_cues END,
   CASE WHEN {_OVER} THEN o.end_ms - o.start_ms ELSE w.ms + o.end_ms - o.start_ms END, CASE WHEN {_OVER} THEN w.group_id + 1 ELSE w.group_id END FROM walk w JOIN o ON o.media_id = w.media_id AND o.rn = w.rn + 1)
SELECT media_id, group_id, min(scene_id) AS first_scene, count(*) AS n_scenes, sum(n_cues) AS n_cues FROM walk GROUP BY ALL""")


def sparse(spark, d):
    t = X.cues(spark, d).where("src % 29 = 0 OR src % 31 < 2").select("media_id", F.col("idx").alias("pos"))
    return S.chunk(t, 20, "pos")


def w12(spark, d):
    return S.split_sparse(sparse(spark, d), 5, 100).select("media_id", "batch_id", "pos", F.col("sub_batch").cast("long").alias("sub_batch"))


W12 = X.query(X.CUES, "t AS (SELECT media_id, idx AS pos, CAST(floor((row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1) / 20) AS INTEGER) AS batch_id FROM cues WHERE src % 29 = 0 OR src % 31 < 2)", """u AS (SELECT *, CASE WHEN max(pos) OVER b - min(pos) OVER b + 11 > 100 AND pos - lag(pos) OVER (b ORDER BY pos) > 10 THEN 1 ELSE 0 END AS cut FROM t WINDOW b AS (PARTITION BY media_id, batch_id))
SELECT media_id, batch_id, pos, CAST(sum(cut) OVER (PARTITION BY media_id, batch_id ORDER BY pos) AS BIGINT) AS sub_batch FROM u""")


def w13(spark, d):
    x = _lines(spark, d)
    return S.context(x, x.where("idx % 5 = 0"), 2)


W13 = X.query(X.LINES + "\nSELECT t.media_id, t.idx AS target_idx, c.idx, c.idx = t.idx AS is_target FROM lines t JOIN lines c ON c.media_id = t.media_id AND c.idx BETWEEN t.idx - 2 AND t.idx + 2 WHERE t.idx % 5 = 0")


def w14(spark, d):
    rows = S.chunk(X.lines(spark, d), 64).select("media_id", "batch_id", "idx", F.char_length("text").alias("n_chars"))
    out, _ = S.bisect_batches(rows, 600, overhead=50)
    return out.groupBy("media_id", "batch_id", "piece").agg(F.min("idx").alias("first"), F.count("*").alias("n"), F.sum("n_chars").alias("n_chars")).select("media_id", "batch_id", "first", "n", "n_chars")


_FITS = "(len(l) = 1 OR list_sum(list_transform(l, lambda x: x.n)) + len(l) - 1 + 50 <= 600)"
W14 = X.query(X.LINES, f"""h AS (SELECT media_id, (idx - 1) // 64 AS batch_id, list({{'i': idx, 'n': length(text)}} ORDER BY idx) AS l FROM lines GROUP BY ALL
  UNION ALL SELECT media_id, batch_id, unnest([l[1:len(l) // 2], l[len(l) // 2 + 1:]]) AS l FROM h WHERE NOT {_FITS})
SELECT media_id, CAST(batch_id AS INTEGER) AS batch_id, l[1].i AS first, len(l) AS n, list_sum(list_transform(l, lambda x: x.n)) AS n_chars FROM h WHERE {_FITS}""")


def w14_context(spark, d):
    """Candidates for a cut, marked by four characters; the prompt has two lines before, three after and all between."""
    x = X.lines(spark, d).withColumn("n_chars", F.char_length("text"))
    rows = S.chunk(x.where("idx % 3 <> 0"), 32).select("media_id", "batch_id", "idx", (F.col("n_chars") + 4).alias("n_chars"))
    out, _ = S.bisect_batches(rows, 900, 70, 1, x, 2)
    return out.groupBy("media_id", "batch_id", "piece").agg(F.min("idx").alias("first"), F.count("*").alias("n"), F.max("prompt_chars").alias("prompt_chars")).select("media_id", "batch_id", "first", "n", "prompt_chars")


# each piece is rendered: the lengths of the lines that its window shows are added up anew
_SHOWN = "70 - 1 + 4 * len(l) + (SELECT sum(length(text) + 1) FROM lines x WHERE x.media_id = h.media_id AND x.idx BETWEEN l[1] - 2 AND l[len(l)] + 3)"
W14C = X.query(X.LINES, """b AS (SELECT media_id, idx, (row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1) // 32 AS batch_id FROM lines WHERE idx % 3 <> 0)""", f"""h AS (SELECT media_id, batch_id, list(idx ORDER BY idx) AS l FROM b GROUP BY ALL
  UNION ALL SELECT media_id, batch_id, unnest([l[1:len(l) // 2], l[len(l) // 2 + 1:]]) AS l FROM (SELECT *, {_SHOWN} AS n FROM h) WHERE len(l) > 1 AND n > 900)
SELECT media_id, CAST(batch_id AS INTEGER) AS batch_id, l[1] AS first, len(l) AS n, CAST(chars AS BIGINT) AS prompt_chars FROM (SELECT *, {_SHOWN} AS chars FROM h) WHERE len(l) = 1 OR chars <= 900""")


def v2_ranges(spark, d):
    s = X.scenes(spark, d).withColumn("end_idx", F.when(F.col("scene_id") % 2 == 0, F.col("end_idx") + 1).otherwise(F.col("end_idx"))).where("scene_id % 5 <> 3")
    return S.coverage_ranges(s, X.lines(spark, d))


def w16(spark, d):
    x = _lines(spark, d).withColumn("batch_id", F.expr("(idx - 1) div 4"))
    t = x.where("idx % 2 = 0").select("media_id", "batch_id", "idx")
    ctx = S.context(x, t, 3).join(t.withColumnRenamed("idx", "target_idx"), ["media_id", "target_idx"])
    return S.batch_context(ctx, t)


W16 = X.query(X.LINES, "b AS (SELECT *, (idx - 1) // 4 AS batch_id FROM lines)", """t AS (SELECT media_id, batch_id, idx FROM b WHERE idx % 2 = 0)
SELECT DISTINCT t.media_id, t.batch_id, c.idx FROM t JOIN b c ON c.media_id = t.media_id AND c.idx BETWEEN t.idx - 3 AND t.idx + 3 WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.media_id = t.media_id AND u.batch_id = t.batch_id AND u.idx = c.idx)""")


def requests(spark, d):
    x = _lines(spark, d).withColumn("batch_id", F.expr("(idx - 1) div 4"))
    return S.prompts(x, "Label:\n", "\nEnd.", T.prompt_line(F.col("idx"), F.col("start_ms"), F.col("end_ms"), F.col("speaker"), F.col("text"), F.col("idx") % 4 == 0))


def w17(spark, d):
    return requests(spark, d)


_LINE = "CASE WHEN idx % 4 = 0 THEN '>> ' ELSE '   ' END || printf('#%d [%s-%s] [%s] %s', idx, {t0}, {t1}, speaker, replace(replace(text, chr(10), ' '), '|', '/'))"
_TIME = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
W17 = X.query(X.LINES + f"\nSELECT media_id, (idx - 1) // 4 AS batch_id, 'Label:' || chr(10) || string_agg({_LINE.format(t0=_TIME.format('start_ms'), t1=_TIME.format('end_ms'))}, chr(10) ORDER BY idx) || chr(10) || 'End.' AS prompt FROM lines GROUP BY ALL")


def i2(spark, d):
    r = requests(spark, d)
    done = r.where("media_id % 3 = 0").withColumn("prompt", F.when(F.col("batch_id") == 1, F.concat("prompt", F.lit("!"))).otherwise(F.col("prompt"))).select("media_id", "batch_id", F.sha2("prompt", 256).alias("prompt_hash"))
    return S.pending(r, done).select("media_id", "batch_id", "prompt_hash")


_R = "r AS (SELECT" + W17.split("\nSELECT", 1)[-1] + ")"
I2 = X.query(X.LINES, _R + "\nSELECT media_id, batch_id, sha256(prompt) AS prompt_hash FROM r WHERE NOT (media_id % 3 = 0 AND batch_id <> 1)")


def i2_resumed(spark, d):
    """A first run over some media and a second over all, into one table: replies of both, each asked once."""
    from ..operators.resume import label_resumed
    from ..scratch import drop_at_exit, shared_dir

    path, r = shared_dir(spark), requests(spark, d)
    fn = lambda prompts: [f"{len(p)}:{p.count(chr(10))}" for p in prompts]
    label_resumed(r.where("media_id % 3 = 0"), fn, path, 2)
    out = label_resumed(r, fn, path, 2)
    drop_at_exit(spark, path)
    return out.select("media_id", "batch_id", "prompt_hash", "reply")


I2R = X.query(X.LINES, _R + "\nSELECT media_id, batch_id, sha256(prompt) AS prompt_hash, length(prompt) || ':' || (length(prompt) - length(replace(prompt, chr(10), ''))) AS reply FROM r")


def u3(spark, d):
    return S.label(requests(spark, d), lambda prompts: [f"{len(p)}:{p.count(chr(10))}" for p in prompts])


U3 = X.query(X.LINES, _R + "\nSELECT media_id, batch_id, length(prompt) || ':' || (length(prompt) - length(replace(prompt, chr(10), ''))) AS reply FROM r")


def f1(spark, d):
    return X.cues(spark, d).where(S.review_target()).select("media_id", "idx")


def f3(spark, d):
    return S.select_cues(X.cues(spark, d), "canonical", None, 10, 200, ["click", "view"]).select("media_id", "idx", "speaker")


def j2(spark, d):
    return S.scene_cues(X.scenes(spark, d), X.lines(spark, d), max_scenes=0)


def j2_some(spark, d):
    return S.scene_cues(X.scenes(spark, d), X.lines(spark, d), 5, 14, 2)


J2 = X.query(X.LINES, X.SCENES + "\nSELECT s.media_id, s.scene_id, c.idx, dense_rank() OVER (PARTITION BY s.media_id ORDER BY s.scene_id) AS number FROM scenes s JOIN lines c ON c.media_id = s.media_id AND c.idx BETWEEN s.start_idx AND s.end_idx WHERE s.enabled AND NOT starts_with(c.speaker, 'NONSPEECH')")


J2S = X.query(X.LINES, X.SCENES + "\nSELECT s.media_id, s.scene_id, c.idx, dense_rank() OVER (PARTITION BY s.media_id ORDER BY s.scene_id) AS number FROM scenes s JOIN lines c ON c.media_id = s.media_id AND c.idx BETWEEN s.start_idx AND s.end_idx WHERE s.enabled AND NOT starts_with(c.speaker, 'NONSPEECH') AND c.idx BETWEEN 5 AND 14 QUALIFY number <= 2")


def cut_replies(spark, d):
    """A cut for every third prediction of a media, each given twice; every tenth media has no cuts array, every eleventh a cut without an idx."""
    x = X.preds(spark, d).where("pid % 3 = 0").groupBy("media_id").agg(F.array_sort(F.collect_list("pid")).alias("p"))
    item = lambda i: F.concat(F.lit('{"after_idx":'), i.cast("string"), F.lit(',"title":" a\\n title ","reason":"r"},{"after_idx":"'), i.cast("string"), F.lit('","title":"second"}'))
    cuts = F.concat(F.lit('{"cuts":['), F.array_join(F.transform("p", item), ","), F.lit("]}"))
    m = F.col("media_id")
    body = F.when(m % 10 == 0, '{"cuts":"none"}').when(m % 11 == 0, F.replace(cuts, F.lit('"reason":"r"},'), F.lit('"reason":"r"},{"title":"lost"},'))).when(m % 13 == 0, "no answer").otherwise(cuts)
    return x.select("media_id", F.lit(0).alias("batch_id"), F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("reply"))


def p10_cuts(spark, d):
    return L.parse_replies(cut_replies(spark, d), "cuts")[0].select("media_id", "batch_id", "after_idx", "title", "reason")


def p10_cut_errors(spark, d):
    return L.parse_replies(cut_replies(spark, d), "cuts")[1]


_CUT = "SELECT DISTINCT media_id, 0 AS batch_id"
P10C = X.query(X.LINES, X.PREDS + "\nSELECT media_id, 0 AS batch_id, pid AS after_idx, 'a title' AS title, 'r' AS reason FROM preds WHERE pid % 3 = 0 AND media_id % 10 <> 0 AND media_id % 11 <> 0 AND media_id % 13 <> 0")
P10CE = X.query(X.LINES, X.PREDS + "\nSELECT DISTINCT media_id, 0 AS batch_id, CASE WHEN media_id % 10 = 0 THEN 'no cuts' WHEN media_id % 11 = 0 THEN 'bad after_idx' ELSE 'no json' END AS error FROM preds WHERE pid % 3 = 0 AND (media_id % 10 = 0 OR media_id % 11 = 0 OR media_id % 13 = 0)")


def p10_corrections(spark, d):
    """Corrections of a media's predictions: some without a confidence, some without an idx."""
    x = X.preds(spark, d)
    n = F.col("pid")
    item = F.concat(F.lit("{"), F.when(n % 6 != 0, F.concat(F.lit('"idx":'), n.cast("string"), F.lit(","))).otherwise(F.lit("")), F.lit('"original_spk":"x","corrected_spk":"'), F.col("speaker"), F.lit('"'), F.when(n % 4 != 0, F.concat(F.lit(',"confidence":"'), F.col("confidence"), F.lit('"'))).otherwise(F.lit("")), F.lit("}"))
    r = x.withColumn("item", item).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("pid", "item"))).alias("i"))
    replies = r.select("media_id", F.lit(1).alias("batch_id"), F.concat(F.lit("Here {it} is: ["), F.array_join(F.transform("i", lambda i: i["item"]), ","), F.lit("] done")).alias("reply"))
    return L.parse_replies(replies, "corrections")[0].select("media_id", "batch_id", "idx", "original_spk", "corrected_spk", "confidence")


P10K = X.query(X.LINES, X.PREDS + "\nSELECT media_id, 1 AS batch_id, pid AS idx, 'x' AS original_spk, speaker AS corrected_spk, CASE WHEN pid % 4 = 0 THEN 'low' ELSE confidence END AS confidence FROM preds WHERE pid % 6 <> 0")


def p10(spark, d):
    return L.parse_replies(X.replies(spark, d))[0].drop("reason")


def p10_errors(spark, d):
    return L.parse_replies(X.replies(spark, d))[1]


P10 = X.query(X.LINES, X.PREDS + "\nSELECT media_id, (pid - 1) // 4 AS batch_id, CAST(row_number() OVER (PARTITION BY media_id, (pid - 1) // 4 ORDER BY pid) - 1 AS INTEGER) AS pos, pid AS idx, speaker, speaker AS speaker_raw, confidence FROM preds WHERE media_id % 10 <> 0")
P10E = X.query(X.LINES, X.PREDS + "\nSELECT DISTINCT media_id, (pid - 1) // 4 AS batch_id, 'bad json' AS error FROM preds WHERE media_id % 10 = 0")


def results(spark, d):
    return L.parse_replies(X.replies(spark, d))[0]


RES = X.LINES + ",\n" + X.PREDS + ",\nres AS (SELECT media_id, pid AS idx, speaker, speaker AS speaker_raw, confidence FROM preds WHERE media_id % 10 <> 0)"


def x6(spark, d):
    return L.restrict(results(spark, d), ["user"]).select("media_id", "idx", "speaker", "speaker_raw")


def x7(spark, d):
    return L.retry_set(results(spark, d), "system")


def j9(spark, d):
    return L.apply_results(_lines(spark, d), L.restrict(results(spark, d), ["user", "assistant"]), ["user", "assistant"], "canonical").select("media_id", "idx", "final_speaker", "reason")


J9 = X.query(RES + """
SELECT l.media_id, l.idx, CASE WHEN l.idx % 4 <> 0 AND l.speaker IN ('user', 'assistant') THEN l.speaker WHEN r.speaker IS NULL THEN l.speaker ELSE r.speaker END AS final_speaker,
       CASE WHEN l.idx % 4 <> 0 AND l.speaker IN ('user', 'assistant') THEN 'locked canonical' WHEN r.speaker IS NULL THEN 'kept input: missing' WHEN r.speaker NOT IN ('user', 'assistant') THEN 'identity of OTHER' ELSE 'label' END AS reason
FROM lines l LEFT JOIN res r USING (media_id, idx)""")


def corrections(spark, d):
    """Corrections of every second prediction, of every fourth twice; the second is `system`. Some name the speaker that stands, some are of no cue."""
    x = X.preds(spark, d).where("pid % 2 = 0").select("media_id", F.when(F.col("pid") % 10 == 0, F.col("pid") + 5000).otherwise(F.col("pid")).alias("idx"), "pid", "speaker", "confidence")
    row = lambda pos, spk: ["media_id", "idx", F.lit(pos).alias("pos"), F.col("speaker").alias("original_spk"), spk.alias("corrected_spk"), "confidence", F.concat(F.lit("r"), "idx").alias("reason")]
    return x.select(*row(0, F.col("speaker"))).union(x.where("pid % 4 = 0").select(*row(1, F.lit("system"))))


def _corrected(spark, d):
    return L.apply_corrections(_lines(spark, d), corrections(spark, d), _lines(spark, d).where("idx % 6 <> 0"))


def j10(spark, d):
    return _corrected(spark, d)[1].withColumn("tags", F.array_join("tags", ","))


def j10_cues(spark, d):
    return _corrected(spark, d)[0].select("media_id", "idx", "speaker")


# one after the other: what a correction changes is what the one before it left; those of other cues than the targets have no row
_COR = X.LINES + ",\n" + X.PREDS + """,
c0 AS (SELECT media_id, CASE WHEN pid % 10 = 0 THEN pid + 5000 ELSE pid END AS idx, pid, speaker, confidence FROM preds WHERE pid % 2 = 0),
cor AS (SELECT media_id, idx, 0 AS pos, speaker AS original_spk, speaker AS corrected_spk, confidence, 'r' || idx AS reason FROM c0
  UNION ALL SELECT media_id, idx, 1, speaker, 'system', confidence, 'r' || idx FROM c0 WHERE pid % 4 = 0),
au AS (SELECT c.*, l.speaker AS spoken, l.start_ms, l.end_ms, l.text FROM cor c JOIN lines l USING (media_id, idx) WHERE c.idx % 6 <> 0)"""
J10 = X.query(_COR + "\nSELECT media_id, idx, pos, original_spk, corrected_spk, confidence, reason, corrected_spk <> CASE WHEN pos = 0 THEN spoken ELSE original_spk END AS applied, corrected_spk AS final_spk, start_ms, end_ms, text, CASE WHEN idx % 4 = 0 THEN 'MULTI' ELSE '' END AS tags FROM au")
J10C = X.query(_COR + "\nSELECT l.media_id, l.idx, coalesce((SELECT arg_max(corrected_spk, pos) FROM au WHERE au.media_id = l.media_id AND au.idx = l.idx), l.speaker) AS speaker FROM lines l")


def j11(spark, d):
    """Reviews by pid: unknown, other, overlap, without a speaker, nonspeech, names; some did not parse; an earlier one of each third cue is overruled."""
    k = F.col("pid") % 7
    said = F.when(k == 0, "?").when(k == 1, "OTHER").when(k == 2, "OVERLAP").when(k == 3, None).when(k == 4, "NONSPEECH").otherwise(F.col("speaker"))
    r = X.preds(spark, d).select("media_id", F.col("pid").alias("idx"), said.alias("speaker"), (F.col("pid") % 11 == 0).alias("parse_error"), F.lit(1).alias("pos"))
    early = r.where("idx % 3 = 0").withColumns({"speaker": F.lit("early"), "parse_error": F.lit(False), "pos": F.lit(0)})
    c = _lines(spark, d).withColumn("tags", F.when(F.col("idx") % 13 == 0, F.array(F.lit("MM_REVIEW"))).otherwise(F.col("tags")))
    return L.apply_reviews(c, r.unionByName(early)).select("media_id", "idx", "speaker", F.array_join("tags", ",").alias("tags"))


J11 = X.query(X.LINES, X.PREDS, """r AS (SELECT media_id, pid AS idx, CASE pid % 7 WHEN 0 THEN '?' WHEN 1 THEN 'OTHER' WHEN 2 THEN 'OVERLAP' WHEN 3 THEN NULL WHEN 4 THEN 'NONSPEECH' ELSE speaker END AS said, pid % 11 = 0 AS failed FROM preds),
x AS (SELECT l.media_id, l.idx, l.speaker, CASE WHEN l.idx % 13 = 0 THEN ['MM_REVIEW'] WHEN l.idx % 4 = 0 THEN ['MULTI'] ELSE [] END AS tags, said,
  CASE WHEN r.idx IS NULL THEN NULL WHEN said IS NULL OR said IN ('OVERLAP', 'OTHER') OR failed THEN 'MM_REVIEW' WHEN said = '?' THEN 'MM_UNCLEAR' ELSE 'MM_VERIFIED' END AS tag FROM lines l LEFT JOIN r USING (media_id, idx))
SELECT media_id, idx, CASE WHEN tag IN ('MM_UNCLEAR', 'MM_VERIFIED') THEN said ELSE speaker END AS speaker, array_to_string(CASE WHEN tag IS NULL OR list_contains(tags, tag) THEN tags ELSE list_append(tags, tag) END, ',') AS tags FROM x""")


def x2(spark, d):
    c = cuts(spark, d).withColumn("title", F.concat(F.lit("old "), F.col("after_idx").cast("string")))
    regions = X.scenes(spark, d).where("scene_id % 2 = 0").select("media_id", F.col("start_idx").alias("first_idx"), F.col("end_idx").alias("last_idx"))
    new = X.lines(spark, d).where("idx % 5 = 0").select("media_id", F.col("idx").alias("after_idx"), F.when(F.col("idx") % 2 == 0, "").otherwise(F.concat(F.lit("new "), F.col("idx").cast("string"))).alias("title"))
    return L.update_cuts(c, regions, new)


X2 = X.query(X.LINES, X.SCENES, """k AS (SELECT media_id, idx FROM lines c WHERE idx % 3 = 0 AND NOT EXISTS (SELECT 1 FROM scenes r WHERE r.media_id = c.media_id AND r.scene_id % 2 = 0 AND c.idx >= r.start_idx AND c.idx < r.end_idx) UNION SELECT media_id, idx FROM lines WHERE idx % 5 = 0)
SELECT media_id, idx AS after_idx, CASE WHEN idx % 5 = 0 AND idx % 2 <> 0 THEN 'new ' || idx WHEN idx % 3 = 0 THEN 'old ' || idx ELSE '' END AS title FROM k""")


def x3(spark, d):
    reply = X.lines(spark, d).select("media_id", F.expr("(idx - 1) div 4").alias("batch_id"), F.explode(F.array(F.col("idx"), F.col("idx") - 1)).alias("after_idx"), F.col("idx").alias("pos"), F.col("speaker").alias("title"))
    candidates = cuts(spark, d).withColumn("batch_id", F.expr("(after_idx - 1) div 4"))
    return L.filter_boundaries(reply, candidates)


X3 = X.query(X.LINES, "rp AS (SELECT media_id, (idx - 1) // 4 AS batch_id, unnest([idx, idx - 1]) AS after_idx, idx AS pos, speaker AS title FROM lines)\nSELECT media_id, batch_id, after_idx, arg_min(title, pos) AS title FROM rp WHERE after_idx % 3 = 0 AND (after_idx - 1) // 4 = batch_id AND EXISTS (SELECT 1 FROM lines l WHERE l.media_id = rp.media_id AND l.idx = rp.after_idx) GROUP BY ALL")


def x4(spark, d):
    old = X.lines(spark, d).select("media_id", "idx", "speaker")
    new = X.preds(spark, d).select("media_id", F.col("pid").alias("idx"), "speaker").where("idx % 2 = 0")
    return L.upsert_audit(old, new)


X4 = X.query(X.LINES, X.PREDS + "\nSELECT l.media_id, l.idx, coalesce(p.speaker, l.speaker) AS speaker FROM lines l LEFT JOIN preds p ON p.media_id = l.media_id AND p.pid = l.idx AND p.pid % 2 = 0")


def x5(spark, d):
    p = X.preds(spark, d)
    return p.select("media_id", "pid", L.conflict(F.col("speaker"), F.col("confidence") == "high", F.lit("user")).alias("conflict"))


X5 = X.query(X.LINES, X.PREDS + "\nSELECT media_id, pid, (speaker = 'user') <> (confidence = 'high') AS conflict FROM preds")


def x8(spark, d):
    """Scenes with titles, with their previews as titles, without, and with odd white space; every third scene has no speech, and every ninth cue is sung."""
    k = F.col("idx") % 9
    c = X.lines(spark, d).withColumns({"speaker": F.when(k.isin(0, 7, 8), "NONSPEECH").otherwise(F.col("speaker")), "text": F.when(k == 4, F.concat(F.lit("\u266a "), "text")).otherwise(F.col("text"))})
    s = X.scenes(spark, d)
    spoken = c.where("speaker <> 'NONSPEECH'").where(~F.contains("text", F.lit("\u266a")))
    pv = S.scene_preview(s, spoken)
    n = F.col("scene_id") % 4
    named = s.join(pv, ["media_id", "scene_id"], "left").withColumn("name", F.when(n == 0, F.col("preview")).when(n == 1, "title").when(n == 2, " ").otherwise("  two \n words ")).drop("preview")
    return L.cuts_from_scenes(named, c)


_SHOWN_TEXT = X.sql_plain("replace(l.text, '\\N', ' / ')")
_PREVIEW = f"CASE WHEN count(*) = 1 THEN min({_SHOWN_TEXT}) ELSE arg_min({_SHOWN_TEXT}, l.idx) || ' / ... / ' || arg_max({_SHOWN_TEXT}, l.idx) END AS preview"
X8 = X.query(X.LINES, X.SCENES, f"""sp AS (SELECT media_id, idx, text FROM lines WHERE idx % 9 NOT IN (0, 4, 7, 8)),
h AS (SELECT s.media_id, s.scene_id, max(l.idx) AS after_idx, {_PREVIEW} FROM scenes s JOIN sp l ON l.media_id = s.media_id AND l.idx BETWEEN s.start_idx AND s.end_idx WHERE enabled GROUP BY ALL),
t AS (SELECT *, CASE scene_id % 4 WHEN 0 THEN preview WHEN 1 THEN 'title' WHEN 2 THEN '' ELSE 'two words' END AS title, row_number() OVER w AS n, lead(scene_id) OVER w IS NULL AS last FROM h WINDOW w AS (PARTITION BY media_id ORDER BY scene_id))
SELECT media_id, CAST(n AS INTEGER) AS scene_id, after_idx, title, NOT last AND title <> '' AND title <> preview AS confirmed FROM t""")


def a19(spark, d):
    return S.scene_preview(X.scenes(spark, d), X.lines(spark, d))


A19 = X.query(X.LINES, X.SCENES + f"\nSELECT s.media_id, s.scene_id, {_PREVIEW} FROM scenes s JOIN lines l ON l.media_id = s.media_id AND l.idx BETWEEN s.start_idx AND s.end_idx GROUP BY ALL")


def a14(spark, d):
    return S.plan_summary(S.budget_groups(_scenes(spark, d), 60_000, 20, 3))


A14 = W11.split("\nSELECT media_id, group_id")[0] + ",\ngr AS (SELECT w.media_id, group_id, count(*) AS s, sum(w.n_cues) AS c, sum(cs.end_ms - cs.start_ms) AS ms FROM walk w JOIN cs USING (media_id, scene_id) GROUP BY ALL)\nSELECT count(*) AS requests, avg(s) AS avg_scenes, max(s) AS max_scenes, avg(c) AS avg_cues, max(c) AS max_cues, avg(ms) AS avg_ms, max(ms) AS max_ms FROM gr"


def w11_compact(spark, d):
    """Requests by the union of their cues' padded windows."""
    s = _scenes(spark, d)
    from ..operators.intervals import idx_join

    j = idx_join(X.cues(spark, d).select("media_id", "idx", "start_ms", "end_ms"), s.select("media_id", "scene_id", "start_idx", "end_idx"))
    w = j.select("p.media_id", "r.scene_id", F.greatest(F.lit(0), F.col("p.start_ms") - 1000).alias("start_ms"), (F.col("p.end_ms") + 1000).alias("end_ms"))
    return S.budget_groups(s, 20_000, 30, 0, w).groupBy("media_id", "group_id").agg(F.min("scene_id").alias("first_scene"), F.count("*").alias("n_scenes"), F.sum("n_cues").alias("n_cues"))


# the open group's windows go along the walk; a fold over them, sorted, gives the length of their union
_SPAN = "{'a': greatest(0, c.start_ms - 1000), 'z': c.end_ms + 1000, 't': c.end_ms + 1000 - greatest(0, c.start_ms - 1000)}"
_UNION = "list_reduce(list_sort({0}), lambda p, x: CASE WHEN x.a - p.z <= 1000 THEN {{'a': p.a, 'z': greatest(p.z, x.z), 't': p.t + greatest(0, x.z - p.z)}} ELSE {{'a': x.a, 'z': x.z, 't': p.t + x.z - x.a}} END).t"
_OVERC = f"(w.c + o.n_cues > 30 OR {_UNION.format('list_concat(w.l, o.l)')} > 20000)"
W11C = X.query(CUT_SCENES, f"""o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY scene_id) AS rn FROM (SELECT cs.media_id, cs.scene_id, cs.n_cues, list({_SPAN}) AS l FROM cs JOIN cues c ON c.media_id = cs.media_id AND c.idx BETWEEN cs.start_idx AND cs.end_idx GROUP BY ALL))""", f"""walk AS (SELECT media_id, rn, scene_id, n_cues, n_cues AS c, l, 0 AS group_id FROM o WHERE rn = 1
  UNION ALL SELECT o.media_id, o.rn, o.scene_id, o.n_cues, CASE WHEN {_OVERC} THEN o.n_cues ELSE w.c + o.n_cues END, CASE WHEN {_OVERC} THEN o.l ELSE list_concat(w.l, o.l) END, CASE WHEN {_OVERC} THEN w.group_id + 1 ELSE w.group_id END FROM walk w JOIN o ON o.media_id = w.media_id AND o.rn = w.rn + 1)
SELECT media_id, group_id, min(scene_id) AS first_scene, count(*) AS n_scenes, sum(n_cues) AS n_cues FROM walk GROUP BY ALL""")


def a15_tokens(spark, d):
    x = X.preds(spark, d).withColumn("total_tokens", F.when(F.col("pid") % 5 != 0, F.col("pid") * 7))
    return P.token_means(x, "confidence")


def a15_decisions(spark, d):
    x = X.preds(spark, d).withColumn("decision", F.when(F.col("pid") % 4 == 0, None).when(F.col("speaker") == "user", "yes_target").otherwise("no_target"))
    return P.counts_by(x.withColumn("decision", F.coalesce("decision", F.lit("pending"))), "decision")


def a15(spark, d):
    return P.counts_by(X.preds(spark, d), "speaker", "confidence")


def a5(spark, d):
    return P.output_speakers(X.cues(spark, d))


def a2(spark, d):
    """More speakers than are asked for: each event type with a number; summaries of 16 values a task."""
    c = X.cues(spark, d).withColumn("speaker", F.concat_ws(" ", "speaker", (F.sqrt(F.col("src") % 900).cast("int")).cast("string"))).withColumn("raw", F.concat_ws("/", "speaker", (F.col("src") % 3).cast("string")))
    return P.speaker_profile(c, 25, 2, 16).select("speaker", "n", F.array_join("variants", "|").alias("variants"), F.array_join("samples", "|").alias("samples"))


A2 = X.query(X.CUES, "c AS (SELECT * REPLACE (speaker || ' ' || CAST(floor(sqrt(src % 900)) AS INTEGER) AS speaker) FROM cues)\nSELECT speaker, count(*) AS n, array_to_string(list_sort(list_distinct(list(speaker || '/' || src % 3))), '|') AS variants, array_to_string((list(text ORDER BY media_id, idx))[1:2], '|') AS samples FROM c GROUP BY speaker ORDER BY n DESC, min((media_id, idx)) LIMIT 25")


def _aliased(spark, d):
    """Cues with the aliases of their own project: the same token is another name in another media."""
    return L.resolve_alias(X.cues(spark, d).withColumn("token", F.when(F.col("speaker") == "?", "").otherwise(F.col("speaker"))), X.aliases(spark, d))


def j1(spark, d):
    return _aliased(spark, d).select("media_id", "idx", "speaker", "alias_hit")


_AL = "rs AS (SELECT c.*, canonical, canonical IS NOT NULL AS hit FROM cues c LEFT JOIN al ON al.media_id = c.media_id AND al.variant = c.speaker)"
J1 = X.query(X.CUES, X.ALIASED, _AL + "\nSELECT media_id, idx, coalesce(canonical, speaker) AS speaker, hit AS alias_hit FROM rs")


def a3(spark, d):
    return P.alias_coverage(_aliased(spark, d))


def a3_misses(spark, d):
    return P.alias_misses(_aliased(spark, d), 3)


A3 = "SELECT speaker, alias_hit, count(*) AS n FROM (" + J1 + ") GROUP BY ALL"


def a4(spark, d):
    return P.normalise_stats(_aliased(spark, d))


def a4_kinds(spark, d):
    kind = F.when(F.col("is_multi"), "multi").when(F.col("is_lyric"), "nonspeech").when(F.col("speaker") == "?", "unlabeled").otherwise("single")
    return P.kept_by_kind(X.cues(spark, d).withColumn("kind", kind))


A4 = X.query(X.CUES, X.ALIASED, _AL + "\nSELECT count(*) AS total, count(*) FILTER (WHERE NOT is_multi AND hit AND text <> '') AS alias_hit_singles, count(*) FILTER (WHERE NOT is_multi AND NOT hit AND text <> '') AS alias_miss_singles, count(*) FILTER (WHERE is_multi AND hit AND text <> '') AS alias_hit_parts, count(*) FILTER (WHERE is_multi AND NOT hit AND text <> '') AS alias_miss_parts, count(*) FILTER (WHERE text = '') AS empty_dropped FROM rs")


def a18(spark, d):
    from ..operators.intervals import bucket

    return P.drop_reasons(bucket(X.cues(spark, d), ["click", "view", "NONSPEECH"]))


A18 = X.query(X.CUES + "\nSELECT CASE WHEN speaker = '?' THEN 'unknown' WHEN speaker IN ('click', 'view') OR starts_with(speaker, 'NONSPEECH') THEN 'kept' ELSE 'not in targets' END AS reason, count(*) AS n FROM cues GROUP BY 1")


def a8(spark, d):
    from ..operators.intervals import merge_overlap
    from .interval_queries import clips

    return P.clip_report(merge_overlap(clips(spark, d)))


def a8_stages(spark, d):
    from ..operators import intervals as I
    from .interval_queries import clips

    overlap = I.merge_overlap(clips(spark, d))
    used = I.first_per_speaker(overlap, 5)
    merged = I.merge_adjacent(used.drop("n_merged"), 300, 30_000)
    r = P.clip_stages(overlap, used, merged, I.min_duration(merged, 2000))
    entries = F.transform(F.map_entries("variants"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return r.withColumn("variants", F.array_join(entries, ","))


A8S = X.query(X.CUES, interval_queries.CLIPS, interval_queries._OVER, f"ov AS ({interval_queries._FOLD.format(run='run', runs='runs')})", "top AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY media_id, speaker ORDER BY start_ms, end_ms, entry_idx) <= 5)",
    "bare AS (SELECT * EXCLUDE (n_merged) FROM top)", interval_queries._adjacent("bare", 300, 30000), f"mg AS ({interval_queries._FOLD.format(run='run', runs='adj')})", """va AS (SELECT media_id, speaker, string_agg(raw_speaker || '=' || n, ',' ORDER BY raw_speaker) AS variants FROM (SELECT media_id, speaker, raw_speaker, count(*) AS n FROM top GROUP BY ALL) GROUP BY ALL)
SELECT o.*, t.after_cap, t.used_ms, coalesce(m.n, 0) AS after_merge, coalesce(l.n, 0) AS after_min_dur, va.variants
FROM (SELECT media_id, speaker, count(*) AS clips_total, count(*) FILTER (WHERE kind = 'single') AS from_single, count(*) FILTER (WHERE kind = 'multi') AS from_multi, sum(n_merged - 1) AS overlap_merged FROM ov GROUP BY ALL) o
JOIN (SELECT media_id, speaker, count(*) AS after_cap, sum(end_ms - start_ms) AS used_ms FROM top GROUP BY ALL) t USING (media_id, speaker) JOIN va USING (media_id, speaker)
LEFT JOIN (SELECT media_id, speaker, count(*) AS n FROM mg GROUP BY ALL) m USING (media_id, speaker)
LEFT JOIN (SELECT media_id, speaker, count(*) AS n FROM mg WHERE end_ms - start_ms >= 2000 GROUP BY ALL) l USING (media_id, speaker)""")


def styled(spark, d):
    s = X.styled(spark, d)
    return s.withColumns(T.ass_flags(F.col("text")))


_FL = rf"""fl AS (SELECT *, regexp_matches(text, '(?i)\\p(bo)?[1-9]') AS drawing, regexp_matches(text, '(?i)\\(pos|move)\(') AS positioned, regexp_matches(text, '(?i)\\k[fo]?[0-9]') AS karaoke, regexp_matches(text, '(?i)\\an[789]([^0-9]|$)') AS top,
  array_to_string(list_filter(list_transform(regexp_split_to_array(replace(regexp_replace(regexp_replace(text, '\{{[^}}]*\}}', '', 'g'), '\\[Nn]', chr(10), 'g'), '\h', ' '), '\r\n|[\n\r]'), lambda x: {X.sql_strip('x')}), lambda x: x <> ''), chr(10)) AS visible FROM styled)"""


def a6(spark, d):
    p = P.style_profile(styled(spark, d), 64)
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    samples = F.array_join(F.transform("samples", lambda x: F.concat_ws(" ", x["source_event_index"].cast("string"), x["start"].cast("string"), x["text"])), "|")
    return p.select("media_id", "style", "n", "drawing", "positioned", "karaoke", "top", flat("event_type").alias("event_types"), flat("layer").alias("layers"), flat("name").alias("names"), samples.alias("samples"))


def _histogram(name, column):
    return f"{name} AS (SELECT media_id, style, string_agg(k || '=' || c, ',' ORDER BY k) AS {name}_ FROM (SELECT media_id, style, CAST({column} AS VARCHAR) AS k, count(*) AS c FROM styled WHERE CAST({column} AS VARCHAR) <> '' GROUP BY ALL) GROUP BY ALL)"


A6 = X.query(X.STYLED, _FL, "r AS (SELECT *, row_number() OVER (PARTITION BY media_id, style ORDER BY event_index) - 1 AS rn, count(*) OVER (PARTITION BY media_id, style) AS n FROM fl)", _histogram("et", "event_type"), _histogram("ly", "layer"), _histogram("nm", "name") + """
SELECT media_id, style, count(*) AS n, count(*) FILTER (WHERE drawing) AS drawing, count(*) FILTER (WHERE positioned) AS positioned, count(*) FILTER (WHERE karaoke) AS karaoke, count(*) FILTER (WHERE top) AS top, max(et_) AS event_types, max(ly_) AS layers, max(nm_) AS names,
       string_agg(event_index || ' ' || start_ms || ' ' || substring(visible, 1, 240), '|' ORDER BY rn) FILTER (WHERE rn = 0 OR rn = n // 2 OR rn = n - 1) AS samples FROM r JOIN et USING (media_id, style) JOIN ly USING (media_id, style) LEFT JOIN nm USING (media_id, style) GROUP BY media_id, style""")


def policy(spark, d):
    """A policy a media: the same style is kept in one and dropped in another."""
    n = F.regexp_extract("style", r"(\d+)$", 1).cast("int") + F.col("media_id")
    return X.styled(spark, d).select("media_id", "style").distinct().where(n % 5 != 4).select("media_id", "style", F.when(n % 5 == 0, "drop_staff").when(n % 5 == 1, "review").otherwise("keep_dialogue").alias("action"))


def _acted(spark, d):
    types = X.styled(spark, d).select("media_id").distinct().where("media_id < 2").select("media_id", F.lit("Comment").alias("event_type"), F.lit("drop_comment").alias("action"))
    return P.apply_policy(styled(spark, d), policy(spark, d), types)


def f6(spark, d):
    return _acted(spark, d)[1]


def a7(spark, d):
    return P.counts_by(_acted(spark, d)[0], "action")


def a7_expected(spark, d):
    return P.check_expected(a7(spark, d), 7, 0)


_PO = r"po AS (SELECT *, (CAST(regexp_extract(style, '(\d+)$', 1) AS INTEGER) + media_id) % 5 AS k FROM fl), ac AS (SELECT *, CASE WHEN event_type = 'Comment' AND media_id < 2 THEN 'drop_comment' WHEN event_type <> 'Dialogue' THEN 'review' WHEN k = 0 THEN 'drop_staff' WHEN k = 1 THEN 'review' WHEN k = 4 THEN 'error' ELSE 'keep_dialogue' END AS action FROM po)"
F6 = X.query(X.STYLED, _FL, _PO + "\nSELECT media_id, event_index, style, CASE WHEN action = 'error' THEN 'unknown style' WHEN drawing THEN 'drawing' WHEN visible = '' THEN 'empty text' ELSE 'bad time' END AS violation FROM ac WHERE action = 'error' OR (action = 'keep_dialogue' AND (drawing OR visible = '' OR start_ms < 0 OR end_ms < start_ms))")
A7 = X.query(X.STYLED, _FL, _PO + "\nSELECT action, count(*) AS n FROM ac GROUP BY action")
A7E = X.query(X.STYLED, _FL, _PO + """
SELECT * FROM (SELECT 'kept events' AS problem, 7 AS expected, count(*) FILTER (WHERE action = 'keep_dialogue') AS found FROM ac UNION ALL SELECT 'review events', 0, count(*) FILTER (WHERE action = 'review') FROM ac
  UNION ALL SELECT 'review to resolve', 0, count(*) FILTER (WHERE action = 'review') FROM ac) WHERE expected <> found""")


def j13(spark, d):
    p = policy(spark, d).unionByName(X.table(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").cast("long").alias("media_id"), F.col("n_name").alias("style"), F.lit("review").alias("action")))
    return P.check_policy(X.styled(spark, d), p)


J13 = X.query(X.STYLED + r"""
SELECT DISTINCT media_id, style, 'not in policy' AS problem FROM styled WHERE (CAST(regexp_extract(style, '(\d+)$', 1) AS INTEGER) + media_id) % 5 = 4
UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name, 'not seen' FROM nation WHERE n_nationkey < 3""")


def v1(spark, d):
    """Every rule broken: gaps in idx, overrides, U+FFFD, odd tags, starts before 0, ends before starts; cues that end where they start break none."""
    i = F.col("src")
    c = X.cues(spark, d).where("src % 37 <> 0").withColumn("text", F.when(i % 41 == 0, F.concat(F.lit("{x}"), "text")).when(i % 59 == 0, F.concat("text", F.lit("\ufffd"))).when(i % 61 == 0, " \u3000").otherwise(F.col("text")))
    c = c.withColumn("tags", F.when(i % 43 == 0, F.array(F.lit("ODD"))).otherwise(F.col("tags"))).withColumns({"start_ms": F.when(i % 47 == 0, -1).otherwise(F.col("start_ms")), "end_ms": F.when(i % 53 == 0, F.col("start_ms") - 1).otherwise(F.col("end_ms"))})
    return P.check_cues(c).groupBy("media_id", "rule").agg(F.count("*").alias("n"))


V1 = X.query(X.CUES, """c AS (SELECT media_id, idx, src, CASE WHEN src % 47 = 0 THEN -1 ELSE start_ms END AS s, CASE WHEN src % 53 = 0 THEN start_ms - 1 ELSE end_ms END AS e,
  src % 41 = 0 AS over, src % 41 <> 0 AND src % 59 = 0 AS odd, CASE WHEN src % 41 = 0 OR src % 59 = 0 THEN FALSE WHEN src % 61 = 0 THEN TRUE ELSE text = '' END AS blank, row_number() OVER (PARTITION BY media_id ORDER BY idx) AS rn FROM cues WHERE src % 37 <> 0)
SELECT media_id, rule, count(*) AS n FROM (SELECT media_id, unnest(list_filter([CASE WHEN idx <> rn THEN 'idx not continuous' END, CASE WHEN blank THEN 'empty text' END, CASE WHEN s < 0 OR e < s THEN 'bad time' END, CASE WHEN src % 43 = 0 THEN 'unknown tag' END, CASE WHEN over THEN 'override left' END, CASE WHEN odd THEN 'replacement character' END], lambda x: x IS NOT NULL)) AS rule FROM c) GROUP BY ALL""")


def v2(spark, d):
    s = X.scenes(spark, d).withColumn("end_idx", F.when(F.col("scene_id") % 2 == 0, F.col("end_idx") + 1).otherwise(F.col("end_idx"))).where("scene_id % 5 <> 3")
    return S.check_coverage(s, X.lines(spark, d))


V2 = X.query(X.LINES, X.SCENES, """h AS (SELECT media_id, unnest(range(start_idx, end_idx + CASE WHEN scene_id % 2 = 0 THEN 2 ELSE 1 END)) AS idx FROM scenes WHERE scene_id % 5 <> 3), g AS (SELECT media_id, idx, count(*) AS n FROM h GROUP BY ALL)
SELECT coalesce(g.media_id, l.media_id) AS media_id, coalesce(g.idx, l.idx) AS idx, CASE WHEN n IS NULL THEN 'missing' WHEN l.idx IS NULL THEN 'unexpected' ELSE 'duplicate' END AS violation
FROM g FULL OUTER JOIN lines l ON g.media_id = l.media_id AND g.idx = l.idx WHERE n IS NULL OR l.idx IS NULL OR n > 1""")


# stretches of neighbours of one kind
V2R = f"""SELECT media_id, min(idx) AS first_idx, max(idx) AS last_idx, violation FROM (SELECT *, idx - row_number() OVER (PARTITION BY media_id, violation ORDER BY idx) AS run FROM ({V2})) GROUP BY media_id, violation, run"""


def v3(spark, d):
    s = X.scenes(spark, d).withColumn("end_idx", F.col("end_idx") + F.when(F.col("scene_id") % 2 == 0, 1).otherwise(0)).withColumn("start_ms", F.when(F.col("scene_id") % 3 == 0, 0).otherwise(F.col("start_ms")))
    return S.check_order(s)


V3 = X.query(X.LINES, X.SCENES, """s AS (SELECT media_id, scene_id, start_idx, end_idx + CASE WHEN scene_id % 2 = 0 THEN 1 ELSE 0 END AS end_idx, CASE WHEN scene_id % 3 = 0 THEN 0 ELSE start_ms END AS start_ms FROM scenes), l AS (SELECT *, lag(end_idx) OVER w AS pi, lag(start_ms) OVER w AS ps FROM s WINDOW w AS (PARTITION BY media_id ORDER BY scene_id))
SELECT media_id, scene_id, CASE WHEN pi >= start_idx THEN 'idx order' ELSE 'start order' END AS violation FROM l WHERE pi >= start_idx OR ps > start_ms""")


def v4(spark, d):
    return S.long_scenes(_scenes(spark, d), 30_000).select("media_id", "scene_id", "n_cues")


def t5(spark, d):
    return S.sample(X.cues(spark, d), 20).select("media_id", "idx")


_HASH = "md5('42|' || media_id || '|' || idx), media_id, idx"
T5 = X.query(X.CUES + f"\nSELECT media_id, idx FROM cues ORDER BY {_HASH} LIMIT 20")


def _strata(spark, d):
    return X.preds(spark, d).withColumnRenamed("pid", "idx").withColumn("stratum", F.when(F.col("confidence") == "low", "conflict").when((F.col("confidence") == "mid") & (F.col("idx") < 3) & (F.col("media_id") < 4), "rejected").otherwise("accepted"))


def t6(spark, d):
    return S.stratified(_strata(spark, d), "stratum", "mixed", 20).select("media_id", "idx", "stratum")


def t6_one(spark, d):
    return S.stratified(_strata(spark, d), "stratum", "conflict", 15).select("media_id", "idx", "stratum")


_ST = "st AS (SELECT media_id, pid AS idx, CASE WHEN confidence = 'low' THEN 'conflict' WHEN confidence = 'mid' AND pid < 3 AND media_id < 4 THEN 'rejected' ELSE 'accepted' END AS stratum FROM preds)"
T6 = X.query(X.LINES, X.PREDS, _ST, f"""rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_HASH}) AS rn FROM st),
q AS (SELECT least(6, count(*) FILTER (WHERE stratum = 'conflict')) + least(6, count(*) FILTER (WHERE stratum = 'rejected')) AS taken FROM st)
SELECT media_id, idx, stratum FROM rk, q WHERE rn <= CASE WHEN stratum = 'accepted' THEN 20 - taken ELSE 6 END""")
T6O = X.query(X.LINES, X.PREDS, _ST + f"\nSELECT media_id, idx, stratum FROM st WHERE stratum = 'conflict' ORDER BY {_HASH} LIMIT 15")


def t9(spark, d):
    return S.candidate_speakers(X.cues(spark, d), ["click"], 1, ["click", "purchase", "view"]).select("media_id", "idx", F.array_join("candidates", ",").alias("candidates"))


T9 = X.query(X.CUES + "\nSELECT media_id, idx, array_to_string(list_sort(list_distinct(list_concat(['click'], list_filter(list(speaker) OVER (PARTITION BY media_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), lambda x: x IN ('click', 'purchase', 'view'))))), ',') AS candidates FROM cues")


def u1(spark, d):
    """Documents as raw cues: sources become bracketed speakers by doc_id."""
    x = X.table(spark, d, "documents").select("doc_id", "source", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n()（）-]", " ").alias("t"))
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, F.concat(F.lit("("), "source", F.lit(")"), "t")).when(k == 1, F.concat(F.lit("- ("), "source", F.lit(")a "), "t", F.lit("\\N- (z)b"))).when(k == 2, F.concat(F.lit("("), "t", F.lit(")"))).when(k == 3, F.concat(F.lit("♪"), "t")).otherwise(F.concat(F.lit("x"), "t"))
    c = x.select("doc_id", T.classified(raw).alias("c"))
    said = F.array_join(F.transform("c.parts", lambda p: p["text"]), "|")
    return c.select("doc_id", F.col("c.kind").alias("kind"), F.array_join(F.transform("c.parts", lambda p: p["raw"]), ",").alias("speakers"), F.char_length(said).cast("long").alias("n_said"), F.md5(said.cast("binary")).alias("said"))


# a cue whose bracket is followed by nothing is a noise; what is said is the document, whole and stripped
_SAID = X.sql_strip("t")
U1 = f"""SELECT doc_id, kind, speakers, length(said) AS n_said, md5(said) AS said FROM (
  SELECT doc_id, CASE WHEN k = 0 AND {_SAID} <> '' THEN 'single' WHEN k = 1 THEN 'multi' WHEN k = 4 THEN 'unlabeled' ELSE 'nonspeech' END AS kind,
    CASE WHEN k = 0 AND {_SAID} <> '' THEN source WHEN k = 1 THEN source || ',z' ELSE '' END AS speakers, CASE WHEN k = 0 THEN {_SAID} WHEN k = 1 THEN {X.sql_strip("'a ' || t")} || '|b' ELSE '' END AS said
  FROM (SELECT doc_id, source, doc_id % 5 AS k, regexp_replace(coalesce(text, ''), '[\n()（）-]', ' ', 'g') AS t FROM documents))"""

QUERIES = {
    "w8_scenes_from_cuts": _scenes, "f8_refine_target": f8, "w9_refine_regions": w9, "w10_chunk": w10, "w11_budget_groups": w11, "w12_split_sparse": w12, "w13_context": w13, "w14_bisect_batches": w14, "w11_compact_groups": w11_compact, "j2_scene_cues_limited": j2_some, "p10_cuts": p10_cuts, "p10_cut_errors": p10_cut_errors, "p10_corrections": p10_corrections, "a15_token_means": a15_tokens, "a15_decisions": a15_decisions, "a3_alias_misses": a3_misses, "a4_kept_by_kind": a4_kinds, "a8_clip_stages": a8_stages, "a7_expected": a7_expected, "t6_one_stratum": t6_one, "w16_batch_context": w16, "w17_p15_prompts": w17, "i2_pending": i2, "i2_resumed_labels": i2_resumed, "u3_label_hook": u3,
    "f1_f2_review_targets": f1, "f3_select_cues": f3, "j2_scene_cues": j2, "p10_p11_parse_replies": p10, "p10_reply_errors": p10_errors, "x6_restrict": x6, "x7_retry_set": x7, "j9_f7_apply_results": j9, "j10_audit": j10, "j10_apply_corrections": j10_cues, "j11_apply_reviews": j11,
    "x2_update_cuts": x2, "x3_filter_boundaries": x3, "x4_upsert_audit": x4, "x5_conflict": x5, "x8_cuts_from_scenes": x8, "a19_scene_preview": a19, "a14_plan_summary": a14, "a15_histograms": a15, "a5_output_speakers": a5, "a2_t1_speaker_profile": a2, "j1_alias": j1, "a3_alias_coverage": a3, "a4_normalise_stats": a4, "a18_drop_reasons": a18, "a8_clip_report": a8,
    "a6_style_profile": a6, "f6_policy_violations": f6, "a7_action_counts": a7, "j13_policy_check": j13, "v1_check_cues": v1, "v2_check_coverage": v2, "v2_coverage_ranges": v2_ranges, "w14_context_prompts": w14_context, "v3_check_order": v3, "v4_long_scenes": v4, "t5_sample": t5, "t6_stratified": t6, "t9_candidate_speakers": t9, "u1_p4_p5_classify": u1,
}
ORACLES = {
    "w14_bisect_batches": W14, "w11_compact_groups": W11C, "j2_scene_cues_limited": J2S, "p10_cuts": P10C, "p10_cut_errors": P10CE, "p10_corrections": P10K, "a8_clip_stages": A8S, "a7_expected": A7E, "t5_sample": T5, "t6_stratified": T6, "t6_one_stratum": T6O,
    "a15_token_means": X.query(X.LINES, X.PREDS + "\nSELECT confidence, count(*) AS n, count(*) FILTER (WHERE pid % 5 <> 0) AS n_with_tokens, avg(pid * 7) FILTER (WHERE pid % 5 <> 0) AS mean_tokens FROM preds GROUP BY confidence"),
    "a15_decisions": X.query(X.LINES, X.PREDS + "\nSELECT CASE WHEN pid % 4 = 0 THEN 'pending' WHEN speaker = 'user' THEN 'yes_target' ELSE 'no_target' END AS decision, count(*) AS n FROM preds GROUP BY 1"),
    "a3_alias_misses": X.query(X.CUES, X.ALIASED, _AL + "\nSELECT token, n FROM (SELECT speaker AS token, count(*) AS n, min((media_id, idx)) AS first FROM rs WHERE NOT hit AND speaker <> '?' GROUP BY speaker) ORDER BY n DESC, first LIMIT 3"),
    "a4_kept_by_kind": X.query(X.CUES + "\nSELECT kind, count(*) FILTER (WHERE NOT gone) AS kept, count(*) FILTER (WHERE gone) AS dropped FROM (SELECT *, kind IN ('single', 'multi') AND text = '' AS gone FROM (SELECT *, CASE WHEN is_multi THEN 'multi' WHEN is_lyric THEN 'nonspeech' WHEN speaker = '?' THEN 'unlabeled' ELSE 'single' END AS kind FROM cues)) GROUP BY kind"),
    "w8_scenes_from_cuts": X.query(CUT_SCENES + "\nSELECT * FROM cs"), "f8_refine_target": F8, "w9_refine_regions": W9, "w10_chunk": X.query(X.CUES + "\nSELECT media_id, CAST((idx - 1) // 80 AS INTEGER) AS batch_id, count(*) AS n, min(idx) AS first FROM cues GROUP BY ALL"), "w11_budget_groups": W11, "w12_split_sparse": W12, "w13_context": W13, "w16_batch_context": W16, "w17_p15_prompts": W17, "i2_pending": I2, "i2_resumed_labels": I2R, "u3_label_hook": U3,
    "f1_f2_review_targets": X.query(X.CUES + "\nSELECT media_id, idx FROM cues WHERE NOT starts_with(speaker, 'NONSPEECH') AND (speaker = '?' OR is_multi)"), "f3_select_cues": X.query(X.CUES + "\nSELECT media_id, idx, speaker FROM cues WHERE idx BETWEEN 10 AND 200 AND speaker IN ('click', 'view')"),
    "j2_scene_cues": J2, "p10_p11_parse_replies": P10, "p10_reply_errors": P10E, "x6_restrict": X.query(RES + "\nSELECT media_id, idx, CASE WHEN speaker = 'user' THEN speaker ELSE 'OTHER' END AS speaker, speaker_raw FROM res"), "x7_retry_set": X.query(RES + "\nSELECT media_id, idx FROM res WHERE speaker = 'system'"), "j9_f7_apply_results": J9, "j10_audit": J10, "j10_apply_corrections": J10C, "j11_apply_reviews": J11,
    "x2_update_cuts": X2, "x3_filter_boundaries": X3, "x4_upsert_audit": X4, "x5_conflict": X5, "x8_cuts_from_scenes": X8, "a19_scene_preview": A19, "a14_plan_summary": A14, "a15_histograms": X.query(X.LINES, X.PREDS + "\nSELECT speaker, confidence, count(*) AS n FROM preds GROUP BY ALL"), "a5_output_speakers": X.query(X.CUES + "\nSELECT media_id, speaker, count(*) AS n, sum(end_ms - start_ms) AS total_ms FROM cues GROUP BY ALL"), "a2_t1_speaker_profile": A2, "j1_alias": J1, "a3_alias_coverage": A3, "a4_normalise_stats": A4, "a18_drop_reasons": A18,
    "a8_clip_report": "SELECT speaker, kind, count(*) AS clips, sum(n_merged) AS cues, sum(end_ms - start_ms) AS total_ms FROM (" + interval_queries.ORACLES["w1_merge_overlap"] + ") GROUP BY ALL",
    "a6_style_profile": A6, "f6_policy_violations": F6, "a7_action_counts": A7, "j13_policy_check": J13, "v1_check_cues": V1, "v2_check_coverage": V2, "v2_coverage_ranges": V2R, "w14_context_prompts": W14C, "v3_check_order": V3, "v4_long_scenes": X.query(CUT_SCENES + "\nSELECT media_id, scene_id, n_cues FROM cs WHERE end_ms - start_ms > 30000"), "t9_candidate_speakers": T9, "u1_p4_p5_classify": U1,
}
