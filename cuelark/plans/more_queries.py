"""Queries of the remaining operators and of whole runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intervals as I
from ..operators import labels as L
from ..operators import sequence as S
from ..sources import subtitles, tables
from . import fixtures as X


def w15(spark, d):
    return I.reindex(X.cues(spark, d).drop("idx"), ["src"]).select("media_id", "src", F.col("idx").cast("long").alias("idx"))


W15 = X.query(X.CUES + "\nSELECT media_id, src, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, speaker, src) AS idx FROM cues")


def raw_cues(spark, d):
    """Raw cues: shared ones hold two bracketed speakers, lyric ones a note, unknown ones no bracket."""
    c = X.cues(spark, d)
    said = F.when(F.col("text") == "", "-").otherwise(F.col("text"))
    two = F.concat(F.lit("- ("), "speaker", F.lit(")"), said, F.lit("\\N- (view)so"))
    raw = F.when(F.col("is_multi"), two).when(F.col("is_lyric"), F.concat(F.lit("♪ "), said)).when(F.col("speaker") == "?", said).otherwise(F.concat(F.lit("("), "speaker", F.lit("(kana))"), said))
    return c.select("media_id", "src", "start_ms", "end_ms", raw.alias("raw"))


def x1(spark, d):
    r = raw_cues(spark, d).withColumn("c", T.classified(F.col("raw"))).withColumnRenamed("raw", "whole")
    return L.explode_speakers(r).select("media_id", "src", "part", T.norm_speaker(F.col("raw")).alias("token"), "said")


_SAID = "CASE WHEN text = '' THEN '-' ELSE text END"
X1 = X.query(X.CUES + f"""
SELECT media_id, src, 0 AS part, speaker AS token, {_SAID} AS said FROM cues WHERE is_multi OR (NOT is_lyric AND speaker <> '?')
UNION ALL SELECT media_id, src, 1, 'view', 'so' FROM cues WHERE is_multi""")


def e1(spark, d):
    """Raw cues normalised: classes, parts, aliases, clean text, order; nonspeech and unlabeled rows kept."""
    c = raw_cues(spark, d).withColumn("c", T.classified(F.col("raw")))
    # cues without a speaker are one part, which no alias names, so that each cue is classed once
    other = F.transform(F.array("raw"), lambda x: F.struct(F.when(F.col("c.kind") == "nonspeech", "NONSPEECH").otherwise("?").alias("raw"), x.alias("text")))
    r = c.select("media_id", "src", "start_ms", "end_ms", F.struct("c.kind", F.when(F.col("c.kind").isin("nonspeech", "unlabeled"), other).otherwise(F.col("c.parts")).alias("parts")).alias("c"))
    spoken = ~F.col("c.kind").isin("nonspeech", "unlabeled")
    parts = L.explode_speakers(r).withColumn("token", F.when(spoken, T.norm_speaker(F.col("raw")))).withColumn("text", T.clean_text(F.col("said")))
    named = L.resolve_alias(parts, X.aliases(spark, d)).withColumn("speaker", F.when(spoken, F.col("speaker")).otherwise(F.col("raw")))
    return I.reindex(named.where(~spoken | (F.col("text") != "")), ["src", "part"]).select("media_id", "src", "part", "speaker", "text", F.col("idx").cast("long").alias("idx"))


E1 = X.query(X.CUES, X.ALIASED, f"""p AS (
  SELECT c.media_id, src, 0 AS part, start_ms, CASE WHEN NOT is_multi AND is_lyric THEN 'NONSPEECH' ELSE coalesce(canonical, speaker) END AS speaker,
         CASE WHEN NOT is_multi AND is_lyric THEN '' ELSE {_SAID} END AS text FROM cues c LEFT JOIN al ON al.media_id = c.media_id AND al.variant = c.speaker
  UNION ALL SELECT c.media_id, src, 1, start_ms, coalesce(canonical, 'view'), 'so' FROM cues c LEFT JOIN al ON al.media_id = c.media_id AND al.variant = 'view' WHERE is_multi)
SELECT media_id, src, part, speaker, text, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, speaker, src, part) AS idx FROM p""")


def t7(spark, d):
    return S.head_scenes(X.scenes(spark, d), 2).select("media_id", "scene_id", "number")


T7 = X.query(X.LINES, X.SCENES + "\nSELECT media_id, scene_id, row_number() OVER (PARTITION BY media_id ORDER BY scene_id) AS number FROM scenes WHERE enabled QUALIFY number <= 2")


def t8(spark, d):
    """Every fourth media's audit is of cues that are not there, so what the cues say counts."""
    audit = X.preds(spark, d).withColumn("idx", F.when(F.col("media_id") % 4 == 0, F.col("pid") + 1000).otherwise(F.col("pid")))
    return S.candidate_pick(audit, X.lines(spark, d), "user")


T8 = X.query(X.LINES, X.PREDS, "a AS (SELECT DISTINCT media_id, pid AS idx, 'audit' AS source FROM preds WHERE speaker = 'user' AND confidence IN ('high', 'mid') AND media_id % 4 <> 0)\nSELECT * FROM a UNION ALL SELECT media_id, idx, 'srt' FROM lines WHERE speaker = 'user' AND media_id NOT IN (SELECT media_id FROM a)")


def s17(spark, d):
    c = subtitles.parse_srt(subtitles.render_srt(X.cues(spark, d)))
    return subtitles.srt_predictions(c, ["click", "view"]).select("media_id", F.col("pid").alias("idx"), "speaker", "speaker_raw", "confidence")


S17 = X.query(X.CUES + "\nSELECT media_id, idx, CASE WHEN starts_with(speaker, 'NONSPEECH') THEN 'NONSPEECH' WHEN speaker IN ('click', 'view', '?') THEN speaker ELSE 'OTHER' END AS speaker, speaker AS speaker_raw, 'unknown' AS confidence FROM cues")


def i1(spark, d):
    """Two passes: each adds the cut after the middle of every scene of more than four cues."""
    c = X.cues(spark, d).select("media_id", "idx", "start_ms", "end_ms")

    def step(cuts):
        s = S.scenes_from_cuts(c, cuts).where("n_cues > 4")
        return cuts.union(s.select("media_id", F.expr("cast(start_idx + n_cues div 2 - 1 as int)"))).distinct()

    start = c.where("idx % 50 = 0").select("media_id", F.col("idx").alias("after_idx"))
    return S.refine(start, step, 2)


def _halved(name, source):
    return f"""{name}s AS (SELECT c.media_id, 1 + (SELECT count(*) FROM {source} k WHERE k.media_id = c.media_id AND k.after_idx < c.idx) AS scene_id, c.idx FROM cues c),
{name} AS (SELECT media_id, after_idx FROM {source} UNION SELECT media_id, CAST(min(idx) + count(*) // 2 - 1 AS INTEGER) FROM {name}s GROUP BY media_id, scene_id HAVING count(*) > 4)"""


I1 = X.query(X.CUES, "c0 AS (SELECT media_id, idx AS after_idx FROM cues WHERE idx % 50 = 0)", _halved("c1", "c0"), _halved("c2", "c1") + "\nSELECT media_id, after_idx FROM c2")


def s5_training(spark, d):
    from .interval_queries import clips

    rows = tables.training_manifest(clips(spark, d))
    return rows.groupBy("media_id", "speaker").agg(F.count("*").alias("n"), F.max(F.size(F.split("value", r"\|"))).alias("fields"))


S5T = X.query(X.CUES + "\nSELECT media_id, CASE WHEN starts_with(speaker, 'NONSPEECH') THEN 'NONSPEECH' ELSE speaker END AS speaker, count(*) AS n, 3 AS fields FROM cues WHERE speaker <> '?' AND text <> '' GROUP BY ALL")

def a1(spark, d):
    r = raw_cues(spark, d).select(T.classified(F.col("raw")).alias("c"))
    return r.groupBy(F.col("c.kind").alias("kind")).agg(F.count("*").alias("n"))


A1 = X.query(X.CUES + "\nSELECT CASE WHEN is_multi THEN 'multi' WHEN is_lyric THEN 'nonspeech' WHEN speaker = '?' THEN 'unlabeled' ELSE 'single' END AS kind, count(*) AS n FROM cues GROUP BY 1")

QUERIES = {"a1_kind_counts": a1, "w15_reindex": w15, "x1_p3_explode_speakers": x1, "e1_normalise": e1, "t7_head_scenes": t7, "t8_candidate_pick": t8, "s17_srt_predictions": s17, "i1_refine_loop": i1, "s19_manifest_counts": s5_training}
ORACLES = {"a1_kind_counts": A1, "w15_reindex": W15, "x1_p3_explode_speakers": X1, "e1_normalise": E1, "t7_head_scenes": T7, "t8_candidate_pick": T8, "s17_srt_predictions": S17, "i1_refine_loop": I1, "s19_manifest_counts": S5T}
