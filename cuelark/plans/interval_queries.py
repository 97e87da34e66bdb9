"""Queries of interval operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from . import fixtures as X

CLIP = ["media_id", "speaker", "start_ms", "end_ms", "raw_speaker", "excerpt", "full_text", "kind", "entry_idx", "n_merged"]


def clips(spark, d):
    kept = I.bucket(X.cues(spark, d)).where("dropped_for IS NULL")
    return I.to_clips(kept).drop("speaker").join(kept.select("media_id", F.col("idx").alias("entry_idx"), F.col("bucket").alias("speaker")), ["media_id", "entry_idx"])


_FOLDED = "CASE WHEN speaker = 'NONSPEECH' OR starts_with(speaker, 'NONSPEECH:') THEN 'NONSPEECH' ELSE speaker END"
CLIPS = f"""clips AS (
  SELECT media_id, {_FOLDED} AS speaker, start_ms, end_ms, speaker AS raw_speaker, substring(text, 1, 60) AS excerpt, text AS full_text,
         CASE WHEN is_multi THEN 'multi' ELSE 'single' END AS kind, idx AS entry_idx
  FROM cues WHERE speaker <> '?')"""

#: Folds rows of `runs` (with columns g1..: the run) to clips.
_FOLD = """
  SELECT media_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
         CASE WHEN count(*) = 1 THEN first(raw_speaker) ELSE substring(string_agg(raw_speaker, ' / ' ORDER BY lead DESC, start_ms, end_ms, entry_idx), 1, 60) END AS raw_speaker,
         CASE WHEN count(*) = 1 THEN first(excerpt) ELSE substring(string_agg(excerpt, ' / ' ORDER BY start_ms, end_ms, entry_idx), 1, 120) END AS excerpt,
         coalesce(string_agg(full_text, ' ' ORDER BY start_ms, end_ms, entry_idx) FILTER (WHERE full_text <> ''), '') AS full_text,
         CASE WHEN bool_or(kind = 'single') THEN 'single' ELSE 'multi' END AS kind, first(entry_idx ORDER BY start_ms, end_ms, entry_idx) AS entry_idx, count(*) AS n_merged
  FROM (SELECT *, CASE WHEN kind = 'single' AND row_number() OVER (PARTITION BY media_id, speaker, {run}, kind ORDER BY start_ms, end_ms, entry_idx) = 1 THEN 1 ELSE 0 END AS lead FROM {runs})
  GROUP BY media_id, speaker, {run}"""


def _runs(name, source, keys, order, fresh):
    return f"""{name} AS (
  SELECT *, sum(CASE WHEN coalesce({fresh}, TRUE) THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {order}) AS run
  FROM (SELECT *, max(end_ms) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}))"""


_BY = "media_id, speaker"
_ORDER = "start_ms, end_ms, entry_idx"


def _adjacent(source, gap, cap):
    """Walks clips of a speaker in order, carrying the open run's start and end."""
    return f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY {_ORDER}) AS rn FROM {source}),
walk AS (
  SELECT media_id, speaker, rn, start_ms AS s, end_ms AS e, CAST(1 AS BIGINT) AS run FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.media_id, o.speaker, o.rn,
         CASE WHEN o.start_ms - w.e <= {gap} AND o.end_ms - w.s <= {cap} THEN w.s ELSE o.start_ms END,
         CASE WHEN o.start_ms - w.e <= {gap} AND o.end_ms - w.s <= {cap} THEN greatest(w.e, o.end_ms) ELSE o.end_ms END,
         CASE WHEN o.start_ms - w.e <= {gap} AND o.end_ms - w.s <= {cap} THEN w.run ELSE w.run + 1 END
  FROM walk w JOIN ordered o ON o.media_id = w.media_id AND o.speaker = w.speaker AND o.rn = w.rn + 1),
adj AS (SELECT o.*, w.run FROM ordered o JOIN walk w USING (media_id, speaker, rn))"""


_CONFLICT = """real AS (
  SELECT media_id, idx, start_ms, end_ms, speaker, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, idx) AS rn FROM cues WHERE speaker NOT IN ('?', 'NONSPEECH')),
rivals AS (
  SELECT a.media_id, a.rn, a.idx, list(b.idx ORDER BY b.rn) FILTER (WHERE b.idx IS NOT NULL) AS later
  FROM real a LEFT JOIN real b ON b.media_id = a.media_id AND b.rn > a.rn AND b.start_ms < a.end_ms AND b.speaker <> a.speaker
       AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) > {t}
  GROUP BY a.media_id, a.rn, a.idx),
sweep AS (
  SELECT media_id, CAST(0 AS BIGINT) AS rn, CAST([] AS INTEGER[]) AS gone FROM real GROUP BY media_id
  UNION ALL
  SELECT s.media_id, r.rn,
         CASE WHEN list_contains(s.gone, r.idx) OR len(list_filter(coalesce(r.later, []), lambda x: NOT list_contains(s.gone, x))) = 0 THEN s.gone
              ELSE list_concat(s.gone, [r.idx, list_filter(r.later, lambda x: NOT list_contains(s.gone, x))[1]]) END
  FROM sweep s JOIN rivals r ON r.media_id = s.media_id AND r.rn = s.rn + 1),
dropped AS (SELECT media_id, unnest(gone) AS idx FROM (SELECT media_id, arg_max(gone, rn) AS gone FROM sweep GROUP BY media_id)),
calm AS (SELECT * FROM cues WHERE (media_id, idx) NOT IN (SELECT media_id, idx FROM dropped))"""


def w1(spark, d):
    return I.merge_overlap(clips(spark, d)).select(*CLIP)


def w2(spark, d):
    m = I.merge_gap(X.cues(spark, d), 100)
    return m.select("media_id", "speaker", "start_ms", "end_ms", "text", F.array_join("tags", ",").alias("tags"), F.array_join(F.col("source_entries").cast("array<string>"), ",").alias("sources"), F.col("merges").cast("long").alias("merges"))


W2 = X.query(
    X.CUES,
    "seg AS (SELECT *, sum(CASE WHEN is_lyric THEN 1 ELSE 0 END) OVER (PARTITION BY media_id, speaker ORDER BY start_ms, end_ms, src) AS part FROM cues)",
    _runs("runs", "seg", "media_id, speaker, part, is_lyric", "start_ms, end_ms, src", "start_ms > reach + 100"),
    """rows AS (SELECT *, row_number() OVER (PARTITION BY media_id, speaker, part, is_lyric, run ORDER BY start_ms, end_ms, src) AS k FROM runs)
SELECT media_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, coalesce(string_agg(text, ' / ' ORDER BY k) FILTER (WHERE text <> ''), '') AS text,
       CASE WHEN count(*) = 1 THEN CASE WHEN bool_or(is_multi) THEN 'MULTI' ELSE '' END
            WHEN bool_or(is_multi AND k <= 2) THEN 'MULTI,MERGED' WHEN bool_or(is_multi) THEN 'MERGED,MULTI' ELSE 'MERGED' END AS tags,
       string_agg(CAST(src AS VARCHAR), ',' ORDER BY k) AS sources, count(*) - 1 AS merges
FROM rows GROUP BY media_id, speaker, part, is_lyric, run""",
)


def w3(spark, d):
    return I.merge_adjacent(clips(spark, d), 300, 30_000).select(*CLIP)


def w4(spark, d):
    return I.union_intervals(X.segments(spark, d), ["media_id", "speaker"])


def w7(spark, d):
    real = X.cues(spark, d).where("speaker NOT IN ('?', 'NONSPEECH')")
    runs = I.islands(real, ["media_id"], ["start_ms", "end_ms", "idx"])
    return runs.groupBy("media_id", "island").agg(F.count("*").alias("n"), F.countDistinct("speaker").alias("n_speakers"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def j17(spark, d):
    return I.drop_cross_speaker(X.cues(spark, d), 200).select("media_id", "idx", "speaker", "start_ms", "end_ms")


def flagship(spark, d):
    return I.clip_table(X.cues(spark, d), conflict_ms=0, n=200).select(*CLIP)


def f4(spark, d):
    return I.bucket(X.cues(spark, d), ["click", "view", "NONSPEECH"]).select("media_id", "idx", "bucket", "dropped_for")


def f5(spark, d):
    return I.min_duration(I.merge_overlap(clips(spark, d)), 2000).select(*CLIP)


def t2(spark, d):
    return I.first_per_speaker(clips(spark, d), 5).select("media_id", "speaker", "entry_idx", "start_ms")


def p12(spark, d):
    """Every tenth cue lies in the first three seconds of its film."""
    c = X.cues(spark, d).withColumn("s", F.when(F.col("idx") % 10 == 0, F.col("start_ms") % 3000).otherwise(F.col("start_ms")))
    a, b = I.clip_window(F.col("s"), F.col("s") + F.col("end_ms") - F.col("start_ms"))
    return c.select("media_id", "idx", a.alias("clip_start"), b.alias("clip_end"))


# both ends are padded, then only the start is held at 0
P12 = X.query(
    X.CUES,
    """p AS (SELECT media_id, idx, CASE WHEN idx % 10 = 0 THEN start_ms % 3000 ELSE start_ms END AS s, end_ms - start_ms AS n FROM cues),
q AS (SELECT *, s + n AS e, CAST(greatest(0, s - 1500) AS DOUBLE) AS a, CAST(s + n + 1500 AS DOUBLE) AS b FROM p)
SELECT media_id, idx, CASE WHEN b - a < 4000 THEN greatest(0, a - (4000 - (b - a)) / 2) WHEN b - a > 12000 THEN greatest(0, (s + e) / 2 - 6000) ELSE a END AS clip_start,
       CASE WHEN b - a < 4000 THEN b + (4000 - (b - a)) / 2 WHEN b - a > 12000 THEN greatest(0, (s + e) / 2 - 6000) + 12000 ELSE b END AS clip_end
FROM q""",
)


def batch_cues(spark, d):
    return X.lines(spark, d).where("idx % 3 <> 0").withColumn("batch_id", F.expr("(idx - 1) div 12"))


BATCH = "bc AS (SELECT *, (idx - 1) // 12 AS batch_id FROM lines WHERE idx % 3 <> 0)"
WINDOWS = "padded AS (SELECT DISTINCT media_id, batch_id AS speaker, idx AS entry_idx, greatest(0, start_ms - 1000) AS start_ms, end_ms + 1000 AS end_ms FROM bc),\n" + _runs("wr", "padded", _BY, "start_ms, end_ms", "start_ms > reach + 1000") + """,
wm AS (SELECT media_id, speaker AS batch_id, run, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM wr GROUP BY ALL),
win AS (SELECT media_id, batch_id, start_ms, end_ms, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY media_id, batch_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_ms,
               row_number() OVER (PARTITION BY media_id, batch_id ORDER BY start_ms) AS window_id FROM wm)"""


def w5(spark, d):
    return I.compact_windows(batch_cues(spark, d)).select("media_id", "batch_id", "start_ms", "end_ms", F.col("offset_ms").cast("long").alias("offset_ms"), F.col("window_id").cast("long").alias("window_id"))


def w6(spark, d):
    b = batch_cues(spark, d)
    return I.compact_clock(b, I.compact_windows(b))


def audio(spark, d):
    return X.cues(spark, d).groupBy("media_id").agg((F.max("end_ms") - 20_000).alias("duration_ms"))


def j5(spark, d, offset=0):
    return I.attach_segments(X.spoken(spark, d), audio(spark, d), X.segments(spark, d), offset_ms=offset)


def j5_map(spark, d):
    """Each media has a label map of its own: the same speakers are others, and the odd ones name one only."""
    c = X.spoken(spark, d)
    named = F.when(F.col("media_id") % 2 == 0, F.map_from_arrays(F.array(F.lit("SPK1"), F.lit("SPK2")), F.array(F.lit("Anna"), F.lit("Ben")))).otherwise(F.map_from_arrays(F.array(F.lit("SPK1")), F.array(F.lit("Cara"))))
    maps = c.select("media_id").distinct().select("media_id", F.explode(named).alias("speaker", "label"))
    return I.attach_segments(c, audio(spark, d), X.segments(spark, d), maps).select("media_id", "idx", "candidate", "chosen", "coverage")


def _j5_sql(offset):
    return X.query(
        X.CUES,
        X.SEGMENTS,
        f"""audio AS (SELECT media_id, max(end_ms) - 20000 AS duration_ms FROM cues GROUP BY media_id),
shifted AS (SELECT media_id, speaker, start_ms + {offset} AS start_ms, end_ms + {offset} AS end_ms, start_ms AS entry_idx FROM segs)""",
        _runs("sr", "shifted", _BY, "start_ms, end_ms", "start_ms > reach"),
        "united AS (SELECT media_id, speaker, run, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM sr GROUP BY ALL)",
        """hit AS (SELECT c.media_id, c.idx, u.speaker, greatest(c.start_ms, u.start_ms) AS start_ms, least(c.end_ms, u.end_ms) AS end_ms FROM spoken c JOIN united u ON u.media_id = c.media_id AND c.start_ms < u.end_ms AND u.start_ms < c.end_ms),
per AS (SELECT media_id, idx, speaker, sum(end_ms - start_ms) AS ms FROM hit GROUP BY ALL),
best AS (SELECT media_id, idx, string_agg(speaker || '=' || ms, ',' ORDER BY speaker) AS "overlaps", CASE WHEN count(*) FILTER (WHERE ms = most) = 1 THEN max(speaker) FILTER (WHERE ms = most) ELSE '?' END AS candidate
         FROM (SELECT *, max(ms) OVER (PARTITION BY media_id, idx) AS most FROM per) GROUP BY media_id, idx)""",
        _runs("cr", "(SELECT media_id, idx AS speaker, start_ms, end_ms FROM hit)", _BY, "start_ms, end_ms", "start_ms > reach"),
        f"""cov AS (SELECT media_id, speaker AS idx, sum(e - s) AS ms FROM (SELECT media_id, speaker, run, min(start_ms) AS s, max(end_ms) AS e FROM cr GROUP BY ALL) GROUP BY media_id, speaker)
SELECT c.media_id, c.idx, coalesce(candidate, '?') AS candidate, CASE WHEN c.speaker = 'NONSPEECH' THEN 'NONSPEECH' ELSE coalesce(candidate, '?') END AS chosen, coalesce("overlaps", '') AS "overlaps",
       CASE WHEN c.end_ms > c.start_ms THEN coalesce(cov.ms, 0) / (c.end_ms - c.start_ms) ELSE 0 END AS coverage, CASE WHEN c.end_ms > c.start_ms THEN coalesce(cov.ms, 0) / (c.end_ms - c.start_ms) < 0.5 ELSE TRUE END AS coverage_low,
       least(c.end_ms, duration_ms + {offset}) - greatest(c.start_ms, {offset}) > 0 AS emitted,
       least(c.end_ms, duration_ms + {offset}) - greatest(c.start_ms, {offset}) > 0 AND (c.start_ms < {offset} OR c.end_ms > duration_ms + {offset}) AS boundary_crossing
FROM spoken c JOIN audio USING (media_id) LEFT JOIN best USING (media_id, idx) LEFT JOIN cov USING (media_id, idx)""",
    )


J5M = f"""SELECT media_id, idx, candidate, coverage, CASE WHEN chosen = 'NONSPEECH' THEN chosen WHEN candidate = 'SPK1' THEN CASE WHEN media_id % 2 = 0 THEN 'Anna' ELSE 'Cara' END WHEN candidate = 'SPK2' AND media_id % 2 = 0 THEN 'Ben' ELSE candidate END AS chosen
FROM ({_j5_sql(0)})"""


def j4(spark, d):
    s, _ = I.map_scenes(X.scenes(spark, d).withColumn("end_ms", F.col("end_ms") - F.when(F.col("scene_id") % 2 == 0, 3000).otherwise(0)), X.lines(spark, d))
    return s


def j4_errors(spark, d):
    _, e = I.map_scenes(X.scenes(spark, d).withColumn("end_ms", F.col("end_ms") - F.when(F.col("scene_id") % 2 == 0, 3000).otherwise(0)), X.lines(spark, d))
    return e


def j4_partial(spark, d):
    return I.map_scenes(X.scenes(spark, d).withColumn("end_ms", F.col("end_ms") - F.when(F.col("scene_id") % 2 == 0, 3000).otherwise(0)), X.lines(spark, d), allow_partial=True)[1]


def in_scenes(spark, d):
    """Lines in requests of two scenes of three lines."""
    return X.lines(spark, d).where("idx % 3 <> 0").withColumn("scene_id", F.expr("(idx - 1) div 3 + 1")).withColumn("batch_id", F.expr("(scene_id - 1) div 2"))


def w6_continuous(spark, d):
    s = X.scenes(spark, d).withColumn("batch_id", F.expr("(scene_id - 1) div 2"))
    return I.continuous_clock(in_scenes(spark, d), s)[1]


def w6_continuous_scenes(spark, d):
    s = X.scenes(spark, d).withColumn("batch_id", F.expr("(scene_id - 1) div 2"))
    return I.continuous_clock(in_scenes(spark, d), s)[0].select("media_id", "batch_id", "scene_id", "batch_start_ms", "batch_end_ms")


def w6_scenes(spark, d):
    c = in_scenes(spark, d)
    return I.scenes_on_clock(c, I.compact_clock(c, I.compact_windows(c)))


_ON = """bc AS (SELECT *, (idx - 1) // 3 + 1 AS scene_id, (idx - 1) // 6 AS batch_id FROM lines WHERE idx % 3 <> 0)"""
_CLOCK = """ck AS (SELECT media_id, scene_id, start_ms, end_ms, (scene_id - 1) // 2 AS batch_id, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY media_id, (scene_id - 1) // 2 ORDER BY scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM scenes)"""
_J4 = """sc AS (SELECT media_id, scene_id, start_ms, end_ms - CASE WHEN scene_id % 2 = 0 THEN 3000 ELSE 0 END AS end_ms FROM scenes),
h AS (SELECT l.media_id, l.idx, s.scene_id FROM lines l JOIN sc s ON s.media_id = l.media_id AND (l.start_ms + l.end_ms) / 2.0 BETWEEN s.start_ms AND s.end_ms)"""


def j3(spark, d):
    return I.preceding_context(X.scenes(spark, d), X.lines(spark, d), 15_000)


QUERIES = {
    "flagship_clip_table": flagship,
    "w1_merge_overlap": w1,
    "w2_merge_gap": w2,
    "w3_merge_adjacent": w3,
    "w4_union": w4,
    "w5_compact_windows": w5,
    "w6_j14_compact_clock": w6,
    "w7_cross_islands": w7,
    "j3_preceding_context": j3,
    "j4_map_scenes": j4,
    "j4_scene_errors": j4_errors,
    "j4_partial_errors": j4_partial,
    "w6_continuous_clock": w6_continuous,
    "w6_continuous_scenes": w6_continuous_scenes,
    "w6_scenes_on_clock": w6_scenes,
    "j5_a16_attach_segments": j5,
    "j5_a16_attach_shifted": lambda s, d: j5(s, d, 10_000),
    "j17_drop_cross_speaker": j17,
    "f4_bucket": f4,
    "f5_min_duration": f5,
    "t2_first_per_speaker": t2,
    "p12_clip_window": p12, "j5_label_map": j5_map,
}

_TOP = "top AS (SELECT * EXCLUDE (n_merged) FROM ({0}) QUALIFY row_number() OVER (PARTITION BY media_id, speaker ORDER BY start_ms, end_ms, entry_idx) <= 200)"
_OVER = _runs("runs", "clips", _BY, _ORDER, "start_ms >= reach")
_COLS = "SELECT media_id, speaker, start_ms, end_ms, raw_speaker, excerpt, full_text, kind, entry_idx, n_merged FROM "
ORACLES = {
    "flagship_clip_table": X.query(X.CUES, _CONFLICT.format(t=0), CLIPS.replace("FROM cues", "FROM calm"), _OVER, _TOP.format(_FOLD.format(run="run", runs="runs")), _adjacent("top", 300, 30000), f"done AS ({_FOLD.format(run='run', runs='adj')})\n{_COLS} done WHERE end_ms - start_ms >= 2000"),
    "w1_merge_overlap": X.query(X.CUES, CLIPS, _OVER, f"done AS ({_FOLD.format(run='run', runs='runs')})\n{_COLS} done"),
    "w2_merge_gap": W2,
    "w3_merge_adjacent": X.query(X.CUES, CLIPS, _adjacent("clips", 300, 30000), f"done AS ({_FOLD.format(run='run', runs='adj')})\n{_COLS} done"),
    "w4_union": X.query(X.CUES, X.SEGMENTS, _runs("r", "segs", _BY, "start_ms, end_ms", "start_ms > reach") + "\nSELECT media_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r GROUP BY media_id, speaker, run"),
    "w5_compact_windows": X.query(X.LINES, BATCH, WINDOWS + "\nSELECT media_id, batch_id, start_ms, end_ms, offset_ms, window_id FROM win"),
    "w6_j14_compact_clock": X.query(X.LINES, BATCH, WINDOWS + """
SELECT b.media_id, b.batch_id, b.idx, b.start_ms + arg_min(offset_ms - win.start_ms, window_id) AS clock_start_ms, b.end_ms + arg_min(offset_ms - win.start_ms, window_id) AS clock_end_ms
FROM bc b JOIN win ON win.media_id = b.media_id AND win.batch_id = b.batch_id AND b.start_ms >= win.start_ms AND b.end_ms <= win.end_ms GROUP BY b.media_id, b.batch_id, b.idx, b.start_ms, b.end_ms"""),
    "w7_cross_islands": X.query(X.CUES, _runs("r", "(SELECT * FROM cues WHERE speaker NOT IN ('?', 'NONSPEECH'))", "media_id", "start_ms, end_ms, idx", "start_ms >= reach") + "\nSELECT media_id, run AS island, count(*) AS n, count(DISTINCT speaker) AS n_speakers, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r GROUP BY media_id, run"),
    "j3_preceding_context": X.query(X.LINES, X.SCENES, "done AS (SELECT 1)\nSELECT l.media_id, s.scene_id, l.idx FROM scenes s JOIN lines l ON l.media_id = s.media_id AND l.idx < s.start_idx AND l.end_ms >= greatest(0, s.start_ms - 15000) AND l.start_ms < s.start_ms"),
    "j4_map_scenes": X.query(X.LINES, X.SCENES, _J4 + "\nSELECT media_id, scene_id, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n_cues FROM h GROUP BY ALL"),
    "j4_scene_errors": X.query(X.LINES, X.SCENES, _J4 + """
SELECT media_id, 'cue in several scenes' AS error, idx AS id FROM h GROUP BY media_id, idx HAVING count(*) > 1
UNION ALL SELECT media_id, 'cue in no scene', idx FROM lines l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.media_id = l.media_id AND h.idx = l.idx)
UNION ALL SELECT media_id, 'empty scene', scene_id FROM sc s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.media_id = s.media_id AND h.scene_id = s.scene_id)"""),
    "j4_partial_errors": X.query(X.LINES, X.SCENES, _J4 + """
SELECT media_id, 'cue in several scenes' AS error, idx AS id FROM h GROUP BY media_id, idx HAVING count(*) > 1
UNION ALL SELECT media_id, 'empty scene', scene_id FROM sc s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.media_id = s.media_id AND h.scene_id = s.scene_id)"""),
    "w6_continuous_clock": X.query(X.LINES, X.SCENES, _ON, _CLOCK + "\nSELECT c.media_id, c.batch_id, c.scene_id, c.idx, c.start_ms - k.start_ms + o AS clock_start_ms, c.end_ms - k.start_ms + o AS clock_end_ms FROM bc c JOIN ck k USING (media_id, batch_id, scene_id)"),
    "w6_continuous_scenes": X.query(X.LINES, X.SCENES, _CLOCK + "\nSELECT media_id, batch_id, scene_id, o AS batch_start_ms, o + end_ms - start_ms AS batch_end_ms FROM ck"),
    "w6_scenes_on_clock": X.query(X.LINES, _ON, WINDOWS, """cl AS (SELECT b.media_id, b.batch_id, b.scene_id, b.start_ms + arg_min(offset_ms - win.start_ms, window_id) AS a, b.end_ms + arg_min(offset_ms - win.start_ms, window_id) AS z
  FROM bc b JOIN win ON win.media_id = b.media_id AND win.batch_id = b.batch_id AND b.start_ms >= win.start_ms AND b.end_ms <= win.end_ms GROUP BY b.media_id, b.batch_id, b.scene_id, b.idx, b.start_ms, b.end_ms)
SELECT media_id, batch_id, scene_id, min(a) AS batch_start_ms, max(z) AS batch_end_ms FROM cl GROUP BY ALL"""),
    "j5_a16_attach_segments": _j5_sql(0),
    "j5_a16_attach_shifted": _j5_sql(10000),
    "j17_drop_cross_speaker": X.query(X.CUES, _CONFLICT.format(t=200) + "\nSELECT media_id, idx, speaker, start_ms, end_ms FROM calm"),
    "f4_bucket": X.query(X.CUES, f"done AS (SELECT 1)\nSELECT media_id, idx, {_FOLDED} AS bucket, CASE WHEN speaker = '?' THEN 'unknown' WHEN {_FOLDED} NOT IN ('click', 'view', 'NONSPEECH') THEN 'not in targets' END AS dropped_for FROM cues"),
    "f5_min_duration": X.query(X.CUES, CLIPS, _OVER, f"done AS ({_FOLD.format(run='run', runs='runs')})\n{_COLS} done WHERE end_ms - start_ms >= 2000"),
    "t2_first_per_speaker": X.query(X.CUES, CLIPS + "\nSELECT media_id, speaker, entry_idx, start_ms FROM clips QUALIFY row_number() OVER (PARTITION BY media_id, speaker ORDER BY start_ms, end_ms, entry_idx) <= 5"),
    "p12_clip_window": P12, "j5_label_map": J5M,
}
