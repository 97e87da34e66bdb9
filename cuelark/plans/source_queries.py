"""Queries of sources and sinks: the given tables are rendered in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..scratch import drop_at_exit, shared_dir
from ..sources import files
from ..sources import subtitles as S
from ..sources import tables as B
from . import fixtures as X
from . import interval_queries


def _cues(spark, d):
    return X.cues(spark, d).withColumn("source_entries", F.array(F.col("src").cast("int")))


def s1(spark, d):
    """V5 as well: written as SRT, read again."""
    r = S.parse_srt(S.render_srt(_cues(spark, d)))
    return r.select("media_id", "idx", "start_ms", "end_ms", "speaker", F.array_join("tags", ",").alias("tags"), "text", "_corrupt")


S1 = X.query(X.CUES + "\nSELECT media_id, idx, start_ms, end_ms, speaker, CASE WHEN is_multi THEN 'MULTI' ELSE '' END AS tags, text, NULL AS _corrupt FROM cues")


def s2(spark, d):
    """Strict reading; some blocks are broken on purpose."""
    c = X.cues(spark, d).withColumn("idx", F.when(F.col("src") % 53 == 0, F.col("idx") - 1).otherwise(F.col("idx")))
    c = c.withColumn("end_ms", F.when(F.col("src") % 59 == 0, F.col("start_ms")).otherwise(F.col("end_ms"))).where("text <> ''")
    texts = S.render_srt(c, labelled=False)
    # an index with a sign or a blank is none, and so is a time without its blanks
    texts = texts.withColumn("content", F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r"(?m)^(\d*7)$", "+$1"), r"(?m)^(\d*8)$", "$1 "), r"(?m)^(\S*,\d\d9) --> ", "$1-->"))
    r = S.parse_srt(texts, "strict")
    return r.groupBy("media_id", F.coalesce("_corrupt", F.lit("ok")).alias("result")).agg(F.count("*").alias("n"))


S2 = X.query(X.CUES, """c AS (SELECT media_id, CASE WHEN src % 53 = 0 THEN idx - 1 ELSE idx END AS idx, start_ms, CASE WHEN src % 59 = 0 THEN start_ms ELSE end_ms END AS end_ms FROM cues WHERE text <> ''),
b AS (SELECT *, idx % 10 IN (7, 8) AS odd FROM c),
k AS (SELECT *, NOT odd AND count(*) OVER (PARTITION BY media_id, odd, idx) > 1 AS twice FROM b)
SELECT media_id, CASE WHEN odd THEN 'idx' WHEN start_ms % 10 = 9 THEN 'time line' WHEN end_ms <= start_ms THEN 'end before start' WHEN twice THEN 'idx repeated' ELSE 'ok' END AS result, count(*) AS n FROM k GROUP BY ALL""")


def s3(spark, d):
    s = X.scenes(spark, d).select("media_id", F.col("scene_id").cast("int").alias("idx"), "start_ms", "end_ms", F.when(F.col("scene_id") % 3 != 0, F.concat(F.lit("scene "), F.col("scene_id").cast("string"))).otherwise("").alias("text"), F.array().cast("array<string>").alias("tags"), F.lit("").alias("speaker"))
    return S.parse_srt(S.render_srt(s, labelled=False).withColumn("content", F.concat(F.lit("﻿"), F.replace("content", F.lit("\n"), F.lit("\r\n")))), "scene").select("media_id", "idx", "start_ms", "end_ms", "text", "_corrupt")


S3 = X.query(X.LINES, X.SCENES + "\nSELECT media_id, CAST(scene_id AS INTEGER) AS idx, start_ms, end_ms, CASE WHEN scene_id % 3 <> 0 THEN 'scene ' || scene_id ELSE 'scene_' || lpad(CAST(scene_id AS VARCHAR), 4, '0') END AS text, NULL AS _corrupt FROM scenes")


def s4(spark, d):
    r = S.from_json_lines(S.to_json_lines(_cues(spark, d)))
    return r.select("media_id", "idx", "start_ms", "end_ms", "speaker", F.array_join("tags", ",").alias("tags"), "text", F.col("source_entries")[0].alias("src"))


S4 = X.query(X.CUES + "\nSELECT media_id, idx, start_ms, end_ms, speaker, CASE WHEN is_multi THEN 'MULTI' ELSE '' END AS tags, text, CAST(src AS INTEGER) AS src FROM cues")


def ass_lines(spark, d):
    """An ASS file a media: header, styles, then an event a cue; every tenth event is a comment, every 61st has a bad time, every 67th too few fields."""
    from ..functions.text import ass_time

    c = X.cues(spark, d)
    kind = F.when(F.col("src") % 10 == 0, "Comment").otherwise("Dialogue")
    start = F.when(F.col("src") % 61 == 0, "x").otherwise(ass_time(F.col("start_ms")))
    event = F.concat(kind, F.lit(": 0,"), start, F.lit(","), ass_time(F.col("end_ms")), F.lit(",Default,"), F.col("speaker"), F.lit(",0,0,0,,"), F.col("text"), F.lit(", with, commas"))
    # every 67th lacks its text and what is before it
    event = F.when(F.col("src") % 67 == 0, F.concat(kind, F.lit(": 0,"), start, F.lit(","), ass_time(F.col("end_ms")), F.lit(",Default"))).otherwise(event)
    rows = c.select("media_id", (F.col("idx") + 10).alias("line_no"), event.alias("line"))
    head = ["[Script Info]", "Title: x", "[V4+ Styles]", "Format: Name, Fontname, Fontsize", "Style: Default,Any,20", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"]
    heads = c.select("media_id").distinct().select("media_id", F.posexplode(F.array(*map(F.lit, head))).alias("line_no", "line"))
    return rows.unionByName(heads)


def s6(spark, d):
    return S.parse_ass_dialogue(ass_lines(spark, d)).select("media_id", "line_no", "start_ms", "end_ms", "style", "text_raw")


_CS = "CAST(round_even({0} / 10.0, 0) AS BIGINT) * 10"
S6 = X.query(X.CUES + f"\nSELECT media_id, idx + 10 AS line_no, {_CS.format('start_ms')} AS start_ms, {_CS.format('end_ms')} AS end_ms, 'Default' AS style, text || ', with, commas' AS text_raw FROM cues WHERE src % 10 <> 0 AND src % 61 <> 0 AND src % 67 <> 0")


def s7(spark, d):
    return S.parse_ass_events(ass_lines(spark, d))[1].select("media_id", "line_no", "source_event_index", "event_type", "layer", "start_ms", "end_ms", "style", "name", "text_raw", "_corrupt")


S7 = X.query(X.CUES, "e AS (SELECT *, src % 67 = 0 AS few, CASE WHEN src % 67 = 0 THEN 'field count' WHEN src % 61 = 0 THEN 'time' END AS bad FROM cues)" + f"""
SELECT media_id, idx + 10 AS line_no, CASE WHEN bad IS NULL THEN row_number() OVER (PARTITION BY media_id, bad IS NULL ORDER BY idx) - 1 END AS source_event_index, CASE WHEN src % 10 = 0 THEN 'Comment' ELSE 'Dialogue' END AS event_type, CASE WHEN few THEN '' ELSE '0' END AS layer,
  CASE WHEN bad IS NULL THEN {_CS.format('start_ms')} END AS start_ms, CASE WHEN NOT few THEN {_CS.format('end_ms')} END AS end_ms, CASE WHEN few THEN '' ELSE 'Default' END AS style, CASE WHEN few THEN '' ELSE speaker END AS name, CASE WHEN few THEN '' ELSE trim(text || ', with, commas') END AS text_raw, bad AS _corrupt FROM e""")


def s7_styles(spark, d):
    return S.parse_ass_events(ass_lines(spark, d))[0].select("media_id", "line_no", F.col("fields")["name"].alias("name"), F.col("fields")["fontsize"].alias("fontsize"))


def s8(spark, d):
    """Each order is a container, each of its lines a stream."""
    li = X.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_suppkey") % 4).alias("k"), F.min("l_returnflag").alias("l_returnflag"))
    codec = F.when(F.col("k") < 2, "ass").when(F.col("k") == 2, "subrip").when(F.col("l_linenumber") == 1, "webvtt").when(F.col("l_linenumber") == 2, "mov_text").otherwise("hdmv_pgs_subtitle")
    stream = F.struct(F.col("l_linenumber").cast("int").alias("index"), F.when(F.col("l_returnflag") == "N", "audio").otherwise("subtitle").alias("codec_type"), codec.alias("codec_name"), F.struct(F.col("l_returnflag").alias("language"), F.concat(F.lit("t"), F.col("k").cast("string")).alias("title")).alias("tags"))
    docs = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(stream).alias("streams"))).alias("value")).select(F.col("l_orderkey").alias("media_id"), "value")
    return B.stream_catalog(docs).select("media_id", "stream_index", "subtitle_index", "codec_name", "language", "title", "support")


S8 = """SELECT l_orderkey AS media_id, CAST(l_linenumber AS INTEGER) AS stream_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS subtitle_index,
 CASE WHEN k < 2 THEN 'ass' WHEN k = 2 THEN 'subrip' WHEN l_linenumber = 1 THEN 'webvtt' WHEN l_linenumber = 2 THEN 'mov_text' ELSE 'hdmv_pgs_subtitle' END AS codec_name, l_returnflag AS language, 't' || k AS title,
 CASE WHEN k < 2 THEN 'prepare' WHEN k = 2 THEN 'extracted_only' ELSE 'inspect_only' END AS support FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey % 4) AS k, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) WHERE l_returnflag <> 'N'"""


ENDINGS = ("mkv", "ass", "json", "txt", "wav", "srt", "ts", "vtt", "flv", "aac", "wma", "m4v")


def s9(spark, d):
    """Three files a project; every 13th is the alias file, other .json files are none."""
    k = F.col("c_custkey")
    name = F.when(k % 13 == 0, "speaker_aliases.json").otherwise(F.concat(F.lit("f"), k.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, ENDINGS)), (k % 12 + 1).cast("int"))))
    files = X.table(spark, d, "customer").select(F.concat(F.lit("/data/p"), F.expr("c_custkey div 3").cast("string"), F.lit("/"), name).alias("path"))
    return B.project_catalog(files)


# videos, audio and subtitles by the endings a project may hold
S9 = """WITH f AS (SELECT 'p' || c_custkey // 3 AS project, '/data/p' || c_custkey // 3 || '/' || CASE WHEN c_custkey % 13 = 0 THEN 'speaker_aliases.json' ELSE 'f' || c_custkey || '.' || (['mkv', 'ass', 'json', 'txt', 'wav', 'srt', 'ts', 'vtt', 'flv', 'aac', 'wma', 'm4v'])[c_custkey % 12 + 1] END AS path FROM customer),
t AS (SELECT *, CASE WHEN ends_with(path, '/speaker_aliases.json') THEN 'alias' WHEN regexp_matches(path, '[.](mkv|wav|ts|flv|aac|wma|m4v)$') THEN 'media' WHEN regexp_matches(path, '[.](ass|srt|vtt)$') THEN 'subtitle' END AS kind FROM f),
g AS (SELECT project, count(*) FILTER (WHERE kind = 'media') AS n_media, count(*) FILTER (WHERE kind = 'subtitle') AS n_subtitle, min(path) FILTER (WHERE kind = 'media') AS media, min(path) FILTER (WHERE kind = 'subtitle') AS subtitle, min(path) FILTER (WHERE kind = 'alias') AS aliases FROM t WHERE kind IS NOT NULL GROUP BY project)
SELECT *, CASE WHEN n_media = 0 THEN 'missing media' WHEN n_media > 1 THEN 'ambiguous media' WHEN n_subtitle > 1 THEN 'ambiguous subtitle' WHEN n_subtitle = 0 THEN 'missing subtitle' ELSE 'ok' END AS status FROM g"""


def _files(spark, d):
    return X.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))


def s10(spark, d):
    return B.manifest(_files(spark, d))


S10 = "SELECT CAST(doc_id AS VARCHAR) AS path, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents"


def s10_verify(spark, d):
    k = F.col("path").cast("long")
    new = _files(spark, d).where(k % 7 != 0).withColumn("content", F.when(k % 5 == 0, F.encode(F.lit("x"), "utf-8")).otherwise(F.col("content")))
    return B.verify_manifest(B.manifest(_files(spark, d)), B.manifest(new))


def segment_docs(spark, d):
    """A document a media, its duration in one of three places; every fourth is whole, the others end before their last segments. Every fifth has a label of another kind."""
    s = X.segments(spark, d)
    label = F.when((F.col("media_id") % 5 == 0) & (F.col("speaker") == "SPK3"), "HOST").otherwise(F.concat(F.lit("SPEAKER_0"), (F.substring("speaker", 4, 1).cast("int") - 1).cast("string")))
    seg = F.struct((F.col("start_ms") / 1000).alias("start"), (F.when(F.col("media_id") % 4 == 0, F.greatest("end_ms", F.col("start_ms") + 1)).otherwise(F.col("end_ms")) / 1000).alias("end"), label.alias("speaker"))
    g = s.groupBy("media_id").agg(F.collect_list(seg).alias("segments"), (F.max("end_ms") / 1000 + F.when(F.col("media_id") % 4 == 0, 1).otherwise(-50)).alias("dur"))
    k = F.col("media_id") % 3
    body = F.to_json(F.struct(F.when(k == 0, F.struct(F.col("dur").alias("duration"))).alias("audio"), F.when(k == 1, F.col("dur")).alias("duration"), F.when(k == 2, F.col("dur")).alias("audio_duration"), "segments"))
    return g.select("media_id", body.alias("value"))


def s11(spark, d):
    audio, segs, _ = B.parse_segments(segment_docs(spark, d))
    return segs.groupBy("media_id", "speaker", "valid").agg(F.count("*").alias("n"), F.sum(F.round(F.col("start_s") * 1000).cast("long")).alias("sum_start")).join(audio, "media_id")


def s11_errors(spark, d):
    return B.parse_segments(segment_docs(spark, d))[2]


_SEG = """sg AS (SELECT media_id, start_ms, CASE WHEN media_id % 4 = 0 THEN greatest(end_ms, start_ms + 1) ELSE end_ms END AS end_ms, CASE WHEN media_id % 5 = 0 AND speaker = 'SPK3' THEN 'HOST' ELSE speaker END AS speaker FROM segs),
a AS (SELECT media_id, max(end_ms) / 1000 + CASE WHEN media_id % 4 = 0 THEN 1 ELSE -50 END AS duration_s FROM segs GROUP BY media_id),
w AS (SELECT sg.*, duration_s, CASE WHEN NOT (start_ms < end_ms AND end_ms / 1000 <= duration_s) THEN 'segment range' WHEN speaker = 'HOST' THEN 'segment speaker' END AS wrong FROM sg JOIN a USING (media_id))"""
S11 = X.query(X.CUES, X.SEGMENTS, _SEG + "\nSELECT media_id, speaker, wrong IS NULL AS valid, count(*) AS n, sum(start_ms) AS sum_start, duration_s FROM w GROUP BY ALL")
S11E = X.query(X.CUES, X.SEGMENTS, _SEG + "\nSELECT media_id, CASE WHEN duration_s <= 0 THEN 'duration' ELSE min(wrong) END AS error FROM w GROUP BY media_id, duration_s HAVING duration_s <= 0 OR min(wrong) IS NOT NULL")


def groups(spark, d):
    """Customers in groups of ten: a small file each."""
    return X.table(spark, d, "customer").select(F.expr("c_custkey div 10").alias("media_id"), (F.col("c_custkey") % 10).cast("int").alias("k"), "c_name", "c_custkey")


GROUPS = "gr AS (SELECT c_custkey // 10 AS media_id, CAST(c_custkey % 10 AS INTEGER) AS k, c_name, c_custkey FROM customer)"


def map_lines(spark, d):
    g, k, r = groups(spark, d), F.col("k"), F.col("media_id") % 7
    line = F.when((k == 0) & (r == 1), "; no header").when(k == 0, "[speakers]").when((k == 5) & (r == 3), "[other]").when((k == 5) & (r == 4), "[DEFAULT]").when((k == 6) & (r == 5), "X1 = a").when((k == 7) & (r == 6), "SPK7 = <b>").when((k == 9) & (r == 2), "SPK1 = again").when(k == 4, "# a remark = none").when(k == 8, "SPK8 =")
    return g.select("media_id", k.cast("long").alias("line_no"), line.otherwise(F.concat(F.lit("SPK"), k.cast("string"), F.lit(" = "), "c_name", F.lit(" 100%"))).alias("line"))


def s12(spark, d):
    return B.parse_label_map(map_lines(spark, d))[0]


def s12_errors(spark, d):
    return B.parse_label_map(map_lines(spark, d))[1]


# a group may be cut before its bad line
S12 = f"WITH {GROUPS} SELECT media_id, 'SPK' || k AS speaker, c_name || ' 100%' AS label FROM gr WHERE k NOT IN (0, 4, 8) AND media_id % 7 <> 1 AND NOT EXISTS (SELECT 1 FROM gr b WHERE b.media_id = gr.media_id AND ((b.k = 5 AND b.media_id % 7 = 3) OR (b.k = 6 AND b.media_id % 7 IN (4, 5)) OR (b.k = 7 AND b.media_id % 7 = 6) OR (b.k = 9 AND b.media_id % 7 = 2)))"
S12E = f"WITH {GROUPS} SELECT DISTINCT media_id, CASE WHEN media_id % 7 = 1 THEN 'no section' WHEN media_id % 7 = 2 THEN 'key twice' WHEN media_id % 7 = 3 THEN 'sections' WHEN media_id % 7 = 4 THEN 'defaults' WHEN media_id % 7 = 5 THEN 'key' ELSE 'label' END AS error FROM gr WHERE (k > 0 AND media_id % 7 = 1) OR (k = 5 AND media_id % 7 = 3) OR (k = 6 AND media_id % 7 IN (4, 5)) OR (k = 7 AND media_id % 7 = 6) OR (k = 9 AND media_id % 7 = 2)"


def _joined(c, order="k"):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c.alias("x")))), lambda i: i["x"]), ",")


def s13(spark, d):
    """Comments of any kind, values that are no lists, members that are no texts, and a variant that every name has."""
    entry = F.concat(F.lit('"C'), F.col("k").cast("string"), F.lit('":["'), "c_name", F.lit('(kana)",7,null,"shared"]'))
    doc = groups(spark, d).groupBy("media_id").agg(F.concat(F.lit('{"_comment":"words","_notes":{"a":["x"]},"plain":"text",'), _joined(entry), F.lit("}")).alias("value"))
    return B.parse_aliases(doc)


S13 = f"WITH {GROUPS} SELECT media_id, c_name AS variant, 'C' || k AS canonical FROM gr UNION ALL SELECT media_id, 'shared', 'C' || max(k) FROM gr GROUP BY media_id"


def s14(spark, d):
    n = F.col("k").cast("string")
    note = F.when(F.col("k") % 3 == 0, "请在此填入 later").when(F.col("k") % 3 == 1, "calm").otherwise("")
    entry = F.concat(F.lit('"R'), n, F.lit('":{"name_ja":"'), "c_name", F.lit('","age":'), F.when(F.col("k") == 2, "null").otherwise(n), F.lit(',"gender":"x","role":"","catchphrases":["oh","ah"],"notes":"'), note, F.lit('","appearance":{"summary":"tall","avoid_mistakes":["a","b"],"visual_cues":{"hair":"red"},"forms":["f1","f2"]}}'))
    doc = groups(spark, d).groupBy("media_id").agg(F.concat(F.lit('{"_speaker_identification_rules":["one","two"],"_story_context":{"act":"first"},"_other":1,'), _joined(entry), F.lit("}")).alias("value"))
    return B.role_prompts(doc, "selected", ("story", "forms"))


S14 = f"""WITH {GROUPS} SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY k) + 2 AS INTEGER) AS pos, 'R' || k AS label, '[R' || k || '] | name: ' || c_name || ' | context only, age: ' || CASE WHEN k = 2 THEN 'unknown' ELSE CAST(k AS VARCHAR) END || ' | context only, gender: x | speaker evidence, catchphrases: oh, ah | weak visual evidence: tall | often mistaken: a; b | further weak visual evidence, forms: f1; f2' ||
  CASE WHEN k % 3 = 1 THEN ' | context only, notes: calm' ELSE '' END AS line FROM gr
UNION ALL SELECT DISTINCT media_id, -2, '_speaker_identification_rules', 'rules: one; two' FROM gr UNION ALL SELECT DISTINCT media_id, -1, '_story_context', 'context only, story: act: first' FROM gr"""


def s15(spark, d):
    """Written by the sink, read again; some indexes are no numbers."""
    s = X.scenes(spark, d)
    rows = s.select("media_id", F.col("scene_id").cast("int").alias("scene_id"), "enabled", F.lit("n").alias("name"), F.when(F.col("scene_id") % 4 == 0, "x").otherwise(F.col("start_idx").cast("string")).alias("start_idx"), F.col("end_idx").cast("string").alias("end_idx"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    return B.parse_scenes(B.render_scenes(rows)).select("media_id", "scene_id", "start_idx", "end_idx", "start", "end")


S15 = X.query(X.LINES, X.SCENES + "\nSELECT media_id, CAST(scene_id AS INTEGER) AS scene_id, start_idx, end_idx, start_ms / 1000 AS start, end_ms / 1000 AS end FROM scenes WHERE enabled AND scene_id % 4 <> 0")


def s16(spark, d):
    p = X.preds(spark, d)
    e = F.struct(F.col("pid").cast("int").alias("idx"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", F.col("speaker").alias("speaker_in_srt"))
    once = F.struct(F.col("pid").cast("string").alias("idx"), F.lit("early").alias("speaker"), F.lit("early").alias("speaker_raw"), F.lit("LOW").alias("confidence"))
    last = F.struct(F.col("pid").cast("string").alias("idx"), "speaker", F.col("speaker").alias("speaker_raw"), F.upper("confidence").alias("confidence"))
    rows = p.withColumn("b", F.expr("(pid - 1) div 4")).groupBy("media_id", "b").agg(F.to_json(F.struct(F.collect_list(e).alias("entries"), F.flatten(F.collect_list(F.when(F.col("pid") % 3 == 0, F.array(once, last)).when(F.col("pid") % 5 != 0, F.array(last)))).alias("results"))).alias("value"))
    return B.parse_results(rows, ["user", "assistant"]).select("media_id", "idx", "start_ms", "end_ms", "speaker", "speaker_raw", "confidence", "input_speaker")


S16 = X.query(X.LINES, X.PREDS + """
SELECT media_id, CAST(pid AS INTEGER) AS idx, start_ms, end_ms, CASE WHEN pid % 5 = 0 AND pid % 3 <> 0 THEN '?' WHEN speaker IN ('user', 'assistant') THEN speaker ELSE 'OTHER' END AS speaker,
 CASE WHEN pid % 5 = 0 AND pid % 3 <> 0 THEN '?' ELSE speaker END AS speaker_raw, CASE WHEN pid % 5 = 0 AND pid % 3 <> 0 THEN 'unknown' ELSE confidence END AS confidence, speaker AS input_speaker FROM preds""")


ACTS = ("keep_dialogue", "drop_translation", "drop_lyrics", "drop_screen", "drop_annotation", "drop_title", "drop_staff", "drop_comment", "review", "burn")


def policies(spark, d):
    """A policy a group of customers; by its number one has no styles, a wrong version, another rule for unknown styles, or no source."""
    r = F.col("media_id") % 5
    entry = F.concat(F.lit('"'), "c_name", F.lit('":"'), F.element_at(F.array(*map(F.lit, ACTS)), F.col("k") + 1), F.lit('"'))
    g = groups(spark, d).groupBy("media_id").agg(_joined(entry).alias("styles"))
    text = F.concat(F.lit('{"schema_version":'), F.when(r == 1, "2").otherwise("1"), F.lit(',"unknown_style":"'), F.when(r == 2, "drop").otherwise("error"), F.lit('","event_types":{"Comment":"drop_comment","Picture":"hide"},"expected":{"kept_events":'), F.col("media_id").cast("string"), F.lit('},"styles":{'), F.when(r == 3, "").otherwise(F.col("styles")), F.lit("}"), F.when(r == 4, "").otherwise(F.concat(F.lit(',"source":{"stream_index":'), (F.col("media_id") % 4).cast("string"), F.lit(',"expected_codec":"ass","expected_title":"t"}'))), F.lit("}"))
    return g.select("media_id", text.alias("value"))


def s18(spark, d):
    return B.parse_policy(policies(spark, d))[0]


def s18_settings(spark, d):
    return B.parse_policy(policies(spark, d))[1].select("media_id", "kept_events", "review_events", "stream_index", "problem")


def s18_streams(spark, d):
    """Three streams a group: the first as expected, the second of another codec, the third of another title; the fourth is not there."""
    settings = B.parse_policy(policies(spark, d))[1].where("stream_index IS NOT NULL")
    streams = groups(spark, d).select("media_id").distinct().select("media_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("stream_index"))
    streams = streams.withColumns({"codec_name": F.when(F.col("stream_index") == 1, "subrip").otherwise("ass"), "title": F.when(F.col("stream_index") == 2, "u").otherwise("t")})
    return B.select_streams(settings, streams)


S18 = f"""WITH {GROUPS} SELECT media_id, 'style' AS kind, c_name AS name, ([{', '.join(repr(x) for x in ACTS)}])[k + 1] AS action, CASE WHEN k = 9 THEN 'action' END AS problem FROM gr WHERE media_id % 5 <> 3
UNION ALL SELECT DISTINCT media_id, 'event type', 'Comment', 'drop_comment', NULL FROM gr UNION ALL SELECT DISTINCT media_id, 'event type', 'Picture', 'hide', 'action' FROM gr"""
S18S = f"WITH {GROUPS} SELECT DISTINCT media_id, CAST(media_id AS INTEGER) AS kept_events, CAST(NULL AS INTEGER) AS review_events, CASE WHEN media_id % 5 <> 4 THEN CAST(media_id % 4 AS INTEGER) END AS stream_index, CASE media_id % 5 WHEN 1 THEN 'schema_version' WHEN 2 THEN 'unknown_style' WHEN 3 THEN 'no styles' WHEN 4 THEN 'source' END AS problem FROM gr"
S18T = f"WITH {GROUPS} SELECT DISTINCT media_id, CAST(media_id % 4 AS INTEGER) AS stream_index, CASE media_id % 4 WHEN 1 THEN 'codec' WHEN 2 THEN 'title' WHEN 3 THEN 'not found once' END AS problem FROM gr WHERE media_id % 5 <> 4"


def s19(spark, d):
    return B.training_manifest(I.merge_overlap(interval_queries.clips(spark, d)))


# the name's own rule is p9_file_name's
S19 = X.query(X.CUES, interval_queries.CLIPS, interval_queries._OVER, f"done AS ({interval_queries._FOLD.format(run='run', runs='runs')})", r"""n AS (SELECT *, row_number() OVER (PARTITION BY media_id, speaker ORDER BY start_ms, end_ms, entry_idx) AS o, CAST(round_even(start_ms / 10.0, 0) AS BIGINT) AS cs,
  substring(regexp_replace(split_part(excerpt, ' / ', 1), '[\s]+', '_', 'g'), 1, 20) AS what FROM done)
SELECT media_id, speaker, lpad(CAST(o AS VARCHAR), 4, '0') || '_' || regexp_replace(speaker, '[\\/:*?"<>|]+', '_', 'g') || '_' || printf('%d-%02d-%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) || '_' || CASE WHEN what = '' THEN '_' ELSE what END || '|' || speaker || '|' || full_text AS value FROM n WHERE full_text <> ''""")


def _written(spark, write):
    """The path of a scratch folder that `write` filled."""
    path = shared_dir(spark)
    write(path)
    drop_at_exit(spark, path)
    return path


def s5_files(spark, d):
    """A labelled file a media through the sink, read again by path."""
    path = _written(spark, lambda p: S.write_srt(_cues(spark, d), p))
    r = S.read_srt(spark, path)
    return r.select(F.col("media_id").cast("long").alias("media_id"), "idx", "start_ms", "end_ms", "speaker", F.array_join("tags", ",").alias("tags"), "text", "_corrupt")


def s6_files(spark, d):
    """An ASS file a media, read by path: lines are numbered from 1 as they are in the file."""
    lines = ass_lines(spark, d).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("i"))
    path = _written(spark, lambda p: files.write_files(lines.select(F.concat(F.col("media_id").cast("string"), F.lit(".ass")).alias("name"), F.array_join(F.transform("i", lambda x: x["line"]), "\n").alias("content")), p))
    return S.read_ass_dialogue(spark, path).select(F.col("media_id").cast("long").alias("media_id"), "line_no", "start_ms", "end_ms", "style", "text_raw")


# seven lines stand before the events
S6F = S6.replace("idx + 10 AS line_no", "idx + 7 AS line_no")


def s19_files(spark, d):
    """Manifests of all speakers through the sink: the lines of each file, in order."""
    path = _written(spark, lambda p: B.write_training_manifest(I.merge_overlap(interval_queries.clips(spark, d)), p))
    lines = files.read_lines(spark, path, media=lambda p: F.regexp_extract(p, r"([^/]+/[^/]+)/[^/]+$", 1))
    return lines.select(F.split("media_id", "/")[0].cast("long").alias("media_id"), F.split("line", r"\|")[1].alias("speaker"), F.col("line_no").cast("long").alias("line_no"), F.col("line").alias("value"))


S19F = S19.replace("SELECT media_id, speaker, lpad(", "SELECT media_id, speaker, row_number() OVER (PARTITION BY media_id, speaker ORDER BY start_ms, end_ms, entry_idx) AS line_no, lpad(")


def p14(spark, d):
    return I.to_clips(X.cues(spark, d)).select("media_id", "entry_idx", "kind", "excerpt", "full_text")


P14 = X.query(X.CUES + "\nSELECT media_id, idx AS entry_idx, CASE WHEN is_multi THEN 'multi' ELSE 'single' END AS kind, substring(text, 1, 60) AS excerpt, text AS full_text FROM cues")


def p16(spark, d):
    return I.rebase(X.cues(spark, d), -1000, 5, 300).select("media_id", "idx", "start_ms", "end_ms", "text")


P16 = X.query(X.CUES + "\nSELECT media_id, idx, start_ms - 1000 AS start_ms, end_ms - 1000 AS end_ms, regexp_replace(text, '^[^ ]+ ', '') AS text FROM cues WHERE idx BETWEEN 5 AND 300")

QUERIES = {"s5_srt_files": s5_files, "s6_ass_files": s6_files, "s19_manifest_files": s19_files, "s1_s5_v5_srt_round_trip": s1, "s2_strict_srt": s2, "s3_scene_srt": s3, "s4_cue_json_lines": s4, "s6_ass_dialogue": s6, "s7_ass_events": s7, "s7_styles": s7_styles, "s11_segment_errors": s11_errors, "s12_map_errors": s12_errors, "s18_settings": s18_settings, "s18_streams": s18_streams, "s8_stream_catalog": s8, "s9_project_catalog": s9, "s10_manifest": s10, "s10_verify_manifest": s10_verify, "s11_segments": s11, "s12_label_map": s12, "s13_aliases": s13, "s14_roles": s14, "s15_scene_json": s15, "s16_s17_results": s16, "s18_policy": s18, "s19_training_manifest": s19, "p14_to_clips": p14, "p16_rebase": p16}
ORACLES = {"s5_srt_files": S1, "s6_ass_files": S6F, "s19_manifest_files": S19F, "s1_s5_v5_srt_round_trip": S1, "s2_strict_srt": S2, "s3_scene_srt": S3, "s4_cue_json_lines": S4, "s6_ass_dialogue": S6, "s7_ass_events": S7, "s7_styles": X.query(X.CUES + "\nSELECT DISTINCT media_id, 4 AS line_no, 'Default' AS name, '20' AS fontsize FROM cues"), "s11_segment_errors": S11E, "s12_map_errors": S12E, "s18_settings": S18S, "s18_streams": S18T, "s19_training_manifest": S19, "s8_stream_catalog": S8, "s9_project_catalog": S9, "s10_manifest": S10, "s10_verify_manifest": "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0", "s11_segments": S11, "s12_label_map": S12, "s13_aliases": S13, "s14_roles": S14, "s15_scene_json": S15, "s16_s17_results": S16, "s18_policy": S18, "p14_to_clips": P14, "p16_rebase": P16}
