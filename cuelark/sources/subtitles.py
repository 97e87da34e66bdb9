"""Subtitle files: labelled, strict and scene SRT, ASS dialogue and events, cue JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ass_ms, prediction_label, srt_ms, srt_time, strip
from .files import lines_of, read_files, read_lines, readable, write_files

TIMES = r"^(\d{1,3}:\d{2}:\d{2},\d{3})\s*-->\s*(\d{1,3}:\d{2}:\d{2},\d{3})"
STRICT = r"^([0-9]{2,}:[0-5][0-9]:[0-5][0-9],[0-9]{3})[ \t]+-->[ \t]+([0-9]{2,}:[0-5][0-9]:[0-5][0-9],[0-9]{3})$"


def blocks(texts: DataFrame) -> DataFrame:
    """(media_id, pos, lines) of blocks between blank lines; BOM and CRLF accepted."""
    plain = F.regexp_replace(F.replace(F.regexp_replace("content", "^﻿", ""), F.lit("\r\n"), F.lit("\n")), r"\r", "\n")
    parts = F.split(F.regexp_replace(plain, r"^\n+|\n+$", ""), r"\n\s*\n")
    rows = texts.select("media_id", F.posexplode(parts).alias("pos", "block")).where(F.trim("block") != "")
    return rows.select("media_id", "pos", F.split("block", "\n").alias("lines"))


def parse_srt(texts: DataFrame, mode: str = "labelled", failfast: bool = False) -> DataFrame:
    """Cues of texts(media_id, content); a block that does not parse has its reason in `_corrupt`.

    labelled: `[speaker] {TAG}* text`; strict: idx of digits alone, plain text, idx unique, end after start; scene: idx is the scene, text
    its name, its lines joined, or scene_0001 and so on where there is none."""
    b = blocks(texts)
    n, first = F.size("lines"), F.col("lines")[0]
    rest = F.array_join(F.slice("lines", 3, F.greatest(F.lit(0), n - 2)), "\n")
    times = STRICT if mode == "strict" else TIMES
    t = F.when(n >= 2, F.col("lines")[1])
    a, z = srt_ms(F.regexp_extract(t, times, 1)), srt_ms(F.regexp_extract(t, times, 2))
    idx = F.when(first.rlike("^[0-9]+$"), first.try_cast("int")) if mode == "strict" else F.trim(first).try_cast("int")
    head = r"(?s)^\[([^\]]*)\]\s*((?:\{[^{}]*\}\s*)*)(.*)$"
    cues = b.select("media_id", "pos", idx.alias("idx"), a.alias("start_ms"), z.alias("end_ms"), rest.alias("body"), n.alias("n"))
    bad = F.when(F.col("idx").isNull(), "idx").when(F.col("n") < (2 if mode == "scene" else 3), "too short").when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "time line")
    if mode == "labelled":
        bad = bad.when(~F.col("body").rlike(head), "no [speaker]")
        tags = F.regexp_extract_all(F.regexp_extract("body", head, 2), F.lit(r"\{([^{}]*)\}"), 1)
        text = F.regexp_replace(F.regexp_extract("body", head, 3), r"^[ \t]+|^\n", "")
        cues = cues.withColumns({"speaker": F.trim(F.regexp_extract("body", head, 1)), "tags": F.transform(tags, F.trim), "text": text})
    else:
        repeated = F.count("*").over(Window.partitionBy("media_id", "idx")) > 1
        late = F.lag("start_ms").over(Window.partitionBy("media_id").orderBy("pos")) > F.col("start_ms")
        bad = bad.when((F.trim("body") == "") & F.lit(mode != "scene"), "blank").when(F.col("end_ms") < F.col("start_ms") if mode == "scene" else F.col("end_ms") <= F.col("start_ms"), "end before start").when(repeated, "idx repeated")
        lines = F.filter(F.transform(F.split("body", r"\n"), strip), lambda x: x != "")
        named = F.when(F.size(lines) > 0, F.array_join(lines, " ")).otherwise(scene_name(F.col("idx")))
        if mode == "scene":
            bad = bad.when(late, "start order")
        cues = cues.withColumn("text", named if mode == "scene" else F.col("body"))
    cues = cues.withColumn("_corrupt", bad).drop("body", "n", "pos")
    if failfast:
        cues = cues.withColumn("idx", F.when(F.col("_corrupt").isNull(), F.col("idx")).otherwise(F.raise_error(F.concat(F.lit("bad block: "), F.col("_corrupt"))).cast("int")))
    return cues


def read_srt(spark: SparkSession, path: str, mode: str = "labelled", failfast: bool = False) -> DataFrame:
    """parse_srt of the files at or below a path, media_id their names without endings; a file that is not UTF-8 is one row with its reason in `_corrupt`."""
    files = read_files(spark, path, "*.srt")
    cues = parse_srt(readable(files, failfast).select("media_id", "content"), mode, failfast)
    return cues if failfast else cues.unionByName(files.where("_corrupt IS NOT NULL").select("media_id", "_corrupt"), allowMissingColumns=True)


def srt_block(labelled: bool = True) -> Column:
    head = F.concat(F.lit("["), F.col("speaker"), F.lit("]"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit(" {"), t, F.lit("}"))), ""))
    body = F.concat(head, F.when(F.col("text") == "", "").when(F.col("text").startswith("\n"), F.col("text")).otherwise(F.concat(F.lit(" "), F.col("text")))) if labelled else F.col("text")
    return F.concat_ws("\n", F.col("idx").cast("string"), F.concat_ws(" --> ", srt_time(F.col("start_ms")), srt_time(F.col("end_ms"))), body)


def render_srt(cues: DataFrame, labelled: bool = True) -> DataFrame:
    """(media_id, content): one text a media."""
    g = cues.withColumn("__b", srt_block(labelled)).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("idx", "__b"))).alias("i"))
    return g.select("media_id", F.concat(F.array_join(F.transform("i", lambda x: x["__b"]), "\n\n"), F.lit("\n")).alias("content"))


def _file(ending: str) -> Column:
    return F.concat(F.col("media_id").cast("string"), F.lit(ending)).alias("name")


def write_srt(cues: DataFrame, path: str, labelled: bool = True, mode: str = "error") -> int:
    """One file `<media_id>.srt` a media; see write_files."""
    return write_files(render_srt(cues, labelled).select(_file(".srt"), "content"), path, mode)


def write_scene_srt(scenes: DataFrame, path: str, mode: str = "error") -> int:
    """scenes(media_id, scene_id, name, start_ms, end_ms) as timelines: idx is the scene, text its name, or scene_0001 where it has none."""
    named = F.coalesce(F.nullif(strip(F.regexp_replace("name", r"(?U)\s+", " ")), F.lit("")), scene_name(F.col("scene_id")))
    return write_srt(scenes.select("media_id", F.col("scene_id").alias("idx"), "start_ms", "end_ms", named.alias("text")), path, False, mode)


def scene_name(scene_id: Column) -> Column:
    """What a scene without a name is called."""
    return F.concat(F.lit("scene_"), F.lpad(scene_id.cast("string"), F.greatest(F.lit(4), F.length(scene_id.cast("string"))), F.lit("0")))


CUE_JSON = "idx int, start double, end double, speaker string, tags array<string>, text string, source_entries array<int>"


def from_json_lines(rows: DataFrame) -> DataFrame:
    """Cues of rows(media_id, value): times to milliseconds, missing lists empty."""
    j = rows.select("media_id", F.from_json("value", CUE_JSON).alias("j")).select("media_id", "j.*")
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    return j.select("media_id", "idx", F.round(F.col("start") * 1000).cast("long").alias("start_ms"), F.round(F.col("end") * 1000).cast("long").alias("end_ms"), "speaker", none("tags", "string").alias("tags"), "text", none("source_entries", "int").alias("source_entries"))


def to_json_lines(cues: DataFrame, *beside: str) -> DataFrame:
    row = F.struct("idx", F.round(F.col("start_ms") / 1000, 3).alias("start"), F.round(F.col("end_ms") / 1000, 3).alias("end"), "speaker", "tags", "text", F.coalesce("source_entries", F.array().cast("array<int>")).alias("source_entries"))
    return cues.select("media_id", *beside, F.to_json(row).alias("value"))


def read_cues_jsonl(spark: SparkSession, path: str, failfast: bool = False) -> DataFrame:
    lines = readable(read_lines(spark, path, "*.jsonl"), failfast)
    return from_json_lines(lines.where(F.trim("line") != "").select("media_id", F.col("line").alias("value")))


def write_cues_jsonl(cues: DataFrame, path: str, mode: str = "error") -> int:
    """One file `<media_id>.jsonl` a media, a cue a line in order of idx."""
    rows = to_json_lines(cues, "idx").groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("i"))
    return write_files(rows.select(_file(".jsonl"), F.array_join(F.transform("i", lambda x: x["value"]), "\n").alias("content")), path, mode)


# ASS ------------------------------------------------------------------------------------------------------


def parse_ass_dialogue(lines: DataFrame) -> DataFrame:
    """Dialogue events of lines(media_id, line_no, line); lines with a bad time are left out."""
    parts = F.split(F.regexp_replace("line", r"^Dialogue:\s*", ""), ",", 10)
    d = lines.where(F.col("line").startswith("Dialogue:")).withColumn("p", parts).where(F.size("p") == 10)
    out = d.select("media_id", "line_no", ass_ms(F.col("p")[1]).alias("start_ms"), ass_ms(F.col("p")[2]).alias("end_ms"), F.col("p")[3].alias("style"), F.col("p")[9].alias("text_raw"))
    return out.where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())


def read_ass_dialogue(spark: SparkSession, path: str, failfast: bool = False) -> DataFrame:
    """parse_ass_dialogue of the .ass and .ssa files at or below a path."""
    return parse_ass_dialogue(readable(read_lines(spark, path, "*.{ass,ssa}"), failfast))


def read_ass_events(spark: SparkSession, path: str, failfast: bool = False) -> tuple[DataFrame, DataFrame]:
    """parse_ass_events of the .ass and .ssa files at or below a path. A file that is not UTF-8, or holds U+FFFD, is an event with nothing but its reason in `_corrupt`."""
    files = read_files(spark, path, "*.{ass,ssa}")
    files = files.withColumn("_corrupt", F.coalesce("_corrupt", F.when(F.contains("content", F.lit("\ufffd")), "replacement character")))
    styles, events = parse_ass_events(readable(lines_of(files.withColumn("content", F.when(F.col("_corrupt").isNull(), F.col("content")))), failfast))
    return styles, events if failfast else events.unionByName(files.where("_corrupt IS NOT NULL").select("media_id", "_corrupt"), allowMissingColumns=True)


def _ass_rows(lines: DataFrame) -> DataFrame:
    """Style, Dialogue and Comment lines in their sections, with the columns of the section's latest Format line, or the reason they are bad."""
    w = Window.partitionBy("media_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.trim("line").rlike(r"^\[.*\]$"), F.lower(F.trim("line"))), ignorenulls=True).over(w)
    x = lines.withColumn("section", section)
    sw = Window.partitionBy("media_id", "section").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fmt = F.last(F.when(F.col("line").startswith("Format:"), F.transform(F.split(F.regexp_replace("line", r"^Format:", ""), ","), lambda c: F.lower(strip(c)))), ignorenulls=True).over(sw)
    x = x.withColumns({"fmt": fmt, "kind": F.regexp_extract("line", r"^(Dialogue|Comment|Style):", 1)})
    style = F.col("section").isin("[v4+ styles]", "[v4 styles]") & (F.col("kind") == "Style")
    # a style before its Format line is passed over, an event before one is an error
    rows = x.where((style & F.col("fmt").isNotNull()) | ((F.col("section") == "[events]") & F.col("kind").isin("Dialogue", "Comment")))
    parts = F.split(F.regexp_replace("line", r"^[A-Za-z]+:\s*", ""), ",")
    n = F.size("fmt")
    # split() takes a constant limit; the last field keeps its commas by joining what lies beyond the header
    joined = F.concat(F.slice(parts, F.lit(1), n - 1), F.array(F.array_join(F.slice(parts, n, F.size(parts)), ",")))
    fits = F.when(F.col("kind") == "Style", F.size(parts) == n).otherwise(F.size(parts) >= n)
    rows = rows.withColumn("fields", F.when(F.col("fmt").isNotNull() & fits, F.map_from_arrays("fmt", F.transform(F.when(F.col("kind") == "Style", parts).otherwise(joined), strip))))
    f = F.col("fields")
    timed = ass_ms(f["start"]).isNotNull() & ass_ms(f["end"]).isNotNull()
    bad = F.when(F.col("fmt").isNull(), "event before Format").when(f.isNull(), "field count").when((F.col("kind") != "Style") & ~timed, "time")
    return rows.withColumn("_corrupt", bad)


def parse_ass_events(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(styles, events) of lines(media_id, line_no, line): columns follow the section's latest Format line. A line that does not parse has its reason
    in `_corrupt` and no fields it lacks; it has no place in source_event_index."""
    rows = _ass_rows(lines)
    styles = rows.where("kind = 'Style'").select("media_id", "line_no", "fields", "_corrupt")
    order = Window.partitionBy("media_id", F.col("_corrupt").isNull()).orderBy("line_no")
    f = F.col("fields")
    number = F.when(F.col("_corrupt").isNull(), F.row_number().over(order) - 1)
    plain = [f[c].alias(c) for c in ("marginl", "marginr", "marginv", "effect")]
    events = rows.where("kind <> 'Style'").select("media_id", "line_no", number.alias("source_event_index"), F.col("kind").alias("event_type"), F.coalesce(f["layer"], f["marked"], F.lit("")).alias("layer"), f["start"].alias("start_raw"), ass_ms(f["start"]).alias("start_ms"), f["end"].alias("end_raw"), ass_ms(f["end"]).alias("end_ms"), F.coalesce(f["style"], F.lit("")).alias("style"), F.coalesce(f["name"], F.lit("")).alias("name"), *plain, F.coalesce(f["text"], F.lit("")).alias("text_raw"), "_corrupt")
    return styles, events


def srt_predictions(cues: DataFrame, cast: list[str]) -> DataFrame:
    """Labelled cues as predictions of unknown confidence."""
    return cues.select("media_id", F.col("idx").alias("pid"), "start_ms", "end_ms", "text", prediction_label(F.col("speaker"), cast).alias("speaker"), F.col("speaker").alias("speaker_raw"), F.lit("unknown").alias("confidence"))
