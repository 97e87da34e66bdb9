"""Other inputs and outputs: probes, file catalogues, manifests, segments, maps, aliases, roles, scenes, results, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_name, norm_speaker, prediction_label, safe_idx, strip
from .files import folder, read_lines, read_values, readable, unreadable, write_files

# File endings by kind, and the name of the alias file.
KINDS = {"video": ("mp4", "mkv", "mov", "avi", "ts", "webm", "flv", "m4v", "wmv"), "audio": ("wav", "flac", "mp3", "m4a", "aac", "opus", "ogg", "wma"), "subtitle": ("ass", "ssa", "srt", "vtt")}
ALIAS_FILE = "speaker_aliases.json"
# The codecs whose streams are prepared, and those that are extracted only.
PREPARED, EXTRACTED = ("ass", "ssa"), ("subrip",)


def stream_catalog(probes: DataFrame) -> DataFrame:
    """probes(media_id, value): a row for each subtitle stream of a container probe; `support` is prepare, extracted_only or inspect_only, by codec."""
    shape = "streams array<struct<index:int,codec_type:string,codec_name:string,codec_long_name:string,tags:struct<language:string,title:string>,disposition:map<string,int>,start_time:string,duration:string>>"
    s = probes.select("media_id", F.explode(F.from_json("value", shape)["streams"]).alias("s")).where("s.codec_type = 'subtitle'")
    w = Window.partitionBy("media_id").orderBy("s.index")
    support = F.when(F.col("s.codec_name").isin(*PREPARED), "prepare").when(F.col("s.codec_name").isin(*EXTRACTED), "extracted_only").otherwise("inspect_only")
    text = lambda c: F.coalesce(f"s.{c}", F.lit("")).alias(c.split(".")[-1])
    return s.select("media_id", F.col("s.index").alias("stream_index"), (F.row_number().over(w) - 1).alias("subtitle_index"), text("codec_name"), text("codec_long_name"), text("tags.language"), text("tags.title"), F.col("s.start_time").alias("start_time"), F.col("s.duration").alias("duration"), F.coalesce(F.col("s.disposition")["default"], F.lit(0)).alias("is_default"), support.alias("support"))


def project_catalog(files: DataFrame, require_subtitle: bool = True) -> DataFrame:
    """files(path): one row a folder with its media and subtitle, and what is missing or ambiguous."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.coalesce(F.when(F.regexp_extract("path", r"([^/]+)$", 1) == ALIAS_FILE, "alias"), *[F.when(ext.isin(*e), k) for k, e in KINDS.items()])
    x = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("project"), "path", kind.alias("kind")).where("kind IS NOT NULL")
    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    one = lambda *k: F.min(F.when(F.col("kind").isin(*k), F.col("path")))
    g = x.groupBy("project").agg(n("video", "audio").alias("n_media"), n("subtitle").alias("n_subtitle"), one("video", "audio").alias("media"), one("subtitle").alias("subtitle"), one("alias").alias("aliases"))
    status = F.when(F.col("n_media") == 0, "missing media").when(F.col("n_media") > 1, "ambiguous media").when(F.col("n_subtitle") > 1, "ambiguous subtitle")
    if require_subtitle:
        status = status.when(F.col("n_subtitle") == 0, "missing subtitle")
    return g.withColumn("status", status.otherwise("ok"))


def manifest(files: DataFrame) -> DataFrame:
    """files(path, content) as path, size, sha256."""
    return files.select("path", F.coalesce(F.octet_length("content"), F.lit(0)).alias("size"), F.sha2(F.coalesce("content", F.lit("").cast("binary")), 256).alias("sha256"))


def verify_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of the old manifest that are missing or changed."""
    x = old.alias("o").join(new.alias("n"), "path", "left")
    what = F.when(F.col("n.sha256").isNull(), "missing").when((F.col("o.sha256") != F.col("n.sha256")) | (F.col("o.size") != F.col("n.size")), "changed")
    return x.select("path", what.alias("problem")).where("problem IS NOT NULL")


def _number(v: Column, path: str) -> Column:
    """The finite number at a path of a variant; null for text, booleans and whatever else is no number."""
    at = F.try_variant_get(v, path, "variant")
    numeric = F.schema_of_variant(at).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    x = F.when(numeric, F.try_variant_get(v, path, "double"))
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def parse_segments(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(audio, segments, errors) of docs(media_id, value): the duration in any of three places; SPEAKER_n becomes SPK(n+1).

    A segment that is not 0 <= start < end <= duration with a SPEAKER_n label has `valid` false. A document with anything wrong is in errors, with
    the first reason; its rows are for looking at, not for use."""
    v = F.try_parse_json("value")
    x = docs.select("media_id", v.alias("v"))
    is_object = lambda c: F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False))
    audio = F.try_variant_get("v", "$.audio", "variant")
    duration = F.when(is_object(audio), _number(F.col("v"), "$.audio.duration")).when(F.try_variant_get("v", "$.duration", "variant").isNotNull(), _number(F.col("v"), "$.duration")).otherwise(_number(F.col("v"), "$.audio_duration"))
    listed = F.try_variant_get("v", "$.segments", "array<variant>")
    x = x.select("media_id", "v", duration.alias("duration_s"), F.when(F.schema_of_variant(F.try_variant_get("v", "$.segments", "variant")).startswith("ARRAY"), listed).alias("s"))
    rows = x.select("media_id", "duration_s", F.explode("s").alias("s")).select("media_id", "duration_s", F.coalesce(is_object(F.col("s")), F.lit(False)).alias("object"), _number(F.col("s"), "$.start").alias("start"), _number(F.col("s"), "$.end").alias("end"), F.when(F.schema_of_variant(F.try_variant_get("s", "$.speaker", "variant")) == "STRING", F.try_variant_get("s", "$.speaker", "string")).alias("speaker"))
    named = F.coalesce(F.col("speaker").rlike(r"^SPEAKER_[0-9]+$"), F.lit(False))
    label = F.when(named, F.concat(F.lit("SPK"), (F.regexp_extract("speaker", r"([0-9]+)$", 1).try_cast("long") + 1).cast("string"))).otherwise(F.col("speaker"))
    inside = F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("duration_s")), F.lit(False))
    wrong = F.when(~F.col("object"), "segment is no object").when(F.col("start").isNull(), "segment start").when(F.col("end").isNull(), "segment end").when(~inside, "segment range").when(~named, "segment speaker")
    rows = rows.withColumn("wrong", wrong)
    worst = rows.groupBy("media_id").agg(F.min("wrong").alias("wrong"))
    reason = F.when(~is_object(F.col("v")), "no object").when(F.col("duration_s").isNull() | (F.col("duration_s") <= 0), "duration").when(F.col("s").isNull(), "no segments")
    errors = x.join(worst, "media_id", "left").select("media_id", F.coalesce(reason, "wrong").alias("error")).where("error IS NOT NULL")
    return x.select("media_id", "duration_s"), rows.select("media_id", label.alias("speaker"), F.col("start").alias("start_s"), F.col("end").alias("end_s"), F.col("wrong").isNull().alias("valid")), errors


def parse_label_map(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(map, errors) of lines(media_id, line_no, line) of INI files: [speakers] alone, SPKn = label, % as it stands.

    A file with anything else is refused: another section, defaults, a key outside a section, a key twice, a bad key or label. Blank labels are no mapping yet."""
    w = Window.partitionBy("media_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("line", strip(F.col("line"))).where((F.col("line") != "") & ~F.col("line").rlike("^[#;]"))
    head = F.regexp_extract("line", r"^\[([^\]]+)\]", 1)
    x = x.withColumn("section", F.last(F.when(head != "", head), ignorenulls=True).over(w)).withColumn("head", head)
    parts = F.split("line", "[=:]", 2)
    kv = x.where("head = ''").select("media_id", "line_no", "section", strip(parts[0]).alias("speaker"), strip(F.coalesce(parts[1], F.lit(""))).alias("label"), F.col("line").rlike("[=:]").alias("paired"))
    twice = F.count("*").over(Window.partitionBy("media_id", "section", "speaker")) > 1
    bad = F.when(F.col("section").isNull(), "no section").when(F.col("section") == "DEFAULT", "defaults").when(~F.col("paired"), "no value").when(twice, "key twice").when(~F.col("speaker").rlike(r"^SPK[1-9][0-9]*$"), "key").when(F.col("label").rlike(r"[\p{C}\p{Z}&&[^ ]]|[\[\]<>]"), "label")
    kv = kv.withColumn("problem", bad)
    sections = x.groupBy("media_id").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("section") != "DEFAULT", F.col("section")))), "\n").alias("s"))
    other = lines.select("media_id").distinct().join(sections, "media_id", "left").where(F.coalesce("s", F.lit("")) != "speakers").select("media_id", F.lit("sections").alias("error"))
    errors = other.unionByName(kv.where("problem IS NOT NULL").select("media_id", F.col("problem").alias("error"))).groupBy("media_id").agg(F.min("error").alias("error"))
    good = kv.join(errors, "media_id", "left_anti").where("section = 'speakers' AND label <> ''")
    return good.select("media_id", "speaker", "label"), errors


def parse_aliases(docs: DataFrame) -> DataFrame:
    """docs(media_id, value) of {canonical: [variants]}: variant (normalised), canonical; later entries win.

    Keys from _ are comments, whatever they hold; values that are no arrays, and members that are no text, are passed over."""
    m = docs.select("media_id", F.posexplode(F.map_entries(F.from_json("value", "map<string,variant>"))).alias("k", "e")).select("media_id", "k", "e.*").where(~F.col("key").startswith("_"))
    m = m.where(F.schema_of_variant("value").startswith("ARRAY"))
    v = m.select("media_id", "k", F.col("key").alias("canonical"), F.posexplode(F.try_variant_get("value", "$", "array<variant>")).alias("i", "raw")).where(F.schema_of_variant("raw") == "STRING")
    v = v.withColumn("variant", norm_speaker(F.try_variant_get("raw", "$", "string")))
    return v.groupBy("media_id", "variant").agg(F.max_by("canonical", F.struct("k", "i")).alias("canonical"))


# Further parts of a role's description, and the text of a note that is still to be written.
ROLE_EXTRAS = ("story", "demographics", "visual_cues", "forms")
ROLE_TO_WRITE = "请在此填入"


def _flat(v: Column) -> Column:
    """A variant as text: objects as `key: value`, arrays in order, both joined by `; `; what lies deeper stays JSON."""
    kind = F.schema_of_variant(v)
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,string>"))
    return F.when(kind.startswith("ARRAY"), F.array_join(F.try_variant_get(v, "$", "array<string>"), "; ")).when(kind.startswith("OBJECT"), F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")).when(kind == "VOID", "unknown").otherwise(F.try_variant_get(v, "$", "string"))


def role_prompts(docs: DataFrame, detail: str = "baseline", extras: tuple[str, ...] = ()) -> DataFrame:
    """docs(media_id, value) of {role: {..}}: (media_id, pos, label, line), a description line a role in the file's order, before them one of
    global rules and, if asked for, one of the story.

    detail baseline has no extras, selected the demographics, full all; `extras` adds to it."""
    if detail not in ("baseline", "selected", "full") or set(extras) - set(ROLE_EXTRAS):
        raise ValueError(f"unknown role detail {detail} or extras {extras}")
    on = set(extras) | {"baseline": set(), "selected": {"demographics"}, "full": set(ROLE_EXTRAS)}[detail]
    m = docs.select("media_id", F.posexplode(F.map_entries(F.from_json("value", "map<string,variant>"))).alias("pos", "e")).select("media_id", "pos", F.col("e.key").alias("label"), F.col("e.value").alias("v"))
    at = lambda path: F.try_variant_get("v", path, "variant")
    has = lambda path: at(path).isNotNull() & ~F.coalesce(_flat(at(path)), F.lit("")).isin("", "unknown")
    part = lambda name, path, show=None: F.when(has(path), F.concat(F.lit(name + ": "), _flat(at(path)) if show is None else show))
    phrases = F.array_join(F.try_variant_get("v", "$.catchphrases", "array<string>"), ", ")
    looks = F.concat_ws(" | ", F.when(has("$.appearance.summary"), _flat(at("$.appearance.summary"))), part("often mistaken", "$.appearance.avoid_mistakes"))
    parts = [
        part("name", "$.name_ja"),
        F.when(at("$.age").isNotNull(), F.concat(F.lit("context only, age: "), _flat(at("$.age")))) if "demographics" in on else None,
        part("context only, gender", "$.gender") if "demographics" in on else None,
        part("context only, role", "$.role"),
        part("first person", "$.first_person"),
        part("speaker evidence, speech style", "$.speech_style"),
        part("speaker evidence, catchphrases", "$.catchphrases", phrases),
        part("speaker evidence, address of others", "$.address_others"),
        F.when(looks != "", F.concat(F.lit("weak visual evidence: "), looks)),
        part("further weak visual evidence, cues", "$.appearance.visual_cues") if "visual_cues" in on else None,
        part("further weak visual evidence, forms", "$.appearance.forms") if "forms" in on else None,
        F.when(~_flat(at("$.notes")).contains(ROLE_TO_WRITE), part("context only, notes", "$.notes")),
    ]
    role = F.concat_ws(" | ", F.concat(F.lit("["), F.col("label"), F.lit("]")), *[p for p in parts if p is not None])
    line = F.when(F.col("label") == "_speaker_identification_rules", F.concat(F.lit("rules: "), _flat(F.col("v"))))
    if "story" in on:
        line = line.when(F.col("label") == "_story_context", F.concat(F.lit("context only, story: "), _flat(F.col("v"))))
    line = line.when(~F.col("label").startswith("_") & F.schema_of_variant("v").startswith("OBJECT"), role)
    return m.select("media_id", F.when(F.col("label") == "_speaker_identification_rules", -2).when(F.col("label") == "_story_context", -1).otherwise(F.col("pos")).alias("pos"), "label", line.alias("line")).where("line IS NOT NULL")


def parse_scenes(docs: DataFrame) -> DataFrame:
    """docs(media_id, value) of scene arrays: enabled scenes with both indexes, in order."""
    shape = "array<struct<scene_id:int,enabled:boolean,name:string,start_idx:string,end_idx:string,start:double,end:double>>"
    x = docs.select("media_id", F.explode(F.from_json("value", shape)).alias("s")).select("media_id", "s.*")
    x = x.withColumns({"start_idx": safe_idx(F.col("start_idx")), "end_idx": safe_idx(F.col("end_idx"))})
    return x.where(F.coalesce("enabled", F.lit(True)) & F.col("start_idx").isNotNull() & F.col("end_idx").isNotNull() & (F.col("start_idx") <= F.col("end_idx")))


def render_scenes(scenes: DataFrame) -> DataFrame:
    """(media_id, value): the scene array of a media, in order, times to the millisecond."""
    of = lambda c, default: F.col(c) if c in scenes.columns else F.lit(default)
    row = F.struct(F.col("scene_id"), of("enabled", True).alias("enabled"), of("name", "").alias("name"), "start_idx", "end_idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))
    return scenes.groupBy("media_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("value"))


def write_scenes(scenes: DataFrame, path: str, mode: str = "error") -> int:
    """One file `<media_id>.json` a media with its scene array; see write_files."""
    return write_files(render_scenes(scenes).select(F.concat(F.col("media_id").cast("string"), F.lit(".json")).alias("name"), F.col("value").alias("content")), path, mode)


def parse_results(rows: DataFrame, cast: list[str]) -> DataFrame:
    """Predictions of rows(media_id, value) of result records: entries left join their record's last result per idx."""
    shape = "entries array<struct<idx:int,start:double,end:double,text:string,speaker_in_srt:string>>, results array<struct<idx:string,speaker:string,speaker_raw:string,confidence:string>>"
    r = rows.select("media_id", F.from_json("value", shape).alias("j")).select("media_id", "j.entries", "j.results")
    e = r.select("media_id", "results", F.explode("entries").alias("e"))
    own = F.filter("results", lambda x: safe_idx(x["idx"]) == F.col("e.idx"))
    last = F.when(F.size(own) > 0, F.element_at(own, -1))
    raw = F.coalesce(last["speaker"], F.lit("?"))
    return e.select("media_id", F.col("e.idx").alias("idx"), F.round(F.col("e.start") * 1000).cast("long").alias("start_ms"), F.round(F.col("e.end") * 1000).cast("long").alias("end_ms"), F.coalesce("e.text", F.lit("")).alias("text"), prediction_label(raw, cast).alias("speaker"), F.coalesce(last["speaker_raw"], raw).alias("speaker_raw"), F.lower(F.coalesce(last["confidence"], F.lit("unknown"))).alias("confidence"), F.coalesce("e.speaker_in_srt", F.lit("?")).alias("input_speaker"))


# The actions of a style policy.
ACTIONS = ("keep_dialogue", "drop_translation", "drop_lyrics", "drop_screen", "drop_annotation", "drop_title", "drop_staff", "drop_comment", "review")
POLICY = "schema_version int, unknown_style string, styles map<string,string>, event_types map<string,string>, expected struct<kept_events:int,review_events:int>, source struct<stream_index:int,expected_codec:string,expected_title:string>"


def parse_policy(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions, settings) of docs(media_id, value) of style policies.

    actions: a row for each style and event type (`kind`, `name`, `action`, `problem`); settings: a row a policy with its expected counts, its
    source stream and what that stream must be, and what is wrong with the policy as a whole."""
    p = docs.select("media_id", F.from_json("value", POLICY).alias("p")).select("media_id", "p.*")
    rows = lambda c, kind: p.select("media_id", F.lit(kind).alias("kind"), F.explode(c).alias("name", "action"))
    actions = rows("styles", "style").unionByName(rows("event_types", "event type"))
    bad = F.when(F.coalesce(F.col("schema_version"), F.lit(0)) != 1, "schema_version").when(F.coalesce(F.size("styles"), F.lit(0)) <= 0, "no styles").when(F.coalesce("unknown_style", F.lit("")) != "error", "unknown_style").when(F.col("source").isNull() | F.col("source.stream_index").isNull(), "source")
    settings = p.select("media_id", "expected.kept_events", "expected.review_events", "source.stream_index", "source.expected_codec", "source.expected_title", bad.alias("problem"))
    return actions.withColumn("problem", F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "action")), settings


def select_streams(settings: DataFrame, streams: DataFrame) -> DataFrame:
    """(media_id, stream_index, problem): the stream each policy names in stream_catalog's rows, and whether it is the one the policy expects."""
    x = settings.select("media_id", "stream_index", "expected_codec", "expected_title").join(streams.select("media_id", "stream_index", "codec_name", "title"), ["media_id", "stream_index"], "left")
    n = F.count("codec_name").over(Window.partitionBy("media_id", "stream_index"))
    bad = F.when(n != 1, "not found once").when(F.col("expected_codec") != F.col("codec_name"), "codec").when(F.col("expected_title") != F.coalesce("title", F.lit("")), "title").when(~F.col("codec_name").isin("ass", "ssa"), "codec not supported")
    return x.select("media_id", "stream_index", bad.alias("problem")).distinct()


def training_manifest(clips: DataFrame, *beside: str) -> DataFrame:
    """file|speaker|text rows of clips with text, numbered per speaker in time order."""
    w = Window.partitionBy("media_id", "speaker").orderBy("start_ms", "end_ms", "entry_idx")
    named = clips.withColumn("__n", F.row_number().over(w))
    row = F.concat_ws("|", file_name(F.col("start_ms"), F.col("speaker"), F.col("excerpt"), F.col("__n")), "speaker", "full_text")
    return named.where("full_text <> ''").select("media_id", "speaker", *beside, row.alias("value"))


def write_training_manifest(clips: DataFrame, path: str, name: str = "filelist_audio.txt", mode: str = "error") -> int:
    """training_manifest's rows as files: `<media_id>/<speaker>/<name>`, a clip with text a line, in time order. A speaker's slashes become _."""
    w = Window.partitionBy("media_id", "speaker").orderBy("start_ms", "end_ms", "entry_idx")
    rows = training_manifest(clips.withColumn("__at", F.row_number().over(w)), "__at")
    own = rows.groupBy("media_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("__at", "value"))).alias("i"))
    at = F.concat_ws("/", F.col("media_id").cast("string"), F.regexp_replace("speaker", r"[\\/]", "_"), F.lit(name))
    return write_files(own.select(at.alias("name"), F.array_join(F.transform("i", lambda x: x["value"]), "\n").alias("content")), path, mode)


# readers by path: a file a media unless said otherwise ----------------------------------------------------------


def _whole(spark: SparkSession, path: str, glob: str, failfast: bool) -> tuple[DataFrame, DataFrame]:
    """(media_id, value) of the readable files and (media_id, error) of the others."""
    files = read_values(spark, path, glob)
    return readable(files, failfast), unreadable(files)


def read_probes(spark: SparkSession, path: str, failfast: bool = False) -> DataFrame:
    """stream_catalog of the container probes (.json) at or below a path."""
    return stream_catalog(_whole(spark, path, "*.json", failfast)[0])


def read_catalog(spark: SparkSession, path: str, require_subtitle: bool = True) -> DataFrame:
    """project_catalog of the files below a path, by their names alone."""
    return project_catalog(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path"), require_subtitle)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """manifest of the files at or below a path."""
    return manifest(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def read_segments(spark: SparkSession, path: str, failfast: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """parse_segments of the .json files at or below a path; unreadable files are errors."""
    good, bad = _whole(spark, path, "*.json", failfast)
    audio, segments, errors = parse_segments(good)
    return audio, segments, errors.unionByName(bad)


def read_label_map(spark: SparkSession, path: str, failfast: bool = False) -> tuple[DataFrame, DataFrame]:
    """parse_label_map of the .ini files at or below a path; unreadable files are errors."""
    lines = read_lines(spark, path, "*.ini")
    found, errors = parse_label_map(readable(lines, failfast))
    return found, errors.unionByName(unreadable(lines))


def read_aliases(spark: SparkSession, path: str, failfast: bool = False) -> DataFrame:
    """parse_aliases of the alias files below a path, media_id the folder each is in."""
    return parse_aliases(readable(read_values(spark, path, ALIAS_FILE, folder), failfast))


def read_roles(spark: SparkSession, path: str, detail: str = "baseline", extras: tuple[str, ...] = (), failfast: bool = False) -> DataFrame:
    return role_prompts(_whole(spark, path, "*.json", failfast)[0], detail, extras)


def read_scenes(spark: SparkSession, path: str, failfast: bool = False) -> DataFrame:
    return parse_scenes(_whole(spark, path, "*.json", failfast)[0])


def read_results(spark: SparkSession, path: str, cast: list[str], failfast: bool = False) -> DataFrame:
    """parse_results of the .jsonl files at or below a path, a record a line."""
    lines = readable(read_lines(spark, path, "*.jsonl"), failfast)
    return parse_results(lines.where(F.trim("line") != "").select("media_id", F.col("line").alias("value")), cast)


def read_policy(spark: SparkSession, path: str, failfast: bool = False) -> tuple[DataFrame, DataFrame]:
    """parse_policy of the .json files at or below a path; an unreadable file is a policy with that problem."""
    good, bad = _whole(spark, path, "*.json", failfast)
    actions, settings = parse_policy(good)
    return actions, settings.unionByName(bad.select("media_id", F.col("error").alias("problem")), allowMissingColumns=True)
