"""Replies, labels, corrections and audit tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_text, safe_idx, shown_text
from .intervals import idx_join

REPLY = "array<struct<idx:string,speaker:string,speaker_raw:string,confidence:string,original_spk:string,corrected_spk:string,reason:string,scene_id:string>>"


def reply_body(reply: Column) -> Column:
    """The JSON in a reply: fences and talk round it dropped."""
    return F.regexp_extract(reply, r"(?s)([\[{].*[\]}])", 1)


def _text(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def parse_replies(replies: DataFrame, kind: str = "labels") -> tuple[DataFrame, DataFrame]:
    """(results, errors) of replies(media_id, batch_id, reply): a row per item with defaults, and the batches that do not parse: `no json` if no bracket opens,
    else `bad json`, also when the reply was cut off before one closed.

    labels: an array of {idx, speaker, ..}; an idx that is none is null. corrections: an array of {idx, corrected_spk, ..}; items without an
    idx are left out. cuts: an object {"cuts": [{after_idx, title, reason}]}, the first of each after_idx; one without makes its batch an error."""
    if kind == "cuts":
        return _parse_cuts(replies)
    body = F.regexp_extract("reply", r"(?s)(\[.*\])", 1) if kind == "corrections" else reply_body(F.col("reply"))
    parsed = replies.withColumn("__v", F.try_parse_json(body)).withColumn("__a", F.when(F.col("__v").isNotNull() & body.startswith("["), F.from_json(body, REPLY)))
    opened = F.col("reply").rlike(r"\[" if kind == "corrections" else r"[\[{]")
    errors = parsed.where("__a IS NULL").select("media_id", "batch_id", F.when(opened, "bad json").otherwise("no json").alias("error"))
    items = parsed.select("media_id", "batch_id", F.posexplode("__a").alias("pos", "r"))
    who = ["media_id", "batch_id", "pos", safe_idx(F.col("r.idx")).alias("idx")]
    if kind == "corrections":
        rows = items.select(*who, _text(F.col("r.original_spk"), "?").alias("original_spk"), _text(F.col("r.corrected_spk"), "?").alias("corrected_spk"), _text(F.col("r.confidence"), "low").alias("confidence"), _text(F.col("r.reason"), "").alias("reason"))
        return rows.where("idx IS NOT NULL"), errors
    return items.select(*who, _text(F.col("r.speaker"), "?").alias("speaker"), F.coalesce("r.speaker_raw", "r.speaker", F.lit("?")).alias("speaker_raw"), F.lower(_text(F.col("r.confidence"), "unknown")).alias("confidence"), _text(F.col("r.reason"), "").alias("reason")), errors


def _parse_cuts(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    body = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    parsed = replies.select("media_id", "batch_id", F.contains("reply", F.lit("{")).alias("__open"), body.alias("__b"), F.try_parse_json(body).alias("__v"))
    listed = F.schema_of_variant(F.try_variant_get("__v", "$.cuts", "variant")).startswith("ARRAY")
    parsed = parsed.withColumn("__a", F.when(listed, F.from_json("__b", "cuts array<struct<after_idx:string,title:string,reason:string>>")["cuts"]))
    lost = F.exists("__a", lambda x: x.isNull() | safe_idx(x["after_idx"]).isNull())
    error = F.when(~F.col("__open"), "no json").when(F.col("__v").isNull(), "bad json").when(F.col("__a").isNull(), "no cuts").when(lost, "bad after_idx")
    parsed = parsed.withColumn("error", error)
    items = parsed.where("error IS NULL").select("media_id", "batch_id", F.posexplode("__a").alias("pos", "r"))
    plain = lambda c: plain_text(_text(F.col(c), ""))
    cuts = items.select("media_id", "batch_id", "pos", safe_idx(F.col("r.after_idx")).alias("after_idx"), plain("r.title").alias("title"), plain("r.reason").alias("reason"))
    first = cuts.groupBy("media_id", "batch_id", "after_idx").agg(F.min_by(F.struct("pos", "title", "reason"), "pos").alias("x")).select("media_id", "batch_id", "after_idx", "x.*")
    return first, parsed.where("error IS NOT NULL").select("media_id", "batch_id", "error")


def restrict(results: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Labels outside the allowed set become OTHER; the raw label stays."""
    out = ~F.col("speaker").isin(*allowed, "?", "NONSPEECH", "OTHER")
    return results.withColumns({"speaker_raw": F.when(out, F.coalesce(F.nullif("speaker_raw", F.lit("")), "speaker")).otherwise(F.col("speaker_raw")), "speaker": F.when(out, "OTHER").otherwise(F.col("speaker"))})


def retry_set(results: DataFrame, forbidden: str = "OVERLAP") -> DataFrame:
    return results.where((F.col("speaker") == forbidden) & F.col("idx").isNotNull()).select("media_id", "idx").distinct()


def locked(lock: str, cast: Sequence[str]) -> Column:
    """Whether an explicit label of the input stands: none, canonical or all."""
    plain = (F.size("tags") == 0) & ~F.col("speaker").isin("?", "NONSPEECH", "")
    return {"none": F.lit(False), "canonical": plain & F.col("speaker").isin(*cast), "all": plain}[lock]


def apply_results(cues: DataFrame, results: DataFrame, cast: Sequence[str], lock: str = "none", keep_tags: bool = False) -> DataFrame:
    """Final speaker of each cue and why; the last result of an idx counts."""
    last = results.where("idx IS NOT NULL").groupBy("media_id", "idx").agg(F.max_by(F.struct(F.col("speaker").alias("s"), F.col("speaker_raw").alias("r")), F.struct("batch_id", "pos")).alias("res"))
    x = cues.join(last, ["media_id", "idx"], "left")
    s, r = F.trim("res.s"), F.trim(F.coalesce("res.r", F.lit("")))
    named = (s == "OTHER") & (r != "") & ~r.isin("OTHER", "?", "NONSPEECH")
    cases = [
        (locked(lock, cast), F.col("speaker"), f"locked {lock}"),
        (F.col("res").isNull(), F.col("speaker"), "kept input: missing"),
        (s == "", F.col("speaker"), "kept input: empty result"),
        (named, r, "identity of OTHER"),
        (s == "OTHER", F.lit("OTHER"), "label"),
        (s == "OVERLAP", F.lit("?"), "OVERLAP needs review"),
        (s.isin(*cast, "?", "NONSPEECH"), s, "label"),
    ]
    final, why = None, None
    for on, value, reason in cases:
        final = F.when(on, value) if final is None else final.when(on, value)
        why = F.when(on, reason) if why is None else why.when(on, reason)
    raw = F.when(r != "", r).otherwise(s)
    tags = F.col("tags") if keep_tags else F.array().cast("array<string>")
    return x.select("media_id", "idx", "start_ms", "end_ms", "text", final.otherwise(raw).alias("final_speaker"), why.otherwise("raw identity").alias("reason"), tags.alias("tags"))


def apply_corrections(cues: DataFrame, corrections: DataFrame, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cues, audit) of corrections(media_id, idx, pos, corrected_spk, ..), taken in order of pos (after batch_id, if there is one); those of other cues than the targets, or of none, are passed over.

    Every correction taken has a row in the audit, with all the reply said, what the cue is, whether it changed the speaker that stood (after the corrections
    before it), and the speaker after it."""
    order = [c for c in ("batch_id", "pos") if c in corrections.columns]
    known = corrections if targets is None else corrections.join(targets.select("media_id", "idx").distinct(), ["media_id", "idx"], "left_semi")
    known = known.join(cues.select("media_id", "idx", F.col("speaker").alias("__spoken"), "start_ms", "end_ms", "text", "tags"), ["media_id", "idx"])
    before = F.coalesce(F.lag("corrected_spk").over(Window.partitionBy("media_id", "idx").orderBy(*order)), "__spoken")
    audit = known.select("media_id", "idx", *[c for c in corrections.columns if c not in ("media_id", "idx")], (~before.eqNullSafe(F.col("corrected_spk"))).alias("applied"), F.col("corrected_spk").alias("final_spk"), "start_ms", "end_ms", "text", "tags")
    last = known.groupBy("media_id", "idx").agg(F.max_by("corrected_spk", F.struct(*order)).alias("__new"))
    return cues.join(last, ["media_id", "idx"], "left").withColumn("speaker", F.coalesce("__new", "speaker")).drop("__new"), audit


def apply_reviews(cues: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews(media_id, idx, speaker[, parse_error][, pos]) written back: cues whose review has no speaker, OTHER or OVERLAP, or did not parse, stay and are for review; `?` makes
    a cue's speaker unknown; any other speaker is set as verified. Of several reviews of a cue the last by pos counts."""
    failed = F.coalesce(F.col("parse_error"), F.lit(False)) if "parse_error" in reviews.columns else F.lit(False)
    own = reviews.select("media_id", "idx", F.struct(F.col("speaker").alias("s"), failed.alias("failed")).alias("__r"), F.col("pos") if "pos" in reviews.columns else F.lit(0).alias("pos"))
    last = own.groupBy("media_id", "idx").agg(F.max_by("__r", "pos").alias("__r"))
    x = cues.join(last, ["media_id", "idx"], "left")
    said = F.coalesce("__r.s", F.lit(""))
    tag = F.when(F.col("__r").isNull(), None).when(F.col("__r.failed") | said.isin("", "OVERLAP", "OTHER"), "MM_REVIEW").when(said == "?", "MM_UNCLEAR").otherwise("MM_VERIFIED")
    return x.select("media_id", "idx", F.when(tag.isin("MM_UNCLEAR", "MM_VERIFIED"), said).otherwise(F.col("speaker")).alias("speaker"), F.when(tag.isNull(), F.col("tags")).otherwise(F.array_union("tags", F.array(tag))).alias("tags"))


def update_cuts(cuts: DataFrame, regions: DataFrame, new: DataFrame) -> DataFrame:
    """cuts(media_id, after_idx, title): those inside a region (first_idx <= cut < last_idx) give way to the new ones.

    A cut's title follows it: a new title that is not empty wins, a cut that stays or comes back keeps its own, one that goes takes its title along."""
    own = cuts.groupBy("media_id", "after_idx").agg(F.max("title").alias("__old"))
    inside = regions.select("media_id", "first_idx", (F.col("last_idx") - 1).alias("__to"))
    kept = idx_join(own, inside, "first_idx", "__to", "after_idx", "left_anti").select("media_id", "after_idx", F.lit(None).cast("string").alias("__new"))
    fresh = new.groupBy("media_id", "after_idx").agg(F.max(F.nullif("title", F.lit(""))).alias("__new"))
    every = kept.unionByName(fresh).groupBy("media_id", "after_idx").agg(F.max("__new").alias("__new"))
    return every.join(own, ["media_id", "after_idx"], "left").select("media_id", "after_idx", F.coalesce("__new", "__old", F.lit("")).alias("title"))


def filter_boundaries(reply: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cuts of a reply that are candidates of their batch, first of each idx."""
    own = reply.join(candidates, ["media_id", "batch_id", "after_idx"], "left_semi")
    return own.groupBy("media_id", "batch_id", "after_idx").agg(F.min_by("title", "pos").alias("title"))


def upsert_audit(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    w = Window.partitionBy("media_id", "idx").orderBy(F.desc("__v"))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__v", "__rn")


def conflict(pick: Column, verified: Column, target: Column) -> Column:
    """The pick is the target, or verification says so, but not both."""
    return (pick == target) != verified


def cuts_from_scenes(scenes: DataFrame, cues: DataFrame) -> DataFrame:
    """(media_id, scene_id, after_idx, title, confirmed) of scenes(media_id, scene_id, start_idx, end_idx, name[, enabled]): a cut after the last spoken cue of each enabled scene that has one.

    A cut is confirmed where the scene has a title, white space aside, that is not its preview; the end of a media's last scene is none. Scenes are numbered anew."""
    on = scenes.where(F.coalesce("enabled", F.lit(True))) if "enabled" in scenes.columns else scenes
    spoken = cues.where((F.col("speaker") != "NONSPEECH") & ~F.contains("text", F.lit("\u266a")))
    j = idx_join(spoken.select("media_id", "idx", "text"), on.select("media_id", "scene_id", "start_idx", "end_idx"))
    held = j.groupBy("r.media_id", "r.scene_id").agg(F.max("p.idx").alias("after_idx"), F.min_by("p.text", "p.idx").alias("__a"), F.max_by("p.text", "p.idx").alias("__z"), F.count("*").alias("__n"))
    preview = F.when(F.col("__n") == 1, shown_text(F.col("__a"))).otherwise(F.concat_ws(" / ... / ", shown_text(F.col("__a")), shown_text(F.col("__z"))))
    x = held.join(on.select("media_id", "scene_id", plain_text(F.coalesce("name", F.lit(""))).alias("title")), ["media_id", "scene_id"])
    w = Window.partitionBy("media_id").orderBy("scene_id")
    last = F.lead("scene_id").over(w).isNull()
    return x.select("media_id", F.row_number().over(w).alias("scene_id"), "after_idx", "title", (~last & (F.col("title") != "") & (F.col("title") != preview)).alias("confirmed"))


def resolve_alias(tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """tokens(media_id, .., token) with canonical speaker: the alias of its own project, aliases(media_id, variant, canonical), else the token, else ?."""
    a = aliases.select("media_id", F.col("variant").alias("token"), F.col("canonical").alias("__c"))
    x = tokens.join(a, ["media_id", "token"], "left")
    return x.withColumn("speaker", F.coalesce("__c", F.nullif("token", F.lit("")), F.lit("?"))).withColumn("alias_hit", F.col("__c").isNotNull()).drop("__c")


def explode_speakers(raw: DataFrame) -> DataFrame:
    """raw(.., c = classified struct): a row for each (cue, part)."""
    # the outer form, as Spark would class each cue again to see whether it has parts
    parts = raw.select("*", F.posexplode_outer("c.parts").alias("part", "p")).where("part IS NOT NULL")
    return parts.withColumns({"raw": F.col("p.raw"), "said": F.col("p.text")}).drop("p")
