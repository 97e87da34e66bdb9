"""Interval algebra per media: islands, merges, unions, windows, range joins, conflict removal.

Times are BIGINT milliseconds. Every window is partitioned by media, most by speaker too. Folds that depend on
state are ordered sweeps (see sweep.py).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored
from .sweep import Clip, clips_joined, cues_heard, cues_merged, sweep

BIN_MS = 60_000


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], gap_ms: int | None = None, start: str = "start_ms", end: str = "end_ms", name: str = "island") -> DataFrame:
    """Numbers runs of rows that overlap: strictly, or with gap_ms inclusively (0: touching joins)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col(start) >= reach if gap_ms is None else F.col(start) > reach + gap_ms
    marked = df.withColumn("__fresh", F.coalesce(fresh.cast("int"), F.lit(1)))
    return marked.withColumn(name, F.sum("__fresh").over(w)).drop("__fresh")


# clips ------------------------------------------------------------------------------------------------


def to_clips(cues: DataFrame) -> DataFrame:
    """Cue -> clip: kind from the MULTI tag, a 60-character excerpt, the text on one line."""
    flat = F.trim(F.replace(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")), F.lit("\\N"), F.lit(" ")))
    kind = F.when(F.array_contains("tags", "MULTI"), "multi").otherwise("single")
    return cues.select("media_id", "start_ms", "end_ms", F.col("speaker").alias("raw_speaker"), F.substring("text", 1, 60).alias("excerpt"), flat.alias("full_text"), kind.alias("kind"), F.col("idx").alias("entry_idx"), "speaker")


def bucket(cues: DataFrame, targets: Sequence[str] | None = None, keep_unknown: bool = False) -> DataFrame:
    """Adds the bucket (speaker folded) and the reason a cue is dropped for, null if kept."""
    folded = F.when((F.col("speaker") == "NONSPEECH") | F.col("speaker").startswith("NONSPEECH:"), "NONSPEECH").otherwise(F.col("speaker"))
    unknown = F.col("speaker") == "?"
    reason = F.when(unknown, F.lit(None) if keep_unknown else F.lit("unknown"))
    if targets is not None:
        reason = reason.when(~folded.isin(*targets), "not in targets") if not keep_unknown else F.when(~unknown & ~folded.isin(*targets), "not in targets")
    return cues.withColumn("bucket", folded).withColumn("dropped_for", reason.cast("string"))


_CLIP = ("start_ms", "end_ms", "entry_idx", "raw_speaker", "excerpt", "full_text", "kind")


def _clips(clips: DataFrame, key: str, joins: Callable[[Clip, int, tuple], bool], gap_ms: int | None, split_over: int | None) -> DataFrame:
    kind = lambda c: clips.schema[c].dataType.simpleString()
    schema = f"media_id {kind('media_id')}, `{key}` {kind(key)}, start_ms long, end_ms long, raw_speaker string, excerpt string, full_text string, kind string, entry_idx {kind('entry_idx')}, n_merged int"
    return sweep(clips, ["media_id", key], _CLIP, _CLIP, clips_joined(joins), schema, split_over, gap_ms)


def merge_overlap(clips: DataFrame, key: str = "speaker", split_over: int | None = None) -> DataFrame:
    """Clips of one speaker that overlap (start < reach) become one, by an ordered sweep; split_over as for sweep()."""
    return _clips(clips, key, lambda run, reach, clip: clip[0] < reach, None, split_over)


def merge_adjacent(clips: DataFrame, gap_ms: int = 300, cap_ms: int = 30_000, key: str = "speaker", split_over: int | None = None) -> DataFrame:
    """Neighbouring clips of one speaker become one while the gap is small and the whole stays under the cap: an ordered sweep that holds the open run."""
    return _clips(clips, key, lambda run, reach, clip: clip[0] - run.end <= gap_ms and clip[1] - run.start <= cap_ms, gap_ms, split_over)


def first_per_speaker(clips: DataFrame, n: int | None, key: str = "speaker") -> DataFrame:
    if n is None:
        return clips
    w = Window.partitionBy("media_id", key).orderBy("start_ms", "end_ms", "entry_idx")
    return clips.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def min_duration(clips: DataFrame, ms: int = 2000) -> DataFrame:
    return clips.where(F.col("end_ms") - F.col("start_ms") >= ms)


def clip_table(cues: DataFrame, conflict_ms: int | None = 0, n: int | None = None, gap_ms: int = 300, cap_ms: int = 30_000, min_ms: int = 2000, targets: Sequence[str] | None = None) -> DataFrame:
    """The clip pipeline: conflicts out, buckets, overlap merge, first n, adjacent merge, minimum duration."""
    kept = cues if conflict_ms is None else drop_cross_speaker(cues, conflict_ms)
    kept = bucket(kept, targets).where("dropped_for IS NULL")
    clips = to_clips(kept).drop("speaker").join(kept.select("media_id", F.col("idx").alias("entry_idx"), F.col("bucket").alias("speaker")), ["media_id", "entry_idx"])
    merged = first_per_speaker(merge_overlap(clips).drop("n_merged"), n)
    return min_duration(merge_adjacent(merged, gap_ms, cap_ms), min_ms)


# cue merges ---------------------------------------------------------------------------------------------


def merge_gap(cues: DataFrame, gap_ms: int = 100, split_over: int | None = None) -> DataFrame:
    """Cues of one speaker within the gap (inclusive) become one; lyric rows stay alone and part their neighbours. An ordered sweep that holds the open run."""
    kind = lambda c: cues.schema[c].dataType.simpleString()
    schema = f"media_id {kind('media_id')}, speaker string, start_ms long, end_ms long, text string, tags array<string>, source_entries array<{kind('src')}>, merges int"
    return sweep(cues, ["media_id", "speaker"], ["start_ms", "end_ms", "src"], ["start_ms", "end_ms", "src", "text", "is_multi", "is_lyric"], cues_merged(gap_ms), schema, split_over, gap_ms)


def reindex(cues: DataFrame, ties: Sequence[str]) -> DataFrame:
    """Order per media by (start, speaker) with stable ties; idx from 1."""
    w = Window.partitionBy("media_id").orderBy("start_ms", "speaker", *ties)
    return cues.withColumn("idx", F.row_number().over(w))


def union_intervals(df: DataFrame, keys: Sequence[str], gap_ms: int = 0) -> DataFrame:
    """Union of intervals by key; touching ones, or ones within the gap, join."""
    runs = islands(df, keys, ["start_ms", "end_ms"], gap_ms)
    return runs.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


# windows ------------------------------------------------------------------------------------------------


def clip_window(start: Column, end: Column, pre: int = 1500, post: int = 1500, least: int = 4000, most: int = 12_000) -> tuple[Column, Column]:
    """Padded review window, never before 0: one shorter than `least` is padded by half of what it lacks at both ends, of which what lies before 0 is lost;
    one longer than `most` becomes `most` about the cue's middle."""
    a, b = F.greatest(F.lit(0), start - pre).cast("double"), (end + post).cast("double")
    pad = (least - (b - a)) / 2
    short, wide = (b - a) < least, (b - a) > most
    centred = F.greatest(F.lit(0.0), (start + end) / 2 - most / 2)
    return F.when(short, F.greatest(F.lit(0.0), a - pad)).when(wide, centred).otherwise(a), F.when(short, b + pad).when(wide, centred + most).otherwise(b)


def compact_windows(batch_cues: DataFrame, pre_ms: int = 1000, post_ms: int = 1000, gap_ms: int = 1000) -> DataFrame:
    """Union of the batch's padded cue windows, each cue used once; with each window's offset on the compact clock."""
    once = batch_cues.dropDuplicates(["media_id", "batch_id", "idx"])
    padded = once.select("media_id", "batch_id", F.greatest(F.lit(0), F.col("start_ms") - pre_ms).alias("start_ms"), (F.col("end_ms") + post_ms).alias("end_ms"))
    merged = union_intervals(padded, ["media_id", "batch_id"], gap_ms)
    w = Window.partitionBy("media_id", "batch_id").orderBy("start_ms")
    before = F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return merged.withColumn("offset_ms", before).withColumn("window_id", F.row_number().over(w))


def compact_clock(batch_cues: DataFrame, windows: DataFrame) -> DataFrame:
    """Cue times on the compact clock: those of the first window that contains the cue."""
    pairs = binned_join(batch_cues.select("media_id", "batch_id", "idx", "start_ms", "end_ms"), windows.select("media_id", "batch_id", "start_ms", "end_ms", "offset_ms", "window_id"), "touch", keys=("media_id", "batch_id"))
    held = pairs.where((F.col("a_start_ms") >= F.col("b_start_ms")) & (F.col("a_end_ms") <= F.col("b_end_ms")))
    shift = F.col("b_offset_ms") - F.col("b_start_ms")
    found = held.groupBy(*[F.col(f"a_{c}").alias(c) for c in ("media_id", "batch_id", "idx", "start_ms", "end_ms")]).agg(F.min_by(shift, F.col("b_window_id")).alias("shift"))
    return found.select("media_id", "batch_id", "idx", (F.col("start_ms") + F.col("shift")).alias("clock_start_ms"), (F.col("end_ms") + F.col("shift")).alias("clock_end_ms"))


def continuous_clock(batch_cues: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scenes, cues) on the clock of a request whose scenes play whole, one after the other.

    scenes(media_id, batch_id, scene_id, start_ms, end_ms), batch_cues(media_id, batch_id, scene_id, idx, ..)."""
    w = Window.partitionBy("media_id", "batch_id").orderBy("scene_id")
    long = F.col("end_ms") - F.col("start_ms")
    before = F.coalesce(F.sum(long).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    clock = scenes.select("media_id", "batch_id", "scene_id", "start_ms", "end_ms", before.alias("batch_start_ms"), (before + long).alias("batch_end_ms"))
    shift = F.col("batch_start_ms") - F.col("__from")
    on = batch_cues.join(clock.select("media_id", "batch_id", "scene_id", "batch_start_ms", F.col("start_ms").alias("__from")), ["media_id", "batch_id", "scene_id"])
    return clock, on.select("media_id", "batch_id", "scene_id", "idx", (F.col("start_ms") + shift).alias("clock_start_ms"), (F.col("end_ms") + shift).alias("clock_end_ms"))


def scenes_on_clock(batch_cues: DataFrame, clock: DataFrame) -> DataFrame:
    """First and last moment of each scene of batch_cues(media_id, batch_id, scene_id, idx) on a compact clock; 0 where no cue of it is on the clock."""
    on = batch_cues.select("media_id", "batch_id", "scene_id", "idx").join(clock, ["media_id", "batch_id", "idx"], "left")
    return on.groupBy("media_id", "batch_id", "scene_id").agg(F.coalesce(F.min("clock_start_ms"), F.lit(0)).alias("batch_start_ms"), F.coalesce(F.max("clock_end_ms"), F.lit(0)).alias("batch_end_ms"))


# range joins --------------------------------------------------------------------------------------------


def _level(start: Column, end: Column, base: int) -> Column:
    """The level of an interval: cells of level n are base * 2^n wide, and at its level an interval reaches into two cells, or for one moment three."""
    long = F.greatest(F.lit(1), end - start)
    return F.greatest(F.lit(0), F.ceil(F.log2(long / base))).cast("int")


def _cell(at: Column, level: Column, base: int) -> Column:
    return F.floor(at / (F.pow(F.lit(2.0), level) * base))


def _cells(start: Column, end: Column, level: Column, base: int) -> Column:
    """The cells of a level that an interval reaches into, as structs (level, cell)."""
    first = _cell(start, level, base)
    return F.transform(F.sequence(first, F.greatest(first, _cell(end, level, base))), lambda c: F.struct(level.alias("level"), c.alias("cell")))


def _levels(df: DataFrame, start: str, end: str, base: int) -> Column:
    """The levels that a table has, as a scalar subquery: an array of a few dozen numbers at most."""
    return F.coalesce(df.agg(F.array_sort(F.collect_set(_level(F.col(start), F.col(end), base)))).scalar(), F.array().cast("array<int>"))


def binned_join(a: DataFrame, b: DataFrame, how: str = "overlap", bin_ms: int = BIN_MS, keys: Sequence[str] = ("media_id",)) -> DataFrame:
    """Pairs of rows of one media (of equal `keys`) whose intervals overlap (or touch: how="touch"), as columns a_* and b_*.

    Cells are hierarchical: an interval lies in the two cells or so it reaches into at the level of its own length, whatever that is, and the shorter of
    a pair asks there, with its two cells or so at each longer level that the other side has. So an interval of any length is two or three rows where it lies,
    and asks as often as there are levels, which for lengths within one bin is once. A pair counts in its first shared cell only."""
    put = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    span = lambda p: (F.col(f"{p}_start_ms"), F.col(f"{p}_end_ms"))
    level = lambda p: _level(*span(p), bin_ms)
    of_a, of_b = _levels(a, "start_ms", "end_ms", bin_ms), _levels(b, "start_ms", "end_ms", bin_ms)
    others = F.col("__levels")
    none = F.array().cast("array<struct<asks:string,level:int,cell:bigint>>")
    named = lambda cells, asks: F.transform(cells, lambda c: F.struct(F.lit(asks).alias("asks"), c["level"].alias("level"), c["cell"].alias("cell")))

    def dealt(p: str, asks_at_own: bool) -> Column:
        """Where a side lies for the other's questions (if that has shorter rows to ask, or equal ones), and where it asks."""
        own = level(p)
        asked = F.filter(others, (lambda x: x >= own) if asks_at_own else (lambda x: x > own))
        asks = F.flatten(F.transform(asked, lambda x: _cells(*span(p), x, bin_ms)))
        shorter = F.exists(others, (lambda x: x < own) if asks_at_own else (lambda x: x <= own))
        lies = F.when(shorter, named(_cells(*span(p), own, bin_ms), "b" if asks_at_own else "a")).otherwise(none)
        return F.concat(named(asks, "a" if asks_at_own else "b"), lies)

    x = put(a, "a").withColumn("__levels", of_b).withColumn("__x", F.explode(dealt("a", True))).drop("__levels")
    y = put(b, "b").withColumn("__levels", of_a).withColumn("__y", F.explode(dealt("b", False))).drop("__levels")
    less = (lambda l, r: l < r) if how == "overlap" else (lambda l, r: l <= r)
    on = F.col("__x") == F.col("__y")
    for k in keys:
        on &= F.col(f"a_{k}") == F.col(f"b_{k}")
    both = x.join(y, on).where(less(F.col("a_start_ms"), F.col("b_end_ms")) & less(F.col("b_start_ms"), F.col("a_end_ms")))
    first = lambda p: _cell(F.col(f"{p}_start_ms"), F.col("__x.level"), bin_ms)
    return both.where(F.col("__x.cell") == F.greatest(first("a"), first("b"))).drop("__x", "__y")


def idx_join(points: DataFrame, ranges: DataFrame, lo: str = "start_idx", hi: str = "end_idx", idx: str = "idx", how: str = "inner", width: int = 256) -> DataFrame:
    """Rows of points(media_id, idx, ..) with the ranges of their media that hold their idx, both ends included; left_anti: the points that none holds.

    Ranges lie in the cells of the level of their own length, two or so each; a point asks once at each level there is. A column of ranges that
    points have too is named by its alias r."""
    real = ranges.where(F.col(lo) <= F.col(hi))
    asks = F.transform("__levels", lambda x: F.struct(x.alias("level"), _cell(F.col(idx), x, width).alias("cell")))
    p = points.withColumn("__levels", _levels(real, lo, hi, width)).withColumn("__cell", F.explode(asks)).drop("__levels").alias("p")
    r = real.withColumn("__cell", F.explode(_cells(F.col(lo), F.col(hi), _level(F.col(lo), F.col(hi), width), width))).alias("r")
    on = (F.col("p.media_id") == F.col("r.media_id")) & (F.col("p.__cell") == F.col("r.__cell")) & F.col(f"p.{idx}").between(F.col(f"r.{lo}"), F.col(f"r.{hi}"))
    if how == "left_anti":
        held = p.join(r, on, "left_semi").select("media_id", idx).distinct()
        return points.join(held, ["media_id", idx], "left_anti")
    return p.join(r, on, how)


def attach_segments(cues: DataFrame, audio: DataFrame, segments: DataFrame, label_map: DataFrame | None = None, offset_ms: int = 0, low: float = 0.5) -> DataFrame:
    """Acoustic speaker of each cue: most overlap, `?` on ties; coverage is over the union of all speakers. label_map(media_id, speaker, label) names a media's speakers.

    A cue without length (end = start) overlaps nothing: coverage 0, low, not emitted."""
    shifted = segments.select("media_id", "speaker", (F.col("start_ms") + offset_ms).alias("start_ms"), (F.col("end_ms") + offset_ms).alias("end_ms"))
    # each speaker's own segments are united first; both sides are asked for their levels and then joined, so they are made once and stored
    shifted = stored(union_intervals(shifted, ["media_id", "speaker"]))
    cues = stored(cues.select("media_id", "idx", "start_ms", "end_ms", "speaker"))
    pairs = binned_join(cues.drop("speaker"), shifted)
    clipped = pairs.select(F.col("a_media_id").alias("media_id"), F.col("a_idx").alias("idx"), F.col("b_speaker").alias("segment_speaker"), F.greatest("a_start_ms", "b_start_ms").alias("start_ms"), F.least("a_end_ms", "b_end_ms").alias("end_ms"))
    # what a part adds to the union of those before it; windows and sums by cue share one shuffle
    before = F.max("end_ms").over(Window.partitionBy("media_id", "idx").orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1))
    clipped = clipped.withColumn("added", F.greatest(F.lit(0), F.col("end_ms") - F.greatest("start_ms", before)))
    per = clipped.groupBy("media_id", "idx", "segment_speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.sum("added").alias("added"))
    best = per.groupBy("media_id", "idx").agg(F.max("ms").alias("most"), F.array_sort(F.collect_list(F.struct("segment_speaker", "ms"))).alias("overlaps"), F.sum("added").alias("covered_ms"))
    top = F.filter("overlaps", lambda x: x["ms"] == F.col("most"))
    best = best.select("media_id", "idx", "overlaps", "covered_ms", F.when(F.size(top) == 1, top[0]["segment_speaker"]).otherwise("?").alias("candidate"))
    out = cues.join(best, ["media_id", "idx"], "left").join(audio.select("media_id", "duration_ms"), "media_id")
    candidate = F.coalesce("candidate", F.lit("?"))
    if label_map is not None:
        out = out.join(label_map.select("media_id", F.col("label").alias("__label"), F.col("speaker").alias("candidate")), ["media_id", "candidate"], "left")
        candidate = F.coalesce("__label", "candidate", F.lit("?"))
    long = F.col("end_ms") - F.col("start_ms")
    coverage = F.when(long > 0, F.coalesce("covered_ms", F.lit(0)) / F.when(long > 0, long)).otherwise(0.0)
    inside = F.greatest(F.lit(0), F.least(F.col("end_ms"), F.col("duration_ms") + offset_ms) - F.greatest(F.col("start_ms"), F.lit(offset_ms)))
    emitted = inside > 0
    return out.select(
        "media_id",
        "idx",
        F.coalesce("candidate", F.lit("?")).alias("candidate"),
        F.when(F.col("speaker") == "NONSPEECH", "NONSPEECH").otherwise(candidate).alias("chosen"),
        F.array_join(F.transform(F.coalesce("overlaps", F.array().cast("array<struct<segment_speaker:string,ms:bigint>>")), lambda x: F.concat_ws("=", x["segment_speaker"], x["ms"].cast("string"))), ",").alias("overlaps"),
        coverage.alias("coverage"),
        (coverage < low).alias("coverage_low"),
        emitted.alias("emitted"),
        (emitted & ((F.col("start_ms") < offset_ms) | (F.col("end_ms") > F.col("duration_ms") + offset_ms))).alias("boundary_crossing"),
    )


def map_scenes(scenes: DataFrame, cues: DataFrame, allow_partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scenes with first and last covered idx, errors): a cue belongs where its midpoint lies, both ends included.

    Errors: cues in several scenes or, unless allow_partial, in none, and scenes without a cue."""
    middle = cues.select("media_id", "idx", ((F.col("start_ms") + F.col("end_ms")) / 2).alias("start_ms"), ((F.col("start_ms") + F.col("end_ms")) / 2).alias("end_ms"))
    pairs = binned_join(middle, scenes.select("media_id", "scene_id", "start_ms", "end_ms"), "touch")
    hits = pairs.select(F.col("a_media_id").alias("media_id"), F.col("a_idx").alias("idx"), F.col("b_scene_id").alias("scene_id"))
    per_cue = cues.select("media_id", "idx").join(hits.groupBy("media_id", "idx").agg(F.count("*").alias("n")), ["media_id", "idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    covered = hits.groupBy("media_id", "scene_id").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n_cues"))
    out = scenes.select("media_id", "scene_id").join(covered, ["media_id", "scene_id"], "left")
    errors = per_cue.where("n > 1").select("media_id", F.lit("cue in several scenes").alias("error"), F.col("idx").alias("id"))
    if not allow_partial:
        errors = errors.union(per_cue.where("n = 0").select("media_id", F.lit("cue in no scene"), "idx"))
    errors = errors.union(out.where("n_cues IS NULL").select("media_id", F.lit("empty scene"), "scene_id"))
    return out.where("n_cues IS NOT NULL"), errors


def preceding_context(scenes: DataFrame, cues: DataFrame, ctx_ms: int = 15_000) -> DataFrame:
    """(scene, cue) pairs: cues before the scene's first, still heard within ctx_ms before its start."""
    first = scenes.select("media_id", "scene_id", F.col("start_idx").alias("first_idx"), F.greatest(F.lit(0), F.col("start_ms") - ctx_ms).alias("start_ms"), F.col("start_ms").alias("end_ms"))
    pairs = binned_join(cues.select("media_id", "idx", "start_ms", "end_ms"), first, "touch")
    kept = pairs.where((F.col("a_idx") < F.col("b_first_idx")) & (F.col("a_end_ms") >= F.col("b_start_ms")) & (F.col("a_start_ms") < F.col("b_end_ms")))
    return kept.select(F.col("a_media_id").alias("media_id"), F.col("b_scene_id").alias("scene_id"), F.col("a_idx").alias("idx"))


# conflicts ----------------------------------------------------------------------------------------------


def drop_cross_speaker(cues: DataFrame, threshold_ms: int = 0, split_over: int | None = None) -> DataFrame:
    """Greedy removal of pairs of different speakers that overlap by more than the threshold.

    In order of (start, end), a cue still there and the first later one it conflicts with go together. The sweep carries only cues that are still
    there and still heard, so a step costs the number of voices at that moment, whatever the media's length. The first of the carried cues that the next one
    conflicts with goes with it; that is the pair the order asks for, since every carried cue has met all cues before."""
    real = cues.where(~F.col("speaker").isin("?", "NONSPEECH"))
    kind = lambda c: cues.schema[c].dataType.simpleString()
    gone = sweep(real, ["media_id"], ["start_ms", "end_ms", "idx"], ["start_ms", "end_ms", "idx", "speaker"], cues_heard(threshold_ms), f"media_id {kind('media_id')}, idx {kind('idx')}", split_over)
    return cues.join(gone, ["media_id", "idx"], "left_anti")


def rebase(cues: DataFrame, offset_ms: int, first: int | None = None, last: int | None = None, label: str | None = r"^\S+ ") -> DataFrame:
    """Cues first..last with their times moved by offset_ms and what `label` matches cut from their texts."""
    out = cues if first is None else cues.where(F.col("idx") >= first)
    out = out if last is None else out.where(F.col("idx") <= last)
    out = out.withColumns({c: F.col(c) + offset_ms for c in ("start_ms", "end_ms")})
    return out if label is None else out.withColumn("text", F.regexp_replace("text", label, ""))
