"""Counts and profiles of cue, style and result tables, and rule checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import drop_overrides, strip
from ..scratch import stored


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def frequent(df: DataFrame, column: str, top: int, counters: int = 4096) -> DataFrame:
    """(column): a superset of the `top` most frequent values of a column, ties for the last place and null included if they may be among them.

    Every task keeps a summary of `counters` values at most: when it is full, the count of the first value that has no place is taken from all, and
    added to the task's error. A value's true count is then its sum over tasks, or up to the sum of all errors more; what cannot reach the
    `top`-th greatest sum so goes. A value that no summary has occurs as often as all errors add up to at most: where that reaches the bound, the summaries
    are made again eight times as long. Only summaries are shuffled."""
    kind = df.schema[column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        error = 0
        for b in batches:
            for x in b.column(0).value_counts().to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            if len(held) > 2 * counters:
                least = sorted(held.values(), reverse=True)[counters]
                held = {v: n - least for v, n in held.items() if n > least}
                error += least
        values = [*held, None]
        yield pa.RecordBatch.from_arrays([pa.array(values, to_arrow_type(kind)), pa.array([*held.values(), error], pa.int64()), pa.array([False] * len(held) + [True])], ["v", "n", "is_error"])

    summary = df.select(F.col(column).alias("v")).mapInArrow(run, T.StructType([T.StructField("v", kind), T.StructField("n", T.LongType()), T.StructField("is_error", T.BooleanType())]))
    summary = stored(summary.groupBy("v", "is_error").agg(F.sum("n").alias("n")))
    lost = summary.where("is_error").first()
    error = lost["n"] if lost else 0
    best = summary.where("NOT is_error").orderBy(F.desc("n")).limit(top).agg(F.min("n").alias("n"), F.count("*").alias("found")).first()
    bound = best["n"] if best["found"] == top else 0
    if error and error >= bound:
        return frequent(df, column, top, 8 * counters)
    return summary.where(~F.col("is_error") & (F.col("n") + error >= bound)).select(F.col("v").alias(column))


def speaker_profile(cues: DataFrame, top: int = 100, samples: int = 1, counters: int = 4096) -> DataFrame:
    """The `top` speakers by count (ties: first appearance), with the sorted set of their raw variants and first lines.

    Two passes: frequent() bounds who may be among them, and only their cues are counted exactly. Only the first lines reach the
    aggregate: a running number per speaker filters before lists are made."""
    own = cues.select("speaker", "raw", "text", "media_id", "idx")
    own = own.join(frequent(own, "speaker", top, counters).where("speaker IS NOT NULL"), "speaker", "left_semi")
    w = Window.partitionBy("speaker").orderBy("media_id", "idx")
    first = own.select("speaker", "text", "media_id", "idx").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= samples)
    lines = first.groupBy("speaker").agg(F.array_sort(F.collect_list(F.struct("rn", "text"))).alias("i")).select("speaker", F.transform("i", lambda x: x["text"]).alias("samples"))
    # a row a variant before the sets are made
    by_raw = own.groupBy("speaker", "raw").agg(F.count("*").alias("n"), F.min(F.struct("media_id", "idx")).alias("first"))
    counts = by_raw.groupBy("speaker").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.array_sort(F.collect_list("raw")).alias("variants"))
    return counts.join(lines, "speaker").orderBy(F.desc("n"), "first").limit(top).drop("first")


def output_speakers(cues: DataFrame) -> DataFrame:
    return cues.groupBy("media_id", "speaker").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))


def style_profile(events: DataFrame, stretch: int = 4096) -> DataFrame:
    """Per media (if events have one) and style: count, counts by event type, layer and name (empty ones aside) as maps, flag sums, and the first, middle and last event with its
    source_event_index, its start and its visible text, cut at 240.

    The middle event is found by counts of stretches of event_index and then by a window over one stretch, so a style that most events have is
    never in one task."""
    by = [c for c in ("media_id", "style") if c in events.columns]
    pairs = lambda c: events.where(F.col(c).cast("string") != "").groupBy(*by, F.col(c).cast("string").alias("k")).agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(c))
    flags = [c for c in ("drawing", "positioned", "karaoke", "top") if c in events.columns]
    n = events.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in flags])
    start = F.col("start_raw" if "start_raw" in events.columns else "start_ms")
    sample = F.struct(F.col("event_index").alias("source_event_index"), start.alias("start"), F.substring(visible_text(F.col("text")), 1, 240).alias("text"))
    at = events.select(*by, "event_index", sample.alias("sample"), F.floor(F.col("event_index") / stretch).alias("s"))
    ends = at.groupBy(*by).agg(F.min_by("sample", "event_index").alias("a"), F.max_by("sample", "event_index").alias("z"))
    w = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    parts = at.groupBy(*by, "s").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0))).join(n.select(*by, F.floor(F.col("n") / 2).alias("want")), by)
    place = parts.where((F.col("before") <= F.col("want")) & (F.col("want") < F.col("before") + F.col("m"))).select(*by, "s", (F.col("want") - F.col("before")).alias("want"))
    inside = at.join(place, [*by, "s"]).withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("event_index")) - 1)
    middle = inside.where(F.col("rn") == F.col("want")).select(*by, F.col("sample").alias("m"))
    samples = ends.join(middle, by).select(*by, F.array_sort(F.array_distinct(F.array("a", "m", "z"))).alias("samples"))
    out = n.join(pairs("event_type"), by).join(pairs("layer"), by).join(samples, by)
    if "name" in events.columns:
        out = out.join(pairs("name"), by, "left")
    return out


def clip_report(clips: DataFrame) -> DataFrame:
    """Per speaker and kind: clips, cues in them, duration."""
    return clips.groupBy("speaker", "kind").agg(F.count("*").alias("clips"), F.sum("n_merged").alias("cues"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))


def clip_stages(overlap: DataFrame, used: DataFrame, merged: DataFrame, long: DataFrame) -> DataFrame:
    """Per media and speaker: clips after the overlap merge (of single and of shared cues, and cues joined), after the cap, after the adjacent merge and
    after the minimum duration, the duration after the cap, and how many clips have each raw speaker."""
    by = ["media_id", "speaker"]
    total = overlap.groupBy(*by).agg(F.count("*").alias("clips_total"), F.count_if(F.col("kind") == "single").alias("from_single"), F.count_if(F.col("kind") == "multi").alias("from_multi"), F.sum(F.col("n_merged") - 1).alias("overlap_merged"))
    capped = used.groupBy(*by).agg(F.count("*").alias("after_cap"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("used_ms"))
    n = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    raw = used.groupBy(*by, "raw_speaker").agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("raw_speaker", "n")))).alias("variants"))
    out = total.join(capped, by, "left").join(n(merged, "after_merge"), by, "left").join(n(long, "after_min_dur"), by, "left").join(raw, by, "left")
    return out.na.fill(0, ["after_cap", "used_ms", "after_merge", "after_min_dur"])


def alias_coverage(resolved: DataFrame) -> DataFrame:
    """Cues by speaker, and whether an alias gave it."""
    return counts_by(resolved, "speaker", "alias_hit")


def alias_misses(resolved: DataFrame, top: int = 15) -> DataFrame:
    """The variants without an alias that most cues have; ties by first cue."""
    missed = resolved.where(~F.col("alias_hit") & (F.col("token") != ""))
    return missed.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("media_id", "idx")).alias("first")).orderBy(F.desc("n"), "first").limit(top).drop("first")


def normalise_stats(resolved: DataFrame) -> DataFrame:
    """Alias hits and misses of single cues and of parts of shared ones, and empties, of resolved(is_multi, alias_hit, text)."""
    multi, hit, empty = F.col("is_multi"), F.col("alias_hit"), F.col("text") == ""
    n = F.count_if
    return resolved.agg(F.count("*").alias("total"), n(~multi & hit & ~empty).alias("alias_hit_singles"), n(~multi & ~hit & ~empty).alias("alias_miss_singles"), n(multi & hit & ~empty).alias("alias_hit_parts"), n(multi & ~hit & ~empty).alias("alias_miss_parts"), n(empty).alias("empty_dropped"))


def kept_by_kind(rows: DataFrame) -> DataFrame:
    """Rows kept and dropped of each kind of rows(kind, text): single and multi ones without a text go, nonspeech and unlabeled ones stay."""
    drop = F.col("kind").isin("single", "multi") & (F.col("text") == "")
    return rows.groupBy("kind").agg(F.count_if(~drop).alias("kept"), F.count_if(drop).alias("dropped"))


def drop_reasons(bucketed: DataFrame) -> DataFrame:
    """Cues by the reason they were dropped for."""
    return counts_by(bucketed.withColumn("reason", F.coalesce("dropped_for", F.lit("kept"))), "reason")


def token_means(usage: DataFrame, *keys: str) -> DataFrame:
    """Rows, rows with a token count, and the mean count, of usage(.., total_tokens)."""
    return usage.groupBy(*keys).agg(F.count("*").alias("n"), F.count("total_tokens").alias("n_with_tokens"), F.avg("total_tokens").alias("mean_tokens"))


def visible_text(text: Column) -> Column:
    """What an event shows: overrides out, line breaks and hard spaces as such, lines trimmed, empty ones out."""
    plain = F.replace(F.regexp_replace(drop_overrides(text), r"\\[Nn]", "\n"), F.lit("\\h"), F.lit(" "))
    return F.array_join(F.filter(F.transform(F.split(plain, r"\r\n|[\n\r]"), strip), lambda x: x != ""), "\n")


def apply_policy(events: DataFrame, policy: DataFrame, event_types: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events with action, violations) of events(media_id, ..) under the policy of their own media. Dialogue acts by its style, and a style that policy(media_id, style, action)
    lacks is an error; other events act by event_types(media_id, event_type, action), or are for review. Kept events must have visible text, 0 <= start <= end and no drawing."""
    x = events.join(policy.select("media_id", "style", F.col("action").alias("__a")), ["media_id", "style"], "left")
    other = F.lit("review")
    if event_types is not None:
        x = x.join(event_types.select("media_id", "event_type", F.col("action").alias("__t")), ["media_id", "event_type"], "left")
        other = F.coalesce("__t", other)
    x = x.withColumn("action", F.when(F.col("event_type") != "Dialogue", other).otherwise(F.coalesce("__a", F.lit("error")))).drop("__a", "__t")
    kept = F.col("action") == "keep_dialogue"
    time = (F.col("start_ms") < 0) | (F.col("end_ms") < F.col("start_ms")) | F.col("start_ms").isNull() | F.col("end_ms").isNull()
    rule = F.when(F.col("action") == "error", "unknown style").when(kept & F.col("drawing"), "drawing").when(kept & (visible_text(F.col("text")) == ""), "empty text").when(kept & time, "bad time")
    return x, x.select("media_id", "event_index", "style", rule.alias("violation")).where("violation IS NOT NULL")


def check_expected(actions: DataFrame, kept_events: int | None = None, review_events: int | None = None) -> DataFrame:
    """(problem, expected, found): counts of actions(action, n) that are not those the policy expects; events left for review are one too."""
    n = lambda a: F.coalesce(F.sum(F.when(F.col("action") == a, F.col("n"))), F.lit(0))
    rows = [F.struct(F.lit(p).alias("problem"), F.lit(e).cast("long").alias("expected"), n(a).alias("found")) for p, e, a in (("kept events", kept_events, "keep_dialogue"), ("review events", review_events, "review")) if e is not None]
    rows.append(F.struct(F.lit("review to resolve").alias("problem"), F.lit(0).cast("long").alias("expected"), n("review").alias("found")))
    return actions.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*").where("expected <> found")


def check_policy(events: DataFrame, policy: DataFrame) -> DataFrame:
    """(media_id, style, problem): styles that only one of a media's events and its policy has."""
    by = ["media_id", "style"]
    seen, known = events.select(*by).distinct(), policy.select(*by).distinct()
    return seen.join(known, by, "left_anti").withColumn("problem", F.lit("not in policy")).union(known.join(seen, by, "left_anti").withColumn("problem", F.lit("not seen")))


def check_cues(cues: DataFrame) -> DataFrame:
    """Rows that break a rule: idx runs from 1, text not blank, 0 <= start <= end, known tags, no overrides and no U+FFFD left."""
    w = Window.partitionBy("media_id").orderBy("idx")
    rules = {
        "idx not continuous": F.col("idx") != F.row_number().over(w),
        "empty text": strip(F.col("text")) == "",
        "bad time": (F.col("start_ms") < 0) | (F.col("end_ms") < F.col("start_ms")),
        "unknown tag": F.size(F.array_except("tags", F.array(F.lit("MULTI"), F.lit("MERGED")))) > 0,
        "override left": F.col("text").rlike(r"\{[^}]*\}"),
        "replacement character": F.contains("text", F.lit("\ufffd")),
    }
    x = cues.select("media_id", "idx", F.filter(F.array(*[F.when(on, name) for name, on in rules.items()]), lambda r: r.isNotNull()).alias("r"))
    return x.select("media_id", "idx", F.explode("r").alias("rule"))
