"""Alignment of gold cues and predictions, and scores.

Both tables are per media; keys are milliseconds and the match key of the text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import stored
from .intervals import binned_join

# Names of alignment methods in scored output.
METHODS = ("exact_timestamp_text", "unique_text_time_overlap", "structural_text_containment_overlap", "unmatched")


def align(gold: DataFrame, preds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, unmatched predictions) of gold(media_id, idx, ..) and preds(media_id, pid, ..).

    1. exact times and text, if one prediction has the key: the first gold cue with the key gets it;
    2. text that is unique on both sides among what is left, and time overlap;
    3. overlap and containment of one text in the other, against all predictions, best first.

    Keys are made once and stored with the cues; steps 1 and 2 are aggregates that combine before they shuffle. The matches keep the gold
    cue's `key`."""
    g = stored(gold.withColumn("key", X.match_key(F.col("text"))))
    p = stored(preds.withColumn("key", X.match_key(F.col("text"))))
    at = ["media_id", "start_ms", "end_ms", "key"]
    sole = p.groupBy(*at).agg(F.count("*").alias("__n"), F.min("pid").alias("pid")).where("__n = 1").select(*at, "pid")
    first = g.groupBy(*at).agg(F.min("idx").alias("idx"))
    exact = first.join(sole, at).select("media_id", "idx", "pid", F.lit(METHODS[0]).alias("method"))
    # what is left, by text
    g2 = g.join(exact, ["media_id", "idx"], "left_anti")
    p2 = p.join(exact, ["media_id", "pid"], "left_anti")
    one = lambda df, c: df.groupBy("media_id", "key").agg(F.count("*").alias("n"), F.min(F.struct(c, "start_ms", "end_ms")).alias(c + "_")).where("n = 1").drop("n")
    both = one(g2, "idx").join(one(p2, "pid"), ["media_id", "key"])
    overlap = (F.col("idx_.start_ms") < F.col("pid_.end_ms")) & (F.col("pid_.start_ms") < F.col("idx_.end_ms"))
    unique = both.where(overlap).select("media_id", F.col("idx_.idx").alias("idx"), F.col("pid_.pid").alias("pid"), F.lit(METHODS[1]).alias("method"))
    # what is left against all predictions
    g3 = g2.join(unique, ["media_id", "idx"], "left_anti")
    pairs = binned_join(g3.select("media_id", "idx", "start_ms", "end_ms", "key"), p.select("media_id", "pid", "start_ms", "end_ms", "key"))
    inside = lambda a, b: (F.col(b) != "") & F.col(a).contains(F.col(b))
    pairs = pairs.where((F.col("a_key") == F.col("b_key")) | inside("a_key", "b_key") | inside("b_key", "a_key"))
    shared = F.least("a_end_ms", "b_end_ms") - F.greatest("a_start_ms", "b_start_ms")
    ratio = shared / F.greatest(F.lit(1), F.least(F.col("a_end_ms") - F.col("a_start_ms"), F.col("b_end_ms") - F.col("b_start_ms")))
    apart = F.abs(F.col("a_start_ms") + F.col("a_end_ms") - F.col("b_start_ms") - F.col("b_end_ms"))
    length = F.abs(F.char_length("a_key") - F.char_length("b_key"))
    best = pairs.withColumn("__rn", F.row_number().over(Window.partitionBy("a_media_id", "a_idx").orderBy(ratio.desc(), apart, length, "b_pid"))).where("__rn = 1")
    structural = best.select(F.col("a_media_id").alias("media_id"), F.col("a_idx").alias("idx"), F.col("b_pid").alias("pid"), F.lit(METHODS[2]).alias("method"))
    found = exact.unionByName(unique).unionByName(structural)
    further = [F.col(c).alias(n) for c, n in (("input_speaker", "input_speaker"), ("tags", "pred_tags")) if c in preds.columns]
    said = preds.select("media_id", "pid", F.col("speaker").alias("pred_speaker"), F.col("speaker_raw").alias("pred_raw"), "confidence", *further)
    matches = g.select("media_id", "idx", "start_ms", "end_ms", "speaker", "text", "key").join(found, ["media_id", "idx"], "left").join(said, ["media_id", "pid"], "left")
    matches = matches.withColumn("method", F.coalesce("method", F.lit(METHODS[3])))
    return matches, preds.join(found, ["media_id", "pid"], "left_anti")


def judged(matches: DataFrame, cast: Sequence[str]) -> DataFrame:
    """matches with target, accepted labels, class, predicted label and whether it is right."""
    target, accepted, kind = X.gold_target(F.col("speaker"), cast)
    out = matches.withColumns({"target": target, "accepted": accepted, "kind": kind, "predicted": F.coalesce("pred_speaker", F.lit("UNMATCHED"))})
    return out.withColumn("right", F.array_contains("accepted", F.col("predicted")))


def slices(j: DataFrame, main: Sequence[str]) -> DataFrame:
    """Accuracy by (overlapping) slices, in one pass."""
    key = F.col("key") if "key" in j.columns else X.match_key(F.col("text"))
    j = j.withColumns({"__short": X.short_text(key), "__cry": X.interjection(key)})
    parts: dict[str, Column] = {"overall": F.lit(True), "canonical": F.col("kind") == "canonical", "main": F.col("target").isin(*main), "other": F.col("kind") == "other", "nonspeech": F.col("kind") == "nonspeech", "combination": F.col("kind") == "combination", "short": F.col("__short"), "interjection": F.col("__cry")}
    counts = [c for k, on in parts.items() for c in (F.count_if(on).alias(f"{k}_n"), F.count_if(on & F.col("right")).alias(f"{k}_r"))]
    stack = ", ".join(f"'{k}', {k}_r, {k}_n" for k in parts)
    out = j.agg(*counts).selectExpr(f"stack({len(parts)}, {stack}) AS (slice, correct, total)")
    return out.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")))


def per_speaker(j: DataFrame, cast: Sequence[str]) -> DataFrame:
    """True and false positives, support, precision and recall of each label."""
    labels = j.sparkSession.createDataFrame([(x,) for x in sorted({*cast, "OTHER", "NONSPEECH"})], "label string")
    small = j.groupBy("target", "kind", "predicted", "accepted").agg(F.count("*").alias("n"))
    x = small.crossJoin(F.broadcast(labels))  # combinations of labels by the fixed cast, not rows by rows
    own = (F.col("target") == F.col("label")) & (F.col("kind") != "combination")
    hit = own & F.array_contains("accepted", F.col("predicted"))
    false = ~hit & (F.col("predicted") == F.col("label")) & ~F.array_contains("accepted", F.col("label"))
    total = lambda on: F.sum(F.when(on, F.col("n")).otherwise(0))
    out = x.groupBy("label").agg(total(own).alias("support"), total(hit).alias("tp"), total(false).alias("fp"))
    return out.withColumns({"precision": F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))), "recall": F.when(F.col("support") > 0, F.col("tp") / F.col("support"))})


# Nominal accuracy of a stated confidence.
NOMINAL = {"high": 0.9, "mid": 0.6, "low": 0.3}


def calibration(j: DataFrame) -> DataFrame:
    """Confidence bins with their share of the expected calibration error and the Brier score."""
    nominal = F.create_map(*[F.lit(x) for kv in NOMINAL.items() for x in kv])[F.col("confidence")]
    b = j.where("pid IS NOT NULL").groupBy("confidence").agg(F.count("*").alias("n"), F.count_if("right").alias("correct"))
    b = b.withColumn("nominal", nominal).withColumn("accuracy", F.col("correct") / F.col("n"))
    known = F.sum(F.when(F.col("nominal").isNotNull(), F.col("n"))).over(Window.partitionBy())  # a row a confidence
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("nominal")) / known
    brier = (F.col("correct") * F.pow(F.col("nominal") - 1, F.lit(2)) + (F.col("n") - F.col("correct")) * F.pow(F.col("nominal"), F.lit(2))) / known
    return b.withColumns({"ece_part": gap, "brier_part": brier})


def alignment_summary(matches: DataFrame, unmatched: DataFrame) -> DataFrame:
    counts = matches.groupBy("method").agg(F.count("*").alias("n"))
    extra = unmatched.agg(F.count("*").alias("n")).select(F.lit("unmatched_predictions").alias("method"), "n")
    distinct = matches.where("pid IS NOT NULL").agg(F.count_distinct("media_id", "pid").alias("n")).select(F.lit("used_predictions").alias("method"), "n")
    return counts.union(extra).union(distinct)


def confusion(j: DataFrame) -> DataFrame:
    return j.where(~F.col("right")).groupBy("target", "predicted").agg(F.count("*").alias("n"))


def combination_detail(j: DataFrame) -> DataFrame:
    """How often each combination of gold speakers was given each label."""
    return j.where(F.col("kind") == "combination").groupBy("speaker", "predicted").agg(F.count("*").alias("n"))


def predicted_on(j: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """For each (gold speaker, label): how many of the speaker's cues were given the label, and how many there are."""
    pair = j.sparkSession.createDataFrame([tuple(p) for p in pairs], "gold string, label string")
    small = j.groupBy(F.col("speaker").alias("gold"), "predicted").agg(F.count("*").alias("n"))
    x = F.broadcast(pair).join(small, "gold", "left")
    return x.groupBy("gold", "label").agg(F.coalesce(F.sum(F.when(F.col("predicted") == F.col("label"), F.col("n"))), F.lit(0)).alias("given"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def swaps(j: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """For each named pair: first taken for second, second for first, right on either."""
    pair = j.sparkSession.createDataFrame([tuple(p) for p in pairs], "a string, b string")
    small = j.groupBy("target", "predicted").agg(F.count("*").alias("n"), F.count_if("right").alias("r"))
    x = small.join(F.broadcast(pair), (F.col("target") == F.col("a")) | (F.col("target") == F.col("b")))
    of = lambda t, p: F.sum(F.when((F.col("target") == F.col(t)) & (F.col("predicted") == F.col(p)), F.col("n")).otherwise(0))
    return x.groupBy("a", "b").agg(of("a", "b").alias("a_as_b"), of("b", "a").alias("b_as_a"), F.sum("r").alias("correct"), F.sum("n").alias("total"))


def error_sample(j: DataFrame, buckets: Column, order: Sequence[str], n: int = 40) -> DataFrame:
    """n errors, taken in turn from the buckets in their order."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("__b"))
    e = j.where(~F.col("right")).withColumn("__b", buckets).withColumn("bucket_order", rank).where("bucket_order > 0")
    turn = F.row_number().over(Window.partitionBy("bucket_order").orderBy("media_id", "idx"))
    few = e.withColumn("turn", turn).where(F.col("turn") <= n)  # a bucket gives n at most
    return few.withColumnRenamed("__b", "bucket").orderBy("turn", "bucket_order").limit(n)


def compare_policies(raw: DataFrame, final: DataFrame, cast: Sequence[str]) -> DataFrame:
    """Changed, fixed and broken labels of two judged matchings of one gold; and the same, with what is right, of the hypothetical in which an explicit label of a
    prediction's input (input_speaker, without pred_tags) would have been locked. Both need the predictions' input_speaker and tags, which align() carries."""
    locked = F.when(F.col("pid").isNotNull() & ~F.coalesce("input_speaker", F.lit("")).isin("?", "NONSPEECH", "") & (F.coalesce(F.size("pred_tags"), F.lit(0)) <= 0), X.prediction_label(F.col("input_speaker"), cast))
    a = raw.select("media_id", "idx", F.col("predicted").alias("p"), F.col("right").alias("r"), F.coalesce(locked, "predicted").alias("k"), "accepted")
    b = final.select("media_id", "idx", F.col("predicted").alias("q"), F.col("right").alias("s"))
    x = a.join(b, ["media_id", "idx"]).withColumn("t", F.array_contains("accepted", F.col("k")))
    r, s, t, n = F.col("r"), F.col("s"), F.col("t"), F.count_if
    moved = F.col("k") != F.col("p")
    return x.agg(F.count("*").alias("total"), n(F.col("p") != F.col("q")).alias("changed"), n(~r & s).alias("fixed"), n(r & ~s).alias("broken"), n(t).alias("locked_correct"), n(moved).alias("locked_changed"), n(moved & ~r & t).alias("locked_fixed"), n(moved & r & ~t).alias("locked_broken"))


def diff_cues(a: DataFrame, b: DataFrame, tol_ms: float = 0.5, source: bool = False) -> DataFrame:
    """Rows in which two cue tables differ, and how: times by more than tol_ms, speaker, tags in their order, text, and with `source` the source entries."""
    x, y = a.alias("x"), b.alias("y")
    on = (F.col("x.media_id") == F.col("y.media_id")) & (F.col("x.idx") == F.col("y.idx"))
    j = x.join(y, on, "full_outer")
    far = lambda c: F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) > tol_ms
    what = F.when(F.col("y.idx").isNull(), "only in first").when(F.col("x.idx").isNull(), "only in second").when(far("start_ms") | far("end_ms"), "time")
    for c, name in (("speaker", "speaker"), ("tags", "tags"), ("text", "text"), *([("source_entries", "source")] if source else [])):
        what = what.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), name)
    return j.select(F.coalesce("x.media_id", "y.media_id").alias("media_id"), F.coalesce("x.idx", "y.idx").alias("idx"), what.alias("difference")).where("difference IS NOT NULL")


def score_clusters(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, metrics) per method: purity of each cluster and of the long samples; accuracy and unknown rate of short ones under the long samples' mapping.

    samples(method, stage, gold, predicted); UNKNOWN counts as wrong. Ties of a mapping go to the lesser label."""
    long = samples.where((F.col("stage") == "long") & (F.col("predicted") != "UNKNOWN"))
    votes = long.groupBy("method", "predicted", "gold").agg(F.count("*").alias("n"))
    best = votes.groupBy("method", "predicted").agg(F.min_by("gold", F.struct(-F.col("n"), F.col("gold"))).alias("mapped"), F.max("n").alias("top"), F.sum("n").alias("samples"))
    clusters = best.select("method", F.col("predicted").alias("cluster"), F.col("mapped").alias("gold_speaker"), "samples", (F.col("top") / F.col("samples")).alias("purity"))
    x = samples.join(best, ["method", "predicted"], "left")
    right = F.coalesce(F.col("mapped") == F.col("gold"), F.lit(False))
    is_long, is_short = F.col("stage") == "long", F.col("stage") == "short"
    out = x.groupBy("method").agg(F.count_if(is_long & right).alias("long_right"), F.count_if(is_long).alias("n_long"), F.count_if(is_short & right).alias("short_right"), F.count_if(is_short).alias("n_short"), F.count_if(is_short & (F.col("predicted") == "UNKNOWN")).alias("short_unknown"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return clusters, out.withColumns({"purity": ratio("long_right", "n_long"), "accuracy": ratio("short_right", "n_short"), "unknown_rate": ratio("short_unknown", "n_short")})


def gates(metrics: DataFrame, base: str, candidate: str, purity: float = 0.95, accuracy: float = 0.85, unknown: float = 0.30, least_gain: float = 0.05) -> DataFrame:
    """The candidate method's four gates against the base method, and whether all hold: shares and gain of accuracy are parameters, at their
    published values but for purity, which has none; a share that does not exist fails its gate."""
    of = lambda m, p: metrics.where(F.col("method") == m).select(F.lit(candidate).alias("method"), *[F.col(c).alias(p + c) for c in ("purity", "accuracy", "unknown_rate")])
    x = of(candidate, "").join(of(base, "base_"), "method", "left")
    gain = F.col("accuracy") - F.col("base_accuracy")
    rules = {"long_purity": F.col("purity") >= purity, "short_accuracy": F.col("accuracy") >= accuracy, "short_unknown": F.col("unknown_rate") <= unknown, "improvement": gain >= least_gain}
    out = x.select("method", gain.alias("short_accuracy_gain"), *[F.coalesce(on, F.lit(False)).alias(k) for k, on in rules.items()])
    return out.withColumn("passed", F.expr(" AND ".join(rules)))
