"""Scenes, batches, context and prompts: ordered work per media."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shown_text
from ..scratch import stored
from .intervals import idx_join
from .sweep import sweep


def review_target(c: str = "") -> Column:
    """Not nonspeech, no lyric mark, and an unknown or shared speaker."""
    return speech(c) & ((F.col(f"{c}speaker") == "?") | F.array_contains(f"{c}tags", "MULTI"))


def speech(c: str = "") -> Column:
    return ~F.col(f"{c}speaker").startswith("NONSPEECH") & ~F.col(f"{c}text").rlike("[♪♫♬]")


def select_cues(cues: DataFrame, mode: str = "all", idxs: list[int] | None = None, first: int | None = None, last: int | None = None, cast: list[str] | None = None) -> DataFrame:
    """By list or range of idx, and by mode: all, review-targets, unknown, canonical."""
    out = cues
    if idxs is not None:
        out = out.where(F.col("idx").isin(*idxs))
    if first is not None:
        out = out.where(F.col("idx") >= first)
    if last is not None:
        out = out.where(F.col("idx") <= last)
    rules = {"all": F.lit(True), "review-targets": review_target(), "unknown": F.col("speaker") == "?", "canonical": F.col("speaker").isin(*(cast or []))}
    return out.where(rules[mode])


def scenes_from_cuts(cues: DataFrame, cuts: DataFrame, pre_ms: int = 1500, post_ms: int = 1500) -> DataFrame:
    """Scenes between cuts(media_id, after_idx): bounds, padded times, cue count."""
    marked = cues.join(cuts.select("media_id", F.col("after_idx").alias("idx"), F.lit(1).alias("__cut")), ["media_id", "idx"], "left")
    w = Window.partitionBy("media_id").orderBy("idx")
    numbered = marked.withColumn("scene_id", 1 + F.coalesce(F.sum(F.coalesce("__cut", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.groupBy("media_id", "scene_id").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.greatest(F.lit(0), F.min("start_ms") - pre_ms).alias("start_ms"), (F.max("end_ms") + post_ms).alias("end_ms"), F.count("*").alias("n_cues"))


def refine_target(scenes: DataFrame, max_ms: int = 75_000, min_ms: int = 5_000, max_cues: int = 0) -> DataFrame:
    """Adds `target`: too long, too many cues, too short, a single cue, or an end that is no confirmed cut."""
    long = F.col("end_ms") - F.col("start_ms")
    many = (F.col("n_cues") > max_cues) if max_cues else F.lit(False)
    last = F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("scene_id"))) == 1
    loose = ~last & ~F.col("confirmed") if "confirmed" in scenes.columns else F.lit(False)
    return scenes.withColumn("target", (long > max_ms) | many | (long < min_ms) | (F.col("n_cues") == 1) | loose)


def refine_regions(scenes: DataFrame, neighbours: int = 1, max_cues: int = 120) -> DataFrame:
    """Regions of scenes round the targets: neighbours added, touching regions joined, cut where the cue budget is passed."""
    near = Window.partitionBy("media_id").orderBy("scene_id").rowsBetween(-neighbours, neighbours)
    kept = scenes.withColumn("__on", F.max(F.col("target").cast("int")).over(near)).where("__on = 1")
    return sweep(kept, ["media_id"], ["scene_id"], ["scene_id", "n_cues"], lambda _: Regions(max_cues), f"media_id {_kind(scenes, 'media_id')}, region int, part int, first_scene {_kind(scenes, 'scene_id')}, last_scene {_kind(scenes, 'scene_id')}, n_cues long")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


class Regions:
    """Fold of (scene_id, n_cues): runs of neighbouring scenes, in parts of max_cues; gives (region, part, first scene, last scene, cues)."""

    def __init__(self, max_cues: int):
        self.max_cues, self.region, self.part, self.open = max_cues, 0, 0, None

    def add(self, scene: tuple) -> Iterable[tuple]:
        at, n = scene
        if self.open is not None and at <= self.open[1] + 1 and self.open[2] + n <= self.max_cues:
            self.open = (self.open[0], at, self.open[2] + n)
            return ()
        out = self.done()
        if self.open is None or at > self.open[1] + 1:
            self.region, self.part = self.region + 1, 0
        else:
            self.part += 1
        self.open = (at, at, n)
        return out

    def done(self) -> Iterable[tuple]:
        return () if self.open is None else ((self.region, self.part, *self.open),)


def chunk(df: DataFrame, n: int = 80, order: str = "idx", name: str = "batch_id") -> DataFrame:
    """Batches of n rows per media, in order."""
    w = Window.partitionBy("media_id").orderBy(order)
    return df.withColumn(name, F.floor((F.row_number().over(w) - 1) / n).cast("int"))


def budget_groups(scenes: DataFrame, max_ms: int = 90_000, max_cues: int = 30, max_scenes: int = 2, windows: DataFrame | None = None, gap_ms: int = 1000) -> DataFrame:
    """scenes(media_id, scene_id, start_ms, end_ms, n_cues) with `group_id`: greedy, in order; a scene over budget stays whole.

    A group's time is the sum of its scenes' lengths, or, where windows(media_id, scene_id, start_ms, end_ms) has the padded windows of their
    cues, the length of the union of the group's windows (those up to gap_ms apart join). An ordered sweep that holds the open group."""
    own = scenes.select("media_id", "scene_id", "start_ms", "end_ms", "n_cues")
    if windows is not None:
        listed = windows.groupBy("media_id", "scene_id").agg(F.collect_list(F.struct("start_ms", "end_ms")).alias("windows"))
        own = own.join(listed, ["media_id", "scene_id"], "left")
    columns = ["scene_id", "start_ms", "end_ms", "n_cues"]
    schema = ", ".join(f"{c} {_kind(own, c)}" for c in ["media_id", *columns]) + ", group_id int"
    compact = windows is not None
    return sweep(own, ["media_id"], ["scene_id"], columns + ["windows"] * compact, lambda _: Groups(max_ms, max_cues, max_scenes, gap_ms if compact else None), schema)


class Union:
    """A union of intervals that grows: those up to a gap apart join; `length` is its length. An interval costs the logarithm of their number."""

    def __init__(self, gap_ms: int):
        self.gap, self.starts, self.ends, self.length = gap_ms, [], [], 0

    def add(self, a: int, b: int) -> None:
        lo = bisect_left(self.ends, a - self.gap)
        hi = bisect_right(self.starts, b + self.gap)
        if lo < hi:
            a, b = min(a, self.starts[lo]), max(b, self.ends[hi - 1])
            self.length -= sum(self.ends[lo:hi]) - sum(self.starts[lo:hi])
        self.starts[lo:hi], self.ends[lo:hi] = [a], [b]
        self.length += b - a


class Groups:
    """Fold of (scene_id, start, end, n_cues[, windows]): gives each scene with the number of its group."""

    def __init__(self, max_ms: int, max_cues: int, max_scenes: int, gap_ms: int | None):
        self.most, self.gap = (max_scenes, max_cues, max_ms), gap_ms
        self.group = self.size = self.cues = self.ms = 0
        self.union = None if gap_ms is None else Union(gap_ms)

    def time(self, scene: tuple) -> int:
        if self.union is None:
            return self.ms + scene[2] - scene[1]
        for w in scene[4] or ():
            self.union.add(w["start_ms"], w["end_ms"])
        return self.union.length

    def add(self, scene: tuple) -> Iterable[tuple]:
        ms, n = self.time(scene), scene[3]
        if self.size and any(most and x > most for most, x in zip(self.most, (self.size + 1, self.cues + n, ms), strict=True)):
            self.group, self.size, self.cues, self.ms = self.group + 1, 0, 0, 0
            self.union = None if self.gap is None else Union(self.gap)
            ms = self.time(scene)
        self.size, self.cues, self.ms = self.size + 1, self.cues + n, ms
        return ((*scene[:4], self.group),)

    def done(self) -> Iterable[tuple]:
        return ()


def plan_summary(groups: DataFrame) -> DataFrame:
    """Requests and their mean and largest scenes, cues and time, of budget_groups' rows."""
    g = groups.groupBy("media_id", "group_id").agg(F.count("*").alias("s"), F.sum("n_cues").alias("c"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return g.agg(F.count("*").alias("requests"), F.avg("s").alias("avg_scenes"), F.max("s").alias("max_scenes"), F.avg("c").alias("avg_cues"), F.max("c").alias("max_cues"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"))


def split_sparse(targets: DataFrame, w: int = 5, max_ctx: int = 200) -> DataFrame:
    """targets(media_id, batch_id, pos): batches whose context would pass max_ctx rows break where targets are over 2w apart."""
    by = Window.partitionBy("media_id", "batch_id")
    span = F.max("pos").over(by) - F.min("pos").over(by) + 2 * w + 1
    gap = F.col("pos") - F.lag("pos").over(by.orderBy("pos")) > 2 * w
    flagged = targets.withColumn("__cut", F.when((span > max_ctx) & gap, 1).otherwise(0))
    return flagged.withColumn("sub_batch", F.sum("__cut").over(by.orderBy("pos"))).drop("__cut")


def context(cues: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(target idx, cue idx, is_target) for cues up to k rows before or after a target."""
    around = targets.select("media_id", F.col("idx").alias("target_idx"), F.explode(F.sequence(F.col("idx") - k, F.col("idx") + k)).alias("idx"))
    return around.join(cues.select("media_id", "idx"), ["media_id", "idx"]).withColumn("is_target", F.col("idx") == F.col("target_idx"))


def batch_context(context_rows: DataFrame, batch_targets: DataFrame) -> DataFrame:
    """Context of a batch less its targets, each cue once."""
    return context_rows.select("media_id", "batch_id", "idx").distinct().join(batch_targets, ["media_id", "batch_id", "idx"], "left_anti")


def bisect_batches(rows: DataFrame, max_chars: int = 50_000, overhead: int = 0, between: int = 1, lines: DataFrame | None = None, context: int = 0) -> tuple[DataFrame, DataFrame]:
    """rows(media_id, batch_id, idx, n_chars): batches halved until their prompts fit; (rows with `piece`, numbered in order, and `prompt_chars`; rows too large alone).

    A prompt has `overhead` characters (head and foot), its lines, and `between` characters between two lines. With lines(media_id, idx, n_chars), all cues of
    the media, a piece's prompt also has the cues between its rows, `context` before its first and context + 1 after its last (a cut lies after its row, so the
    next one is always seen); n_chars of lines is a line's length as context, that of rows its length as a row. Of an odd number of rows the first half has one less.

    No piece is rendered to be measured: running sums of line lengths over the media, taken where a window that begins or ends at a row would begin or end, give the
    length of any piece by one subtraction. A batch is the state of its sweep."""
    if lines is None:
        own = rows.withColumns({"__a": F.lit(0).cast("long"), "__z": F.lit(0).cast("long"), "__more": F.col("n_chars").cast("long") + between})
    else:
        w = Window.partitionBy("media_id").orderBy("idx")
        upto = F.sum(F.col("n_chars").cast("long") + between).over(w)
        whole = Window.partitionBy("media_id")
        summed = lines.select("media_id", "idx", F.col("n_chars").alias("__as_context"), upto.alias("__s"), F.sum(F.col("n_chars").cast("long") + between).over(whole).alias("__all"))
        edges = summed.select("media_id", "idx", "__as_context", F.coalesce(F.lag("__s", context + 1).over(w), F.lit(0)).alias("__a"), F.coalesce(F.lead("__s", context + 1).over(w), "__all").alias("__z"))
        own = rows.join(edges, ["media_id", "idx"]).withColumn("__more", F.col("n_chars").cast("long") - F.col("__as_context"))
    schema = f"media_id {_kind(rows, 'media_id')}, batch_id {_kind(rows, 'batch_id')}, idx {_kind(rows, 'idx')}, n_chars {_kind(rows, 'n_chars')}, piece long, prompt_chars long"
    out = sweep(own, ["media_id", "batch_id"], ["idx"], ["idx", "n_chars", "__a", "__z", "__more"], lambda _: Halves(max_chars, overhead - between), schema)
    alone = F.count("*").over(Window.partitionBy("media_id", "batch_id", "piece")) == 1
    return out, out.withColumn("__alone", alone).where(F.col("__alone") & (F.col("prompt_chars") > max_chars)).drop("__alone")


class Halves:
    """Fold of a batch's rows (idx, n_chars, sum before a window that begins here, sum up to one that ends here, characters more as a row): gives each row with its piece and that piece's length."""

    def __init__(self, most: int, base: int):
        self.most, self.base, self.rows = most, base, []

    def add(self, row: tuple) -> Iterable[tuple]:
        self.rows.append(row)
        return ()

    def done(self) -> Iterable[tuple]:
        more = [0, *accumulate(r[4] for r in self.rows)]
        long = lambda lo, hi: self.base + self.rows[hi - 1][3] - self.rows[lo][2] + more[hi] - more[lo]
        todo, piece = [(0, len(self.rows))] if self.rows else [], 0
        while todo:
            lo, hi = todo.pop()
            n = long(lo, hi)
            if n > self.most and hi - lo > 1:
                middle = lo + (hi - lo) // 2
                todo += [(middle, hi), (lo, middle)]
                continue
            yield from ((*r[:2], piece, n) for r in self.rows[lo:hi])
            piece += 1


def prompts(batch_rows: DataFrame, head: str, foot: str, line: Column) -> DataFrame:
    """One request per batch: head, its lines in order, foot."""
    rows = batch_rows.withColumn("__line", line)
    g = rows.groupBy("media_id", "batch_id").agg(F.array_sort(F.collect_list(F.struct("idx", "__line"))).alias("i"))
    return g.select("media_id", "batch_id", F.concat(F.lit(head), F.array_join(F.transform("i", lambda x: x["__line"]), "\n"), F.lit(foot)).alias("prompt"))


def label(requests: DataFrame, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """Replies of the caller's function to prompts, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("media_id"), b.column("batch_id"), pa.array(fn(b.column("prompt").to_pylist()), pa.string())], ["media_id", "batch_id", "reply"])

    own = requests.select("media_id", "batch_id", "prompt")
    return own.mapInArrow(run, own.select("media_id", "batch_id", F.col("prompt").alias("reply")).schema)


def pending(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests without a stored reply to the very same prompt."""
    key = F.sha2("prompt", 256)
    return requests.withColumn("prompt_hash", key).join(done.select("media_id", "batch_id", "prompt_hash"), ["media_id", "batch_id", "prompt_hash"], "left_anti")


def refine(cuts: DataFrame, step: Callable[[DataFrame], DataFrame], passes: int = 2) -> DataFrame:
    """Cut sets refined up to `passes` times, until they stop changing. Each pass is stored, so that the next does not run it again."""
    cuts = stored(cuts)
    for _ in range(passes):
        fresh = stored(step(cuts))
        if fresh.exceptAll(cuts).isEmpty() and cuts.exceptAll(fresh).isEmpty():
            break
        cuts = fresh
    return cuts


def by_hash(seed: int) -> list[Column]:
    """A seeded order of cues that does not hang on their places: md5 of seed, media and idx."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("media_id").cast("string"), F.col("idx").cast("string")).cast("binary")), F.col("media_id"), F.col("idx")]


def sample(df: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    """n rows by seeded hash, in order of media and idx."""
    return df.orderBy(*by_hash(seed)).limit(n).orderBy("media_id", "idx")


STRATA = ("conflict", "rejected", "accepted")


def stratified(df: DataFrame, stratum: str, mode: str = "mixed", n: int = 20, seed: int = 42) -> DataFrame:
    """Up to n rows by seeded hash, in order of media and idx: of one stratum (conflict, rejected, accepted), of all rows (all), or mixed: a third of n,
    one at least, of conflict and of rejected, and accepted rows for the rest.

    A stratum gives n rows at most before anything is counted, so a common one is cut down in every task before it is shuffled."""
    if mode == "all":
        return sample(df, n, seed)
    kept = df.where(F.col(stratum).isin(*STRATA if mode == "mixed" else [mode]))
    w = Window.partitionBy(stratum).orderBy(*by_hash(seed))
    few = kept.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    if mode == "mixed":
        third = max(1, n // 3)
        every = Window.partitionBy()  # 3 n rows at most
        taken = sum((F.least(F.count_if(F.col(stratum) == s).over(every), F.lit(third)) for s in STRATA[:2]), F.lit(0))
        few = few.withColumn("__quota", F.when(F.col(stratum) == "accepted", n - taken).otherwise(third)).where(F.col("__rn") <= F.col("__quota")).drop("__quota")
    return few.drop("__rn").orderBy("media_id", "idx")


def head_scenes(scenes: DataFrame, n: int) -> DataFrame:
    """The first n enabled scenes of each media, numbered from 1."""
    w = Window.partitionBy("media_id").orderBy("scene_id")
    return scenes.where("enabled").withColumn("number", F.row_number().over(w).cast("long")).where(F.col("number") <= n)


def scene_cues(scenes: DataFrame, cues: DataFrame, start_idx: int | None = None, end_idx: int | None = None, max_scenes: int = 1) -> DataFrame:
    """(scene, cue) rows: spoken cues of enabled scenes within start_idx..end_idx; scenes left empty go, the others are numbered from 1 per media,
    and the first max_scenes stay (0: all)."""
    own = cues.where(speech())
    own = own if start_idx is None else own.where(F.col("idx") >= start_idx)
    own = own if end_idx is None else own.where(F.col("idx") <= end_idx)
    j = idx_join(own.select("media_id", "idx"), scenes.where("enabled").select("media_id", "scene_id", "start_idx", "end_idx"))
    w = Window.partitionBy("media_id").orderBy("scene_id")
    out = j.select("p.media_id", "r.scene_id", "p.idx").withColumn("number", F.dense_rank().over(w).cast("long"))
    return out.where(F.col("number") <= max_scenes) if max_scenes else out


def candidate_pick(audit: DataFrame, cues: DataFrame, target: str, confidences: Sequence[str] = ("high", "mid")) -> DataFrame:
    """(media, idx, source): cues audited for the target at one of the confidences (none named: any); in a media without any, cues labelled with it; each once. Audit rows of no cue are none."""
    sure = audit.where((F.col("speaker") == target) & (F.col("confidence").isin(*confidences) if confidences else F.lit(True))).select("media_id", "idx").distinct()
    sure = sure.join(cues.select("media_id", "idx"), ["media_id", "idx"], "left_semi").withColumn("source", F.lit("audit"))
    said = cues.where(F.col("speaker") == target).select("media_id", "idx").distinct().withColumn("source", F.lit("srt"))
    return sure.unionByName(said.join(sure.select("media_id").distinct(), "media_id", "left_anti"))


def candidate_speakers(cues: DataFrame, core: list[str], k: int, canonical: Sequence[str], mode: str = "context") -> DataFrame:
    """context: the core cast, and of the cue's label and those k rows round it the canonical ones, sorted; all: every canonical label."""
    if mode == "all":
        return cues.select("media_id", "idx", F.array(*map(F.lit, sorted(canonical))).alias("candidates"))
    w = Window.partitionBy("media_id").orderBy("idx").rowsBetween(-k, k)
    near = F.filter(F.collect_set("speaker").over(w), lambda s: s.isin(*canonical))
    return cues.select("media_id", "idx", F.array_sort(F.array_distinct(F.concat(F.array(*map(F.lit, core)), near))).alias("candidates"))


def coverage_ranges(scenes: DataFrame, targets: DataFrame) -> DataFrame:
    """(media_id, first_idx, last_idx, violation): stretches of idx that are targets no scene holds (missing), that several do (duplicate), or that scenes hold though they are none (unexpected).

    A difference sweep: scenes and runs of targets begin and end at events, and running sums over the events say what each stretch between
    two of them is. So a scene costs two rows, however many cues it has; one that ends before it starts holds nothing."""
    w = Window.partitionBy("media_id").orderBy("idx")
    runs = targets.select("media_id", "idx").distinct().withColumn("__run", F.col("idx") - F.row_number().over(w))
    runs = runs.groupBy("media_id", "__run").agg(F.min("idx").alias("a"), F.max("idx").alias("z"))
    ends = lambda df, a, z, scene: df.select("media_id", F.explode(F.array(*[F.struct(at.cast("long").alias("idx"), F.lit(d * scene).alias("s"), F.lit(d * (1 - scene)).alias("t")) for at, d in ((F.col(a), 1), (F.col(z) + 1, -1))])).alias("e")).select("media_id", "e.*")
    events = ends(scenes.where(F.col("start_idx") <= F.col("end_idx")), "start_idx", "end_idx", 1).unionByName(ends(runs, "a", "z", 0))
    at = events.groupBy("media_id", "idx").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    x = at.select("media_id", F.col("idx").alias("first_idx"), (F.lead("idx").over(w) - 1).alias("last_idx"), F.sum("s").over(w).alias("s"), F.sum("t").over(w).alias("t"))
    what = F.when((F.col("t") > 0) & (F.col("s") == 0), "missing").when((F.col("t") == 0) & (F.col("s") > 0), "unexpected").when(F.col("s") > 1, "duplicate")
    x = x.withColumn("violation", what)
    # neighbours of one kind are one stretch
    by = Window.partitionBy("media_id").orderBy("first_idx")
    fresh = ~F.col("violation").eqNullSafe(F.lag("violation").over(by))
    x = x.withColumn("__g", F.sum(fresh.cast("int")).over(by)).where("violation IS NOT NULL")
    return x.groupBy("media_id", "__g", "violation").agg(F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx")).select("media_id", "first_idx", "last_idx", "violation")


def check_coverage(scenes: DataFrame, targets: DataFrame) -> DataFrame:
    """coverage_ranges as rows, one for each idx that breaks a rule."""
    return coverage_ranges(scenes, targets).select("media_id", F.explode(F.sequence("first_idx", "last_idx")).alias("idx"), "violation")


def check_order(scenes: DataFrame) -> DataFrame:
    w = Window.partitionBy("media_id").orderBy("scene_id")
    x = scenes.withColumns({"__idx": F.lag("end_idx").over(w), "__ms": F.lag("start_ms").over(w)})
    what = F.when(F.col("__idx") >= F.col("start_idx"), "idx order").when(F.col("__ms") > F.col("start_ms"), "start order")
    return x.select("media_id", "scene_id", what.alias("violation")).where("violation IS NOT NULL")


def long_scenes(scenes: DataFrame, max_ms: int = 120_000) -> DataFrame:
    return scenes.where(F.col("end_ms") - F.col("start_ms") > max_ms)


def scene_preview(scenes: DataFrame, cues: DataFrame) -> DataFrame:
    """First / ... / last text of each scene, white space run together; one text if it has one cue; empty titles fall back to it."""
    j = idx_join(cues.select("media_id", "idx", "text"), scenes.select("media_id", "scene_id", "start_idx", "end_idx"))
    g = j.groupBy("r.media_id", "r.scene_id").agg(F.min_by("p.text", "p.idx").alias("a"), F.max_by("p.text", "p.idx").alias("b"), F.count("*").alias("n"))
    return g.select("media_id", "scene_id", F.when(F.col("n") == 1, shown_text(F.col("a"))).otherwise(F.concat_ws(" / ... / ", shown_text(F.col("a")), shown_text(F.col("b")))).alias("preview"))
