"""Sweeps, cells and running sums against plain loops on random data, and what they hold in memory."""

import random

import pytest
from pyspark.sql import functions as F

from cuelark.operators import intervals as I
from cuelark.operators import sequence as S
from cuelark.operators import sweep as W

SPAN = "media_id long, idx int, start_ms long, end_ms long"


def spans(rng, n, media=3, longest=3_000_000):
    """Lengths over many orders of magnitude, none, and equal ones."""
    rows = []
    for i in range(n):
        a = rng.randint(-100_000, 4_000_000)
        rows.append((rng.randrange(media), i, a, a + rng.choice([0, 1, rng.randint(1, 500), rng.randint(1, 100_000), rng.randint(1, longest), 60_000])))
    return rows


@pytest.mark.parametrize("seed,how", [(0, "overlap"), (1, "touch"), (2, "overlap")])
def test_range_joins_equal_all_pairs(spark, seed, how):
    rng = random.Random(seed)
    a, b = spans(rng, 150), spans(rng, 120, longest=50_000 if seed == 2 else 3_000_000)
    less = (lambda x, y: x < y) if how == "overlap" else (lambda x, y: x <= y)
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and less(x[2], y[3]) and less(y[2], x[3]))
    for left, right, swap in ((a, b, False), (b, a, True)):
        got = I.binned_join(spark.createDataFrame(left, SPAN), spark.createDataFrame(right, SPAN), how).select("a_idx", "b_idx").collect()
        assert sorted((r[1], r[0]) if swap else (r[0], r[1]) for r in got) == want
    assert I.binned_join(spark.createDataFrame(a, SPAN), spark.createDataFrame([], SPAN), how).count() == 0


def test_cells_are_few_for_any_length(spark):
    rng = random.Random(3)
    rows = [(0, i, a, a + n) for i, n in enumerate([0, 1, 59_999, 60_000, 60_001, 3_600_000, 86_400_000, 10**10]) for a in [rng.randint(0, 10**9) for _ in range(20)]]
    d = spark.createDataFrame(rows, SPAN)
    start, end = F.col("start_ms"), F.col("end_ms")
    assert d.select(F.size(I._cells(start, end, I._level(start, end, I.BIN_MS), I.BIN_MS)).alias("n")).agg(F.max("n")).first()[0] <= 3
    # an hour-long segment and its cues: rows in the join, all sides
    long = spark.createDataFrame([(0, 1, 0, 36_000_000)], SPAN)
    short = spark.range(2000).select(F.lit(0).cast("long").alias("media_id"), F.col("id").cast("int").alias("idx"), (F.col("id") * 18_000).alias("start_ms"), (F.col("id") * 18_000 + 900).alias("end_ms"))
    assert I.binned_join(short, long).count() == 2000


@pytest.mark.parametrize("seed", range(2))
def test_idx_ranges_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    points = [(rng.randrange(3), rng.randint(-5, 5000)) for _ in range(200)]
    ranges = [(rng.randrange(3), i, a, a + rng.choice([-1, 0, 1, rng.randint(0, 20), rng.randint(0, 4000)])) for i in range(80) for a in [rng.randint(-5, 5000)]]
    p = spark.createDataFrame(points, "media_id long, idx int")
    r = spark.createDataFrame(ranges, "media_id long, range_id int, start_idx int, end_idx int")
    want = sorted((m, i, k) for m, i in points for n, k, lo, hi in ranges if m == n and lo <= i <= hi)
    assert sorted(map(tuple, I.idx_join(p, r).select("p.media_id", "p.idx", "r.range_id").collect())) == want
    free = sorted((m, i) for m, i in points if not any(m == n and lo <= i <= hi for n, _, lo, hi in ranges))
    assert sorted(map(tuple, I.idx_join(p, r, how="left_anti").collect())) == free
    assert I.idx_join(p, r.limit(0), how="left_anti").count() == len(points)


CLIP = "media_id long, speaker string, start_ms long, end_ms long, entry_idx int, raw_speaker string, excerpt string, full_text string, kind string"


def clip_of(items):
    """The fields of a run of clips, by the rules written out."""
    singles = [x for x in items if x[8] == "single"]
    raws = [x[5] for x in items]
    if items[0][8] == "multi" and singles:
        raws = [singles[0][5]] + [x[5] for x in items if x[4] != singles[0][4]]
    cut = lambda parts, n: " / ".join(parts)[:n] if len(items) > 1 else parts[0]
    return (min(x[2] for x in items), max(x[3] for x in items), cut(raws, 60), cut([x[6] for x in items], 120), " ".join(x[7] for x in items if x[7]), "single" if singles else items[0][8], items[0][4], len(items))


def clips(rng, n):
    return [(rng.randrange(2), rng.choice("ab"), a, a + rng.choice([0, rng.randint(1, 90), rng.randint(1, 900)]), i, f"raw {i}", rng.choice(["", f"excerpt {i} " * 3]), rng.choice(["", f"text {i}"]), rng.choice(["single", "multi", "multi"])) for i in range(n) for a in [rng.randint(0, 6000)]]


@pytest.mark.parametrize("split", [None, 5])
@pytest.mark.parametrize("seed", range(2))
def test_clip_runs_equal_the_folds(spark, seed, split, monkeypatch):
    monkeypatch.setattr(W.pieces, "__defaults__", (*W.pieces.__defaults__[:2], 700))
    rng = random.Random(seed)
    rows = clips(rng, 120)
    frame = spark.createDataFrame(rows, CLIP).repartition(3)
    for merge, joins in ((lambda f: I.merge_overlap(f, split_over=split), lambda run, reach, x: x[2] < reach), (lambda f: I.merge_adjacent(f, 40, 500, split_over=split), lambda run, reach, x: x[2] - max(y[3] for y in run) <= 40 and x[3] - min(y[2] for y in run) <= 500)):
        want = []
        for m in range(2):
            for s in "ab":
                run, reach = [], None
                for x in sorted((x for x in rows if x[:2] == (m, s)), key=lambda x: x[2:]):
                    if run and joins(run, reach, x):
                        run.append(x)
                    else:
                        want += [(m, s, *clip_of(run))] if run else []
                        run = [x]
                    reach = x[3] if reach is None else max(reach, x[3])
                want += [(m, s, *clip_of(run))] if run else []
        assert sorted(map(tuple, merge(frame).collect())) == sorted(want)


@pytest.mark.parametrize("split", [None, 5])
def test_merged_cues_equal_the_fold(spark, split, monkeypatch):
    monkeypatch.setattr(W.pieces, "__defaults__", (*W.pieces.__defaults__[:2], 700))
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.choice("ab"), a, a + rng.randint(0, 60), i, rng.choice(["", f"t{i}"]), rng.random() < 0.4, rng.random() < 0.1) for i in range(150) for a in [rng.randint(0, 6000)]]
    want = []
    for m in range(2):
        for s in "ab":
            run = []
            for x in [*sorted((x for x in rows if x[:2] == (m, s)), key=lambda x: x[2:5]), None]:
                if x and run and not x[7] and not run[-1][7] and x[2] <= max(y[3] for y in run) + 30:
                    run.append(x)
                    continue
                if run:
                    multi = [y[6] for y in run]
                    tags = (["MULTI"] if multi[0] else []) if len(run) == 1 else ["MULTI", "MERGED"] if any(multi[:2]) else ["MERGED", "MULTI"] if any(multi) else ["MERGED"]
                    want.append((m, s, run[0][2], max(y[3] for y in run), " / ".join(y[5] for y in run if y[5]), tags, [y[4] for y in run], len(run) - 1))
                run = [x] if x else []
    frame = spark.createDataFrame(rows, "media_id long, speaker string, start_ms long, end_ms long, src int, text string, is_multi boolean, is_lyric boolean").repartition(3)
    assert sorted(map(tuple, I.merge_gap(frame, 30, split).collect())) == sorted(want)


def test_conflicts_are_the_same_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(W.pieces, "__defaults__", (*W.pieces.__defaults__[:2], 500))
    rng = random.Random(5)
    rows = [(rng.randrange(2), i, a, a + rng.randint(0, 200), rng.choice("abc?")) for i in range(200) for a in [rng.randint(0, 20_000)]]
    frame = spark.createDataFrame(rows, "media_id long, idx int, start_ms long, end_ms long, speaker string")
    whole, cut = (sorted(map(tuple, I.drop_cross_speaker(frame, 10, split).collect())) for split in (None, 10))
    assert whole == cut and len(whole) < 200
    assert W.pieces(frame, ["media_id"], 10, None).select("media_id", "__piece").distinct().count() > 4


def test_a_media_that_never_pauses_is_held_by_its_voices_only():
    """Millions of cues, each heard when the next begins: the sweep's state stays as small as the number of voices."""
    fold = W.cues_heard(0)(("m",))
    most = gone = 0
    for i in range(2_000_000):
        gone += len(fold.add((i * 10, i * 10 + 35, i, "ab"[i % 7 == 0])))
        most = max(most, len(fold.live))
    assert most <= 5 and gone > 0
    run = W.clips_joined(lambda run, reach, clip: clip[0] < reach)(("m",))
    for i in range(200_000):
        assert not run.add((i * 10, i * 10 + 35, i, "raw", "excerpt", "", "single"))
    assert len(run.run.raws) < 80 and len(run.run.excerpt) < 140 and not run.run.texts and len(list(run.done())) == 1


@pytest.mark.parametrize("seed", range(2))
def test_halves_equal_rendering_every_piece(spark, seed):
    rng = random.Random(seed)
    texts = {m: ["x" * rng.randint(0, 40) for _ in range(rng.randint(1, 60))] for m in range(4)}
    chosen = [(m, k // 16, i) for m, t in texts.items() for k, i in enumerate(sorted(rng.sample(range(len(t)), (len(t) + 1) // 2)))]
    lines = spark.createDataFrame([(m, i, len(x)) for m, t in texts.items() for i, x in enumerate(t)], "media_id int, idx int, n_chars int")
    rows = spark.createDataFrame([(m, b, i, len(texts[m][i]) + 3) for m, b, i in chosen], "media_id int, batch_id int, idx int, n_chars int")
    head, foot, k = "h" * 11, "f" * 9, rng.randint(0, 3)

    def render(m, ids):
        show = range(max(0, ids[0] - k), min(len(texts[m]), ids[-1] + k + 2))
        return head + "\n".join(("C> " if i in ids else "") + texts[m][i] for i in show) + foot

    want, large = [], []
    for m, b in sorted({c[:2] for c in chosen}):
        todo, piece = [[i for n, c, i in chosen if (n, c) == (m, b)]], 0
        while todo:
            ids = todo.pop(0)
            n = len(render(m, ids))
            if n > 150 and len(ids) > 1:
                todo[:0] = [ids[: len(ids) // 2], ids[len(ids) // 2 :]]
                continue
            want += [(m, b, i, piece, n) for i in ids]
            large += [(m, b, i) for i in ids if n > 150]
            piece += 1
    out, alone = S.bisect_batches(rows, 150, 20, 1, lines, k)
    assert sorted((r.media_id, r.batch_id, r.idx, r.piece, r.prompt_chars) for r in out.collect()) == sorted(want)
    assert sorted((r.media_id, r.batch_id, r.idx) for r in alone.collect()) == sorted(large)


@pytest.mark.parametrize("seed", range(2))
def test_coverage_equals_counting_every_idx(spark, seed):
    rng = random.Random(seed)
    scenes = [(m, i, a, a + rng.choice([-2, 0, 0, 3, 10, 60])) for m in range(3) for i in range(12) for a in [rng.randint(1, 150)]]
    targets = [(m, i) for m in (0, 1, 3) for i in range(1, 160) if rng.random() < 0.7]
    want = []
    for m in range(4):
        for i in range(-5, 300):
            n, t = sum(a <= i <= z for s, _, a, z in scenes if s == m), (m, i) in targets
            kind = "missing" if t and not n else "unexpected" if n and not t else "duplicate" if n > 1 else None
            want += [(m, i, kind)] if kind else []
    s = spark.createDataFrame(scenes, "media_id int, scene_id int, start_idx int, end_idx int")
    t = spark.createDataFrame(targets + targets[:5], "media_id int, idx int")
    assert sorted(map(tuple, S.check_coverage(s, t).collect())) == sorted(want)
    ranges = sorted(map(tuple, S.coverage_ranges(s, t).collect()))
    assert sorted((m, i, k) for m, a, z, k in ranges for i in range(a, z + 1)) == sorted(want)
    assert not any(x[0] == y[0] and x[3] == y[3] and x[2] + 1 == y[1] for x, y in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("seed", range(3))
def test_unions_grow_as_if_made_anew(seed):
    rng = random.Random(seed)
    gap, union, spans_ = rng.choice([0, 5, 50]), None, []
    union = S.Union(gap)
    for _ in range(300):
        a = rng.randint(0, 5000)
        b = a + rng.choice([0, rng.randint(0, 30), rng.randint(0, 400)])
        union.add(a, b)
        spans_.append((a, b))
        merged = []
        for x, y in sorted(spans_):
            if merged and x - merged[-1][1] <= gap:
                merged[-1][1] = max(merged[-1][1], y)
            else:
                merged.append([x, y])
        assert list(map(list, zip(union.starts, union.ends, strict=True))) == merged and union.length == sum(y - x for x, y in merged)


def test_regions_equal_the_fold(spark):
    rng = random.Random(9)
    rows = [(m, s, rng.random() < 0.4, rng.randint(0, 30)) for m in range(3) for s in range(1, 60)]
    near = {(m, s) for m, s, on, _ in rows if any((m, t, True) in {r[:3] for r in rows} for t in (s - 1, s, s + 1))}
    want, before = [], None
    for m, s, _, n in rows:
        if (m, s) not in near:
            continue
        if before == (m, s - 1) and want[-1][3] + n <= 40:
            want[-1] = (m, want[-1][1], s, want[-1][3] + n)
        else:
            want.append((m, s, s, n))
        before = (m, s)
    got = S.refine_regions(spark.createDataFrame(rows, "media_id int, scene_id int, target boolean, n_cues int"), 1, 40).collect()
    assert sorted((r.media_id, r.first_scene, r.last_scene, r.n_cues) for r in got) == sorted(want)


def test_frequent_values_keep_every_one_that_may_be(spark):
    from cuelark.operators import profile

    rng = random.Random(31)
    values = [f"s{int(rng.paretovariate(0.6))}" for _ in range(6000)] + ["tie a"] * 40 + ["tie b"] * 40 + [None] * 50
    rng.shuffle(values)
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "speaker string, i int").repartition(5)
    counts = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    for top, counters in ((3, 4), (10, 16), (20, 8), (5000, 16)):
        kept = {r.speaker for r in profile.frequent(frame, "speaker", top, counters).collect()}
        least = sorted(counts.values(), reverse=True)[:top][-1]
        assert {v for v, n in counts.items() if n >= least} <= kept or top > len(counts)
        if top <= 20:
            assert len(kept) < len(counts)


def test_a_run_that_died_goes_on(spark, tmp_path):
    """The labeller fails in the third commit; the next run asks for the rest alone, and the table is as if nothing had happened."""
    from cuelark.operators.resume import ResultTable, label_resumed

    requests = spark.createDataFrame([(m, b, f"prompt {m} {b}") for m in range(6) for b in range(5)], "media_id long, batch_id int, prompt string")
    log = tmp_path / "asked"
    log.mkdir()

    def fn(limit):
        def run(prompts):
            import os
            import uuid

            for p in prompts:
                if len(os.listdir(log)) >= limit:
                    raise RuntimeError("stopped")
                (log / f"{p.replace(' ', '-')}-{uuid.uuid4().hex}").touch()
            return [p.upper() for p in prompts]

        return run

    path = f"file://{tmp_path}/table"
    with pytest.raises(Exception, match="stopped"):
        label_resumed(requests, fn(17), path, 5)
    table = ResultTable(spark, path, "media_id long, batch_id int, prompt_hash string, reply string")
    done = {(r.media_id, r.batch_id) for r in table.read().collect()}
    assert 0 < len(done) < 30 and 1 <= len(table.commits()) < 5 and not [f for f in (tmp_path / "table").iterdir() if f.name.startswith("_stage")]
    for f in log.iterdir():
        f.unlink()
    out = label_resumed(requests, fn(10**9), path, 5)
    assert sorted((r.media_id, r.batch_id, r.reply) for r in out.collect()) == [(m, b, f"PROMPT {m} {b}") for m in range(6) for b in range(5)]
    asked = {tuple(map(int, f.name.split("-")[1:3])) for f in log.iterdir()}
    assert not asked & done and asked | done == {(m, b) for m in range(6) for b in range(5)}
    # a prompt that changed is asked again, and the later reply counts
    for f in log.iterdir():
        f.unlink()
    changed = requests.withColumn("prompt", F.when((F.col("media_id") == 2) & (F.col("batch_id") == 3), "other").otherwise(F.col("prompt")))
    out = label_resumed(changed, fn(10**9), path, 5)
    assert out.where("media_id = 2 AND batch_id = 3").first().reply == "OTHER" and out.count() == 30 and len(list(log.iterdir())) == 1
    rows = sorted(map(tuple, table.read().collect()))
    table.compact()
    assert len(table.commits()) == 1 and sorted(map(tuple, table.read().collect())) == rows


def test_classes_in_the_jvm_equal_the_definition(spark):
    """Random strings of brackets of both widths, dashes, lyric marks, line ends, blanks and marks of direction; no Python worker in the plan."""
    from cuelark.functions import text as T

    rng = random.Random(41)
    parts = ["(", ")", "（", "）", "-", "―", "\u266a", "\\N", "\n", " ", "\u3000", "~", "a", "Ann", "\u200e", "\u200f", "\t", "\x1f", "é", "🙂", "(Ann)", "（外）", "- (Ben)", "-(C)x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, "", "()", ")(", "(a", "((a)b)c", ")a(b", "(a)\\N(b)", "\n(a)b", "(a)\u266a\\N(b)c"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.classified(F.col("t")).alias("c"))
    got = {r.i: (r.c.kind, [(p.raw, p.text) for p in r.c.parts]) for r in frame.collect()}
    for i, t in enumerate(texts):
        want = T.classify(t)
        assert got[i] == (want["kind"], [(p["raw"], p["text"]) for p in want["parts"]]), repr(t)
    assert len({g[0] for g in got.values()}) == 4
    assert "Python" not in frame._jdf.queryExecution().toString()
