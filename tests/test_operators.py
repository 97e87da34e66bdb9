"""Hand-made cases and folds written out, for what SQL does not show."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cuelark.functions import text as T
from cuelark.operators import intervals as I
from cuelark.operators import sequence as S
from cuelark.sources import subtitles, tables

CUE = "media_id long, idx int, start_ms long, end_ms long, speaker string, text string, tags array<string>"


def cues(spark, rows):
    return spark.createDataFrame([(m, i, a, b, s, f"t{i}", []) for m, i, a, b, s in rows], CUE)


def test_conflicts_go_in_pairs_and_a_third_stays(spark):
    c = cues(spark, [(1, 1, 0, 100, "a"), (1, 2, 10, 90, "b"), (1, 3, 20, 80, "c")])
    assert [r.idx for r in I.drop_cross_speaker(c, 0).collect()] == [3]


@pytest.mark.parametrize("seed", range(3))
def test_conflicts_equal_the_sweep(spark, seed):
    rng = random.Random(seed)
    rows = []
    for m in range(4):
        for i in range(60):
            a = rng.randint(0, 2000)
            rows.append((m, i, a, a + rng.randint(1, 120), rng.choice(["a", "b", "c", "?", "NONSPEECH", "NONSPEECH:x"])))
    want = set()
    for m in range(4):
        real = sorted((r for r in rows if r[0] == m and r[4] not in ("?", "NONSPEECH")), key=lambda r: (r[2], r[3], r[1]))
        gone = set()
        for k, a in enumerate(real):
            if a[1] in gone:
                continue
            for b in real[k + 1 :]:
                if b[1] not in gone and a[4] != b[4] and min(a[3], b[3]) - max(a[2], b[2]) > 20:
                    gone |= {a[1], b[1]}
                    break
        want |= {(m, r[1]) for r in rows if r[0] == m and r[1] not in gone}
    assert {(r.media_id, r.idx) for r in I.drop_cross_speaker(cues(spark, rows), 20).collect()} == want


@pytest.mark.parametrize("gap,cap", [(30, 200), (0, 50), (100, 10_000)])
def test_adjacent_merge_equals_the_fold(spark, gap, cap):
    rng = random.Random(gap)
    rows = [(m, i, a, a + rng.randint(1, 60), rng.choice("ab")) for m in range(3) for i in range(50) for a in [rng.randint(0, 3000)]]
    clips = I.to_clips(cues(spark, rows))
    got = {(r.media_id, r.speaker, r.start_ms, r.end_ms, r.n_merged) for r in I.merge_adjacent(clips, gap, cap).collect()}
    want = set()
    for m in range(3):
        for s in "ab":
            run = None
            for r in sorted((r for r in rows if r[0] == m and r[4] == s), key=lambda r: (r[2], r[3], r[1])):
                if run and r[2] - run[1] <= gap and r[3] - run[0] <= cap:
                    run = [run[0], max(run[1], r[3]), run[2] + 1]
                else:
                    if run:
                        want.add((m, s, *run))
                    run = [r[2], r[3], 1]
            if run:
                want.add((m, s, *run))
    assert got == want


def test_touching_joins_only_where_it_should(spark):
    c = cues(spark, [(1, 1, 0, 10, "a"), (1, 2, 10, 20, "a")])
    assert I.merge_overlap(I.to_clips(c)).count() == 2
    assert I.union_intervals(c, ["media_id"]).count() == 1


def test_empty_tables(spark):
    none = cues(spark, [])
    assert I.clip_table(none).count() == 0
    assert I.union_intervals(none, ["media_id"]).count() == 0
    assert S.chunk(none, 3).count() == 0


@pytest.mark.parametrize(
    "text,kind,parts",
    [
        ("(Ann)hi", "single", [("Ann", "hi")]),
        ("- (Ann)hi\\N- (Ben)ho", "multi", [("Ann", "hi"), ("Ben", "ho")]),
        ("(Ann)\nhi\n(Ben)\nho\nhe", "multi", [("Ann", "hi"), ("Ben", "ho\\Nhe")]),
        ("(door slams)", "nonspeech", []),
        ("（外（そと）の音）", "nonspeech", []),
        ("♪ la la", "nonspeech", []),
        ("hm\\N(Ann)hi", "single", [("Ann", "hm\\Nhi")]),
        ("(noise)\\N(Ann)hi", "single", [("Ann", "hi")]),
        ("(Ann)♪ la\\N(Ben)ho", "single", [("Ben", "ho")]),
        ("(open", "unlabeled", []),
        ("", "unlabeled", []),
    ],
)
def test_classes_of_raw_cues(text, kind, parts):
    got = T.classify(text)
    assert (got["kind"], [(p["raw"], p["text"]) for p in got["parts"]]) == (kind, parts)


def test_text_functions(spark):
    row = spark.createDataFrame([("ＡＢ　c\\Nd", "山田(やま(y)だ)花子\u200e（はなこ）", r"{\an8}a\N♪ b\N \h c ")], "a string, b string, c string")
    got = row.select(T.match_key(F.col("a")).alias("k"), T.norm_speaker(F.col("b")).alias("s"), T.clean_text(F.col("c")).alias("t")).first()
    assert tuple(got) == ("ABcd", "山田花子", "a\\Nc")


def test_srt_files(spark, tmp_path):
    c = spark.createDataFrame([(7, 1, 0, 1500, "A", "one\ntwo", ["MULTI"]), (7, 2, 2000, 3_600_000, "?", "", [])], CUE)
    path = f"file://{tmp_path}/out"
    subtitles.write_srt(c, path)
    assert (tmp_path / "out" / "7.srt").read_text() == "1\n00:00:00,000 --> 00:00:01,500\n[A] {MULTI} one\ntwo\n\n2\n00:00:02,000 --> 01:00:00,000\n[?]\n"
    bad = tmp_path / "bad.srt"
    bad.write_text("﻿1\r\n00:00:00,000 --> 00:00:01,000\r\n[A] x\r\n\r\nno\r\n00:00:00,000 --> 00:00:01,000\r\n[A] y\r\n")
    got = subtitles.read_srt(spark, f"file://{bad}").orderBy(F.col("_corrupt").isNotNull()).collect()
    assert [(r.media_id, r.idx, r.text, r._corrupt) for r in got] == [("bad", 1, "x", None), ("bad", None, "y", "idx")]
    with pytest.raises(Exception, match="bad block"):
        subtitles.read_srt(spark, f"file://{bad}", failfast=True).collect()


def test_bisect_leaves_only_rows_too_large_alone(spark):
    rows = spark.createDataFrame([(1, 0, i, 10) for i in range(7)] + [(1, 1, 0, 99)], "media_id int, batch_id int, idx int, n_chars int")
    out, large = S.bisect_batches(rows, 25)
    sizes = out.groupBy("batch_id", "piece").agg(F.sum("n_chars").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.s <= 25 or r.n == 1 for r in sizes)
    assert [r.n_chars for r in large.collect()] == [99]


def test_refine_stops_when_nothing_changes(spark):
    calls = []

    def step(df):
        calls.append(1)
        return df.union(spark.createDataFrame([(1, 5)], df.schema)).distinct()

    start = spark.createDataFrame([(1, 3)], "media_id int, after_idx int")
    assert S.refine(start, step, 5).count() == 2
    assert len(calls) == 2


@pytest.mark.parametrize(
    "value,error",
    [
        ('{"duration": 9, "segments": [{"start": 1, "end": 2, "speaker": "SPEAKER_3"}]}', None),
        ("[1]", "no object"),
        ("no json", "no object"),
        ('{"segments": []}', "duration"),
        ('{"duration": true, "segments": []}', "duration"),
        ('{"duration": 0, "segments": []}', "duration"),
        ('{"audio": {}, "duration": 5, "segments": []}', "duration"),
        ('{"duration": 5, "segments": {}}', "no segments"),
        ('{"duration": 5, "segments": [7]}', "segment is no object"),
        ('{"duration": 5, "segments": [{"start": "0", "end": 2, "speaker": "SPEAKER_0"}]}', "segment start"),
        ('{"duration": 5, "segments": [{"start": 0, "speaker": "SPEAKER_0"}]}', "segment end"),
        ('{"duration": 5, "segments": [{"start": -1, "end": 2, "speaker": "SPEAKER_0"}]}', "segment range"),
        ('{"duration": 5, "segments": [{"start": 2, "end": 2, "speaker": "SPEAKER_0"}]}', "segment range"),
        ('{"duration": 5, "segments": [{"start": 1, "end": 6, "speaker": "SPEAKER_0"}]}', "segment range"),
        ('{"duration": 5, "segments": [{"start": 1, "end": 2, "speaker": "Ann"}]}', "segment speaker"),
    ],
)
def test_segment_documents(spark, value, error):
    audio, segments, errors = tables.parse_segments(spark.createDataFrame([(1, value)], "media_id int, value string"))
    assert [r.error for r in errors.collect()] == ([error] if error else [])
    if not error:
        assert [tuple(r) for r in audio.collect()] == [(1, 9.0)] and [tuple(r) for r in segments.collect()] == [(1, "SPK4", 1.0, 2.0, True)]


def test_zero_length_cues_are_covered_by_nothing(spark):
    c = spark.createDataFrame([(1, 1, 100, 100, "A"), (1, 2, 100, 300, "A")], "media_id long, idx int, start_ms long, end_ms long, speaker string")
    audio = spark.createDataFrame([(1, 1000)], "media_id long, duration_ms long")
    got = {r.idx: (r.candidate, r.coverage, r.coverage_low, r.emitted) for r in I.attach_segments(c, audio, c.where("idx = 2").withColumn("speaker", F.lit("SPK1"))).collect()}
    assert got == {1: ("?", 0.0, True, False), 2: ("SPK1", 1.0, False, True)}


def union_ms(spans, gap):
    out = []
    for a, b in sorted(spans):
        if out and a - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return sum(b - a for a, b in out)


@pytest.mark.parametrize("seed", range(2))
def test_compact_requests_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    scenes, windows = [], []
    for m in range(3):
        at = 0
        for s in range(1, 30):
            for _ in range(rng.randint(1, 4)):
                at += rng.randint(0, 4000)
                windows.append((m, s, max(0, at - 1000), at + rng.randint(100, 2000)))
            own = [w for w in windows if w[:2] == (m, s)]
            scenes.append((m, s, min(w[2] for w in own), max(w[3] for w in own), len(own)))
    want = {}
    for m in range(3):
        group, held, n = 0, [], 0
        for s in (x for x in scenes if x[0] == m):
            own = [w[2:] for w in windows if w[:2] == (m, s[1])]
            if n and (n + 1 > 4 or union_ms(held + own, 500) > 15_000):
                group, held, n = group + 1, [], 0
            held, n = held + own, n + 1
            want[m, s[1]] = group
    table = spark.createDataFrame(scenes, "media_id int, scene_id int, start_ms long, end_ms long, n_cues int")
    spans = spark.createDataFrame(windows, "media_id int, scene_id int, start_ms long, end_ms long")
    got = {(r.media_id, r.scene_id): r.group_id for r in S.budget_groups(table, 15_000, 0, 4, spans, 500).collect()}
    assert got == want


def test_scene_files(spark, tmp_path):
    s = spark.createDataFrame([(1, 2, "b", 4, 6, 1.23456, 2.0), (1, 1, "a", 1, 3, 0.0, 1.0)], "media_id int, scene_id int, name string, start_idx int, end_idx int, start double, end double")
    tables.write_scenes(s, f"file://{tmp_path}/out")
    assert [(r["scene_id"], r["start"]) for r in json.loads((tmp_path / "out" / "1.json").read_text())] == [(1, 0.0), (2, 1.235)]


def test_mixed_sample_quotas(spark):
    few = spark.createDataFrame([(1, i, "conflict" if i < 2 else "rejected" if i < 50 else "accepted") for i in range(200)], "media_id int, idx int, stratum string")
    got = [r.stratum for r in S.stratified(few, "stratum", "mixed", 20).collect()]
    assert (got.count("conflict"), got.count("rejected"), got.count("accepted")) == (2, 6, 12)
    rows = [r.idx for r in S.stratified(few, "stratum", "all", 20).collect()]
    assert rows == sorted(rows) and len(rows) == 20
