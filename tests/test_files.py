"""Readers by path on files that the tests write, and sinks with tasks that fail."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cuelark.sources import files, subtitles, tables

ASS = """[Script Info]
Title: x

[V4+ Styles]
Format: Name, Fontsize
Style: Default,20

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
Dialogue: 0,0:00:01.00,0:00:02.50,Default,A,0,0,0,,one, two
Comment: 0,0:00:03.00,0:00:04.00,Default,,0,0,0,,note
Dialogue: 0,x,0:00:05.00,Default,,0,0,0,,bad time
"""


def put(root, name, text, encoding="utf-8"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))
    return path


def test_lines_are_numbered_as_files_have_them(spark, tmp_path):
    cases = {"a.txt": "one\ntwo\n", "b.txt": "﻿one\r\n\r\ntwo", "c.txt": "", "d.txt": "x y\x0bz\x85", "e.txt": "\n", "sub/f g+%41.txt": "é"}
    for name, text in cases.items():
        put(tmp_path, name, text)
    put(tmp_path, "bad.txt", b"\xff\xfe\x00")
    got = files.read_lines(spark, f"file://{tmp_path}").collect()
    by = lambda m: [r.line for r in sorted((r for r in got if r.media_id == m), key=lambda r: r.line_no or 0)]
    for name, text in cases.items():
        assert by(os.path.basename(name)[:-4]) == text.removeprefix("﻿").splitlines(), name
    assert [(r.line, r._corrupt) for r in got if r.media_id == "bad"] == [(None, "not UTF-8")]
    assert all(sorted(r.line_no for r in got if r.media_id == m) == list(range(1, len(by(m)) + 1)) for m in "abd")


def test_ass_files(spark, tmp_path):
    put(tmp_path, "ep1.ass", "﻿" + ASS)
    put(tmp_path, "deep/ep2.ssa", ASS.replace("\n", "\r\n"))
    put(tmp_path, "ep3.ass", b"\xff\xff")
    put(tmp_path, "ep4.ass", ASS.replace("note", "�"))
    put(tmp_path, "ep5.srt", "not asked for")
    rows = sorted((r.media_id, r.line_no, r.start_ms, r.end_ms, r.style, r.text_raw) for r in subtitles.read_ass_dialogue(spark, f"file://{tmp_path}").collect())
    assert rows == [(m, 10, 1000, 2500, "Default", "one, two") for m in ("ep1", "ep2", "ep4")]
    styles, events = subtitles.read_ass_events(spark, f"file://{tmp_path}")
    assert sorted((r.media_id, r.fields["fontsize"]) for r in styles.collect()) == [("ep1", "20"), ("ep2", "20")]
    got = sorted((r.media_id, r.line_no or 0, r.source_event_index, r.event_type, r._corrupt) for r in events.collect())
    assert got == [x for m in ("ep1", "ep2") for x in ((m, 10, 0, "Dialogue", None), (m, 11, 1, "Comment", None), (m, 12, None, "Dialogue", "time"))] + [("ep3", 0, None, None, "not UTF-8"), ("ep4", 0, None, None, "replacement character")]
    with pytest.raises(Exception, match="unreadable file: ep3"):
        subtitles.read_ass_dialogue(spark, f"file://{tmp_path}", failfast=True).collect()


def test_other_readers(spark, tmp_path):
    put(tmp_path, "seg/m.json", json.dumps({"audio": {"duration": 9}, "segments": [{"start": 0, "end": 1.5, "speaker": "SPEAKER_00"}]}))
    put(tmp_path, "seg/n.json", b"\xff")
    audio, segments, errors = tables.read_segments(spark, f"file://{tmp_path}/seg")
    assert [(r.media_id, r.duration_s) for r in audio.collect()] == [("m", 9.0)]
    assert [(r.speaker, r.end_s, r.valid) for r in segments.collect()] == [("SPK1", 1.5, True)]
    assert [(r.media_id, r.error) for r in errors.collect()] == [("n", "not UTF-8")]
    put(tmp_path, "map/m.ini", "﻿[speakers]\r\nSPK1 = 100% A\r\n")
    put(tmp_path, "map/n.ini", "[speakers]\nSPK1 = B\nSPK1 = C\n")
    found, errors = tables.read_label_map(spark, f"file://{tmp_path}/map")
    assert [tuple(r) for r in found.collect()] == [("m", "SPK1", "100% A")] and [tuple(r) for r in errors.collect()] == [("n", "key twice")]
    put(tmp_path, "p/one/speaker_aliases.json", '{"A": ["x", "y"], "_c": 1}')
    put(tmp_path, "p/two/speaker_aliases.json", '{"B": ["x"]}')
    assert sorted((r.media_id, r.variant, r.canonical) for r in tables.read_aliases(spark, f"file://{tmp_path}/p").collect()) == [("one", "x", "A"), ("one", "y", "A"), ("two", "x", "B")]
    put(tmp_path, "roles/m.json", '{"R": {"name_ja": "n", "age": 3}}')
    assert [r.line for r in tables.read_roles(spark, f"file://{tmp_path}/roles").collect()] == ["[R] | name: n"]
    put(tmp_path, "pol/m.json", '{"schema_version": 1, "unknown_style": "error", "styles": {"D": "keep_dialogue"}, "source": {"stream_index": 2}}')
    put(tmp_path, "pol/n.json", b"\xfe")
    actions, settings = tables.read_policy(spark, f"file://{tmp_path}/pol")
    assert [(r.media_id, r.name, r.action) for r in actions.collect()] == [("m", "D", "keep_dialogue")]
    assert sorted((r.media_id, r.problem or "") for r in settings.collect()) == [("m", ""), ("n", "not UTF-8")]
    put(tmp_path, "res/m.jsonl", '{"entries": [{"idx": 1, "start": 0, "end": 1, "text": "t"}], "results": [{"idx": "1", "speaker": "A"}]}\n\n')
    assert [(r.media_id, r.idx, r.speaker) for r in tables.read_results(spark, f"file://{tmp_path}/res", ["A"]).collect()] == [("m", 1, "A")]
    put(tmp_path, "probe/m.json", json.dumps({"streams": [{"index": 0, "codec_type": "video"}, *({"index": i, "codec_type": "subtitle", "codec_name": c, "start_time": "0.5"} for i, c in enumerate(("ass", "ssa", "subrip", "webvtt", "mov_text", None), 1))]}))
    got = [(r.subtitle_index, r.codec_name, r.support, r.title, r.start_time) for r in tables.read_probes(spark, f"file://{tmp_path}/probe").orderBy("subtitle_index").collect()]
    assert got == [(0, "ass", "prepare", "", "0.5"), (1, "ssa", "prepare", "", "0.5"), (2, "subrip", "extracted_only", "", "0.5")] + [(i, c, "inspect_only", "", "0.5") for i, c in ((3, "webvtt"), (4, "mov_text"), (5, ""))]
    assert {(r.project, r.status) for r in tables.read_catalog(spark, f"file://{tmp_path}/p", False).collect()} == {("one", "missing media"), ("two", "missing media")}
    sizes = {os.path.basename(r.path): r.size for r in tables.read_manifest(spark, f"file://{tmp_path}/seg").collect()}
    assert sizes == {"m.json": (tmp_path / "seg/m.json").stat().st_size, "n.json": 1}


def test_scene_timelines_with_and_without_names(spark, tmp_path):
    s = spark.createDataFrame([("m", 1, " a  b\n", 0, 1000), ("m", 2, "", 1000, 1000), ("m", 12345, None, 2000, 3000)], "media_id string, scene_id int, name string, start_ms long, end_ms long")
    assert subtitles.write_scene_srt(s, f"file://{tmp_path}/out") == 1
    got = subtitles.read_srt(spark, f"file://{tmp_path}/out", "scene").orderBy("idx").collect()
    assert [(r.media_id, r.idx, r.text, r._corrupt) for r in got] == [("m", 1, "a b", None), ("m", 2, "scene_0002", None), ("m", 12345, "scene_12345", None)]
    put(tmp_path, "in/n.srt", "1\n00:00:01,000 --> 00:00:02,000\n\n2\n00:00:00,500 --> 00:00:03,000\n  one \n two\n\n3\n00:00:04,000 --> 00:00:03,000\nx\n\n4\n")
    got = subtitles.read_srt(spark, f"file://{tmp_path}/in", "scene").orderBy("idx").collect()
    assert [(r.idx, r.text, r._corrupt) for r in got] == [(1, "scene_0001", None), (2, "one two", "start order"), (3, "x", "end before start"), (4, "scene_0004", "too short")]


CUE = "media_id string, idx int, start_ms long, end_ms long, speaker string, text string, tags array<string>, source_entries array<int>"


def test_a_file_a_media_under_its_own_name(spark, tmp_path):
    rows = [(m, i, i * 1000, i * 1000 + 500, "A", f"t{i}", [], [i]) for m in ("m 1", "é=%2F", "x") for i in range(1, 4)]
    c = spark.createDataFrame(rows, CUE).repartition(5)
    path = f"file://{tmp_path}/srt"
    assert subtitles.write_srt(c, path) == 3
    assert sorted(os.listdir(tmp_path / "srt")) == sorted([f"{m}{e}" for m in ("m 1", "é=%2F", "x") for e in (".srt",)] + [f".{m}.srt.crc" for m in ("m 1", "é=%2F", "x") if (tmp_path / "srt" / f".{m}.srt.crc").exists()])
    got = sorted((r.media_id, r.idx, r.start_ms, r.text) for r in subtitles.read_srt(spark, path).collect())
    assert [g[1:] for g in got if g[0] == "x"] == [(i, i * 1000, f"t{i}") for i in range(1, 4)] and len(got) == 9
    assert {g[0] for g in got} == {"m 1", "é=%2F", "x"}
    subtitles.write_cues_jsonl(c, f"file://{tmp_path}/jsonl")
    back = subtitles.read_cues_jsonl(spark, f"file://{tmp_path}/jsonl").select(*[f.split()[0] for f in CUE.split(", ")])
    assert sorted(map(repr, back.collect())) == sorted(map(repr, c.collect()))
    with pytest.raises(FileExistsError):
        subtitles.write_srt(c, path)
    subtitles.write_srt(c.where("media_id = 'x' AND idx = 1"), path, mode="overwrite")
    assert subtitles.read_srt(spark, path).count() == 7


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    broken = F.when(F.col("id") == 70, F.raise_error(F.lit("broken"))).otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
    frame = spark.range(100).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), broken.alias("content"))
    with pytest.raises(Exception, match="broken"):
        files.write_files(frame, f"file://{tmp_path}/new")
    assert not (tmp_path / "new").exists()
    put(tmp_path, "old/keep", "kept")
    with pytest.raises(Exception, match="broken"):
        files.write_files(frame, f"file://{tmp_path}/old", "overwrite")
    assert os.listdir(tmp_path / "old") == ["keep"]
    for name in ("", "/a", "../a", "a//b", "a/./b", None):
        with pytest.raises(Exception, match="bad file name"):
            files.write_files(spark.createDataFrame([("ok", "x"), (name, "x")], "name string, content string"), f"file://{tmp_path}/names")
    with pytest.raises(ValueError, match="twice"):
        files.write_files(spark.createDataFrame([("a", "x"), ("a", "y")], "name string, content string"), f"file://{tmp_path}/names")
    assert not (tmp_path / "names").exists()


def test_a_manifest_a_speaker(spark, tmp_path):
    row = "media_id long, speaker string, start_ms long, end_ms long, entry_idx int, excerpt string, full_text string"
    clips = spark.createDataFrame([(1, "A/B", 2000, 3000, 2, "two", "two words"), (1, "A/B", 0, 1000, 1, "one", "one word"), (1, "A/B", 1000, 1500, 3, "", ""), (1, "C", 0, 10, 4, "x", "x"), (2, "C", 0, 10, 4, "y", "y")], row)
    assert tables.write_training_manifest(clips, f"file://{tmp_path}/out") == 3
    read = lambda name: (tmp_path / "out" / name / "filelist_audio.txt").read_text().splitlines()
    assert [line.split("|")[1:] for line in read("1/A_B")] == [["A/B", "one word"], ["A/B", "two words"]]
    assert read("1/A_B")[1].startswith("0003_") and len(read("1/C")) == len(read("2/C")) == 1
