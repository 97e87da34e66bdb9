"""Cases of the third round's findings."""

import pytest
from pyspark.sql import functions as F

from cuelark.functions import text as T
from cuelark.operators import intervals as I
from cuelark.operators import labels as L
from cuelark.plans import more_queries
from cuelark.sources import files

SMALL = "/root/testdata/sf0.001"
CUT = '[{"idx":1,"speaker":"A","confidence":"high"'


@pytest.mark.parametrize(
    "kind,reply,error",
    [
        ("labels", CUT, "bad json"),
        ("labels", f"Sure:\n```json\n{CUT}\n```", "bad json"),
        ("labels", CUT + "},{", "bad json"),
        ("labels", "no answer", "no json"),
        ("corrections", '[{"idx":1', "bad json"),
        ("corrections", '{"idx":1}', "no json"),
        ("cuts", '{"cuts":[{"after_idx":3', "bad json"),
        ("cuts", "[3]", "no json"),
    ],
)
def test_a_reply_cut_off_before_a_bracket_closes_is_bad_json(spark, kind, reply, error):
    rows, errors = L.parse_replies(spark.createDataFrame([(1, 2, reply)], "media_id long, batch_id long, reply string"), kind)
    assert [tuple(r) for r in errors.collect()] == [(1, 2, error)] and rows.count() == 0


def test_files_are_moved_by_tasks_not_by_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ThreadPoolExecutor", None)  # the driver's mover
    frame = spark.range(300).select(F.format_string("m%d/s %d/é#?%%41.txt", F.col("id") % 10, F.col("id")).alias("name"), F.concat(F.lit("one\ntwo "), F.col("id").cast("string")).alias("content"))
    assert files.write_files(frame.repartition(5), f"file://{tmp_path}/out") == 300
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert found == {f"m{i % 10}/s {i}/é#?%41.txt": f"one\ntwo {i}\n" for i in range(300)}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    # a file that Hadoop wrote has a checksum, which goes with it
    spark.range(1).selectExpr("'old' AS value").coalesce(1).write.text(f"file://{tmp_path}/h")
    part = next(p.name for p in (tmp_path / "h").iterdir() if p.name.startswith("part-"))
    files.write_files(spark.createDataFrame([(part, "new")], "name string, content string"), f"file://{tmp_path}/h", "overwrite")
    assert [r.line for r in files.read_lines(spark, f"file://{tmp_path}/h", "part-*").collect()] == ["new"]


def test_stores_without_a_mount_are_written_through_spark(spark, tmp_path):
    frame = spark.createDataFrame([("a/b", "x"), ("c", "y")], "name string, value string")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"file://{tmp_path}")
    assert files._by_driver(frame, f"file://{tmp_path}", f"file://{tmp_path}/_stage-1", at.getFileSystem(spark._jsc.hadoopConfiguration())) == 2
    assert ((tmp_path / "a/b").read_text(), (tmp_path / "c").read_text()) == ("x\n", "y\n")


@pytest.mark.parametrize("query", [more_queries.x1, more_queries.e1])
def test_a_raw_cue_is_classed_once(spark, query):
    once = more_queries.raw_cues(spark, SMALL).select(T.classified(F.col("raw")).alias("c"))
    folds = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    assert folds(query(spark, SMALL)) == folds(once) > 0


def test_attached_segments_are_joined_once(spark):
    cues = spark.createDataFrame([(1, 1, 0, 100, "A"), (1, 2, 200, 300, "A")], "media_id long, idx int, start_ms long, end_ms long, speaker string")
    segments = spark.createDataFrame([(1, "S1", 10, 60), (1, "S2", 20, 40), (1, "S3", 50, 80), (1, "S3", 90, 95), (1, "S2", 95, 95)], "media_id long, speaker string, start_ms long, end_ms long")
    audio = spark.createDataFrame([(1, 300)], "media_id long, duration_ms long")
    got = I.attach_segments(cues, audio, segments)
    assert sorted((r.idx, r.candidate, r.overlaps, r.coverage) for r in got.collect()) == [(1, "S1", "S1=50,S2=20,S3=35", 0.75), (2, "?", "", 0.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2  # a side of the range join each
