"""What lies on the disk while operators work: shuffle files and scratch tables."""

import os
import time

import corpus_pipeline
from cuelark.llm import neardup
from cuelark.scratch import shared_dir, stored


def shuffle_files(spark) -> set[str]:
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def tables(spark) -> dict[str, list[str]]:
    """The columns of each scratch table that is there."""
    top = os.path.dirname(shared_dir(spark)).removeprefix("file://")
    return {d: spark.read.parquet(f"{top}/{d}").columns for d in os.listdir(top) if os.path.exists(f"{top}/{d}/_SUCCESS")}


def test_shuffle_files_go_with_the_write(spark):
    before = shuffle_files(spark)
    table = stored(spark.range(100_000).repartition(3, "id"))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and table.count() == 100_000, left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_sketches_are_gone_before_the_cells(spark, monkeypatch):
    seen, old, across = [], set(tables(spark)), neardup.across
    monkeypatch.setattr(neardup, "across", lambda *a: (seen.extend(v for k, v in tables(spark).items() if k not in old), across(*a))[1])
    rows = [(d, " ".join(f"w{d % 20}x{i}" for i in range(30)) + (" tail" if d >= 20 else "")) for d in range(40)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d % 20 for d in range(40)}
    assert seen and not [c for c in seen if "keys" in c or {"n", "b"} <= set(c)], seen


def test_cells_in_slices_lose_no_pair(spark, monkeypatch):
    """Pairs that meet in cells only, as no round comes before, are the same in one slice and in many; so are those of a large group."""
    rows = [(p + 1000 * c, " ".join(f"p{i}" for i in range(70)) + " " + " ".join(f"t{p}w{i}c{c if i % 2 and i < 28 else 0}" for i in range(30))) for p in range(40) for c in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    asked, count = [], neardup.slice_count
    monkeypatch.setattr(neardup, "slice_count", lambda *a: asked.append(count(*a)) or 7)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == {d: d % 1000 for d, _ in rows}
    assert asked == [1]


def test_slices_follow_the_bytes_of_the_cells(spark, monkeypatch):
    known = spark.createDataFrame([(1, (10, bytearray(36)), [5], [6]), (2, (30, bytearray(36)), [5, 7], [])], "rep long, x struct<n_words long, bits binary>, low array<long>, high array<long>")
    monkeypatch.setattr(neardup, "SLICE_BYTES", 50)
    assert neardup.slice_count(12, known) == 24  # 12 rows of 100 bytes, 50 at a time
    monkeypatch.setattr(neardup, "SLICE_BYTES", 1)
    assert neardup.slice_count(12, known) == 30  # 40 words
    assert neardup.slice_count(0, known.limit(0)) == 1


def test_pipeline_drops_each_stage_behind_it(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    stage = lambda spark, docs, sf_dir: stored(docs.selectExpr("doc_id + 1 AS doc_id", "text"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), stage) for k in range(4)])
    old = set(tables(spark))
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = set(tables(spark)) - old
    assert [r.doc_id for r in out.collect()] == [5] and len(left) == 2, left  # the last stage's input and its own table
