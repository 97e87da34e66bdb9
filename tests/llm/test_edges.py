"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuelark.llm import collocations, decontam, discriminant, html_text, licenses, mixing, neardup, quality, queries, sharding, tokens, toxicity, url_lists, vector_codes

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"word{i % 97} other{i % 89}" for i in range(60))
ROWS = [
    (1, WORDS, "en", "a", 1),
    (1, WORDS, "en", "a", 1),
    (2, WORDS, None, None, None),
    (3, None, "en", "b", 0),
    (4, "", "en", "b", 0),
    (None, "no id here", "en", "c", 10),
    (5, "x " * 40_000 + "tail", "en", "c", 80_004),
    (6, "é　ü 日本 \u0000 🙂\n\n\t\r\n", "fr", "", 9),
    (7, WORDS.replace("word3 ", "changed "), "en", "a", 2),
]
EXTRA = ["shard", "bucket", "size", "slot", "target", "score", "kept", "counts", "quality", "part", "ids", "label", "a", "b", "rep", "label", "key", "__x"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, DOC)
    return d.withColumns({c: F.lit("clash") for c in dict.fromkeys(EXTRA)})


@pytest.fixture(scope="module")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_quality(docs, nothing):
    rows = quality.weak_supervision(docs.drop("quality")).select("doc_id", "quality.*", "kept").collect()
    assert len(rows) == len(ROWS)
    by = {r[0]: r for r in rows}
    assert by[3]["n_words"] == by[4]["n_words"] == 0 and by[3]["base_failed"]
    assert by[5]["n_words"] == 40_001 and by[5]["n_repeat_words"] == 40_000
    assert quality.weak_supervision(nothing.drop("quality")).count() == 0


def test_neardup(docs, nothing):
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r.class_id for r in rows}
    assert by[1] == by[2] == by[7] == 1 and by[3] == by[4] == 3 and by[5] == 5
    assert neardup.near_duplicates(nothing).count() == 0
    assert [r.class_id < 0 for r in rows if r.doc_id is None] == [True]
    assert len({r.class_key for r in rows}) == 5
    kept = neardup.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 5, 6] and kept.columns == docs.columns
    assert neardup.one_of_each(nothing).count() == 0


def test_neardup_tells_texts_of_one_id_apart(spark):
    other = WORDS.replace("word", "term").replace("other", "else")
    rows = [(7, WORDS, "a", {"k": 1}), (7, other, "b", {"k": 2}), (9, other.replace("term5 ", "x "), "c", None), (None, "one two three four five six", "d", None), (None, "six five four three two one", "e", None), (7, other, "b", {"k": 2})]
    d = spark.createDataFrame(rows, "doc_id long, text string, h1 string, m map<string, int>")
    got = neardup.near_duplicates(d).collect()
    keys = [sorted({r.class_key for r in got if r.doc_id == i}) for i in (7, 9, None)]
    assert [len(k) for k in keys] == [2, 1, 2] and keys[1][0] in keys[0] and len({*keys[0], *keys[2]}) == 4
    assert len({r.class_id for r in got}) == 4 and {r.class_id for r in got if r.class_id >= 0} == {7}
    want = [(None, "d"), (None, "e"), (7, "a"), (7, "b")]
    for order in (d, d.orderBy(F.desc("text"))):
        assert sorted(((r.doc_id, r.h1) for r in neardup.one_of_each(order).collect()), key=str) == sorted(want, key=str)


def test_tokens(spark, docs, nothing):
    path, freq = tokens.write_tokens(docs, queries.tokenizer_path(), part_bytes=4000)
    rows = tokens.read_tokens(spark, path, freq).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert rows[4].n_tokens == rows[5].n_tokens == 1
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    path, freq = tokens.write_tokens(nothing, queries.tokenizer_path())
    assert tokens.read_tokens(spark, path, freq).count() == 0


def test_sharding(docs, nothing):
    _, out = sharding.two_pass_shuffle(docs, bucket_bytes=500)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.two_pass_shuffle(nothing)[1].count() == 0


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).select("doc_id", "source", "mix.*").collect()
    assert len(rows) == len(ROWS)
    assert all(r.taken <= 2 * r.size and len(r.shards) == r.copies for r in rows)
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed(docs).count() == sum(r.copies for r in rows)


def test_toxicity(spark, docs, nothing):
    learned, weights = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(docs.drop("score"), learned, weights, "score").where("score between 0 and 1").count() == len(ROWS)
    assert toxicity.scored(nothing.drop("score"), learned, weights, "score").count() == 0


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame([(1, WORDS[:200]), (2, None), (3, ""), (4, "no id here"), (4, "no id here")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    rows = decontam.with_leaks(docs, items).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: [x.item_id for x in r.leaks] for r in rows}
    assert by[2] == [1] and by[None] == [4, 4] and by[3] == by[4] == []
    assert decontam.with_leaks(docs, items.limit(0)).where(F.size("leaks") > 0).count() == 0
    assert decontam.with_leaks(nothing, items).count() == 0
    # slices of the index change nothing
    again = decontam.with_leaks(docs, items, most_items=2).collect()
    assert {r.doc_id: sorted(x.item_id for x in r.leaks) for r in again} == {k: sorted(v) for k, v in by.items()}


def test_licenses(docs, nothing):
    assert licenses.with_licenses(docs).where(F.size("licenses") > 0).count() == 0
    assert licenses.with_licenses(nothing).count() == 0


def test_pages(spark):
    page = "page_id long, url string, html string, host string, text string"
    rows = [(1, "http://a.b/c", "<p>x", "h", "t"), (1, "http://a.b/c", "<p>x", "h", "t"), (2, None, None, None, None), (None, "", "", "", ""), (3, "u", "<" * 50 + "&#0;&bogus;<p", "", ""), (4, "http://a.b", "<div>" * 3000 + "deep" + "</div>" * 10, "", "")]
    got = html_text.extract(spark.createDataFrame(rows, page)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "x" and by[2] == by[None] == "" and by[4] == "deep"
    assert html_text.extract(spark.createDataFrame([], page)).count() == 0


def test_url_lists(spark):
    cap = spark.createDataFrame([(1, "http://x.a.com/p/q?z#f", 5), (1, "http://x.a.com/p/q?z#f", 5), (2, None, 5), (3, "", 5), (4, "http://a.com", None), (None, "http://a.com/", 9), (None, "http://a.com/", 3), (7, "http://a.com/", 3), (7, "http://b.com/", 3)], "id long, url string, day int").withColumn("key", F.lit("clash"))
    ent = spark.createDataFrame([("l", "a.com", 1, "add"), ("l", "a.com", 1, "add"), ("l", "A.com", 9, "remove"), ("m", "x.a.com/p", 5, "remove"), ("m", "x.a.com/p", 5, "add"), (None, "a.com", 1, "add"), ("n", "com", 1, "add"), ("o", "a.com", None, "add"), ("o", "a.com", 1, "odd")], "list string, key string, day int, action string")
    rows = url_lists.evaluate(cap, ent).collect()
    assert sorted((str(r.id), r.blocked, r.n_active, r.lists) for r in rows) == [("1", True, 2, "l,m")] * 2 + [("2", False, 0, ""), ("3", False, 0, ""), ("4", False, 0, ""), ("7", False, 0, ""), ("7", True, 1, "l"), ("None", False, 0, ""), ("None", True, 1, "l")]
    assert url_lists.evaluate(cap.limit(0), ent).count() == 0
    assert url_lists.evaluate(cap, ent.limit(0)).where("blocked").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, nothing, k, tmp_path):
    base = docs.drop("quality")
    spark.createDataFrame([(1, "an item of seven words or so")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, base, str(tmp_path))
    if k < 4:
        assert out.columns == base.columns
    assert out.count() > 0
    assert stage(spark, nothing.drop("quality"), str(tmp_path)).count() == 0


def test_vector_codes(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 1.0, -0.25, 3.0], 1), (1, [0.5, 1.0, -0.25, 3.0], 1), (2, None, 1), (3, [0.5, None, 1.0, 2.0], 1), (4, [inf, 0.0, 0.0, 0.0], 1), (5, [nan, 0.0, 0.0, 0.0], 1), (6, [1.0], 1), (7, [], None), (None, [1e30, -1e30, 0.0, 0.0], None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("code", "salt", "pos", "entry", "n", "error")})
    books, out = vector_codes.compress(d)
    got = out.collect()
    # one length; with three vectors there are three entries, of which equal ones leave the later unused
    assert sorted((r.vec_id or 0, r.code, r.error) for r in got) == [(0, "02020202", 0), (1, "00000000", 0), (1, "00000000", 0)]
    assert books.shape == (4, 3, 1) and {r.label_error for r in got} == {0}
    assert vector_codes.compress(d.limit(0))[1].count() == 0
    only = vector_codes.compress(d.where("vec_id = 7"))[1].collect()
    assert [(r.code, r.error) for r in only] == [("00000000", 0)]


def test_collocations(docs, nothing):
    d = docs.withColumns({c: F.lit("clash") for c in ("phrase", "f", "w", "rank", "n", "l", "r")}).union(docs.withColumns({c: F.lit("clash") for c in ("phrase", "f", "w", "rank", "n", "l", "r")}))
    got = collocations.collocations(d).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n) for r in got if r.lang == "en" and r.phrase.startswith("x")] == [("x x x", 79996, 80000, 79998, 80000 + 2 * (1 + 3 + 3 * 120))]
    assert {r.lang for r in got} == {"en"}
    assert collocations.collocations(nothing).count() == 0


def test_discriminant(spark, docs, nothing):
    d = docs.drop("quality").withColumn("x", F.lit("clash")).withColumn("held_out", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in discriminant.classified(d, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0), (7, 1), (7, 0)], none.schema)
    assert len({r.score for r in discriminant.classified(d, one).collect()}) == 1
    both = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (6, 0)], none.schema).withColumn("text", F.lit("clash"))
    got = discriminant.classified(d, both).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] > 0.5 > by[3] == by[4]
    assert discriminant.classified(nothing.drop("quality"), both).count() == 0
