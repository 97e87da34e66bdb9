"""The operators against brute force, exact round trips and held-out labels, on small tables."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import takewhile
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelark.llm import collocations, decontam, discriminant, html_text, licenses, mixing, neardup, quality, queries, sharding, tokens, toxicity, url_lists, vector_codes
from cuelark.llm import words as W

DIR = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_hashes_tell_words_apart():
    texts = ["a b  a\tb", "", "é é 🙂", "ab a b"]
    seen = {}
    for s in W.slices(pa.array(texts)):
        words = W.hash_words(s)
        flat = [w for t in texts for w in split(t)]
        assert words.counts.tolist() == [4, 0, 3, 3]
        for w, h in zip(flat, words.hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_quality_counts_and_verdict(spark, docs, rows):
    got = {r.doc_id: r for r in queries.op6_weak_supervision(spark, DIR).collect()}
    for r in rows:
        w = split(r.text)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + j for i in range(len(w) - 2) for j in range(3) if grams[tuple(w[i : i + 3])] > 1}
        seen, dup = set(), 0
        for line in (r.text or "").split("\n"):
            if split(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), dup, len(cover))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (g.kept and g.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    got = queries.op6_weak_supervision(spark, BIG).collect()
    assert all(r.kept or r.base_failed for r in got if labels.get(r.doc_id) == 1)
    assert not any(r.kept for r in got if labels.get(r.doc_id) == 0)


def test_posteriors_equal_brute_force(spark, docs):
    """EM with plain loops over the documents themselves, and Bayes' rule for each of them."""
    rows = quality.weak_supervision(docs, columns=["doc_id"]).select("quality.*").collect()
    votes = [tuple(r.votes) for r in rows]
    prior = ({1: 5.0, 0: 5.0, -1: 0.1}, {1: 0.5, 0: 5.0, -1: 5.0})
    q = [0.05 if -1 in v else 0.95 for v in votes]
    for _ in range(60):
        share = (sum(q) + 4.0) / (len(q) + 5.0)
        mass = [[dict(p) for p in prior] for _ in votes[0]]
        for w, v in zip(q, votes, strict=True):
            for r, x in enumerate(v):
                mass[r][0][x] += w
                mass[r][1][x] += 1 - w
        fresh = []
        for v in votes:
            good, bad = share, 1 - share
            for r, x in enumerate(v):
                good *= mass[r][0][x] / sum(mass[r][0].values())
                bad *= mass[r][1][x] / sum(mass[r][1].values())
            fresh.append(good / (good + bad))
        moved, q = max(abs(a - b) for a, b in zip(q, fresh, strict=True)), fresh
        if moved < 1e-9:
            break
    for r, p in zip(rows, q, strict=True):
        assert r.probability == pytest.approx(p, abs=1e-6) and r.kept == (not r.base_failed and r.probability >= 0.5)


def test_em_finds_the_faulty_rule():
    rng = random.Random(1)
    patterns = Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        right = lambda p: rng.random() < p
        patterns[tuple([(0 if good or not right(0.7) else -1), (0 if good or not right(0.6) else -1), 1 if right(0.9) == good else 0])] += 1
    share, tables = quality.fit(sorted(patterns.items()))
    assert quality.posterior((-1, -1, 0), share, tables) < 0.1 < 0.9 < quality.posterior((0, 0, 1), share, tables)


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_banded_alignment_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 12))]
        b = [x for x in a if rng.random() > 0.2] + [b"d"] * rng.randint(0, 3)
        k, d = rng.randint(0, 6), distance(a, b)
        assert neardup.banded_distance(a, b, k) == (d if d <= k else None)


def test_near_duplicates_lose_no_pair(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").where("doc_id < 400")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    texts = sorted(((r.doc_id, (r.text or "").encode().split()) for r in docs.collect()), key=lambda x: len(x[1]))
    root = {i: i for i, _ in texts}

    def find(x):
        return x if root[x] == x else find(root[x])

    for p, (i, a) in enumerate(texts):
        masks = neardup.word_masks(a)
        for j, b in texts[p + 1 :]:
            if len(a) < 0.8 * len(b) - 1e-9:
                break
            if neardup.banded_distance(a, b, int(0.2 * len(b) + 1e-9), masks) is not None:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert got == {i: find(i) for i, _ in texts}


def test_tokens_are_the_librarys(spark, docs, rows):
    path, freq = tokens.write_tokens(docs, queries.tokenizer_path(), part_bytes=50_000)
    got = sorted(map(tuple, tokens.read_tokens(spark, path, freq).collect()))
    library, start = tokens.table(queries.tokenizer_path()).tokenizer, 0
    for r, g in zip(sorted(rows, key=lambda r: r.doc_id), got, strict=True):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert g == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("text", ["It's don't, 'Re. <|endoftext|>. x\x1cy 12.5 İ. ﬁ É.", "ΟΔΟΣ, Σ. l'", "été. ÉTÉ!! $$$ &&& a*** <p> ¿qué? “x”", "日本語。 テスト", "a ́b  c", ""])
def test_pieces_equal_whole_texts(text):
    t = tokens.table(queries.tokenizer_path())
    got = [i for s in W.slices(pa.array([text])) for i in t.encode(s)[0].tolist()]
    assert got == t.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 5, 4096, 20_000, 1_300_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 60_000).astype(np.uint16)
    counts = np.bincount(ids, minlength=1)
    coder = tokens.Rans(tokens.scaled({int(i): int(counts[i]) for i in np.flatnonzero(counts)}))
    row = coder.encode(ids)
    assert (coder.decode(n, row["lanes"], row["states"], row["payload"]) == ids).all()
    for first, left, states in coder.checkpoints(row["lanes"], row["checkpoints"]):
        part = coder.decode(n, row["lanes"], states, row["payload"], first, 3, left)
        assert (part == ids[first * row["lanes"] : (first + 3) * row["lanes"]]).all()


def test_a_damaged_block_is_noticed(spark, docs):
    path, freq = tokens.write_tokens(docs.limit(20), queries.tokenizer_path())
    block = spark.read.schema(tokens.BLOCKS).parquet(path).first().asDict()
    block["payload"] = bytes([block["payload"][0] ^ 1]) + bytes(block["payload"][1:])
    batch = pa.RecordBatch.from_pylist([block])
    with pytest.raises(ValueError, match="damaged"):
        list(tokens.decode_blocks(freq)(iter([batch])))


def test_shards_and_permutations_equal_brute_force(spark):
    """The shard by its law, and each bucket's order by a plain Fisher-Yates over the same generator's draws."""
    d = spark.createDataFrame([(i % 50 if i % 9 else None, f"text {i // 3}") for i in range(300)], "doc_id long, text string")
    _, out = sharding.two_pass_shuffle(d, bucket_bytes=300)
    rows = out.collect()
    assert len(rows) == 300
    # equal doc_ids share a shard, the null one too, and are spread over buckets
    assert all(len({r.shard for r in rows if r.doc_id == k}) == 1 for k in {r.doc_id for r in rows})
    assert len({r.bucket for r in rows if r.doc_id is None}) > 1
    draws = spark.sql("SELECT id, s, xxhash64(coalesce(cast(id AS string), ''), 7, s) w FROM (SELECT explode(array(null, 0, 1, 2, 3, 49)) id), (SELECT explode(sequence(0, 8)) s)").collect()
    for r in rows:
        own = sorted((x.w, x.s) for x in draws if x.id == r.doc_id)
        if own:
            assert r.shard == max(x for x in own if x[1] < 8)[1] and r.grown_shard == own[-1][1]
    for s in {r.shard for r in rows}:
        at = 0
        for b in sorted({r.bucket for r in rows if r.shard == s}):
            cell = [r for r in rows if (r.shard, r.bucket) == (s, b)]
            order = sorted(((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.size) for r in cell), key=lambda x: (x[0] == -1, x))
            place = np.arange(len(cell))
            np.random.Generator(np.random.PCG64([7, s, b])).shuffle(place)
            got = [(-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.size) for r in sorted(cell, key=lambda r: r.slot)]
            assert got == [order[i] for i in place] and min(r.slot for r in cell) == at
            at += len(cell)


def test_shards(spark, rows):
    got = queries.op4_two_pass_shuffle(spark, DIR).collect()
    again = queries.op4_two_pass_shuffle(spark, DIR).collect()
    assert sorted(got) == sorted(again)
    text = {r.doc_id: (r.text or "").encode() for r in rows}
    for r in got:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]))
        assert r.grown_shard in (r.shard, 8)


def filled(sizes, total, weights=(3, 1, 2)):
    names = sorted(sizes)
    open_, out = {s: weights[i % 3] for i, s in enumerate(names)}, {}
    while open_:
        level = (total - sum(out.values())) / sum(open_.values())
        full = [s for s, w in open_.items() if level * w > 2 * sizes[s]]
        if not full:
            return out | {s: level * w for s, w in open_.items()}
        for s in full:
            out[s] = 2.0 * sizes[s]
            del open_[s]
    return out


def test_mix_meets_its_targets(spark):
    got = queries.op8_hypergeometric_mix(spark, BIG).collect()
    text = {r.doc_id: len(split(r.text)) for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        assert r.size == text[r.doc_id] and r.taken <= 2 * r.size and all(0 <= s < 8 for s in r.shards)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    want = filled(sizes, 1.5 * sum(sizes.values()))
    for r in got:
        assert r.target == pytest.approx(want[r.source])
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    assert sorted(map(str, got)) == sorted(map(str, queries.op8_hypergeometric_mix(spark, BIG).collect()))


def test_mix_draws_as_brute_force_does(spark):
    """Every copy has a slot, gapless in its shard, no two copies of a document fall together, and the drawn epoch is a plain prefix of the permuted blocks."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = mixing.mix(docs, blocks=24, columns=["doc_id", "source"]).select("doc_id", "source", "mix.*").collect()
    by_shard: dict[int, list[int]] = {}
    for r in rows:
        assert len(r.shards) == len(r.slots) == r.copies
        for shard, slot in zip(r.shards, r.slots, strict=True):
            by_shard.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        full = int(own[0].target // own[0].source_size)
        assert {r.copies for r in own} <= {full, full + 1}
        drawn = sum(r.size for r in own if r.copies == full + 1)
        assert abs(drawn - (own[0].target - full * own[0].source_size)) <= max(r.size for r in own) / 2 + 1
    # a shard's order is no order of doc_ids
    first = sorted((slot, r.doc_id) for r in rows for shard, slot in zip(r.shards, r.slots, strict=True) if shard == 0)
    ids = [d for _, d in first]
    assert ids != sorted(ids) and sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.7 * len(ids)


def test_splitting_tree_deals_equal_numbers_of_blocks(spark):
    blocks = spark.range(1000).selectExpr("false __null", "cast(id % 7 as string) __src", "cast(id as int) __block", "1 __full", "cast(0 as double) __left")
    leaves = mixing.deal_blocks(blocks, 8, 3).groupBy("__shard").count().collect()
    assert len(leaves) == 8 and all(r["count"] == 125 for r in leaves)
    odd = mixing.deal_blocks(blocks, 5, 3).groupBy("__shard").count().collect()
    assert len(odd) == 5 and all(199 <= r["count"] <= 201 for r in odd)


def simple(text):
    return [w for w in (re.sub(r"[!-/:-@\[-`{-~]", "", x) for x in split((text or "").lower())) if w]


def test_leaks_equal_brute_force(spark):
    items = {r.item_id: simple(r.text) for r in spark.read.parquet(f"{BIG}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op9_wand_decontamination(spark, BIG).collect()}
    want = set()
    for r in spark.read.parquet(f"{BIG}/documents.parquet").collect():
        w = simple(r.text)
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for item, words in items.items():
            own = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
            if len(own & grams) >= 0.8 * len(own):
                want.add((r.doc_id, item))
    assert got == want and want


def test_edited_leaks_are_found_and_clean_passages_are_not():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    item = [rng.choice(vocabulary) for _ in range(60)]
    part = [(7, decontam.item_words([" ".join(item)])[0])]
    index = decontam.indexes_of(part, decontam.Stats.of([w for _, w in part]))
    noise = [rng.choice(vocabulary) for _ in range(900)]
    edited = [*item]
    edited[30] = "changed"
    half = item[:40]
    texts = [" ".join([*noise[:333], *x, *noise[333:]]) for x in (item, edited, half, [])]
    assert [len(r) for r in decontam.find(index)(pa.array(texts)).to_pylist()] == [1, 1, 0, 0]


def test_licenses_equal_brute_force(spark, rows):
    templates = {n: simple(t) for n, t in licenses.TEMPLATES.items()}
    got = {(r.doc_id, r.license) for r in queries.op10_license_scan(spark, BIG).collect()}
    want = set()
    for r in spark.read.parquet(f"{BIG}/documents.parquet").collect():
        w = simple(r.text)
        for name, t in templates.items():
            k = min(5, len(t))
            own = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
            # every stretch as long as the template and a quarter
            size = len(own) + max(1, len(own) // 4)
            grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            near = [i for i, g in enumerate(grams) if g in own]
            if any(len(own & set(grams[max(0, i - j) : max(0, i - j) + size])) >= 0.8 * len(own) for i in near for j in range(size)):
                want.add((r.doc_id, name))
    assert got == want and want


def test_long_templates_in_running_text():
    rng = random.Random(5)
    noise = lambda n: [f"n{rng.randint(0, 999)}" for _ in range(n)]
    held = licenses.Templates()
    for name, text in licenses.TEMPLATES.items():
        words = text.split()
        texts = [" ".join([*noise(77), *words, *noise(40)]), " ".join(noise(200))]
        found = [x for s in W.normal_slices(pa.array(texts)) for x in held.scan(s)]
        assert name in {x["license"] for x in found[0]} and not found[1]


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no system license texts")
def test_full_texts_of_any_length():
    """The system's own license texts as templates: each is found in running text, and with a tenth of its words changed it is not lost to a cap."""
    rng = random.Random(8)
    noise = lambda n: " ".join(f"n{rng.randint(0, 999)}" for _ in range(n))
    folder = Path("/usr/share/common-licenses")
    names = ["GPL-2", "GPL-3", "LGPL-2.1", "Apache-2.0", "MPL-2.0"]
    held = licenses.Templates({n: t for n, t in licenses.read_templates(str(folder)).items() if n in names})
    assert max(len(s) for s in held.sets) > 4000
    for name in names:
        text = f"{noise(300)} {(folder / name).read_text(errors='replace')} {noise(200)}"
        (found,) = [x for s in W.normal_slices(pa.array([text])) for x in held.scan(s)]
        assert name in {f["license"] for f in found if f["best"]}


def test_versions_of_a_license_are_told_apart():
    held = licenses.Templates()
    for name in ("GPL-2.0-notice", "GPL-3.0-notice", "GPL-2.0-header", "AGPL-3.0-header"):
        (found,) = [x for s in W.normal_slices(pa.array([f"so much. {licenses.TEMPLATES[name]} and more"])) for x in held.scan(s)]
        assert [f["license"] for f in found if f["best"]] == [name]


def test_band_settings():
    for w in takewhile(lambda x: x <= 1 << 14, licenses.widths()):
        r = licenses.floor_of(w)
        assert 1 - (1 - r**licenses.ROWS) ** licenses.bands_for(r) >= licenses.CERTAIN or r == 1


def test_held_out_toxicity(spark):
    rows = queries.op7_toxicity_grammar(spark, "/root/testdata/sf0.1").where("held_out").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    c = Counter((labels[r.doc_id], r.predicted) for r in rows if r.doc_id in labels)
    assert c[1, 1] / (c[1, 1] + c[1, 0]) > 0.88 and c[1, 1] / (c[1, 1] + c[0, 1]) > 0.97


def test_clauses_of_kinds_no_label_speaks_of_still_count(spark):
    """The tables' toxic documents hold bare insults. Threats, negations and reports move a learned score all the same, each its own way."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    learned, weights = toxicity.learn(docs, spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "toxic"))
    texts = ["you are an idiot", "you are not an idiot", "he said that you are an idiot", "I will kill you", "kill the lights", "good day"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    aimed, negated, reported, threat, bare, none = (r.score for r in toxicity.scored(rows, learned, weights, "score").orderBy("doc_id").collect())
    assert threat > 0.9 > 0.1 > bare == none and negated < aimed - 0.05 and reported < aimed - 0.05


@pytest.mark.parametrize("text,kind", [("you are an idiot", 2), ("what an idiot", 1), ("you are not an idiot", 4), ("she said he is an idiot", 5), ("I will kill you", 3), ("kill time", 0), ("they said so. You moron", 2)])
def test_clauses(text, kind):
    weights, counts = toxicity.Grammar({}).matches(text)
    assert [i for i, n in enumerate(counts) if n] == ([kind] if kind else [])


def test_one_document_from_a_checkpoint(spark, docs, rows):
    path, freq = tokens.write_tokens(docs, queries.tokenizer_path())
    wanted = [r.doc_id for r in rows][::7]
    got = {r.doc_id: r for r in tokens.read_documents(spark, path, freq, spark.createDataFrame([(d,) for d in wanted], "doc_id long")).collect()}
    library = tokens.table(queries.tokenizer_path()).tokenizer
    text = {r.doc_id: r.text or "" for r in rows}
    assert sorted(got) == sorted(wanted)
    assert all(got[d].ids == [*library.encode(text[d], add_special_tokens=False).ids, 1] for d in wanted)


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    """A tokenizer whose words hold white space, and one of more than 65,536 ids."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = {"<unk>": 0, "<end>": 1} | {f"w{i}": i for i in range(2, 70_000)}
    library = Tokenizer(models.WordLevel(vocabulary, unk_token="<unk>"))
    library.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("|")
    path = str(tmp_path / "own.json")
    library.save(path)
    assert not tokens.table(path).alone and tokens.table(path).width == 4
    folder, freq = tokens.write_tokens(spark.createDataFrame([(1, "w7|w69999|w 5"), (2, None)], "doc_id long, text string"), path)
    got = [tuple(r) for r in tokens.read_tokens(spark, folder, freq).orderBy("start").collect()]
    assert got == [(1, 0, 4, zlib.crc32(np.array([7, 69_999, 0, 1], "<u4").tobytes())), (2, 4, 1, zlib.crc32(np.array([1], "<u4").tobytes()))]


def test_pieces_of_one_hash_keep_their_own_ids(monkeypatch):
    t = tokens.PieceTable(queries.tokenizer_path())
    monkeypatch.setattr(W, "mix", lambda h: h & np.uint64(3))
    texts = ["one two three four five six", "seven one eight", "two nine ten one"]
    for text in texts:
        got = [i for s in W.slices(pa.array([text])) for i in t.encode(s)[0].tolist()]
        assert got == t.tokenizer.encode(text, add_special_tokens=False).ids


def test_grammar_equals_its_transducers_one_after_the_other():
    """Brute force: each transducer rewrites the whole sentence before the next one reads it; a clause weighs its word's weight times e to its arcs' sum."""
    rng = random.Random(9)
    words = [w for name in toxicity.BASE for w in toxicity.BASE[name][:3]] + ["plain", "words", ",", "."]
    learned = {"!^smash": 0.7, "=foul": 1.2}
    grammar = toxicity.Grammar(learned)
    lexicon = {w: (name, 1.0) for name, ws in toxicity.BASE.items() for w in ws} | {"smashing": ("THREAT", 0.7), "foul": ("INSULT", 1.2), ",": ("COMMA", 0.0)}
    for _ in range(300):
        tokens_ = [rng.choice([*words, "smashing", "foul"]) for _ in range(rng.randint(1, 40))]
        weights, counts = [0.0] * 6, [0] * 6
        for sentence in " ".join(tokens_).split("."):
            said = sentence.split()
            symbols = [(lexicon.get(w, ("OTHER", 0))[0], frozenset()) for w in said]
            arcs = [0.0] * len(said)
            for step in toxicity.STEPS:
                state = 0
                for i, symbol in enumerate(symbols):
                    state, symbols[i], weight = step(state, symbol)
                    arcs[i] += weight
            for w, symbol, arc in zip(said, symbols, arcs, strict=True):
                if kind := toxicity.kind_of(symbol):
                    counts[kind] += 1
                    weights[kind] += lexicon[w][1] * math.exp(arc)
        got = grammar.matches(" ".join(tokens_))
        assert got[1] == counts and got[0] == pytest.approx(weights)


def test_scores_equal_brute_force(spark):
    text = "you are an idiot. I will kill you. they said he is scum"
    weights = [-1.0, 0.5, 0.7, 0.9, -0.2, -0.3, 0.1, 0.2, 0.4, 0.6]
    aimed, threat, reported = math.exp(0.4), math.exp(0.6), math.exp(-1.0 + 0.4)
    x = [1, 0, math.log1p(aimed), math.log1p(threat), 0, math.log1p(reported), 1, 1, math.log1p(100 * 3 / 13), (aimed + threat) / 10]
    want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x, strict=True))))
    row = toxicity.scored(spark.createDataFrame([(1, text)], "doc_id long, text string"), {}, weights, "s").first()
    assert row.s == pytest.approx(want)


def test_main_text(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    import html as entities

    for r in queries.op1_site_style_tree(spark, DIR).collect():
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]+>", " " if "<br" in p else "", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_markup_parts():
    text = lambda h: [b["text"] for b in html_text.parse(h, {})["blocks"]]
    assert text('<header><h1>Site</h1></header><div class="menu">x</div><article><header><h1>T &eacute; &#8212;</h1></header><p>a<br>b <b>c</b></p><div class="comments"><p>nice</p></div><ul><li>1<li>2</ul><form>q</form><p>z</article><aside>n</aside>') == ["T é —", "a b c", "1", "2", "z"]
    assert text("<p>one <b>bold <p title='a>b'>two &lt;tag&gt; 3 < 4") == ["one bold", "two <tag> 3 < 4"]
    # names inside other attributes' names and values say nothing
    assert text('<article style="overflow:hidden"><p title="a hidden gem">one</p><p data-id="nav">two</p></article>') == ["one", "two"]
    # body is no article, whatever it is called
    assert text('<body class="single single-post"><header>h</header><div class="menu">m</div><div><p>story</p></div></body>') == ["story"]
    # a comment is one, even as an article; words of a name are noise only if nothing else is named
    assert text('<article><p>x</p><article class="comment"><p>c</p></article><div class="social-history network widget skip">y</div></article>') == ["x", "y"]
    # an article wins over the form or layout round it
    assert text('<form><div class="layout has-sidebar"><article><p>long text</p></article></div><div class="sidebar">s</div></form>') == ["long text"]
    assert text("<form><p>a page in a form</p></form>") == ["a page in a form"] and text("<div>some text</div><form>q</form>") == ["some text"]
    # parts of names mark no article, and an article that holds little of the page is not believed
    assert text('<h1 class="post-title">T</h1><div class="post-meta">by</div><div class="content"><p>body</p></div>') == ["T", "by", "body"]
    assert text(f"<article>tiny</article><div>{'long ' * 30}</div>") == ["tiny", ("long " * 30).strip()]
    assert text('<p>a <span class="ad">buy</span> b</p>') == ["a b"] and text('<div class="entry-content"><p>x</p></div><p>y</p>') == ["x"]


def test_comments_notices_and_teasers_by_what_their_names_say():
    text = lambda h: [b["text"] for b in html_text.parse(h, {})["blocks"]]
    for comments in ('<div class="article-comments"><p>nice</p></div>', '<div class="user-comments">nice</div>', '<section id="comment-thread"><p>nice</p></section>', '<div class="discussion"><article><p>nice</p></article></div>'):
        assert text(f"<article><p>story</p>{comments}</article>") == ["story"] and text(f"<article><p>story</p></article>{comments}") == ["story"], comments
    for notice in ('<div class="cookie-banner">we use cookies</div>', '<div id="cookieConsent"><p>ok</p></div>', '<div class="related-posts"><a>more</a></div>', '<ul class="menu-primary"><li>Home</ul>'):
        assert text(f"<article><p>story</p>{notice}</article>") == ["story"] and text(f"<div><p>story</p></div>{notice}") == ["story"], notice
    # an article in a sidebar counts where there is no other; one in comments never does
    assert text('<div class="sidebar"><article><p>story</p><div class="share">s</div></article></div>') == ["story"]
    assert text('<article><p>story and more</p></article><aside><article>teaser</article></aside>') == ["story and more"]
    assert text('<nav><main>all there is</main></nav><div class="comments"><article>nice</article></div>') == ["all there is"]
    # a label is a word of its paragraph, but for those of forms
    assert text("<article><p>press <label>Start</label> now</p></article>") == ["press Start now"] and text("<article><p>x</p><form><label>Name</label></form></article>") == ["x"]
    # states and other words say nothing
    assert text('<article class="post comments-open"><p>story</p></article>') == ["story"] and text('<div class="no-comments has-sidebar"><p>story</p></div>') == ["story"]
    assert text('<div class="lunch-menu"><p>soup</p></div>') == ["soup"]


def test_entropies_equal_brute_force(spark):
    """Importance of every node of a host from its definition: shares of the variants of its child sequences and of its contents over the different pages."""
    rng = random.Random(21)
    page = lambda i: "".join(f"<div class={c}><p>{rng.choice(words)}</p>{'<ul><li>x</ul>' if rng.random() < p else ''}</div>" for c, words, p in (("a", ["same"], 0.0), ("b", ["one", "two"], 0.5), ("c", [str(i)], 0.2), ("d", ["rare"] * 9 + ["odd"], 0.1)))
    rows = [(i, f"http://h.com/{i}", page(i)) for i in range(25)]
    rows += rows[:5]
    parsed = spark.createDataFrame([(i, u, "h.com", hash(h), h) for i, u, h in rows], "page_id long, url string, host string, copy long, html string").mapInArrow(html_text.parse_batches, html_text.PARSED)
    seen = {r.copy: r.nodes for r in parsed.collect()}
    variants = {}
    for nodes in seen.values():
        for n in nodes:
            for kind in ("shape", "content"):
                variants.setdefault(n.node, {}).setdefault(kind, []).append(n[kind])

    def entropy(values):
        m = len(values)
        return 1.0 if m == 1 else -sum(c / m * math.log(c / m) for c in Counter(values).values()) / math.log(m)

    importance = {}
    for node, v in variants.items():
        m, l = len(v["shape"]), len(set(v["shape"]))
        x = (1 - html_text.GAMMA**l) * entropy(v["shape"]) + html_text.GAMMA**l * entropy(v["content"])
        importance[node] = (m * x + html_text.PRIOR) / (m + html_text.PRIOR)
    best = max(importance.values())
    want = {n for n, x in importance.items() if x < html_text.LOW * min(1.0, best)}
    assert {r.node for r in html_text.low_branches(parsed).collect()} == want and 0 < len(want) < len(importance)


def test_tree_removes_what_a_host_repeats(spark):
    rows = [(i, f"http://h.com/{i}", f"<div class=x><p>about us and so on</p></div><div class=y><p>{' '.join(str(i * 7 + j) for j in range(20))}</p></div>") for i in range(20)]
    rows.append((99, "http://alone.com/", "<div class=x><p>about us and so on</p></div><div class=y><p>story</p></div>"))
    # inside an article too; copies of a page count once, so an article that is served often stays
    rows += [(200 + i, f"http://in.com/{i}", f"<article><p>{' '.join(str(i * 7 + j) for j in range(20))}</p><div class=z>read on, dear reader</div></article>") for i in range(20)]
    rows += [(300 + i, f"http://often.com/{i}", "<article><p>the same words</p></article>") for i in range(30)] + [(330, "http://often.com/x", "<article><p>others</p></article>")]
    # pages without a host have nothing to do with each other
    rows += [(400 + i, None if i % 2 else "no url", f"<div class=x><p>about us and so on</p></div><div class=y>{i}</div>") for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("about" not in got[i] and str(i * 7) in got[i] for i in range(20))
    assert got[99] == "about us and so on\nstory"
    assert all("reader" not in got[200 + i] and str(i * 7) in got[200 + i] for i in range(20))
    assert got[300] == "the same words" and got[330] == "others"
    assert all(got[400 + i] == f"about us and so on\n{i}" for i in range(20))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 9, 30])
def test_tree_has_one_law_for_hosts_of_any_size(spark, n):
    """A branch that repeats on every page goes as soon as PRIOR pages of which nothing is known weigh less than LOW."""
    rows = [(i, f"http://h.com/{i}", f"<div class=x>about us</div><div class=y>{i} and {i * 31}</div>") for i in range(n)]
    got = [r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    gone = html_text.PRIOR / (n + html_text.PRIOR) < html_text.LOW
    assert all(("about" not in t) == gone for t in got) and gone == (n > 1)


def test_pipeline_stages_equal_brute_force(spark, docs):
    """Each stage on what the one before it kept, against plain Python."""
    import corpus_pipeline

    held = docs.withColumn("n", F.col("n_chars"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, held, DIR).collect()
    verdict = {r.doc_id: r.kept for r in queries.op6_weak_supervision(spark, DIR).collect()}
    assert sorted(r.doc_id for r in good) == sorted(d for d, k in verdict.items() if k)
    once = stages["near duplicates"](spark, spark.createDataFrame(good, held.schema), DIR).collect()
    texts = sorted(((r.doc_id, (r.text or "").encode().split()) for r in good), key=lambda x: len(x[1]))
    root = {i: i for i, _ in texts}

    def find(x):
        return x if root[x] == x else find(root[x])

    for p, (i, a) in enumerate(texts):
        for j, b in texts[p + 1 :]:
            if len(a) >= 0.8 * len(b) - 1e-9 and neardup.banded_distance(a, b, int(0.2 * len(b) + 1e-9)) is not None:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert sorted(r.doc_id for r in once) == sorted({find(i) for i, _ in texts})
    clean = stages["benchmark leaks"](spark, spark.createDataFrame(once, held.schema), DIR).collect()
    items = [simple(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    leaks = lambda t: any(len(grams(w) & grams(simple(t))) >= 0.8 * len(grams(w)) for w in items)
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in once if not leaks(r.text))
    rest = spark.createDataFrame(clean, held.schema)
    drawn = stages["source mix"](spark, rest, DIR).collect()
    copies = {r.doc_id: r.mix.copies for r in mixing.mix(rest).collect()}
    assert Counter(r.doc_id for r in drawn) == Counter({d: n for d, n in copies.items() if n})
    sizes, taken = Counter(), Counter()
    for r in clean:
        sizes[r.source] += len(split(r.text))
    for r in drawn:
        taken[r.source] += len(split(r.text))
    want = filled(sizes, 1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= max(len(split(r.text)) for r in clean if r.source == s) / 2 + 1 for s in want)
    coded = stages["token output"](spark, spark.createDataFrame(drawn, held.schema), DIR).collect()
    library, start, crcs = tokens.table(queries.tokenizer_path()).tokenizer, 0, {}
    for r in sorted(drawn, key=lambda r: r.doc_id):
        crcs.setdefault(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 1])
    for r in sorted(coded, key=lambda r: r.start):
        ids = crcs[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in drawn)


def test_url_lists_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DIR}/pages.parquet'")
    want = con.execute(queries.OP5_SQL).fetchall()
    got = [tuple(r) for r in queries.op5_url_lists(spark, DIR).select("page_id", "url", "day", "blocked", "n_active", "lists").collect()]
    assert sorted(got) == sorted(want) and any(r[3] for r in got)


def lloyd(rows, rounds=4):
    """The codes by plain loops: {vec_id: (code, error)}, books."""
    own = sorted((i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows)
    w = len(own[0][1]) // 4
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(4)]
    books = [[cut(v)[p] for _, v in own[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, m: min((far(m, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for _, v in own:
            for p, m in enumerate(cut(v)):
                held[p][best(p, m)[1]].append(m)
        books = [[[sum(x) // len(ms) for x in zip(*ms, strict=True)] if ms else c for c, ms in zip(b, h, strict=True)] for b, h in zip(books, held, strict=True)]
    found = {i: [best(p, m) for p, m in enumerate(cut(v))] for i, v in own}
    return {i: ("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for i, f in found.items()}, books


@pytest.mark.parametrize("scale", [1.0, 3e4])
def test_lloyd_codes_equal_brute_force(spark, scale):
    """A third of the vectors are one vector, so entries repeat and stay unused; large components leave the doubles' exact range."""
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, scale) for _ in range(8)]) for i in range(400)]
    rows = [(i, rows[7][1] if i % 3 == 0 else v) for i, v in rows]
    want, books = lloyd(rows)
    got_books, out = vector_codes.compress(spark.createDataFrame([(i, v, None if i % 5 == 0 else i % 2) for i, v in rows], "vec_id long, embedding array<float>, label int"))
    got = out.collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want and got_books.tolist() == books
    for label in (None, 0, 1):
        assert {r.label_error for r in got if r.label == label} == {sum(r.error for r in got if r.label == label)}


def test_only_members_that_change_entry_migrate(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(900)]
    sent = []
    settle = vector_codes.Residents.settle

    def noted(self, members):
        sent.append(members.count())
        return settle(self, members)

    monkeypatch.setattr(vector_codes.Residents, "settle", noted)
    vector_codes.compress(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int"))
    assert len(sent) == 4 and sent[0] == 3600 and all(0 < n < 1800 for n in sent[1:])


def phrases_of(rows, support):
    """Counts by (language, phrase) and of all words, by plain loops."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in (1, 2, 3):
                counts.update((lang or "und", " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return {k: n for k, n in counts.items() if n >= support}, totals


@pytest.mark.parametrize("shard_bytes", [200, 4000, 1 << 24])
def test_phrase_counts_equal_brute_force(spark, shard_bytes):
    """With small shards the lowered support is 1, with large ones it prunes and shards are silent; neither changes a count."""
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "Ab", "aB", " x", "日本"]
    rows = [(draw.choice(["en", "de", None]), draw.choice([" ", "  ", "\t"]).join(draw.choice(vocabulary) + draw.choice(["", "", "", ".", ",\n", "!?"]) for _ in range(draw.randrange(60)))) for _ in range(150)]
    rows += [("en", None), ("fr", ""), ("fr", " .. "), ("en", "a b a b a b " * 50)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want, totals = phrases_of(rows, 10)
    got = collocations.phrase_counts(frame, 10, shard_bytes).collect()
    assert {(r.lang, r.phrase): r.f for r in got if r.phrase is not None} == want
    assert {r.lang: r.f for r in got if r.phrase is None} == {k: totals[k] for k in ("en", "de", "und", "fr")}


def test_collocations_equal_brute_force(spark):
    draw = random.Random(12)
    rows = [("en", " ".join(draw.choice(["new york", "new york city", "the", "of the", "city", "york"]) for _ in range(40))) for _ in range(80)]
    want, totals = phrases_of(rows, 10)
    f = {p: n for (_, p), n in want.items()}
    found = []
    for p, a in f.items():
        w = p.split(" ")
        if len(w) == 1:
            continue
        cuts = [(10**6 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if not any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 2 * n >= a for q, n in f.items()):
            found.append((-score, -a, p, f[" ".join(w[:k])], f[" ".join(w[k:])]))
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), most=25).orderBy("rank").collect()
    assert [(-r.score, -r.a, r.phrase, r.l, r.r) for r in got] == sorted(found)[:25] and {r.n for r in got} == {totals["en"]}
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_lowered_supports_lose_nothing():
    for sizes in ([1], [3, 1], [5, 5, 5, 1], [1] * 30, [100, 1, 1, 1]):
        least = [collocations.lowered(s, sum(sizes), 10) for s in sizes]
        assert sum(t - 1 for t in least) < 10


def test_discriminant_equals_brute_force(spark):
    """Means and covariances from plain loops over the labelled rows, the densities by determinants and inverses without factors."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = docs.select("doc_id", discriminant.text_features(F.col("text")).alias("x")).collect()
    d = len(discriminant.FEATURES)
    taught = {k: [np.array(r.x) / discriminant.UNIT for r in rows if known.get(r.doc_id) == k and zlib.crc32(str(r.doc_id).encode()) % 5] for k in (0, 1)}
    total = sum(map(len, taught.values()))
    mean = {k: sum(v) / len(v) for k, v in taught.items()}
    scatter = {k: sum(np.outer(x - mean[k], x - mean[k]) for x in v) for k, v in taught.items()}
    pooled = (scatter[0] + scatter[1]) / total
    spread = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    cov = {}
    for k, v in taught.items():
        c = (scatter[k] + discriminant.POOLED_ROWS * pooled) / (len(v) + discriminant.POOLED_ROWS) / np.outer(spread, spread)
        m = sum(c[i, i] for i in range(d)) / d
        square = sum(c[i, j] ** 2 for i in range(d) for j in range(d))
        weight = min(1.0, ((1 - 2 / d) * square + (m * d) ** 2) / ((len(v) + 1 - 2 / d) * (square - m * m * d)))
        cov[k] = np.array([[(1 - weight) * c[i, j] + (weight * m if i == j else 0) for j in range(d)] for i in range(d)])

    def log_density(k, x):
        z = x / spread - mean[k] / spread
        return -0.5 * z @ np.linalg.inv(cov[k]) @ z - 0.5 * math.log(np.linalg.det(cov[k]))

    got = {r.doc_id: r for r in queries.op11_quadratic_quality(spark, BIG).collect()}
    assert len(got) == len(rows)
    for r in rows:
        x = np.array(r.x) / discriminant.UNIT
        odds = (log_density(1, x) - log_density(0, x)) / discriminant.TEMPER + math.log(len(taught[1]) / len(taught[0]))
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-max(-500, min(500, odds)))), abs=1e-6)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)
    held = [(known[i], r.score, r.predicted) for i, r in got.items() if r.held_out and known.get(i) is not None]
    good, bad = [s for k, s, _ in held if k], [s for k, s, _ in held if not k]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad) > 0.99
    assert sum(k == p for k, _, p in held) / len(held) > 0.97


def test_discriminant_does_not_hang_on_partitions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    runs = [{(r.doc_id, r.score) for r in discriminant.classified(docs.repartition(n), labels.repartition(n)).collect()} for n in (1, 5)]
    assert runs[0] == runs[1]


def test_slices_of_items_change_no_leak_no_share_and_no_score(spark):
    """Items of 10 to 400 words: alone, in slices of any size and all at once they give the same rows."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: draw(n) for i, n in enumerate([10, 25, 25, 60, 70, 130, 400])}
    texts = [draw(300) + w[: int(len(w) * cut)] + draw(90) + w[int(len(w) * cut) :] + draw(300) for w in items.values() for cut in (0.0, 0.9)]
    # both halves, far apart: no passage of the item's own width holds enough, whatever other items there are
    texts.append(draw(50) + items[1][:13] + draw(150) + items[1][13:] + draw(50))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    rows = lambda **k: sorted((r.doc_id, x.item_id, x.share, x.bm25) for r in decontam.with_leaks(docs, frame, **k).collect() for x in r.leaks)
    whole = rows()
    assert {(2 * i, i) for i in items} <= {r[:2] for r in whole} and not any(r[0] == len(texts) - 1 for r in whole)
    assert rows(most_items=3) == whole == rows(most_items=1)


@pytest.mark.parametrize("most_tasks", [20_000, 3])
def test_slots_do_not_hang_on_how_the_input_is_split(spark, monkeypatch, most_tasks):
    """Repeated rows, a third of them one record, in any partitions and order: the same shards and slots; tasks of several cells change nothing."""
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(i % 40, f"text {i % 40}") for i in range(90)] + [(5, "the same")] * 60 + [(None, None)] * 3 + [(None, "")] * 2 + [(i, "x" * 30) for i in range(100, 130)]
    want = None
    for n, seed in ((1, 0), (3, 1), (7, 2)):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        monkeypatch.setattr(sharding, "MOST_TASKS", most_tasks if n > 1 else 20_000)
        _, out = sharding.two_pass_shuffle(spark.createDataFrame(mixed, "doc_id long, text string").repartition(n), bucket_bytes=200)
        got = sorted((r.doc_id is None, r.doc_id, r.text or "", r.size, r.shard, r.slot, r.grown_shard) for r in out.collect())
        want = want or got
        assert got == want
    assert len(want) == len(rows) and sorted((r[1], r[2]) for r in want if not r[0]) == sorted((i, t) for i, t in rows if i is not None)
    for s in {r[4] for r in want}:
        assert sorted(r[5] for r in want if r[4] == s) == list(range(sum(r[4] == s for r in want)))


FORMS = [
    # entry, captures it holds for, captures it does not
    ("a.com:8080/x", ["http://a.com:8080/x", "http://a.com:8080/x/y?q"], ["http://a.com/x", "http://a.com:80/x", "http://a.com:8080/xy"]),
    ("http://b.com:80", ["http://b.com/", "http://www.b.com:80/z", "http://b.com:/"], ["https://b.com/", "http://b.com:81/"]),
    ("b.com:443", ["https://b.com/p"], ["http://b.com/p"]),
    ("c.com/~user", ["http://c.com/%7Euser/z", "http://c.com/~user"], ["http://c.com/user", "http://c.com/~users"]),
    ("c.com/%7Eother", ["http://c.com/~other"], ["http://c.com/7Eother"]),
    ("c.com/a%2Fb", ["http://c.com/a%2Fb/c"], ["http://c.com/a/b"]),
    ("d.com.", ["http://d.com/", "http://D.com./x", "ftp://x.d.com"], ["http://d.com.au/"]),
    ("//e.com", ["https://e.com/q", "http://u:p@e.com/"], ["http://be.com/"]),
    ("f.com/p?id=1", ["http://f.com/p?id=1", "http://f.com//p/?id=1#x"], ["http://f.com/p", "http://f.com/p?id=12", "http://f.com/p/q?id=1"]),
    ("f.com?x", ["http://f.com/?x", "http://f.com?x"], ["http://f.com/", "http://f.com/y?x"]),
    ("f.com:8080/p?id=1", ["http://f.com:8080/p?id=1"], []),
    ("g.com/P/", ["http://g.com/P", "http://g.com/P?z"], ["http://g.com/p", "http://g.com/"]),
    ("[::1]:99", ["http://[::1]:99/"], ["http://[::1]/"]),
    ("1.2.3.4", ["http://1.2.3.4/x"], ["http://9.1.2.3.4/", "http://3.4/"]),
    ("/only/a/path", [], ["http://a.com/only/a/path"]),
    ("com", [], ["http://a.com/"]),
]


def test_entries_and_captures_in_all_their_forms(spark):
    entries = spark.createDataFrame([(f"l{i}", e, 1, "add") for i, (e, _, _) in enumerate(FORMS)], "list string, key string, day int, action string")
    captures = sorted({c for _, yes, no in FORMS for c in yes + no})
    got = {r.url: set(r.lists.split(",")) for r in url_lists.evaluate(spark.createDataFrame([(i, c, 5) for i, c in enumerate(captures)], "id long, url string, day int"), entries).collect()}
    for i, (entry, yes, no) in enumerate(FORMS):
        assert [c for c in yes if f"l{i}" not in got[c]] == [] and [c for c in no if f"l{i}" in got[c]] == [], entry


@pytest.mark.parametrize("per_task", [1_000_000, 3])
def test_the_merge_by_time_equals_brute_force(spark, per_task):
    """Keys with many marks and many captures, marks and captures of one day, lists that come and go; hot keys dealt to many tasks."""
    rng = random.Random(13)
    entries = [(rng.choice("lm"), rng.choice(["a.com", "x.a.com", "x.a.com/p", "b.com"]), rng.randrange(30), rng.choice(["add", "remove"])) for _ in range(120)]
    captures = [(i, rng.choice(["http://x.a.com/p/q", "http://a.com", "http://b.com/z", "http://c.com"]) + rng.choice(["", "?1", "?2"]), rng.randrange(-1, 32)) for i in range(150)]
    got = {r.id: (r.n_active, r.lists) for r in url_lists.evaluate(spark.createDataFrame(captures, "id long, url string, day int"), spark.createDataFrame(entries, "list string, key string, day int, action string"), per_task).collect()}
    asks = {"http://x.a.com/p/q": ["a.com", "x.a.com", "x.a.com/p"], "http://a.com": ["a.com"], "http://b.com/z": ["b.com"], "http://c.com": []}
    for i, url, day in captures:
        on = set()
        for name in "lm":
            for key in asks[url.split("?")[0]]:
                marks = [(d, a == "add") for n, k, d, a in entries if (n, k) == (name, key) and d <= day]
                if marks and any(adds for d, adds in marks if d == max(marks)[0]):
                    on.add((name, key))
        assert got[i] == (len(on), ",".join(sorted({n for n, _ in on})))
