"""The registered queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, discriminant, html_text, licenses, mixing, neardup, quality, sharding, tokens, toxicity, url_lists, vector_codes
from .common import crc_mod, read


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, freq = tokens.write_tokens(read(spark, sf_dir, "documents"), tokenizer_path())
    return tokens.read_tokens(spark, path, freq)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op4_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = sharding.two_pass_shuffle(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def list_history(pages: DataFrame) -> DataFrame:
    """Dated entries drawn from the pages' own hosts, domains and path steps (without ports and queries), so that lists grow with the pages."""
    keys = pages.select("page_id", F.explode(url_lists.keys_of(F.col("url"))).alias("key")).where(~F.col("key").rlike("[:?]"))
    first = keys.groupBy("key").agg(F.min("page_id").alias("k"), F.max(F.instr("key", "/") > 0).alias("path"))
    add = F.pmod(F.col("k") * 13, F.lit(300)).cast("int")
    entry = lambda name, day, action: F.struct(F.lit(name).alias("list"), day.cast("int").alias("day"), F.lit(action).alias("action"))
    none = F.lit(None).cast("array<struct<list:string,day:int,action:string>>")
    domain = F.when(~F.col("path") & (F.col("k") % 3 == 0), F.array(entry("domains", add, "add"), entry("domains", add + 60, "remove"), entry("domains", add + 90 + F.col("k") % 7, "add")))
    paths = F.when(F.col("path") & (F.col("k") % 5 == 0), F.array(entry("paths", add, "add"), entry("paths", add + 45, "remove")))
    both = F.concat(F.coalesce(domain, F.array().cast("array<struct<list:string,day:int,action:string>>")), F.coalesce(paths, none, F.array().cast("array<struct<list:string,day:int,action:string>>")))
    return first.select("key", F.explode(both).alias("e")).select("key", "e.*")


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.select(F.col("page_id").alias("id"), "url", F.pmod(F.col("page_id") * 37, F.lit(360)).cast("int").alias("day"))
    return url_lists.evaluate(captures, list_history(pages)).withColumnRenamed("id", "page_id")


OP5_SQL = """
WITH cap AS (
  SELECT page_id, url, CAST((page_id * 37) % 360 AS INTEGER) AS day,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*@)?(\\[[^]/?#]*\\]|[^/?#:@]*)', 2)) AS host,
         list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '/'), lambda x: x <> '') AS steps
  FROM pages),
ask AS (SELECT DISTINCT url, day, host, steps, string_split(host, '.') AS labels FROM cap WHERE host <> '' AND day IS NOT NULL),
asked AS (
  SELECT DISTINCT url, day, key FROM (
    SELECT url, day, unnest(list_transform(range(1, greatest(1, len(labels) - 1) + 1), lambda i: array_to_string(labels[i:], '.'))) AS key FROM ask
    UNION ALL
    SELECT url, day, unnest(list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(steps[1:i], '/'))) AS key FROM ask)),
first AS (SELECT key, min(page_id) AS k, contains(key, '/') AS is_path FROM asked JOIN cap USING (url, day) GROUP BY key),
entries AS (
  SELECT 'domains' AS list, key, (k * 13) % 300 AS day, 'add' AS action FROM first WHERE NOT is_path AND k % 3 = 0
  UNION ALL SELECT 'domains', key, (k * 13) % 300 + 60, 'remove' FROM first WHERE NOT is_path AND k % 3 = 0
  UNION ALL SELECT 'domains', key, (k * 13) % 300 + 90 + k % 7, 'add' FROM first WHERE NOT is_path AND k % 3 = 0
  UNION ALL SELECT 'paths', key, (k * 13) % 300, 'add' FROM first WHERE is_path AND k % 5 = 0
  UNION ALL SELECT 'paths', key, (k * 13) % 300 + 45, 'remove' FROM first WHERE is_path AND k % 5 = 0),
latest AS (
  SELECT a.url, a.day, e.list, e.key, arg_max(e.action, e.day) AS action
  FROM asked a JOIN entries e ON e.key = a.key AND e.day <= a.day GROUP BY ALL),
hit AS (SELECT url, day, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM latest WHERE action = 'add' GROUP BY url, day)
SELECT cap.page_id, url, day, hit.n IS NOT NULL AS blocked, coalesce(hit.n, 0) AS n_active, coalesce(lists, '') AS lists
FROM cap LEFT JOIN hit USING (url, day)
"""


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    q = quality.weak_supervision(docs, columns=["doc_id"])
    return q.select("doc_id", *[f"quality.{f}" for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")])


def op8_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = mixing.mix(docs, columns=["doc_id", "source"])
    return rows.select("doc_id", "source", *[f"mix.{f}" for f in ("size", "source_size", "target", "taken", "shards", "slots")])


def op9_wand_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontam.with_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", F.round("leak.share", 6).alias("share"), F.round("leak.bm25", 6).alias("bm25"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = licenses.with_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.explode("licenses").alias("found")).select("doc_id", "found.*")


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.scored(docs, *toxicity.learn(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic")), "score")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = discriminant.classified(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op12_sql() -> str:
    """The four rounds written out; sums of products of integers are exact in doubles."""
    steps = []
    for k in range(5):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, row, p, m, min((mm - 2 * list_inner_product(m, c) + cc) * 256 + e) AS best FROM parts JOIN c{k} USING (p) GROUP BY ALL)""")
        if k < 4:
            steps.append(f"""
u{k} AS (
  SELECT p, CAST(best % 256 AS BIGINT) AS e, i, floor(sum(x) / count(*)) AS x
  FROM (SELECT p, best, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM a{k}) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(f, c) AS c, list_inner_product(coalesce(f, c), coalesce(f, c)) AS cc
  FROM c{k} LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS f FROM u{k} GROUP BY ALL) USING (p, e))""")
    return """
WITH v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, row, p, q[p * (len(q) // 4) + 1 : (p + 1) * (len(q) // 4)] AS m, list_inner_product(m, m) AS mm FROM v, range(4) AS t(p)),
c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, m AS c, mm AS cc
  FROM parts WHERE row IN (SELECT row FROM v ORDER BY vec_id LIMIT 256)),""" + ",".join(steps) + """,
digest AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM c4)),
coded AS (
  SELECT row, string_agg(printf('%02x', CAST(best % 256 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(floor(best / 256)) AS BIGINT) AS error FROM a4 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (row) CROSS JOIN digest
"""


OP12_SQL = _op12_sql()


def op13_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents)),
runs AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS t(k)),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
cuts AS (
  SELECT lang, phrase, k, f AS a, j, string_split(phrase, ' ') AS w FROM f, (VALUES (1), (2)) AS t(j) WHERE k > j),
cut AS (
  SELECT c.lang, c.phrase, c.k, c.a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1 :], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM f WHERE k = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best JOIN n USING (lang) LEFT JOIN held USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_site_style_tree": op1_site_style_tree,
        "op5_url_lists": op5_url_lists,
        "op2_rans_tokens": op2_rans_tokens,
        "op3_order_minhash": op3_order_minhash,
        "op4_two_pass_shuffle": op4_two_pass_shuffle,
        "op8_hypergeometric_mix": op8_hypergeometric_mix,
        "op9_wand_decontamination": op9_wand_decontamination,
        "op10_license_scan": op10_license_scan,
        "op7_toxicity_grammar": op7_toxicity_grammar,
        "op6_weak_supervision": op6_weak_supervision,
        "op11_quadratic_quality": op11_quadratic_quality,
        "op12_lloyd_codes": op12_lloyd_codes,
        "op13_son_collocations": op13_son_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_lists": OP5_SQL, "op12_lloyd_codes": OP12_SQL, "op13_son_collocations": OP13_SQL}
