"""Cue, line, prediction, scene and segment tables projected from the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200000000  # 2024-01-01 in microseconds


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cues(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    start = F.expr(f"(unix_micros(cast(ts as timestamp)) - {EPOCH}) div 60000")
    i = F.col("event_id")
    speaker = F.when(i % 13 == 0, "?").when(i % 17 == 0, "NONSPEECH").when(i % 19 == 0, "NONSPEECH:sfx").otherwise(F.col("event_type"))
    out = e.select(
        F.expr("user_id div 10").alias("media_id"),
        i.alias("src"),
        start.alias("start_ms"),
        F.when(i % 101 == 0, start).otherwise(start + F.round(F.col("value") * 1000).cast("long")).alias("end_ms"),
        speaker.alias("speaker"),
        (i % 7 == 0).alias("is_multi"),
        (i % 11 == 0).alias("is_lyric"),
        F.when(i % 23 == 0, "").otherwise(F.concat_ws(" ", "event_type", i.cast("string"))).alias("text"),
    )
    from pyspark.sql import Window

    order = Window.partitionBy("media_id").orderBy("start_ms", "end_ms", "src")
    return out.withColumn("idx", F.row_number().over(order)).withColumn("tags", F.when(F.col("is_multi"), F.array(F.lit("MULTI"))).otherwise(F.array().cast("array<string>")))


CUES = f"""cues AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, src) AS INTEGER) AS idx,
         CASE WHEN is_multi THEN ['MULTI'] ELSE [] END AS tags
  FROM (SELECT user_id // 10 AS media_id, event_id AS src, (epoch_us(ts) - {EPOCH}) // 60000 AS start_ms,
               (epoch_us(ts) - {EPOCH}) // 60000 + CASE WHEN event_id % 101 = 0 THEN 0 ELSE CAST(round(value * 1000) AS BIGINT) END AS end_ms,
               CASE WHEN event_id % 13 = 0 THEN '?' WHEN event_id % 17 = 0 THEN 'NONSPEECH'
                    WHEN event_id % 19 = 0 THEN 'NONSPEECH:sfx' ELSE event_type END AS speaker,
               event_id % 7 = 0 AS is_multi, event_id % 11 = 0 AS is_lyric,
               CASE WHEN event_id % 23 = 0 THEN '' ELSE event_type || ' ' || event_id END AS text
        FROM events))"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    start = F.col("turn") * 4000
    text = F.coalesce("text", F.lit(""))
    return c.select(F.col("conv_id").alias("media_id"), (F.col("turn") + 1).alias("idx"), start.alias("start_ms"), (start + F.least(F.char_length(text) * 10, F.lit(6000)) + 500).cast("long").alias("end_ms"), F.col("role").alias("speaker"), text.alias("text"), "turn")


LINES = """lines AS (
  SELECT conv_id AS media_id, turn + 1 AS idx, turn * 4000 AS start_ms,
         CAST(turn * 4000 + least(length(coalesce(text, '')) * 10, 6000) + 500 AS BIGINT) AS end_ms,
         role AS speaker, coalesce(text, '') AS text, turn
  FROM conversations)"""


def preds(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d)
    n = F.col("media_id") + F.col("turn")
    shift = F.when(n % 5 == 0, 40).otherwise(0)
    half = F.when(n % 7 == 0, F.substring("text", F.lit(1), F.floor(F.char_length("text") / 2).cast("int"))).otherwise(F.col("text"))
    text = F.when(n % 6 == 0, F.replace(half, F.lit(" "), F.lit("  "))).otherwise(half)
    turned = F.when(F.col("speaker") == "user", "assistant").when(F.col("speaker") == "assistant", "system").otherwise("user")
    speaker = F.when(n % 4 == 0, turned).otherwise(F.col("speaker"))
    confidence = F.element_at(F.array(*map(F.lit, ("high", "mid", "low", "unknown"))), (F.col("turn") % 4 + 1).cast("int"))
    kept = x.where((F.col("media_id") * 31 + F.col("turn")) % 9 != 0)
    return kept.select("media_id", F.col("idx").alias("pid"), (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"), text.alias("text"), speaker.alias("speaker"), speaker.alias("speaker_raw"), confidence.alias("confidence"))


PREDS = """preds AS (
  SELECT media_id, idx AS pid, start_ms + sh AS start_ms, end_ms + sh AS end_ms,
         CASE WHEN n % 6 = 0 THEN replace(half, ' ', '  ') ELSE half END AS text,
         CASE WHEN n % 4 = 0 THEN CASE speaker WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'system' ELSE 'user' END ELSE speaker END AS speaker,
         CASE WHEN n % 4 = 0 THEN CASE speaker WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'system' ELSE 'user' END ELSE speaker END AS speaker_raw,
         (['high', 'mid', 'low', 'unknown'])[turn % 4 + 1] AS confidence
  FROM (SELECT *, media_id + turn AS n, CASE WHEN (media_id + turn) % 5 = 0 THEN 40 ELSE 0 END AS sh,
               CASE WHEN (media_id + turn) % 7 = 0 THEN substring(text, 1, CAST(floor(length(text) / 2) AS INTEGER)) ELSE text END AS half
        FROM lines WHERE (media_id * 31 + turn) % 9 <> 0))"""


def scenes(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d).withColumn("scene_id", F.expr("(idx - 1) div 3 + 1"))
    s = x.groupBy("media_id", "scene_id").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return s.withColumn("enabled", ~((F.col("media_id") % 10 == 0) & (F.col("scene_id") == 1)))


SCENES = """scenes AS (
  SELECT media_id, (idx - 1) // 3 + 1 AS scene_id, min(idx) AS start_idx, max(idx) AS end_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
         NOT (media_id % 10 = 0 AND (idx - 1) // 3 + 1 = 1) AS enabled
  FROM lines GROUP BY ALL)"""


def segments(spark: SparkSession, d: str, offset_ms: int = 0) -> DataFrame:
    """Acoustic segments from three event types; the other rows are cues they label."""
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view", "error")).select("event_id", F.col("event_type").alias("kind"))
    c = cues(spark, d).join(e, F.col("src") == F.col("event_id"))
    label = F.when(F.col("kind") == "click", "SPK1").when(F.col("kind") == "view", "SPK2").otherwise("SPK3")
    return c.select("media_id", label.alias("speaker"), (F.col("start_ms") + offset_ms).alias("start_ms"), (F.col("end_ms") + offset_ms).alias("end_ms"))


SEGMENTS = """segs AS (
  SELECT media_id, CASE event_type WHEN 'click' THEN 'SPK1' WHEN 'view' THEN 'SPK2' ELSE 'SPK3' END AS speaker, start_ms, end_ms
  FROM cues JOIN events ON src = event_id WHERE event_type IN ('click', 'view', 'error')),
spoken AS (SELECT cues.* FROM cues JOIN events ON src = event_id WHERE event_type NOT IN ('click', 'view', 'error'))"""


def spoken(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(~F.col("event_type").isin("click", "view", "error")).select("event_id")
    return cues(spark, d).join(e, F.col("src") == F.col("event_id"), "left_semi")


def replies(spark: SparkSession, d: str, size: int = 4) -> DataFrame:
    """A JSON reply for each batch of predictions of a media: fenced where the batch is even, idx as text where odd, cut off for every tenth media."""
    x = preds(spark, d).withColumn("batch_id", F.expr(f"(pid - 1) div {size}"))
    odd = F.col("batch_id") % 2 == 1
    item = F.concat(F.lit('{"idx":'), F.when(odd, F.concat(F.lit('"'), F.col("pid").cast("string"), F.lit('"'))).otherwise(F.col("pid").cast("string")), F.lit(',"speaker":"'), F.col("speaker"), F.lit('","confidence":"'), F.col("confidence"), F.lit('"}'))
    b = x.withColumn("item", item).groupBy("media_id", "batch_id").agg(F.array_sort(F.collect_list(F.struct("pid", "item"))).alias("items"))
    body = F.concat(F.lit("["), F.array_join(F.transform("items", lambda i: i["item"]), ","), F.lit("]"))
    cut = F.when(F.col("media_id") % 10 == 0, F.substring(body, F.lit(1), F.char_length(body) - 2)).otherwise(body)
    reply = F.when(F.col("batch_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), cut, F.lit("\n```"))).otherwise(cut)
    return b.select("media_id", "batch_id", reply.alias("reply"))


#: Overrides before the texts: some are flags, some only look like one.
OVERRIDES = (r"{\pos(1,1)}", r"{\p1}", r"{\k10}", r"{\an8}", "", r"{\PBO2}", r"{\p0}", r"{\an77}", r"{\KF5}", r"\kt5\h")


def styled(spark: SparkSession, d: str) -> DataFrame:
    """Documents, whole, as events of three files: every 97th starts before 0, every 89th ends before it starts."""
    x = table(spark, d, "documents")
    i = F.col("doc_id")
    tag = F.element_at(F.array(*map(F.lit, OVERRIDES)), (i % 10 + 1).cast("int"))
    start = F.when(i % 97 == 0, F.lit(-1)).otherwise(i * 1000).cast("long")
    kind = F.when(i % 12 == 0, "Comment").when(i % 30 == 1, "Picture").otherwise("Dialogue")
    name = F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("n"), (i % 3).cast("string")))
    return x.select((i % 3).alias("media_id"), i.alias("event_index"), F.col("source").alias("style"), kind.alias("event_type"), (i % 3).cast("int").alias("layer"), name.alias("name"), start.alias("start_ms"), (start + F.when(i % 89 == 0, -500).otherwise(500)).alias("end_ms"), F.concat(tag, F.coalesce("text", F.lit(""))).alias("text"))


STYLED = f"""styled AS (
  SELECT doc_id % 3 AS media_id, doc_id AS event_index, source AS style, CASE WHEN doc_id % 12 = 0 THEN 'Comment' WHEN doc_id % 30 = 1 THEN 'Picture' ELSE 'Dialogue' END AS event_type, CAST(doc_id % 3 AS INTEGER) AS layer,
         CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'n' || doc_id % 3 END AS name, CASE WHEN doc_id % 97 = 0 THEN -1 ELSE doc_id * 1000 END AS start_ms,
         CASE WHEN doc_id % 97 = 0 THEN -1 ELSE doc_id * 1000 END + CASE WHEN doc_id % 89 = 0 THEN -500 ELSE 500 END AS end_ms,
         ([{', '.join("'" + o + "'" for o in OVERRIDES)}])[doc_id % 10 + 1] || coalesce(text, '') AS text
  FROM documents)"""
#: White space as Unicode has it, for the SQL's patterns.
SPACES = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACES}+', ''), '{SPACES}+$', '')"


def sql_plain(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '{SPACES}+', ' ', 'g')")


#: Aliases of each project: names in capitals, in every third project with a prefix, and in another third one name fewer.
def aliases(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "events").select(F.col("event_type").alias("variant")).distinct().where("variant <> 'error'")
    media = table(spark, d, "events").select(F.expr("user_id div 10").alias("media_id"), F.col("event_type").alias("variant")).distinct()
    own = media.join(kinds, "variant", "left_semi").where(~((F.col("media_id") % 3 == 2) & (F.col("variant") == "view")))
    return own.select("media_id", "variant", F.when(F.col("media_id") % 3 == 1, F.concat(F.lit("P_"), "variant")).otherwise(F.upper("variant")).alias("canonical"))


ALIASED = """al AS (SELECT DISTINCT user_id // 10 AS media_id, event_type AS variant, CASE WHEN user_id // 10 % 3 = 1 THEN 'P_' || event_type ELSE upper(event_type) END AS canonical
  FROM events WHERE event_type <> 'error' AND NOT (user_id // 10 % 3 = 2 AND event_type = 'view'))"""


def query(*parts: str) -> str:
    """A WITH statement; the last part is the last CTE and the body after it."""
    return "WITH RECURSIVE " + ",\n".join(parts)
