"""The driver's tables read as what the operators take.

An utterance is a line of a document; its task, speaker and duration follow from
its place. Both engines build the same rows: each function has its SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, where the input is fewer files than there are cores (a
    file of one row group is one task's work, however it is split)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    small = df.rdd.getNumPartitions() <= 4 * n and len(df.inputFiles()) < n
    return df.repartition(n) if small else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master gets a
    temporary one where spark.checkpoint.dir is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        named = f"file://{tempfile.gettempdir()}/skein-checkpoints"
    return named.rstrip("/")


#: Lines that a document's numbers leave room for: a hundred million.
LINES = 100_000_000


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, utt_id, audio_path, text, language, task, duration, source, speaker, translation)."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    docs = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    utt = F.substring(F.sha1(F.concat_ws("|", "source", F.col("doc_id").cast("string"), F.col("line").cast("string"))), 1, 16)
    task = F.when((F.col("doc_id") + F.col("line")) % 4 == 0, "translate").otherwise("transcribe")
    return docs.select(
        (F.col("doc_id") * LINES + F.col("line")).alias("seq"), utt.alias("utt_id"), F.concat(F.lit("audio/"), utt, F.lit(".wav")).alias("audio_path"), "text", F.col("lang").alias("language"), task.alias("task"),
        (F.length("text").cast("double") / (8 + (F.col("doc_id") + F.col("line")) % 20)).alias("duration"), "source", (F.col("doc_id") % 37).cast("string").alias("speaker"),
        F.when(task == "translate", F.lower("text")).otherwise("").alias("translation"),
    )


MANIFEST_SQL = f"""manifest AS (
  SELECT doc_id * {LINES} + line AS seq, u.utt_id, 'audio/' || u.utt_id || '.wav' AS audio_path, text, lang AS language, task,
    CAST(length(text) AS DOUBLE) / (8 + (doc_id + line) % 20) AS duration, source, CAST(doc_id % 37 AS VARCHAR) AS speaker, CASE WHEN task = 'translate' THEN lower(text) ELSE '' END AS translation
  FROM (SELECT *, substring(sha1(concat_ws('|', source, CAST(doc_id AS VARCHAR), CAST(line AS VARCHAR))), 1, 16) AS utt_id,
          CASE WHEN (doc_id + line) % 4 = 0 THEN 'translate' ELSE 'transcribe' END AS task
        FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)) u)"""


def with_addresses(rows: DataFrame) -> DataFrame:
    """Every 13th utterance names an address, so that the rule for it is seen at work."""
    return rows.withColumn("text", F.when(F.col("seq") % 13 == 0, F.concat("text", F.lit(" http://x"))).otherwise(F.col("text")))


#: Words of an utterance in pairs.
STRETCH = 24


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, part, language, source, reference, hypothesis, avg_logprob): each stretch of
    STRETCH words of a line against itself less its 7th words and with its 11th replaced."""
    rows = manifest(spark, sf_dir).select("seq", "language", "source", F.split("text", " ").alias("all"))
    rows = rows.select("seq", "language", "source", F.posexplode(F.expr(f"transform(sequence(0, (size(all) - 1) div {STRETCH}), k -> slice(all, {STRETCH} * cast(k AS int) + 1, {STRETCH}))")).alias("part", "ws"))
    heard = F.expr("array_join(filter(transform(ws, (w, i) -> CASE WHEN (seq + i) % 7 = 0 THEN null WHEN (seq + i) % 11 = 0 THEN 'uh' ELSE w END), w -> w IS NOT NULL), ' ')")
    return rows.select("seq", F.col("part").cast("long").alias("part"), "language", "source", F.array_join("ws", " ").alias("reference"), heard.alias("hypothesis"), (-(F.col("seq") % 23).cast("double") / 10).alias("avg_logprob"))


PAIRS_SQL = f"""stretches AS (SELECT seq, language, source, part, words[part * {STRETCH} + 1:part * {STRETCH} + {STRETCH}] AS ws
  FROM (SELECT seq, language, source, string_split(text, ' ') AS words, unnest(range((len(string_split(text, ' ')) - 1) // {STRETCH} + 1)) AS part FROM manifest)),
pairs AS (SELECT seq, part, language, source, array_to_string(ws, ' ') AS reference,
    array_to_string(list_filter(list_transform(ws, lambda w, i: CASE WHEN (seq + i - 1) % 7 = 0 THEN NULL WHEN (seq + i - 1) % 11 = 0 THEN 'uh' ELSE w END), lambda w: w IS NOT NULL), ' ') AS hypothesis
  FROM stretches)"""


def token_rows(spark: SparkSession, sf_dir: str, begin: int = 1000) -> DataFrame:
    """(conv_id, pos, token, window_seconds, offset): turns as token sequences in which each opens with a stamp."""
    turns = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    two = F.array((F.lit(begin) + F.least(F.col("turn") * 150, F.lit(1500))).cast("long"), (F.length(F.coalesce("text", F.lit(""))) % 997).cast("long"))
    rows = turns.select("conv_id", "turn", F.posexplode(two).alias("k", "token"))
    return rows.select("conv_id", (F.col("turn") * 2 + F.col("k")).alias("pos"), "token", F.lit(30.0).alias("window_seconds"), (F.col("conv_id") * 30).cast("double").alias("offset"))


TOKEN_ROWS_SQL = """tokens AS (
  SELECT conv_id, turn * 2 + k AS pos, CASE WHEN k = 0 THEN 1000 + least(turn * 150, 1500) ELSE length(coalesce(text, '')) % 997 END AS token, CAST(30 AS DOUBLE) AS window_seconds, CAST(conv_id * 30 AS DOUBLE) AS "offset"
  FROM conversations, (VALUES (0), (1)) v(k) WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"""
