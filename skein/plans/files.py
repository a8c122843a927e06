"""Queries over files written from the driver's tables and read by the sources' scans."""

from __future__ import annotations

import io
import uuid
import wave as wavefile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import tokens as tk
from ..functions.evidence import advance_of, windows_of
from ..operators import curate, order
from ..sources import readers
from . import surrogates as s
from .corpus import AUDIO, SPLIT, M

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark) -> str:
    return f"{s.shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _flat(c: str):
    """A cell without tabs."""
    return F.translate(F.coalesce(c, F.lit("")), "\t", " ")


HEARD = f"{M}, {AUDIO}, heard AS (SELECT * FROM manifest JOIN audio USING (audio_path))"


def _audio(rows, path):
    """Utterances of under two seconds have no file."""
    return rows.where("duration >= 2").select(path.alias("audio_path"), "duration")


@query(f"{HEARD} SELECT substring(sha1('read' || speaker || '-' || seq), 1, 16) AS utt_id, lower(text) AS text, speaker, duration FROM heard")
def transcript_scan(spark, sf_dir):
    """Transcript files: an id and a text a line; utterances without audio go."""
    root, rows = _folder(spark), s.manifest(spark, sf_dir)
    key = F.concat("speaker", F.lit("-"), F.col("seq").cast("string"))
    rows.select(F.concat(key, F.lit(" "), "text").alias("value")).write.text(root)
    audio = _audio(rows, F.concat(F.lit(f"{root}/"), key, F.lit(".wav")))
    return readers.scan_transcripts(spark, root, "read", "en", audio, pattern="*.txt").select("utt_id", "text", "speaker", "duration")


@query(f"{HEARD} SELECT substring(sha1('books' || speaker || '_1_' || seq), 1, 16) AS utt_id, text, speaker, duration FROM heard")
def tab_transcript_scan(spark, sf_dir):
    """Transcripts of books: id, tab, text; case is kept."""
    root, rows = _folder(spark), s.manifest(spark, sf_dir)
    key = F.concat("speaker", F.lit("_1_"), F.col("seq").cast("string"))
    rows.select(F.concat(key, F.lit("\t"), "text").alias("value")).write.text(f"{root}/train/transcripts.txt")
    audio = _audio(rows, F.concat(F.lit(f"{root}/train/audio/"), "speaker", F.lit("/1/"), key, F.lit(".wav")))
    return readers.scan_tab_transcripts(spark, root, "books", "de", audio).select("utt_id", "text", "speaker", "duration")


@query(f"{HEARD} SELECT substring(sha1('clips' || seq), 1, 16) AS utt_id, replace(text, chr(9), ' ') AS text, replace(translation, chr(9), ' ') AS translation, speaker, duration FROM heard WHERE task = 'translate'")
def translation_scan(spark, sf_dir):
    """A headed table of clips, sentences and translations."""
    root, rows = _folder(spark), s.manifest(spark, sf_dir).where("task = 'translate'")
    table = rows.select(F.col("seq").cast("string").alias("path"), _flat("text").alias("sentence"), _flat("translation").alias("translation"), F.col("speaker").alias("client_id"))
    readers.write_table(table, f"{root}/t.tsv", header=True)
    audio = _audio(rows, F.concat(F.lit(f"{root}/clips/"), F.col("seq").cast("string")))
    return readers.scan_translations(spark, f"{root}/t.tsv", f"{root}/clips", "clips", "fr", audio).select("utt_id", "text", "translation", "speaker", "duration")


@query(f"{M} SELECT seq || '.wav' AS wav, replace(text, chr(9), ' ') AS reference FROM manifest")
def reference_scan(spark, sf_dir):
    """References of an evaluation set: the fourth of tab-separated cells."""
    root, rows = _folder(spark), s.manifest(spark, sf_dir)
    name = F.concat(F.col("seq").cast("string"), F.lit(".wav"))
    rows.select(F.concat_ws("\t", F.lit("0"), name, F.lit("raw"), _flat("text"), F.lit("more")).alias("value")).write.text(f"{root}/test.tsv")
    found = readers.scan_references(spark, f"{root}/test.tsv", f"{root}/audio", rows.select(F.concat(F.lit(f"{root}/audio/"), name).alias("audio_path")))
    return found.select(F.substring_index("wav", "/", -1).alias("wav"), "reference")


@query(f"{M} SELECT utt_id, audio_path, text, language, task, duration, source, speaker, translation FROM manifest")
def manifest_files(spark, sf_dir):
    """A manifest written as JSON lines and read again."""
    root = _folder(spark)
    readers.write_manifest(s.manifest(spark, sf_dir), root)
    return readers.read_manifest(spark, root)


@query(f"{SPLIT} SELECT split, language, utt_id, duration FROM rows_")
def shard_files(spark, sf_dir):
    """Shards by split and language, written and read again."""
    root = _folder(spark)
    readers.write_shards(order.speaker_split(s.manifest(spark, sf_dir), 20260301), root)
    return spark.read.parquet(root).select("split", "language", "utt_id", "duration")


@query(f"{M}, {s.PAIRS_SQL} SELECT seq || chr(9) || part || chr(9) || translate(reference, chr(9) || chr(13), '  ') || chr(9) || translate(hypothesis, chr(9) || chr(13), '  ') AS line FROM pairs")
def hypothesis_files(spark, sf_dir):
    """References and hypotheses in a tab-separated file, line by line."""
    root = _folder(spark)
    readers.write_hypotheses(s.pairs(spark, sf_dir).select("seq", "part", "reference", "hypothesis"), root, header=False)
    return spark.read.text(root).select(F.col("value").alias("line"))


@query("SELECT event_id AS step, value AS loss FROM events WHERE event_id % 3 > 0 AND value IS NOT NULL")
def metrics_files(spark, sf_dir):
    """A log that two writers append to, read by one of its keys."""
    root, e = _folder(spark), s.table(spark, sf_dir, "events").withColumn("step", F.col("event_id"))
    for k in range(3):
        readers.append_metrics(e.where(F.col("event_id") % 3 == k).select("step", F.col("value").alias("loss" if k else "dev_loss")), root)
    return readers.read_metrics(spark, root, "loss")


def _wave_file(values, rate: int = 16_000) -> bytes:
    out = io.BytesIO()
    with wavefile.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.rint(np.asarray(values, np.float64)).astype("<i2").tobytes())
    return out.getvalue()


@query("SELECT CAST(user_id AS VARCHAR) AS path, count(*) AS n, sum(round_even(value, 0) / 32768) AS total FROM events GROUP BY user_id")
def decoded_waves(spark, sf_dir):
    """Samples of audio files made of each user's values."""
    write = _wave_file

    @F.pandas_udf(BinaryType())
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(write)

    e = s.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("path")).agg(F.collect_list("value").alias("v"))
    waves = readers.decoded(e.select("path", packed("v").alias("content")))
    return waves.select("path", F.size("wave").cast("long").alias("n"), F.aggregate("wave", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@query("""WITH RECURSIVE r AS (SELECT user_id, count(*) * 48000 AS n FROM events GROUP BY user_id),
g AS (SELECT user_id, n, 0::BIGINT AS "window", 0::BIGINT AS start FROM r
  UNION ALL SELECT user_id, n, "window" + 1, start + CASE WHEN (start // 16000) % 5 = 0 THEN 480000 ELSE greatest(least(((start // 16000) * 7 % 31 + 0.25) * 16000, 480000), 8000)::BIGINT END FROM g
  WHERE start + CASE WHEN (start // 16000) % 5 = 0 THEN 480000 ELSE greatest(least(((start // 16000) * 7 % 31 + 0.25) * 16000, 480000), 8000)::BIGINT END < n)
SELECT user_id, "window", start FROM g""")
def transcribe_windows(spark, sf_dir):
    """The windows that transcribing a recording goes through: each starts where the
    last stamp of the one before says, a whole window on where it has none."""
    walk, step = windows_of, advance_of

    @F.pandas_udf("array<struct<window: long, start: long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        stamp = lambda at: 0.0 if at // 16_000 % 5 == 0 else at // 16_000 * 7 % 31 + 0.25
        for sizes in batches:
            yield sizes.map(lambda n: [{"window": k, "start": at} for k, at in enumerate(walk(int(n), lambda at: step(stamp(at))))])

    n = s.table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") * 48_000).alias("n"))
    return n.select("user_id", F.inline(run("n")))


@query("SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'missing' WHEN vec_id % 7 = 0 THEN 'differs' ELSE 'equal' END AS status, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN abs(embedding[1]::DOUBLE - (embedding[1] + 0.25::FLOAT)::FLOAT::DOUBLE) ELSE 0 END AS diff FROM embeddings")
def tensor_mismatches(spark, sf_dir):
    """Tensors against a copy in which some are missing and some differ in one value."""
    e = s.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").alias("values"))
    changed = F.transform("values", lambda x, i: F.when((F.col("name") % 7 == 0) & (i == 0), (x + F.lit(0.25).cast("float")).cast("float")).otherwise(x))
    copy = e.where(F.col("name") % 11 != 0).select("name", changed.alias("values"))
    return readers.tensor_differences(e, copy).withColumnRenamed("name", "vec_id")


IDS = tk.layout(256)


@query(f"SELECT doc_id, CAST(least(n_chars % 600 + 5, {tk.TEXT_CONTEXT}) AS INT) AS n, CAST(CASE WHEN n_chars % 600 + 5 <= {tk.TEXT_CONTEXT} THEN {IDS['eot']} ELSE {tk.TEXT_CONTEXT} - 4 END AS INT) AS last FROM documents")
def truncated_targets(spark, sf_dir):
    """Target sequences cut to the text context: long ones lose their end."""
    d = s.table(spark, sf_dir, "documents")
    n = (F.col("n_chars") % 600).cast("int")
    body = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    target = tk.target_sequence(F.lit("en"), F.lit("transcribe"), body, IDS, longest=tk.TEXT_CONTEXT)
    return d.select("doc_id", F.size(target).alias("n"), F.element_at(target, -1).alias("last"))


@query("SELECT lang || '_' || source AS folder, CASE WHEN lang = '' THEN NULL ELSE lang END AS code, count(*) AS n FROM documents WHERE lang <> '' AND source IS NOT NULL GROUP BY ALL")
def evaluation_languages(spark, sf_dir):
    """Documents by evaluation folder and its language; a folder without one is an error."""
    d = s.table(spark, sf_dir, "documents").where("lang <> ''").select(F.concat("lang", F.lit("_"), "source").alias("folder")).where("folder IS NOT NULL")
    return d.groupBy("folder").agg(F.count("*").alias("n")).select("folder", curate.checkpoint_language(F.col("folder"), strict=True).alias("code"), "n")
