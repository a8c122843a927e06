"""Sources and sinks: transcripts, tab-separated references, audio, manifests, shards.

Whether an utterance without audio is skipped or an error is a parameter:
preparation skips, evaluation refuses.
"""

from __future__ import annotations

import io
import wave as wavefile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

SHARD_ROWS = 2048


class MissingInput(ValueError):
    """A corpus that isn't complete."""


def _refuse(bad: DataFrame, column: str, what: str) -> None:
    rows = bad.select(column).take(3)
    if rows:
        raise MissingInput(f"{what}: {', '.join(str(r[0]) for r in rows)}")


def utterance_id(*parts) -> Column:
    """First 16 hex digits of the SHA-1 of the parts."""
    return F.substring(F.sha1(F.concat(*parts)), 1, 16)


def _plain(path: Column) -> Column:
    """One spelling of local paths, which have no scheme, or one with a slash or three."""
    return F.regexp_replace(path, "^file:/+", "/")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def audio_listing(spark: SparkSession, root: str, glob: str = "*.wav") -> DataFrame:
    """(audio_path, duration) from audio headers; only the first bytes are parsed, one row a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "content")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, seconds = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    with wavefile.open(io.BytesIO(content.as_py())) as w:
                        seconds.append(w.getnframes() / w.getframerate())
                except (wavefile.Error, EOFError, ZeroDivisionError):
                    continue
                paths.append(path)
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(seconds, pa.float64())], names=["audio_path", "duration"])

    return files.mapInArrow(headers, "audio_path string, duration double")


def with_audio(rows: DataFrame, audio: DataFrame, on_missing: str = "skip") -> DataFrame:
    """rows with their audio's duration: unmatched rows go, or are an error."""
    rows, audio = (df.withColumn("audio_path", _plain(F.col("audio_path"))) for df in (rows, audio))
    if on_missing == "error":
        _refuse(rows.join(audio, "audio_path", "left_anti"), "audio_path", "no audio for")
    return rows.join(audio, "audio_path")


def scan_transcripts(spark: SparkSession, root: str, source: str, language: str, audio: DataFrame, on_missing: str = "skip", extension: str = ".wav", pattern: str = "*.trans.txt") -> DataFrame:
    """Transcript files, by default *.trans.txt: lines "id text"; the id begins with the speaker."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root).select("value", F.col("_metadata.file_path").alias("file"))
    parts = F.split("value", " ", 2)
    if on_missing == "error":
        _refuse(lines.where(F.size(parts) < 2), "file", "a line without an id and a text in")
    rows = lines.where(F.size(parts) == 2).select(parts[0].alias("id"), parts[1].alias("raw"), "file")
    rows = rows.select("*", F.concat(_folder(F.col("file")), F.lit("/"), "id", F.lit(extension)).alias("audio_path"))
    out = with_audio(rows, audio, on_missing)
    return _manifest(out, source, language, "transcribe", F.lower("raw"), F.split("id", "-")[0], F.col("id"))


def scan_tab_transcripts(spark: SparkSession, root: str, source: str, language: str, audio: DataFrame, extension: str = ".wav") -> DataFrame:
    """train/transcripts.txt: lines "speaker_book_seq<TAB>text"; case is kept, unmatched rows go."""
    lines = spark.read.text(f"{root}/train/transcripts.txt")
    parts = F.split("value", "\t", 2)
    ids = F.split(parts[0], "_")
    rows = lines.where((F.size(parts) == 2) & (F.size(ids) == 3)).select(parts[0].alias("id"), parts[1].alias("raw"), ids[0].alias("speaker"), ids[1].alias("book"))
    rows = rows.withColumn("audio_path", F.concat(F.lit(f"{root}/train/audio/"), "speaker", F.lit("/"), "book", F.lit("/"), "id", F.lit(extension)))
    out = with_audio(rows, audio)
    return _manifest(out, source, language, "transcribe", F.col("raw"), F.col("speaker"), F.col("id"))


def scan_translations(spark: SparkSession, tsv: str, clips: str, source: str, language: str, audio: DataFrame, nan_text: bool = False) -> DataFrame:
    """A headed TSV of path, sentence, translation and perhaps client_id; without a
    translation column there are no rows. nan_text: empty cells read "nan"."""
    table = spark.read.csv(tsv, sep="\t", header=True, quote="", mode="DROPMALFORMED")
    if "translation" not in table.columns:
        return spark.createDataFrame([], schemas.MANIFEST)
    blank = F.lit("nan" if nan_text else "")
    cell = lambda c: F.coalesce(F.col(c), blank)
    speaker = cell("client_id") if "client_id" in table.columns else F.lit("")
    rows = table.select(F.col("path").alias("id"), cell("sentence").alias("raw"), cell("translation").alias("translation"), speaker.alias("speaker"), F.concat(F.lit(clips + "/"), "path").alias("audio_path"))
    return _manifest(with_audio(rows, audio), source, language, "translate", F.col("raw"), F.col("speaker"), F.col("id"), F.col("translation"))


def _manifest(rows: DataFrame, source: str, language: str, task: str, text, speaker, key, translation=None) -> DataFrame:
    columns = {"utt_id": utterance_id(F.lit(source), key), "audio_path": F.col("audio_path"), "text": text, "language": F.lit(language), "task": F.lit(task), "duration": F.col("duration"), "source": F.lit(source), "speaker": speaker, "translation": F.lit("") if translation is None else translation}
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def scan_references(spark: SparkSession, tsv: str, audio_root: str, audio: DataFrame | None = None) -> DataFrame:
    """test.tsv without a header: (wav, reference) from columns 1 and 3, by path; short lines and missing audio are errors."""
    lines = spark.read.text(tsv).where(F.trim("value") != "")
    cells = F.split("value", "\t")
    _refuse(lines.where(F.size(cells) < 4), "value", "fewer than four columns")
    rows = lines.select(F.concat(F.lit(audio_root + "/"), cells[1]).alias("wav"), cells[3].alias("reference"))
    if audio is not None:
        have = audio.select(_plain(F.col("audio_path")).alias("key"))
        _refuse(rows.withColumn("key", _plain(F.col("wav"))).join(have, "key", "left_anti"), "wav", "no audio for")
    return rows.orderBy(F.split("wav", "/"))


def read_waves(spark: SparkSession, root: str, glob: str = "*.wav") -> DataFrame:
    """(path, wave): mono at 16 kHz, by linear interpolation; unreadable files have null waves."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "content"))


def decoded(files: DataFrame) -> DataFrame:
    """(path, wave) of audio files (path, content)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    samples = wave_samples(content.as_py())
                except (wavefile.Error, EOFError, ValueError):
                    samples = None
                yield pa.record_batch([pa.array([path]), pa.array([samples], pa.list_(pa.float32()))], names=["path", "wave"])

    return files.mapInArrow(decode, "path string, wave array<float>")


def wave_samples(content: bytes, rate: int = 16_000) -> np.ndarray:
    with wavefile.open(io.BytesIO(content)) as w:
        width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
    x = x.reshape(-1, channels).mean(axis=1)
    if own == rate or not len(x):
        return x.astype(np.float32)
    at = np.arange(int(len(x) * rate / own)) * (own / rate)
    return np.interp(at, np.arange(len(x)), x).astype(np.float32)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(*schemas.MANIFEST.names).write.mode("overwrite").json(path)


def sharded(rows: DataFrame, seq: str = "seq", size: int = SHARD_ROWS, *by: str) -> DataFrame:
    """rows with shard and pos: `size` rows a shard in the order of seq, numbered within `by`."""
    from ..operators.order import ranked

    out = ranked(rows, seq, *by)
    return out.withColumn("shard", F.floor((F.col("rank") - 1) / size)).withColumn("pos", (F.col("rank") - 1) % size).drop("rank")


def write_shards(rows: DataFrame, path: str, split: str = "split") -> None:
    """Parquet by split and language, so reads of one prune the others; 2,048 rows a file at most."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", SHARD_ROWS).partitionBy(split, "language").parquet(path)


def write_hypotheses(rows: DataFrame, path: str, header: bool) -> None:
    """Tab-separated; tabs and line breaks within a cell become spaces."""
    clean = rows.select(*[F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\r\n", "   ").alias(c) for c in rows.columns])
    write_table(clean, path, header)


def write_table(cells: DataFrame, path: str, header: bool) -> None:
    """Tab-separated, unquoted; cells hold no tabs and keep their outer spaces."""
    cells.write.mode("overwrite").csv(path, sep="\t", header=header, quote="", escape="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, token) of the vocabulary and (id, content) of the added tokens; missing special tokens are an error."""
    schema = "model struct<vocab: map<string, int>, merges: array<string>>, added_tokens array<struct<id: int, content: string>>"
    table = spark.read.schema(schema).json(path, multiLine=True)
    vocab = table.select(F.explode("model.vocab").alias("token", "id")).select("id", "token")
    added = table.select(F.inline("added_tokens"))
    have = {r.content for r in added.where("content NOT RLIKE '^<[|][0-9.]+[|]>$'").collect()}  # a tokenizer's special tokens, a hundred or so
    need = {f"<|{c}|>" for c in ("endoftext", "startoftranscript", "translate", "transcribe", "startoflm", "startofprev", "notimestamps")}
    lacking = sorted(need - have) + ([] if have & {"<|nospeech|>", "<|nocaptions|>"} else ["<|nospeech|>"])
    if lacking:
        raise MissingInput(f"no special token {', '.join(lacking)}")
    return vocab, added


def read_metrics(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(step, key) of the log rows that have the key."""
    return spark.read.schema(schemas.METRICS).json(path).where(F.col(key).isNotNull()).select("step", key)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Adds rows (step, and any of the metrics) to a log."""
    rows.write.mode("append").json(path)


def tensor_differences(own: DataFrame, copy: DataFrame) -> DataFrame:
    """(name, status, diff) of the tensors (name, values) against a copy's: equal, or
    differs by at most diff, or of another shape, or missing from the copy."""
    both = own.join(copy.select("name", F.col("values").alias("__copy")), "name", "left")
    apart = F.zip_with("values", "__copy", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    status = F.when(F.col("__copy").isNull(), "missing").when(F.size("values") != F.size("__copy"), "shape").when(F.col("values") == F.col("__copy"), "equal").otherwise("differs")
    return both.select("name", status.alias("status"), F.when(status.isin("equal", "differs"), F.array_max(apart)).alias("diff"))


def console_lines(segments: DataFrame) -> DataFrame:
    """One printable line a segment, or that there was none."""
    line = F.format_string("[%.2f --> %.2f] (%s, %.2f, %.2f) %s", F.col("start"), F.col("end"), "language", F.col("avg_logprob"), F.col("no_speech_prob"), "text")
    lines = segments.select(line.alias("line"))
    none = segments.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("(no speech detected)").alias("line"))
    return lines.unionByName(none)


def save_tensors(tensors: dict[str, np.ndarray], path: str) -> None:
    """Length of the header (8 bytes, little-endian), header JSON padded to 8 bytes, then the arrays by name."""
    import json
    import struct

    header, at = {}, 0
    for name in sorted(tensors):
        t = np.ascontiguousarray(tensors[name], np.float32)
        header[name] = {"dtype": "F32", "shape": list(t.shape), "data_offsets": [at, at + t.nbytes]}
        at += t.nbytes
    raw = json.dumps(header).encode()
    raw += b" " * (-len(raw) % 8)
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(raw)) + raw)
        for name in sorted(tensors):
            f.write(np.ascontiguousarray(tensors[name], np.float32).tobytes())


def load_tensors(path: str) -> dict[str, np.ndarray]:
    import json
    import struct

    with open(path, "rb") as f:
        raw = f.read()
    (n,) = struct.unpack_from("<Q", raw)
    header, body = json.loads(raw[8 : 8 + n]), raw[8 + n :]
    return {k: np.frombuffer(body[slice(*v["data_offsets"])], np.float32).reshape(v["shape"]) for k, v in header.items() if k != "__metadata__"}
