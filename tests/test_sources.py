import json
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import curate, order
from skein.plans import surrogates
from skein.sources import readers, schemas
from skein.streaming import windows


def write_wav(path, samples, rate=16_000, channels=1, width=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes((np.asarray(samples) * (2 ** (8 * width - 1) - 1)).astype(f"<i{width}").tobytes())


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "root" / "12" / "7"
    for k in range(3):
        write_wav(folder / f"12-7-{k:04d}.wav", np.zeros(16_000 * (k + 1)))
    (folder / "12-7.trans.txt").write_text("12-7-0000 HELLO WORLD\n12-7-0001 TWO\n12-7-0009 NO AUDIO\n")
    return f"file://{tmp_path}/root"


def test_transcripts(spark, corpus):
    audio = readers.audio_listing(spark, corpus)
    assert sorted(r.duration for r in audio.collect()) == [1.0, 2.0, 3.0]
    out = readers.scan_transcripts(spark, corpus, "libri", "en", audio)
    rows = {r.text: r for r in out.collect()}
    assert set(rows) == {"hello world", "two"} and out.columns == schemas.MANIFEST.names
    r = rows["hello world"]
    assert (r.duration, r.speaker, r.task, len(r.utt_id)) == (1.0, "12", "transcribe", 16)
    with pytest.raises(readers.MissingInput, match="0009"):
        readers.scan_transcripts(spark, corpus, "libri", "en", audio, on_missing="error")


def test_tab_sources(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "transcripts.txt").write_text("1_2_3\tEin Text\n1_2_4\tohne Ton\nbad\tx\n")
    audio = spark.createDataFrame([(f"{root}/train/audio/1/2/1_2_3.wav", 2.5), (f"{root}/clips/a.wav", 1.0), (f"{root}/w/x.wav", 1.0)], "audio_path string, duration double")
    assert [(r.text, r.duration, r.speaker) for r in readers.scan_tab_transcripts(spark, root, "mls", "de", audio).collect()] == [("Ein Text", 2.5, "1")]
    (tmp_path / "c.tsv").write_text('path\tsentence\ttranslation\tclient_id\na.wav\the said "hi\til dit\tc1\nmissing.wav\tx\ty\tc2\n')
    rows = readers.scan_translations(spark, f"{root}/c.tsv", f"{root}/clips", "cv", "fr", audio).collect()
    assert [(r.text, r.translation, r.speaker, r.task) for r in rows] == [('he said "hi', "il dit", "c1", "translate")]
    (tmp_path / "n.tsv").write_text("path\tsentence\na.wav\tx\n")
    assert readers.scan_translations(spark, f"{root}/n.tsv", f"{root}/clips", "cv", "fr", audio).count() == 0
    (tmp_path / "test.tsv").write_text("1\tx.wav\traw\tthe reference\textra\n\n")
    assert [r.reference for r in readers.scan_references(spark, f"{root}/test.tsv", f"{root}/w", audio).collect()] == ["the reference"]
    (tmp_path / "bad.tsv").write_text("1\tx.wav\n")
    with pytest.raises(readers.MissingInput):
        readers.scan_references(spark, f"{root}/bad.tsv", f"{root}/w")


def test_waves(spark, tmp_path):
    tone = 0.5 * np.sin(2 * np.pi * 440 * np.arange(32_000) / 32_000)
    write_wav(tmp_path / "a.wav", np.repeat(tone, 2), rate=32_000, channels=2)
    (tmp_path / "b.wav").write_bytes(b"not audio")
    rows = {r.path.rsplit("/", 1)[1]: r.wave for r in readers.read_waves(spark, f"file://{tmp_path}").collect()}
    assert rows["b.wav"] is None and len(rows["a.wav"]) == 16_000 and abs(max(rows["a.wav"]) - 0.5) < 0.01


def test_manifest_round_trip(spark, sf_dir, tmp_path):
    rows = surrogates.manifest(spark, sf_dir)
    readers.write_manifest(rows, f"file://{tmp_path}/m")
    back = readers.read_manifest(spark, f"file://{tmp_path}/m")
    assert back.exceptAll(rows.select(*schemas.MANIFEST.names)).count() == 0 and back.count() == rows.count()
    readers.write_shards(order.speaker_split(rows, 1), f"file://{tmp_path}/shards")
    one = spark.read.parquet(f"file://{tmp_path}/shards").where("split = 'train' AND language = 'en'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and one.count() > 0
    readers.write_hypotheses(spark.createDataFrame([("a\tb", None)], "x string, y string").coalesce(1), f"file://{tmp_path}/h", header=True)
    text = [r.value for r in spark.read.text(f"file://{tmp_path}/h").collect()]
    assert text == ["x\ty", "a b\t"]


def test_logs_and_console(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(x) for x in ({"step": 1, "loss": 2.0}, {"step": 2, "dev_loss": 1.5})))
    assert [tuple(r) for r in readers.read_metrics(spark, f"file://{tmp_path}/log.jsonl", "dev_loss").collect()] == [(2, 1.5)]
    segs = spark.createDataFrame([(0.0, 1.25, "en", -0.5, 0.1, "hi")], "start double, end double, language string, avg_logprob double, no_speech_prob double, text string")
    assert readers.console_lines(segs).first().line == "[0.00 --> 1.25] (en, -0.50, 0.10) hi"
    assert readers.console_lines(segs.where("false")).first().line == "(no speech detected)"


def test_tensors(tmp_path):
    t = {"b": np.arange(6).reshape(2, 3).astype(np.float32), "a": np.ones(2, np.float32)}
    readers.save_tensors(t, tmp_path / "t")
    back = readers.load_tensors(tmp_path / "t")
    assert back.keys() == t.keys() and all((back[k] == t[k]).all() for k in t)
    assert int.from_bytes((tmp_path / "t").read_bytes()[:8], "little") % 8 == 0


def test_ranks(spark):
    rng = np.random.default_rng(3)
    ids = rng.permutation(500_000)[:5000].tolist()
    df = spark.createDataFrame([(i, i % 3) for i in ids], "seq long, g long")
    want = {i: k for k, i in enumerate(sorted(ids), 1)}
    assert {r.seq: r["rank"] for r in order.ranked(df, "seq").collect()} == want
    got = order.ranked(df, "seq", "g").collect()
    for g in range(3):
        own = sorted(i for i in ids if i % 3 == g)
        assert {r.seq: r["rank"] for r in got if r.g == g} == {i: k for k, i in enumerate(own, 1)}
    plan = order.ranked(df, "seq")._jdf.queryExecution().executedPlan().toString()
    wide = spark.createDataFrame([(i * 10**12,) for i in ids], "seq long")  # far apart, as numbers of documents are
    assert {r.seq // 10**12: r["rank"] for r in order.ranked(wide, "seq").collect()} == want
    buckets = wide.withColumn("b", order.quantile_bucket(wide, "seq")).groupBy("b").count().collect()
    assert 4 <= len(buckets) <= 8 and max(r["count"] for r in buckets) < 2 * 5000 / 8
    assert "SinglePartition" not in plan
    assert order.ranked(df.where("false"), "seq").count() == 0
    shuffled = [r.seq for r in order.shuffled(df, 5, "seq").orderBy("rank").collect()]
    assert sorted(shuffled) == sorted(ids) and shuffled != sorted(ids)
    assert [r.seq for r in order.every_kth(df, "seq", 1000).orderBy("seq").collect()] == sorted(ids)[::1000]


def test_filters(spark):
    rows = [("ok words here", 1.0), ("x", 1.0), ("ok words here", 0.59), ("ok words here", 0.6), ("a " * 400, 30.1), ("w" * 41, 6.0), ("a b c d e f g h i", 1.0), ("many chars in one", 0.6)]
    df = spark.createDataFrame(rows, "text string, duration double")
    got = df.select(curate.duration_ok(F.col("text"), F.col("duration")).alias("d"), curate.alignment_ok(F.col("text"), F.col("duration")).alias("a")).collect()
    assert [r.d for r in got] == [True, False, False, True, False, True, True, True]
    assert [r.a for r in got] == [True, True, True, True, False, False, False, True]
    score = {"": 1.0, "ALL CAPITALS SHOUTED": 0.5, "1234567 a": 0.5, "see www.x": 1.0, "plain text": 0.0, "HTTP": 0.0}
    out = spark.createDataFrame([(t,) for t in score], "t string").select("t", curate.machine_text_score(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in out} == score
    odd = spark.createDataFrame([(" it’s – “so”  «ok» ",)], "t string").select(curate.clean_text(F.col("t")).alias("c")).first().c
    assert odd == "it's - \"so\" \"ok\""


def test_strict_languages(spark):
    df = spark.createDataFrame([("de_x",), ("yue_hant_hk",), ("_x",)], "f string")
    code = curate.checkpoint_language(F.col("f"), strict=True)
    assert [r.c for r in df.where("f <> '_x'").select(code.alias("c")).collect()] == ["de", "zh"]
    with pytest.raises(Exception, match="no language code in _x"):
        df.select(code.alias("c")).collect()


def test_tensor_differences(spark):
    own = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", [3.0]), ("d", [1.0])], "name string, values array<float>")
    copy = spark.createDataFrame([("a", [1.0, 2.5]), ("b", [1.0]), ("d", [1.0, 1.0]), ("e", [1.0])], "name string, values array<float>")
    got = {tuple(r) for r in readers.tensor_differences(own, copy).collect()}
    assert got == {("a", "differs", 0.5), ("b", "equal", 0.0), ("c", "missing", None), ("d", "shape", None)}


def test_advancing_stream(spark, sf_dir, tmp_path):
    stream = windows.stream_of(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", (F.col("event_id") * 1.0).alias("seconds"), "value")
    kept = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    out = windows.advancing(stream)
    out.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda df, n: kept.extend(df.collect())).start().awaitTermination()
    events = sorted(surrogates.table(spark, sf_dir, "events").select("user_id", "event_id", "value").collect(), key=lambda r: r.event_id)
    want, at, n = set(), {}, {}
    for r in events:
        if r.event_id >= at.get(r.user_id, 0.0):
            n[r.user_id] = n.get(r.user_id, 0) + 1
            at[r.user_id] = r.event_id + min(max(abs(r.value), 0.5), 30.0)
            want.add((r.user_id, r.event_id, n[r.user_id], float(r.event_id)))
    assert {tuple(r) for r in kept} == want


def test_late_rows_are_dropped_and_windows_kept(spark, tmp_path):
    """Append mode: windows past the watermark come out once, a row behind it is not counted."""
    at = lambda h, m: f"2024-01-01 {h:02}:{m:02}:00"
    batches = [[(1, at(1, 5)), (2, at(1, 50))], [(3, at(4, 0))], [(5, at(7, 0))], [(4, at(1, 6)), (6, at(9, 0))], [(7, at(11, 0))]]
    for rows in batches:
        df = spark.createDataFrame(rows, "event_id long, t string").selectExpr("event_id", "cast(t AS timestamp) AS ts", "'x' AS event_type", "1.0D AS value")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    schema = spark.read.parquet(f"{tmp_path}/events").schema
    files = sorted((tmp_path / "events").glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
    for k, f in enumerate(files):  # one file a trigger, in order of time
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/events")
    out = windows.drained(windows.tumbling(stream), f"file://{tmp_path}/sink", "append")
    rows = sorted((str(r.start), r.n) for r in out.collect())
    assert rows[:3] == [(at(1, 0), 2), (at(4, 0), 1), (at(7, 0), 1)] and len(rows) == len(dict(rows)) < 5
    again = windows.drained(windows.tumbling(stream), f"file://{tmp_path}/sink2", "complete")
    assert {str(r.start): r.n for r in again.collect()}[at(11, 0)] == 1
