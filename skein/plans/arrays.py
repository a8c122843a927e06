"""Queries over arrays: tokens, signals, decoding evidence, model tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..functions import signal as sg
from ..functions import tokens as tk
from ..operators import curate, order
from ..functions.signal import log_mel as mel_of
from . import surrogates as s

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


IDS = tk.layout(1000)
LANG_CASE = "CASE lang " + " ".join(f"WHEN '{c}' THEN {IDS[f'lang:{c}']}" for c in tk.LANGUAGES) + " END"


@query("SELECT vec_id, i - 1 AS i, p FROM (SELECT vec_id, unnest(range(1, len(e) + 1)) AS i, unnest(list_transform(e, lambda x: x / list_sum(e))) AS p FROM (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x - list_max(embedding) AS DOUBLE))) AS e FROM embeddings))")
def softmax(spark, sf_dir):
    """Probabilities of every vector read as logits."""
    e = s.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(ev.softmax(F.col("embedding"))).alias("i", "p"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS first_, len(embedding) - list_position(list_reverse(embedding), list_max(embedding)) AS last_ FROM embeddings")
def argmax(spark, sf_dir):
    """Place of the largest value, the first and the last among equals."""
    e = s.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", ev.argmax_first(F.col("embedding")).alias("first_"), ev.argmax_last(F.col("embedding")).alias("last_"))


@query("SELECT vec_id, list_max(embedding) AS hi, list_min(embedding) AS lo, list_max(embedding) - list_min(embedding) AS span, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS mean FROM embeddings")
def array_stats(spark, sf_dir):
    e, v = s.table(spark, sf_dir, "embeddings"), F.col("embedding")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.select("vec_id", F.array_max(v).alias("hi"), F.array_min(v).alias("lo"), (F.array_max(v) - F.array_min(v)).alias("span"), (total / F.size(v)).alias("mean"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: ln(abs(x::DOUBLE) + 1e-3))) / len(embedding) AS avg_logprob FROM embeddings")
def avg_logprob(spark, sf_dir):
    """Mean log of each vector's values as probabilities; the last is the end token's."""
    e = s.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", ev.avg_logprob(F.transform("embedding", lambda x: F.abs(x.cast("double")) + 1e-3)).alias("avg_logprob"))


@query("SELECT l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE NOT (d.n_chars % 100 / 100.0::DOUBLE > 0.6 AND -(d.n_chars % 30) / 10.0::DOUBLE < -1.0)")
def evidence_gate(spark, sf_dir):
    """Rows that are speech by their evidence."""
    rows = s.table(spark, sf_dir, "labels").join(s.table(spark, sf_dir, "documents"), "doc_id")
    return rows.where(~ev.is_silence((F.col("n_chars") % 100) / F.lit(100.0), -(F.col("n_chars") % 30) / F.lit(10.0))).select("doc_id")


@query("SELECT conv_id, turn, trim(text) AS text FROM conversations WHERE trim(text) <> ''")
def nonempty_segments(spark, sf_dir):
    return s.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim("text").alias("text")).where("text <> ''")


@query("""WITH seg AS (SELECT lang, -(n_chars % 30) / 10.0::DOUBLE AS lp, doc_id % 3 AS t FROM documents)
SELECT count(*) AS segments, avg(lp) AS avg_logprob_mean, min(lp) AS avg_logprob_min, CAST(count_if(t > 0) AS BIGINT) AS fallback_segments, CAST(count_if(lp < -1) AS BIGINT) AS low_confidence_segments, (SELECT string_agg(lang, ',' ORDER BY lang) FROM (SELECT DISTINCT lang FROM seg)) AS languages FROM seg""")
def evidence_report(spark, sf_dir):
    d = s.table(spark, sf_dir, "documents")
    return ev.evidence_report(d.select(F.col("lang").alias("language"), (-(F.col("n_chars") % 30) / F.lit(10.0)).alias("avg_logprob"), (F.col("doc_id") % 3).alias("temperature")))


@query("""WITH p AS (SELECT vec_id, i - 1 AS pos, x / sum(x) OVER (PARTITION BY vec_id) AS p, (vec_id % 10) / 10.0::DOUBLE AS draw FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(list_transform(embedding, lambda x: round(abs(x::DOUBLE) * 1000))) AS x FROM embeddings)),
r AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY pos) AS run FROM p)
SELECT vec_id, coalesce(min(CASE WHEN draw < run THEN pos END), arg_max(pos, (p, pos))) AS pick FROM r GROUP BY vec_id""")
def inverse_cdf(spark, sf_dir):
    """The place where a draw falls in each vector's running sum."""
    e = s.table(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", F.posexplode(F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")) * 1000))).alias("pos", "x"))
    total = F.sum("x").over(Window.partitionBy("vec_id"))
    rows = rows.withColumn("p", F.when(total == 0, float("nan")).otherwise(F.col("x") / total)).withColumn("draw", (F.col("vec_id") % 10) / F.lit(10.0))
    return order.inverse_cdf(rows, "vec_id", "draw").select("vec_id", F.col("pick").cast("long").alias("pick"))


@query(f"""WITH {s.TOKEN_ROWS_SQL}, r AS (SELECT *, CASE WHEN token >= 1000 THEN least((token - 1000) * 0.02::DOUBLE, window_seconds) END AS sec FROM tokens),
g AS (SELECT *, count(sec) OVER (PARTITION BY conv_id ORDER BY pos) AS i, last_value(sec IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos) AS f,
  first_value(sec IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS t FROM r),
x AS (SELECT conv_id, i, any_value(f) AS f, any_value(t) AS t, any_value(window_seconds) AS w, any_value("offset") AS o, count(*) AS n FROM g WHERE token < 1000 GROUP BY conv_id, i)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS segment, o + coalesce(f, 0) AS start, o + coalesce(t, w) AS "end", n FROM x""")
def token_segments(spark, sf_dir):
    """Segments of every conversation's token sequence: islands of text between stamps."""
    return ev.segments(s.token_rows(spark, sf_dir), "conv_id", 1000).select("conv_id", "segment", "start", "end", F.size("ids").cast("long").alias("n"))


@query("""WITH a AS (SELECT conv_id, turn AS attempt, -(length(coalesce(text, '')) % 25) / 10.0::DOUBLE AS logprob, (length(coalesce(text, '')) % 35) / 10.0::DOUBLE AS ratio, (conv_id % 10) / 10.0::DOUBLE AS no_speech FROM conversations),
b AS (SELECT *, coalesce(max(CASE WHEN NOT (ratio > 2.4 OR logprob < -1) OR (no_speech > 0.6 AND logprob < -1) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM a)
SELECT conv_id, attempt, logprob, ratio, no_speech FROM b WHERE stopped = 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY ratio > 2.4, CASE WHEN ratio <= 2.4 THEN -logprob END, CASE WHEN ratio <= 2.4 THEN attempt ELSE -attempt END) = 1""")
def temperature_ladder(spark, sf_dir):
    """The attempt that the fallback ladder settles on; a conversation's turns stand for attempts."""
    n = F.length(F.coalesce("text", F.lit("")))
    rows = s.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("attempt"), (-(n % 25) / F.lit(10.0)).alias("logprob"), ((n % 35) / F.lit(10.0)).alias("ratio"), ((F.col("conv_id") % 10) / F.lit(10.0)).alias("no_speech"))
    return ev.ladder(rows, "conv_id")


@query()
def compression_ratio(spark, sf_dir):
    """Bytes over compressed bytes of every turn, and whether it repeats itself."""
    rows = s.table(spark, sf_dir, "conversations").select("conv_id", "turn", ev.compression_ratio("text").alias("ratio"))
    return rows.withColumn("repetitive", F.col("ratio") > ev.REPETITIVE)


@query(f"SELECT doc_id, [{IDS['sot']}, {LANG_CASE}, CASE WHEN doc_id % 4 = 0 THEN {IDS['translate']} ELSE {IDS['transcribe']} END, {IDS['notimestamps']}] || list_transform(regexp_extract_all(text, '[^ ]+'), lambda w: length(w)) || [{IDS['eot']}] AS seq FROM documents".replace(" AS seq", "::VARCHAR AS seq").replace("SELECT doc_id, [", "SELECT doc_id, ([").replace(f"[{IDS['eot']}]::", f"[{IDS['eot']}])::"))
def target_sequences(spark, sf_dir):
    """start, language, task, body, end of every document, with word lengths as the body."""
    d = s.table(spark, sf_dir, "documents")
    body = F.transform(F.regexp_extract_all("text", F.lit("([^ ]+)"), F.lit(1)), lambda w: F.length(w))
    seq = tk.target_sequence(F.col("lang"), F.when(F.col("doc_id") % 4 == 0, "translate").otherwise("transcribe"), body, IDS)
    return d.select("doc_id", F.concat(F.lit("["), F.array_join(seq.cast("array<string>"), ", "), F.lit("]")).alias("seq"))


BEGIN = IDS["timestamp_begin"]


@query(f"""WITH q AS (SELECT conv_id, list(tok ORDER BY turn) AS st FROM (SELECT conv_id, turn, {BEGIN} + length(coalesce(text, '')) % 50 AS tok FROM conversations) GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN 'missing sot' WHEN conv_id % 13 = 0 THEN 'missing language' WHEN conv_id % 17 = 0 THEN 'missing task' WHEN conv_id % 19 = 0 THEN 'missing eot' WHEN len(st) % 2 <> 0 THEN 'unpaired timestamps'
  WHEN len(list_filter(range(1, len(st)), lambda i: st[i + 1] < st[i])) > 0 THEN 'decreasing timestamps' ELSE 'ok' END AS verdict FROM q""")
def grammar_check(spark, sf_dir):
    """What is wrong with each conversation's token sequence, if anything."""
    c = s.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))) % 50 + BEGIN).alias("tok"))
    seqs = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "tok"))), lambda x: x["tok"]).alias("st"))
    bad = lambda k, right: F.when(F.col("conv_id") % k == 0, 0).otherwise(right)
    seq = F.concat(F.array(bad(11, IDS["sot"]), bad(13, IDS["lang:en"]), bad(17, IDS["transcribe"])), F.col("st"), F.array(bad(19, IDS["eot"])))
    return seqs.select("conv_id", tk.grammar_check(seq, IDS).alias("verdict"))


@query(f"SELECT id, content FROM (VALUES ({IDS['eot']}, '<|endoftext|>'), ({IDS['sot']}, '<|startoftranscript|>'), {', '.join(f'''({IDS[f'lang:{c}']}, '<|{c}|>')''' for c in tk.LANGUAGES)}, {', '.join(f'''({IDS[c]}, '<|{c}|>')''' for c in tk.AFTER_LANGUAGES)}) v(id, content) UNION ALL SELECT CAST({BEGIN} + i AS INT), printf('<|%.2f|>', i * 0.02::DOUBLE) FROM range({tk.N_TIMESTAMPS}) t(i)")
def special_tokens(spark, sf_dir):
    return tk.special_tokens(spark, 1000)


@query(f"SELECT CAST(id AS INT) AS id, tag FROM (VALUES {', '.join(f'''({IDS[f'lang:{c}']}, '{c}')''' for c in tk.LANGUAGES)}) v(id, tag)")
def language_tags(spark, sf_dir):
    """The language tokens: those right after the start token."""
    return tk.language_run(tk.special_tokens(spark, 1000))


@query(f"SELECT event_id, CAST({BEGIN} + round_even(abs(value) % 30 / 0.02::DOUBLE, 0) AS INT) AS token FROM events")
def timestamp_tokens(spark, sf_dir):
    """Events' values as seconds, as timestamp tokens."""
    return s.table(spark, sf_dir, "events").select("event_id", tk.timestamp_token(F.abs("value") % 30, IDS).alias("token"))


@query("""WITH t AS (SELECT unnest(range(256)) AS b) SELECT CAST(b AS INT) AS byte, CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 THEN chr(CAST(b AS INT)) ELSE chr(CAST(255 + count_if(NOT (b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255)) OVER (ORDER BY b) AS INT)) END AS unit FROM t""")
def byte_table(spark, sf_dir):
    """The character that stands for each byte."""
    return spark.createDataFrame(list(enumerate(tk.byte_units())), "byte int, unit string")


@query()
def bpe_tokens(spark, sf_dir):
    """Every turn encoded and decoded by a byte-level BPE trained on all turns."""
    turns = s.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    bpe = tk.trained(spark, turns.withColumn("translation", F.lit("")), 400)
    ids = turns.withColumn("ids", tk.encoder(bpe)(tk.pretokens(F.coalesce("text", F.lit("")))))
    return ids.select("conv_id", "turn", F.size("ids").alias("n_tokens"), (tk.decoder(bpe)("ids") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query("""WITH t AS (SELECT conv_id, turn, range(1, length(coalesce(text, '')) % 9 + 1) AS seq FROM conversations), n AS (SELECT conv_id, max(len(seq)) AS n FROM t GROUP BY conv_id)
SELECT conv_id, turn, len(seq) AS real, CAST(n AS BIGINT) AS width FROM t JOIN n USING (conv_id)""")
def padded_batches(spark, sf_dir):
    """Sequences padded to the longest of their batch, with their real lengths from the mask."""
    n = F.length(F.coalesce("text", F.lit(""))) % 9
    rows = s.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")).alias("seq"))
    out = tk.padded(rows, "seq", 0, "conv_id")
    return out.select("conv_id", "turn", F.size(F.filter("mask", lambda m: m)).cast("long").alias("real"), F.size("seq").cast("long").alias("width"))


MEL = "CASE WHEN {m} >= 15 THEN 1000 * exp(({m} - 15) * (ln(6.4::DOUBLE) / 27)) ELSE {m} * 200 / 3 END"
TOP = "(15 + ln(8::DOUBLE) / (ln(6.4::DOUBLE) / 27))"


@query("SELECT event_id, CASE WHEN abs(value) * 10 >= 1000 THEN 15 + ln(abs(value) * 10 / 1000) / (ln(6.4::DOUBLE) / 27) ELSE abs(value) * 10 * 3 / 200 END AS mel FROM events")
def hz_to_mel(spark, sf_dir):
    return s.table(spark, sf_dir, "events").select("event_id", sg.hz_to_mel(F.abs("value") * 10.0).alias("mel"))


BANK = f"""p AS (SELECT i, {MEL.format(m=f"(i::DOUBLE * {TOP} / 81)")} AS hz FROM range(82) t(i)),
bank AS (SELECT CAST(a.i AS INT) AS mel, CAST(f.k AS INT) AS freq, 2 / (c.hz - a.hz) * greatest(least((f.k * 40::DOUBLE - a.hz) / (b.hz - a.hz), (c.hz - f.k * 40::DOUBLE) / (c.hz - b.hz)), 0) AS weight
  FROM p a JOIN p b ON b.i = a.i + 1 JOIN p c ON c.i = a.i + 2, range(201) f(k))"""


@query(f"WITH {BANK} SELECT * FROM bank WHERE weight > 0")
def mel_filterbank(spark, sf_dir):
    """Non-zero cells of the 80-band filterbank."""
    return sg.filterbank_rows(spark)


POWER = "frames AS (SELECT user_id AS frame, CAST(event_id % 201 AS INT) AS freq, sum(value * value) AS power FROM events GROUP BY ALL)"


@query(f"WITH {BANK}, {POWER}, m AS (SELECT frame, mel, log10(greatest(sum(weight * power), 1e-10)) AS v FROM frames JOIN bank USING (freq) WHERE weight > 0 GROUP BY frame, mel) SELECT frame, mel, (greatest(v, max(v) OVER (PARTITION BY frame) - 8) + 4) / 4 AS v FROM m")
def mel_energies(spark, sf_dir):
    """Filterbank times power, as a join and a sum; logs clamped to eight below the largest."""
    e = s.table(spark, sf_dir, "events")
    power = e.groupBy(F.col("user_id").alias("frame"), (F.col("event_id") % 201).cast("int").alias("freq")).agg(F.sum(F.col("value") * F.col("value")).alias("power"))
    bank = sg.filterbank_rows(spark)  # 80 bands of 201 bins at most
    mel = power.join(F.broadcast(bank), "freq").groupBy("frame", "mel").agg(F.log10(F.greatest(F.sum(F.col("weight") * F.col("power")), F.lit(1e-10))).alias("v"))
    top = F.max("v").over(Window.partitionBy("frame"))
    return mel.select("frame", "mel", ((F.greatest(F.col("v"), top - 8) + 4) / 4).alias("v"))


WAVES = "w AS (SELECT user_id, list(value ORDER BY event_id) AS wave FROM events GROUP BY user_id)"


def _waves(spark, sf_dir):
    e = s.table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    return e.select("user_id", F.transform("x", lambda r: r["value"]).alias("wave"))


@query(f"WITH {WAVES}, f AS (SELECT user_id, wave, unnest(range(CAST(floor((len(wave) - 8) / 4) AS BIGINT) + 1)) AS i FROM w WHERE len(wave) >= 8) SELECT user_id, i AS frame, list_sum(wave[i * 4 + 1:i * 4 + 8]) AS total FROM f")
def sliding_frames(spark, sf_dir):
    """Frames of 8 values, 4 apart, of each user's signal."""
    frames = _waves(spark, sf_dir).select("user_id", F.posexplode(sg.frames(F.col("wave"), 8, 4)).alias("frame", "f"))
    return frames.select("user_id", F.col("frame").cast("long").alias("frame"), F.aggregate("f", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {WAVES} SELECT user_id, CAST(floor(len(wave) / 1.5::DOUBLE) AS BIGINT) AS n, list_sum(list_transform(range(CAST(floor(len(wave) / 1.5::DOUBLE) AS BIGINT)), lambda i: CAST(wave[least(CAST(floor(i * 1.5::DOUBLE) AS BIGINT) + 1, len(wave))] + (wave[least(CAST(floor(i * 1.5::DOUBLE) AS BIGINT) + 2, len(wave))] - wave[least(CAST(floor(i * 1.5::DOUBLE) AS BIGINT) + 1, len(wave))]) * (i * 1.5::DOUBLE - floor(i * 1.5::DOUBLE)) AS FLOAT)::DOUBLE)) AS total FROM w")
def resampled(spark, sf_dir):
    """Each user's signal from 24 to 16 kHz by linear interpolation."""
    r = _waves(spark, sf_dir).select("user_id", sg.resampled(F.col("wave"), 24_000).alias("r"))
    return r.select("user_id", F.size("r").cast("long").alias("n"), F.aggregate("r", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@query(f"WITH {WAVES}, g AS (SELECT user_id, wave, list_max(list_transform(wave, lambda x: abs(x))) AS peak FROM w) SELECT user_id, list_max(list_transform(wave, lambda x: abs(CAST(x * (CASE WHEN peak < 1e-8 THEN 1 ELSE least(1, 0.95::DOUBLE / peak) END) AS FLOAT)))) AS peak FROM g")
def peak_normalized(spark, sf_dir):
    """Peaks after scaling down to 0.95."""
    n = _waves(spark, sf_dir).select("user_id", sg.peak_normalized(F.col("wave")).alias("n"))
    return n.select("user_id", F.array_max(F.transform("n", F.abs)).alias("peak"))


@query(f"WITH {WAVES} SELECT user_id, CAST(256 AS BIGINT) AS n, list_sum(wave[1:256]) AS total FROM w")
def pad_or_trim(spark, sf_dir):
    """Signals cut or padded to 256 values."""
    p = _waves(spark, sf_dir).select("user_id", sg.pad_or_trim(F.col("wave"), 256).alias("p"))
    return p.select("user_id", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"""WITH {WAVES}, x AS (SELECT user_id, list_resize([]::FLOAT[], 4000, 0) || list_transform(wave, lambda x: CAST(x / 1000 AS FLOAT)) || list_resize([]::FLOAT[], 4000, 0) AS x FROM w),
f AS (SELECT user_id, i * 160 AS pos, list_sum(list_transform(x[i * 160 + 1:i * 160 + 400], lambda v: v::DOUBLE * v::DOUBLE)) AS e FROM (SELECT user_id, x, unnest(range((len(x) - 400) // 160 + 1)) AS i FROM x)),
v AS (SELECT user_id, min(pos) AS a, max(pos) AS b FROM f WHERE e > 400 * pow(10::DOUBLE, -4.5) GROUP BY user_id)
SELECT x.user_id, CAST(len(x) AS INT) AS before, CAST(CASE WHEN a IS NULL THEN len(x) ELSE least(b + 400 + 800, len(x)) - greatest(a - 640, 0) END AS INT) AS after FROM x LEFT JOIN v USING (user_id)""")
def trimmed_silence(spark, sf_dir):
    """Lengths of each user's signal before and after silence is cut at both ends."""
    tone = F.transform("wave", lambda x: (x / 1000).cast("float"))
    w = _waves(spark, sf_dir).select("user_id", F.concat(F.array_repeat(F.lit(0).cast("float"), 4000), tone, F.array_repeat(F.lit(0).cast("float"), 4000)).alias("wave"))
    return w.select("user_id", F.size("wave").alias("before"), F.size(sg.silence_trimmed("wave")).alias("after"))


# by its function's name, not its module's: what workers run travels by value, and a
# module with functions of Spark's own that have run can't
def _mel_figures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for wave in batches:
        mels = (mel_of(np.asarray(w, np.float32)) for w in wave)
        yield pd.DataFrame([(m.size, m.max(), m.max() - m.min()) for m in mels], columns=["n", "hi", "span"])


@query()
def log_mel(spark, sf_dir):
    """Size, highest value and range of the log-mel spectrogram of each user's signal."""
    run = F.pandas_udf(_mel_figures, "n int, hi float, span float")
    tone = F.transform("wave", lambda x: (x / 1000).cast("float"))
    mel = _waves(spark, sf_dir).select("user_id", run(tone).alias("m"))
    return mel.select("user_id", "m.n", F.round("m.hi", 3).alias("hi"), F.round("m.span", 3).alias("span"))


@query("SELECT CAST(p AS INT) AS pos, CAST(c AS INT) AS channel, CASE WHEN c < 16 THEN sin(p * exp(-(ln(10000::DOUBLE) / 15) * (c % 16))) ELSE cos(p * exp(-(ln(10000::DOUBLE) / 15) * (c % 16))) END AS value FROM range(64) a(p), range(32) b(c)")
def sinusoids(spark, sf_dir):
    return sg.sinusoids(spark, 64, 32)


@query("SELECT CAST(q AS INT) AS q, CAST(k AS INT) AS k, k > q + 5 AS masked FROM range(20) a(q), range(25) b(k)")
def causal_mask(spark, sf_dir):
    """Which of 25 keys 20 new queries after 5 cached ones may not see."""
    return sg.causal_mask(spark, 20, 5)


@query("SELECT event_id, CASE WHEN event_id < 500 THEN 0.001::DOUBLE * event_id / 500 ELSE 0.001::DOUBLE * (0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least(greatest((event_id - 500) / 7500::DOUBLE, 0), 1)))) END AS lr FROM events")
def learning_rate(spark, sf_dir):
    """The schedule's rate at each step."""
    return s.table(spark, sf_dir, "events").select("event_id", sg.learning_rate(F.col("event_id"), 0.001, 500, 8000).alias("lr"))


@query("SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN value END) / greatest(count_if(event_type = 'purchase'), 1) AS loss FROM events GROUP BY user_id".replace("sum(CASE WHEN event_type = 'purchase' THEN value END)", "coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END), 0)"))
def masked_loss(spark, sf_dir):
    """Mean of the values that a mask lets count."""
    real = F.col("event_type") == "purchase"
    total = F.coalesce(F.sum(F.when(real, F.col("value"))), F.lit(0.0))
    return s.table(spark, sf_dir, "events").groupBy("user_id").agg((total / F.greatest(F.count_if(real), F.lit(1))).alias("loss"))


@query("SELECT avg(m) AS dev_loss FROM (SELECT avg(value) AS m FROM events GROUP BY user_id)")
def dev_loss(spark, sf_dir):
    """Mean of batch means."""
    return s.table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m")).agg(F.avg("m").alias("dev_loss"))


@query("SELECT event_id, CASE WHEN value > 0 THEN value END AS lr FROM events WHERE CASE WHEN value > 0 THEN value END IS NOT NULL")
def metric_rows(spark, sf_dir):
    """Log rows that have a key."""
    return s.table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 0, F.col("value")).alias("lr")).where("lr IS NOT NULL")


PARTS = ["encoder.blocks.0.attn.query.weight", "encoder.ln_post.weight", "decoder.blocks.3.cross_attn.out.bias", "decoder.token_embedding.weight", "decoder.positional_embedding", "decoder.ln.bias", "encoder.blocks.1.mlp.0.weight"]


@query("SELECT name, replaced, decay FROM (VALUES " + ", ".join(f"('{n}', '{r}', {str(d).lower()})" for n, r, d in zip(PARTS, ["model.encoder.layers.0.self_attn.q_proj.weight", "model.encoder.layer_norm.weight", "model.decoder.layers.3.encoder_attn.out_proj.bias", "model.decoder.embed_tokens.weight", "model.decoder.embed_positions.weight", "model.decoder.layer_norm.bias", "model.encoder.layers.1.fc1.weight"], [True, False, False, False, False, False, True])) + ") v(name, replaced, decay)")
def parameter_names(spark, sf_dir):
    """Export names of parameters, and which decay."""
    dims = F.when(F.col("name").rlike(r"(bias|ln_post\.weight)$"), 1).otherwise(2)
    return spark.createDataFrame([(n,) for n in PARTS], "name string").select("name", curate.export_name(F.col("name")).alias("replaced"), curate.decays(F.col("name"), dims).alias("decay"))


@query("SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def parameter_report(spark, sf_dir):
    """Totals by name prefix and over all."""
    return s.table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.sum("n_chars").alias("n"))


@query("SELECT CAST(state AS INT) AS state, CAST(layers AS INT) AS layers, CAST(heads AS INT) AS heads, size, state // heads AS head_width FROM (VALUES ('tiny', 384, 4, 6), ('base', 512, 6, 8), ('small', 768, 12, 12), ('medium', 1024, 24, 16), ('large', 1280, 32, 20)) v(size, state, layers, heads)")
def model_sizes(spark, sf_dir):
    """The model's sizes."""
    # fixed values: state width, layers, heads of each size
    sizes = [("tiny", 384, 4, 6), ("base", 512, 6, 8), ("small", 768, 12, 12), ("medium", 1024, 24, 16), ("large", 1280, 32, 20)]
    return spark.createDataFrame(sizes, "size string, state int, layers int, heads int").withColumn("head_width", F.expr("CAST(state div heads AS int)"))


@query("SELECT a.user_id, coalesce(max(a.event_id), 0) AS last_event, CAST(greatest(CASE WHEN max(a.value) > 0 THEN least(CAST(max(a.value) * 16000 AS BIGINT), 480000) ELSE 480000 END, 8000) AS BIGINT) AS advance FROM events a GROUP BY a.user_id".replace("CAST(max(a.value) * 16000 AS BIGINT)", "CAST(floor(max(a.value) * 16000) AS BIGINT)"))
def window_advance(spark, sf_dir):
    """How far the next window starts after each user's last stamp."""
    e = s.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.max("value").alias("v"))
    return e.select("user_id", "last_event", ev.advance(F.col("v")).cast("long").alias("advance"))
