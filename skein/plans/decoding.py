"""Queries over logits and tokens that a decoder would meet: language, no-speech,
rules, sampling, assembly, augmentation, encoding."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType

from ..functions import evidence as ev
from ..functions import model as md
from ..functions import tokens as tk
from ..functions.evidence import Greedy, Specials, XorShift, choose, sample, timestamp_rules
from ..functions.evidence import paired_segments as segments_by_pairs
from ..functions.signal import N_FRAMES, augment
from ..sources import readers
from . import surrogates as s

QUERIES, SQL = {}, {}
#: In a vector read as logits: text below 40, end, start, controls, then timestamps.
SPECIALS = Specials(eot=40, sot=41, timestamp_begin=48)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT vec_id, ['en', 'de', 'fr', 'es'][list_position(embedding[43:46], list_max(embedding[43:46]))] AS language, exp(embedding[48]::DOUBLE - list_max(embedding)::DOUBLE) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))) AS no_speech FROM embeddings")
def window_language(spark, sf_dir):
    """Language and no-speech probability of each window from the start token's logits."""
    e, v = s.table(spark, sf_dir, "embeddings"), F.col("embedding")
    run = F.slice(v, 43, len(tk.LANGUAGES))
    langs = F.array(*[F.lit(c) for c in tk.LANGUAGES])
    top = F.array_max(v).cast("double")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))
    return e.select("vec_id", F.get(langs, ev.argmax_first(run)).alias("language"), (F.exp(F.get(v, F.lit(47)).cast("double") - top) / total).alias("no_speech"))


@query("""WITH t AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS pos, unnest(list_transform(embedding, lambda x: CAST(floor(abs(x) * 1000) AS INT) % 26)) AS id FROM embeddings)
SELECT vec_id, string_agg(chr(97 + id), '' ORDER BY pos) AS text FROM t GROUP BY vec_id""")
def token_bytes(spark, sf_dir):
    """Token ids to text by a join with the vocabulary, put together in order."""
    vocab = spark.range(26).select(F.col("id").cast("int").alias("id"), F.char(F.col("id") + 97).alias("unit"))
    ids = F.transform("embedding", lambda x: (F.floor(F.abs(x) * F.lit(1000).cast("float")) % 26).cast("int"))
    rows = s.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(ids).alias("pos", "id"))
    joined = rows.join(F.broadcast(vocab), "id")  # a vocabulary: its size is fixed
    ordered = F.array_sort(F.collect_list(F.struct("pos", "unit")))
    return joined.groupBy("vec_id").agg(F.array_join(F.transform(ordered, lambda x: x["unit"]), "").alias("text"))


@query("SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w IN ('the', 'of', 'and', 'und', 'der', 'de', 'que') GROUP BY w")
def keyword_union(spark, sf_dir):
    """Counts of the words of two keyword sets put together."""
    keys = F.array_union(F.array(*[F.lit(w) for w in ("the", "of", "and", "de")]), F.array(*[F.lit(w) for w in ("und", "der", "de", "que")]))
    words = s.table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("w"))
    return words.where(F.array_contains(keys, F.col("w"))).groupBy("w").agg(F.count("*").alias("n"))


def _per_row(kind, f):
    """A vectorized function over (key, logits)."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, logits in batches:
            yield pd.Series([f(int(k), np.asarray(z, np.float64)) for k, z in zip(key, logits)])

    return run


# The seeded draw of the other engine: one step of the generator in 128-bit numbers.
DRAW = """x0 AS (SELECT vec_id, embedding, (vec_id | 1)::UHUGEINT AS x FROM embeddings), x1 AS (SELECT vec_id, embedding, xor(x, x >> 12) AS x FROM x0),
x2 AS (SELECT vec_id, embedding, xor(x, (x << 25) & 18446744073709551615::UHUGEINT) AS x FROM x1), x3 AS (SELECT vec_id, embedding, xor(x, x >> 27) AS x FROM x2),
drawn AS (SELECT vec_id, embedding, (((x * 2685821657736338717::UHUGEINT) & 18446744073709551615::UHUGEINT) >> 40)::DOUBLE / 16777216 AS draw FROM x3)"""


@query(f"""WITH {DRAW}, p AS (SELECT vec_id, draw, unnest(range(len(embedding))) AS pos, unnest(list_transform(embedding, lambda x: exp((x::DOUBLE - list_max(embedding)::DOUBLE) / 0.7::DOUBLE))) AS p FROM drawn),
r AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY pos) / sum(p) OVER (PARTITION BY vec_id) AS run FROM p)
SELECT vec_id, coalesce(min(CASE WHEN draw < run THEN pos END), arg_max(pos, (p, pos))) AS token FROM r GROUP BY vec_id""")
def sampled_tokens(spark, sf_dir):
    """A token drawn from each vector at temperature 0.7, seeded by its id."""
    draw = _per_row(LongType(), lambda k, z: sample(z, 0.7, XorShift(k)))
    return s.table(spark, sf_dir, "embeddings").select("vec_id", draw("vec_id", "embedding").alias("token"))


def _chosen(allowed: str) -> str:
    """SQL: the token chosen among those allowed (by number i): a stamp if stamps weigh more than the best text."""
    p = f"list_transform(embedding, lambda x, k: CASE WHEN {allowed.replace('#', '(k - 1)')} THEN exp(x::DOUBLE) ELSE 0 END)"
    last = "list_max(list_transform({r}, lambda i: CASE WHEN p[i + 1] = list_max(p[{a}:{b}]) THEN i END))"
    text, stamp = last.format(r="range(48)", a=1, b=48), last.format(r="range(48, 64)", a=49, b=64)
    return f"(SELECT CASE WHEN list_sum(p[49:64]) > list_max(p[1:48]) THEN {stamp} ELSE {text} END FROM (SELECT {p} AS p))"


@query(f"SELECT vec_id, {_chosen('# >= 48')} AS first, {_chosen('# <= 40')} AS after_stamp, {_chosen('(# <= 40 OR # >= 49)')} AS after_text, {_chosen('(# = 40 OR # >= 50)')} AS closing FROM embeddings")
def constrained_tokens(spark, sf_dir):
    """The token that the timestamp grammar leaves, after no token, a stamp, a stamp and text, and a stamp that closes."""
    e = s.table(spark, sf_dir, "embeddings")
    names = {"first": [], "after_stamp": [48], "after_text": [48, 5], "closing": [48, 5, 50]}
    rules, pick, sp = timestamp_rules, choose, SPECIALS

    @F.pandas_udf("struct<" + ", ".join(f"{n}: long" for n in names) + ">")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for logits in batches:
            rows = [[pick(rules(np.asarray(z, np.float64), h, sp), sp) for h in names.values()] for z in logits]
            yield pd.DataFrame(rows, columns=list(names))

    return e.select("vec_id", run("embedding").alias("t")).select("vec_id", "t.*")


# The loop as a recursion: logits turned by 7 a token, the grammar's mask from the last two tokens and the largest stamp.
GREEDY = """WITH RECURSIVE g AS (SELECT vec_id, embedding, 0 AS n, []::BIGINT[] AS tokens, false AS done FROM embeddings
  UNION ALL SELECT vec_id, embedding, n + 1, CASE WHEN t = 40 THEN tokens ELSE tokens || [t] END, t = 40 OR n + 2 >= 224 FROM (
    SELECT vec_id, embedding, n, tokens, CASE WHEN list_sum(p[49:64]) > list_max(p[1:48])
        THEN list_max(list_transform(range(48, 64), lambda i: CASE WHEN p[i + 1] = list_max(p[49:64]) THEN i END))
        ELSE list_max(list_transform(range(48), lambda i: CASE WHEN p[i + 1] = list_max(p[1:48]) THEN i END)) END AS t
    FROM (SELECT *, list_transform(range(64), lambda i: CASE WHEN CASE WHEN n = 0 THEN i >= 48
          WHEN last AND before THEN i <= 40
          WHEN last THEN i = 40 OR i >= top
          ELSE i <= 40 OR (i >= 48 AND i > top) END THEN exp(embedding[(i - 7 * n) % 64 + 1 + CASE WHEN (i - 7 * n) % 64 < 0 THEN 64 ELSE 0 END]::DOUBLE * 8) ELSE 0 END) AS p
      FROM (SELECT *, tokens[-1] >= 48 AS last, n < 2 OR tokens[-2] >= 48 AS before, coalesce(list_max(list_filter(tokens, lambda x: x >= 48)), -1) AS top FROM g WHERE NOT done))))
SELECT vec_id, CAST(arg_max(tokens, n) AS INT[]) AS tokens FROM g GROUP BY vec_id"""


@query(GREEDY)
def greedy_tokens(spark, sf_dir):
    """Sequences from a decoding loop whose logits are each vector turned by the tokens so far."""

    def decode(k, z):
        step = lambda prefix, tokens: np.roll(z, 7 * len(tokens)) * 8
        return Greedy(step, SPECIALS).run([41])[0]

    return s.table(spark, sf_dir, "embeddings").select("vec_id", _per_row(ArrayType(IntegerType()), decode)("vec_id", "embedding").alias("tokens"))


@query(f"""WITH {s.TOKEN_ROWS_SQL}, l AS (SELECT conv_id, list(token ORDER BY pos) AS t FROM tokens GROUP BY conv_id),
a AS (SELECT conv_id, t, list_filter(list_transform(t, lambda x, i: CASE WHEN x >= 1000 THEN i END), lambda i: i IS NOT NULL) AS stamps FROM l),
k AS (SELECT conv_id, t, stamps, unnest(range(len(stamps) // 2)) AS segment FROM a WHERE len(stamps) >= 2)
SELECT conv_id, CAST(segment AS INT) AS segment, least((t[stamps[2 * segment + 1]] - 1000) * 0.02::DOUBLE, 30) AS start, least((t[stamps[2 * segment + 2]] - 1000) * 0.02::DOUBLE, 30) AS "end", CAST(len(list_filter(t[stamps[2 * segment + 1] + 1:stamps[2 * segment + 2] - 1], lambda x: x < 1000)) AS INT) AS n FROM k
UNION ALL SELECT conv_id, 0, 0, 30, CAST(len(list_filter(t, lambda x: x < 1000)) AS INT) FROM a WHERE len(stamps) < 2""")
def paired_segments(spark, sf_dir):
    """Segments of each conversation's tokens by pairs of stamps: the research form."""
    rows = s.token_rows(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(c, n, a, e, len(x)) for c, t in zip(pdf["conv_id"], pdf["t"]) for n, (a, e, x) in enumerate(segments_by_pairs(list(t), 1000, 1000, 30.0))]
            yield pd.DataFrame(out, columns=["conv_id", "segment", "start", "end", "n"])

    return rows.mapInPandas(run, "conv_id long, segment int, start double, end double, n int")


def _waves(spark, sf_dir):
    e = s.table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    return e.select(F.col("user_id").cast("string").alias("utt_id"), F.transform("x", lambda r: (r["value"] / 1000).cast("float")).alias("wave"))


@query()
def augmented_waves(spark, sf_dir):
    """Each user's signal with gain, noise, speed and reverb drawn by its key."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, wave in batches:
            yield pd.Series([augment(np.asarray(w, np.float32), k) for k, w in zip(key, wave)])

    return _waves(spark, sf_dir).select("utt_id", F.size("wave").alias("before"), F.size(run("utt_id", "wave")).alias("after"))


@query()
def encoder_states(spark, sf_dir):
    """Mean encoder states of each user's signal, whole windows of 30 seconds, by a small model with seeded random weights."""
    return md.encoded(_waves(spark, sf_dir), md.Sizes(audio_context=N_FRAMES // 2))


@query()
def tokenizer_export(spark, sf_dir):
    """Entries of the exported tokenizer, trained on all turns."""
    turns = s.table(spark, sf_dir, "conversations").select("text", F.lit("").alias("translation"))
    data = json.loads(tk.tokenizer_json(tk.trained(spark, turns, 400)))
    rows = [(i, t) for t, i in data["model"]["vocab"].items()] + [(a["id"], a["content"]) for a in data["added_tokens"]]
    return spark.createDataFrame(rows, "id int, content string")


@query("SELECT printf('[%.2f --> %.2f] (%s, %.2f, %.2f) %s', turn * 1.0::DOUBLE, turn + 1.0::DOUBLE, role, -0.5::DOUBLE, 0.25::DOUBLE, text) AS line FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL")
def console_lines(spark, sf_dir):
    """Turns as the lines a console shows for segments."""
    c = s.table(spark, sf_dir, "conversations").where("text IS NOT NULL AND role IS NOT NULL")
    at = F.col("turn").cast("double")
    segs = c.select(at.alias("start"), (at + 1).alias("end"), F.col("role").alias("language"), F.lit(-0.5).alias("avg_logprob"), F.lit(0.25).alias("no_speech_prob"), "text")
    return readers.console_lines(segs)
