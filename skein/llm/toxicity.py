"""Toxicity by cumulative-link ordinal regression.

Severity grades are ordered: 0 not toxic, 1 toxic, 2 toxic and of low quality.
P(grade >= k) = sigmoid(w.x - cut_k): the thresholds share the weights w of
sparse text features, so severity is one scale. x counts a document's distinct
words that have a feature: the word itself, its prefixes and its suffixes.
Reported are the expected grade and the grade's probabilities.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util

U64 = np.uint64
GRADE_SQL = "CASE WHEN toxic = 0 THEN 0 WHEN toxic = 1 AND quality = 0 THEN 2 WHEN toxic = 1 THEN 1 END"
GRADES = 3
#: Labelled rows fitted on, of each grade at most; rows stand for their grade's share.
SAMPLE_OF_GRADE = (3000, 1000, 1000)
DIMS = 1 << 20
#: Distinct words read of a document that is fitted on, at most: those of the smallest hashes. Scoring reads all.
SAMPLE_WORDS = 4000
#: Features kept: those whose presence differs between toxic and other rows by so many standard errors.
LEAST_Z, MAX_FEATURES = 2.5, 20_000
STEPS, RIDGE = 300, 1e-4
#: A document is toxic from this P(grade >= 1): toxic ones are a tenth of the rows, and missing one costs more.
TOXIC_FROM = 0.25
AFFIXES = (("^", 3), ("^", 4), ("^", 5), ("$", 3), ("$", 4))
WORD = re.compile(r"\w+")


def word_features(words: list) -> np.ndarray:
    """Feature numbers, a row for each word; 0 (never a feature) where a word is too short for an affix."""
    out = [util.hash_words(words)]
    for k, (kind, n) in enumerate(AFFIXES):
        h = util.hash_words([w[:n] if kind == "^" else w[-n:] for w in words]) + U64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
        out.append(np.where(np.fromiter(map(len, words), np.int64, len(words)) >= n, h, 0))
    h = np.stack(out, axis=1) if words else np.empty((0, 1 + len(AFFIXES)), U64)
    return np.where(h == 0, 0, 1 + util.mix(h) % U64(DIMS - 1)).astype(np.int64)


def _words(batches, size: int = 4 << 20):
    """(ids, document of each distinct word, its number, the words) of slices of a batch."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        a = held = 0
        for b, t in enumerate(texts):
            held += len(t or "")
            if held < size and b + 1 < len(texts):
                continue
            lists = [WORD.findall(t.lower()) if t else [] for t in texts[a : b + 1]]
            flat = [w for x in lists for w in x]
            codes, names = pd.factorize(np.array(flat, dtype=object)) if flat else (np.empty(0, np.int64), [])
            doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            pairs = np.unique(doc * max(1, len(names)) + codes)
            yield a, b + 1, batch, ids[a : b + 1], pairs // max(1, len(names)), pairs % max(1, len(names)), list(names)
            a, held = b + 1, 0


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights by feature number and rising cuts."""

    weights: np.ndarray
    cuts: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return _sigmoid(score[:, None] - self.cuts[None, :])


def fit_rows(rows: list, share: np.ndarray) -> Model:
    """rows: (grade, feature numbers with repeats); share: what a row of each grade stands for."""
    y = np.array([g for g, _ in rows], np.int64)
    weights = np.zeros(DIMS, np.float32)
    if len(np.unique(y)) < 2:
        return Model(weights, np.where(np.arange(1, GRADES) <= (y[0] if len(y) else 0), -40.0, 40.0))
    one, n1, n0 = y > 0, max(1, (y > 0).sum()), max(1, (y == 0).sum())
    # row by row, so that no array holds all features of all rows
    counted, present = [], np.zeros((2, DIMS))
    for toxic, (_, found) in zip(one, rows):
        u, c = np.unique(found, return_counts=True)
        counted.append((u.astype(np.int32), c.astype(np.int32)))
        present[int(toxic), u] += 1
    p1, p0 = (present[1] + 0.5) / (n1 + 1), (present[0] + 0.5) / (n0 + 1)
    pooled = (p1 * n1 + p0 * n0) / (n1 + n0)
    z = np.abs(p1 - p0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    z[0] = 0
    kept = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    kept = np.sort(kept[z[kept] >= LEAST_Z])
    number = np.full(DIMS, -1)
    number[kept] = np.arange(len(kept))
    cells = [(np.full((number[u] >= 0).sum(), k), number[u[number[u] >= 0]], c[number[u] >= 0]) for k, (u, c) in enumerate(counted)]
    d, f, x = (np.concatenate(z) for z in zip(*cells))
    del counted, cells, present
    w, v = np.zeros(len(kept)), share[y] / share[y].sum()
    base = np.clip(np.array([v[y >= k].sum() for k in range(1, GRADES)]), 1e-4, 1 - 1e-4)
    cuts = -np.log(base / (1 - base))
    # Adam over the weights, the first cut and the logs of the gaps between cuts
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
    theta = np.concatenate([w, cuts[:1], gaps])
    m, s, nw = np.zeros_like(theta), np.zeros_like(theta), len(w)
    for step in range(1, STEPS + 1):
        w, gaps = theta[:nw], np.exp(theta[nw + 1 :])
        cuts = theta[nw] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(d, w[f] * x, len(y))
        # P(y) = F(y) - F(y + 1) with F(k) = P(grade >= k)
        p = np.concatenate([np.ones((len(y), 1)), _sigmoid(score[:, None] - cuts), np.zeros((len(y), 1))], axis=1)
        slope = p * (1 - p)
        like = np.maximum(p[np.arange(len(y)), y] - p[np.arange(len(y)), y + 1], 1e-9)
        up, down = slope[np.arange(len(y)), y] / like * v, slope[np.arange(len(y)), y + 1] / like * v
        g_score = down - up
        g_cut = np.array([up[y == k].sum() - down[y == k - 1].sum() for k in range(1, GRADES)])
        g_gap = np.array([g_cut[k + 1 :].sum() for k in range(len(gaps))]) * gaps
        grad = np.concatenate([np.bincount(f, g_score[d] * x, nw) + RIDGE * w, [g_cut.sum()], g_gap])
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    weights[kept] = theta[:nw]
    return Model(weights, theta[nw] + np.concatenate([[0], np.cumsum(np.exp(theta[nw + 1 :]))]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_sql: str = GRADE_SQL) -> Model:
    """Fits on a sample of labelled rows bounded by SAMPLE_OF_GRADE, drawn by a
    hash of the id, and on at most SAMPLE_WORDS words of each. Rows without a grade,
    an id or a text are not drawn; of an id's contradictory grades the most severe
    counts; of rows that share an id, each is a document with its grade."""
    spark = docs.sparkSession
    graded = labels.select(F.col(id_col).cast("long").alias("__id"), F.expr(grade_sql).alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL")
    graded = graded.groupBy("__id").agg(F.max("__y").alias("__y"))
    n = dict(map(tuple, graded.groupBy("__y").agg(F.count("*")).collect()))
    if not n:
        return fit_rows([], np.ones(GRADES))
    drawn = graded.withColumn("__r", F.pmod(F.xxhash64(F.col("__id"), F.lit(11)), F.lit(1 << 30)))
    limit = [min(1.0, 1.3 * SAMPLE_OF_GRADE[k] / n[k]) if k in n else 0.0 for k in range(GRADES)]
    drawn = drawn.where(" OR ".join(f"(__y = {k} AND __r < {int(x * (1 << 30))})" for k, x in enumerate(limit)))
    # at most 1.3 times the sample, give or take chance; then cut to the sample
    few = drawn.select("__id", "__y", "__r").toPandas().sort_values(["__r", "__id"])
    few = few[few.groupby("__y").cumcount() < few["__y"].map(dict(enumerate(SAMPLE_OF_GRADE)))]
    share = np.array([n.get(k, 0) / max(1, (few["__y"] == k).sum()) for k in range(GRADES)])
    ids = F.broadcast(spark.createDataFrame(few[["__id", "__y"]].astype("int64")))  # as many rows as the sample
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__t")).where("__t IS NOT NULL").join(ids, "__id")

    def features(batches):
        for a, b, batch, _, doc, word, names in _words(batches):
            number = word_features(names)
            y = batch.column(2).slice(a, b - a).to_pylist()
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            own = [word[cut[k] : cut[k + 1]] for k in range(b - a)]
            found = [number[w if len(w) <= SAMPLE_WORDS else w[np.argsort(util.hash_words([names[k] for k in w]), kind="stable")[:SAMPLE_WORDS]]].ravel() for w in own]
            yield pa.record_batch([pa.array(y, pa.int64()), pa.array([f[f > 0].astype(np.int32).tobytes() for f in found], pa.binary())], names=["y", "f"])

    got = rows.select("__id", "__t", "__y").mapInArrow(util.lean(features), "y long, f binary").toArrow()
    return fit_rows(sorted(zip(got.column(0).to_pylist(), (np.frombuffer(f, np.int32) for f in got.column(1).to_pylist())), key=lambda r: (r[0], r[1].tobytes())), share)


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, p_toxic, p_severe, grade, toxic) for every row: the expected
    grade, P(grade >= 1), P(grade >= 2), the likeliest grade, and whether P(grade >= 1)
    is above TOXIC_FROM.

    Whole texts are read. Null and empty texts have no features and get the
    score of a document without any; rows without labels are scored like others;
    repeated rows score alike; empty tables give empty results.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))

    def score(batches):
        model = Model(*held.value)
        for a, b, _, ids, doc, word, names in _words(batches):
            weight = model.weights[word_features(names)]
            weight = weight.sum(axis=1, dtype=np.float64) if len(names) else np.empty(0)
            p = model.probabilities(np.bincount(doc, weight[word], b - a))
            each = -np.diff(np.concatenate([np.ones((b - a, 1)), p, np.zeros((b - a, 1))], axis=1), axis=1)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, -1]), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] > TOXIC_FROM)], names=["id", "severity", "p_toxic", "p_severe", "grade", "toxic"])

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(util.lean(score), "id long, severity double, p_toxic double, p_severe double, grade int, toxic boolean").withColumnRenamed("id", id_col)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's severity, by a model fitted on the labelled ones."""
    util.bounded_batches(spark)
    docs = util.spread(util.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return severity(docs, fit(docs, util.table(spark, sf_dir, "labels")))


QUERIES = {"op8_toxicity": op8_toxicity}
