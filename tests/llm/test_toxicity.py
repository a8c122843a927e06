import numpy as np

from skein.llm import toxicity as tx
from skein.llm import util


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs = util.table(spark, d, "documents").select("doc_id", "text")
    labels = util.table(spark, d, "labels")
    model = tx.fit(docs, labels.where("doc_id % 3 <> 0"))
    truth = labels.where("doc_id % 3 = 0").select("doc_id", util.F.col("toxic").alias("t"))
    held = tx.severity(docs, model).join(truth, "doc_id").select("toxic", "t", "severity").toPandas()
    hit, miss = held[held.t == 1], held[held.t == 0]
    # a few documents of this table are labelled toxic but hold only repeats or junk
    assert hit.toxic.mean() > 0.85 and miss.toxic.mean() < 0.01
    assert hit.severity.mean() > miss.severity.mean() + 0.8


def test_gradient_recovers_order():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(900):
        y = int(rng.integers(3))
        f = rng.integers(100, 400, 20)
        rows.append((y, np.array([*f, *[7] * y, *[9] * (rng.random() < 0.5)], np.int64)))
    model = tx.fit_rows(rows, np.ones(3))
    assert model.weights[7] > 1 and np.all(np.diff(model.cuts) > 0)
    score = np.array([model.weights[f].sum() for _, f in rows])
    p = model.probabilities(score)
    assert np.all(np.diff(p, axis=1) <= 0)
    grade = (p > 0.5).sum(axis=1)
    assert np.mean(grade == [y for y, _ in rows]) > 0.9


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (3, "x " * 50000), (3, "x " * 50000), (4, "!!!")], "doc_id long, text string").withColumn("severity", util.F.lit("a"))
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 0), (3, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int").withColumn("toxic2", util.F.lit(1))
    model = tx.fit(docs, labels)
    assert tx.severity(docs, model).count() == 6
    # contradictory grades: the most severe one counts, in whatever order the rows come
    twice = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(1, "bad words here"), (2, "fine words here")], "doc_id long, text string")
    models = [tx.fit(few, t) for t in (twice, twice.orderBy("toxic"), twice.where("doc_id = 2 OR toxic = 1"))]
    assert all(np.array_equal(m.weights, models[0].weights) and np.array_equal(m.cuts, models[0].cuts) for m in models)
    assert all(not r.toxic for r in tx.severity(docs, tx.fit(docs, labels.where("false"))).collect())
    assert tx.severity(docs.where("false"), model).count() == 0
