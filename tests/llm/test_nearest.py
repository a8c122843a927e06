import math
import random

import numpy as np

from skein.llm import nearest as nn
from skein.llm import util


def exact(rows, queries, k=20):
    out = {}
    for qid, q in queries:
        s = sorted(((-float(np.einsum("ij,j->i", np.array([v]), np.array(q))[0]), i) for i, v in rows if i != qid and len(v) == len(q)))
        out[qid] = [(i, -x) for x, i in s[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items() if w])


def test_recall_of_query(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in util.table(spark, d, "embeddings").collect()]
    want = exact(rows, [r for r in rows if r[0] % 20 == 0])
    got = found(nn.op7_nearest(spark, d))
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    score = {(q, i): s for q, w in exact(rows, [r for r in rows if r[0] % 20 == 0], len(rows)).items() for i, s in w}
    assert all(score[q, i] == s for q, g in got.items() for i, s in g)


def test_blocks_norms_ties_and_edges(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(16)]) for i in range(600)]
    rows += [(1000 + i, [1.0] * 16) for i in range(60)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [math.nan] * 16), (2060, [1.0, None] + [0.0] * 14), (None, [1.0] * 16), (2080, [math.inf] * 16), (2100, []), (2120, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", util.F.lit(1))
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.where("vec_id < 2000").collect()]
    want = exact(rows, [r for r in rows if r[0] % 20 == 0])
    old = nn.BLOCK, nn.QUERIES_BLOCK
    nn.BLOCK, nn.QUERIES_BLOCK = 200, 10
    try:
        got = found(nn.nearest(df, df.where("vec_id % 20 = 0")))
    finally:
        nn.BLOCK, nn.QUERIES_BLOCK = old
    assert set(got) == set(want)
    assert recall(got, want) >= 0.9
    assert [i for i, _ in got[1020]][:1] and got[1020] == sorted(got[1020], key=lambda x: (-x[1], x[0]))
    assert nn.nearest(df.where("false"), df).count() == 0
    few = df.where("vec_id < 5")
    assert {q: len(v) for q, v in found(nn.nearest(few, few)).items()} == {i: 4 for i in range(5)}


def test_chi_square():
    x = np.random.default_rng(0).chisquare(8, 200_000)
    for p in (0.5, 0.9, 0.97):
        assert abs((x < nn.chi_square_quantile(p, 8)).mean() - p) < 0.01


def test_boxes_down_the_tree():
    rng = np.random.default_rng(6)
    blocks = np.array([0, 1, 3, 4, 6, 7])
    centre = rng.normal(size=(6, nn.PROJECTED)) * 3
    low, high = centre - rng.random((6, nn.PROJECTED)), centre + rng.random((6, nn.PROJECTED))
    boxes = nn.Boxes(3, blocks, low, high, np.arange(1, 7))
    for q in rng.normal(size=(200, nn.PROJECTED)) * 3:
        gap = np.maximum(np.maximum(low - q, q - high), 0)
        near = (gap**2).sum(axis=1)
        assert boxes.nearest(q) == blocks[near.argmin()]
        for limit in (0.0, 5.0, 60.0, np.inf):
            assert sorted(boxes.within(q, limit)[0].tolist()) == blocks[near < limit].tolist()
    assert boxes.parts.tolist() == [1, 2, 1, 3, 4, 1, 5, 6]
    one = nn.Boxes(0, np.array([0]), low[:1], high[:1], np.array([2]))
    assert one.nearest(q) == 0 and one.within(q, np.inf)[0].tolist() == [0]
