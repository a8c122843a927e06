import collections

import numpy as np
import pytest

from skein.llm import pieces as sp
from skein.llm import util


PIECES = sp.load()


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary(sp.load(), sp.ALPHA)


def segmentations(v, s):
    if not s:
        return [((), 1.0)]
    out = []
    for b in range(1, len(s) + 1):
        t = {p: i for i, (p, _, k) in enumerate(PIECES) if k == "n"}.get(s[:b], -1)
        if t >= 0:
            out += [((t, *rest), v.weight[t] * w) for rest, w in segmentations(v, s[b:])]
        elif b == 1:
            out += [((-1 - ord(s[0]), *rest), w) for rest, w in segmentations(v, s[1:])]
    return out


def test_samples_follow_exact_probabilities(vocabulary):
    s = sp.SPACE + "thing"
    every = segmentations(vocabulary, s)
    total = sum(w for _, w in every)
    n = 40_000
    lattice = sp.Lattice(vocabulary, ["x", s, "yz"])
    tokens, count = lattice.sample(np.ones(n, np.int64), util.mix(np.arange(n).astype(np.uint64)))
    end = np.cumsum(count)
    got = collections.Counter(tuple(tokens[e - c : e].tolist()) for e, c in zip(end, count))
    tokens, count = sp.Lattice(vocabulary, ["x", s, "long" * 50], logs=True).sample(np.ones(n, np.int64), util.mix(np.arange(n).astype(np.uint64) + np.uint64(n)))
    end = np.cumsum(count)
    long = collections.Counter(tuple(tokens[e - c : e].tolist()) for e, c in zip(end, count))
    assert set(got) <= {t for t, _ in every}
    for t, w in every:
        assert abs(got[t] / n - w / total) < 0.012
        assert abs(long[t] / n - w / total) < 0.012


def test_long_segments_by_brute_force(vocabulary):
    """Each token's share at each place against sums over all segmentations, for a
    segment whose sums need logarithms, and the same draws as without them."""
    s = "abab" * 30
    normal = {p: i for i, (p, _, k) in enumerate(PIECES) if k == "n"}
    fore, back = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0]
    step = lambda a, b: vocabulary.weight[normal[s[a:b]]] / sp.GROWTH ** (b - a) * 30 ** (b - a) if s[a:b] in normal else 0.0
    for b in range(1, len(s) + 1):
        fore[b] = sum(fore[a] * step(a, b) for a in range(max(0, b - vocabulary.longest), b))
    for a in range(len(s) - 1, -1, -1):
        back[a] = sum(step(a, b) * back[b] for b in range(a + 1, min(len(s), a + vocabulary.longest) + 1))
    assert abs(fore[-1] / back[0] - 1) < 1e-9
    n = 20_000
    tokens, count = sp.Lattice(vocabulary, [s], logs=True).sample(np.zeros(n, np.int64), util.mix(np.arange(n).astype(np.uint64)))
    size = np.array([len(vocabulary.text[t].decode()) for t in tokens.tolist()])
    end = np.cumsum(size)
    assert end[-1] == n * len(s)
    borders = np.bincount(end % len(s), minlength=len(s)) / n
    for p in range(1, len(s)):
        assert abs(borders[p] - fore[p] * back[p] / fore[-1]) < 0.02
    short = "▁abab"
    key = util.mix(np.arange(500).astype(np.uint64))
    a, b = (sp.Lattice(vocabulary, [short], logs=x).sample(np.zeros(500, np.int64), key)[0] for x in (False, True))
    assert np.array_equal(a, b)


def test_query_is_lossless_and_reproducible(spark, sf_dir):
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "text")
    a = sp.op3_sentencepiece(spark, sf_dir)
    rows = a.collect()
    assert len(rows) == docs.count() and all(r.lossless and r.n_tokens == len(r.ids) for r in rows)
    b = {r.doc_id: r.ids for r in sp.encode(docs.repartition(7)).collect()}
    assert all(b[r.doc_id] == r.ids for r in rows)
    c = {r.doc_id: r.ids for r in sp.encode(docs, seed=8).collect()}
    assert sum(c[r.doc_id] != r.ids for r in rows) > 0.9 * len(rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in sp.decode(a).collect()} == texts


def test_edges(spark):
    texts = [None, "", " ", "  two  spaces ", "\n\n\ttab", "own ▁ and ▁▁", "𝒳 é ü ñ 漢字 \U0010ffff \x00", "long" * 3000, "x " * 20000, "<0x0A> <s> </s>", "a▁b c"]
    df = spark.createDataFrame([(None if k == 3 else k % 9, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", util.F.lit(0))
    out = sp.encode(df)
    assert all(r.lossless for r in out.collect())
    back = [r.text for r in sp.decode(out).collect()]
    assert sorted(back, key=repr) == sorted(texts, key=repr)
    assert {r.n_tokens for r in out.collect() if r.ids is None} == {0}
    assert sp.encode(df.where("false")).count() == 0
