import itertools

import numpy as np

from skein.llm import language_id as li
from skein.llm import util


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = util.table(spark, d, "documents").select("doc_id", "lang")
    out = li.op10_language_id(spark, d).join(truth, "doc_id").toPandas()
    held = out[out.held_out]
    assert 0.2 < len(held) / len(out) < 0.3
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    k, steps = 3, 4
    e, t = rng.normal(size=(2, steps, k)), rng.normal(size=(k, k))
    length = np.array([4, 3])
    p, pairs = li.marginals(e, length, t, pairs=True)
    total = np.zeros((k, k))
    for c in range(2):
        weight, single = 0.0, np.zeros((length[c], k))
        pair = np.zeros((k, k))
        for y in itertools.product(range(k), repeat=length[c]):
            s = np.exp(sum(e[c, j, y[j]] for j in range(len(y))) + sum(t[a, b] for a, b in zip(y, y[1:])))
            weight += s
            for j, a in enumerate(y):
                single[j, a] += s
            for a, b in zip(y, y[1:]):
                pair[a, b] += s
        assert np.allclose(p[c, : length[c]], single / weight)
        total += pair / weight
    assert np.allclose(pairs, total)


def test_messages_of_long_chains_are_exact():
    rng = np.random.default_rng(4)
    for k, spread in ((2, 0.05), (4, 3.0)):
        sizes = np.array([0, 1, 5, li.RUN, 0, li.RUN + 1, 5 * li.RUN + 7, 2])
        begin = np.cumsum(sizes) - sizes
        e, t = rng.normal(size=(sizes.sum(), k)) * spread, rng.normal(size=(k, k)) + 4 * np.eye(k)
        p = li.chain_marginals(e, begin, sizes, t)
        for b, n in zip(begin, sizes):
            if n:
                want = li.marginals(e[None, b : b + n], np.array([n]), t)[0][0]
                assert np.abs(p[b : b + n] - want).max() < 1e-4


def test_every_letter_is_read():
    word = "".join(chr(0x3042 + k) for k in range(20))
    seen = set()
    for at in range(20):
        whole, inner, _ = li.features([word[:at] + "\u4e00" + word[at + 1 :]])
        seen.add((tuple(whole[0, 1:]), tuple(inner.ravel())))
    assert len(seen) == 20
    assert li.WORD.findall(word * 3) == [(word * 3)[:24], (word * 3)[24:48], (word * 3)[48:]]
    whole, inner, start = li.features(["a", "bcd"])
    assert whole.shape == (2, 9) and inner.shape == (4, 3) and list(start) == [0, 1]
    assert (whole[0] > 0).sum() == 3 and (inner[1:] > 0).sum() == 3 + 2 + 1


def test_text_without_spaces_and_many_languages(spark):
    rng = np.random.default_rng(8)
    letters = {"xa": range(0x3042, 0x3090), "xb": range(0x4E00, 0x4E60), "xc": range(0xAC00, 0xAC60)}
    text = lambda y, n: "".join(chr(rng.choice(letters[y])) for _ in range(n))
    rows = [(k, text(y, 150), y) for k, y in enumerate(["xa", "xb", "xc"] * 20)]
    rows += [(1000 + k, f"only{k} of{k} lang{k}", f"l{k:03}") for k in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(docs)
    assert len(model.langs) > 180 + 3 and model.weights.size <= li.CELLS
    # same letters at both ends, another script between them
    ends = text("xa", 6)
    ask = [(1, text("xa", 400)), (2, text("xb", 30_000)), (3, ends + text("xb", 90) + ends), (4, ends + text("xc", 90) + ends)]
    got = {r.doc_id: r.lang_pred for r in li.identify(spark.createDataFrame(ask, "doc_id long, text string"), model).collect()}
    assert got == {1: "xa", 2: "xb", 3: "xb", 4: "xc"}


def test_code_switched_and_edges(spark):
    d = "/root/testdata/sf0.01"
    docs = util.table(spark, d, "documents")
    model = li.fit(docs)
    by = {r.lang: " ".join(r.text.split()[:60]) for r in docs.where("length(text) > 800").collect()}
    mixed = by["en"] + " " + by["de"]
    rows = [(1, None), (2, ""), (3, "123 -- !"), (4, mixed), (None, by["fr"]), (5, "la " * 30000), (5, by["es"]), (5, by["es"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", util.F.lit("x"))
    out = li.identify(df.select("doc_id", "text"), model).collect()
    got = {(r.doc_id, r.n_words): r for r in out}
    assert [got[k, 0].lang_pred for k in (1, 2, 3)] == ["und"] * 3
    switched = next(r for r in out if r.doc_id == 4)
    assert switched.n_switches >= 1 and switched.score < 0.9
    assert next(r for r in out if r.doc_id is None).lang_pred == "fr"
    assert len(out) == len(rows)
    none = li.fit(docs.where("false"))
    assert {r.lang_pred for r in li.identify(df.select("doc_id", "text"), none).collect()} == {"und"}
    assert li.identify(df.select("doc_id", "text").where("false"), model).count() == 0
    clash = li.identify(df, model, keep=("score",))
    assert clash.columns == ["doc_id", "lang_pred", "score", "n_words", "n_switches"]
    assert {r.score for r in clash.collect()} == {r.score for r in out}
