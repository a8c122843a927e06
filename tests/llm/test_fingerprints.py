import hashlib
import math
import random

import numpy as np

from skein.llm import fingerprints as fp
from skein.llm import util


def expected(rows):
    rows = sorted(rows, key=lambda r: r[0])
    texts = [t or "" for _, t in rows]
    own = fp.simhashes([t.encode() for t in texts])
    out = {}
    for k, (i, _) in enumerate(rows):
        t, m = texts[k], texts[(k + 1) % len(rows)]
        h = len(t) // 2
        e = (t[: len(t) - h] + m[:h]).encode()
        f = fp.simhashes([e])[0]
        near = sum(0 < (int.from_bytes(o) ^ int.from_bytes(own[k])).bit_count() <= fp.RADIUS for o in set(own))
        out[i] = (len(t), hashlib.sha256(e).hexdigest(), own[k].hex(), f.hex(), fp.likeness(own[k], f), fp.likeness(own[k], own[(k + 1) % len(rows)]), min(j for (j, _), o in zip(rows, own) if o == own[k]), near)
    return out


def got(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.class_id, r.n_near) for r in df.collect()}


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in util.table(spark, sf_dir, "documents").collect()]
    out = got(fp.op9_fingerprints(spark, sf_dir))
    assert out == expected(rows)
    assert np.mean([r[4] > r[5] for r in out.values()]) > 0.9


def test_simhash_is_the_weighted_vote():
    text = "a b c a b c a b d"
    words = text.split()
    h = {w: int(util.hash_words([w.encode()])[0]) for w in set(words)}
    votes = np.zeros(128)
    terms = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    for t in set(terms):
        x = util.mix(np.array([sum(h[w] * int(m) for w, m in zip(t, fp.MULT)) % 2**64], np.uint64))
        y = util.mix(x + fp.MULT[0])
        bits = np.unpackbits(np.stack([x, y], axis=1).view(np.uint8))
        votes += (1 + math.log(terms.count(t))) * (2.0 * bits - 1)
    assert fp.simhashes([text.encode()])[0] == np.packbits(votes > 0).tobytes()


def test_edges(spark):
    rows = [(5, None), (2, ""), (9, "x"), (11, "é ü ß ñ"), (30, "a b c " * 400), (7, "a b c " * 400), (-4, "𝒳𝒴 z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", util.F.lit("x"))
    assert got(fp.document_fingerprints(df)) == expected(rows)
    assert fp.document_fingerprints(df.where("false")).count() == 0
    one = spark.createDataFrame([(None, "abc def")], "doc_id long, text string")
    r = fp.document_fingerprints(one).collect()[0]
    assert r.doc_id is None and r.class_id is None and r.near_next == 1
    twice = df.union(df)
    assert fp.document_fingerprints(twice).count() == 2 * len(rows)


def test_all_within_radius(spark):
    rng = random.Random(4)
    base = rng.getrandbits(128)
    every = {base}
    for _ in range(300):
        x = base if rng.random() < 0.7 else rng.getrandbits(128)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(128)
        every.add(x)
    near = {x: sum(0 < (x ^ y).bit_count() <= 3 for y in every) for x in every}
    df = spark.createDataFrame([(x.to_bytes(16),) for x in every], "fp binary")
    old, fp.BLOCK_ROWS = fp.BLOCK_ROWS, 40
    try:
        out = {int.from_bytes(r.fp): r.n_near for r in fp.within_radius(df).collect()}
    finally:
        fp.BLOCK_ROWS = old
    assert out == {x: n for x, n in near.items() if n}
