import hashlib
import random
import re
from collections import Counter

from skein.llm import substring_dedup as sd
from skein.llm import util
from tests.test_entry import compared


def brute(rows, window=35):
    docs = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_cover():
    for period in (3, 7, 13, 21, 30):
        c = sd.difference_cover(period)
        assert {(a - b) % period for a in c for b in c} == set(range(period))


def test_query_against_brute_force(spark, sf_dir):
    docs = util.table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in sd.op4_substring_dedup(spark, sf_dir).collect()), key=repr)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


def test_edges(spark):
    rng = random.Random(5)
    passage = [f"w{k}" for k in range(40)]
    rows = [(1, None), (2, ""), (3, "a b c"), (4, "x " * 60), (None, " ".join(passage)), (None, None)]
    for i in range(10, 60):
        own = [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(80))]
        at = rng.randrange(len(own) + 1)
        n = rng.choice([33, 34, 35, 36, 40])
        rows.append((i, " ".join(own[:at] + passage[:n] + own[at:])))
    rows += rows[10:12]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"cid": util.F.lit(1), "removed": util.F.lit("x")})
    out = sd.substring_dedup(df).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in out), key=repr)
    assert got == brute(rows)
    assert all(sum(s["to"] - s["from"] for s in r.removed) == r.n_removed for r in out)
    assert sd.substring_dedup(df.where("false")).count() == 0


def test_query_against_sql(spark):
    compared(spark, "/root/testdata/sf0.01", sd.op4_substring_dedup, sd.SQL["op4_substring_dedup"])
