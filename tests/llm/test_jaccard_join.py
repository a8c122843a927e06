import random

from skein.llm import jaccard_join as jj
from skein.llm import util
from tests.test_entry import compared


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for x, s in enumerate(sets):
        seen = set()
        for t in s:
            for y in where.setdefault(t, []):
                if y not in seen:
                    seen.add(y)
                    i = len(s & sets[y])
                    if 100 * i >= 75 * (len(s) + len(sets[y]) - i):
                        up[root(x)] = root(y)
            where[t].append(x)
    key = lambda i: util.NULL_ID if i is None else i
    small = {}
    for x, (i, _) in enumerate(rows):
        small[root(x)] = min(small.get(root(x), 2**63), key(i))
    out = [(i, len(sets[x]), None if small[root(x)] == util.NULL_ID else small[root(x)]) for x, (i, _) in enumerate(rows)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in util.table(spark, sf_dir, "documents").collect()]
    assert rows_of(jj.op2_jaccard_join(spark, sf_dir)) == brute(rows)


def test_chains_ties_and_edges(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A b"), (905, "a"), (None, "only words of a null id here"), (None, None)]
    for c in range(6):
        words = [f"c{c}x{k}" for k in range(40 + 7 * c)]
        for _ in range(25):
            w = list(words)
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(w)))
            words = w if rng.random() < 0.4 else words
    for _ in range(40):  # a passage that many documents share
        rows.append((len(rows), " ".join(base[: rng.randrange(20, 60)] + [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(120))])))
    rows += rows[20:24] + [(5000, rows[30][1].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", util.F.lit("x"))
    got = rows_of(jj.near_duplicate_classes(df))
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(got)
    assert jj.near_duplicate_classes(df.where("false")).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 160)] + [(3, 9), (9, 4), (7, 8), (2, 8)]
    got = {r.node: r.comp for r in jj.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 3: 3, 9: 3, 4: 3, 7: 2, 8: 2, 2: 2}


def test_members_of_one_group(spark):
    """Records under templates that open alike: the templates are more frequent than
    the record, so its shingles are the prefix and no other group holds them. Only
    the second and third are alike, neither the first nor the last of the group."""
    rows = []
    for g in range(4):
        record, opening = [f"r{g}x{k}" for k in range(34)], [f"o{g}x{k}" for k in range(4)]
        ends = {c: [*opening, *[f"{c}{g}x{k}" for k in range(66)]] for c in "xyz"}
        ends = [ends["x"], ends["y"], [*ends["y"][:40], f"changed{g}", *ends["y"][41:]], ends["z"]]
        for k, end in enumerate(ends):
            rows.append((10 * g + k, " ".join(record + end)))
            rows += [(1000 + 100 * g + 10 * k + c, " ".join([f"s{g}x{k}x{c}x{j}" for j in range(200)] + end)) for c in range(5)]
    want = brute(rows)
    assert {(i, c) for i, _, c in want if i != c} == {(10 * g + 2, 10 * g + 1) for g in range(4)}
    assert rows_of(jj.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_shared_boilerplate(spark):
    """Random documents of few passages, so that prefixes, groups and buckets repeat and
    blocks are split; shuffled ids, so that leaders fall anywhere."""
    rng = random.Random(11)
    passages = [[f"p{g}x{k}" for k in range(rng.randrange(8, 60))] for g in range(9)]
    rows = []
    for _ in range(420):
        words = [w for g in rng.sample(range(9), rng.randrange(1, 4)) for w in passages[g]]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
        rows.append((rng.randrange(10**6), " ".join(words)))
    old, jj.BLOCK_ROWS = jj.BLOCK_ROWS, 7
    try:
        got = rows_of(jj.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    finally:
        jj.BLOCK_ROWS = old
    assert got == brute(rows)


def test_query_against_sql(spark):
    compared(spark, "/root/testdata/sf0.01", jj.op2_jaccard_join, jj.SQL["op2_jaccard_join"])


def test_tables_are_dropped(spark, sf_dir):
    before = set(util._tables)
    with util.kept_only(spark) as kept:
        kept.append(util.written(jj.op2_jaccard_join(spark, sf_dir), "kept"))
    assert set(util._tables) - before == {kept[0]._written_at} and kept[0].count() == 200
    util.drop(kept[0])
    assert set(util._tables) == before
