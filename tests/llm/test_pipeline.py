import corpus_pipeline as cp
from skein.llm import language_id, util
from tests.llm.test_jaccard_join import brute


def test_stages(spark, sf_dir):
    docs = util.table(spark, sf_dir, "documents")
    assert tuple(docs.columns) == cp.COLUMNS and 4 <= len(cp.STAGES) <= 5
    frames = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        out = util.written(stage(spark, frames[-1], sf_dir), "t")
        if k + 1 < len(cp.STAGES):
            assert out.dtypes == docs.dtypes
        frames.append(out)
    rows = [{r.doc_id: r for r in f.collect()} for f in frames]
    start, named, lines, distinct, mixed, encoded = rows
    # language ID: what stays is untouched, clean documents stay
    assert all(start[i] == r for i, r in named.items()) and len(named) > 0.97 * len(start)
    # line dedup: every kept text is the input less some lines
    for i, r in lines.items():
        own = named[i].text.split("\n")
        it = iter(own)
        assert all(any(x == y for y in it) for x in r.text.split("\n"))
        assert r.n_chars == len(r.text) or r.text == named[i].text
    # near duplicates: exactly the smallest of each class
    classes = brute([(i, r.text) for i, r in lines.items()])
    assert set(distinct) == {i for i, _, c in classes if i == c}
    assert all(distinct[i] == lines[i] for i in distinct)
    # mixing: whole documents of the last stage, within the budget
    words = lambda rs: sum(len(r.text.split()) for r in rs)
    assert all(distinct[i] == r for i, r in mixed.items())
    assert 0.5 * words(distinct.values()) < words(mixed.values()) <= 0.9 * words(distinct.values())
    assert set(encoded) == set(mixed) and all(r.lossless for r in encoded.values())
    run = {r.doc_id: r for r in cp.run(spark, sf_dir).collect()}
    assert run == encoded


def test_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a1", 0), (3, "12 34", "en", None, 5), (None, "the word of the day and the night", None, "b2", 3), (5, "x y z", "en", "a1", 5), (5, "x y z", "en", "a1", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (df, df.where("false")):
        docs = start
        for name, stage in cp.STAGES:
            docs = util.written(stage(spark, docs, "/nowhere"), "t")
        assert docs.count() <= 5
    for name, stage in cp.STAGES:
        assert stage(spark, df, "/nowhere").count() <= len(rows)
    assert language_id.UNKNOWN == "und"


def test_near_duplicates_of_shared_ids(spark):
    text = lambda x: " ".join(f"{x}{k}" for k in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (7, text("c")), (8, text("d") + " end"), (8, text("e")), (9, text("d")), (9, text("f")), (9, text("f")), (10, text("a") + " end"), (11, None)]
    df = spark.createDataFrame([(i, t, "en", "a1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, df, "/nowhere").collect()]
    assert sorted(out, key=repr) == sorted([*rows[:3], *rows[4:6], rows[7], rows[10]], key=repr)


def exact_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_differ_in_other_columns_and_wordless_rows(spark):
    text = " ".join(f"a{k}" for k in range(60))
    rows = [(None, None, "en", "s", None)] * 3 + [(4, " ", "en", "s", 1)] * 2 + [(5, text, "en", "s", 1), (5, text, "de", "s", 1), (5, text, "en", "s", 1), (2, text + " b", "fr", "t", 9)]
    got = exact_rows(cp.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "/nowhere"))
    assert got == sorted([*rows[:5], rows[8]], key=repr)
    got = exact_rows(cp.drop_near_duplicates(spark, spark.createDataFrame(rows[:8], SCHEMA), "/nowhere"))
    assert [r for r in got if r[0] != 5] == sorted(rows[:5], key=repr) and len(got) == 6


def test_mix_takes_rows_not_ids(spark):
    """One id, or none, for all rows: the budget holds all the same, rows stay whole."""
    for i in (None, 7):
        rows = [(i, f"w{k} " * 10, "en", "s1", k) for k in range(200)]
        got = exact_rows(cp.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), "/nowhere"))
        assert len(got) == cp.MIX_PERCENT * 2 and set(got) <= set(rows)
    rows = [(1, "a b c", "en", "s1", 5)] * 30 + [(k, "x y z", "en", "s1", 5) for k in range(2, 72)]
    got = exact_rows(cp.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), "/nowhere"))
    assert sum(len(r[1].split()) for r in got) <= 270 and got.count(rows[0]) in (0, 30)


def test_edges_of_each_stage(spark):
    """Null ids, repeated ids, null texts, clashing columns: exact rows of each stage."""
    prose = {r.lang: " ".join(r.text.split()[:80]) for r in util.table(spark, "/root/testdata/sf0.001", "documents").where("length(text) > 800").collect()}
    rows = [(k, f"{prose[y]} u{k}", y, "s1", 1) for k, y in enumerate(["en", "de", "fr"] * 8)]
    odd = [(None, f"{prose['en']} v", "en", "s1", 1), (3, f"{prose['de']} v", "de", "s1", 1), (3, None, "de", "s1", 1), (None, "", None, None, 0), (9, "12 -- !", "fr", "s1", 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumns({"score": util.F.lit("x"), "__id": util.F.lit(1), "copies": util.F.lit("c"), "n_lines": util.F.lit(2)})
    assert exact_rows(cp.identify_language(spark, df, "/nowhere")) == sorted(rows + odd[:2], key=repr)
    assert exact_rows(cp.dedup_lines(spark, df, "/nowhere")) == sorted(rows + odd, key=repr)
    near = exact_rows(cp.drop_near_duplicates(spark, df, "/nowhere"))
    assert near == sorted([rows[1], rows[2], *odd[2:], odd[0]], key=repr)  # of the English ones the null id comes first
    assert set(exact_rows(cp.mix_sources(spark, df, "/nowhere"))) <= set(rows + odd)
    assert [r.doc_id for r in cp.encode_pieces(spark, df, "/nowhere").where("ids IS NULL").collect()] == [3]
    for _, stage in cp.STAGES:
        assert stage(spark, df.where("false"), "/nowhere").count() == 0
