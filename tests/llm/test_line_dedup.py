import random

from skein.llm import line_dedup as ld
from skein.llm import util
from tests.test_entry import compared


def brute(rows, window=3):
    """rows of (id, text) without repeats; text kept by id."""
    key = lambda i: util.NULL_ID if i is None else i
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        lines = [] if t is None else t.split("\n")
        gone = set()
        for p in range(len(lines) - window + 1):
            w = tuple(lines[p : p + window])
            if w in seen:
                gone.update(range(p, p + window))
            seen.add(w)
        out[i] = (len(lines), len(gone), t if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone))
    return out


def test_query_against_sql(spark):
    compared(spark, "/root/testdata/sf0.01", ld.op5_line_dedup, ld.SQL["op5_line_dedup"])


def test_against_brute_force_and_edges(spark):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "a"), (4, "a\nb"), (5, "a\nb\nc"), (6, "x\na\nb\nc\ny"), (7, "\n\n\n\n\n"), (None, "a\nb\nc\nd"), (8, "z\n" * 3000)]
    rows += [(k, "\n".join(rng.choice("abcde") for _ in range(rng.randrange(12)))) for k in range(20, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": util.F.lit("x"), "pos": util.F.lit(1)})
    out = ld.line_dedup(df)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()} == brute(rows)
    assert out.columns == ["doc_id", "text", "pos", "n_lines", "n_removed"]
    clash = ld.line_dedup(df.withColumns({"__id": util.F.lit("i"), "__LS": util.F.lit(2)}))
    assert clash.columns == ["doc_id", "text", "pos", "__id", "__LS", "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in clash.collect()} == {r.doc_id: r.text for r in out.collect()}
    twice = ld.line_dedup(df.union(df)).collect()
    assert sorted(map(repr, twice)) == sorted(2 * list(map(repr, out.collect())))
    assert ld.line_dedup(df.where("false")).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = ld.op5_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
