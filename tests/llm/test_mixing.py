from skein.llm import mixing as mx
from skein.llm import util
from tests.test_entry import compared


def test_query_against_sql(spark):
    compared(spark, "/root/testdata/sf0.01", mx.op6_mixing, mx.SQL["op6_mixing"])


def leaves(spark, rows):
    return spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")


def budgets(spark, rows, **k):
    return {r.source: r.budget for r in mx.allocate(leaves(spark, rows), **k).collect()}


def test_shortages_go_to_siblings_before_ancestors(spark):
    rows = [("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 1000), ("b", "x", "s4", 2000)]
    got = budgets(spark, rows, weights={}, budget_percent=40, max_epochs=1)  # 1604: 802 each domain, 401 each language of a
    assert got == {"s1": 10, "s2": 391, "s3": 401, "s4": 802}
    rows[1] = ("a", "x", "s2", 100)  # all of a.x is 110: the rest goes to a.y, none to b
    got = budgets(spark, rows, weights={}, budget_percent=50, max_epochs=1)  # 1555: 777 each domain
    assert got == {"s1": 10, "s2": 100, "s3": 667, "s4": 777}
    rows[2] = ("a", "y", "s3", 200)  # a is full with 310: the rest goes to b
    got = budgets(spark, rows, weights={}, budget_percent=50, max_epochs=1)
    assert got == {"s1": 10, "s2": 100, "s3": 200, "s4": 845}


def test_weights_and_epochs(spark):
    rows = [("web", "en", "s1", 100), ("books", "en", "s2", 100)]
    assert budgets(spark, rows, budget_percent=350, max_epochs=5) == {"s1": 500, "s2": 200}
    assert budgets(spark, rows, weights={"domain": {"web": 0}}, budget_percent=100, max_epochs=1) == {"s2": 100}
    docs = spark.createDataFrame([(k, "web", "en", "s1", 10) for k in range(10)], "doc_id long, domain string, lang string, source string, n_tokens long")
    out = mx.mix(docs, budget_percent=250, max_epochs=5).collect()
    assert sum(r.copies for r in out) == 25 and {r.copies for r in out} == {2, 3}
    again = {r.doc_id: r.copies for r in mx.mix(docs.repartition(5), budget_percent=250, max_epochs=5).collect()}
    assert again == {r.doc_id: r.copies for r in out}
    other = {r.doc_id: r.copies for r in mx.mix(docs, budget_percent=250, max_epochs=5, seed=3).collect()}
    assert other != again and sum(other.values()) == 25


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "web", "en", "s1", 10, "c", k) for k in range(10)], "doc_id long, domain string, lang string, source string, n_tokens long, copies string, __b int")
    out = mx.mix(docs, budget_percent=250, max_epochs=5)
    assert out.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "__b", "copies"]
    assert sum(r.copies for r in out.collect()) == 25 and all(r["__b"] == r.doc_id for r in out.collect())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a b c", None, 1), (None, "en", None, "s1", 2), (3, "en", "", "s2", 3), (4, "en", "x y", "s2", 4), (4, "en", "x y", "s2", 4)], "doc_id long, lang string, text string, source string, copies int")
    light = mx.tokens_by_leaf(docs)
    assert {r.doc_id: r.n_tokens for r in light.collect()} == {1: 3, None: 0, 3: 0, 4: 2}
    out = mx.mix(light, budget_percent=100, max_epochs=1)
    assert sum(r.n_tokens for r in out.collect()) <= 7
    assert mx.mix(light.where("false")).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
