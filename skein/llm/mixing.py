"""Mixing sources to target weights: hierarchical budgeting over a tree of
domain, language and source, then a token-prefix of seeded epochs in each leaf.

DataFrame functions only. Only sums travel: tokens of a leaf, then tokens of a
leaf's order buckets (4096 at most, by the first three hex digits of the
seeded order key), so no leaf is ever sorted as a whole: the buckets below the
cut are taken, one bucket a leaf is ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import util

LEVELS = ("domain", "lang", "source")
#: The domain of a source, where a table has none: by the source's last character.
DOMAIN_SQL = """CASE WHEN source IS NULL THEN 'unknown' WHEN right(source, 1) IN ('0', '1', '2', '3') THEN 'web'
 WHEN right(source, 1) IN ('4', '5', '6') THEN 'reference' ELSE 'books' END"""
#: Relative weights; 1 where a value is not named.
WEIGHTS = {"domain": {"web": 5, "reference": 3, "books": 2}, "lang": {"en": 4, "de": 2, "fr": 2}}
BUDGET_PERCENT, MAX_EPOCHS, SEED = 60, 4, 17


def weight_of(level: str, weights: dict[str, dict[str, int]]):
    named = weights.get(level, {})
    return reduce(lambda w, kv: w.when(F.col(level) == kv[0], F.lit(kv[1])), named.items(), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(1)).cast("long")


def allocate(leaves: DataFrame, levels=LEVELS, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A budget of tokens for each leaf (levels..., tokens): column `budget`.

    Weights are whole numbers; a node of weight 0 is left out with all below it.
    The root has budget_percent of all tokens. From the top, a node's budget goes
    to its children in proportion to their weights; a child takes no more than
    its subtree's tokens times max_epochs, and what it can't take goes to its
    siblings. Because a node asks for no more than its subtree holds, a shortage
    reaches an ancestor only when all siblings are full. Whole tokens: rounded
    down at each node.
    """
    cap = F.col("tokens") * max_epochs
    node = leaves.groupBy().agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * budget_percent / 100).cast("long").alias("budget"))
    node = node.withColumn("__k", F.lit(1))
    path: list[str] = []
    for depth, level in enumerate(levels):
        own = [*path, level]
        kids = leaves.groupBy(*own).agg(F.sum(cap).cast("long").alias("__cap")).withColumn("__w", weight_of(level, weights)).where("__w > 0")
        if path:
            up = node.select(*[F.col(c).alias(f"__u{i}") for i, c in enumerate(path)], "budget")
            kids = kids.join(up, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__u{i}")) for i, c in enumerate(path)]))
        else:
            kids = kids.withColumn("__k", F.lit(1)).join(F.broadcast(node), "__k").drop("__k")  # one row: the root
        # by rising tokens for a weight: a child is full if its share of what is left reaches its cap
        part = Window.partitionBy(*(path or [F.lit(1)])).orderBy(F.col("__cap") / F.col("__w"), F.col(level))
        before = part.rowsBetween(Window.unboundedPreceding, -1)
        after = part.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        kids = kids.withColumns({"__left": F.col("budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0)), "__wl": F.sum("__w").over(after)})
        kids = kids.withColumn("__full", (F.col("__left").cast("double") * F.col("__w") / F.col("__wl")) >= F.col("__cap"))
        kids = kids.withColumn("__x", F.when(~F.col("__full"), F.struct(F.col("__left").alias("l"), F.col("__wl").alias("w"))))
        rest = F.first("__x", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        kids = kids.withColumn("__r", rest)
        share = F.floor(F.col("__r.l").cast("double") * F.col("__w") / F.col("__r.w")).cast("long")
        node = kids.select(*own, F.when(F.col("__full"), F.col("__cap")).otherwise(F.least("__cap", share)).alias("budget"))
        path = own
    return node


def mix(docs: DataFrame, levels=LEVELS, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """How often each document of docs (id, levels..., n_tokens) is taken: column `copies`, only rows with 1 or more.

    A leaf with budget B and T tokens takes B div T whole epochs, then, of the
    next epoch's seeded order (MD5 of seed, epoch and id; then id, then the
    tokens), the documents while their tokens' running sum is within what is
    left. Null levels are values of their own; a null id is ordered as an empty
    string; repeated rows are taken one by one; documents without tokens
    come free, within the prefix. An empty table gives an empty result. Other columns
    pass through; one named `copies` is replaced.
    """
    docs, restored = util.shielded(docs.drop("copies"), kept=(id_col,))
    leaves = docs.groupBy(*levels).agg(F.sum("n_tokens").cast("long").alias("tokens"), F.count("*").alias("__n"))
    leaves = util.written(leaves, "leaves")
    plan = allocate(leaves, levels, weights, budget_percent, max_epochs)
    names = [f"__l{i}" for i in range(len(levels))]
    on = lambda cols: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(cols, names)])
    cut = plan.select(*[F.col(c).alias(n) for c, n in zip(levels, names)], "budget").join(leaves.select(*levels, "tokens"), on(levels)).drop(*levels)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    cut = cut.withColumn("__e", epochs).withColumn("__rest", F.col("budget") - F.col("__e") * F.col("tokens"))
    cut = util.written(cut.select(*names, "__e", "__rest"), "budgets")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__e").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    dealt = docs.join(cut, on(levels)).withColumn("__key", key).withColumn("__b", F.conv(F.substring("__key", 1, 3), 16, 10).cast("int"))
    sums = dealt.groupBy(*names, "__rest", "__b").agg(F.sum("n_tokens").cast("long").alias("__t"))
    upto = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("__cum", F.sum("__t").over(upto))
    edge = sums.where("__cum > __rest").groupBy(*names).agg(F.min(F.struct("__b", (F.col("__rest") - F.col("__cum") + F.col("__t")).alias("left"))).alias("__m"))
    edge = util.written(edge.select(*[F.col(n).alias(f"{n}e") for n in names], F.col("__m.__b").alias("__eb"), F.col("__m.left").alias("__left")), "edges")
    both = dealt.join(edge, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}e")) for n in names]), "left")
    keep = [*docs.columns, "copies"]
    whole = both.where(F.col("__eb").isNull() | (F.col("__b") != F.col("__eb")))
    whole = whole.withColumn("copies", F.col("__e") + F.when(F.col("__eb").isNull() | (F.col("__b") < F.col("__eb")), 1).otherwise(0))
    order = Window.partitionBy(*names).orderBy("__key", id_col, "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = both.where(F.col("__b") == F.col("__eb")).withColumn("__run", F.sum("n_tokens").over(order))
    part = part.withColumn("copies", F.col("__e") + F.when(F.col("__run") <= F.col("__left"), 1).otherwise(0))
    return restored(whole.select(*keep).unionByName(part.select(*keep)).where("copies > 0"))


def count_tokens(text):
    """Words between white space (space and U+0009 to U+000D); 0 for null, empty and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tokens_by_leaf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_sql: str = DOMAIN_SQL) -> DataFrame:
    """(id, domain, lang, source, n_tokens) of every row of docs, as a written table.

    Null and empty texts have 0 tokens; a null source is of the domain that
    domain_sql names, null languages and sources stay null; repeated rows stay; an
    empty table gives an empty one. Only the id, text, lang and source and what
    domain_sql names are read, so other columns can't clash.
    """
    light = docs.select(id_col, F.expr(domain_sql).alias("domain"), "lang", "source", count_tokens(F.col(text_col)).alias("n_tokens"))
    return util.written(light, "tokens")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document taken, with its leaf, tokens and copies."""
    return mix(tokens_by_leaf(util.table(spark, sf_dir, "documents")))


def _sql() -> str:
    w = {k: "CASE " + k + "".join(f" WHEN '{v}' THEN {n}" for v, n in WEIGHTS[k].items()) + " ELSE 1 END" if k in WEIGHTS else "1" for k in LEVELS}
    steps, path = [], []
    for level in LEVELS:
        own, up = [*path, level], f"n_{path[-1]}" if path else "root"
        using = " AND ".join(f"k.{c} IS NOT DISTINCT FROM u.{c}" for c in path) or "true"
        part = f"PARTITION BY {', '.join(path)}" if path else ""
        steps.append(f"""k_{level} AS (SELECT k.*, u.budget FROM (SELECT {', '.join(own)}, CAST(sum(tokens) * {MAX_EPOCHS} AS BIGINT) AS cap, {w[level]} AS w FROM leaves GROUP BY {', '.join(own)}) k JOIN {up} u ON {using}),
o_{level} AS (SELECT *, budget - coalesce(sum(cap) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft, sum(w) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl,
  row_number() OVER b AS rn FROM k_{level} WINDOW b AS ({part} ORDER BY CAST(cap AS DOUBLE) / w, {level})),
f_{level} AS (SELECT *, CAST(lft AS DOUBLE) * w / wl >= cap AS fl FROM o_{level}),
r_{level} AS (SELECT f.*, first_value(CASE WHEN NOT fl THEN lft END IGNORE NULLS) OVER g AS rl, first_value(CASE WHEN NOT fl THEN wl END IGNORE NULLS) OVER g AS rw FROM f_{level} f WINDOW g AS ({part} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
n_{level} AS (SELECT {', '.join(own)}, CASE WHEN fl THEN cap ELSE least(cap, CAST(floor(CAST(rl AS DOUBLE) * w / rw) AS BIGINT)) END AS budget FROM r_{level})""")
        path = own
    domain = DOMAIN_SQL.replace("\n", " ")
    return f"""
WITH t AS (SELECT doc_id, {domain} AS domain, lang, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM t GROUP BY ALL),
root AS (SELECT CAST(floor(coalesce(sum(tokens), 0) * {BUDGET_PERCENT} / 100) AS BIGINT) AS budget FROM leaves),
{', '.join(steps)},
c AS (SELECT n.*, l.tokens, CASE WHEN l.tokens > 0 THEN CAST(n.budget AS BIGINT) // CAST(l.tokens AS BIGINT) ELSE 0 END AS e FROM n_source n JOIN leaves l
  ON n.domain IS NOT DISTINCT FROM l.domain AND n.lang IS NOT DISTINCT FROM l.lang AND n.source IS NOT DISTINCT FROM l.source),
d AS (SELECT t.*, c.e, c.budget - c.e * c.tokens AS rest, sum(t.n_tokens) OVER (PARTITION BY t.domain, t.lang, t.source ORDER BY md5(concat_ws(':', '{SEED}', CAST(c.e AS VARCHAR), coalesce(CAST(t.doc_id AS VARCHAR), ''))), t.doc_id, t.n_tokens ROWS UNBOUNDED PRECEDING) AS run
  FROM t JOIN c ON t.domain IS NOT DISTINCT FROM c.domain AND t.lang IS NOT DISTINCT FROM c.lang AND t.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, domain, lang, source, n_tokens, CAST(e + CASE WHEN run <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM d WHERE e + CASE WHEN run <= rest THEN 1 ELSE 0 END > 0
"""


SQL = {"op6_mixing": _sql()}
QUERIES = {"op6_mixing": op6_mixing}
