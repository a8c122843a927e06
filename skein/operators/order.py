"""Ordered operators: ranks, first rows, samples, shuffles, neighbours.

A rank over a whole table is never one task's work: rows fall into buckets between
quantiles of their order key, buckets are counted, and each row's rank is the
rows in the buckets before plus its place in its own.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a rank at most; only as many counts are ever in one task.
MOST_BUCKETS = 1024


def quantile_bucket(df: DataFrame, key: str) -> Column:
    """Which of about equal buckets a numeric key falls in; as many as the session
    has shuffle partitions, MOST_BUCKETS at most. Null keys are in the first."""
    n = min(MOST_BUCKETS, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if n == 1:
        return F.lit(0)
    shares = F.array(*[F.lit(k / n) for k in range(1, n)])
    found = df.agg(F.percentile_approx(key, shares, 20 * n)).first()[0]  # fewer than n numbers
    bounds = sorted(set(found or []))
    return F.size(F.filter(F.lit(bounds), lambda b: F.col(key) >= b)) if bounds else F.lit(0)


def ranked(df: DataFrame, key: str, *by: str, bucket: Column | None = None) -> DataFrame:
    """df with `rank` (from 1) by key within `by`. bucket: any column that never
    falls as key rises and has few values; by default ranges of a numeric key that
    hold about as many rows each. Rows of equal keys and null keys share a bucket."""
    cells = df.withColumn("__b", quantile_bucket(df, key) if bucket is None else bucket)
    counts = cells.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    if by:
        before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    else:
        found = sorted(tuple(r) for r in counts.collect())  # a row for each bucket
        sums = [0, *accumulate(n for _, n in found)]
        counts = df.sparkSession.createDataFrame([(b, s) for (b, _), s in zip(found, sums)], "__b int, __before long")
    names = {c: f"__{c}" for c in (*by, "__b")}
    counts = counts.select(*[F.col(c).alias(n) for c, n in names.items()], "__before")
    joined = cells.join(counts if by else F.broadcast(counts), [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])  # a row a bucket
    place = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(key))
    return joined.withColumn("rank", (F.col("__before") + place).cast("long")).drop("__b", "__before", *names.values())


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """df with `rank` in a seeded random order of the key columns."""
    parts = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    hashed = df.withColumn("__h", F.md5(parts))
    return ranked(hashed, "__h", bucket=F.conv(F.substring("__h", 1, 3), 16, 10).cast("int")).drop("__h")


def keep_first(df: DataFrame, seq: str, *key) -> DataFrame:
    """The first row by seq of each key."""
    order = Window.partitionBy(*key).orderBy(seq)
    return df.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def every_kth(df: DataFrame, seq: str, k: int, first: bool = True) -> DataFrame:
    """Rows 0, k, 2k ... by seq; or (first=False) rows k - 1, 2k - 1 ..."""
    k = max(k, 1)
    return ranked(df, seq).where((F.col("rank") - 1) % k == (0 if first else k - 1)).drop("rank")


def last_k(df: DataFrame, order: str, k: int, *by: str) -> DataFrame:
    """The k last rows by order of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def by_path(df: DataFrame, path: str) -> DataFrame:
    """Sorted by path, component by component."""
    return df.orderBy(F.split(path, "/"))


def speaker_split(rows: DataFrame, seed: int, per: int = 100) -> DataFrame:
    """rows with `split`: a hundredth of the speakers (one at least) is dev, as
    many are test, the others train; no speaker is in two."""
    speakers = shuffled(rows.select("source", "speaker").distinct(), seed, "source", "speaker")
    n = speakers.agg(F.greatest(F.floor(F.count("*") / per), F.lit(1)).cast("long").alias("__n")).withColumn("__one", F.lit(1))
    labelled = speakers.withColumn("__one", F.lit(1)).join(F.broadcast(n), "__one")  # one row: the count
    split = F.when(F.col("rank") <= F.col("__n"), "dev").when(F.col("rank") <= 2 * F.col("__n"), "test").otherwise("train")
    labelled = labelled.select(F.col("source").alias("__s"), F.col("speaker").alias("__p"), split.alias("split"))
    return rows.join(labelled, F.col("source").eqNullSafe(F.col("__s")) & F.col("speaker").eqNullSafe(F.col("__p"))).drop("__s", "__p")


#: Values that a running sum adds up as one block.
RUN_BLOCK = 16


def inverse_cdf(p: DataFrame, key: str, draw: str) -> DataFrame:
    """(key, pick): the first pos whose running sum of p exceeds the draw, else the last largest.

    A running sum is that of the whole blocks of RUN_BLOCK values, then value by value:
    DuckDB's order where every key has a multiple of RUN_BLOCK rows, so that a draw
    that equals a sum but for rounding falls in the same place. Null p add nothing."""

    def add(s, c):
        value, last = F.coalesce(c["p"], F.lit(0.0)), s["n"] % RUN_BLOCK == RUN_BLOCK - 1
        block = s["block"] + value
        run = F.when(last, s["base"] + block).otherwise(s["run"] + value)
        hit = F.coalesce(s["hit"], F.when(c["p"].isNotNull() & (c["draw"] < run), c["pos"]))
        base = F.when(last, run).otherwise(s["base"])
        return F.struct((s["n"] + 1).alias("n"), base.alias("base"), F.when(last, 0.0).otherwise(block).alias("block"), run.alias("run"), hit.alias("hit"))

    pos = p.schema["pos"].dataType
    none = F.struct(F.lit(0).alias("n"), *[F.lit(0.0).alias(x) for x in ("base", "block", "run")], F.lit(None).cast(pos).alias("hit"))
    cells = F.array_sort(F.collect_list(F.struct("pos", F.col("p").cast("double").alias("p"), F.col(draw).alias("draw"))))
    out = p.groupBy(key).agg(cells.alias("__cells"), F.max(F.struct("p", "pos")).alias("top"))
    return out.select(key, F.coalesce(F.aggregate("__cells", none, add, lambda s: s["hit"]), "top.pos").alias("pick"))
