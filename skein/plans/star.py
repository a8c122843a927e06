"""Built-in operators over the star schema: joins of every kind, grouping sets,
ranking windows, set operations. Spark's own; none of them is the reference's."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import surrogates as s

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _money(c):
    return F.sum(c.cast("decimal(18,2)")).cast("double")


REVENUE = "CAST(sum(CAST(l_extendedprice AS DECIMAL(14, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE)"


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def star_pricing(spark, sf_dir):
    """Filter, two keys, sums: the filter and four columns reach the scan."""
    li = s.table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), _money(F.col("l_quantity")).alias("quantity"))


@query("SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def star_inner_join(spark, sf_dir):
    o, c, n = (s.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("orders"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def star_left_join(spark, sf_dir):
    """Orders of every customer; counted before the join."""
    c, o = s.table(spark, sf_dir, "customer"), s.table(spark, sf_dir, "orders")
    counts = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("orders"))
    return c.select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"))


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def star_anti_join(spark, sf_dir):
    return s.table(spark, sf_dir, "customer").join(s.table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier SEMI JOIN lineitem ON l_suppkey = s_suppkey")
def star_semi_join(spark, sf_dir):
    return s.table(spark, sf_dir, "supplier").join(s.table(spark, sf_dir, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nation, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY ALL) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY ALL) ON c_nationkey = s_nationkey")
def star_full_join(spark, sf_dir):
    c = s.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    p = s.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    return c.join(p, F.col("c_nationkey") == F.col("s_nationkey"), "full").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "c", "s")


@query("SELECT a.event_id, max(b.event_id) AS before FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id < a.event_id GROUP BY a.event_id")
def star_as_of(spark, sf_dir):
    """Each event's previous one of its user: as-of by a window instead of a range join."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return s.table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("before")).where("before IS NOT NULL")


@query(f"SELECT n_regionkey, n_name, {REVENUE} AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
def star_rollup(spark, sf_dir):
    """Revenue by region and nation with totals; summed by supplier before the joins."""
    li = s.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(14,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("r"))
    p, n = s.table(spark, sf_dir, "supplier"), s.table(spark, sf_dir, "nation")
    joined = li.join(p, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.rollup("n_regionkey", "n_name").agg(F.sum("r").cast("double").alias("revenue"))


@query("SELECT l_returnflag, l_shipmode, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_shipmode)".replace("l_shipmode", "l_linestatus"))
def star_cube(spark, sf_dir):
    return s.table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)")
def star_ranks(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    near = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)
    return s.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.sum("o_totalprice").over(near).alias("recent"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def star_intersect(spark, sf_dir):
    return s.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(s.table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def star_except(spark, sf_dir):
    return s.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(s.table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def star_distinct_counts(spark, sf_dir):
    return s.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
