"""Line dedup: windows of three consecutive lines, repeated windows found over
the whole corpus, later occurrences removed by merging the positions they cover.

DataFrame functions only. The windows travel as two 64-bit hashes and a
position; counts combine before the shuffle, so a window that a third of all
rows hold costs one row a task there. Repeated windows and covered positions are
written first and joined by merging at every size, so that adaptive execution can
split the joins back; the texts are shuffled once, as they are, and split into
lines again after the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """docs with the lines of later occurrences of repeated windows removed.

    A window is `window` consecutive lines (text between line feeds, compared
    exactly). Its first occurrence, by id (null first), then text hash, then
    position, stays; lines that any later occurrence covers go. Adds n_lines and
    n_removed (replacing columns so named).

    Null text: 0 lines, stays null. Empty text: one empty line. Fewer lines than
    a window: unchanged. All lines covered: the text becomes empty. Rows equal in
    id and text are one occurrence and keep the same lines. Empty tables give
    empty tables; other columns pass through, whatever their names.
    """
    docs, restored = util.shielded(docs.drop("n_lines", "n_removed"))
    own = util.row_key(docs, id_col, text_col)
    split = F.split(docs[text_col], "\n", -1).alias("__ls")
    src = docs.select("*", *own)
    last = window - 1
    lines = ", ".join(f"__ls[i + {k}]" for k in range(window))
    win = (
        docs.select(*own, split)
        .where(F.size("__ls") >= window)
        .select(
            "__id",
            "__th",
            F.posexplode(
                F.expr(
                    f"if(size(__ls) >= {window}, transform(sequence(0, size(__ls) - {window}),"
                    f" i -> struct(xxhash64({lines}) AS a, xxhash64(7, {lines}) AS b)), array())"
                )
            ).alias("__p", "__w"),
        )
        .select("__id", "__th", "__p", F.col("__w.a").alias("__a"), F.col("__w.b").alias("__b"))
    )
    place = F.struct("__id", "__th", "__p")
    repeated = win.groupBy("__a", "__b").agg(F.count("*").alias("__n"), F.min(place).alias("__first")).where("__n > 1")
    repeated = util.written(repeated.select("__a", "__b", "__first"), "repeated")
    covered = (
        win.join(repeated.hint("merge"), ["__a", "__b"])
        .where(place != F.col("__first"))
        .groupBy("__id", "__th")
        .agg(F.sort_array(F.collect_set("__p")).alias("__ps"))
        .select(F.col("__id").alias("__i2"), F.col("__th").alias("__t2"), "__ps")
    )
    covered = util.written(covered, "covered")
    util.drop(repeated)
    joined = src.join(covered.hint("merge"), F.col("__id").eqNullSafe(F.col("__i2")) & F.col("__th").eqNullSafe(F.col("__t2")), "left").withColumn("__ls", F.split(text_col, "\n", -1))
    # covered positions merge to intervals [start, end); what lies between them stays
    starts = f"filter(__ps, (p, i) -> i = 0 OR p > __ps[i - 1] + {window})"
    ends = f"transform(filter(__ps, (p, i) -> i = size(__ps) - 1 OR __ps[i + 1] > p + {window}), p -> p + {last + 1})"
    kept = joined.withColumn(
        "__kept",
        F.expr(
            f"if(__ps IS NULL, __ls, flatten(transform(arrays_zip(concat(array(0), {ends}), concat({starts}, array(size(__ls)))),"
            " g -> slice(__ls, g['0'] + 1, g['1'] - g['0']))))"
        ),
    )
    n_lines = F.when(F.col("__ls").isNull(), 0).otherwise(F.size("__ls")).cast("long")
    n_kept = F.when(F.col("__kept").isNull(), 0).otherwise(F.size("__kept")).cast("long")
    out = kept.withColumns(
        {
            text_col: F.when(F.col("__ps").isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n")),
            "n_lines": n_lines,
            "n_removed": n_lines - n_kept,
        }
    )
    return restored(out.drop("__id", "__th", "__ls", "__i2", "__t2", "__ps", "__kept"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: n_lines, n_removed and the SHA-256 of the text kept."""
    docs = util.table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = {
    "op5_line_dedup": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i AS pos, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM w) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, pos + d AS pos FROM later, (VALUES (0), (1), (2)) v(d)),
kept AS (
  SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.pos) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM l) a
  ANTI JOIN covered c ON a.doc_id = c.doc_id AND a.pos = c.pos
  GROUP BY a.doc_id)
SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls), 0) - coalesce(n, 0) AS BIGINT) AS n_removed,
       CASE WHEN ls IS NULL THEN NULL ELSE sha256(coalesce(t, '')) END AS kept_sha256
FROM l LEFT JOIN kept k ON l.doc_id = k.doc_id
"""
}
QUERIES = {"op5_line_dedup": op5_line_dedup}
