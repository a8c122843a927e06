"""A corpus pipeline: five stages over documents, each an operator whose decisions take effect.

run(spark, sf_dir) applies STAGES in order; each stage's result is written as
Parquet in the shared folder and read again as the next one's documents. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import jaccard_join, language_id, line_dedup, mixing, pieces, util

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less sure than this, by share of their words, go.
LEAST_SCORE = 0.4
#: The mix asks for this share of the tokens that stay; a leaf is not repeated here.
MIX_PERCENT, MIX_EPOCHS = 90, 1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a language that holds two fifths of
    their words; the others stay as they are.

    Null, empty and letterless texts go; every row is judged by itself, so null
    ids, ties and repeated rows need no rule; a table in which no language can be
    learned, an empty one too, gives no rows. Other columns aren't read.
    """
    util.bounded_batches(spark)
    model = language_id.fit(docs)
    found = language_id.identify(util.spread(docs.select(*COLUMNS)), model, keep=COLUMNS[1:])
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the lines of later occurrences of repeated three-line windows;
    documents without a line left go.

    Null and empty texts stay as they are; rows that repeat an id and text are one
    occurrence and keep the same lines; a null id comes first; an empty table gives
    an empty one. n_chars is counted anew where lines went. Other columns aren't read.
    """
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    left = (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))
    out = out.where(left).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*COLUMNS)


def _with_key(docs: DataFrame) -> DataFrame:
    """The columns of documents with __row, a hash of all of them: equal rows share it."""
    return docs.select(*COLUMNS, F.xxhash64(*[F.struct(F.col(c).isNull(), c) for c in COLUMNS]).alias("__row"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: the one with the smallest id
    (null first), then the smallest hashes of its text and of the whole row.

    A document is a row: rows that share an id, or have none, are as many documents
    as they differ; rows equal in all columns are exact copies, of which one stays.
    Documents without words, null and empty texts among them, are like no other
    and all stay. An empty table gives an empty one. Other columns aren't read.
    """
    docs = _with_key(docs)
    docs = docs.select("*", *util.row_key(docs))
    classes = jaccard_join.near_duplicate_classes(docs, id_col="__row").where("n_shingles > 0").select("__row", "component_id")
    first = F.min(F.struct("__id", "__th", "__row")).alias("first")
    kept = classes.join(docs.select("__row", "__id", "__th").distinct(), "__row").groupBy("component_id").agg(first)
    kept = util.written(kept.select(F.col("first.__row").alias("__row")), "firsts")
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    firsts = docs.where(~wordless).join(kept, "__row", "left_semi").dropDuplicates(["__row"])
    return firsts.select(*COLUMNS).unionByName(docs.where(wordless).select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the target mix takes: MIX_PERCENT of the tokens.

    Rows equal in all columns are one unit, taken or left together with the tokens
    of all; rows that share an id, or have none, but differ are taken one by one.
    Null languages and sources are leaves of their own; documents without tokens
    come free, within their leaf's order. An empty table gives an empty one. Other
    columns aren't read.
    """
    docs = _with_key(docs)
    light = mixing.tokens_by_leaf(docs, id_col="__row")
    units = light.groupBy("__row", *mixing.LEVELS).agg(F.sum("n_tokens").cast("long").alias("n_tokens"))
    taken = mixing.mix(units, budget_percent=MIX_PERCENT, max_epochs=MIX_EPOCHS, id_col="__row").select("__row")
    return docs.join(taken, "__row", "left_semi").select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled token ids of every document left.

    Null texts have null ids and 0 tokens, empty ones an empty array; repeated rows
    get the same; an empty table gives an empty one. Other columns aren't read.
    """
    return pieces.encode(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Between stages only the last result is kept on disk."""
    docs = util.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with util.kept_only(spark) as kept:
            last, docs = docs, util.written(stage(spark, docs, sf_dir), f"stage{k + 1}")
            kept.append(docs)
        util.drop(last)


#: The conditional random field and the sampled segmentations are not expressible in SQL.
ORACLE_SQL = None
