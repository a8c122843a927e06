"""Error rates: edit distance, pooled rates, buckets, worst cases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Languages scored by character.
BY_CHARACTER = ("zh", "ja", "th", "lo", "my", "km")
LONG_PRODUCT = 250_000
#: Upper bounds of the buckets after "exact".
BUCKETS = (("near", 0.1), ("degraded", 0.5))


def edit_distance(reference, hypothesis) -> int:
    """Unit-cost Levenshtein distance of two sequences, by bit vectors: a column
    of the table is two whole numbers, the places where it rises and falls."""
    if len(reference) > len(hypothesis):
        reference, hypothesis = hypothesis, reference
    n = len(reference)
    if n == 0:
        return len(hypothesis)
    where: dict = {}
    for i, x in enumerate(reference):
        where[x] = where.get(x, 0) | 1 << i
    every, last = (1 << n) - 1, 1 << (n - 1)
    rises, falls, distance = every, 0, n
    for y in hypothesis:
        same = where.get(y, 0)
        diagonal = (((same & rises) + rises) ^ rises) | same | falls
        up = falls | (every & ~(diagonal | rises))
        down = rises & diagonal
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, (down << 1) & every
        rises, falls = down | (every & ~(same | falls | up)), up & (same | falls)
    return distance


@F.pandas_udf(LongType())
def word_distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for ref, hyp in batches:
        yield pd.Series([edit_distance((r or "").split(), (h or "").split()) for r, h in zip(ref, hyp)], dtype="int64")


@F.pandas_udf(LongType())
def code_point_distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for ref, hyp in batches:
        yield pd.Series([edit_distance(r or "", h or "") for r, h in zip(ref, hyp)], dtype="int64")


def squeezed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def char_distance(ref: Column, hyp: Column) -> Column:
    """Code points without white space. The engine's own function takes the
    product of the lengths; beyond LONG_PRODUCT of them, bit vectors do it."""
    a, b = squeezed(ref), squeezed(hyp)
    long = F.length(a).cast("long") * F.length(b) > LONG_PRODUCT
    return F.when(long, code_point_distance(F.when(long, a), F.when(long, b))).otherwise(F.levenshtein(a, b).cast("long"))


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")).cast("long")


def n_chars(c: Column) -> Column:
    return F.length(squeezed(c)).cast("long")


def rate(edits: Column, units: Column, zero_ref: str = "zero") -> Column:
    """Pooled edits over pooled units; without units 0, or ("max1") the edits."""
    total, n = F.sum(edits), F.sum(units)
    if zero_ref == "max1":
        return total / F.greatest(n, F.lit(1))
    return F.when(n > 0, total / n).otherwise(0.0)


def corpus_rates(pairs: DataFrame, *by: str, zero_ref: str = "zero") -> DataFrame:
    """wer and cer over pairs (reference, hypothesis), by group; one shuffle of sums."""
    scored = pairs.withColumns({"__we": word_distance("reference", "hypothesis"), "__ww": n_words(F.col("reference")), "__ce": char_distance(F.col("reference"), F.col("hypothesis")), "__cc": n_chars(F.col("reference"))})
    grouped = scored.groupBy(*by) if by else scored.groupBy()
    return grouped.agg(rate(F.col("__we"), F.col("__ww"), zero_ref).alias("wer"), rate(F.col("__ce"), F.col("__cc"), zero_ref).alias("cer"), F.count("*").alias("n"))


def language_metric(pairs: DataFrame) -> DataFrame:
    """(language, metric, value, n): by character where words aren't spaced."""
    rates = corpus_rates(pairs, "language")
    by_char = F.col("language").isin(*BY_CHARACTER)
    return rates.select("language", F.when(by_char, "cer").otherwise("wer").alias("metric"), F.when(by_char, F.col("cer")).otherwise(F.col("wer")).alias("value"), "n")


def utterance_rates(pairs: DataFrame) -> DataFrame:
    """pairs with edits, words and wer; rows without reference words go."""
    scored = pairs.withColumn("words", n_words(F.col("reference"))).where("words > 0")
    return scored.withColumn("edits", word_distance("reference", "hypothesis")).withColumn("wer", F.col("edits") / F.col("words"))


def error_buckets(rates: DataFrame) -> DataFrame:
    """One row with all four buckets' counts, of rows with wer."""
    w = F.col("wer")
    (near, a), (degraded, b) = BUCKETS
    return rates.agg(F.count_if(w == 0).alias("exact"), F.count_if((w > 0) & (w <= a)).alias(near), F.count_if((w > a) & (w <= b)).alias(degraded), F.count_if(w > b).alias("failed"))


def worst_examples(rates: DataFrame, *seq: str, k: int = 10) -> DataFrame:
    """The k rows of largest wer, earlier rows first among equals."""
    return rates.orderBy(F.desc("wer"), *(seq or ("seq",))).limit(k)
