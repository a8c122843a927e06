"""Curation of utterance manifests: filters, cleaning, deduplication, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import keep_first

# fixed values: bounds of the filters, and characters with a plain form
MIN_SECONDS, MAX_SECONDS, MIN_CHARS, MAX_CHARS_PER_SECOND = 0.6, 30.0, 2, 30.0
MIN_WORDS_PER_SECOND, MAX_WORDS_PER_SECOND, MAX_WORD = 0.3, 7.5, 40
PLAIN = (("’ʼ‘", "'"), ("–—−", "-"), ("“”«»", '"'))
SCORE_LIMIT, KEY_CHARS = 0.5, 200


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def duration_ok(text: Column, seconds: Column) -> Column:
    rate = F.length(text) / F.greatest(seconds, F.lit(1e-6))
    return seconds.between(MIN_SECONDS, MAX_SECONDS) & (F.length(text) >= MIN_CHARS) & (rate <= MAX_CHARS_PER_SECOND)


def alignment_ok(text: Column, seconds: Column) -> Column:
    """Words come neither too slowly nor too fast, and none is too long."""
    w = words(text)
    pace = F.size(w) / F.greatest(seconds, F.lit(1e-6))
    return (F.size(w) > 0) & pace.between(MIN_WORDS_PER_SECOND, MAX_WORDS_PER_SECOND) & (F.array_max(F.transform(w, F.length)) <= MAX_WORD)


def clean_text(c: Column) -> Column:
    """Plain apostrophes, dashes and quotes; white space as single spaces, none at the ends."""
    odd = "".join(a for a, _ in PLAIN)
    plain = "".join(b * len(a) for a, b in PLAIN)
    return F.trim(F.regexp_replace(F.translate(c, odd, plain), r"(?U)\s+", " "))


def machine_text_score(c: Column) -> Column:
    """Signs of text no one said: capitals, digits, addresses; 1 for empty text."""
    only = lambda kind: F.length(F.regexp_replace(c, rf"[^\p{{{kind}}}]", ""))
    letters, total = only("L"), F.length(c)
    capitals = F.when((only("Lu") / F.greatest(letters, F.lit(1)) > 0.6) & (letters > 10), 0.5).otherwise(0.0)
    digits = F.when(only("Nd") / F.greatest(total, F.lit(1)) > 0.4, 0.5).otherwise(0.0)
    address = F.when(F.contains(c, F.lit("http")) | F.contains(c, F.lit("www.")), 1.0).otherwise(0.0)
    return F.when(total == 0, 1.0).otherwise(capitals + digits + address)


def duration_filter(rows: DataFrame) -> DataFrame:
    return rows.where(duration_ok(F.col("text"), F.col("duration")))


def alignment_filter(rows: DataFrame) -> DataFrame:
    return rows.where(alignment_ok(F.col("text"), F.col("duration")))


def text_filter(rows: DataFrame) -> DataFrame:
    """Cleans text and translation, drops empty and machine-made text."""
    cleaned = rows.withColumn("text", clean_text(F.col("text"))).withColumn("translation", F.when(F.col("translation") != "", clean_text(F.col("translation"))).otherwise(F.col("translation")))
    return cleaned.where((F.col("text") != "") & (machine_text_score(F.col("text")) < SCORE_LIMIT))


def dedupe(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """The first row by seq of each source, language, task and text start."""
    return keep_first(rows, seq, "source", "language", "task", F.substring("text", 1, KEY_CHARS))


def curated(rows: DataFrame) -> DataFrame:
    """All filters, cheap ones first, then deduplication: one lazy plan, one shuffle."""
    return rows.transform(duration_filter).transform(alignment_filter).transform(text_filter).transform(dedupe)


def split_stats(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., language, task, utterances, hours): totals, by language and by task, in one pass."""
    sets = [[*by], [*by, "language"], [*by, "task"]]
    columns = [F.col(c) for c in (*by, "language", "task")]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return out.agg(F.count("*").alias("utterances"), (F.sum("duration") / 3600).alias("hours"), F.grouping_id().alias("level"))


def checkpoint_language(c: Column, strict: bool = False) -> Column:
    """Language of an evaluation folder's name; where none can be derived null, or
    (strict) an error."""
    # fixed values: folders whose language is not their first part
    named = {"cmn_hans_cn": "zh", "yue_hant_hk": "zh", "fil_ph": "tl", "nb_no": "no"}
    code = F.element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), c)
    found = F.coalesce(code, F.nullif(F.substring_index(c, "_", 1), F.lit("")))
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no language code in "), F.coalesce(c, F.lit("null")))).cast("string"))


def target_text(rows: DataFrame) -> Column:
    return F.when((rows["task"] == "translate") & (F.coalesce(rows["translation"], F.lit("")) != ""), rows["translation"]).otherwise(rows["text"])


# fixed values: parameter names, replaced in this order
RENAMES = (
    ("encoder.", "model.encoder."), ("decoder.", "model.decoder."), (".attn.query.", ".self_attn.q_proj."), (".attn.key.", ".self_attn.k_proj."), (".attn.value.", ".self_attn.v_proj."),
    (".attn.out.", ".self_attn.out_proj."), (".cross_attn.query.", ".encoder_attn.q_proj."), (".cross_attn.key.", ".encoder_attn.k_proj."), (".cross_attn.value.", ".encoder_attn.v_proj."),
    (".cross_attn.out.", ".encoder_attn.out_proj."), (".attn_ln.", ".self_attn_layer_norm."), (".cross_attn_ln.", ".encoder_attn_layer_norm."), (".mlp.0.", ".fc1."), (".mlp.2.", ".fc2."),
    (".mlp_ln.", ".final_layer_norm."), ("blocks.", "layers."), ("ln_post.", "layer_norm."), ("decoder.ln.", "decoder.layer_norm."), ("token_embedding.", "embed_tokens."),
    ("positional_embedding", "embed_positions.weight"),
)


def export_name(c: Column) -> Column:
    for old, new in RENAMES:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def decays(name: Column, dims: Column) -> Column:
    """Whether weight decay applies to a parameter."""
    return ~((dims < 2) | F.contains(name, F.lit("embedding")) | F.endswith(name, F.lit(".bias")))
