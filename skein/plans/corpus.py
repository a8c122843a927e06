"""Queries over manifests: filters, cleaning, joins, splits, samples, reports, error rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics, textnorm, tokens
from ..operators import curate, order
from ..sources import readers
from . import surrogates as s

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


M = f"WITH {s.MANIFEST_SQL}"
WORDS = "list_filter(string_split(regexp_replace({c}, '[\\s\\p{{Z}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
DURATION = "duration BETWEEN 0.6 AND 30 AND length(text) >= 2 AND length(text) / greatest(duration, 1e-6) <= 30"
ALIGNED = f"len({WORDS.format(c='text')}) > 0 AND len({WORDS.format(c='text')}) / greatest(duration, 1e-6) BETWEEN 0.3 AND 7.5 AND list_max(list_transform({WORDS.format(c='text')}, lambda w: length(w))) <= 40"
CLEAN = "trim(regexp_replace(translate({c}, '’ʼ‘–—−“”«»', '''''''---\"\"\"\"'), '[\\s\\p{{Z}}]+', ' ', 'g'))"
SCORE = """CASE WHEN length({c}) = 0 THEN 1.0::DOUBLE ELSE
  CASE WHEN length(regexp_replace({c}, '[^\\p{{Lu}}]', '', 'g')) / greatest(length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g')), 1)::DOUBLE > 0.6 AND length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g')) > 10 THEN 0.5::DOUBLE ELSE 0 END
  + CASE WHEN length(regexp_replace({c}, '[^\\p{{Nd}}]', '', 'g')) / greatest(length({c}), 1)::DOUBLE > 0.4 THEN 0.5::DOUBLE ELSE 0 END
  + CASE WHEN contains({c}, 'http') OR contains({c}, 'www.') THEN 1.0::DOUBLE ELSE 0 END END"""
CURATED = f"""{M}, m AS (SELECT * REPLACE (CASE WHEN seq % 13 = 0 THEN text || ' http://x' ELSE text END AS text) FROM manifest),
f1 AS (SELECT * FROM m WHERE {DURATION}), f2 AS (SELECT * FROM f1 WHERE {ALIGNED}),
f3 AS (SELECT * REPLACE ({CLEAN.format(c='text')} AS text, CASE WHEN translation <> '' THEN {CLEAN.format(c='translation')} ELSE translation END AS translation) FROM f2),
f4 AS (SELECT * FROM f3 WHERE text <> '' AND {SCORE.format(c='text')} < 0.5),
f5 AS (SELECT * FROM f4 QUALIFY row_number() OVER (PARTITION BY source, language, task, substring(text, 1, 200) ORDER BY seq) = 1)"""


def _rows(spark, sf_dir):
    return s.with_addresses(s.manifest(spark, sf_dir))


@query(f"{CURATED} SELECT language, count(*) AS utterances, sum(duration) / 3600 AS hours FROM f5 GROUP BY language")
def curate_report(spark, sf_dir):
    """Curated utterances and hours by language."""
    return curate.curated(_rows(spark, sf_dir)).groupBy("language").agg(F.count("*").alias("utterances"), (F.sum("duration") / 3600).alias("hours"))


@query(f"{CURATED} SELECT (SELECT count(*) FROM m) AS scanned, (SELECT count(*) FROM f1) AS timed, (SELECT count(*) FROM f2) AS aligned, (SELECT count(*) FROM f4) AS spoken, (SELECT count(*) FROM f5) AS distinct_rows")
def curate_funnel(spark, sf_dir):
    """Rows left after each filter, in one pass and the deduplication's shuffle."""
    rows = _rows(spark, sf_dir)
    ok1 = curate.duration_ok(F.col("text"), F.col("duration"))
    ok2 = ok1 & curate.alignment_ok(F.col("text"), F.col("duration"))
    clean = curate.clean_text(F.col("text"))
    ok3 = ok2 & (clean != "") & (curate.machine_text_score(clean) < curate.SCORE_LIMIT)
    flagged = rows.select("source", "language", "task", F.substring(clean, 1, 200).alias("key"), ok1.alias("a"), ok2.alias("b"), ok3.alias("c"))
    keyed = flagged.groupBy("source", "language", "task", "key").agg(F.count("*").alias("n"), F.count_if("a").alias("a"), F.count_if("b").alias("b"), F.count_if("c").alias("c"))
    return keyed.agg(F.sum("n").alias("scanned"), F.sum("a").alias("timed"), F.sum("b").alias("aligned"), F.sum("c").alias("spoken"), F.count_if(F.col("c") > 0).alias("distinct_rows"))


@query(f"{M} SELECT utt_id, seq FROM manifest")
def utterance_ids(spark, sf_dir):
    """Identifiers of all utterances: 16 hex digits of a SHA-1."""
    return s.manifest(spark, sf_dir).select("utt_id", "seq")


@query(f"{M} SELECT seq FROM manifest WHERE {DURATION}")
def duration_filter(spark, sf_dir):
    return curate.duration_filter(s.manifest(spark, sf_dir)).select("seq")


@query(f"{M} SELECT seq FROM manifest WHERE {ALIGNED}")
def alignment_filter(spark, sf_dir):
    return curate.alignment_filter(s.manifest(spark, sf_dir)).select("seq")


@query(f"{M}, m AS (SELECT * REPLACE (CASE WHEN seq % 13 = 0 THEN text || ' http://x' ELSE text END AS text) FROM manifest) SELECT seq, {CLEAN.format(c='text')} AS clean, {SCORE.format(c='text')} AS score FROM m")
def text_quality(spark, sf_dir):
    """Cleaned text and machine-text score of every utterance."""
    return _rows(spark, sf_dir).select("seq", curate.clean_text(F.col("text")).alias("clean"), curate.machine_text_score(F.col("text")).alias("score"))


@query(f"{CURATED} SELECT seq, text, translation FROM f4")
def text_filter(spark, sf_dir):
    """Utterances whose cleaned text passes, text and translation replaced."""
    rows = _rows(spark, sf_dir).transform(curate.duration_filter).transform(curate.alignment_filter)
    return curate.text_filter(rows).select("seq", "text", "translation")


@query(f"{M} SELECT seq FROM manifest QUALIFY row_number() OVER (PARTITION BY source, language, task, substring(text, 1, 200) ORDER BY seq) = 1")
def dedupe_transcripts(spark, sf_dir):
    return curate.dedupe(s.manifest(spark, sf_dir)).select("seq")


@query("""WITH f AS (SELECT DISTINCT lang || '_' || source AS folder FROM documents UNION SELECT unnest(['cmn_hans_cn', 'yue_hant_hk', 'fil_ph', 'nb_no', 'ja_jp', '_x']))
SELECT folder, code, coalesce(code IN ('zh', 'ja', 'th', 'lo', 'my', 'km'), false) AS by_character FROM (SELECT folder, CASE folder WHEN 'cmn_hans_cn' THEN 'zh' WHEN 'yue_hant_hk' THEN 'zh' WHEN 'fil_ph' THEN 'tl' WHEN 'nb_no' THEN 'no' ELSE nullif(split_part(folder, '_', 1), '') END AS code FROM f)""")
def language_codes(spark, sf_dir):
    """Language codes of folders, and whether the language is scored by character."""
    docs = s.table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("_"), "source").alias("folder"))
    named = spark.createDataFrame([(x,) for x in ("cmn_hans_cn", "yue_hant_hk", "fil_ph", "nb_no", "ja_jp", "_x")], "folder string")
    out = docs.union(named).where("folder IS NOT NULL").distinct().withColumn("code", curate.checkpoint_language(F.col("folder")))
    return out.withColumn("by_character", F.coalesce(F.col("code").isin(*metrics.BY_CHARACTER), F.lit(False)))


@query(f"{M} SELECT seq, CASE WHEN task = 'translate' AND translation <> '' THEN translation ELSE text END AS target FROM manifest")
def target_text(spark, sf_dir):
    rows = s.manifest(spark, sf_dir)
    return rows.select("seq", curate.target_text(rows).alias("target"))


SPLIT = f"""{M}, speakers AS (SELECT source, speaker, row_number() OVER (ORDER BY md5('20260301:' || coalesce(source, '') || ':' || coalesce(speaker, ''))) AS r, count(*) OVER () AS total FROM (SELECT DISTINCT source, speaker FROM manifest)),
lab AS (SELECT source, speaker, CASE WHEN r <= greatest(total // 100, 1) THEN 'dev' WHEN r <= 2 * greatest(total // 100, 1) THEN 'test' ELSE 'train' END AS split FROM speakers),
rows_ AS (SELECT m.*, split FROM manifest m JOIN lab USING (source, speaker))"""


@query(f"{SPLIT} SELECT seq, split FROM rows_")
def speaker_split(spark, sf_dir):
    """Train, dev and test without a speaker in two of them."""
    return order.speaker_split(s.manifest(spark, sf_dir), 20260301).select("seq", "split")


@query(f"{SPLIT} SELECT split, language, task, count(*) AS utterances, sum(duration) / 3600 AS hours FROM rows_ GROUP BY GROUPING SETS ((split), (split, language), (split, task))")
def split_report(spark, sf_dir):
    """Utterances and hours by split, by language and by task, in one pass."""
    return curate.split_stats(order.speaker_split(s.manifest(spark, sf_dir), 20260301), "split").drop("level")


@query(f"{SPLIT} SELECT count(*) AS shared FROM (SELECT source, speaker FROM rows_ WHERE split = 'train' INTERSECT SELECT source, speaker FROM rows_ WHERE split <> 'train')")
def split_overlap(spark, sf_dir):
    """Speakers that are in training and elsewhere: none."""
    rows = order.speaker_split(s.manifest(spark, sf_dir), 20260301)
    return rows.where("split = 'train'").select("source", "speaker").intersect(rows.where("split <> 'train'").select("source", "speaker")).agg(F.count("*").alias("shared"))


@query(f"{M} SELECT seq, row_number() OVER (ORDER BY md5('7:' || CAST(seq AS VARCHAR))) AS rank FROM manifest")
def seeded_shuffle(spark, sf_dir):
    """Every utterance's place in a seeded order, without one task seeing all."""
    return order.shuffled(s.manifest(spark, sf_dir).select("seq"), 7, "seq")


@query(f"{M}, r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY seq) - 1 AS k FROM manifest) SELECT seq, language, k // 2048 AS shard, k % 2048 AS pos, CAST(duration * 16000 AS BIGINT) AS samples FROM r")
def shard_metadata(spark, sf_dir):
    """Shard, place and sample count of each utterance, numbered within its language."""
    rows = readers.sharded(s.manifest(spark, sf_dir), "seq", readers.SHARD_ROWS, "language")
    return rows.select("seq", "language", "shard", "pos", F.rint(F.col("duration") * 16000).cast("long").alias("samples"))


AUDIO = "audio AS (SELECT audio_path, duration AS seconds FROM manifest WHERE duration >= 2)"


def _audio(rows):
    """Clips of under two seconds have no file."""
    return rows.where("duration >= 2").select("audio_path", F.col("duration").alias("seconds"))


@query(f"{M}, {AUDIO} SELECT seq, seconds FROM manifest JOIN audio USING (audio_path)")
def audio_join_skip(spark, sf_dir):
    """Utterances that have audio; the audio brings the duration."""
    rows = s.manifest(spark, sf_dir)
    return readers.with_audio(rows.drop("duration"), _audio(rows)).select("seq", "seconds")


@query(f"{M}, {AUDIO} SELECT seq FROM manifest ANTI JOIN audio USING (audio_path)")
def audio_missing(spark, sf_dir):
    """Utterances without audio, which evaluation refuses."""
    rows = s.manifest(spark, sf_dir)
    return rows.join(_audio(rows), "audio_path", "left_anti").select("seq")


@query(f"""{M}, sources(source, url, kind) AS (SELECT 'src' || i, 'https://data.example/' || i, CASE WHEN i % 2 = 0 THEN 'transcribe' ELSE 'translate' END FROM range(20) t(i))
SELECT source, url, kind, count(*) AS n FROM manifest JOIN sources USING (source) GROUP BY ALL""")
def source_catalog(spark, sf_dir):
    """Utterances by source, with the catalog's columns; counted before the join."""
    i = F.col("id").cast("string")
    catalog = spark.range(20).select(F.concat(F.lit("src"), i).alias("source"), F.concat(F.lit("https://data.example/"), i).alias("url"), F.when(F.col("id") % 2 == 0, "transcribe").otherwise("translate").alias("kind"))
    counts = s.manifest(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(catalog), "source").select("source", "url", "kind", "n")  # twenty rows


SPELL = "(VALUES ('the', 'THE'), ('que', 'QUE'), ('und', 'UND')) v(w, to_)"
MAP = {"the": "THE", "que": "QUE", "und": "UND"}


@query(f"""{M} SELECT seq, coalesce((SELECT string_agg(coalesce(v.to_, x.w), ' ' ORDER BY x.i) FROM (SELECT unnest({WORDS.format(c='m.text')}) AS w, generate_subscripts({WORDS.format(c='m.text')}, 1) AS i) x LEFT JOIN {SPELL} USING (w)), '') AS spelled FROM manifest m""")
def spelling_map(spark, sf_dir):
    """Words replaced by a small map; other words stay."""
    return s.manifest(spark, sf_dir).select("seq", textnorm.spelling(F.col("text"), MAP).alias("spelled"))


@query(f"{M}, r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY seq) - 1 AS k FROM manifest) SELECT a.seq, b.duration FROM r a JOIN r b ON a.language = b.language AND a.k = b.k")
def positional_zip(spark, sf_dir):
    """Audio rows and metadata rows joined by shard and place."""
    rows = readers.sharded(s.manifest(spark, sf_dir), "seq", readers.SHARD_ROWS, "language")
    return rows.select("language", "shard", "pos", "seq").join(rows.select("language", "shard", "pos", "duration"), ["language", "shard", "pos"]).select("seq", "duration")


@query("SELECT a.vec_id, list_sum(list_transform(a.embedding, lambda x: abs(x)::DOUBLE)) - list_sum(list_transform(a.embedding, lambda x: abs(x::FLOAT)::DOUBLE)) AS diff FROM embeddings a JOIN embeddings b USING (vec_id) WHERE a.embedding = b.embedding")
def tensor_parity(spark, sf_dir):
    """Arrays that agree with their stored copy, by name."""
    e = s.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select("vec_id", F.col("embedding").alias("copy")), "vec_id").where("embedding = copy")
    total = lambda c: F.aggregate(F.transform(c, lambda x: F.abs(x).cast("double")), F.lit(0.0), lambda a, x: a + x)
    return both.select("vec_id", (total("embedding") - total("copy")).alias("diff"))


@query(f"{M}, r AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS k FROM manifest) SELECT seq FROM r WHERE k % 9 = 0")
def systematic_sample(spark, sf_dir):
    """Rows 0, 9, 18 ... in order."""
    return order.every_kth(s.manifest(spark, sf_dir).select("seq"), "seq", 9)


@query(f"{M}, r AS (SELECT seq, row_number() OVER (ORDER BY seq) AS k FROM manifest) SELECT seq FROM r WHERE k % 9 = 0")
def systematic_sample_late(spark, sf_dir):
    """Rows 8, 17, 26 ... in order: the research form."""
    return order.every_kth(s.manifest(spark, sf_dir).select("seq"), "seq", 9, first=False)


@query("SELECT page_id, url FROM pages ORDER BY string_split(url, '/')")
def sorted_paths(spark, sf_dir):
    return order.by_path(s.table(spark, sf_dir, "pages").select("page_id", "url"), "url")


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def retain_last(spark, sf_dir):
    """The three latest events of each user, as checkpoints are kept."""
    return order.last_k(s.table(spark, sf_dir, "events"), "event_id", 3, "user_id").select("user_id", "event_id", "ts")


@query(f"{M} SELECT language, count(*) AS n FROM (SELECT language FROM manifest UNION ALL SELECT lang FROM documents) GROUP BY language")
def union_sources(spark, sf_dir):
    """Rows of several sources put together, none dropped."""
    both = s.manifest(spark, sf_dir).select("language").unionByName(s.table(spark, sf_dir, "documents").select(F.col("lang").alias("language")))
    return both.groupBy("language").agg(F.count("*").alias("n"))


@query(f"{M} SELECT source, count(DISTINCT speaker) AS speakers, count(DISTINCT language) AS languages FROM manifest GROUP BY source")
def distinct_speakers(spark, sf_dir):
    return s.manifest(spark, sf_dir).groupBy("source").agg(F.countDistinct("speaker").alias("speakers"), F.countDistinct("language").alias("languages"))


@query("SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def segment_concat(spark, sf_dir):
    """Non-empty segment texts in order, joined by spaces."""
    turns = s.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim("text").alias("text")).where("text <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


@query(f"{M} SELECT translate(seq::VARCHAR || chr(9) || text, chr(9), ' ') AS row_ FROM manifest")
def hypothesis_rows(spark, sf_dir):
    """Tab-separated cells with tabs within them made spaces."""
    return s.manifest(spark, sf_dir).select(F.translate(F.concat(F.col("seq").cast("string"), F.lit("\t"), "text"), "\t", " ").alias("row_"))


PIECE = "regexp_extract_all(translate({c}, chr(9), ' '), ' ?\\p{{L}}+')"


@query(f"{M}, p AS (SELECT unnest(regexp_extract_all(text, '\\p{{L}}+')) AS piece FROM manifest UNION ALL SELECT unnest(regexp_extract_all(translation, '\\p{{L}}+')) FROM manifest) SELECT piece, count(*) AS n FROM p GROUP BY piece")
def letter_piece_counts(spark, sf_dir):
    """Counts of the letter runs of text and translation."""
    rows = s.manifest(spark, sf_dir)
    runs = F.concat(*[F.regexp_extract_all(c, F.lit(r"(\p{L}+)"), F.lit(1)) for c in ("text", "translation")])
    return rows.select(F.explode(runs).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


# The other engine has no look-ahead: a mark before the last of several white spaces that text follows stands for it.
MARKED = "regexp_replace({c}, '(\\s+)(\\s)(\\S)', '\\1' || chr(57344) || '\\2\\3', 'g')"
PRETOKENS = "regexp_extract_all(" + MARKED + ", '''s|''t|''re|''ve|''m|''ll|''d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^\\s\\p{{L}}\\p{{N}}\\x{{E000}}]+|\\s+')"


@query(f"{M}, p AS (SELECT unnest({PRETOKENS.format(c='text')}) AS piece FROM manifest UNION ALL SELECT unnest({PRETOKENS.format(c='translation')}) FROM manifest WHERE translation <> '') SELECT piece, count(*) AS n FROM p GROUP BY piece")
def word_frequencies(spark, sf_dir):
    """Counts of all pre-tokens of text and translation."""
    return tokens.word_frequencies(s.manifest(spark, sf_dir))


PAIRS = "w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM w GROUP BY w), p AS (SELECT w[i] AS a, w[i + 1] AS b, n FROM (SELECT w, n, unnest(range(1, length(w))) AS i FROM c))"


def _words(spark, sf_dir):
    runs = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    counts = s.table(spark, sf_dir, "documents").select(F.explode(runs).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return counts.select(F.split("w", "").alias("symbols"), "n")


@query(f"WITH {PAIRS} SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY a, b")
def pair_counts(spark, sf_dir):
    """Counts of adjacent letters over distinct words, weighted by the words' counts."""
    return tokens.pair_counts(_words(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY a, b ORDER BY n DESC, a, b LIMIT 1")
def top_pair(spark, sf_dir):
    return tokens.top_pair(tokens.pair_counts(_words(spark, sf_dir)))


# Sequences as strings of one byte a unit, by a unit's place among a pair's distinct ones (fewer than 127 in a
# stretch): the other engine's edit distance counts bytes.
CODED = "array_to_string(list_transform({x}, lambda u: chr(CAST(list_position({d}, u) AS INT))), '')"
RATED = f"""{M}, {s.PAIRS_SQL},
u AS (SELECT *, {WORDS.format(c='reference')} AS rw, {WORDS.format(c='hypothesis')} AS hw, regexp_extract_all(regexp_replace(reference, '[\\s\\p{{Z}}]+', '', 'g'), '(?s).') AS rc, regexp_extract_all(regexp_replace(hypothesis, '[\\s\\p{{Z}}]+', '', 'g'), '(?s).') AS hc FROM pairs),
d AS (SELECT *, list_distinct(rw || hw) AS dw, list_distinct(rc || hc) AS dc FROM u),
rated AS (SELECT seq, part, language, source, reference, hypothesis, len(rw) AS words, len(rc) AS chars, levenshtein({CODED.format(x='rw', d='dw')}, {CODED.format(x='hw', d='dw')}) AS edits, levenshtein({CODED.format(x='rc', d='dc')}, {CODED.format(x='hc', d='dc')}) AS char_edits FROM d)"""
RATES = "CASE WHEN sum(words) > 0 THEN sum(edits) / sum(words)::DOUBLE ELSE 0 END AS wer, CASE WHEN sum(chars) > 0 THEN sum(char_edits) / sum(chars)::DOUBLE ELSE 0 END AS cer, count(*) AS n"


@query(f"{RATED} SELECT source, {RATES} FROM rated GROUP BY source")
def corpus_wer(spark, sf_dir):
    """Pooled word and character error rates by source."""
    return metrics.corpus_rates(s.pairs(spark, sf_dir), "source")


@query(f"{RATED}, g AS (SELECT language, {RATES} FROM rated GROUP BY language) SELECT language, CASE WHEN language IN ('zh', 'ja', 'th', 'lo', 'my', 'km') THEN 'cer' ELSE 'wer' END AS metric, CASE WHEN language IN ('zh', 'ja', 'th', 'lo', 'my', 'km') THEN cer ELSE wer END AS value, n FROM g")
def language_metric(spark, sf_dir):
    return metrics.language_metric(s.pairs(spark, sf_dir))


@query(f"{RATED}, w AS (SELECT edits / words::DOUBLE AS wer FROM rated WHERE words > 0) SELECT count(*) FILTER (wer = 0) AS exact, count(*) FILTER (wer > 0 AND wer <= 0.1) AS near, count(*) FILTER (wer > 0.1 AND wer <= 0.5) AS degraded, count(*) FILTER (wer > 0.5) AS failed FROM w")
def error_buckets(spark, sf_dir):
    return metrics.error_buckets(metrics.utterance_rates(s.pairs(spark, sf_dir)))


@query(f"{RATED} SELECT seq, part, reference, hypothesis, edits / words::DOUBLE AS wer FROM rated WHERE words > 0 ORDER BY wer DESC, seq, part LIMIT 10")
def worst_examples(spark, sf_dir):
    """The ten utterances of largest error rate."""
    return metrics.worst_examples(metrics.utterance_rates(s.pairs(spark, sf_dir)), "seq", "part").select("seq", "part", "reference", "hypothesis", "wer")


@query("""SELECT conv_id, turn, length(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', '', 'g')) AS chars, CAST(len(list_filter(string_split(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g'), ' '), lambda w: w <> '')) AS BIGINT) AS words FROM conversations""")
def unit_counts(spark, sf_dir):
    """Reference characters and words: the denominators of error rates."""
    c = F.col("text")
    return s.table(spark, sf_dir, "conversations").select("conv_id", "turn", metrics.n_chars(c).alias("chars"), metrics.n_words(c).alias("words"))


@query("SELECT w, regexp_full_match(w, '[0-9]+(\\.[0-9]+)?') AS numeric FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents)")
def numeric_words(spark, sf_dir):
    words = s.table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    return words.select("w", textnorm.is_numeric(F.col("w")).alias("numeric"))


@query(f"{M} SELECT seq, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[<\\[][^>\\]]*[>\\]]', '', 'g'), '\\(([^)]+?)\\)', '', 'g'), '[\\p{{M}}\\p{{S}}\\p{{P}}]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS text FROM manifest")
def normalize_basic(spark, sf_dir):
    """The basic normalizer; the SQL holds for composed text without compatibility forms."""
    return s.manifest(spark, sf_dir).select("seq", textnorm.basic("text").alias("text"))


@query(f"{M} SELECT seq, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[<\\[][^>\\]]*[>\\]]', '', 'g'), '\\(([^)]+?)\\)', '', 'g'), '[\\p{{M}}\\p{{S}}\\p{{P}}]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS text FROM manifest")
def normalize_basic_columns(spark, sf_dir):
    """The basic normalizer in column expressions."""
    return s.manifest(spark, sf_dir).select("seq", textnorm.basic_ascii(F.col("text")).alias("text"))


@query()
def normalize_english(spark, sf_dir):
    return s.manifest(spark, sf_dir).select("seq", textnorm.english("text").alias("text"))


@query()
def english_lite(spark, sf_dir):
    return s.manifest(spark, sf_dir).select("seq", textnorm.lite("text").alias("text"))


@query()
def english_numbers(spark, sf_dir):
    return s.manifest(spark, sf_dir).select("seq", textnorm.numbers(F.lower("text")).alias("text"))


# The symbols kept go by characters of no kind meanwhile.
KEPT = "chr(57344) || chr(57345) || chr(57346) || chr(57347) || chr(57348) || chr(57349)"
PLAIN = "replace(replace(replace(replace(text, 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'ø', 'o')"


@query(f"{M} SELECT seq, translate(regexp_replace(translate(strip_accents({PLAIN}), '{textnorm.KEPT_SYMBOLS}', {KEPT}), '[\\p{{M}}\\p{{S}}\\p{{P}}]', ' ', 'g'), {KEPT}, '{textnorm.KEPT_SYMBOLS}') AS text FROM manifest")
def plain_letters(spark, sf_dir):
    """Text without diacritics and symbols."""
    return s.manifest(spark, sf_dir).select("seq", textnorm.diacritics("text").alias("text"))
