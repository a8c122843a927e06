"""Byte-level BPE, pre-tokens, counts, and multitask token sequences."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

# fixed values: the pre-token expression, and the special tokens in id order
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
AFTER_LANGUAGES = ("translate", "transcribe", "startoflm", "startofprev", "nospeech", "notimestamps")
#: Ids of a target sequence at most.
TEXT_CONTEXT = 448
#: Pieces a worker remembers; bytes of distinct pieces that the driver merges by itself, beyond which Spark merges.
KNOWN, DRIVER_BYTES = 100_000, 64 << 20
N_LANGUAGES, N_TIMESTAMPS, TICK = 99, 1501, 0.02
#: Language codes of the evaluation data; a run of N_LANGUAGES ids is reserved for them and others.
LANGUAGES = ("en", "de", "fr", "es")


def pretokens(c: Column) -> Column:
    """Array of pre-tokens; their concatenation is the text."""
    return F.regexp_extract_all(c, F.lit(f"({PRETOKEN})"), F.lit(1))


def word_frequencies(manifest: DataFrame) -> DataFrame:
    """(piece, n) over text and non-empty translation; counts combine before the shuffle."""
    both = F.concat(pretokens(F.coalesce("text", F.lit(""))), F.when(F.coalesce("translation", F.lit("")) != "", pretokens(F.col("translation"))).otherwise(F.array().cast("array<string>")))
    return manifest.select(F.explode(both).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(a, b, n) of adjacent symbols over words (symbols array, n), overlaps counted."""
    pairs = F.expr("transform(sequence(1, greatest(size(symbols) - 1, 1)), i -> struct(symbols[i - 1] AS a, symbols[i] AS b))")
    return words.where(F.size("symbols") > 1).select(F.explode(pairs).alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def top_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; equals by symbols."""
    return pairs.orderBy(F.desc("n"), "a", "b").limit(1)


@lru_cache(1)
def byte_units() -> tuple[str, ...]:
    """The printable character that stands for each byte: itself where printable,
    else the next free one from U+0100."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return tuple(chr(b) if b in set(printable) else chr(next(rest)) for b in range(256))


def to_units(text: str) -> str:
    table = byte_units()
    return "".join(table[b] for b in text.encode())


def from_units(units: str) -> str:
    back = {u: b for b, u in enumerate(byte_units())}
    return bytes(back[u] for u in units).decode("utf-8", "replace")


def train_bpe(counts: dict[str, int], vocab_size: int) -> tuple[list[str], list[tuple[str, str]]]:
    """(base symbols, merges) from counts of unit strings.

    The most frequent pair merges first, equal counts by the pair itself; it ends
    at vocab_size, or when no pair occurs twice. Only words that hold the merged
    pair are counted anew.
    """
    words = [(list(w), n) for w, n in sorted(counts.items())]
    base = sorted({u for w, _ in words for u in w})
    count: Counter = Counter()
    where = defaultdict(set)
    for k, (w, n) in enumerate(words):
        for pair in zip(w, w[1:]):
            count[pair] += n
            where[pair].add(k)
    merges: list[tuple[str, str]] = []
    while len(base) + len(merges) < vocab_size and count:
        pair, n = min(count.items(), key=lambda x: (-x[1], x[0]))
        if n < 2:
            break
        merges.append(pair)
        for k in sorted(where.pop(pair)):
            w, times = words[k]
            for old in zip(w, w[1:]):
                count[old] -= times
                if count[old] <= 0:
                    del count[old]
            words[k] = (w := merged(w, pair), times)
            for new in zip(w, w[1:]):
                count[new] += times
                where[new].add(k)
    return base, merges


def merged(word: list[str], pair: tuple[str, str]) -> list[str]:
    out: list[str] = []
    it = iter(range(len(word)))
    for i in it:
        if tuple(word[i : i + 2]) == pair:
            out.append(word[i] + word[i + 1])
            next(it)
        else:
            out.append(word[i])
    return out


class Bpe:
    """Encoder and decoder; ids are dense over distinct symbols, base symbols first."""

    def __init__(self, base: list[str], merges: list[tuple[str, str]]):
        self.merges = merges
        self.symbols = list(dict.fromkeys([*base, *(a + b for a, b in merges)]))
        self.ids = {s: i for i, s in enumerate(self.symbols)}
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.known: dict[str, list[int]] = {}  # KNOWN pieces at most

    def split(self, units: str) -> list[str]:
        """Lowest-ranked pair first, leftmost among equals; a heap holds the pairs of
        neighbours, so long pieces take little more time than their length."""
        word, after = list(units), list(range(1, len(units) + 1))
        before = list(range(-1, len(units) - 1))
        heap = [(self.rank[pair], i) for i, pair in enumerate(zip(word, word[1:])) if pair in self.rank]
        heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(word) and (rank := self.rank.get((word[i], word[after[i]]))) is not None:
                heappush(heap, (rank, i))

        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if not word[i] or j >= len(word) or self.rank.get((word[i], word[j])) != rank:
                continue  # one of the two has merged since
            word[i], word[j], after[i] = word[i] + word[j], "", after[j]
            if after[i] < len(word):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [w for w in word if w]

    def encode(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p not in self.known:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[p] = [self.ids[s] for s in self.split(to_units(p))]
            out += self.known[p]
        return out

    def decode(self, ids: list[int]) -> str:
        return from_units("".join(self.symbols[i] for i in ids if 0 <= i < len(self.symbols)))


def trained(spark: SparkSession, manifest: DataFrame, vocab_size: int, driver_bytes: int = DRIVER_BYTES) -> Bpe:
    """Counts words in the cluster and merges over distinct words: on the driver while
    they are driver_bytes at most, else in the cluster, with the same merges.
    All bytes are base symbols, so any text can be encoded."""
    words = word_frequencies(manifest)
    size = words.agg(F.coalesce(F.sum(F.octet_length("piece") + 16), F.lit(0))).first()[0]
    if size > driver_bytes:
        merges = train_in_rounds(words, vocab_size)
        return Bpe(sorted(byte_units()), merges)
    counts = {to_units(r.piece): r.n for r in words.toLocalIterator()}
    base, merges = train_bpe(counts, max(0, vocab_size - 256) + len({u for w in counts for u in w}))
    return Bpe(sorted({*byte_units(), *base}), merges)


def units_of(c: Column) -> Column:
    """The units of a text's bytes, as an array."""
    table = F.lit(list(byte_units()))
    return F.transform(F.split(F.hex(F.encode(c, "UTF-8")), "(?<=\\G..)(?=.)"), lambda h: F.element_at(table, F.conv(h, 16, 10).cast("int") + 1))


def train_in_rounds(words: DataFrame, vocab_size: int) -> list[tuple[str, str]]:
    """The merges of train_bpe, one round of counting in the cluster for each: for
    more distinct words (piece, n) than a driver holds. Words that are one symbol
    drop out; the words are checkpointed after each round, so plans stay small."""
    left = words.where("piece <> ''").select(units_of(F.col("piece")).alias("symbols"), "n").where(F.size("symbols") > 1).checkpoint()
    merges: list[tuple[str, str]] = []
    while len(merges) < vocab_size - 256:
        top = top_pair(pair_counts(left)).first()
        if top is None or top.n < 2:
            break
        merges.append((top.a, top.b))
        a, b = F.lit(top.a), F.lit(top.b)
        empty = F.array().cast("array<string>")
        # held: the symbol that may yet merge with the next
        step = lambda s, x: F.when((s["held"] == a) & (x == b), F.struct(F.concat(s["done"], F.array(F.concat(a, b))).alias("done"), F.lit("").alias("held"))).otherwise(F.struct(F.when(s["held"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["held"]))).alias("done"), x.alias("held")))
        end = lambda s: F.when(s["held"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["held"])))
        folded = F.aggregate("symbols", F.struct(empty.alias("done"), F.lit("").alias("held")), step, end)
        left = left.withColumn("symbols", F.when(F.array_contains("symbols", a) & F.array_contains("symbols", b), folded).otherwise(F.col("symbols"))).where(F.size("symbols") > 1).checkpoint()
    return merges


def encoder(bpe: Bpe):
    """Vectorized encoding of arrays of pre-tokens."""
    state = (bpe.symbols[: len(bpe.symbols)], bpe.merges)

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Bpe(*state)
        for s in batches:
            yield s.map(lambda p: None if p is None else own.encode(list(p)))

    return run


def decoder(bpe: Bpe):
    state = (bpe.symbols, bpe.merges)

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Bpe(*state)
        for s in batches:
            yield s.map(lambda i: None if i is None else own.decode(list(i)))

    return run


def layout(n_base: int, languages: tuple[str, ...] = LANGUAGES) -> dict[str, int]:
    """Ids of the special tokens after n_base symbols, and where the runs begin."""
    ids = {"eot": n_base, "sot": n_base + 1, "language_begin": n_base + 2}
    ids |= {f"lang:{code}": n_base + 2 + k for k, code in enumerate(languages)}
    ids |= {name: n_base + 2 + N_LANGUAGES + k for k, name in enumerate(AFTER_LANGUAGES)}
    ids["timestamp_begin"] = ids["notimestamps"] + 1
    return ids | {"n_vocab": ids["timestamp_begin"] + N_TIMESTAMPS}


def special_tokens(spark: SparkSession, n_base: int, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(id, content) of all special tokens, timestamps included."""
    ids = layout(n_base, languages)
    named = {"<|endoftext|>": ids["eot"], "<|startoftranscript|>": ids["sot"]} | {f"<|{c}|>": ids[f"lang:{c}"] for c in languages} | {f"<|{c}|>": ids[c] for c in AFTER_LANGUAGES}
    table = spark.createDataFrame([(i, c) for c, i in named.items()], "id int, content string")
    stamps = spark.range(N_TIMESTAMPS).select((F.col("id") + ids["timestamp_begin"]).cast("int").alias("id"), F.format_string("<|%.2f|>", F.col("id") * TICK).alias("content"))
    return table.unionByName(stamps)


def timestamp_token(seconds: Column, ids: dict[str, int]) -> Column:
    """Nearest tick, halves to even."""
    return (F.rint(seconds / TICK) + ids["timestamp_begin"]).cast("int")


def timestamp_seconds(token: Column, ids: dict[str, int]) -> Column:
    return (token - ids["timestamp_begin"]) * TICK


def start_sequence(language: Column, task: Column, ids: dict[str, int], timestamps: bool = False) -> Column:
    by_code = F.create_map(*[F.lit(x) for k, v in ids.items() if k.startswith("lang:") for x in (k[5:], v)])
    head = [F.lit(ids["sot"]), F.element_at(by_code, language), F.when(task == "translate", ids["translate"]).otherwise(ids["transcribe"])]
    return F.array(*head, *([] if timestamps else [F.lit(ids["notimestamps"])]))


def target_sequence(language: Column, task: Column, body: Column, ids: dict[str, int], timestamps: bool = False, longest: int | None = None) -> Column:
    """start, body, end; cut to `longest` ids where given."""
    seq = F.concat(start_sequence(language, task, ids, timestamps), body, F.array(F.lit(ids["eot"])))
    return F.slice(seq, 1, longest) if longest else seq


def grammar_check(seq: Column, ids: dict[str, int]) -> Column:
    """"ok" or the first thing wrong with a token sequence."""
    stamps = F.filter(seq, lambda t: t >= ids["timestamp_begin"])
    falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size(stamps) - 1, F.lit(1))), lambda i: F.get(stamps, i) < F.get(stamps, i - 1))
    return (
        F.when(~F.coalesce(F.get(seq, F.lit(0)) == ids["sot"], F.lit(False)), "missing sot")
        .when(~F.coalesce(F.get(seq, F.lit(1)).between(ids["language_begin"], ids["language_begin"] + N_LANGUAGES - 1), F.lit(False)), "missing language")
        .when(~F.coalesce(F.get(seq, F.lit(2)).isin(ids["translate"], ids["transcribe"]), F.lit(False)), "missing task")
        .when(F.element_at(seq, -1) != ids["eot"], "missing eot")
        .when(F.size(stamps) % 2 != 0, "unpaired timestamps")
        .when(F.coalesce(falls, F.lit(False)), "decreasing timestamps")
        .otherwise("ok")
    )


def padded(df: DataFrame, seq: str, pad_id: int, *batch: str) -> DataFrame:
    """Sequences of each batch padded to its longest, with a mask of real places."""
    longest = df.groupBy(*batch).agg(F.max(F.size(seq)).alias("__n"))
    out = df.join(longest, list(batch))
    pads = F.array_repeat(F.lit(pad_id), F.col("__n") - F.size(seq))
    mask = F.concat(F.transform(F.col(seq), lambda _: F.lit(True)), F.transform(pads, lambda _: F.lit(False)))
    return out.withColumn("mask", mask).withColumn(seq, F.concat(seq, pads)).drop("__n")


def tokenizer_json(bpe: Bpe, languages: tuple[str, ...] = LANGUAGES) -> str:
    ids = layout(len(bpe.symbols), languages)
    named = [(ids["eot"], "<|endoftext|>"), (ids["sot"], "<|startoftranscript|>")] + [(ids[f"lang:{c}"], f"<|{c}|>") for c in languages] + [(ids[c], f"<|{c}|>") for c in AFTER_LANGUAGES]
    named += [(ids["timestamp_begin"] + k, f"<|{k * TICK:.2f}|>") for k in range(N_TIMESTAMPS)]
    model = {"type": "BPE", "vocab": bpe.ids, "merges": [" ".join(m) for m in bpe.merges]}
    return json.dumps({"model": model, "added_tokens": [{"id": i, "content": c, "special": True} for i, c in sorted(named)]}, ensure_ascii=False)


def language_run(added: DataFrame) -> DataFrame:
    """(id, tag): the tokens right after <|startoftranscript|>, without a gap,
    whose content is two or three lower-case letters."""
    start = added.where("content = '<|startoftranscript|>'").agg(F.max("id").alias("sot")).withColumn("one", F.lit(1))
    tags = added.withColumn("one", F.lit(1)).join(F.broadcast(start), "one").where(F.col("id") > F.col("sot"))  # one row: the start token
    tags = tags.where(F.col("content").rlike(r"\A<\|[a-z]{2,3}\|>\z"))
    run = tags.withColumn("k", F.row_number().over(Window.partitionBy("sot").orderBy("id")))
    return run.where(F.col("id") == F.col("sot") + F.col("k")).select("id", F.regexp_replace("content", r"<\||\|>", "").alias("tag"))
