"""Language ID by a linear-chain conditional random field.

Each word is labelled with a language: word, affix and character n-gram features
hashed to weights, a lexicon of words that one language owns, and learned
transitions. Forward-backward gives each word's probabilities; a document's
language is the one with the largest share of its words. So code-switched text
is labelled word by word.

A document is one chain, however long. Its messages are first passed within runs
of RUN words, all runs at once, then carried on over each border until they
agree with what is there. A word is at most WORD_LETTERS letters: longer runs of
letters, as in scripts without spaces, are several words, and every letter is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import util

U64 = np.uint64
WORD_LETTERS, AFFIX, RUN = 24, 4, 128
#: Words of letters, lower-cased; what isn't a letter parts words.
WORD = re.compile(rf"[^\W\d_]{{1,{WORD_LETTERS}}}")
#: Weights: features times languages at most; features at most.
CELLS, DIMS = 1 << 24, 1 << 18
#: Documents fitted on: of each language, and in all languages, at most; chains of TRAIN_CHAIN words of each.
SAMPLE_DOCS, SAMPLE_TOTAL, SAMPLE_CHAINS, TRAIN_CHAIN = 200, 40_000, 3, 48
EPOCHS, BATCH, RATE, RIDGE, SWITCHED = 4, 48, 0.3, 1e-5, 0.3
#: The lexicon: words so often in the sample, so purely in one language.
LEXICON_COUNT, LEXICON_SHARE = 3, 0.9
UNKNOWN = "und"
#: Messages that differ by no more agree.
AGREE = 1e-6


def dims_for(n_langs: int) -> int:
    """Features hashed to, a power of two: DIMS, fewer where languages are many."""
    return min(DIMS, max(1 << 12, 1 << max(1, CELLS // max(1, n_langs)).bit_length() - 1))


def features(words: list, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of distinct words, 0 where there is none: a row for each
    word (itself, its affixes), a row for each character (the block it is of, the
    n-grams from it), and where each word's characters begin."""
    n = len(words)
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    size = np.fromiter(map(len, words), np.int64, n)
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(len(chars))

    def gram(at: np.ndarray, step: int, k: int, kind: int, ok: np.ndarray) -> np.ndarray:
        """Hashes of k characters from each place, onwards or backwards."""
        h = np.full(len(at), kind, U64)
        for j in range(k):
            h = (h ^ chars[np.where(ok, at + step * j, 0)]) * U64(0x9E3779B97F4A7C15)
            h ^= h >> U64(29)
        return np.where(ok, h, U64(0))

    whole, every = [util.hash_words(words)], np.arange(len(chars))
    for k in range(1, AFFIX + 1):
        whole += [gram(start, 1, k, 100 + k, size >= k), gram(start + size - 1, -1, k, 200 + k, size >= k)]
    block = (chars >> U64(7)) * U64(0x9E3779B97F4A7C15) + U64(1)
    inner = [block, gram(every, 1, 2, 302, left >= 2), gram(every, 1, 3, 303, left >= 3)]
    number = lambda hs: np.where(h == 0, 0, 1 + util.mix(h) % U64(dims - 1)).astype(np.int64) if (h := np.stack(hs, axis=1)).size else np.zeros((0, len(hs)), np.int64)
    return number(whole), number(inner), start


@dataclass
class Model:
    """langs, weights (DIMS, K), transitions (K, K) by from and to, lexicon word -> K."""

    langs: list
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict
    lexicon_weight: float

    def emissions(self, words: list) -> np.ndarray:
        """(words, K): scores of distinct words, by slices to bound memory."""
        out = np.empty((len(words), len(self.langs)), np.float32)
        step = max(256, 80_000 // max(4, len(self.langs)))
        for a in range(0, len(words), step):
            whole, inner, start = features(words[a : a + step], len(self.weights))
            by_char = np.zeros((len(inner), len(self.langs)), np.float32)
            for column in inner.T:
                by_char += self.weights[column]
            e = np.add.reduceat(by_char, start, axis=0)
            for column in whole.T:
                e += self.weights[column]
            out[a : a + step] = e
        for k, w in enumerate(words):
            if (owner := self.lexicon.get(w)) is not None:
                out[k, owner] += self.lexicon_weight
        return out


def messages(x: np.ndarray, t: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Forward messages of all words of chains that lie one after another in x
    (words, K), each chain from `begin` on of `size` words; each sums to 1."""
    count = -(-size // RUN)
    chain = np.repeat(np.arange(len(size)), count)
    first = begin[chain] + RUN * (np.arange(len(chain)) - (np.cumsum(count) - count)[chain])
    end = (begin + size)[chain]
    out = np.empty_like(x)
    if not len(first):
        return out
    # every run as if it began a chain, the longest first
    live = np.argsort(first - np.minimum(first + RUN, end), kind="stable")
    rows, stop = first[live], np.minimum(first + RUN, end)[live]
    f = x[rows]
    while True:
        f = f / f.sum(axis=1, keepdims=True)
        out[rows] = f
        n = np.count_nonzero(rows + 1 < stop)
        if not n:
            break
        rows, stop = rows[:n] + 1, stop[:n]
        f = (f[:n] @ t) * x[rows]
    # from each border on, until the messages agree; a correction may run over further borders
    later = first > begin[chain]
    rows, end = first[later], end[later]
    while len(rows):
        f = (out[rows - 1] @ t) * x[rows]
        f /= f.sum(axis=1, keepdims=True)
        go = (np.abs(f - out[rows]).max(axis=1) > AGREE) & (rows + 1 < end)
        out[rows] = f
        rows, end = rows[go] + 1, end[go]
    return out


def chain_marginals(e: np.ndarray, begin: np.ndarray, size: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """(words, K): label probabilities of every word of chains laid out as in messages."""
    x = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32)
    t = np.exp(transitions - transitions.max()).astype(np.float32)
    p = messages(x, t, begin, size)
    back = messages(x[::-1], t.T, (len(x) - begin - size)[::-1], size[::-1])[::-1]
    inner = np.ones(len(x), bool)
    inner[(begin + size - 1)[size > 0]] = False
    at = np.flatnonzero(inner)
    p[at] *= back[at + 1] @ t.T
    return p / p.sum(axis=1, keepdims=True)


def marginals(e: np.ndarray, length: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Forward-backward over chains e (chains, time, K) of the given lengths:
    each word's label probabilities, and the sum of pair probabilities."""
    n, steps, k = e.shape
    x = np.exp(e - e.max(axis=2, keepdims=True))
    t = np.exp(transitions - transitions.max())
    live = np.arange(steps)[None, :] < length[:, None]
    x[~live] = 1
    fwd, back = np.empty_like(x), np.empty_like(x)
    fwd[:, 0] = x[:, 0]
    fwd[:, 0] /= fwd[:, 0].sum(axis=1, keepdims=True)
    for s in range(1, steps):
        f = (fwd[:, s - 1] @ t) * x[:, s]
        fwd[:, s] = f / f.sum(axis=1, keepdims=True)
    back[:, -1] = 1
    for s in range(steps - 2, -1, -1):
        b = (back[:, s + 1] * x[:, s + 1]) @ t.T
        b /= b.sum(axis=1, keepdims=True)
        back[:, s] = np.where(live[:, s + 1 : s + 2], b, 1)
    p = fwd * back
    p /= p.sum(axis=2, keepdims=True)
    if not pairs:
        return p, None
    total = np.zeros((k, k))
    for s in range(1, steps):
        q = fwd[:, s - 1, :, None] * t[None] * (x[:, s] * back[:, s])[:, None, :]
        q /= q.sum(axis=(1, 2), keepdims=True)
        total += q[live[:, s]].sum(axis=0)
    return p, total


def sampled_chains(text: str, seed: int) -> list:
    """At most SAMPLE_CHAINS stretches of TRAIN_CHAIN words of a text, joined by spaces."""
    words = WORD.findall(text.lower())
    starts = range(0, len(words), TRAIN_CHAIN)
    drawn = np.random.default_rng(seed).permutation(len(starts))[:SAMPLE_CHAINS]
    return [" ".join(words[starts[a] : starts[a] + TRAIN_CHAIN]) for a in drawn]


def fit_chains(rows: list, seed: int = 5) -> Model:
    """rows: (chains, lang) of the documents of a bounded sample."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in rows})
    number = {lang: k for k, lang in enumerate(langs)}
    chains = [(part, [number[lang]] * len(part)) for texts, lang in rows for part in map(str.split, texts)]
    k = len(langs)
    if k < 2 or not chains:
        return Model(langs, np.zeros((2, max(1, k)), np.float32), np.zeros((max(1, k), max(1, k))), {}, 0.0)
    switched = []
    for a in rng.permutation(len(chains))[: int(SWITCHED * len(chains))]:
        b = int(rng.integers(len(chains)))
        (wa, ya), (wb, yb) = chains[a], chains[b]
        cut = int(rng.integers(1, max(2, min(len(wa), len(wb)))))
        switched.append((wa[:cut] + wb[cut:], ya[:cut] + yb[cut:]))
    chains += switched
    flat = [w for ws, _ in chains for w in ws]
    gold = np.array([y for _, ys in chains for y in ys])
    codes, names = pd.factorize(np.array(flat, dtype=object))
    seen = np.zeros((len(names), k))
    np.add.at(seen, (codes, gold), 1)
    pure = (seen.max(axis=1) >= LEXICON_SHARE * seen.sum(axis=1)) & (seen.sum(axis=1) >= LEXICON_COUNT)
    lexicon = {names[i]: int(seen[i].argmax()) for i in np.flatnonzero(pure)}
    owner = np.array([lexicon.get(w, -1) for w in names])
    dims = dims_for(k)
    whole, inner, begin = features(list(names), dims)
    letters = np.fromiter(map(len, names), np.int64, len(names))
    # each distinct word's features, one after another
    of = np.concatenate([np.repeat(np.arange(len(names)), whole.shape[1]), np.repeat(np.arange(len(names)), inner.shape[1] * letters)])
    order = np.argsort(of, kind="stable")
    f = np.concatenate([whole.ravel(), inner.ravel()])[order]
    width = whole.shape[1] + inner.shape[1] * letters
    from_ = np.cumsum(width) - width
    w, g2 = np.zeros((dims, k)), np.full((dims, k), 1e-6)
    t, t2 = np.zeros((k, k)), np.full((k, k), 1e-6)
    lex, lex2 = 0.0, 1e-6
    size = np.array([len(ws) for ws, _ in chains])
    first = np.cumsum(size) - size
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // BATCH)):
            at = [np.arange(first[c], first[c] + size[c]) for c in batch]
            e = np.zeros((len(batch), size[batch].max(), k))
            rows_at = np.concatenate(at)
            here = (np.repeat(np.arange(len(batch)), size[batch]), np.concatenate([np.arange(len(x)) for x in at]))
            words = codes[rows_at]
            distinct, word = np.unique(words, return_inverse=True)
            wide = width[distinct]
            edge = np.cumsum(wide) - wide
            cells = f[np.repeat(from_[distinct] - edge, wide) + np.arange(wide.sum())]
            e[here] = np.add.reduceat(w[cells], edge, axis=0)[word]
            own = owner[words]
            e[here[0][own >= 0], here[1][own >= 0], own[own >= 0]] += lex
            p, pairs = marginals(e, size[batch], t, pairs=True)
            d = p[here]
            d[np.arange(len(d)), gold[rows_at]] -= 1
            for y in at:
                np.add.at(pairs, (gold[y[:-1]], gold[y[1:]]), -1)
            by_word = np.stack([np.bincount(word, d[:, c], len(distinct)) for c in range(k)], axis=1)
            used, inverse = np.unique(cells, return_inverse=True)
            slope = np.repeat(by_word, wide, axis=0)
            g = np.stack([np.bincount(inverse, slope[:, c], len(used)) for c in range(k)], axis=1)
            g = (g + RIDGE * w[used]) * (used > 0)[:, None]
            g2[used] += g**2
            w[used] -= RATE * g / np.sqrt(g2[used])
            t2 += pairs**2
            t -= RATE * pairs / np.sqrt(t2)
            gl = d[np.arange(len(d))[own >= 0], own[own >= 0]].sum()
            lex2 += gl**2
            lex -= RATE * gl / np.sqrt(lex2)
    return Model(langs, w.astype(np.float32), t, lexicon, float(lex))


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on a sample of at most SAMPLE_DOCS documents of each language and
    SAMPLE_TOTAL in all (one of each language at least), drawn by a hash of the id.
    Held-out documents and rows without a text or language aren't drawn.

    Every language is learned. Chains are drawn where the documents are, so the
    driver gets at most SAMPLE_CHAINS * TRAIN_CHAIN words of WORD_LETTERS letters of a
    sampled document. The weights stay within CELLS until languages are over 4,096.
    """
    own = docs.where(~held_out(id_col)).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    own = own.select(F.col(lang_col).cast("string").alias("y"), F.col(text_col).alias("t"), F.col(id_col).cast("long").alias("i"))
    counts = own.groupBy("y").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not counts:
        return fit_chains([])
    most = max(1, min(SAMPLE_DOCS, SAMPLE_TOTAL // len(counts)))
    limits = docs.sparkSession.createDataFrame([(r.y, int(min(1.0, 1.4 * most / r.n) * (1 << 30))) for r in counts], "y string, lim long")
    own = own.withColumn("r", F.pmod(F.xxhash64("i", F.lit(23)), F.lit(1 << 30)))
    few = own.join(F.broadcast(limits), "y").where("r < lim").select("y", "r", "i", "t")  # as many rows as the model has languages

    def chains(batches):
        for batch in batches:
            y, r, i, t = (batch.column(c) for c in range(4))
            found = [sampled_chains(text.as_py(), draw) for text, draw in zip(t, r.to_pylist())]
            yield pa.RecordBatch.from_arrays([y, r, i, pa.array(found, pa.list_(pa.string()))], names=["y", "r", "i", "chains"])

    rows = few.mapInArrow(util.lean(chains), "y string, r long, i long, chains array<string>").toArrow().to_pylist()
    rows.sort(key=lambda x: (x["y"], x["r"], util.NULL_ID if x["i"] is None else x["i"], x["chains"]))
    taken: dict = {}
    for x in rows:
        taken.setdefault(x["y"], []).append(x["chains"])
    return fit_chains([(c, y) for y, found in taken.items() for c in found[:most]])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """(id, *keep, lang_pred, score, n_words, n_switches) for every row.

    lang_pred is the language with the largest share of the words' probability,
    score that share (0 to 1), n_switches how often neighbouring words' likeliest
    labels differ. Null texts and texts without a letter get `und` and 0, as does
    every text when no language was learned; ties go to the first language by
    name; repeated rows get the same; empty tables give empty results. Columns of
    `keep` named like a result's are left out.
    """
    made = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("n_words", T.LongType()), ("n_switches", T.LongType())]
    keep = [c for c in keep if c not in dict(made)]
    packed = (model.langs, model.weights, model.transitions, model.lexicon, model.lexicon_weight)
    held = docs.sparkSession.sparkContext.broadcast(packed)

    def label(texts: list, model: Model):
        lists = [WORD.findall(t.lower()) if t else [] for t in texts]
        n = np.array([len(x) for x in lists], np.int64)
        k = len(model.langs)
        if not n.sum() or not k:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), n, np.zeros(len(texts), np.int64)
        codes, names = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
        names = list(names)
        e = model.emissions(names)
        letters = np.array([any(map(str.isalpha, w)) for w in names])
        doc = np.repeat(np.arange(len(n)), n)
        p = chain_marginals(e[codes], np.cumsum(n) - n, n, model.transitions)
        best = p.argmax(axis=1)
        turn = (best[1:] != best[:-1]) & (doc[1:] == doc[:-1])
        switches = np.bincount(doc[1:][turn], minlength=len(n))
        ok = letters[codes]
        total = np.stack([np.bincount(doc[ok], p[ok, c], len(n)) for c in range(k)], axis=1)
        counted = np.bincount(doc[ok], minlength=len(n))
        score = np.where(counted > 0, total.max(axis=1) / np.maximum(counted, 1), 0)
        top = total.argmax(axis=1)
        return [model.langs[c] if m else UNKNOWN for c, m in zip(top, counted)], np.clip(np.round(score, 6), 0, 1), n, switches

    def scan(batches):
        model, width = Model(*held.value), 1 + len(keep)
        slice_size = (3 << 20) * 8 // max(8, len(model.langs))
        for batch in batches:
            texts = batch.column(at).to_pylist()
            a = size = 0
            for b, t in enumerate(texts):
                size += len(t or "")
                if size < slice_size and b + 1 < len(texts):
                    continue
                found = label(texts[a : b + 1], model)
                columns = [batch.column(c).slice(a, b + 1 - a) for c in range(width)]
                names = [*batch.schema.names[:width], *dict(made)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2]), pa.array(found[3], pa.int64())], names=names)
                a, size = b + 1, 0

    # the text is sent once, whether or not it is among the columns kept
    given = docs.select(docs[id_col], *keep, *([] if text_col in keep else [docs[text_col].alias("__t")]))
    at = 1 + keep.index(text_col) if text_col in keep else 1 + len(keep)
    schema = T.StructType([*given.schema.fields[: 1 + len(keep)], *[T.StructField(c, kind) for c, kind in made]])
    return given.mapInArrow(util.lean(scan), schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language, by a model of the documents that aren't held out."""
    util.bounded_batches(spark)
    docs = util.table(spark, sf_dir, "documents")
    out = identify(util.spread(docs.select("doc_id", "text")), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


QUERIES = {"op10_language_id": op10_language_id}
