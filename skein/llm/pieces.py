"""SentencePiece encoding and decoding with sampled segmentations.

A text's pieces form a lattice: every vocabulary piece that matches at a place
is an edge, weighted by its probability. Forward filtering sums the weights of
all segmentations of each prefix; backward sampling then draws one segmentation
from its exact probability, edge by edge from the end. The draws are hashes of
the row key, the segment and the place, so a row gets the same segmentation in
every run. Decoding gives back every text byte by byte.

No piece crosses the start of a word, so the lattice falls into segments (white
space and the word after it), and equal segments share one forward pass.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util

U64 = np.uint64
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Piece weights: a power of 1 / (rank + 1), where the model's scores give the ranks.
ALPHA, SEED = 1.0, 7
SPACE = "▁"
#: Stands for the text's own U+2581; no valid text holds a lone surrogate.
OWN = "\ud800"
SEGMENT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: Sums of segments up to this length stay in range as they are; longer ones are kept in logarithms.
LONG, SLICE_CHARS = 40, 1 << 20
#: Weights grow by this for each character, which changes no conditional probability but keeps sums in range.
GROWTH = 1e4


class Trie:
    """Prefixes of pieces as nodes; a node's child by character, for whole arrays.

    Children are in one hash table with linear probing, built on the driver and
    sent as arrays.
    """

    def __init__(self, pieces: dict):
        """pieces: text -> id."""
        node = {"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                node.setdefault(p[:k], len(node))
        self.piece = np.full(len(node), -1, np.int64)
        for p, i in pieces.items():
            self.piece[node[p]] = i
        rest = [(node[p[:-1]] << 21 | ord(p[-1]), n) for p, n in node.items() if p]
        keys, children = np.array([k for k, _ in rest], np.int64), np.array([n for _, n in rest], np.int64)
        self.bits = int(np.ceil(np.log2(max(4, 4 * len(keys)))))
        self.keys = np.full((1 << self.bits) + 1, -1, np.int64)
        self.children = np.zeros(len(self.keys), np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.children[at] = keys[todo[free][first]], children[todo[free][first]]
            left = self.keys[slot] != keys[todo]
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Children, -1 where there is none."""
        key = node << 21 | char
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.children[slot], -1)
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            slot_ = slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot_]
            hit = found == key[todo]
            out[todo[hit]] = self.children[slot_[hit]]
            todo = todo[~hit & (found >= 0)]
        return out


class Vocabulary:
    """Pieces by text, byte pieces, weights, and each id's bytes."""

    def __init__(self, pieces: list, alpha: float):
        """pieces: (text, score, kind) by id; kind n normal, b byte, else special."""
        normal = [(i, p, s) for i, (p, s, k) in enumerate(pieces) if k == "n"]
        rank = {i: r for r, (i, _, _) in enumerate(sorted(normal, key=lambda x: (-x[2], x[0])))}
        self.bytes = [next(i for i, (p, _, k) in enumerate(pieces) if k == "b" and p == f"<0x{b:02X}>") for b in range(256)]
        self.weight = np.zeros(len(pieces))
        for i, p, _ in normal:
            self.weight[i] = (rank[i] + 1.0) ** -alpha * GROWTH ** len(p)
        self.trie = Trie({p: i for i, p, _ in normal})
        self.longest = max(len(p) for _, p, _ in normal)
        self.text = [b""] * len(pieces)
        for i, p, _ in normal:
            self.text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.text[i] = bytes([b])
        crossing = any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for _, p, _ in normal)
        self.whole = crossing

    def segments(self, text: str) -> list:
        return [text] if self.whole else SEGMENT.findall(text)

    def edges(self, segments: list) -> tuple:
        """(segment, from, to, token) of all edges; a token below 0 is the
        character -(token + 1) in bytes, for characters without a piece."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        seg = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
        left = size[seg] - at
        live, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        out: list = []
        for n in range(1, self.longest + 1):
            ok = left[live] >= n
            live, node = live[ok], node[ok]
            child = self.trie.step(node, chars[live + n - 1])
            piece = np.where(child >= 0, self.trie.piece[child], -1)
            if n == 1:
                piece = np.where(piece >= 0, piece, -1 - chars)
                out.append((live, 1, piece))
            else:
                hit = np.flatnonzero(piece >= 0)
                out.append((live[hit], n, piece[hit]))
            ok = child >= 0
            live, node = live[ok], child[ok]
            if not len(live):
                break
        where = np.concatenate([w for w, _, _ in out]) if out else np.empty(0, np.int64)
        n = np.concatenate([np.full(len(w), n) for w, n, _ in out]) if out else where
        token = np.concatenate([t for _, _, t in out]) if out else where
        return seg[where], at[where], at[where] + n, token

    def weights(self, token: np.ndarray) -> np.ndarray:
        """A character without a piece has but this one edge, so its weight is free."""
        return np.where(token >= 0, self.weight[np.maximum(token, 0)], 1.0)

    def expand(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of tokens, and how many ids each token has."""
        odd = np.flatnonzero(token < 0)
        if not len(odd):
            return token, np.ones(len(token), np.int64)
        kinds, which = np.unique(token[odd], return_inverse=True)
        spelled = [[self.bytes[b] for b in (SPACE if -1 - t == 0xD800 else chr(-1 - t)).encode()] for t in kinds.tolist()]
        count = np.ones(len(token), np.int64)
        count[odd] = np.array([len(x) for x in spelled])[which]
        out = np.repeat(token, count)
        at = (np.cumsum(count) - count)[odd]
        for k in range(4):
            has = np.array([len(x) > k for x in spelled])[which]
            out[at[has] + k] = np.array([x[k] if len(x) > k else 0 for x in spelled])[which][has]
        return out, count


def _draws(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (util.mix(key + util.mix(place.astype(U64) + U64(0x632BE59BD9B4E019))) >> U64(11)) * 2.0**-53


class Lattice:
    """Distinct segments after forward filtering.

    Segments are ranked by falling length and nodes numbered place by place, so
    the nodes of one place, and the edges into them, are one run: a forward step
    handles all segments at once. logs: sums are kept in logarithms, for segments
    of any length.
    """

    def __init__(self, vocabulary: Vocabulary, segments: list, logs: bool = False):
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(-size, kind="stable")
        self.rank = np.empty(len(size), np.int64)
        self.rank[order] = np.arange(len(size))
        self.size = size
        longest = int(size.max(initial=0))
        alive = np.searchsorted(-size[order], -np.arange(longest + 1), "right")
        self.base = np.cumsum(alive) - alive
        seg, start, end, token = vocabulary.edges(segments)
        row = self.rank[seg]
        source, target = self.base[start] + row, self.base[end] + row
        # long pieces first among a node's edges: most draws end there
        by = np.argsort(target * 64 + (63 - (end - start)))
        self.source, target, self.token, end = source[by], target[by], token[by], end[by]
        weight = vocabulary.weights(self.token)
        total = np.zeros(int(alive.sum())) if logs else np.ones(int(alive.sum()))
        weight = np.log(weight) if logs else weight
        cut = np.searchsorted(end, np.arange(1, longest + 2))
        share = np.empty(len(end))
        first = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.empty(0, np.int64)
        # every node past a segment's start has an edge: a piece or its last character
        self.first = np.zeros(len(total) + 1, np.int64)
        self.first[int(alive[0]) if len(alive) else 0 : len(total)] = first
        for p in range(1, longest + 1):
            a, b = cut[p - 1], cut[p]
            nodes = slice(self.base[p], self.base[p] + alive[p])
            runs = self.first[nodes] - a
            if not logs:
                share[a:b] = total[self.source[a:b]] * weight[a:b]
                total[nodes] = np.add.reduceat(share[a:b], runs)
                continue
            x = total[self.source[a:b]] + weight[a:b]
            most = np.maximum.reduceat(x, runs)
            spread = np.exp(x - np.repeat(most, np.diff(np.append(runs, b - a))))
            share[a:b], total[nodes] = x, most + np.log(np.add.reduceat(spread, runs))
        share = np.exp(share - total[target]) if logs else share / total[target]
        run = np.cumsum(share)
        self.upto = run - np.append(0, run)[self.first[target]]
        last = np.append(target[1:] != target[:-1], True) if len(target) else np.empty(0, bool)
        self.upto[last] = 2.0

    def sample(self, which: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of one segmentation of each segment in `which`, and how many each has."""
        row, place = self.rank[which], self.size[which].copy()
        active = np.flatnonzero(place > 0)
        place, row_of = place[active], row[active]
        count = np.zeros(len(which), np.int64)
        steps = []
        node = self.base[place] + row_of
        starts = int(self.base[1]) if len(self.base) > 1 else len(self.rank)
        mixed = key[active]
        while len(active):
            u = _draws(mixed, place)
            edge = self.first[node]
            more = np.flatnonzero(self.upto[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[self.upto[edge[more]] <= u[more]]
            steps.append((active, self.token[edge]))
            count[active] += 1
            node = self.source[edge]
            ok = node >= starts
            active, node, mixed = active[ok], node[ok], mixed[ok]
            place = np.searchsorted(self.base, node, "right") - 1
        end = np.cumsum(count)
        out = np.empty(int(count.sum()), np.int64)
        for s, (who, token) in enumerate(steps):
            out[end[who] - 1 - s] = token
        return out, count


def encode_texts(vocabulary: Vocabulary, texts: list, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, how many each text has). Every text gets one leading space."""
    find = vocabulary.segments
    lists = [find(SPACE + t.replace(SPACE, OWN).replace(" ", SPACE)) if t else [] for t in texts]
    n = np.array([len(x) for x in lists], np.int64)
    flat = [s for x in lists for s in x]
    if not flat:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    names = list(dict.fromkeys(flat))
    codes = np.fromiter(map(dict(zip(names, range(len(names)))).__getitem__, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(flat)) - (np.cumsum(n) - n)[doc]
    key = util.mix(keys.astype(U64)[doc] + util.mix(at.astype(U64)))
    size = np.fromiter(map(len, names), np.int64, len(names))
    far = np.flatnonzero(size > LONG)
    if not len(far):
        every, count = Lattice(vocabulary, names).sample(codes, key)
    else:
        # long segments are few: a lattice of their own, and their tokens put in place
        number = np.full(len(names), -1, np.int64)
        number[far] = np.arange(len(far))
        is_long = size[codes] > LONG
        count = np.zeros(len(flat), np.int64)
        short, few = np.flatnonzero(~is_long), np.flatnonzero(is_long)
        token, count[short] = Lattice(vocabulary, ["" if n > LONG else x for x, n in zip(names, size.tolist())]).sample(codes[short], key[short])
        extra, count[few] = Lattice(vocabulary, [names[k] for k in far.tolist()], logs=True).sample(number[codes[few]], key[few])
        every = np.empty(int(count.sum()), np.int64)
        begin = (np.cumsum(count) - count)[few]
        at_long = np.repeat(begin - (np.cumsum(count[few]) - count[few]), count[few]) + np.arange(len(extra))
        rest = np.ones(len(every), bool)
        rest[at_long] = False
        every[rest], every[at_long] = token, extra
    ids, spelled = vocabulary.expand(every)
    of = np.repeat(doc, count)
    return ids, np.bincount(of, spelled, len(texts)).astype(np.int64)


class Decoder:
    def __init__(self, text: list):
        self.size = np.array([len(t) for t in text], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(text), np.uint8)

    def texts(self, ids: np.ndarray, count: np.ndarray) -> list:
        """The texts (bytes) that ids stand for: the pieces joined, less the leading space."""
        size = self.size[ids]
        end = np.cumsum(size)
        raw = self.blob[np.repeat(self.first[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        mark = np.append(0, end)[np.append(0, np.cumsum(count))].tolist()
        return [raw[a + 1 : b] for a, b in zip(mark[:-1], mark[1:])]


def load(model_file: str = MODEL_FILE) -> list:
    """(text, score, kind) of a model's pieces; the driver reads the file, executors get the pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: "b" if sp.is_byte(i) else "x" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "n"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


def _slices(batches, size: int = SLICE_CHARS):
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        a = held = 0
        for b, t in enumerate(texts):
            held += len(t or "")
            if held >= size or b + 1 == len(texts):
                yield keys[a : b + 1], texts[a : b + 1]
                a, held = b + 1, 0


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL_FILE, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(id, ids, n_tokens, lossless) for every row: a sampled segmentation of the
    whole text, and whether decoding its ids gave the text back.

    The sample depends on seed, id and text alone: repeated rows get the same.
    Null ids draw like a fixed id. Null texts have null ids, 0 tokens; empty texts
    an empty array. Characters without a piece are spelled in bytes, a text's own
    U+2581 too. Other columns aren't read; empty tables give empty results.
    """
    util.bounded_batches(docs.sparkSession)
    # as plain state, for a broadcast can't hold this package's classes by value
    built = Vocabulary(load(model_file), alpha)
    held = docs.sparkSession.sparkContext.broadcast((vars(built.trie), {k: v for k, v in vars(built).items() if k != "trie"}))

    def scan(batches):
        vocabulary, trie = Vocabulary.__new__(Vocabulary), Trie.__new__(Trie)
        vars(trie).update(held.value[0])
        vars(vocabulary).update(held.value[1], trie=trie)
        decoder = Decoder(vocabulary.text)
        for keys, texts in _slices(batches):
            key = np.array([util.NULL_ID if k is None else k for k in keys], np.int64).view(U64)
            ids, count = encode_texts(vocabulary, texts, util.mix(key ^ util.mix(np.array([seed], U64))))
            back = decoder.texts(ids, count)
            same = [(t or "").encode() == b for t, b in zip(texts, back)]
            null = np.array([t is None for t in texts])
            arrays = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), arrays, pa.array(count), pa.array(same)], names=["id", "ids", "n_tokens", "lossless"])

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(util.lean(scan), "id long, ids array<int>, n_tokens long, lossless boolean").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """(id, text) for every row: the texts that arrays of ids stand for; null for null."""
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary(load(model_file), ALPHA).text)

    def scan(batches):
        decoder = Decoder(held.value)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            ids = np.array([i for x in lists for i in x or []], np.int64)
            texts = decoder.texts(ids, np.array([len(x or []) for x in lists], np.int64))
            texts = [None if x is None else t.decode("utf-8", "replace") for x, t in zip(lists, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(encoded[id_col].cast("long"), encoded[ids_col]).mapInArrow(util.lean(scan), "id long, text string").withColumnRenamed("id", id_col)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sampled ids, and whether they decode to its text."""
    return encode(util.spread(util.table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
