"""Substring dedup by difference-cover anchors.

Any two places i, j of a corpus have a shift d < period for which i+d and j+d
are both cover positions (a difference cover modulo the period holds every
difference). So two equal windows of `window` words share an equal anchor of
window - period + 1 words at an aligned cover position, and only the cover
positions (5 of 21) are hashed and sent. Anchors found twice are extended: the
windows that hold one are candidates, and only those are hashed and compared.

Documents are packed into chunks of bounded size. A chunk sends each hash once,
sorted, in byte strings by hash range, and gets one bit a hash back. So a
passage that a third of all documents hold costs its range one hash a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util

U64 = np.uint64
WINDOW, PERIOD = 35, 21
#: A perfect difference set modulo 21.
COVER_21 = (0, 1, 4, 14, 16)
CHUNK_BYTES = 8 << 20
RANGE_HASHES = 500_000
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out)


def difference_cover(period: int) -> tuple[int, ...]:
    """Positions modulo period among whose differences is every residue."""
    if period == 21:
        return COVER_21
    cover, missing = [0], set(range(1, period))
    while missing:
        best = max(range(period), key=lambda x: len({(s * (x - c)) % period for c in cover for s in (1, -1)} & missing))
        missing -= {(s * (best - c)) % period for c in cover for s in (1, -1)}
        cover.append(best)
    return tuple(sorted(cover))


class Chunk:
    """The words of a chunk's documents with their anchors and windows."""

    def __init__(self, blob: bytes, window: int, period: int):
        self.ids, texts = unpacked(blob)
        self.docs = [t.split() if t else [] for t in texts]
        n = np.fromiter(map(len, self.docs), np.int64, len(self.docs))
        self.end = np.cumsum(n)
        self.start = self.end - n
        h = util.hash_words([w for d in self.docs for w in d])
        self.window, self.period = window, period
        self.back = _powers(INVERSE, len(h) + 1)
        self.sums = np.zeros(len(h) + 1, U64)
        np.cumsum(h * _powers(BASE, len(h) + 1)[:-1], out=self.sums[1:])
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(h)) - self.start[doc]
        long = window - period + 1
        is_cover = np.zeros(period, bool)
        is_cover[list(difference_cover(period))] = True
        ok = is_cover[at % period] & (self.end[doc] - np.arange(len(h)) >= long)
        self.anchors = np.flatnonzero(ok)
        self.doc = doc
        self.anchor_hash = self._hash(self.anchors, long)

    def _hash(self, at: np.ndarray, n: int) -> np.ndarray:
        """Polynomial hashes modulo 2**64 of n words from each place."""
        return util.mix((self.sums[at + n] - self.sums[at]) * self.back[at])

    def candidates(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that hold a repeated anchor."""
        p = self.anchors[repeated]
        lo = np.maximum(p - (self.period - 1), self.start[self.doc[p]])
        hi = np.minimum(p, self.end[self.doc[p]] - self.window)
        lo, hi = lo[lo <= hi], hi[lo <= hi]
        edge = np.zeros(len(self.back) + 1, np.int64)
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi + 1, -1)
        at = np.flatnonzero(np.cumsum(edge) > 0)
        return at, self._hash(at, self.window)


def _unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    return u, inverse, count > 1


def ranges(u: np.ndarray, bits: int) -> np.ndarray:
    """Where in the sorted hashes each range begins, and the end."""
    if not bits:
        return np.array([0, len(u)])
    marks = np.arange(1 << bits, dtype=U64) << U64(64 - bits)
    return np.append(np.searchsorted(u, marks), len(u))


def _send(u: np.ndarray, bits: int, cid: int) -> pa.RecordBatch:
    cut = ranges(u, bits)
    some = np.flatnonzero(np.diff(cut))
    blobs = [u[cut[r] : cut[r + 1]].tobytes() for r in some]
    return pa.record_batch([pa.array(some, pa.int64()), pa.array([cid] * len(some), pa.int64()), pa.array(blobs, pa.binary())], names=["r", "cid", "hashes"])


def _answers(u: np.ndarray, bits: int, got: dict) -> np.ndarray:
    """Of sorted hashes, which were found in another chunk too."""
    cut, out = ranges(u, bits), np.zeros(len(u), bool)
    for r, packed in got.items():
        n = cut[r + 1] - cut[r]
        out[cut[r] : cut[r + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
    return out


SENT = "r long, cid long, hashes binary"
ANSWERED = "cid long, kind int, r long, packed binary"


def _counted(kind: int):
    def found(group: pa.Table) -> pa.Table:
        blobs = group.column("hashes").to_pylist()
        every = np.frombuffer(b"".join(blobs), U64)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(every), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        cut = np.cumsum([0] + [len(b) // 8 for b in blobs])
        some = [k for k in range(len(blobs)) if twice[cut[k] : cut[k + 1]].any()]
        packed = [np.packbits(twice[cut[k] : cut[k + 1]]).tobytes() for k in some]
        cid, r = group.column("cid").to_pylist(), group.column("r").to_pylist()
        return pa.table({"cid": pa.array([cid[k] for k in some], pa.int64()), "kind": pa.array([kind] * len(some), pa.int32()), "r": pa.array([r[k] for k in some], pa.int64()), "packed": pa.array(packed, pa.binary())})

    return found


def _by_kind(answers: pa.Table) -> dict:
    got: dict = {0: {}, 1: {}}
    for kind, r, packed in zip(*(answers.column(c).to_pylist() for c in ("kind", "r", "packed"))):
        got[kind][r] = packed
    return got


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_BYTES) -> DataFrame:
    """(cid, n_words, blob): documents packed to chunks of about `size` bytes of
    text, compressed. A chunk's id is a hash of what it holds."""

    def pack(batches):
        import xxhash

        ids, texts, held = [], [], 0

        def out():
            sink = pa.BufferOutputStream()
            t = pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as w:
                w.write_table(t)
            blob = sink.getvalue().to_pybytes()
            cid = np.array([xxhash.xxh64_intdigest(blob)], U64).view(np.int64)
            n = sum(len(t) for t in texts if t) // 4
            return pa.record_batch([pa.array(cid), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], names=["cid", "n", "blob"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), util.texts_of(batch.column(1))):
                ids.append(i)
                texts.append(t)
                held += len(t or b"") + 16
                if held >= size:
                    yield out()
                    ids, texts, held = [], [], 0
        if ids:
            yield out()

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(util.lean(pack), "cid long, n long, blob binary")


def unpacked(blob: bytes) -> tuple:
    """(ids, texts in bytes) of a chunk."""
    t = pa.ipc.open_stream(pa.py_buffer(blob)).read_all()
    return t.column(0), t.column(1).to_pylist()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """(id, text, n_words, n_removed, removed) for every row: the words kept,
    joined by one space, and the spans [from, to) of words removed.

    A word goes if a window of `window` words that covers it occurs anywhere
    else too, in its own document or another; all occurrences go, judged on the
    input. Words are bytes between white space (space, U+0009 to U+000D).

    Null and empty texts: no words, empty text. Documents under a window's length
    stay. Rows repeated are occurrences of their own, so both lose their
    windows. An empty table gives an empty result; other columns aren't read.
    Windows are compared by 64-bit hashes.
    """
    packed = util.written(chunks(docs, id_col, text_col), "chunks")
    # words are about text bytes / 4 at most, anchors a quarter of that
    total = packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(3, int(np.ceil(np.log2(max(1, total / 4 / RANGE_HASHES)))))
    blobs = packed.select("cid", "blob")

    def anchors(batches):
        for batch in batches:
            for cid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _send(np.unique(Chunk(blob, window, period).anchor_hash), bits, cid)

    first = blobs.mapInArrow(util.lean(anchors), SENT).groupBy("r").applyInArrow(_counted(0), ANSWERED)
    first = util.written(first, "anchors")

    def windows_of(blob, got):
        c = Chunk(blob, window, period)
        u, inverse, local = _unique(c.anchor_hash)
        return c, *c.candidates((local | _answers(u, bits, got[0]))[inverse])

    def windows(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        got = _by_kind(answers)
        out = [_send(np.unique(windows_of(blob, got)[2]), bits, cid) for cid, blob in zip(chunk.column("cid").to_pylist(), chunk.column("blob").to_pylist())]
        util.release()
        return pa.Table.from_batches(out)

    by_cid = lambda df: df.groupBy("cid")
    sent = by_cid(blobs).cogroup(by_cid(first)).applyInArrow(windows, SENT)
    second = sent.groupBy("r").applyInArrow(_counted(1), ANSWERED)

    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))])

    def cut(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        got, parts = _by_kind(answers), []
        for blob in chunk.column("blob").to_pylist():
            c, at, hashes = windows_of(blob, got)
            u, inverse, local = _unique(hashes)
            hit = at[(local | _answers(u, bits, got[1]))[inverse]]
            edge = np.zeros(len(c.back) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
            gone = np.cumsum(edge)[: len(c.back) - 1] > 0
            before = np.append(0, np.cumsum(gone))
            texts, removed = [], []
            for words, s, e in zip(c.docs, c.start.tolist(), c.end.tolist()):
                spans = []
                if before[e] > before[s]:
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], gone[s:e].view(np.int8), [0]))))
                    spans = [{"from": a, "to": b} for a, b in turn.reshape(-1, 2).tolist()]
                    words = [w for w, g in zip(words, gone[s:e].tolist()) if not g]
                texts.append(b" ".join(words).decode("utf-8", "replace"))
                removed.append(spans)
            columns = [c.ids, pa.array(texts, pa.string()), pa.array(c.end - c.start), pa.array(before[c.end] - before[c.start]), pa.array(removed, schema.field("removed").type)]
            parts.append(pa.table(columns, schema=schema))
        util.release()
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return (
        by_cid(blobs)
        .cogroup(by_cid(first.unionByName(second)))
        .applyInArrow(cut, "id long, text string, n_words long, n_removed long, removed array<struct<from: int, to: int>>")
        .withColumnRenamed("id", id_col)
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: n_words, n_removed and the SHA-256 of the words kept."""
    out = substring_dedup(util.spread(util.table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = {
    "op4_substring_dedup": """
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
starts AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
hits AS (SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS pos FROM hits, range(35) t(d)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
}
QUERIES = {"op4_substring_dedup": op4_substring_dedup}
