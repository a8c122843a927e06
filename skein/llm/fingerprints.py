"""Document fingerprints: SimHash of 128 bits, and all fingerprints within a
Hamming radius by block tables.

Terms are three-word shingles; each term's hash votes, by its weight
1 + log(count), on 128 signed bits. For a radius r the bits fall into r + 1
blocks: two fingerprints within r agree in one block at least, so one table a
block, led by that block, holds all pairs. A pair counts in the first table
that has it. Hot table entries are split into blocks that meet pairwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util

U64 = np.uint64
TERM_WORDS, RADIUS, BLOCK_ROWS = 3, 3, 2048
MULT = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: For each byte, the votes of its bits.
VOTES = (2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) - 1).astype(np.float32)


def simhashes(texts: list) -> list:
    """16-byte fingerprints of texts (bytes or None). A text with fewer words
    than a term is one term; one without words has the fingerprint of zeros."""
    n = TERM_WORDS
    docs = [t.lower().split() if t else [] for t in texts]
    h = util.hash_words([w for d in docs for w in d])
    m = max(0, len(h) - n + 1)
    terms = np.zeros(m, U64)
    for k in range(n):
        terms += h[k : k + m] * MULT[k]
    terms = util.mix(terms)
    out, at = [], 0
    for d in docs:
        if not d:
            out.append(bytes(16))
            continue
        own = terms[at : at + len(d) - n + 1] if len(d) >= n else util.mix(np.array([np.sum(h[at : at + len(d)] * MULT[: len(d)]) ^ MULT[3]], U64))
        at += len(d)
        u, count = np.unique(own, return_counts=True)
        wide = np.stack([u, util.mix(u + MULT[0])], axis=1).view(np.uint8)
        votes = (1 + np.log(count)).astype(np.float32) @ VOTES[wide].reshape(len(u), 128)
        out.append(np.packbits(votes > 0).tobytes())
    return out


def likeness(a: bytes, b: bytes) -> float:
    """1 less the share of bits that differ."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / 128


def _slices(batches, size: int = 8 << 20):
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), util.texts_of(batch.column(1))
        a = held = 0
        for b, t in enumerate(texts):
            held += len(t or b"")
            if held >= size or b + 1 == len(texts):
                yield ids[a : b + 1], texts[a : b + 1]
                a, held = b + 1, 0


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next): each
    text's fingerprint, its edited text's, and likeness to that and the next's.

    Ids are cut into ranges by approximate quantiles; a range's first document
    also goes to the range before it, the first of all to the last. Each range is
    then streamed in order, so memory holds two documents and a batch.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(util.NULL_ID)).alias("id"), docs[text_col].alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx("id", F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10 * parts)).first()[0]
    bounds = np.unique(np.array(found or [], np.int64))

    def lowest(batches):
        low: dict = {}
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            at = np.searchsorted(bounds, ids, "right")
            order = np.lexsort((ids, at))
            p, first = np.unique(at[order], return_index=True)
            for k, i in zip(p.tolist(), ids[order][first].tolist()):
                low[k] = min(low.get(k, i), i)
        yield pa.record_batch([pa.array(list(low), pa.int64()), pa.array(list(low.values()), pa.int64())], names=["p", "first"])

    firsts = {r.p: r.first_id for r in rows.select("id").mapInArrow(lowest, "p long, first long").groupBy("p").agg(F.min("first").alias("first_id")).collect()}
    ps = sorted(firsts)
    before = {p: ps[k - 1] for k, p in enumerate(ps)}

    def send(batches):
        import xxhash
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for ids, texts in _slices(batches):
            fps = simhashes(texts)
            out = []
            for p, i, t, fp in zip(np.searchsorted(bounds, np.array(ids, np.int64), "right").tolist(), ids, texts, fps):
                t = t or b""
                n = len(t.decode("utf-8", "replace"))
                row = (p, 0, i, xxhash.xxh64_intdigest(t) >> 1, n, fp, z.compress(t))
                out.append(row)
                if firsts[p] == i:
                    out.append((before[p], 1, *row[2:]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(),) * 5 + (pa.binary(),) * 2)], names=["p", "edge", "id", "tie", "n", "fp", "z"])

    sent = rows.mapInArrow(util.lean(send), "p long, edge long, id long, tie long, n long, fp binary, z binary")
    sent = sent.repartition(max(1, min(parts // 4, len(ps))), "p").sortWithinPartitions("p", "edge", "id", "tie")
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.binary()), ("edited_fp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def edit(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        last, held, size = None, [], 0

        def out():
            edited = [e for *_, e in held]
            fps = simhashes(edited)
            cols = zip(*((i, n, hashlib.sha256(e).hexdigest(), fp, f, likeness(fp, f), likeness(fp, nfp)) for (i, n, fp, nfp, e), f in zip(held, fps)))
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, schema)], schema=schema)

        for batch in batches:
            for p, edge, i, n, fp, zt in zip(*(batch.column(c).to_pylist() for c in ("p", "edge", "id", "n", "fp", "z"))):
                text = unpack(zt).decode("utf-8", "replace")
                if last and last[0] == p:
                    _, li, ln, lfp, lt = last
                    e = (lt[: ln - ln // 2] + text[: ln // 2]).encode()
                    held.append((li, ln, lfp, fp, e))
                    size += len(e)
                    if size >= 4 << 20:
                        yield out()
                        held, size = [], 0
                last = None if edge else (p, i, n, fp, text)
        if held:
            yield out()

    return sent.mapInArrow(util.lean(edit), "id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double")


def within_radius(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, n_near) of the distinct fingerprints fps (fp): how many other
    fingerprints are within the radius; only those with one at least."""
    tables = radius + 1
    bits = 128 // tables

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_pylist()
            keys = [(k, (int.from_bytes(f) >> (128 - bits * (k + 1))) & ((1 << bits) - 1) & ((1 << 63) - 1), f) for f in fp for k in range(tables)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*keys) if keys else ([], [], []), (pa.int64(), pa.int64(), pa.binary()))], names=["k", "key", "fp"])

    rows = fps.select("fp").mapInArrow(spread, "k long, key long, fp binary")
    rows = util.written(rows, "tables")
    counts = rows.groupBy("k", "key").agg(F.count("*").alias("c")).where("c > 1").select("k", "key", F.ceil(F.col("c") / BLOCK_ROWS).alias("nb"))
    counts = util.written(counts, "entries")  # read from a table, so that a hot entry's rows can be split in the join
    rows = rows.join(counts.hint("merge"), ["k", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("nb")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    rows = rows.select("k", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    key = ["k", "key", "i", "j"]
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *key).sortWithinPartitions(*key)

    def near(held):
        """Counts for whole segments of equal keys: rows meet at rising distance."""
        keys = [np.concatenate([np.asarray(b.column(c), np.int64) for b in held]) for c in range(5)]
        raw = b"".join(f for b in held for f in b.column(5).to_pylist())
        x = np.frombuffer(raw, ">u8").astype(U64).reshape(-1, 2)
        blocks = np.stack([(x[:, (bits * k) // 64] >> U64(64 - bits - (bits * k) % 64)) & U64((1 << bits) - 1) for k in range(tables)], axis=1) if 64 % bits == 0 else None
        new = np.any([k[1:] != k[:-1] for k in keys[:4]], axis=0)
        seg = np.append(0, np.cumsum(new))
        end = np.searchsorted(seg, seg, "right")
        count = np.zeros(len(x), np.int64)
        left = np.arange(len(x))
        d = 1
        while len(left := left[left + d < end[left]]):
            a, b = left, left + d
            ok = np.bitwise_count(x[a] ^ x[b]).sum(axis=1) <= radius
            ok &= (keys[2][a] == keys[3][a]) | (keys[4][a] != keys[4][b])
            a, b = a[ok], b[ok]
            if len(a):
                if blocks is not None:
                    first = np.argmax(blocks[a] == blocks[b], axis=1)
                else:
                    first = np.array([next(k for k in range(tables) if _block(raw, p, k, bits) == _block(raw, q, k, bits)) for p, q in zip(a, b)])
                ok = first == keys[0][a]
                np.add.at(count, a[ok], 1)
                np.add.at(count, b[ok], 1)
            d += 1
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array([raw[16 * s : 16 * s + 16] for s in some.tolist()], pa.binary()), pa.array(count[some])], names=["fp", "n"])

    def scan(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c) for c in range(4)]
            tail = [c[batch.num_rows - 1].as_py() for c in columns]
            cut = batch.num_rows
            while cut and all(c[cut - 1].as_py() == t for c, t in zip(columns, tail)):
                cut -= 1
            same = bool(held) and all(held[-1].column(c)[held[-1].num_rows - 1].as_py() == tail[c] for c in range(4))
            if cut or not same:
                if not cut:
                    if held:
                        yield near(held)
                    held = [batch]
                else:
                    yield near([*held, batch.slice(0, cut)])
                    held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield near(held)

    return rows.mapInArrow(util.lean(scan), "fp binary, n long").groupBy("fp").agg(F.sum("n").alias("n_near"))


def _block(raw: bytes, row: int, k: int, bits: int) -> int:
    return (int.from_bytes(raw[16 * row : 16 * row + 16]) >> (128 - bits * (k + 1))) & ((1 << bits) - 1)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: (id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, class_id, n_near).

    Texts count in code points; null is empty. The edited text is the first
    n - n // 2 code points and as many as are replaced, or all, of the next
    document's first; next is by id (null first), then by a hash of the text; after the last comes
    the first, a single row is its own next. class_id is the smallest id with the
    same fingerprint, n_near how many other fingerprints are within the radius.
    Texts without words have the fingerprint of zeros. An empty table gives an
    empty result; other columns aren't read.
    """
    out = util.written(with_next(docs, id_col, text_col), "fingerprints")
    classes = util.written(out.groupBy("fp").agg(F.min("id").alias("class_id")), "classes")
    # a table of its own: adaptive execution then splits the rows of a hot fingerprint in the join
    classes = util.written(classes.join(within_radius(classes, radius), "fp", "left"), "near")
    to_id = lambda c: F.when(F.col(c) != util.NULL_ID, F.col(c))
    out = out.join(classes.hint("merge"), "fp")
    return out.select(
        to_id("id").alias(id_col), "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited_fp")).alias("edited_fingerprint"),
        "near_edited", "near_next", to_id("class_id").alias("class_id"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(util.spread(util.table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op9_fingerprints": op9_fingerprints}
