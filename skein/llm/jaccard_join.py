"""N-gram Jaccard join by grouped prefixes, and the classes its links form.

Documents are sets of word shingles. In one order of all shingles (by how many
sets hold them, the rarest first, then by hash), two sets of Jaccard similarity
t or more share a shingle within their prefixes of n - ceil(t n) + 1. The counts
come from all documents: chunks of documents send their distinct shingles in
byte strings by hash range and get a count class of one byte for each back.
Shingles that one set alone holds fill prefixes but meet nothing, so a document
that shares only a passage with others has no candidates. Sets with the same
size and prefix form one group; groups meet by prefix shingles, pairs of groups are
filtered by size and by the places of the shared shingle, and then expand to
their members. Member pairs are filtered by bitmaps (each shingle flips one of
BITS bits, so two sets differ in at least as many shingles as their bitmaps in
bits) and verified on whole shingle sets.

Classes need no pair twice: two star rounds link each group to the leaders of
its buckets, first those with the fewest shingles of their own, which edited
copies have in common, and each member to the first and the last of its group. After
them only pairs of different classes are compared, in buckets and in groups: the
members outside a bucket's largest class with all of its members, those in blocks
of BLOCK_ROWS. So a bucket of thousands of near copies costs rows in proportion to
its members, no bucket is one task's work, and no link between classes is lost:
every candidate pair is either within one class already or verified.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util
from .substring_dedup import chunks, ranges, unpacked

U64 = np.uint64
NGRAM = 5
#: Shingles of a hash range, about.
RANGE_SHINGLES = 1_000_000
#: Similarity as a fraction of whole numbers.
NUM, DEN = 3, 4
#: Bits of the filter that spares documents without candidates the way to verification; a full filter spares none.
BLOOM_BITS = 1 << 25
#: Members of a bucket that one task compares others with, about.
BLOCK_ROWS = 2048
MULT = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_sets(texts: list, n: int = NGRAM) -> list:
    """Sorted distinct 64-bit shingle hashes of each text (bytes or None): words
    are bytes between white space, A-Z lower-cased; a text with fewer than n
    words is one shingle, one without words an empty set."""
    docs = [t.lower().split() if t else [] for t in texts]
    h = util.hash_words([w for d in docs for w in d])
    m = max(0, len(h) - n + 1)
    whole = np.zeros(m, U64)
    for k in range(n):
        whole += h[k : k + m] * MULT[k % len(MULT)] * U64(2 * (k // len(MULT)) + 1)
    whole = util.mix(whole)
    out, at = [], 0
    for d in docs:
        if len(d) >= n:
            out.append(np.unique(whole[at : at + len(d) - n + 1]))
        elif d:
            short = np.array([len(d)], U64)
            for k in range(len(d)):
                short = short * MULT[5] + h[at + k]
            out.append(util.mix(short ^ MULT[6]))
        else:
            out.append(np.empty(0, U64))
        at += len(d)
    return out


def _digest(u: np.ndarray) -> tuple[int, int]:
    two = np.frombuffer(hashlib.blake2b(u.tobytes(), digest_size=16).digest(), np.int64)
    return int(two[0]), int(two[1])


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(np.asarray(c, np.int64)) for c in columns], names=names.split())


class Chunk:
    """The shingle sets of a chunk's documents, and its distinct shingles with
    how many distinct sets of the chunk hold each."""

    def __init__(self, blob: bytes, n: int):
        ids, texts = unpacked(blob)
        self.ids, self.sets = ids.to_pylist(), shingle_sets(texts, n)
        self.keys = [_digest(u) for u in self.sets]
        self.distinct = {k: u for k, u in zip(self.keys, self.sets) if len(u)}
        every = np.concatenate([*self.distinct.values(), np.empty(0, U64)])
        self.tokens, self.counts = np.unique(every, return_counts=True)


def _sent(c: Chunk, bits: int, cid: int) -> pa.RecordBatch:
    """By range: the next 32 bits of each shingle, and its count up to 255."""
    cut = ranges(c.tokens, bits)
    some = np.flatnonzero(np.diff(cut))
    short = (c.tokens >> U64(32 - bits)).astype(np.uint32)
    counts = np.minimum(c.counts, 255).astype(np.uint8)
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.record_batch(
        [pa.array(some, pa.int64()), pa.array([cid] * len(some), pa.int64()), pa.array([short[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary()), pa.array([pack(counts[cut[r] : cut[r + 1]].tobytes()) for r in some], pa.binary())],
        names=["r", "cid", "shingles", "counts"],
    )


def _classed(group: pa.Table) -> pa.Table:
    """For each chunk, the count classes of its shingles in one range: 0 for
    those that one set holds, else 8 log2 of the count."""
    blobs = group.column("shingles").to_pylist()
    unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
    every = np.frombuffer(b"".join(blobs), np.uint32)
    counts = np.frombuffer(b"".join(map(unpack, group.column("counts").to_pylist())), np.uint8)
    order = np.argsort(every, kind="stable")
    new = np.append(True, every[order][1:] != every[order][:-1])
    total = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
    classes = np.minimum(8 * np.log2(total), 255).astype(np.uint8)
    out = np.empty(len(every), np.uint8)
    out[order] = classes[np.cumsum(new) - 1]
    cut = np.cumsum([0] + [len(b) // 4 for b in blobs])
    return pa.table({"cid": group.column("cid"), "r": group.column("r"), "classes": pa.array([pack(out[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])], pa.binary())})


#: Words of a set's bitmap.
WORDS = 16


def bitmap(u: np.ndarray) -> list:
    """Parities of the shingles that fall on each of 64 * WORDS bits."""
    at = (util.mix(u) >> U64(64 - 10)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def _near_enough(a: str, b: str, num: int, den: int) -> str:
    """SQL: whether bitmaps (arrays a, b) of sets of sizes a_n, b_n leave room for the overlap needed."""
    differ = " + ".join(f"bit_count({a}w[{k}] ^ {b}w[{k}])" for k in range(WORDS))
    return f"{num + den} * ({a}n + {b}n - ({differ})) >= {2 * num} * ({a}n + {b}n)"


def _rows(c: Chunk, classes: np.ndarray, num: int, den: int):
    """kind 0: (id, two halves of the set's digest, set size) of each document.
    For sets with a shingle of another set in their prefix also kind 1: (shingle,
    group, size << 32 | place in the order) for each such shingle, and kind 2:
    (group, set, -, set size) with the set's bitmap w."""
    n = len(c.ids)
    bitmaps: list = [None] * n
    kind, a, b, d, size = [np.zeros(n)], [np.array(c.ids, np.int64)], [np.array([k[0] for k in c.keys], np.int64)], [np.array([k[1] for k in c.keys], np.int64)], [np.array([len(u) for u in c.sets])]
    for key, u in c.distinct.items():
        code = classes[np.searchsorted(c.tokens, u)]
        take = len(u) - -(-num * len(u) // den) + 1
        first = np.lexsort((u, code))[:take]
        shared = np.flatnonzero(code[first] > 0)
        if not len(shared):
            continue
        group = _digest(np.append(u[first], U64(len(u))))[0]
        m = len(shared)
        kind += [np.full(m, 1), [2]]
        a += [u[first[shared]].view(np.int64), [group]]
        b += [np.full(m, group), [key[0]]]
        d += [(len(u) << 32) | shared, [0]]
        size += [np.zeros(m), [len(u)]]
        bitmaps += [None] * m + [bitmap(u)]
    columns = [np.concatenate([np.asarray(x, np.int64) for x in xs]) for xs in (kind, a, b, d, size)]
    return _batch("kind a b c n w", *columns, pa.array(bitmaps, pa.list_(pa.int64())))


def scan(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The rows of _rows for all documents (id, text)."""
    packed = util.written(chunks(rows, "id", "text"), "chunks")
    # chunks count a word for four bytes of text; about as many shingles
    total = packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(31, max(3, int(np.ceil(np.log2(max(1, total / RANGE_SHINGLES))))))
    blobs = packed.select("cid", "blob")

    def send(batches):
        for batch in batches:
            for cid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _sent(Chunk(blob, n), bits, cid)

    sent = blobs.mapInArrow(util.lean(send), "r long, cid long, shingles binary, counts binary")
    answers = sent.groupBy("r").applyInArrow(_classed, "cid long, r long, classes binary")

    def finish(chunk: pa.Table, got: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        by_range = {r: z for r, z in zip(got.column("r").to_pylist(), got.column("classes").to_pylist())}
        classes = np.frombuffer(b"".join(unpack(by_range[r]) for r in sorted(by_range)), np.uint8)
        out = [_rows(Chunk(blob, n), classes, num, den) for blob in chunk.column("blob").to_pylist()]
        util.release()
        return pa.Table.from_batches(out)

    return blobs.groupBy("cid").cogroup(answers.groupBy("cid")).applyInArrow(finish, "kind long, a long, b long, c long, n long, w array<long>")


def _fits(a: str, b: str, num: int, den: int) -> str:
    """Whether sizes and places in a bucket leave room for the overlap needed."""
    size = lambda x: f"shiftright({x}, 32)"
    rest = lambda x: f"({size(x)} - ({x} & 4294967295L))"
    return f"{num + den} * least({rest(a)}, {rest(b)}) >= {num} * ({size(a)} + {size(b)})"


# Tables that a large one joins by a key that may be hot are written first and merged
# with: then adaptive execution can split the large side (it can't beside an aggregate).


def _buckets(index: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (token, grp, sp) of shingles that two groups or more have, with two
    leaders of their bucket: by place (g1, sp1) and by group (g2, sp2).

    Rows that no other of the bucket can fit are left out: the sum of two sizes
    must be within what either has left from the shared shingle on. Buckets of two
    are judged exactly, others by their smallest size and largest rest.
    """
    size, place = F.shiftright("sp", 32), F.col("sp").bitwiseAND(F.lit(0xFFFFFFFF))
    rest = F.floor((num + den) * (size - place) / num).cast("long")
    # numbers only, so that they aggregate in hash tables
    central = F.shiftleft(place, 32).bitwiseOR(F.col("grp").bitwiseAND(F.lit(0xFFFFFFFF)))
    leads = [F.min_by("grp", central).alias("g1"), F.min_by("sp", central).alias("sp1"), F.min("grp").alias("g2"), F.min_by("sp", "grp").alias("sp2")]
    sums = [F.count("*").alias("k"), F.min(size).alias("s0"), F.sum(size).alias("ss"), F.max(rest).alias("r0"), F.sum(rest).alias("rs")]
    leaders = util.written(index.groupBy("token").agg(*leads, *sums).where("k > 1"), "leaders")
    two = F.least(rest, F.col("rs") - rest) >= F.col("ss")
    more = F.least(rest, "r0") >= size + F.col("s0")
    met = index.join(leaders.hint("merge"), "token").where(F.when(F.col("k") == 2, two).otherwise(more))
    buckets = util.written(met.select("token", "grp", "sp", "g1", "sp1", "g2", "sp2"), "buckets")
    util.drop(leaders)
    return buckets


def _apart(placed: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of members (token, node, sp, comp, n, w) of one bucket whose classes
    differ and that may be alike: those outside the bucket's largest class meet
    all, which lie in blocks. Sets alike have sizes of one class or neighbouring ones."""
    by_class = placed.groupBy("token", "comp").agg(F.count("*").alias("k"))
    mixed = by_class.groupBy("token").agg(F.sum("k").alias("c"), F.max_by("comp", "k").alias("top"), F.count("*").alias("classes")).where("classes > 1")
    mixed = util.written(mixed.select("token", "top", F.ceil(F.col("c") / BLOCK_ROWS).alias("nb")), "mixed")
    scale = F.floor(F.log("n") / F.log(F.lit(1.01 * den / num))).cast("long")
    rows = util.written(placed.join(mixed.hint("merge"), "token").withColumn("scale", scale), "open")
    every = rows.select(F.col("token").alias("t2"), F.col("scale").alias("c2"), F.pmod(F.xxhash64("node"), F.col("nb")).alias("b2"), F.col("node").alias("b"), F.col("sp").alias("osp"), F.col("comp").alias("oc"), F.col("n").alias("yn"), F.col("w").alias("yw"))
    few = rows.where("comp <> top").withColumnsRenamed({"n": "xn", "w": "xw"}).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    few = few.withColumn("scale", F.explode(F.expr("array(scale - 1, scale, scale + 1)")))
    other = (F.col("comp") != F.col("oc")) & ((F.col("oc") == F.col("top")) | (F.col("node") > F.col("b")))
    alike = F.expr(_fits("sp", "osp", num, den)) & F.expr(_near_enough("x", "y", num, den))
    met = few.join(every, (F.col("token") == F.col("t2")) & (F.col("scale") == F.col("c2")) & (F.col("block") == F.col("b2")) & other & alike)
    return met.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, of the nodes of edges (a, b).

    Every class hooks to its smallest neighbour class, hooks are followed to
    their end, and edges shrink to those between classes, until none is left.
    Sums are combined before the shuffle; each round is a written table.
    """
    e = util.written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    comp = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("comp", F.col("node"))
    comp = util.written(comp, "comp")
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        up = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("p"))
        up = held = util.written(up, "hooks")
        while True:
            jumped = up.join(up.select(F.col("c").alias("p"), F.col("p").alias("pp")), "p", "left").select("c", "p", F.coalesce("pp", "p").alias("q"))
            jumped = util.written(jumped, "hooks")
            util.drop(held)
            held = jumped
            up = jumped.select("c", F.col("q").alias("p"))
            if jumped.where("p <> q").isEmpty():
                break
        to = up.select(F.col("c").alias("comp"), F.col("p").alias("__to"))
        last, comp = comp, util.written(comp.join(to, "comp", "left").select("node", F.coalesce("__to", "comp").alias("comp")), "comp")
        ends = e.join(to.withColumnsRenamed({"comp": "a", "__to": "pa"}), "a").join(to.withColumnsRenamed({"comp": "b", "__to": "pb"}), "b")
        used, e = e, util.written(ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        util.drop(last, used, held)
    util.drop(e)
    return comp


def verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b), those whose whole shingle sets are similar enough."""
    held = pairs.join(texts.select(F.col("node").alias("a"), F.col("z").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("z").alias("tb")), "b")

    def check(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        last, last_set = None, None
        for batch in batches:
            keep = []
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2), batch.column(3)
            for k in range(len(a)):
                if b[k] != last:
                    last, last_set = b[k], shingle_sets([unpack(tb[k].as_py())], n)[0]
                u = shingle_sets([unpack(ta[k].as_py())], n)[0]
                inter = len(np.intersect1d(u, last_set, assume_unique=True))
                keep.append(den * inter >= num * (len(u) + len(last_set) - inter))
            at = [k for k, x in enumerate(keep) if x]
            yield _batch("a b", [a[k] for k in at], [b[k] for k in at])

    return held.select("a", "b", "ta", "tb").mapInArrow(util.lean(check), "a long, b long")


def bloom_positions(x: np.ndarray) -> list:
    return [(util.mix(x.view(U64) + MULT[k]) % U64(BLOOM_BITS)).astype(np.int64) for k in range(2)]


def candidate_texts(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, z, s): compressed text and set of the rows whose id is among nodes,
    and a few more: what a Bloom filter of fixed size lets pass."""
    spark = docs.sparkSession

    def spots(batches):
        for batch in batches:
            x = np.asarray(batch.column(0), np.int64)
            yield _batch("at", np.concatenate(bloom_positions(x)))

    words = nodes.mapInArrow(spots, "at long").select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit"))
    words = util.written(words.groupBy("w").agg(F.expr("bit_or(bit)").alias("bits")), "filter")
    table = np.zeros(BLOOM_BITS // 64, np.int64)
    got = words.toArrow()  # BLOOM_BITS / 64 rows at most
    table[np.asarray(got.column(0), np.int64)] = np.asarray(got.column(1), np.int64)
    held = spark.sparkContext.broadcast(table.view(U64))

    def pack(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            ok = np.ones(len(ids), bool)
            for at in bloom_positions(ids):
                ok &= ((held.value[at >> 6] >> (at & 63).astype(U64)) & U64(1)).astype(bool)
            rows = np.flatnonzero(ok)
            texts = util.texts_of(batch.column(1).take(pa.array(rows)))
            yield pa.record_batch([pa.array(ids[rows]), pa.array([z.compress(t or b"") for t in texts], pa.binary()), pa.array([_digest(u)[0] for u in shingle_sets(texts, n)], pa.int64())], names=["node", "z", "s"])

    return docs.mapInArrow(util.lean(pack), "node long, z binary, s long")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, num: int = NUM, den: int = DEN) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the size of its set, and the
    smallest id that links of similarity num/den or more reach, its own included.

    Empty sets (null or empty text, no words) link with nothing. Rows with equal
    sets are linked whatever their ids; rows that share an id are one document,
    linked by what any of them is linked by. A null id counts as the smallest id; a
    class that holds one has a null component_id. An empty table gives an empty
    result; other columns aren't read. Shingles and sets are compared by 64-bit
    and 128-bit hashes.
    """
    spark = docs.sparkSession
    util.bounded_batches(spark)
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(util.NULL_ID)).alias("id"), docs[text_col].alias("text"))
    scanned = util.written(scan(rows, n, num, den), "scan")
    sig = scanned.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("s"), F.col("c").alias("s2"), "n")

    # a set's node is the smallest id that has it
    reps = util.written(sig.where("n > 0").groupBy("s", "s2").agg(F.min("id").alias("node")), "sets")
    index = scanned.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("grp"), F.col("c").alias("sp")).distinct()

    # groups with a partner anywhere, and their members
    index = util.written(index, "index")
    buckets = _buckets(index, num, den)
    util.drop(index)
    members = scanned.where("kind = 2").select(F.col("a").alias("grp"), F.col("b").alias("s"), "n", "w").dropDuplicates(["grp", "s"])
    several = members.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select("grp")
    active = buckets.select("grp").distinct().union(several).distinct()
    members = util.written(members.join(active, "grp").join(reps.groupBy("s").agg(F.min("node").alias("node")), "s").select("grp", "node", "n", "w"), "members")
    texts = candidate_texts(rows, members.select("node").distinct(), n)
    texts = texts.join(members.select("node").distinct(), "node", "left_semi")
    texts = util.written(texts.join(reps.select("node", "s"), ["node", "s"], "left_semi").dropDuplicates(["node", "s"]).select("node", "z"), "texts")

    # star rounds: each group with the leaders of its buckets, each member with the first and the last of its group
    close = _near_enough("x", "y", num, den)
    ends = members.groupBy("grp").agg(F.min("node").alias("lead"), F.max("node").alias("last"))
    ends = util.written(ends.join(members, "grp").where("node IN (lead, last)").dropDuplicates(["grp", "node"]), "ends")
    side = lambda p, node, at: ends.where(F.col("node") == F.col(at)).select(F.col("grp").alias(p), F.col("node").alias(node), F.col("n").alias(f"{p}n"), F.col("w").alias(f"{p}w"))
    stars = [buckets.where(F.col("grp") != F.col(g)).where(F.expr(_fits("sp", s, num, den))).select(F.least("grp", g).alias("x"), F.greatest("grp", g).alias("y")) for g, s in (("g1", "sp1"), ("g2", "sp2"))]
    pairs = stars[0].union(stars[1]).distinct().join(side("x", "a", "lead"), "x").join(side("y", "b", "lead"), "y").where(close).select("a", "b")
    for at in ("lead", "last"):
        within = members.select(F.col("node").alias("a"), F.col("grp").alias("y"), F.col("n").alias("xn"), F.col("w").alias("xw")).join(side("y", "b", at), "y")
        pairs = pairs.union(within.where("a <> b").where(close).select("a", "b"))
    pairs = util.written(pairs.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct(), "stars")
    links = util.written(verified(pairs, texts, n, num, den), "links")
    comp = components(links)

    # what is left: pairs of a bucket, or of a group as one more bucket, whose classes still differ
    labelled = members.join(comp, "node", "left").select("grp", "node", F.coalesce("comp", "node").alias("comp"), "n", "w")
    labelled = util.written(labelled, "labelled")
    placed = buckets.select("token", "grp", "sp").join(labelled, "grp").select("token", "node", "sp", "comp", "n", "w")
    own = labelled.select(F.xxhash64("grp").alias("token"), "node", F.shiftleft("n", 32).alias("sp"), "comp", "n", "w")
    rest = _apart(placed.unionByName(own), num, den).join(pairs, ["a", "b"], "left_anti")
    rest = util.written(rest, "rest")
    more = util.written(verified(rest, texts, n, num, den), "links")
    util.drop(buckets, members, ends, labelled, texts, pairs, links, rest)
    between = more.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    again = components(between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    util.drop(more)
    again = again.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    final = comp.join(again, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    alone = again.join(comp.select("comp").distinct(), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("top").alias("comp"))
    final = final.unionByName(alone)

    out = sig.join(reps, ["s", "s2"], "left").join(final, "node", "left")
    to_id = lambda c: F.when(c != util.NULL_ID, c)
    return out.select(to_id(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), to_id(F.coalesce("comp", "node", "id")).alias("component_id"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: n_shingles and component_id."""
    return near_duplicate_classes(util.spread(util.table(spark, sf_dir, "documents").select("doc_id", "text")))


SQL = {
    "op2_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS s FROM w),
reps AS (SELECT s, len(s) AS n, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT node, n, unnest(s) AS t FROM reps),
links AS (SELECT a.node AS a, b.node AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.node <> b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(node, seen) AS (SELECT node, node FROM reps UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
classes AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(c.component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN reps ON reps.s = sets.s LEFT JOIN classes c ON c.node = reps.node
"""
}
QUERIES = {"op2_jaccard_join": op2_jaccard_join}
