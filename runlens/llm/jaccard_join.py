"""Operator 8: n-gram Jaccard self-join by a grouped prefix join.

A document is the set of its distinct 5-word shingles (64-bit hashes); two documents
link if their Jaccard similarity is at least 0.8. Only components are asked for, so no
group of copies is expanded into pairs, yet no link between different texts is lost:

1. Equal sets collapse into one class. Tokens are ordered by a count sketch over all
   documents (rare first, ties by hash), whose width follows the input up to a bound: any
   fixed order gives exact results, the sketch only keeps common passages out of the prefixes.
2. Classes with equal size and equal prefix collapse into one group. Groups that share a
   prefix token meet in that token's bucket; the smallest group is its pivot. By the
   prefix filter, two linked documents share a bucket or a group, hence a pivot.
3. Every member of a group that met a pivot is paired with the pivot's leader: at most
   one pair per index entry. Pairs whose sizes and parity signatures (bits that bound the
   overlap from above) leave room for a link are verified on the full sets.
4. Two members of one pivot that are still in different components meet if their size
   classes (steps of 1.25) are neighbours, and are compared by the same bounds, and by the
   triangle inequality where both distances to the pivot are known (they may differ by at
   most 0.2) and belong to one text each. Pairs that pass are verified too. Where many
   members of a size class stay, a few of them by hash meet the others first: near copies
   that their pivot didn't link become one component and don't all meet one another.
5. Components by alternating large-star and small-star steps over written tables; up to
   ``ALONE`` links are settled in one task instead, as each step would write tables of many tiny files.

Keys with many rows (a pivot of thousands, the centre of a star) are split: rows are
counted per key, keys over a partition's even share are at most as many as partitions, so
that list is broadcast, their rows are salted and the other side's rows repeated per salt.

Sets are computed from the texts again for the few documents that need verification,
chosen by a bit table as wide as there are such documents (up to a bound, past which more
sets are computed than needed), so texts are never shuffled.

Defined cases: words as in the contract; null, empty or wordless text has an empty set,
links with nothing and is its own component; rows that share a doc_id are one document
for linking; a row with a null doc_id takes no part (component null); an empty table
gives no rows; other columns are not read. ``one_of_each`` takes rows, not ids: of rows
that link, also those repeated or without a doc_id, the one with the least doc_id stays.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, forget, holds, partitions, session, written

SHINGLE = 5
PERCENT = 80
#: Least and most counters of the frequency sketch (two bytes each when sent), and input bytes a counter.
SKETCH, MAX_SKETCH, SKETCH_CHUNK, SKETCH_BYTES = 1 << 21, 1 << 24, 1 << 14, 256
#: Least and most bits of the candidate table, and bits a candidate.
BITS, MAX_BITS, BITS_CHUNK, BITS_EACH = 1 << 24, 1 << 28, 1 << 16, 16
#: Sizes of linked sets differ by a factor of 1.25 at most, so their classes differ by one at most.
CLASS_STEP = math.log(100 / PERCENT) * 1.000001
#: Rows of one key that are never split.
FEW = 32
MEMO_WORDS = 200_000
#: Members of a size class of a pivot that all meet at once; of larger ones about so many go first, so many times.
CROWD, PICKS, TURNS = 64, 16, 2
#: Most links (16 bytes each) whose components one task settles.
ALONE = 1 << 20
#: Fewest bits of a signature; longer sets get the next power of two above their size.
SIGNATURE = 256


class _Hashes(dict):
    """64-bit hash of each word, kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_hashes = _Hashes()
holds("hashes", _hashes.clear)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = len(w) - SHINGLE + 1
    h = w[:n] * _FACTORS[0]
    for k in range(1, SHINGLE):
        h += w[k : k + n] * _FACTORS[k]
    h ^= h >> np.uint64(29)
    h *= _FACTORS[1]
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _slices(batches):
    """Batches of few rows, so that Python holds the texts and sets of only so many documents."""
    claim("hashes")
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield batch.slice(at, 512)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def width(wanted: int, least: int, most: int) -> int:
    """The power of two that holds ``wanted``, between two bounds."""
    return min(most, max(least, 1 << max(0, wanted - 1).bit_length()))


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's size: no scan, and only sizes of tables depend on it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _sketch_parts(size: int):
    def run(batches):
        counts = np.zeros(size, np.int32)
        for batch in _slices(batches):
            for text in batch.column(0).to_pylist():
                np.add.at(counts, (shingles(text) % np.uint64(size)).astype(np.int64), 1)
        if counts.any():
            for k in range(0, size, SKETCH_CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([k // SKETCH_CHUNK], pa.int32()), pa.array([zlib.compress(counts[k : k + SKETCH_CHUNK].astype(np.int64).tobytes(), 1)])], ["chunk", "data"])

    return run


def _sketch_sum(batches):
    """Sums the parts of each chunk of this partition, on a scale of logarithms: only their order counts."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(data), np.int64)
            sums[chunk] = sums[chunk] + part if chunk in sums else part
    for chunk, part in sums.items():
        level = np.round(np.log2(part + 1.0) * 1000).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)])], ["chunk", "data"])


def sketch(docs: DataFrame, size: int | None = None) -> np.ndarray:
    """How often shingles of all documents fall on each counter, as 1000 x log2(1 + count)."""
    size = size or width(input_bytes(docs) // SKETCH_BYTES, SKETCH, MAX_SKETCH)
    parts = docs.select("text").mapInArrow(_sketch_parts(size), "chunk int, data binary").repartition(partitions(docs.sparkSession), "chunk")
    out = np.zeros(size, np.uint16)
    for r in parts.mapInArrow(_sketch_sum, "chunk int, data binary").collect():  # bounded by MAX_SKETCH counters
        out[r.chunk * SKETCH_CHUNK : (r.chunk + 1) * SKETCH_CHUNK] = np.frombuffer(zlib.decompress(r.data), np.uint16)
    return out


def signature(tokens: np.ndarray) -> list[int]:
    """Parity of the tokens in as many bins as tokens or more: |a xor b| bounds the symmetric difference from below.

    The bins of half the width are the exclusive or of both halves, so signatures of two widths compare.
    """
    bins = max(SIGNATURE, 1 << max(0, len(tokens) - 1).bit_length())
    parity = np.bincount(((tokens >> np.uint64(17)) % np.uint64(bins)).astype(np.int64), minlength=bins) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64).tolist()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _prefix_rows(shared):
    def run(batches):
        counts = shared.value
        for batch in _slices(batches):
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = shingles(text)
                n, prefix = len(tokens), tokens[:0]
                if n:
                    order = np.argsort(counts[(tokens % np.uint64(len(counts))).astype(np.int64)], kind="stable")
                    prefix = tokens[order[: prefix_length(n)]]
                d, g = (np.frombuffer(xxhash.xxh3_128_digest(x.tobytes(), seed=n), np.int64).tolist() for x in (tokens, prefix))
                rows.append((doc, n, *d, *g, signature(tokens), _signed(prefix)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c) if k < 7 else list(c), t) for k, (c, t) in enumerate(zip(zip(*rows) if rows else [()] * 8, _PREFIX_TYPES))], _PREFIX_NAMES)

    return run


_PREFIX_NAMES = ["doc_id", "n", "d1", "d2", "g1", "g2", "sig", "prefix"]
_PREFIX_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_PREFIX_SCHEMA = "doc_id long, n long, d1 long, d2 long, g1 long, g2 long, sig array<long>, prefix array<long>"


def bit_table(ids: DataFrame) -> np.ndarray:
    """Bits set at the hashes of ``ids`` (column id); as many as the ids ask for, within bounds."""
    size = width(BITS_EACH * ids.count(), BITS, MAX_BITS)
    at = F.pmod(F.xxhash64("id"), F.lit(size))
    chunks = ids.select(F.floor(at / BITS_CHUNK).cast("int").alias("chunk"), (at % BITS_CHUNK).cast("int").alias("bit")).distinct()

    def fill(batches):
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk in np.unique(batch.column(0)):
                part = tables.setdefault(int(chunk), np.zeros(BITS_CHUNK, bool))
                part[np.asarray(batch.column(1))[np.asarray(batch.column(0)) == chunk]] = True
        for chunk, part in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(np.packbits(part).tobytes(), 1)])], ["chunk", "data"])

    out, step = np.zeros(size // 8, np.uint8), BITS_CHUNK // 8
    for r in chunks.repartition(partitions(ids.sparkSession), "chunk").mapInArrow(fill, "chunk int, data binary").collect():
        out[r.chunk * step : (r.chunk + 1) * step] = np.frombuffer(zlib.decompress(r.data), np.uint8)
    return out


def _set_rows(shared):
    def run(batches):
        table = shared.value
        for batch in _slices(batches):
            doc, at, text = batch.columns
            where = at.to_numpy()
            chosen = np.flatnonzero(table[where >> 3] >> (7 - (where & 7)) & 1)
            if len(chosen):
                sets = [_signed(shingles(t)) for t in text.take(pa.array(chosen)).to_pylist()]
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(chosen)), pa.array(sets, pa.list_(pa.int64()))], ["id", "tokens"])

    return run


def set_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Shingle sets of at least the documents in ``ids`` (column id); a few more may come along."""
    ids = written(ids, "ids")
    table = bit_table(ids)
    shared = session(docs).sparkContext.broadcast(table)
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(8 * len(table))).alias("at"), "text")
    out = written(rows.mapInArrow(_set_rows(shared), "id long, tokens array<long>"), "sets")
    forget(ids)
    shared.destroy()
    return out


def crowded(rows: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """Keys of more than an even share of ``n_rows`` rows a partition, with the number of ``salts`` they are split by.

    There are fewer such keys than partitions, so the table can be broadcast.
    """
    limit = max(FEW, n_rows // partitions(rows.sparkSession))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > limit).select(*keys, F.ceil(F.col("k") / limit).cast("int").alias("salts"))


def salted_join(rows: DataFrame, other: DataFrame, keys: list[str], by: str, n_rows: int, how: str = "inner") -> DataFrame:
    """Join on ``keys``; crowded keys of ``rows`` are split by the hash of ``by`` and met by copies of ``other``."""
    many = F.broadcast(crowded(rows, keys, n_rows))
    left = rows.join(many, keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), "salts").cast("int"), F.lit(0))).drop("salts")
    right = other.join(many, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [*keys, "salt"], how).drop("salt")


def gridded_join(rows: DataFrame, other: DataFrame, keys: list[str], by: str, by_other: str, n_rows: int) -> DataFrame:
    """Join on ``keys``; both sides of crowded keys are split, as rows and columns of a grid, so each is copied by the root of the splits."""
    many = F.broadcast(crowded(rows.select(*keys).union(other.select(*keys)), keys, n_rows))

    def split(side: DataFrame, by: str, own: str, across: str) -> DataFrame:
        out = side.join(many, keys, "left").withColumn("grid", F.coalesce(F.ceil(F.sqrt("salts")).cast("int"), F.lit(1))).drop("salts")
        return out.withColumn(own, F.pmod(F.xxhash64(by), "grid").cast("int")).withColumn(across, F.explode(F.sequence(F.lit(0), F.col("grid") - 1))).drop("grid")

    both = split(rows, by, "row", "column").join(split(other, by_other, "column", "row"), [*keys, "row", "column"])
    return both.drop("row", "column")


def _pivots(batches):
    """Of an index sorted by (token, leader): each leader with the first of its token; the partition's first run stays open."""
    first_token = token = pivot = first_pivot = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t, leaders = (c.to_numpy() for c in batch.columns)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(t)) + 1])
        pivots = leaders[starts]
        if first_token is None:
            first_token, first_pivot = t[0], leaders[0]
        elif t[0] == token:
            pivots[0] = pivot
        token, pivot = t[-1], pivots[-1]
        own = np.repeat(pivots, np.diff(np.append(starts, len(t))))
        opened = t == first_token
        chosen = opened | (leaders != own)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(opened, OPEN, MET)[chosen], pa.int32()), *(pa.array(x[chosen]) for x in (t, leaders, own))], _INDEX)
    if token is not None:
        yield pa.RecordBatch.from_arrays([pa.array([EDGE, EDGE], pa.int32()), *(pa.array(x, pa.int64()) for x in ([first_token, token], [first_pivot, pivot], [first_pivot, pivot]))], _INDEX)


MET, OPEN, EDGE = 0, 1, 2
_INDEX = ["kind", "token", "leader", "pivot"]


def meetings(index: DataFrame) -> DataFrame:
    """``index`` (token, leader) to distinct (leader, pivot): the least leader of each token against the others.

    The index is cut into ranges of (token, leader), so a frequent token spreads over
    partitions; the first run of a partition may have begun in an earlier one and takes the
    least leader of the edges, at most two a partition.
    """
    ordered = index.repartitionByRange(partitions(index.sparkSession), "token", "leader").sortWithinPartitions("token", "leader")
    stream = written(ordered.select("token", "leader").mapInArrow(_pivots, "kind int, token long, leader long, pivot long"), "pivots")
    least = stream.where(F.col("kind") == EDGE).groupBy("token").agg(F.min("leader").alias("least"))
    settled = stream.where(F.col("kind") == OPEN).join(F.broadcast(least), "token").select("leader", F.col("least").alias("pivot"))
    both = stream.where(F.col("kind") == MET).select("leader", "pivot").union(settled).where("leader != pivot")
    out = written(both.distinct(), "met")
    forget(stream)
    return out


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b; a written table) with ``common``, ``na`` and ``nb`` from the full sets."""
    n = pairs.count()
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = salted_join(salted_join(pairs, left, ["a"], "b", n), right, ["b"], "a", n)
    out = both.withColumn("common", F.size(F.array_intersect("ta", "tb")).cast("long"))
    return out.withColumn("na", F.size("ta").cast("long")).withColumn("nb", F.size("tb").cast("long")).drop("ta", "tb")


def room(n, n2, sig, sig2):
    """Whether sizes and signatures leave room for a link: a condition that no linked pair fails."""
    xor = lambda x, y: F.zip_with(x, y, lambda v, w: v.bitwiseXOR(w))
    half = lambda x: xor(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")))
    both = F.when(F.size(sig) == F.size(sig2), xor(sig, sig2)).when(F.size(sig) > F.size(sig2), xor(half(sig), sig2)).otherwise(xor(sig, half(sig2)))
    differ = F.aggregate(both, F.lit(0), lambda s, x: s + F.bit_count(x))
    # Sizes that fit differ by less than a factor of two, so at most one halving is needed.
    return (100 * F.least(n, n2) >= PERCENT * F.greatest(n, n2)) & ((100 + PERCENT) * differ <= (100 - PERCENT) * (n + n2))


def linked(common, na, nb):
    return 100 * common >= PERCENT * (na + nb - common)


def with_least(edges: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` (u, v; a written table) with ``m``, the least v of each u, and the table to forget afterwards.

    The minimum is combined before the shuffle; nodes with more edges than a partition's
    share are fewer than partitions, and get theirs from a broadcast.
    """
    limit = max(FEW, n_rows // partitions(edges.sparkSession))
    least = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")), "least")
    hubs = F.broadcast(least.where(F.col("k") > limit).select("u", F.col("m").alias("m_hub")))
    marked = edges.join(hubs, "u", "left")
    rest = marked.where("m_hub is null").select("u", "v").join(least.where(F.col("k") <= limit).select("u", "m"), "u")
    return rest.select("u", "v", "m").union(marked.where("m_hub is not null").select("u", "v", F.col("m_hub").alias("m"))), least


def _settled(batches):
    """The whole table of edges (u, v) to (node, component): roots hook on to smaller ones until every edge is within one tree."""
    parts = [[np.zeros(0, np.int64)] * 2, *([c.to_numpy() for c in batch.columns] for batch in batches)]
    nodes, at = np.unique(np.concatenate([x for side in zip(*parts) for x in side]), return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        x, y = root[u], root[v]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    for k in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(nodes[root[k : k + (1 << 16)]])], ["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, component): the smallest node reachable; only nodes of links appear."""
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = [F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))]
    before = edges.agg(*mark).first()
    if before[0] <= ALONE:
        return edges.coalesce(1).mapInArrow(_settled, "node long, component long")
    while before[0]:
        both = written(edges.union(edges.select(F.col("v"), F.col("u"))), "both")
        near, used = with_least(both, 2 * before[0])
        large = near.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u != v").distinct()
        large = written(large, "large")
        forget(both)
        forget(used)
        near, used = with_least(large, before[0])
        small = near.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        after = written(small, "edges")
        for old in (edges, large, used):
            forget(old)
        edges, last, before = after, before, after.agg(*mark).first()
        if last == before:
            break
    root = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return root.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def sided(lists: DataFrame, found: DataFrame, n_rows: int) -> DataFrame:
    """Members of pivots (a, b, j, n, sig, size) with their component ``c`` and the pivot's, ``cb``."""
    label = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    own = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    side = salted_join(lists.join(label, "a", "left"), own, ["b"], "a", n_rows, "left")
    return written(side.select("a", "b", "j", "n", "sig", "size", F.coalesce("ca", "a").alias("c"), F.coalesce("cb", "b").alias("cb")), "sides")


def chosen(side: DataFrame, turn: int) -> DataFrame:
    """About ``PICKS`` by hash of the members outside their pivot's component, of each size class that has more than ``CROWD``."""
    minor = side.where("c != cb")
    many = minor.groupBy("b", "size").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > CROWD)
    rows = salted_join(minor, many, ["b", "size"], "a", minor.count())
    return rows.where(F.pmod(F.xxhash64("a", F.lit(turn)), "k") < PICKS).select(*side.columns)


def open_pairs(some: DataFrame, side: DataFrame) -> DataFrame:
    """Members ``some`` of pivots against all members of the same pivot, in other components, whose bounds leave room for a link."""
    near_size = F.explode(F.array(*(F.col("size") + k for k in (-1, 0, 1)))).alias("size")
    other = side.select("b", near_size, *(F.col(x).alias(x + "2") for x in ("a", "j", "n", "sig", "c")))
    fits = (F.col("c") != F.col("c2")) & F.coalesce(F.abs(F.col("j") - F.col("j2")) <= 1 - PERCENT / 100 + 1e-9, F.lit(True))
    fits &= room(F.col("n"), F.col("n2"), F.col("sig"), F.col("sig2"))
    pairs = gridded_join(some.drop("cb"), other, ["b", "size"], "a", "a2", some.count() + 3 * side.count()).where(fits)
    return pairs.select(F.least("a", "a2").alias("a"), F.greatest("a", "a2").alias("b")).distinct()


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b; a written table) that link by their full sets."""
    sets = set_table(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    return overlaps(pairs, sets).where(linked(F.col("common"), F.col("na"), F.col("nb"))).select("a", "b")


def near_components(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    spark = session(docs)
    counts = spark.sparkContext.broadcast(sketch(docs))
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prefix_rows(counts), _PREFIX_SCHEMA), "prefixes")
    counts.unpersist()
    some = rows.where("n > 0 and doc_id is not null")
    # 1. Classes of equal sets; a doc_id with several texts links its classes.
    classes = written(some.groupBy("d1", "d2", "n", "g1", "g2", "sig").agg(F.min("doc_id").alias("rep")), "classes")
    n_rows = rows.count()
    same = salted_join(some.select("doc_id", "d1", "d2"), classes.select("d1", "d2", "rep"), ["d1", "d2"], "doc_id", n_rows).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    same, sizes = written(same, "same"), written(rows.select("doc_id", "n"), "counts")
    # Copies stay out of the components: they follow their representative. Only a doc_id with several texts links classes.
    several = same.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("k"))
    tied = same.join(several.where("k > 1"), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    tied = tied.union(same.join(classes.select(F.col("rep").alias("a")), "a", "left_semi").select("a", "b"))
    tied = written(tied.distinct(), "tied")
    # Representatives with several texts: a similarity of theirs may belong to any of them.
    texts = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("rep").alias("a"))
    mixed = written(texts.union(same.join(classes.select(F.col("rep").alias("a")), "a", "left_semi").select("a")).distinct(), "mixed")
    # 2. Groups of equal prefix and size; their leader is the smallest representative.
    alike, n_classes = ["g1", "g2", "n"], classes.count()
    least = classes.groupBy(*alike).agg(F.min("rep").alias("leader"))
    grouped = written(salted_join(classes.select(*alike, "rep", "sig"), least, alike, "rep", n_classes).select("rep", "n", "sig", "leader"), "groups")
    leaders = grouped.where("rep = leader").select("leader").distinct()
    index = rows.select(F.col("doc_id").alias("leader"), "prefix").join(leaders, "leader", "left_semi").select("leader", F.explode("prefix").alias("token"))
    met = meetings(index)
    forget(rows)
    # 3. Members against pivots, and against the leader of their own group.
    members = grouped.select("rep", "leader")
    stars = salted_join(members, met, ["leader"], "rep", n_classes).select(F.col("rep").alias("a"), F.col("pivot").alias("b")).union(members.where("rep != leader").select("rep", "leader"))
    hosts = met.select(F.col("pivot").alias("leader")).distinct()
    stars = stars.union(salted_join(members, hosts, ["leader"], "rep", n_classes).where("rep != leader").select("rep", "leader"))
    pairs = written(stars.distinct(), "pairs")
    n_pairs = pairs.count()
    bounds = grouped.select("rep", "n", "sig")
    near, far = (bounds.select(*(F.col(x).alias(y) for x, y in zip(("rep", "n", "sig"), z))) for z in (("a", "n", "sig"), ("b", "n2", "sig2")))
    both = salted_join(salted_join(pairs, near, ["a"], "b", n_pairs), far, ["b"], "a", n_pairs)
    both = both.select("a", "b", "n", "sig", room(F.col("n"), F.col("n2"), F.col("sig"), F.col("sig2")).alias("room"))
    stars = written(both, "stars")
    for used in (met, grouped, classes, pairs):
        forget(used)
    sets = set_table(docs, stars.where("room").select(F.explode(F.array("a", "b")).alias("id")).distinct())
    got = overlaps(stars.where("room").select("a", "b"), sets)
    share = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    got = got.groupBy("a", "b").agg(F.max(share).alias("j"), F.bool_or(linked(F.col("common"), F.col("na"), F.col("nb"))).alias("link"))
    checked = written(got, "checked")
    forget(sets)
    links = tied.union(checked.where("link").select("a", "b"))
    found = written(components(links), "components")
    # 4. What one pivot brought together without a link so far: members outside its component against all its members.
    known = checked.join(mixed, "a", "left_anti").join(mixed.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b", "j")
    lists = stars.join(known, ["a", "b"], "left")
    lists = written(lists.select("a", "b", "j", "n", "sig", F.floor(F.log("n") / CLASS_STEP).cast("int").alias("size")), "lists")
    # Near copies whose pivot is none of them are linked through a few of them first, so that they don't all meet one another.
    side = sided(lists, found, n_pairs)
    for turn in range(TURNS):
        few = written(chosen(side, turn), "few")
        open_ = written(open_pairs(few, side), "open")
        more = None if open_.isEmpty() else written(verified(docs, open_), "more")
        for used in (few, open_):
            forget(used)
        if more is None or more.isEmpty():
            break
        links = written(links.union(more), "links")
        found = written(components(links), "components")
        for used in (more, side):
            forget(used)
        side = sided(lists, found, n_pairs)
    left_over = written(open_pairs(side.where("c != cb"), side), "open")
    if not left_over.isEmpty():
        found = written(components(links.union(verified(docs, left_over))), "components")
    for used in (tied, mixed, stars, checked, lists, side, left_over):
        forget(used)
    # A document follows the component of its representative (itself, if it is one).
    rep = same.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("rep"))
    out = sizes.select("doc_id", F.col("n").alias("n_shingles")).join(rep, "doc_id", "left").withColumn("node", F.coalesce("rep", "doc_id"))
    out = written(out, "nodes")
    return salted_join(out, found, ["node"], "doc_id", n_rows, "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the least doc_id (null last), the first of equals.

    Rows are numbered in a written copy, and the numbers take the place of doc_ids in the join.
    """
    session(docs)
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = near_components(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("c")).where("c is not null")
    named = written(found.join(rows.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc")), "row"), "named")
    order = F.struct(F.col("doc").isNull().alias("none"), F.col("doc"), F.col("row"))
    stays = named.groupBy("c").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("c", "first.row")
    both = salted_join(named, stays.withColumnRenamed("row", "stays"), ["c"], "row", named.count())
    gone = both.where("row != stays").select(F.col("row").alias("__gone"))
    return rows.join(gone, F.col("__row") == F.col("__gone"), "left_anti").select(*docs.columns)
