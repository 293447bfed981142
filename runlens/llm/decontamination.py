"""Operator 6: benchmark decontamination by rare word pairs as seeds and local alignment.

A pair of document and item counts if Smith-Waterman over words (match 2, else -1)
reaches ``MIN_SCORE`` of a full match. No such pair is lost before the alignment: if M
matches and E errors score 2M - E >= S, the M - 1 steps from match to match hold at most
2M - S errors, so 2 x (steps without error) + (steps with one) >= S - 2. Such a step
takes a word and the next or next but one of the item to a word and the next or next but
one of the document. Seeds are these word pairs, from the places of an item where
they are rarest in the documents (one pass counts); at least (S - 1) // 2 places must
be hit, so all places but (S - 1) // 2 - 1 of the most common are enough. A second pass
finds seeds in each document, opens a window that holds every alignment through them,
and aligns it if its pairs can reach S - 2.

Both passes are map-only: the benchmark travels to the documents, in blocks of at most
``BLOCK_BYTES`` of text, one pass pair a block. The bound holds whatever the items are:
equal items (same words) are one entry, joined to their ids afterwards; an item over
``PIECE_WORDS`` words is cut into even pieces, each with a score of its own (pieces share
out any alignment's score, so a document that reaches the item's score reaches a piece's);
words over ``WORD_CHARS`` characters stand as their hash. Blocks are packed from exact
sums per hash bucket, cut finer until no bucket exceeds a block. With several blocks each
one's hits are written and its broadcast destroyed before the next.

Defined cases: words are runs of letters and digits in lower case; items with fewer than
``N`` words, null or empty, have no seeds and match nothing; a null item_id is an item;
repeated items and repeated documents give repeated pairs; null or empty documents match
nothing; an empty table on either side gives no pairs; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, forget, session, written

N = 3
MATCH, MISS, GAP = 2, -1, -1
MIN_SCORE = 0.5
BLOCK_BYTES = 4 << 20
PIECE_WORDS, WORD_CHARS = 2048, 64
_WORD = re.compile(r"\w+")


def word_list(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def short(word: str) -> str:
    """The word, or a mark of its hash if it is long."""
    return word if len(word) <= WORD_CHARS else f"#{xxhash.xxh3_128_hexdigest(word)}"


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over word numbers: best score, first and last position in ``text`` (inclusive).

    A row at a time; the horizontal gap recursion is a running maximum.
    """
    j = np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1, np.int64)
    origin_above = j.copy()
    best, span = 0, (0, -1)
    for word in item:
        step = np.where(text == word, MATCH, MISS)
        row, origin = np.zeros_like(above), j.copy()
        diagonal, vertical = above[:-1] + step, above[1:] + GAP
        take = diagonal >= vertical
        value = np.where(take, diagonal, vertical)
        positive = value > 0
        row[1:] = np.where(positive, value, 0)
        origin[1:] = np.where(positive, np.where(take, origin_above[:-1], origin_above[1:]), j[1:])
        lifted = row - GAP * j
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, j, 0))
        horizontal = top + GAP * j
        better = horizontal > row
        row, origin = np.where(better, horizontal, row), np.where(better, origin[source], origin)
        end = int(row.argmax())
        if row[end] > best:
            best, span = int(row[end]), (int(origin[end]), end - 1)
        above, origin_above = row, origin
    return best, *span


def needed(n: int) -> int:
    """Score that an item of ``n`` words has to reach."""
    return math.ceil(MIN_SCORE * MATCH * n)


class Block:
    """Benchmark pieces of one block with their vocabulary and word pairs."""

    def __init__(self, pieces: list[tuple[tuple, str]]):
        self.ids, self.words = [], []
        self.vocabulary: dict[str, int] = {}
        for key, text in pieces:
            self.ids.append(key)
            self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.split(" ")], np.int64))
        self.hashed = any(w[0] == "#" for w in self.vocabulary)
        self.base = len(self.vocabulary) + 1  # under 2^31, as a block's text is bounded: a pair's number fits
        codes = [(self.codes(w, 1), self.codes(w, 2)) for w in self.words]
        self.grams = np.unique(np.concatenate([c for both in codes for c in both])) if codes else np.zeros(0, np.int64)
        #: Pairs of neighbours and of next neighbours, by the place of their first word.
        self.item_grams = [tuple(np.searchsorted(self.grams, c) for c in both) for both in codes]

    def codes(self, ids: np.ndarray, step: int) -> np.ndarray:
        """The number of each pair of words ``step`` apart; 0 where a word is outside the vocabulary."""
        first, second = ids[:-step], ids[step:]
        return np.where((first > 0) & (second > 0), first * self.base + second, 0)

    def numbers(self, text: str | None) -> np.ndarray:
        words = word_list(text)
        if self.hashed:
            words = list(map(short, words))
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of item pairs in a text, the pairs' indexes, and whether the text's words are neighbours."""
        found = []
        for step in (1, 2):
            codes = self.codes(ids, step)
            at = np.flatnonzero(codes)
            index = np.searchsorted(self.grams, codes[at])
            same = self.grams[np.minimum(index, len(self.grams) - 1)] == codes[at] if len(at) else np.zeros(0, bool)
            found.append((at[same], index[same], np.full(int(same.sum()), step == 1)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def choose(self, counts: np.ndarray) -> None:
        """Seeds: the pairs of an item's rarest places, so many that an alignment that counts hits one."""
        gram, item, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, (near, far) in enumerate(self.item_grams):
            common = counts[near]
            common[:-1] += counts[far]
            must = (needed(len(self.words[i])) - 1) // 2
            rare = np.argsort(common, kind="stable")[: len(near) - must + 1]
            inner = rare[rare < len(far)]
            gram += [near[rare], far[inner]]
            place += [rare, inner]
            item.append(np.full(len(rare) + len(inner), i))
        gram, item, place = np.concatenate(gram), np.concatenate(item), np.concatenate(place)
        order = np.argsort(gram, kind="stable")
        self.seed_item, self.seed_place = item[order], place[order]
        self.seed_start = np.searchsorted(gram[order], np.arange(len(self.grams) + 1))

    def matches(self, text: str | None) -> list[tuple]:
        """(piece's key, score, first word, last word) of each piece that the text holds."""
        ids = self.numbers(text)
        at, grams, near = self.hits(ids)
        first, count = self.seed_start[grams], self.seed_start[grams + 1] - self.seed_start[grams]
        if not count.sum():
            return []
        seeds = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        items, starts = self.seed_item[seeds], np.repeat(at, count) - self.seed_place[seeds]
        order = np.lexsort((starts, items))
        windows = defaultdict(list)
        for item, start in zip(items[order].tolist(), starts[order].tolist()):
            n = len(self.words[item])
            slack = MATCH * n - needed(n)  # an alignment that counts has no more errors
            a, b = max(0, start - slack), min(len(ids), start + n + slack)
            merged = windows[item]
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out = []
        for item, merged in windows.items():
            words, need, best = self.words[item], needed(len(self.words[item])), (0, 0, -1)
            for a, b in merged:
                if self.reaches(item, need, a, b, at, grams, near):
                    score, first, last = align(words, ids[a:b])
                    best = max(best, (score, a + first, a + last), key=lambda x: x[0])
            if best[0] >= need:
                out.append((*self.ids[item], best[0] / (MATCH * len(words)), best[1], best[2]))
        return out

    def reaches(self, item: int, need: int, a: int, b: int, at: np.ndarray, grams: np.ndarray, near: np.ndarray) -> bool:
        """Whether the pairs between two places of a text leave the needed score open."""
        inside = (at >= a) & (at < b)
        pairs, (mine, far) = grams[inside], self.item_grams[item]
        weight = np.isin(mine, pairs).astype(np.int64)
        weight[:-1] |= np.isin(far, pairs)
        weight[np.isin(mine, grams[inside & near])] = 2
        return int(weight.sum()) >= need - 2


def _counts(shared):
    def run(batches):
        claim("")
        block = shared.value
        counts = np.zeros(len(block.grams), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                grams = block.hits(block.numbers(text))[1]
                if len(grams):
                    counts[np.unique(grams)] += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["gram", "n"])

    return run


def _pieces(batches):
    for batch in batches:
        keys, rows = [], []
        for item, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = list(map(short, word_list(text)))
            if len(words) >= N:
                key = np.frombuffer(xxhash.xxh3_128_digest(" ".join(words)), np.int64).tolist()
                n = -(-len(words) // PIECE_WORDS)
                cuts = [len(words) * k // n for k in range(n + 1)]
                rows += [(item, *key, k, " ".join(words[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["item_id", "k1", "k2", "piece", "words"])


def packed(pieces: DataFrame, block_bytes: int) -> list[tuple[int, list[int]]]:
    """(buckets in all, buckets of this block) of each block; no block has more than ``block_bytes`` of words."""
    size = F.octet_length("words") + 1
    total = pieces.agg(F.coalesce(F.sum(size), F.lit(0)).alias("s")).first().s
    n = 1 if total <= block_bytes else 8 * math.ceil(total / block_bytes)
    while True:  # ends: distinct pieces part sooner or later, and one is far smaller than a block
        sums = {r.b: r.s for r in pieces.groupBy(F.pmod("h", F.lit(n)).alias("b")).agg(F.sum(size).alias("s")).collect()}
        if max(sums.values(), default=0) <= block_bytes:
            break
        n *= 4
    blocks, held = [], 0
    for b in sorted(sums):
        if not blocks or held + sums[b] > block_bytes:
            blocks.append((n, []))
            held = 0
        blocks[-1][1].append(b)
        held += sums[b]
    return blocks


def prepared(docs: DataFrame, pieces: DataFrame, n: int, buckets: list[int]):
    """One block, broadcast, with seeds chosen by the counts in ``docs``."""
    spark = session(docs)
    part = pieces.where(F.pmod("h", F.lit(n)).isin(buckets)).select("k1", "k2", "piece", "words").collect()  # checked by packed()
    block = Block(sorted(((r.k1, r.k2, r.piece), r.words) for r in part))
    shared = spark.sparkContext.broadcast(block)
    counts = np.zeros(len(block.grams), np.int64)
    for r in docs.select("text").mapInArrow(_counts(shared), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r.gram] = r.n
    shared.destroy()
    block.choose(counts)
    return spark.sparkContext.broadcast(block)


def _hits(shared):
    def run(batches):
        claim("")
        block = shared.value
        for batch in batches:
            doc, tkey, text = batch.columns
            rows = [(d, t, *match) for d, t, x in zip(doc.to_pylist(), tkey.to_pylist(), text.to_pylist()) for match in block.matches(x)]
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _HIT_TYPES)], _HIT_NAMES)

    return run


_HIT_NAMES = ["doc_id", "tkey", "k1", "k2", "piece", "score", "first_word", "last_word"]
_HIT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
_HIT_SCHEMA = "doc_id long, tkey long, k1 long, k2 long, piece int, score double, first_word long, last_word long"


def _entries(benchmark: DataFrame, block_bytes: int):
    """Pieces of distinct items, the ids of each item, and the blocks."""
    session(benchmark)
    rows = written(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_pieces, "item_id long, k1 long, k2 long, piece int, words string"), "items")
    pieces = rows.groupBy("k1", "k2", "piece").agg(F.min("words").alias("words")).withColumn("h", F.xxhash64("k1", "k2", "piece"))
    pieces = written(pieces, "pieces")
    return pieces, rows.where("piece = 0").select("item_id", "k1", "k2"), packed(pieces, block_bytes)


def _found(docs: DataFrame, pieces: DataFrame, blocks: list) -> DataFrame:
    """Hits of all blocks; those of several blocks are written one after the other."""
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text"), None
    for block in blocks:
        shared = prepared(docs, pieces, *block)
        hits = rows.mapInArrow(_hits(shared), _HIT_SCHEMA)
        if len(blocks) > 1:
            hits = written(hits, "hits")
            shared.destroy()
        out = hits if out is None else out.union(hits)
    return docs.sparkSession.createDataFrame([], _HIT_SCHEMA) if out is None else out


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document, item and piece found: doc_id, item_id, piece (0 unless the item is cut), score (share of the piece's full match), first_word, last_word."""
    pieces, owners, blocks = _entries(benchmark, block_bytes)
    return _found(docs, pieces, blocks).join(owners, ["k1", "k2"]).select("doc_id", "item_id", "piece", "score", "first_word", "last_word")


def _clean(shared, column: int):
    def run(batches):
        claim("")
        block = shared.value
        for batch in batches:
            yield batch.filter(pa.array([not block.matches(t) for t in batch.column(column).to_pylist()], pa.bool_()))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold an item.

    Rows never move while the benchmark is one block; else they are joined to the written hits.
    """
    pieces, _, blocks = _entries(benchmark, block_bytes)
    if len(blocks) == 1:
        shared = prepared(docs, pieces, *blocks[0])
        forget(pieces)
        return docs.mapInArrow(_clean(shared, docs.columns.index("text")), docs.schema)
    hits = _found(docs, pieces, blocks).select(F.col("doc_id").alias("__hit_doc"), F.col("tkey").alias("__hit_text")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__hit_doc")) & (F.xxhash64("text") == F.col("__hit_text"))
    return docs.join(hits, same, "left_anti")
