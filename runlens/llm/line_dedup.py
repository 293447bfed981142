"""Operator 2: line deduplication by sorted hash streams and per-document keep bitmaps.

A line's key is the line without ASCII white space at both ends and with A-Z in lower
case. Each document first collapses its own repeats: one row (128-bit key hash,
document, positions) per distinct key. Rows are range-partitioned by (hash, doc_id) --
so one very common line spreads over several partitions -- and sorted within; a stream
over each partition decides every run of equal hashes. Only the first and last run of a
partition can go on in a neighbour: if such a run is still below the limit, its few
members (fewer than the limit) and its count are settled afterwards from a table of at
most two counts a partition. Texts are not moved: the result is a compressed bitmap of
kept lines per document. Who needs the kept text joins bitmaps to texts (``with_bitmaps``),
which moves both once; ``line_dedup_digest`` and the registered query do that.

``keep="none"`` drops all lines of a key found in at least ``min_docs`` documents;
``keep="first"`` leaves the first occurrence by (doc_id, position).

Defined cases: null or empty text is one empty line; keys shorter than ``min_chars``
code points are never dropped; rows that share a doc_id count as one document; a null
doc_id is a document of its own, first in order; repeated rows get the same bitmap; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, forget, partitions, session, written

HEADER, DROP, OPEN, EDGE = 0, 1, 2, 3
_LINES = "kind int, h1 long, h2 long, doc_id long, tkey long, pos array<int>"
_DECIDED = _LINES + ", head boolean, n long"
_LINES_ARROW = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("tkey", pa.int64()), ("pos", pa.list_(pa.int32()))])
_DECIDED_ARROW = pa.schema([*_LINES_ARROW, ("head", pa.bool_()), ("n", pa.int64())])


def _explode(min_chars: int):
    """(doc_id, tkey, text) to one header row a document and one row per distinct key."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                kinds, hashes, docs, tkeys, lengths, flat = [], [], [], [], [0], []
                for doc, tkey, text in zip(*(c.to_pylist() for c in some.columns)):
                    lines = (text or "").encode().split(b"\n")
                    kinds.append(HEADER)
                    hashes.append(b"\0" * 16)
                    flat.append(len(lines))
                    lengths.append(len(flat))
                    seen: dict[bytes, list[int]] = {}
                    for k, line in enumerate(lines):
                        key = line.strip(SPACE_BYTES).lower()
                        if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars):
                            if key in seen:
                                seen[key].append(k)
                            else:
                                seen[key] = [k]
                    for key, where in seen.items():
                        hashes.append(digest(key))
                        flat += where
                        lengths.append(len(flat))
                    kinds += [DROP] * len(seen)
                    docs += [doc] * (len(seen) + 1)
                    tkeys += [tkey] * (len(seen) + 1)
                both = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(docs, pa.int64()), pa.array(tkeys, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int32()))],
                    schema=_LINES_ARROW,
                )

    return run


def _decide(min_docs: int, first: bool):
    """Stream over sorted rows of a partition; yields DROP rows, and OPEN and EDGE rows for its outer runs."""

    def typed(rows: pa.RecordBatch, kind: int, heads=None) -> pa.RecordBatch:
        n = rows.num_rows
        heads = pa.array(np.zeros(n, bool) if heads is None else heads)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *rows.columns[1:], heads, pa.nulls(n, pa.int64())], schema=_DECIDED_ARROW)

    def edge(key, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"kind": EDGE, "h1": key[0], "h2": key[1], "n": n}], schema=_DECIDED_ARROW)

    def without_first(rows: pa.RecordBatch) -> pa.RecordBatch:
        """The first row loses its first position: that occurrence stays."""
        pos = rows.column(5).to_pylist()
        pos[0] = pos[0][1:]
        return pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array(pos, pa.list_(pa.int32()))], schema=_LINES_ARROW)

    def finish(run, outer: bool):
        """``run``: key, documents so far, rows not yet given out (None once decided)."""
        key, n, rows, opened = run
        if outer and rows is not None:
            heads = np.zeros(rows.num_rows, bool)
            heads[0] = True
            yield typed(rows, OPEN, heads)
        elif rows is not None and n >= min_docs:
            yield typed(without_first(rows) if first else rows, DROP)
        if outer or opened:
            yield edge(key, n)

    def run(batches):
        current, last_doc, at_start = None, None, True  # current: [key, n, rows, outer]
        last_row = None
        for batch in batches:
            if batch.num_rows:  # rows repeated in the table give equal rows: one of them is enough
                keys = [pc.fill_null(batch.column(k), 0).to_numpy() for k in (1, 2, 3, 4)] + [batch.column(3).is_null().to_numpy(zero_copy_only=False)]
                same = np.concatenate([[tuple(k[0] for k in keys) == last_row], np.all([k[1:] == k[:-1] for k in keys], axis=0)])
                last_row = tuple(k[-1] for k in keys)
                batch = batch.filter(pa.array(~same)) if same.any() else batch
            if not batch.num_rows:
                continue
            h1, h2 = (batch.column(k).to_numpy() for k in (1, 2))
            docs = batch.column(3)
            ids, nulls = pc.fill_null(docs, 0).to_numpy(), docs.is_null().to_numpy(zero_copy_only=False)
            change = (np.diff(h1) != 0) | (np.diff(h2) != 0)
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            ends = np.append(starts[1:], len(h1))
            new_doc = np.concatenate([[True], change | (np.diff(ids) != 0) | (np.diff(nulls.astype(np.int8)) != 0)])
            counts = np.add.reduceat(new_doc, starts, dtype=np.int64)
            inner = np.zeros(len(h1), bool)
            for k in sorted({0, len(starts) - 1}):
                a, b, key = starts[k], ends[k], (int(h1[starts[k]]), int(h2[starts[k]]))
                rows, n = batch.slice(a, b - a), int(counts[k])
                if k == 0 and current is not None and current[0] == key:
                    n -= (ids[0], nulls[0]) == last_doc
                    current[1] += n
                    if current[2] is not None:
                        current[2] = pa.Table.from_batches([current[2], rows]).combine_chunks().to_batches()[0]
                    else:
                        yield typed(rows, DROP)
                else:
                    if current is not None:
                        yield from finish(current, current[3])
                    if k and len(starts) > 2:
                        # All runs between the first and the last of the batch are whole.
                        mask = np.repeat(counts[1:-1] >= min_docs, np.diff(starts[1:]))
                        inner[starts[1] : starts[-1]] = mask
                        if mask.any():
                            chosen = batch.filter(pa.array(inner))
                            if first:
                                heads = np.isin(np.flatnonzero(inner), starts)
                                pos = [p[1:] if h else p for p, h in zip(chosen.column(5).to_pylist(), heads)]
                                chosen = pa.RecordBatch.from_arrays([*chosen.columns[:5], pa.array(pos, pa.list_(pa.int32()))], schema=_LINES_ARROW)
                            yield typed(chosen, DROP)
                    current = [key, n, rows, at_start]
                at_start = False
                # A run that has reached the limit needs no memory any more.
                if current[1] >= min_docs and current[2] is not None:
                    if first:  # whether its head is the first of all is settled with the neighbours
                        yield typed(current[2].slice(0, 1), OPEN, [True])
                        current[2], current[3] = current[2].slice(1), True
                    yield typed(current[2], DROP)
                    current[2] = None
            last_doc = (ids[-1], nulls[-1])
        if current is not None:
            yield from finish(current, True)

    return run


def _bitmaps(batches):
    for batch in batches:
        doc, tkey, n_lines, dropped = batch.columns
        counts, maps = [], []
        for n, where in zip(n_lines.to_pylist(), dropped.to_pylist()):
            keep = np.ones(n, bool)
            keep[[p for some in where for p in some]] = False
            counts.append(int(n - keep.sum()))
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([doc, tkey, n_lines, pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "tkey", "n_lines", "n_dropped", "keep_bitmap"])


def line_keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """Per document: doc_id, tkey (hash of the text), n_lines, n_dropped, keep_bitmap (zlib, little bit order)."""
    spark = session(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")
    lines = written(keyed.mapInArrow(_explode(min_chars), _LINES), "lines")
    ordered = lines.where(F.col("kind") == DROP).repartitionByRange(partitions(spark), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "tkey")
    decided = written(ordered.mapInArrow(_decide(min_docs, keep == "first"), _DECIDED), "decided")
    # At most two counts and 2 * min_docs open documents a partition.
    totals = decided.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("n").alias("n_all")).where(F.col("n_all") >= min_docs)
    opened = decided.where(F.col("kind") == OPEN).join(totals, ["h1", "h2"])
    pos = F.col("pos")
    if keep == "first":
        firsts = opened.where("head").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "tkey")).alias("first"))
        opened = opened.join(firsts, ["h1", "h2"])
        is_first = F.col("head") & F.struct("doc_id", "tkey").eqNullSafe(F.col("first"))
        pos = F.when(is_first, F.slice(pos, 2, F.size(pos))).otherwise(pos)
    drops = decided.where(F.col("kind") == DROP).select("doc_id", "tkey", "pos").union(opened.select("doc_id", "tkey", pos.alias("pos")))
    heads = lines.where(F.col("kind") == HEADER).select("doc_id", "tkey", F.col("pos")[0].alias("n_lines"), F.lit(None).cast("array<int>").alias("pos"))
    both = heads.unionByName(drops.withColumn("n_lines", F.lit(None).cast("int")))
    grouped = both.groupBy("doc_id", "tkey").agg(F.max("n_lines").cast("long").alias("n_lines"), F.collect_list("pos").alias("dropped"))
    out = written(grouped.mapInArrow(_bitmaps, "doc_id long, tkey long, n_lines long, n_dropped long, keep_bitmap binary"), "bitmaps")
    forget(lines)
    forget(decided)
    return out


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and keep_bitmap; joined by doc_id and text hash, nulls equal.

    Columns of ``docs`` with these three names give way.
    """
    own = ["n_lines", "n_dropped", "keep_bitmap"]
    marked = docs.drop(*own).withColumn("__text", F.xxhash64("text"))
    found = bitmaps.select(F.col("doc_id").alias("__doc"), F.col("tkey").alias("__tkey"), *own)
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__tkey"))
    return marked.join(found, match).drop("__doc", "__text", "__tkey")


def kept_text(text: str | None, n_dropped: int, bitmap: bytes) -> str:
    if not n_dropped:
        return text or ""
    lines = (text or "").split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines), bitorder="little")
    return "\n".join(line for line, stays in zip(lines, keep) if stays)


def _digest(batches):
    for batch in batches:
        doc, text, n_lines, n_dropped, bitmap = batch.columns
        shas = [hashlib.sha256(kept_text(t, n, b).encode()).hexdigest() for t, n, b in zip(text.to_pylist(), n_dropped.to_pylist(), bitmap.to_pylist())]
        yield pa.RecordBatch.from_arrays([doc, n_lines, n_dropped, pa.array(shas)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_dedup_digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Counts and the SHA-256 of each document's kept lines."""
    rows = with_bitmaps(docs.select("doc_id", "text"), line_keep_bitmaps(docs, min_docs, min_chars))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_lines", "n_dropped", "keep_bitmap").mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
