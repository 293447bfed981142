"""Operator 1: token ids as directly addressable codes in ascending document order.

``write_tokens`` range-partitions documents by id, encodes every whole text and
writes one table row per segment (about ``SEGMENT_TOKENS`` ids, whole documents)
through Spark's own committer, so any file system that Spark writes works and a lost
executor only repeats its tasks. A directory beside them (``path``.index: the global start
of each segment, sorted) is written from their narrow columns. ``read_documents`` reads the
segments back; ``token_at`` looks positions up in the directory, whose row statistics skip
what doesn't hold them, and reads only the segments found, by part and number.

Defined cases: null or empty text gives the end id alone; a null doc_id sorts first;
repeated rows each get their own entry, in text order within a doc_id; an empty table
gives no segment; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dac
from .common import claim, holds, partitions, session, work_path

SEGMENT_TOKENS = 1 << 16
#: Bytes of pieces, their ids and 150 for each entry that a Python worker keeps; then the cache starts anew.
CACHE_BYTES, ENTRY_BYTES = 80 << 20, 150
#: Longer pieces (texts without spaces) aren't kept.
PIECE_CHARS = 256
#: Texts encoded together.
SLICE_ROWS = 256
END_ID = 0

SEGMENT_SCHEMA = "part int, seg int, start_in_part long, n_docs long, n_tokens long, first_doc long, last_doc long, data binary"
_loaded: dict[str, "PieceEncoder"] = {}
holds("tokens", _loaded.clear)


class _Pieces(dict):
    """Ids of pieces, worked out when a piece is first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, piece: str) -> bytes:
        got = self.make(piece)
        if len(piece) <= PIECE_CHARS:
            self[piece] = got
            self.held += len(piece) + len(got) + ENTRY_BYTES
        return got

    def drop(self) -> None:
        self.clear()
        self.held = 0


class PieceEncoder:
    """Encodes texts with a byte-level BPE tokenizer through a cache of space-led pieces.

    The tokenizer's pre-tokenizer always starts a token at the last space before a
    character that isn't white space, so a text without two spaces in a row encodes as
    the pieces between its spaces do, each with its leading space. A new piece made of
    letters, ASCII punctuation behind them and single line ends falls apart into
    pre-tokens in one way, so its letter runs go straight to the tokenizer's model; all
    other pieces, and texts with two spaces in a row, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The model's alphabet: printable bytes stand for themselves, the others follow from 256 on.
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = iter(range(256, 512))
        self.alphabet = {b: b if b in printable else next(others) for b in range(256)}
        self.space = chr(self.alphabet[0x20])
        self.first = _Pieces(lambda p: self._piece(p, "", ""))
        self.later = _Pieces(lambda p: self._piece(p, self.space, " "))
        self.parts: dict[str, bytes] = {}
        self.line_end = self._raw(["\n"])[0]

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, run: str, lead: str) -> bytes:
        """Ids of one pre-token: a run of letters or of punctuation."""
        spelled = run if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(lead + spelled)]).tobytes()

    def _simple(self, piece: str, lead: str) -> bytes | None:
        """Ids of a piece of the simple kinds, else None."""
        if piece.isalpha():
            return self._run(piece, lead)
        lines = piece.split("\n")
        out = []
        for k, line in enumerate(lines):
            stem = line.rstrip(punctuation)
            if not stem.isalpha():
                return None
            if k:
                out.append(self.line_end)
            cache = self.first if k or not lead else self.later
            if (got := cache.get(stem)) is None:
                got = self._run(stem, "" if k else lead)
                if len(stem) <= PIECE_CHARS:
                    cache[stem] = got
                    cache.held += len(stem) + len(got) + ENTRY_BYTES
            out.append(got)
            if tail := line[len(stem) :]:
                if (got := self.parts.get(tail)) is None:
                    got = self._run(tail, "")
                    if len(self.parts) < 10_000 and len(tail) <= PIECE_CHARS:
                        self.parts[tail] = got
                out.append(got)
        return b"".join(out)

    def _piece(self, piece: str, spelled: str, lead: str) -> bytes:
        ids = self._simple(piece, spelled)
        return self._raw([lead + piece])[0] if ids is None else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.first.held + self.later.held > CACHE_BYTES:
            self.first.drop()
            self.later.drop()
        later, out = self.later.__getitem__, []
        for text in texts:
            if "  " in text:
                out += self._raw([text])
            else:
                pieces = iter(text.split(" "))
                first = self.first[next(pieces)]
                out.append(first + b"".join(map(later, pieces)))
        return out


def encoder(path: str) -> PieceEncoder:
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def _segments(tokenizer_path: str):
    def run(batches):
        part, seg, start = TaskContext.get().partitionId(), 0, 0
        claim("tokens")
        coder, end = encoder(tokenizer_path), np.array([END_ID], "<u4").tobytes()
        docs, ends, data, held = [], [], [], 0

        def flush():
            nonlocal docs, ends, data, held, seg, start
            ids = np.frombuffer(b"".join(data), "<u4")
            row = {"part": part, "seg": seg, "start_in_part": start, "n_docs": len(docs), "n_tokens": len(ids), "first_doc": docs[0], "last_doc": docs[-1], "data": dac.pack(docs, ends, ids)}
            seg, start = seg + 1, start + len(ids)
            docs, ends, data, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(at, SLICE_ROWS)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc, ids in zip(some.column(0).to_pylist(), coder.encode(texts)):
                    data += (ids, end)
                    held += len(ids) // 4 + 1
                    docs.append(doc)
                    ends.append(held)
                    if held >= SEGMENT_TOKENS:
                        yield flush()
        if docs:
            yield flush()

    return run


_ARROW = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("start_in_part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("data", pa.binary())])


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> str:
    """Encode ``docs`` (doc_id, text, ...) and write the segments and their directory; returns the segments' path."""
    spark = session(docs)
    path = path or work_path(spark, "tokens")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(tokenizer_path), SEGMENT_SCHEMA).write.parquet(path)
    _with_starts(spark, path).select("start", (F.col("start") + F.col("n_tokens")).alias("end"), "part", "seg", "first_doc", "last_doc").repartitionByRange(partitions(spark), "start").sortWithinPartitions("start").write.parquet(f"{path}.index")
    return path


def _with_starts(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``: the number of ids in all segments before.

    The offsets of the range partitions come from a table with one row per partition,
    so the broadcast is bounded by the partition count.
    """
    rows = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(order), F.lit(0)).alias("part_start"))
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("start_in_part")).drop("part_start")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """The directory of segments: start, end (global positions), part, seg, first_doc, last_doc."""
    return spark.read.schema("start long, end long, part int, seg int, first_doc long, last_doc long").parquet(f"{path}.index")


def _digest(batches):
    for batch in batches:
        for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            segment = dac.Segment(data.as_buffer())
            ids = segment.tokens().astype("<u4")
            ends = segment.ends
            begins = np.concatenate([[0], ends[:-1]])
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(segment.doc_ids, pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens (with the end id), ids_crc32."""
    return _with_starts(spark, path).select("start", "data").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, path: str, positions: list[int]) -> dict[int, int]:
    """Ids at some global positions (a list that fits a filter): one lookup in the directory, one read of the segments that hold them."""
    inside = F.lit(False)
    for at in positions:
        inside |= (F.col("start") <= at) & (F.col("end") > at)
    places = {(r.part, r.seg): r.start for r in directory(spark, path).where(inside).collect()}
    wanted = F.lit(False)
    for part, seg in places:
        wanted |= (F.col("part") == part) & (F.col("seg") == seg)
    found = {}
    rows = spark.read.schema(SEGMENT_SCHEMA).parquet(path).where(wanted).select("part", "seg", "n_tokens", "data")
    for r in rows.toLocalIterator():  # one segment at a time
        segment, start = dac.Segment(bytes(r.data)), places[r.part, r.seg]
        found |= {at: segment.token(at - start) for at in positions if start <= at < start + r.n_tokens}
    return found
