"""Directly addressable codes for token ids.

Ids are cut into chunks of ``CHUNK_BITS`` bits. Level 0 holds the lowest chunk of
every id with one bit per entry that says whether the id goes on in the next level;
level k holds only the ids that got that far. The place of an id in the next level is
the rank of its continuation bit, found from a directory of counts per block of
``RANK_BLOCK`` bits. So the i-th id is read by one step per level, without decoding
any block.

Segment layout, little-endian: header, document directory (ids, null flags, token
ends), then for each level its chunks, continuation bitmap and rank directory.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"RLDAC01\0"
CHUNK_BITS = 8
RANK_BLOCK = 512
_HEAD = struct.Struct("<8sQQII")
_LEVEL = struct.Struct("<QQQQ")


def pack(doc_ids, ends, ids: np.ndarray) -> bytes:
    """A segment of whole documents; ``ends[i]`` is the number of ids up to the end of document i."""
    levels, current = [], np.asarray(ids, dtype=np.uint32)
    while True:
        rest = current >> CHUNK_BITS
        more = rest > 0
        levels.append(((current & 0xFF).astype(np.uint8), more))
        if not more.any():
            break
        current = rest[more]
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    body = [np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(), nulls.tobytes(), np.asarray(ends, dtype="<i8").tobytes()]
    table, at = [], _HEAD.size + _LEVEL.size * len(levels) + sum(map(len, body))
    for chunks, more in levels:
        bits = np.packbits(more, bitorder="little").tobytes()
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = (np.cumsum(counts) - counts).astype("<u4").tobytes()
        parts = [chunks.tobytes(), bits, ranks]
        table.append(_LEVEL.pack(len(chunks), at, at + len(parts[0]), at + len(parts[0]) + len(parts[1])))
        at += sum(map(len, parts))
        body += parts
    return b"".join([_HEAD.pack(MAGIC, len(ids), len(doc_ids), len(levels), CHUNK_BITS), *table, *body])


class Segment:
    """Read access to a packed segment; nothing is decoded until it is asked for."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.n_tokens, self.n_docs, n_levels, bits = _HEAD.unpack_from(self.data, 0)
        if magic != MAGIC or bits != CHUNK_BITS:
            raise ValueError("not a segment of this format")
        self.levels = [_LEVEL.unpack_from(self.data, _HEAD.size + k * _LEVEL.size) for k in range(n_levels)]
        at = _HEAD.size + n_levels * _LEVEL.size
        raw = np.frombuffer(self.data, "<i8", self.n_docs, at)
        nulls = np.frombuffer(self.data, np.uint8, self.n_docs, at + 8 * self.n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(raw, nulls)]
        self.ends = np.frombuffer(self.data, "<i8", self.n_docs, at + 9 * self.n_docs)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before entry ``i``: one directory entry and the bits of one block."""
        _, _, bits, ranks = self.levels[level]
        block = i // RANK_BLOCK
        first = struct.unpack_from("<I", self.data, ranks + 4 * block)[0]
        start, end = bits + block * RANK_BLOCK // 8, bits + (i + 7) // 8
        value = int.from_bytes(self.data[start:end], "little") & ((1 << (i - block * RANK_BLOCK)) - 1)
        return first + value.bit_count()

    def token(self, i: int) -> int:
        """The i-th id of the segment by random access."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            value |= self.data[chunks + i] << shift
            if not self.data[bits + i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + CHUNK_BITS
        return value

    def tokens(self) -> np.ndarray:
        """All ids, from the last level upwards."""
        deeper = np.zeros(0, np.uint32)
        for n, chunks, bits, _ in reversed(self.levels):
            values = np.frombuffer(self.data, np.uint8, n, chunks).astype(np.uint32)
            more = np.unpackbits(np.frombuffer(self.data, np.uint8, (n + 7) // 8, bits), count=n, bitorder="little").astype(bool)
            values[more] |= deeper << CHUNK_BITS
            deeper = values
        return deeper
