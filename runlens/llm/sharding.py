"""Operator 5: shards of near-equal bytes by histogram sort.

Documents are sorted by (hash of the text, doc_id), so equal texts are neighbours and
the key space is even except for groups of copies. Splitters are found by rounds: each
round counts, for a set of probe keys, the exact bytes and rows between them across all
partitions (partial sums per task, one small row per probe to the driver), then narrows
every boundary to the one interval that holds its target. A hot group of copies is cut
inside by doc_id. Boundaries of shards must meet ``TOLERANCE``; a boundary inside a
group of equal texts moves to the group's edge where that costs at most
``GROUP_TOLERANCE``. A shard is cut into several tasks the same way, loosely. Row
counts below each splitter come out of the same histogram, so the only exchange of the
rows also gives their final slots.

Defined cases: null text has 0 bytes (size 1) and crc32 0; a null doc_id sorts first;
repeated rows have equal keys and sit side by side, possibly on both sides of a
boundary's neighbour but never across one; an empty table gives no rows; other columns
can be carried with ``columns``, under their name and ``_in`` where it is one of the result's.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, session, written

TOLERANCE = 0.0005
GROUP_TOLERANCE = 0.02
INNER_TOLERANCE = 0.1
#: Probes between two neighbouring bounds of one boundary in a round.
PROBES = 16
MAX_ROUNDS = 40
_LOW, _BIAS = -(1 << 63), 1 << 63


def _wide(h: int, doc: int) -> int:
    return (h + _BIAS) << 64 | (doc + _BIAS)


def _narrow(key: int) -> tuple[int, int]:
    return (key >> 64) - _BIAS, (key & ((1 << 64) - 1)) - _BIAS


def bins_of(h: np.ndarray, doc: np.ndarray, probes: list[int]) -> np.ndarray:
    """For each row the number of probes at or below its key."""
    pairs = [_narrow(p) for p in probes]
    ph, pd = np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)
    first, upto = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    out, tied = first.copy(), np.flatnonzero(upto > first)
    for k in np.unique(first[tied]):
        rows = tied[first[tied] == k]
        out[rows] += np.searchsorted(pd[k : upto[rows[0]]], doc[rows], "right")
    return out


def _histogram(probes: list[int]):
    """Partial sums per bin: bytes, rows, least and greatest key."""

    def run(batches):
        bins: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            h, doc, size = batch.column(0).to_numpy(), pc.fill_null(batch.column(1), _LOW).to_numpy(), batch.column(2).to_numpy()
            order = np.lexsort((doc, h))
            h, doc, size = h[order], doc[order], size[order]
            where = bins_of(h, doc, probes)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
            ends = np.append(starts[1:], len(where))
            for a, b, total in zip(starts, ends, np.add.reduceat(size, starts)):
                low, high = _wide(int(h[a]), int(doc[a])), _wide(int(h[b - 1]), int(doc[b - 1]))
                if got := bins.get(int(where[a])):
                    got[0] += int(total)
                    got[1] += int(b - a)
                    got[2], got[3] = min(got[2], low), max(got[3], high)
                else:
                    bins[int(where[a])] = [int(total), int(b - a), low, high]
        if bins:
            lows, highs = [_narrow(v[2]) for v in bins.values()], [_narrow(v[3]) for v in bins.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(bins)), pa.array([v[0] for v in bins.values()]), pa.array([v[1] for v in bins.values()]), *(pa.array([x[k] for x in xs], pa.int64()) for xs in (lows, highs) for k in (0, 1))], ["bin", "bytes", "n", "lh", "ld", "hh", "hd"])

    return run


def histogram(rows: DataFrame, probes: list[int]) -> list[tuple]:
    """(bytes, rows, least key, greatest key) between neighbouring probes; None for the keys of an empty bin."""
    part = rows.select("h", "doc_id", "size").mapInArrow(_histogram(probes), "bin long, bytes long, n long, lh long, ld long, hh long, hd long")
    got = part.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min(F.struct("lh", "ld")).alias("low"), F.max(F.struct("hh", "hd")).alias("high")).collect()
    out: list[tuple] = [(0, 0, None, None)] * (len(probes) + 1)
    for r in got:
        out[r.bin] = (r.bytes, r.n, _wide(*r.low), _wide(*r.high))
    return out


def splitters(rows: DataFrame, goals: list[tuple[int, float]]) -> list[int]:
    """Keys with ``goal`` bytes below them, for (goal, allowed miss) in ascending order of goal.

    The miss is met unless a single key's rows span it; then the nearer end of that key is taken.
    """
    found: dict[int, int] = {}
    span = {i: (0, (1 << 128) - 1) for i in range(len(goals))}
    for round_ in range(MAX_ROUNDS):
        if not span:
            break
        per = PROBES if round_ else max(PROBES, 4 * len(goals))
        probes = sorted({lo + (hi - lo) * k // per for lo, hi in set(span.values()) for k in range(per)} | {hi for _, hi in span.values()})
        bins = histogram(rows, probes)
        edges = np.concatenate([[0], np.cumsum([b[0] for b in bins], dtype=np.int64)])
        for i in list(span):
            goal, miss = goals[i]
            j = min(int(np.searchsorted(edges, goal, "right")) - 1, len(bins) - 1)
            while j > 0 and bins[j][2] is None:
                j -= 1
            _, _, low, high = bins[j]
            below, above = int(edges[j]), int(edges[j + 1])
            if low is None:
                found[i] = 0
            elif min(goal - below, abs(above - goal)) <= miss or low == high:
                found[i] = low if goal - below <= abs(above - goal) else high + 1
            else:
                span[i] = (low, high + 1)
                continue
            del span[i]
    if span:
        raise RuntimeError(f"{len(span)} splitters weren't settled in {MAX_ROUNDS} rounds")
    return [found[i] for i in range(len(goals))]


def plan(rows: DataFrame, n_shards: int, n_tasks: int) -> tuple[list[int], list[int], list[int]]:
    """Splitters of tasks, the shard of each task, the first slot of each task."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first().s
    per = max(1, math.ceil(n_tasks / n_shards))
    share, task = total / n_shards, total / (n_shards * per)
    goals = [(round(total * i / (n_shards * per)), (share * TOLERANCE if i % per == 0 else task * INNER_TOLERANCE)) for i in range(1, n_shards * per)]
    keys = splitters(rows, goals)
    outer = [per * s - 1 for s in range(1, n_shards)]
    # Where a shard's boundary cuts a group of equal texts, the group's nearer edge is taken if that is cheap.
    groups = {k: ((keys[k] >> 64) << 64, ((keys[k] >> 64) + 1) << 64) for k in outer if 0 < keys[k] < (1 << 128) - 1}
    groups = {k: (a, min(b, (1 << 128) - 1)) for k, (a, b) in groups.items()}
    probes = sorted({x for ab in groups.values() for x in ab})
    edges = dict(zip(probes, np.cumsum([b[0] for b in histogram(rows, probes)]).tolist())) if probes else {}
    for k, ab in groups.items():
        best = min(ab, key=lambda x: abs(edges[x] - goals[k][0]))
        if abs(edges[best] - goals[k][0]) <= share * GROUP_TOLERANCE:
            keys[k] = best
    for k in range(1, len(keys)):  # inner boundaries give way to those of shards
        keys[k] = max(keys[k], keys[k - 1])
    for k in range(len(keys) - 1, 0, -1):
        if k in outer:
            continue
        nxt = next((keys[o] for o in outer if o > k), (1 << 128) - 1)
        keys[k] = min(keys[k], nxt)
    counts = [0] * (len(keys) + 1)
    distinct = sorted(set(keys))
    # A bin of the histogram lies above all splitters equal to its lower probe: the last of them owns it.
    for j, b in enumerate(histogram(rows, distinct)):
        counts[0 if j == 0 else len(keys) - keys[::-1].index(distinct[j - 1])] += b[1]
    shards = [k // per for k in range(len(counts))]
    first, slots = {}, []
    for shard, n in zip(shards, counts):
        slots.append(first.get(shard, 0))
        first[shard] = slots[-1] + n
    return keys, shards, slots


def _assign(keys: list[int]):
    def run(batches):
        for batch in batches:
            h, doc = batch.column(0).to_numpy(), pc.fill_null(batch.column(1), _LOW).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins_of(h, doc, keys).astype(np.int32))], [*batch.schema.names, "task"])

    return run


def shard_documents(docs: DataFrame, n_shards: int = 8, columns: tuple[str, ...] = ()) -> DataFrame:
    """All documents with doc_id, size, text_crc32, law, shard, slot, grown_shard, and ``columns`` of theirs."""
    spark = session(docs)
    binary = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(F.xxhash64("text").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(binary) + 1).cast("long").alias("size"), F.crc32(binary).cast("long").alias("text_crc32"), F.struct(F.lit(0).alias("_"), *columns).alias("carried"))
    narrow = written(keyed.select("h", "doc_id", "size", "text_crc32"), "keys")
    n_tasks = partitions(spark)
    keys, shards, slots = plan(narrow, n_shards, n_tasks)
    rows = keyed if columns else narrow
    own = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    carried = [F.col("carried")[c].alias(c + "_in" if c in own else c) for c in columns]
    placed = rows.mapInArrow(_assign(keys), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", task int")
    # One row per task of the exchange: n_tasks rounded up to whole shards.
    tasks = spark.createDataFrame(list(zip(range(len(shards)), shards, slots)), "task int, shard int, first_slot long")
    sorted_ = placed.repartitionById(len(shards), F.col("task")).sortWithinPartitions("h", "doc_id")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = sorted_.withColumn("_inside", inside).join(F.broadcast(tasks), "task")
    return sorted_.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_slot") + F.col("_inside")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carried)
