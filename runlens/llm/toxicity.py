"""Operator 3: toxicity by a convolutional text classifier trained in numpy.

Words are hashed; a word's embedding is the sum of the hashed embeddings of the word
and of its first four to seven letters, so that unseen inflections of a stem share its
parameters. Filters of widths 1, 2 and 3 run over the embeddings, ReLU and max pooling
over the whole text follow, and a logistic layer gives the score. Training (Adam, numpy,
a batch of texts at a time) reads every labelled row in every epoch, in tasks: rows are dealt
by hash of doc_id into shards of about ``SHARD_ROWS``, a task trains a shard (in pieces of at
most ``SHARD_BYTES`` of features) from the common state, and the states, which are all that
moves, are averaged after every ``ROUND`` epochs, weighted by rows, an embedding over the
pieces that used it. One shard trains all its epochs at once. The driver holds one state,
whatever the input. Scoring covers every text whole: long texts run in blocks that overlap by
the widest filter, so memory is bounded.

Thresholds are calibrated by language on a fifth of the labelled rows by hash, which training
leaves out: the score (in steps of 1/``BINS``, counted over all those rows) with the best F1,
drawn towards that of all languages (``0.3`` without positives) as if the latter rested on
``POOL`` positives. They are reported beside the score; lang, source, doc_id and labels never
enter it.

Defined cases: null and empty texts get the score of the bias alone; labels without a
document, or null labels, are ignored; a doc_id with several texts is trained on the least
by hash; a label table with a single class gives its smoothed share as every score, one
without labels gives 0; repeated rows score alike; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import copy
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, forget, holds, partitions, session, written
from .jaccard_join import bit_table

#: Labelled rows of a shard, and most bytes of features that a task trains on at once.
SHARD_ROWS, SHARD_BYTES = 1 << 14, 64 << 20
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 16, (1, 2, 3)
EPOCHS, MIN_STEPS, BATCH, RATE = 6, 600, 32, 0.02
#: Epochs that shards train between two averages of their states.
ROUND = 2
THRESHOLD = 0.3
#: Rows of the table that are averaged together, and steps of scores that thresholds are told in.
ROWS_CHUNK, BINS = 1 << 10, 1 << 12
CALIBRATE_EVERY = 5
POOL = 10
BLOCK_WORDS = 1 << 14
MEMO_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of the prefixes that a word is embedded by, besides the whole word.
PREFIXES = (4, 5, 6, 7)
PARTS = 1 + len(PREFIXES)
_STARTS = [(k, zlib.crc32(b"%d" % k)) for k in PREFIXES]


def word_buckets(word: str) -> tuple[int, ...]:
    half = BUCKETS // 2
    return (zlib.crc32(word.encode()) % half, *(half + zlib.crc32(word[:k].encode(), start) % half for k, start in _STARTS))


class _Places(dict):
    """The row of ``rows`` that has a word's buckets, for a bounded number of words."""

    def __init__(self):
        self.rows = np.zeros((MEMO_WORDS, PARTS), np.int32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        self.rows[at] = word_buckets(word)
        self[word] = at
        return at


_places = _Places()
holds("buckets", _places.clear)


def features(text: str | None) -> np.ndarray:
    """An array of PARTS bucket numbers per word of the whole text."""
    found = _WORD.findall((text or "").lower())
    out = np.empty((len(found), PARTS), np.int32)
    for at in range(0, len(found), BLOCK_WORDS):
        some = found[at : at + BLOCK_WORDS]
        if len(_places) + len(some) > MEMO_WORDS:
            _places.clear()
        np.take(_places.rows, np.fromiter(map(_places.__getitem__, some), np.int64, len(some)), axis=0, out=out[at : at + len(some)])
    return out


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.prior, self.step = None, 0
        self.m, self.v = ([np.zeros_like(p) for p in self.dense()] for _ in range(2))
        self.mt, self.vt = np.zeros_like(self.table), np.zeros_like(self.table)

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, *self.bias, self.out, self.out_bias]

    def pooled(self, x: np.ndarray):
        """Max over the text of each filter's response, and where it is; empty texts pool to 0."""
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        where = np.full(len(best), -1)
        for start in range(0, len(x), BLOCK_WORDS):
            part = self.table[x[start : start + BLOCK_WORDS + max(WIDTHS) - 1]].sum(1)
            for k, (w, f, b) in enumerate(zip(WIDTHS, self.filters, self.bias)):
                n = len(part) - w + 1
                if n < 1:
                    continue
                z = part[:n] @ f[0]
                for d in range(1, w):
                    z += part[d : d + n] @ f[d]
                top = z.argmax(0)
                value = z[top, np.arange(FILTERS)] + b
                cols = np.arange(k * FILTERS, (k + 1) * FILTERS)
                better = value > best[cols]
                best[cols[better]], where[cols[better]] = value[better], top[better] + start
        return best, where

    def logit(self, x: np.ndarray) -> float:
        return float(self.pooled(x)[0] @ self.out + self.out_bias[0])

    def probability(self, x: np.ndarray) -> float:
        if self.prior is not None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30))))

    def forward(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch of texts: pooled responses, the first word of each filter's best window (-1: none), words' embeddings.

        The texts stand behind one another.
        """
        lengths = np.array([len(t) for t in texts])
        x, starts = np.concatenate([*texts, np.zeros((0, PARTS), np.int32)]), np.cumsum(lengths) - lengths
        embedded = np.zeros((len(x), DIM), np.float32)
        for part in range(PARTS):
            embedded += np.take(self.table, x[:, part], axis=0)
        best = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        where = np.full(best.shape, -1)
        for k, (w, f, b) in enumerate(zip(WIDTHS, self.filters, self.bias)):
            rows = np.flatnonzero(lengths >= w)
            if not len(rows):
                continue
            n = len(x) - w + 1
            z = embedded[:n] @ f[0]
            for d in range(1, w):
                z += embedded[d : d + n] @ f[d]
            # One slice a text leaves out windows that reach into the next; a batch is few texts of many words.
            for i in rows:
                part = z[starts[i] : starts[i] + lengths[i] - w + 1]
                top = part.argmax(0)
                value = part[top, np.arange(FILTERS)] + b
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                best[i, cols] = np.maximum(value, 0)
                where[i, cols] = np.where(value > 0, top + starts[i], -1)
        return best, where, embedded

    def gradients(self, texts: list[np.ndarray], y: np.ndarray, weights: np.ndarray):
        """Gradients of the mean weighted log loss of a batch: dense parameters, rows of the table in use, theirs."""
        best, where, embedded = self.forward(texts)
        x, n = np.concatenate([*texts, np.zeros((0, PARTS), np.int32)]), len(texts)
        d = weights * (1 / (1 + np.exp(-np.clip(best @ self.out + self.out_bias[0], -30, 30))) - y) / n
        back = np.where(where >= 0, d[:, None] * self.out, 0).astype(np.float32)
        filters, bias, ids, grads = [], [], [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            dk, at = back[:, cols], where[:, cols]
            i, j = np.nonzero(at >= 0)
            dc, windows = dk[i, j], at[i, j][:, None] + np.arange(w)
            g = np.zeros((FILTERS, w, DIM), np.float32)
            np.add.at(g, j, dc[:, None, None] * embedded[windows])
            filters.append(g.transpose(1, 2, 0))
            bias.append(dk.sum(0))
            ids.append(windows.reshape(-1))
            grads.append((dc[:, None, None] * f.transpose(2, 0, 1)[j]).reshape(-1, DIM))
        places, inverse = np.unique(np.concatenate(ids), return_inverse=True)
        at_word = np.zeros((len(places), DIM), np.float32)
        np.add.at(at_word, inverse, np.concatenate(grads))
        used, inverse = np.unique(x[places].reshape(-1), return_inverse=True)
        rows = np.zeros((len(used), DIM), np.float32)
        np.add.at(rows, inverse, np.repeat(at_word, PARTS, 0))
        return [*filters, *bias, d @ best, d.sum(keepdims=True)], used, rows

    def train(self, texts: list[bytes], y: np.ndarray, epochs: range, of: int, seed: int) -> np.ndarray:
        """``epochs`` of ``of`` of Adam on the log loss; table rows are updated lazily where they are used, which is returned."""
        dense, touched, weights = self.dense(), np.zeros(BUCKETS, bool), np.ones(len(y))
        for epoch in epochs:
            order = np.random.default_rng((seed, epoch)).permutation(len(texts))
            rate = RATE * (1 - epoch / of)
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                self.step += 1
                g, used, gt = self.gradients([_words(texts[i]) for i in some], y[some], weights[some])
                touched[used] = True
                lift = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
                for p, gp, mp, vp in zip(dense, g, self.m, self.v):
                    gp = gp + 1e-4 * p
                    mp += 0.1 * (gp - mp)
                    vp += 0.001 * (gp * gp - vp)
                    p -= rate * lift * mp / (np.sqrt(vp) + 1e-8)
                self.mt[used] += 0.1 * (gt - self.mt[used])
                self.vt[used] += 0.001 * (gt * gt - self.vt[used])
                self.table[used] -= rate * lift * self.mt[used] / (np.sqrt(self.vt[used]) + 1e-8)
        return touched

    def parts(self) -> dict[int, np.ndarray]:
        """The state in rows: chunks of the table with its moments, and -1, one row of the rest."""
        rest = np.concatenate([*(x.ravel() for x in (*self.dense(), *self.m, *self.v)), [self.step]])
        table = np.concatenate([self.table, self.mt, self.vt], axis=1)
        return {-1: rest[None, :], **{k: table[k * ROWS_CHUNK : (k + 1) * ROWS_CHUNK] for k in range(BUCKETS // ROWS_CHUNK)}}

    def take(self, chunk: int, weight: np.ndarray, total: np.ndarray) -> None:
        """The mean of a chunk's rows; rows that no piece used stay."""
        rows = np.flatnonzero(weight)
        mean = (total[rows] / weight[rows, None]).astype(np.float32)
        if chunk >= 0:
            self.table[rows + chunk * ROWS_CHUNK], self.mt[rows + chunk * ROWS_CHUNK], self.vt[rows + chunk * ROWS_CHUNK] = np.split(mean, 3, axis=1)
            return
        at = 0
        for x in (*self.dense(), *self.m, *self.v):
            x[...] = mean[0, at : at + x.size].reshape(x.shape)
            at += x.size
        self.step = round(float(mean[0, at]))

    def compact(self) -> "Network":
        """For scoring: each bucket's responses to all filter offsets, so that a word is one table row."""
        fast = Network.__new__(Network)
        stacked = np.concatenate([f[d] for f in self.filters for d in range(f.shape[0])], axis=1)
        fast.responses = (self.table @ stacked).astype(np.float32)
        fast.bias, fast.out, fast.out_bias, fast.prior = self.bias, self.out, self.out_bias, self.prior
        return fast


def score(fast: Network, x: np.ndarray) -> float:
    """The same probability from the compact form, in blocks of words."""
    if fast.prior is not None:
        return fast.prior
    best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    for start in range(0, len(x), BLOCK_WORDS):
        part = x[start : start + BLOCK_WORDS + max(WIDTHS) - 1]
        r = np.take(fast.responses, part[:, 0], axis=0)
        for d in range(1, PARTS):
            r += np.take(fast.responses, part[:, d], axis=0)
        column = 0
        for k, w in enumerate(WIDTHS):
            n = len(part) - w + 1
            if n >= 1:
                z = r[:n, column : column + FILTERS]
                for d in range(1, w):
                    z = z + r[d : d + n, column + d * FILTERS : column + (d + 1) * FILTERS]
                best[k * FILTERS : (k + 1) * FILTERS] = np.maximum(best[k * FILTERS : (k + 1) * FILTERS], z.max(0) + fast.bias[k])
            column += w * FILTERS
    return float(1 / (1 + np.exp(-np.clip(best @ fast.out + fast.out_bias[0], -30, 30))))


def is_held_out(doc_id):
    """crc32 of the decimal doc_id modulo 4 is 2; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


_ROWS = "shard int, spot long, id long, toxic int, key long, lang string, aside boolean, data binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
_TRAINING = "shard int, toxic int, lang string, aside boolean, data binary"


def _feature_rows(shared):
    def run(batches):
        table = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                *others, bit, text = batch.slice(at, 512).columns
                where = bit.to_numpy()
                chosen = pa.array(np.flatnonzero(table[where >> 3] >> (7 - (where & 7)) & 1))
                if len(chosen):  # bucket numbers are below 1 << 15
                    data = [zlib.compress(features(t).astype(np.int16).tobytes(), 1) for t in text.take(chosen).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*(x.take(chosen) for x in others), pa.array(data, pa.binary())], _NAMES)

    return run


def _matched(batches):
    """Of rows sorted by id, labels (null data) before texts: each label with the first text of its id."""
    last, marks = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            out = []
            for shard, _, i, toxic, _, lang, aside, data in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                if i != last:
                    last, marks = i, []
                if data is None:
                    marks.append(toxic)
                else:
                    out += [(shard, y, lang, aside, data) for y in marks]
                    marks = []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.binary()))], [x.split()[0] for x in _TRAINING.split(", ")])


def within(sizes: list[tuple], max_bytes: int) -> list[tuple]:
    """The first of (class, order, id, key, bytes, weight) in order whose bytes fit ``max_bytes`` a class, at least one a class."""
    held: dict[int, int] = {}
    out = []
    for row in sorted(sizes):
        if row[0] not in held or held[row[0]] + row[4] <= max_bytes:
            held[row[0]] = held.get(row[0], 0) + row[4]
            out.append(row)
    return out


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every usable label with the features of its document, in a written table, each shard in one file."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    usable = written(usable.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).distinct(), "labels")
    n = usable.count()
    shards = max(1, -(-n // SHARD_ROWS))
    # Texts aren't moved: a bit table, as in the similarity join, tells which may have a label, and labels meet their features.
    table = bit_table(usable.select("id"))
    shared = session(docs).sparkContext.broadcast(table)
    dealt = lambda k: F.xxhash64("id", F.lit(k))
    aside = F.pmod(dealt(2), F.lit(CALIBRATE_EVERY)) == 0 if n > CALIBRATE_EVERY else F.lit(False)
    place = [F.pmod(dealt(0), F.lit(shards)).cast("int").alias("shard"), dealt(1).alias("spot"), "id"]
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    none = lambda kind: F.lit(None).cast(kind)
    at = F.pmod(F.xxhash64("id"), F.lit(8 * len(table))).alias("bit")
    found = texts.select(*place, none("int").alias("toxic"), F.xxhash64("text").alias("key"), "lang", aside.alias("aside"), at, "text").mapInArrow(_feature_rows(shared), _ROWS)
    marks = usable.select(*place, "toxic", none("long").alias("key"), none("string").alias("lang"), aside.alias("aside"), none("binary").alias("data"))
    rows = marks.union(found).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "spot", "id", F.col("data").isNotNull(), "toxic", "key", "lang")
    out = written(rows.mapInArrow(_matched, _TRAINING), "training")
    forget(usable)
    shared.destroy()
    return out


def _words(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int16).reshape(-1, PARTS).astype(np.int32)


def _pieces(batches):
    """(shard, piece, texts, marks) of a stream of shards."""
    shard, piece, texts, marks, held = None, 0, [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            for s, y, data in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                if texts and (s != shard or held >= SHARD_BYTES):
                    yield shard, piece, texts, np.array(marks)
                    piece, texts, marks, held = piece + 1 if s == shard else 0, [], [], 0
                shard, held = s, held + len(data)
                texts.append(data)
                marks.append(y)
    if texts:
        yield shard, piece, texts, np.array(marks)


def _trainer(shared):
    def run(batches):
        state, epochs, of = shared.value
        for shard, piece, texts, y in _pieces(batches):
            net = copy.deepcopy(state)
            touched = net.train(texts, y, epochs, of, seed=7 + shard)
            for chunk, rows in net.parts().items():
                weight = len(y) * (np.ones(1) if chunk < 0 else touched[chunk * ROWS_CHUNK : (chunk + 1) * ROWS_CHUNK])
                if weight.any():
                    data = np.column_stack([weight, weight[:, None] * rows]).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([shard], pa.int32()), pa.array([piece], pa.int32()), pa.array([zlib.compress(data.tobytes(), 1)])], ["chunk", "shard", "piece", "data"])

    return run


def _sums(batches):
    """Sums of each chunk of a sorted partition, in its order, so that reruns agree."""
    last, total = None, None
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            part = np.frombuffer(zlib.decompress(data), np.float32).astype(np.float64)
            if chunk != last and total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()])], ["chunk", "data"])
                total = None
            last, total = chunk, part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()])], ["chunk", "data"])


def trained(rows: DataFrame, n: int, positives: int) -> Network:
    """The network of all ``rows`` (shard, toxic, data): ``n``, of which ``positives`` toxic."""
    spark, network = session(rows), Network()
    if not 0 < positives < n:
        network.prior = (positives + 0.5) / (n + 1) if n else 0.0
        return network
    network.out_bias[0] = np.log(positives / (n - positives))
    epochs = max(EPOCHS, -(-MIN_STEPS * BATCH // n))
    alone = rows.select("shard").distinct().count() == 1
    step = epochs if alone else ROUND
    for start in range(0, epochs, step):
        shared = spark.sparkContext.broadcast((network, range(start, min(start + step, epochs)), epochs))
        parts = rows.mapInArrow(_trainer(shared), "chunk int, shard int, piece int, data binary")
        parts = parts.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "shard", "piece")
        for r in parts.mapInArrow(_sums, "chunk int, data binary").collect():  # one state
            found = np.frombuffer(r.data, np.float64).reshape(1 if r.chunk < 0 else ROWS_CHUNK, -1)
            network.take(r.chunk, found[:, 0], found[:, 1:])
        shared.destroy()
    return network


def _scored_aside(shared):
    def run(batches):
        for batch in batches:
            lang, toxic, data = batch.columns
            bins = [min(BINS - 1, int(score(shared.value, _words(x)) * BINS)) for x in data.to_pylist()]
            yield pa.RecordBatch.from_arrays([lang, toxic, pa.array(bins, pa.int32())], ["lang", "toxic", "bin"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Network, dict]:
    """The trained network in compact form and the thresholds by language, from every usable label."""
    rows = training_rows(docs, labels)
    counts = {(r.aside, r.toxic): r.n for r in rows.groupBy("aside", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    positives, negatives = counts.get((False, 1), 0), counts.get((False, 0), 0)
    fast = trained(rows.where("not aside").select("shard", "toxic", "data"), positives + negatives, positives).compact()
    shared = session(docs).sparkContext.broadcast(fast)
    scored = rows.where("aside").select("lang", "toxic", "data").mapInArrow(_scored_aside(shared), "lang string, toxic int, bin int")
    found = scored.groupBy("lang", "toxic", "bin").agg(F.count(F.lit(1)).alias("n")).collect()  # by language at most 2 * BINS
    shared.destroy()
    langs = [r.lang for r in rows.select("lang").distinct().collect()]
    forget(rows)
    pick = lambda own: (np.array([r.bin / BINS for r in own]), np.array([r.toxic for r in own]), np.array([r.n for r in own]))
    overall = calibrate(*pick(found))
    return fast, {lang: calibrate(*pick([r for r in found if r.lang == lang]), overall) for lang in langs}


def calibrate(scores, y, weights, towards: float | None = None) -> float:
    """The score with the best F1, halfway to the next below it.

    It is drawn towards ``towards`` as if that rested on POOL positives; without positives it is ``towards`` or THRESHOLD.
    """
    positives = (weights * y).sum()
    if not positives:
        return THRESHOLD if towards is None else towards
    order = np.argsort(-scores, kind="stable")
    sorted_, hit, all_ = scores[order], np.cumsum((weights * y)[order]), np.cumsum(weights[order])
    f1 = np.where(np.append(sorted_[1:] < sorted_[:-1], True), 2 * hit / (all_ + hit[-1]), 0)
    k = int(f1.argmax())
    own = float((sorted_[k] + sorted_[k + 1]) / 2 if k + 1 < len(sorted_) else sorted_[k])
    return own if towards is None else (positives * own + POOL * towards) / (positives + POOL)


def _scorer(model):
    def run(batches):
        claim("buckets")
        fast, thresholds = model.value
        for batch in batches:
            doc, lang, held, text = batch.columns
            scores = np.array([score(fast, features(t)) for t in text.to_pylist()])
            limits = np.array([thresholds.get(x, THRESHOLD) for x in lang.to_pylist()])
            yield pa.RecordBatch.from_arrays([doc, held, pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(limits, pa.float64()), pa.array((scores >= limits).astype(np.int32))], ["doc_id", "held_out", "score", "predicted", "lang_threshold", "lang_predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents: doc_id, held_out, score, predicted, lang_threshold, lang_predicted."""
    spark = session(docs)
    model = spark.sparkContext.broadcast(fit(docs, labels))  # fixed size: BUCKETS rows of responses
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int, lang_threshold double, lang_predicted int")
