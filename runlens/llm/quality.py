"""Operator 7 [native]: quality rules with a hashed n-gram log-likelihood ratio.

Only DataFrame functions. Tokens (words and runs of punctuation, lower case) and their
neighbouring pairs are hashed into ``BUCKETS`` features. Two multinomials with add-one
smoothing are counted: the raw corpus over every document, and the trusted target over
documents whose label says quality 1 (at most ``MAX_TRUSTED`` of them, by hash of
doc_id: the only sample, a bounded classifier fit). A document's score is the mean over
its features of log p(target) - log p(raw); it is kept if the base rules pass and the
score is at least ``THRESHOLD``. The model is ``BUCKETS`` doubles, whatever the input.

Base figures: words are runs without ASCII white space. n_repeat_words counts words
inside 3-word windows that occur twice or more: windows are hashed, packed with their
place into a long, sorted and compared with their neighbours; the words of those whose
hashes meet are compared themselves, so the count is exact; then the places are merged.

Defined cases: null or empty text has no words and fails the base rules (score 0); no
trusted labels give an even ratio, so only the base rules decide; null labels are
ignored; repeated rows count repeatedly and are judged alike; an empty table gives no
rows; other columns pass by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, let

BUCKETS = 1 << 14
MAX_TRUSTED = 20_000
THRESHOLD = -0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
SYMBOLS = r"[#*$%&|<>]"


def _empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def bucket(h: Column) -> Column:
    """Bucket of a hash; BUCKETS is a power of two."""
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def features(text: Column) -> Column:
    """Bucket numbers of a text's tokens and of its neighbouring token pairs."""
    tokens = F.regexp_extract_all(F.lower(_empty_if_null(text)), F.lit(TOKEN_PATTERN), F.lit(0))

    def both(h: Column) -> Column:
        n = F.size(h)
        pairs = F.zip_with(F.slice(h, 1, F.greatest(n - 1, F.lit(0))), F.slice(h, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: bucket(F.xxhash64(a, b)))
        return F.concat(F.transform(h, bucket), pairs)

    return let(F.transform(tokens, lambda x: F.xxhash64(x)), both)


def fit(docs: DataFrame, labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> list[float]:
    """log p(target) - log p(raw) of each bucket, from one pass over all documents."""
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_trusted")).distinct()
    trusted = trusted.orderBy(F.xxhash64("_trusted"), "_trusted").limit(max_trusted)
    flagged = docs.select("doc_id", "text").join(F.broadcast(trusted), F.col("doc_id") == F.col("_trusted"), "left")  # at most max_trusted ids
    counts = flagged.select(F.col("_trusted").isNotNull().cast("long").alias("t"), F.explode(features(F.col("text"))).alias("bucket"))
    got = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).collect()  # at most BUCKETS rows
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in got:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not sum(target):
        return [0.0] * BUCKETS
    all_raw, all_target = sum(raw) + BUCKETS, sum(target) + BUCKETS
    return [math.log((t + 1) / all_target) - math.log((r + 1) / all_raw) for r, t in zip(raw, target)]


def ratio(text: Column, model: list[float]) -> Column:
    """Mean of the model over the text's features; 0 without any."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")  # folded to one literal
    return let(features(text), lambda f: F.when(F.size(f) > 0, F.aggregate(f, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size(f)).otherwise(F.lit(0.0)))


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by)


def _neighbours(sorted_: Column, key) -> Column:
    """The elements of a sorted array whose ``key`` is that of a neighbour."""
    same = lambda x, other: F.coalesce(key(x) == key(other), F.lit(False))
    return F.filter(sorted_, lambda x, k: same(x, F.get(sorted_, k + 1)) | same(x, F.get(sorted_, F.when(k > 0, k - 1))))


def _repeat_words(found: Column, hash_of=lambda x: F.xxhash64(x)) -> Column:
    """Words covered by 3-word windows found at least twice in the words ``found``.

    Hashes only choose the windows whose words are compared; ``hash_of`` can be any function of a word.
    """
    zero = F.lit(0).cast("long")

    def candidates(h: Column) -> Column:
        """Places of windows whose hash, less the bits that hold the place, is that of another."""
        bits = F.ceil(F.log2(F.size(h) + F.lit(1.0))).cast("int")
        packed = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: _shift("shiftleft", F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)), bits).bitwiseOR(i.cast("long")))
        mask = _shift("shiftleft", F.lit(1).cast("long"), bits) - 1
        return let(F.sort_array(packed), lambda p: F.transform(_neighbours(p, lambda x: _shift("shiftrightunsigned", x, bits)), lambda x: x.bitwiseAND(mask)))

    def window(i: Column) -> Column:
        at = i.cast("int")
        return F.concat_ws(" ", F.get(found, at), F.get(found, at + 1), F.get(found, at + 2))  # no word holds a space

    def exact(at: Column) -> Column:
        pairs = F.transform(at, lambda i: F.struct(window(i).alias("w"), i.alias("i")))
        return let(F.sort_array(pairs), lambda p: F.sort_array(F.transform(_neighbours(p, lambda x: x["w"]), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).cast("long").alias("last"), zero.alias("n"))
        return F.aggregate(exact(at), start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3).cast("long"), i - s["last"])).alias("n")), lambda s: s["n"])

    some = lambda h: let(candidates(h), lambda at: F.when(F.size(at) == 0, zero).otherwise(covered(at)))
    return let(F.transform(found, hash_of), lambda h: F.when(F.size(h) < 4, zero).otherwise(some(h)))


def figures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = _empty_if_null(text)
    found = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    full_lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_PATTERN)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(
        found,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            full_lines.cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one more column ``_quality``: the base figures, base_failed, llr and kept."""
    model = fit(docs, labels)
    rows = docs.withColumn("_figures", figures(F.col("text"))).withColumn("_llr", ratio(F.col("text"), model))
    n, repeated = F.col("_figures.n_words"), F.col("_figures.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
    verdict = F.struct("_figures.*", failed.alias("base_failed"), F.col("_llr").alias("llr"), (~failed & (F.col("_llr") >= threshold)).alias("kept"))
    return rows.select(*docs.columns, verdict.alias("_quality"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept."""
    return judged(docs.select("doc_id", "text"), labels).select("doc_id", "_quality.*")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the base rules or the ratio reject."""
    return judged(docs, labels).where("_quality.kept").select(*docs.columns)
