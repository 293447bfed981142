"""Operator 4: mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule: a piecewise linear density over training time
0..1. Targets share the total by weight with a cap of ``cap`` times the source's size,
the excess reshared by weight (water filling, found by rounds that move two sums to the
driver). A source is consumed in a fixed hash order, pass after pass; the words taken up
to a document (pass * source size + words before it) are inverted through the integral
of the schedule to give the document its training position, and the assignments are
range-sorted by position.

Words before a document come from a two-level prefix sum: a source of n rows is cut by
hash into about sqrt(n) buckets of as many rows, so a source with a third of all rows is
spread over many tasks, and neither the windows inside buckets nor those over a source's
buckets grow as the source does.

Defined cases: null or empty text has size 0 and takes nothing; the null source is a
source of its own, last in order; repeated rows are separate rows and take separately;
an empty table gives no rows; sources of size 0 have target 0; other columns pass by
(names that start with two underscores are the operator's own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, n_words, partitions, session, written

CAP = 3
#: Parts in which the rows of one source meet its plan row, should that join be a shuffle.
SALTS = 64
WEIGHTS = (1, 2, 3)
#: Knots (time, density) of the schedule of each weight class: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct rows of ``df`` with their rank by ``key`` from 0, nulls last, without a single-task window."""
    spark = df.sparkSession
    order = F.col(key).asc_nulls_last()
    spread = written(df.repartitionByRange(partitions(spark), order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_in_part")), name)
    before, offsets = 0, {}
    for r in sorted(spread.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # one row a partition
        offsets[r._part] = before
        before += r.n
    offset = F.create_map(*[F.lit(x) for p, n in offsets.items() for x in (p, n)]) if offsets else F.create_map(F.lit(0), F.lit(0))
    return spread.withColumn("rank", F.coalesce(offset[F.col("_part")], F.lit(0)) + F.col("_in_part")).drop("_part", "_in_part")


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``sources`` (source, source_size, weight, ...) with ``target``.

    The final level L satisfies sum(min(L * weight, cap * size)) = total size. Each round
    fixes the sources above their cap and raises L for the rest; L only rises, so it ends.
    """
    limit, level = cap * F.col("source_size"), 0.0
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first().s
    while total:
        full = limit <= F.lit(level) * F.col("weight")
        got = sources.agg(F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("fixed"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("free")).first()
        if not got.free:
            break
        new = (total - got.fixed) / float(got.free)
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), limit.cast("double")))


def position(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """Training time at which a source has used ``share`` of its demand: the inverse of the schedule's integral.

    Within a segment the density is linear, so the integral is a quadratic in time.
    """
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
        done, inverse = 0.0, F.lit(1.0)
        pieces = []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            piece = (t1 - t0) * (w0 + w1) / 2 / area
            slope = (w1 - w0) / (t1 - t0)
            need = F.greatest(share - F.lit(done), F.lit(0.0)) * F.lit(area)
            # need = w0*u + slope*u^2/2 in the form that is stable for small slopes
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0)))
            under = F.lit(w0) + root
            pieces.append((done + piece, F.lit(t0) + F.when(under > 0, 2 * need / under).otherwise(F.lit(0.0))))
            done += piece
        for upper, value in reversed(pieces):
            inverse = F.when(share <= F.lit(upper), value).otherwise(inverse)
        out = F.when(kind == k, F.least(inverse, F.lit(1.0))).otherwise(out)
    return out


def source_plan(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, n_docs, weight, kind (weight class), target."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rows = ranked(by_source, "source", "sources")
    kind = (F.col("rank") % len(weights)).cast("int")
    return targets(rows.withColumn("kind", kind).withColumn("weight", F.array(*map(F.lit, weights))[kind]).drop("rank"), cap)


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, cap: int = CAP, whole_documents: bool = False) -> DataFrame:
    """Training assignments, range-sorted by position.

    One row per document and pass: doc_id, tkey (hash of the text), source, size,
    source_size, target, pass, words (taken in this pass), position (null if none are).
    A document that isn't taken has one row with 0 words. With ``whole_documents`` a
    document is taken whole in a pass if its middle word is within the target, so that a
    source ends within half a document of its target instead of within a word.
    """
    spark = session(docs)
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tkey")), "sizes")
    plan = source_plan(sized, weights, cap).withColumn("buckets", F.ceil(F.sqrt("n_docs"))).withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    order = F.xxhash64("doc_id", "tkey")
    salts = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = sized.withColumn("salt", F.pmod(order, F.lit(SALTS)).cast("int"))
    rows = salted.join(salts, same & (F.col("salt") == F.col("_salt"))).drop("_source", "_salt", "salt").withColumn("order", order).withColumn("bucket", F.pmod(F.shiftright("order", 3), F.col("buckets")))
    rows = planned = written(rows, "planned")
    forget(sized)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), before.alias("bucket_start"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "tkey").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, same & (F.col("bucket") == F.col("_bucket"))).withColumn("start", F.col("bucket_start") + F.col("inside"))
    goal = F.round("target").cast("long")
    n_pass = F.when((F.col("size") > 0) & (F.col("start") < goal), F.ceil((goal - F.col("start")) / F.col("source_size"))).otherwise(1)
    taken = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n_pass, F.lit(1)) - 1))
    rows = rows.select("doc_id", "tkey", "source", "size", "source_size", "target", "kind", "start", taken.alias("pass"))
    used = F.col("pass") * F.col("source_size") + F.col("start")
    if whole_documents:
        amount = F.when(2 * used + F.col("size") <= 2 * goal, F.col("size")).otherwise(0)
    else:
        amount = F.least(F.col("size"), F.greatest(goal - used, F.lit(0)))
    rows = rows.withColumn("words", amount.cast("long")).withColumn("position", F.when(F.col("words") > 0, position(used / F.col("target"), F.col("kind"), schedules)))
    rows = rows.select("doc_id", "tkey", "source", "size", "source_size", "target", F.col("pass").cast("int").alias("pass"), "words", "position")
    key = ["position", "source", "doc_id", "pass"]
    assigned = written(rows, "assigned")
    forget(planned)
    return assigned.repartitionByRange(partitions(spark), *key).sortWithinPartitions(*key)


def mix_totals(assignments: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, passes, first_position."""
    key = ["doc_id", "tkey", "size", "source_size", "target"]
    got = assignments.groupBy(*key, "source").agg(F.sum("words").alias("taken"), F.sum(F.when(F.col("words") > 0, 1).otherwise(0)).alias("passes"), F.min("position").alias("first_position"), F.sum(F.when(F.col("pass") == 0, 1).otherwise(0)).alias("copies"))
    # Rows repeated in the table share a key; the group's words are dealt out evenly, the rest to the first.
    n, k = F.col("copies"), F.col("copy")
    dealt = got.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    each = F.floor(F.col("taken") / n) + F.when(k <= F.col("taken") % n, 1).otherwise(0)
    return dealt.select("doc_id", "size", "source_size", "target", each.cast("long").alias("taken"), F.col("passes"), "first_position")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every document repeated as often as the mix takes it whole (not at all: gone).

    Rows repeated with the same doc_id, source and text share their group's passes: each gets the even
    part, and the first rows by ``_dealt`` one more, so the words taken are those of the plan.
    """
    taken = mix(docs, whole_documents=True, **options).groupBy("doc_id", "tkey", "source").agg(F.sum(F.when(F.col("words") > 0, 1).otherwise(0)).alias("__times"), F.sum(F.when(F.col("pass") == 0, 1).otherwise(0)).alias("__rows"))
    names = {"doc_id": "__doc", "source": "__source", "tkey": "__text"}
    taken = taken.where("__times > 0").withColumnsRenamed(names)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & F.col("source").eqNullSafe(F.col("__source")) & (F.xxhash64("text") == F.col("__text"))
    single = docs.join(taken.where("__rows = 1"), same).select(*docs.columns, "__times")
    several = _dealt(docs.join(taken.where("__rows > 1"), same)).select(*docs.columns, "__times")
    again = F.explode(F.sequence(F.lit(1).cast("long"), "__times"))
    return single.union(several).where("__times > 0").withColumn("__again", again).select(*docs.columns)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of repeated groups (``__doc``, ``__source``, ``__text``, ``__times``, ``__rows``) with their own ``__times``.

    A group can be any share of all rows, so its rows are numbered along a range order that
    cuts inside groups, from one count a partition and one least number a group.
    """
    key = ["__doc", "__source", "__text"]
    stable = written(rows.withColumn("__at", F.monotonically_increasing_id()), "repeats")
    order = [*key, "__at"]
    part, inside = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    spread = written(stable.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("__part", part).withColumn("__in", inside), "dealt")
    forget(stable)
    before, offsets = 0, []
    for r in sorted(spread.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()):  # one row a partition
        offsets.append((r[0], before))
        before += r.n
    offsets = rows.sparkSession.createDataFrame(offsets, "__part int, __before long")
    numbered = spread.join(F.broadcast(offsets), "__part").withColumn("__number", F.col("__before") + F.col("__in"))
    first = numbered.groupBy(*key).agg(F.min("__number").alias("__first"), F.lit(True).alias("__found")).withColumnsRenamed({k: k + "2" for k in key})
    match = F.lit(True)
    for k in key:
        match &= F.col(k).eqNullSafe(F.col(k + "2"))
    rank = F.col("__number") - F.col("__first")
    times = F.floor(F.col("__times") / F.col("__rows")) + F.when(rank < F.col("__times") % F.col("__rows"), 1).otherwise(0)
    return numbered.join(first, match).withColumn("__times", times.cast("long"))


__all__ = ["mix", "mix_totals", "mixed_documents", "position", "ranked", "source_plan", "targets"]
