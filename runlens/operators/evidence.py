"""Format 6: for each change and side, where its outcomes come from and every event behind them.

Counts are null, not 0, where they don't apply (metadata) or aren't known (a side whose
events are withheld). Samples are the bounded ones of the report; the lists per outcome are
whole, bounded by a run's event budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.vocab import EVIDENCE_LIMIT, METADATA_FIELDS

from . import compare
from .report import SIDES, mapping, visible

c = F.col
REFERENCE = "struct<index:bigint,evidence:struct<file:string,line:bigint,end_line:bigint>>"
OUTCOMES = f"array<struct<outcome:string,event_count:bigint,events:array<{REFERENCE}>>>"


def _side(source: Column, fields: Column, n: Column, samples: Column, outcomes: Column) -> Column:
    """One side; samples and outcomes may be null, which is none."""
    samples = F.coalesce(samples, F.array().cast("array<bigint>"))
    n_samples = F.size(samples).cast("bigint")
    return F.struct(
        source.alias("source"), F.coalesce(fields, F.array().cast("array<string>")).alias("metadata_fields"), n.alias("event_count"), samples.alias("sample_event_indices"),
        n_samples.alias("sample_count"), (n - n_samples).alias("omitted_sample_count"), F.coalesce(outcomes, F.array().cast(OUTCOMES)).alias("outcomes"),
    )


def evidence_mappings(heads: DataFrame, found: DataFrame, events: DataFrame) -> DataFrame:
    """pair_id, position, evidence_mapping of the changes of format-6 pairs.

    ``heads``, ``found`` and ``events`` are those of ``report.changes``.
    """
    good = heads.where("comparable and format = 6")
    seen = visible(good, events)
    lists = mapping(seen).withColumn("events", c("events").cast(f"array<{REFERENCE}>"))
    lists = lists.groupBy(*compare.KEY, "side").agg(F.sum("event_count").alias("n"), F.array_sort(F.collect_list(F.struct("outcome", "event_count", "events"))).alias("outcomes"))
    taken = compare.evidence_samples(seen).groupBy(*compare.KEY, "side").agg(F.array_sort(F.collect_list(F.struct("slot", "event_index"))).alias("taken"))
    both = lists.join(taken, [*compare.KEY, "side"], "left")
    wide = both.groupBy(*compare.KEY).agg(*(F.max(F.when(c("side") == s, F.struct("n", "taken", "outcomes"))).alias(f"{s}_seen") for s in SIDES))
    facts = good.select("pair_id", *(F.struct(*(c(f"{s}.{n}").alias(n) for n in ("storage", "schema_version", "target_provenance"))).alias(f"{s}_run") for s in SIDES))
    rows = found.select("pair_id", "position", *compare.KEY[1:], "change", *SIDES).join(facts, "pair_id").join(wide, compare.KEY, "left")
    fields_of = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in METADATA_FIELDS.items() for x in pair])
    fields, none = fields_of[c("change")], lambda kind: F.lit(None).cast(kind)
    observed = c("kind") != ""

    def of(s: str) -> Column:
        run, got = c(f"{s}_run"), c(f"{s}_seen")
        held = run["storage"] == "unfinalized"
        proof = run["target_provenance"]["target_exit"]
        unknown = _side(F.when(held, "withheld").otherwise("metadata"), F.when(~observed, fields), none("bigint"), none("array<bigint>"), none(OUTCOMES))
        normalized = _side(F.lit("normalized_events"), none("array<string>"), F.coalesce(got["n"], F.lit(0)).cast("bigint"), F.transform(got["taken"], lambda x: x["event_index"]), got["outcomes"])
        target = F.array(F.struct(F.element_at(s, 1).alias("outcome"), F.lit(1).cast("bigint").alias("event_count"), F.array(proof.cast(REFERENCE)).alias("events")))
        exit_ = _side(F.lit("target_provenance"), fields, F.lit(1).cast("bigint"), F.array(proof["index"].cast("bigint")), target)
        proven = (c("change") == "ExitStatus") & (run["storage"] == "verified") & (run["schema_version"] == 4) & proof.isNotNull()
        return F.when(observed & ~held, normalized).when(F.coalesce(proven, F.lit(False)), exit_).otherwise(unknown).alias(s)

    key = F.when(observed, F.struct("kind", "operation", "path"))
    return rows.select("pair_id", "position", F.struct(key.alias("observation"), F.lit(EVIDENCE_LIMIT).alias("sample_limit_per_side"), of("left"), of("right")).alias("evidence_mapping"))


def mapping_lines(m: Column) -> Column:
    """The lines of one mapping in a text report, or null without one."""
    number = lambda x: F.coalesce(x.cast("string"), F.lit("N/A"))
    parts = [F.array(F.concat(F.lit("  Evidence sample limit per side: "), m["sample_limit_per_side"].cast("string")))]
    for s in SIDES:
        x = m[s]
        head = F.concat(F.lit(f"  {s} evidence: source="), x["source"], F.lit(", events="), number(x["event_count"]), F.lit(", sampled="), number(x["sample_count"]), F.lit(", omitted_from_sample="), number(x["omitted_sample_count"]))
        fields = F.when(F.size(x["metadata_fields"]) > 0, F.concat(F.lit("    metadata fields: "), F.array_join(x["metadata_fields"], ", ")))
        sampled = F.when(F.size(x["sample_event_indices"]) > 0, F.concat(F.lit("    sampled event indices (0-based): ["), F.array_join(x["sample_event_indices"], ", "), F.lit("]")))
        each = F.transform(x["outcomes"], lambda o: F.concat(F.lit("    outcome "), o["outcome"], F.lit(": "), o["event_count"].cast("string"), F.lit(" events (all references in --json)")))
        parts += [F.array_compact(F.array(head, fields, sampled)), each]
    return F.concat(*parts)
