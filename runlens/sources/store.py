"""Sink of recorded runs: event files, metadata and, last, the finalize marker with checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_FIELDS = ["schema_version", "pid", "kind", "operation", "path", "outcome", "evidence", "argv", "child_pid", "cwd_before", "context_uncertain"]


def write_tables(events: DataFrame, path: str) -> None:
    """The analytics copy: Parquet by run, in event order inside each file."""
    events.repartition("run_id").sortWithinPartitions("run_id", "event_index").write.mode("overwrite").partitionBy("run_id").parquet(path)


def jsonl(events: DataFrame) -> DataFrame:
    """One compact JSON line per event (run_id, event_index, value); null fields are left out."""
    fields = [c for c in EVENT_FIELDS if c in events.columns]
    return events.select("run_id", "event_index", F.to_json(F.struct(*fields)).alias("value"))


def save_run(root: str, run_id: str, metadata: dict, lines: list[str]) -> None:
    """Write one run on a local store: events, metadata, each read back, then the marker."""
    import os

    from .ingest import document, publish

    folder = f"{root}/runs/{run_id}"
    os.makedirs(folder)
    events = publish(f"{folder}/events.jsonl", (x.encode() + b"\n" for x in lines))
    saved = publish(f"{folder}/metadata.json", document(metadata))
    marker = {"schema_version": 1, "run_id": run_id, "event_count": len(lines), "events": events, "metadata": saved}
    publish(f"{folder}/finalized.json", document(marker))
