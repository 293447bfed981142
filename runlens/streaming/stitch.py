"""Incremental stitching of interrupted calls over a stream of raw lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "run_id string, pid string, op string, line long, end_line long, state string"
STATE = "line long, op string"


def _step(key, batches, state):
    """Rows of one (run, pid): at most one call is pending, whatever the length of the run."""
    pending = state.get if state.exists else None
    out = []
    for batch in batches:
        for line, t, op in batch.sort_values("line")[["line", "t", "op"]].itertuples(index=False):
            if t == "C":
                out.append((*key, op, line, line, "complete"))
            elif t == "R":
                same = pending is not None and pending[1] == op
                out.append((*key, op, pending[0] if same else line, line, "stitched" if same else "unmatched resumed" if pending is None else "resumed mismatch"))
                pending = None
            else:
                if pending is not None:
                    out.append((*key, pending[1], pending[0], pending[0], "replaced" if t == "U" else "ended with exit"))
                pending = (line, op) if t == "U" else None
    if pending is None:
        state.remove() if state.exists else None
    else:
        state.update(pending)
    yield pd.DataFrame(out, columns=["run_id", "pid", "op", "line", "end_line", "state"])


def stitched_stream(lines: DataFrame) -> DataFrame:
    """``lines`` (streaming: run_id, line, pid, t, op) to observations as soon as they are complete.

    Lines of a run must arrive in order. A call still pending stays in the state store.
    """
    return lines.groupBy("run_id", "pid").applyInPandasWithState(_step, OUTPUT, STATE, "append", "NoTimeout")
