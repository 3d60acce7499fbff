"""Cuts that depend on the last cut, on a stream: the steps of ``tidemark.operators.segmenters`` with open cuts in the checkpoint.

Rows of a micro-batch are taken in order of time, micro-batches in the order in which they come, so a segment goes on
over any number of them and a long stream is never read again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType

from ..operators.segmenters import Scan


def scan_stream(frame: DataFrame, scan: Scan) -> DataFrame:
    """The streaming rows of ``frame`` with the values of ``scan``, in append mode."""
    rows = scan.rows(frame)
    names, clock, (output, _) = rows.columns, rows.columns.index(scan.time), scan.output.split()
    whole = [isinstance(f.dataType, IntegralType) for f in rows.schema]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else scan.start()
        batch = pd.concat(list(frames)).sort_values([scan.time, "event_id"], kind="stable", na_position="first")
        held = [tuple(None if pd.isna(v) else int(v) if w else v for v, w in zip(row, whole)) for row in batch.itertuples(index=False)]
        found = [(*row, None if row[clock] is None else scan.step(own, row)) for row in held]
        state.update((json.dumps(own),))
        yield pd.DataFrame(found, columns=[*names, output])

    found = rows.groupBy(scan.key).applyInPandasWithState(run, scan.schema(rows), "state string", "append", GroupStateTimeout.NoTimeout)
    return found.drop(*scan.unused)
