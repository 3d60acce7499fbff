"""Failover as a stream: the state machine of ``tidemark.operators.failover`` with its state in the checkpoint.

Rows of a micro-batch are taken in order of time, micro-batches in the order in which they come. Timers are
event-time timeouts: a switch in a silence is told once the watermark has passed its time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.failover import COOLDOWN_MS, RANKS, TIMEOUT_MS, Machine

SWITCHES = "stream_code string, ms long, from_input long, to_input long, reason string"


def switch_stream(rows: DataFrame, timeout_ms: int = TIMEOUT_MS, cooldown_ms: int = COOLDOWN_MS, late: str = "1 minute") -> DataFrame:
    """Switches of streaming rows (stream_code, event_id, ms, input_priority, kind) in append mode."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine(timeout_ms, cooldown_ms)
        if state.exists:
            machine.restored(state.get[0])
        found = []
        if state.hasTimedOut:
            found += machine.until(state.getCurrentWatermarkMs() + 1)
        else:
            batch = pd.concat(list(frames))
            order = batch.assign(rank=batch["kind"].map(RANKS.index)).sort_values(["ms", "rank", "event_id"], kind="stable")
            for ms, priority, kind in zip(order["ms"].tolist(), order["input_priority"], order["kind"]):
                found += machine.until(ms)
                found += machine.row(kind, ms, None if pd.isna(priority) else int(priority))
        state.update((machine.state(),))
        if (due := machine.due()) is not None:
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *f) for f in found], columns=["stream_code", "ms", "from_input", "to_input", "reason"])

    sound = rows.where("ms IS NOT NULL AND stream_code IS NOT NULL AND (kind = 'command' OR input_priority IS NOT NULL)")
    timed = sound.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", late)
    return timed.groupBy("stream_code").applyInPandasWithState(step, SWITCHES, "machine string", "append", GroupStateTimeout.EventTimeTimeout)
