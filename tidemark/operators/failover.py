"""Failover between the inputs of a stream, as a state machine over arrivals, commands and timers.

An input is healthy while packets come; a silence longer than the timeout degrades it.  When the active
input is degraded the healthy one of least priority takes over, a healthy override before all, and after a
switch the next waits for the cooldown unless nothing is left to play.  Between two rows of a stream the
machine stops at the moments when a timeout or a cooldown ends, so that a switch in a silence has its own
time; with every input silent the stream is exhausted (-1) until a packet comes.  A command sets the
override if its input is healthy, switches at once, and holds until that input is degraded; a command
without an input takes the override back.  An error that is reported of an input degrades it at once, and
an input that is removed is forgotten until it sends again.  Nothing probes a degraded input: its next packet restores it.

Defined cases: rows without a time or a stream, and packets without an input, are left out; equal times are
ordered packets first, then by event_id; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUT_MS, COOLDOWN_MS = 3_600_000, 1_200_000
NEVER = -(1 << 60)
#: Order of rows of one time.
RANKS = ("packet", "error", "remove", "command")


def best_input(last_seen: dict[int, int], now: int, override: int | None = None, timeout_ms: int = TIMEOUT_MS) -> int | None:
    """The input to play: a healthy override, else the healthy one of least priority, else none."""
    healthy = [p for p, seen in last_seen.items() if now - seen <= timeout_ms]
    if override in healthy:
        return override
    return min(healthy, default=None)


class Machine:
    """The state of one stream; what it does gives (ms, from, to, reason) of each switch, -1 for no input."""

    def __init__(self, timeout_ms: int, cooldown_ms: int):
        self.timeout, self.cooldown = timeout_ms, cooldown_ms
        self.seen: dict[int, int] = {}
        self.active, self.override, self.switched, self.started = -1, None, NEVER, False

    def _switch(self, ms: int, to: int, reason: str) -> tuple:
        out = (ms, self.active, to, reason)
        self.active, self.started = to, True
        if to >= 0:
            self.switched = ms
        return out

    def state(self) -> str:
        return json.dumps([list(self.seen.items()), self.active, self.override, self.switched, self.started])

    def restored(self, state: str) -> Machine:
        seen, self.active, self.override, self.switched, self.started = json.loads(state)
        self.seen = dict(map(tuple, seen))
        return self

    def _decide(self, ms: int, why: str = "timeout") -> Iterator[tuple]:
        best = best_input(self.seen, ms, self.override, self.timeout)
        if best != self.override:
            self.override = None
        lost = self.active < 0 or ms - self.seen.get(self.active, NEVER) > self.timeout
        if best is None:
            if self.active >= 0:
                yield self._switch(ms, -1, "exhausted")
        elif best != self.active and (lost or ms - self.switched >= self.cooldown):
            yield self._switch(ms, best, ("recovery" if self.started else "initial") if self.active < 0 else why if lost else "failback")

    def due(self) -> int | None:
        """When the next timer ends at which anything changes; None while nothing plays."""
        if self.active < 0:
            return None
        due, ready = self.seen[self.active] + self.timeout + 1, self.switched + self.cooldown
        return ready if ready < due and best_input(self.seen, ready, self.override, self.timeout) not in (None, self.active) else due

    def until(self, ms: int) -> Iterator[tuple]:
        """Switches of timers that end before ``ms``."""
        while (due := self.due()) is not None and due < ms:
            yield from self._decide(due)

    def row(self, kind: str, ms: int, priority: int | None) -> Iterator[tuple]:
        """What a row of this kind does: packet, command, error or remove."""
        return {"packet": self.packet, "command": self.command, "error": self.error, "remove": self.remove}[kind](ms, priority)

    def error(self, ms: int, priority: int) -> Iterator[tuple]:
        if priority in self.seen:
            self.seen[priority] = NEVER
            yield from self._decide(ms, "error")

    def remove(self, ms: int, priority: int) -> Iterator[tuple]:
        if self.seen.pop(priority, None) is not None:
            yield from self._decide(ms, "input_removed")

    def packet(self, ms: int, priority: int) -> Iterator[tuple]:
        self.seen[priority] = ms
        yield from self._decide(ms)

    def command(self, ms: int, priority: int | None) -> Iterator[tuple]:
        yield from self._decide(ms)
        if priority is None:
            self.override = None
            yield from self._decide(ms)
        elif priority in self.seen and ms - self.seen[priority] <= self.timeout:
            self.override = priority
            if priority != self.active:
                yield self._switch(ms, priority, "manual")


def timeline(packets: DataFrame, overrides: DataFrame | None = None, timeout_ms: int = TIMEOUT_MS, cooldown_ms: int = COOLDOWN_MS, until_ms: int = 0) -> DataFrame:
    """Every packet, command and switch of each stream in order (``step``), with the active input after it.

    ``kind`` is that of the row, or switch; only switches have from_input and reason.  ``overrides`` has the
    columns of packets, with a null input_priority to take an override back, and may have a ``kind``: command (the
    default), error or remove.  Timers run up to ``until_ms``, or to the stream's last row if that is later.
    """
    names = ["stream_code", "event_id", "ms", "input_priority"]
    rows = packets.select(*names, F.lit("packet").alias("kind"))
    if overrides is not None:
        kind = F.col("kind") if "kind" in overrides.columns else F.lit("command")
        rows = rows.unionByName(overrides.select(*names, kind.alias("kind")))
    rows = rows.where("ms IS NOT NULL AND stream_code IS NOT NULL AND (kind = 'command' OR input_priority IS NOT NULL)")
    schema = pa.schema([("stream_code", pa.string()), ("step", pa.int64()), ("kind", pa.string()), ("event_id", pa.int64()), ("ms", pa.int64()), ("input_priority", pa.int64()), ("from_input", pa.int64()), ("active", pa.int64()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, machine, step, out = None, None, 0, []

        def add(*row) -> None:
            nonlocal step
            step += 1
            out.append((code, step, *row))

        def switches(found: Iterator[tuple]) -> None:
            for ms, before, to, reason in found:
                add("switch", None, ms, None, before, to, reason)

        def packed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for stream, event_id, ms, priority, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if machine is None or stream != code:
                    if machine is not None:
                        switches(machine.until(until_ms + 1))
                    code, machine, step = stream, Machine(timeout_ms, cooldown_ms), 0
                switches(machine.until(ms))
                switches(machine.row(kind, ms, priority))
                add(kind, event_id, ms, priority, None, machine.active, None)
            if out:
                yield packed()
        if machine is not None:
            switches(machine.until(until_ms + 1))
        if out:
            yield packed()

    types = "stream_code string, step long, kind string, event_id long, ms long, input_priority long, from_input long, active long, reason string"
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("kind")).alias("rank")
    dealt = rows.select("*", rank).repartition("stream_code").sortWithinPartitions("stream_code", "ms", "rank", "event_id").drop("rank")
    return dealt.mapInArrow(run, types)


def active_inputs(packets: DataFrame, timeout_ms: int = TIMEOUT_MS, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """The active input after each packet."""
    return timeline(packets, None, timeout_ms, cooldown_ms).where("kind = 'packet'").select("stream_code", "event_id", "ms", "input_priority", "active")


def switch_history(packets: DataFrame, keep: int = 20, overrides: DataFrame | None = None, **settings: int) -> DataFrame:
    """Switches, newest first, at most ``keep`` of each stream; from or to input -1 where there is none."""
    from pyspark.sql import Window

    switches = timeline(packets, overrides, **settings).where("kind = 'switch'")
    back = F.row_number().over(Window.partitionBy("stream_code").orderBy(F.desc("step")))
    return switches.withColumn("place", back).where(F.col("place") <= keep).select("stream_code", "ms", "from_input", F.col("active").alias("to_input"), "place", "reason")
