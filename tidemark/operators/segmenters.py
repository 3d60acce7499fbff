"""Cuts that depend on the last cut: segments, keyframe segments, session lives, anchored bit rates.

Where a cut begins decides where the next one may fall, so no window of fixed borders gives these.  Rows
are dealt by key and sorted, and a task goes through them once with the state of one key at a time; a key
of any number of rows takes no more memory than its last cut.  ``tidemark.streaming.scans`` runs the same steps
on a stream, with the open cuts in its checkpoint.

Defined cases: a row without a time (ms) has a null result and changes nothing; a null pts_ms, like 0, is no
timestamp; equal times are ordered by event_id; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scan:
    """``step(state, row)`` gives the value of each row in order of ``time`` and event_id, with a fresh state for each key.

    ``columns`` are what rows hold, as expressions; ``output`` is the value's name and type (long or double). States are dicts of plain values,
    so that a stream can keep them in its checkpoint.
    """

    columns: tuple[str, ...]
    key: str
    step: Callable[[dict, tuple], float | None]
    start: Callable[[], dict]
    output: str
    time: str = "ms"
    unused: tuple[str, ...] = ()

    def rows(self, frame: DataFrame) -> DataFrame:
        return frame.selectExpr(*self.columns)

    def schema(self, rows: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {self.output}"

    def over(self, frame: DataFrame) -> DataFrame:
        """The rows of ``frame`` with their values, in one pass over each key."""
        rows, (name, kind), key = self.rows(frame), self.output.split(), self.key
        at, clock = rows.columns.index(key), rows.columns.index(self.time)
        arrow, step, start = {"long": pa.int64(), "double": pa.float64()}[kind], self.step, self.start

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, state = object(), None
            for batch in batches:
                found = []
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if row[at] != current:
                        current, state = row[at], start()
                    found.append(None if row[clock] is None else step(state, row))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=[*batch.schema.names, name])

        dealt = rows.repartition(key).sortWithinPartitions(key, self.time, "event_id")
        return dealt.mapInArrow(run, self.schema(rows)).drop(*self.unused)


def span_scan(target_ms: int) -> Scan:
    """Segment numbers: once the timestamps span the target (the clock, without any), the packet that crosses ends the segment.

    The next segment's span begins at that packet's own timestamp.
    """

    def step(state: dict, row: tuple) -> int:
        _, _, ms, pts = row
        state["opened"] = ms if state["opened"] is None else state["opened"]
        if state["from"] is None and pts:
            state["from"] = pts
        own = state["n"]
        if pts is not None and pts - state["from"] >= target_ms if state["from"] is not None else ms - state["opened"] >= target_ms:
            state.update({"n": own + 1, "opened": ms, "from": pts or None})
        return own

    return Scan(("stream_code", "event_id", "ms", "pts_ms"), "stream_code", step, lambda: {"from": None, "opened": None, "n": 1}, "segment long")


def span_segments(packets: DataFrame, target_ms: int) -> DataFrame:
    return span_scan(target_ms).over(packets)


def keyframe_scan(target_ms: int) -> Scan:
    """A cut at the first keyframe from the target on, at any packet from 1.5 times it, and at a discontinuity."""

    def step(state: dict, row: tuple) -> int:
        _, _, ms, key, broken = row
        age = None if state["from"] is None else ms - state["from"]
        if age is None or broken or (key and age >= target_ms) or 2 * age >= 3 * target_ms:
            state["from"], state["n"] = ms, state["n"] + 1
        return state["n"]

    flags = ("key_frame", "discontinuity")
    return Scan(("stream_code", "event_id", "ms", *flags), "stream_code", step, lambda: {"from": None, "n": 0}, "segment long", unused=flags)


def keyframe_segments(packets: DataFrame, target_ms: int) -> DataFrame:
    return keyframe_scan(target_ms).over(packets)


def session_scan(idle_ms: int, life_ms: int) -> Scan:
    """Session numbers: a session ends by idleness, or when its age passes the longest life."""

    def step(state: dict, row: tuple) -> int:
        ms = row[2]
        if state["last"] is None or ms - state["last"] > idle_ms or ms - state["from"] > life_ms:
            state["from"], state["n"] = ms, state["n"] + 1
        state["last"] = ms
        return state["n"]

    return Scan(("user_id", "event_id", "ms"), "user_id", step, lambda: {"from": None, "last": None, "n": 0}, "session long")


def bounded_sessions(hits: DataFrame, idle_ms: int, life_ms: int) -> DataFrame:
    return session_scan(idle_ms, life_ms).over(hits)


def bitrate_scan(least_ms: int = 3000) -> Scan:
    """Kbps after each packet: bytes gathered for at least ``least_ms``, this packet's too, then half old and half new."""

    def step(state: dict, row: tuple) -> float:
        _, _, ms, size = row
        state["from"] = ms if state["from"] is None else state["from"]
        state["bytes"] += size or 0
        elapsed = ms - state["from"]
        if elapsed >= least_ms and elapsed > 0:
            fresh = state["bytes"] * 8 / elapsed
            state["kbps"] = 0.5 * state["kbps"] + 0.5 * fresh if state["kbps"] else fresh
            state["from"], state["bytes"] = ms, 0
        return float(int(state["kbps"] + 0.5))

    columns = ("stream_code || ' ' || codec AS track", "event_id", "ms", "size")
    return Scan(columns, "track", step, lambda: {"from": None, "bytes": 0, "kbps": 0.0}, "kbps double")


def smoothed_bitrate(packets: DataFrame, least_ms: int = 3000) -> DataFrame:
    return bitrate_scan(least_ms).over(packets)


def dash_scan(target_ms: int, audio_frames: int) -> Scan:
    """Segment numbers; each packet is a tick after which a cut is due.

    It is due when the clock reaches the target, when the video that waits spans it (in the first segment only if it begins
    with a keyframe), or when enough frames wait of a stream that has had audio alone.
    """

    def step(state: dict, row: tuple) -> int:
        _, _, ms, codec, key, pts = row
        own, video = state["n"], codec in ("h264", "h265")
        state["opened"] = ms if state["opened"] is None else state["opened"]
        if video:
            state["seen"] = True
            if pts is not None:
                if state["first"] is None:
                    state["first"], state["key"] = pts, bool(key)
                state["last"] = pts
        else:
            state["frames"] += 1
        waits = state["first"] is not None and state["last"] - state["first"] >= target_ms and (own > 1 or state["key"])
        if ms - state["opened"] >= target_ms or waits or (not state["seen"] and state["frames"] >= audio_frames):
            state.update({"n": own + 1, "opened": None, "first": None, "last": None, "frames": 0})
        return own

    start = lambda: {"n": 1, "opened": None, "first": None, "last": None, "key": False, "frames": 0, "seen": False}
    columns, unused = ("stream_code", "event_id", "ms", "codec", "key_frame", "pts_ms"), ("key_frame", "pts_ms")
    return Scan(columns, "stream_code", step, start, "segment long", unused=unused)


def dash_segments(packets: DataFrame, target_ms: int, audio_frames: int) -> DataFrame:
    return dash_scan(target_ms, audio_frames).over(packets)


class Aligner:
    """188-byte packets of a transport stream that comes in chunks; what may still become a packet is carried over."""

    def __init__(self):
        self._held = b""

    def feed(self, chunk: bytes) -> list[bytes]:
        """Packets that are whole now: they start with 0x47, and where the stream is known to go on, so does the next."""
        data, at, found = self._held + chunk, 0, []
        while len(data) - at >= 188:
            sync = data.find(b"\x47", at)
            if sync < 0:
                at = len(data) - 187
            elif len(data) - sync < 188:
                at = sync
                break
            elif len(data) - sync >= 376 and data[sync + 188] != 0x47:
                at = sync + 1
            else:
                found.append(data[sync : sync + 188])
                at = sync + 188
        self._held = data[at:]
        return found


def aligned_packets(chunks: DataFrame) -> DataFrame:
    """(stream_code, seq, packet) of every whole packet of chunks (stream_code, seq, data) in order; seq is the chunk that made it whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, aligner = object(), None
        for batch in batches:
            out = []
            for code, seq, data in zip(*(c.to_pylist() for c in batch.columns)):
                if code != current:
                    current, aligner = code, Aligner()
                out += [(code, seq, packet) for packet in aligner.feed(data or b"")]
            kinds = (pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["stream_code", "seq", "packet"])

    rows = chunks.select("stream_code", F.col("seq").cast("long").alias("seq"), "data")
    return rows.repartition("stream_code").sortWithinPartitions("stream_code", "seq").mapInArrow(run, "stream_code string, seq long, packet binary")
