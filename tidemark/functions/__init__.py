"""Column functions that statements and users share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(stream: Column, ip: Column, agent: Column, token: Column) -> Column:
    """Key of a play session: 16 hexadecimal digits over stream, address, agent and token."""
    clean = [F.coalesce(c, F.lit("")) for c in (stream, F.lower(F.trim(ip)), F.trim(agent), F.trim(token))]
    return F.substring(F.sha2(F.concat_ws("\0", *clean), 256), 1, 16)


def backoff(attempt: Column, base: float = 2.0, cap: float = 30.0) -> Column:
    """Seconds to wait before an attempt (from 1): doubled each time up to the cap."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(30))))


def event_passes(kind: Column, stream: Column, types: Column, only: Column, without: Column) -> Column:
    """Whether a hook takes an event: its type is listed or none is, and the stream passes; ``only`` wins."""
    listed = (F.size(types) == 0) | F.array_contains(types, kind)
    passes = F.when(F.size(only) > 0, F.array_contains(only, stream)).otherwise(~F.array_contains(without, stream))
    return listed & passes
