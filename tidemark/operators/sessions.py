"""Play sessions of hits (user_id, event_id, ms, bytes, proto, stream_code, ip).

Hits of a user are ordered by (ms, event_id); a null ms comes first. A user is one window; hot users are what
AQE's skew handling can't split, as a session is a chain. Cut users by time first if one has too many hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Protocols and states that a session list may be asked for, and its longest length.
PROTOCOLS, STATES, LONGEST_LIST = ("hls", "dash", "rtmp", "srt", "rtsp"), ("active", "closed"), 1000


def numbered(hits: DataFrame, idle_ms: int) -> DataFrame:
    """Add ``session``: a silence longer than the idle time closes one; one of exactly that length does not."""
    order = Window.partitionBy("user_id").orderBy("ms", "event_id")
    fresh = F.coalesce((F.col("ms") - F.lag("ms").over(order) > idle_ms).cast("long"), F.lit(0))
    return hits.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(order)).drop("_fresh")


def rolled_up(hits: DataFrame, idle_ms: int, now_ms: int) -> DataFrame:
    """One row a session: counts, first and last times, what its first hit says, whole seconds, whether it is closed."""
    first = F.struct("ms", "event_id")
    rows = numbered(hits, idle_ms).groupBy("user_id", "session").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("bytes").alias("bytes"), F.min("ms").alias("opened_ms"), F.max("ms").alias("updated_ms"),
        F.min(F.when(F.col("bytes") > 0, F.col("ms"))).alias("started_ms"), *[F.min_by(c, first).alias(c) for c in ("proto", "stream_code", "ip")],
    )
    return rows.withColumns({
        "duration_sec": F.floor(F.greatest(F.col("updated_ms") - F.col("opened_ms"), F.lit(0)) / 1000).cast("long"), "closed": F.col("updated_ms") < now_ms - idle_ms,
    })


def stats(sessions: DataFrame, kicked: DataFrame | None = None) -> DataFrame:
    """One row: opened, closed, idle_closed, kicked and active; ``kicked`` (user_id, session) were ended by hand."""
    if kicked is not None:
        sessions = sessions.join(kicked.select("user_id", "session").distinct().withColumn("_kicked", F.lit(True)), ["user_id", "session"], "left")
    else:
        sessions = sessions.withColumn("_kicked", F.lit(None).cast("boolean"))
    kick, idle = F.col("_kicked").isNotNull(), F.col("_kicked").isNull() & F.col("closed")
    return sessions.agg(F.count(F.lit(1)).alias("opened"), F.count_if(kick | idle).alias("closed"), F.count_if(idle).alias("idle_closed"), F.count_if(kick).alias("kicked"), F.count_if(~kick & ~idle).alias("active"))


def by_reason(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("stream_code", "proto", F.when(F.col("closed"), "idle").otherwise("open").alias("reason")).agg(F.count(F.lit(1)).alias("sessions"))


def chosen(sessions: DataFrame, stream_code: str | None = None, proto: str | None = None, status: str | None = None) -> DataFrame:
    """Sessions that pass all filters that are given."""
    for column, value in (("stream_code", stream_code), ("proto", proto)):
        if value:
            sessions = sessions.where(F.col(column) == value)
    return sessions.where(F.col("closed") == (status == "closed")) if status else sessions


def newest_first(sessions: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` sessions by opening time, user and number; 0 gives all."""
    ordered = sessions.orderBy("opened_ms", "user_id", "session")
    return ordered.limit(limit) if limit else ordered


def request_verdict(proto: Column, status: Column, limit: Column) -> dict[str, Column]:
    """verdict (ok or what is wrong) and the limit that holds, of a request for a list; empty means not asked."""
    asked = F.coalesce(limit, F.lit(""))
    number = F.expr("try_cast(null as bigint)") if limit is None else F.when(asked.rlike("^[+-]?[0-9]+$"), asked.try_cast("bigint"))
    verdict = (
        F.when(~F.coalesce(proto, F.lit("")).isin("", *PROTOCOLS), "invalid proto").when(~F.coalesce(status, F.lit("")).isin("", *STATES), "invalid status")
        .when((asked != "") & (number.isNull() | (number < 0)), "invalid limit").otherwise("ok")
    )
    return {"verdict": verdict, "most": F.when(verdict == "ok", F.least(F.coalesce(number, F.lit(0)), F.lit(LONGEST_LIST)))}
