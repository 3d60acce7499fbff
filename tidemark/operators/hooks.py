"""Events (id, type, stream_code, ms, payload) to hooks (hook_id, event_types, only_streams, except_streams, enabled).

Hooks are configuration, some hundreds at most; events are not moved to meet them. A null list is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import event_passes

#: Hooks that are sent to all tasks at most; how more are joined is left to the planner.
MOST_HOOKS = 10_000
#: A hook's settings where neither it nor the global configuration has one.
DEFAULTS = {"batch_max_items": 100, "batch_flush_interval_sec": 5, "batch_max_queue_items": 10_000, "timeout_sec": 10, "max_retries": 3}


def dispatched(events: DataFrame, hooks: DataFrame, limit: int = MOST_HOOKS) -> DataFrame:
    """(id, hook_id): each event goes to every enabled hook whose type list and stream filter let it pass; "only" wins."""
    none = F.array().cast("array<string>")
    ready = hooks.where("enabled").select("hook_id", *[F.coalesce(c, none).alias(c) for c in ("event_types", "only_streams", "except_streams")])
    ready = F.broadcast(ready) if ready.limit(limit + 1).count() <= limit else ready
    passes = event_passes(F.col("type"), F.col("stream_code"), F.col("event_types"), F.col("only_streams"), F.col("except_streams"))
    return events.join(ready, passes).select("id", "hook_id")


def matched(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("hook_id").agg(F.count(F.lit(1)).alias("events"))


def queued(pairs: DataFrame, cap: int) -> DataFrame:
    """The newest ``cap`` events of each hook, in two steps: the bound id of a hook is found from counts by slice of ids.

    A full queue drops its oldest, so a hook with any number of events is never ordered as a whole.
    """
    slices = pairs.groupBy("hook_id", F.floor(F.col("id") / cap).alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    after = F.sum("n").over(Window.partitionBy("hook_id").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    edge = slices.withColumn("after", after).where(F.col("after") < cap)
    placed = pairs.withColumn("slice", F.floor(F.col("id") / cap)).join(edge, ["hook_id", "slice"])
    whole = placed.where(F.col("after") + F.col("n") <= cap).select("hook_id", "id")
    back = F.row_number().over(Window.partitionBy("hook_id", "slice").orderBy(F.desc("id")))
    cut = placed.where(F.col("after") + F.col("n") > cap).withColumn("back", back).where(F.col("back") <= F.lit(cap) - F.col("after")).select("hook_id", "id")
    return whole.unionByName(cut)


def batched(pairs: DataFrame, size: int, slice_ids: int = 1 << 16) -> DataFrame:
    """(hook_id, batch, items, first_id): events of a hook in order of id, ``size`` to a batch.

    Places are counted by slice of ids and within slices, so a hook's events are not ordered in one task.
    """
    sliced = pairs.withColumn("slice", F.floor(F.col("id") / slice_ids))
    counts = sliced.groupBy("hook_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("hook_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("hook_id", "slice").orderBy("id")) - 1
    placed = sliced.withColumn("place", place).join(counts.withColumn("before", before).drop("n"), ["hook_id", "slice"])
    batch = F.floor((F.col("before") + F.col("place")) / size).cast("long")
    return placed.groupBy("hook_id", batch.alias("batch")).agg(F.count(F.lit(1)).alias("items"), F.min("id").alias("first_id"))


def with_metadata(payload: Column, metadata: Column) -> Column:
    """A payload (JSON object) as a map with the hook's metadata under ``meta.`` keys, which win over its own."""
    own = F.coalesce(F.from_json(payload, "map<string,string>"), F.create_map().cast("map<string,string>"))
    more = F.transform_keys(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit("meta."), k))
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(more), k)), more)


def json_line(*columns: str, payload: str = "payload") -> Column:
    """One JSON object of the columns, the payload as what it says."""
    return F.to_json(F.struct(*columns, F.try_parse_json(F.col(payload)).alias(payload)))


def setting(own: Column, common: Column, default: int) -> Column:
    """A hook's own value if above 0, else the global one if above 0, else the built-in one."""
    return F.when(own > 0, own).when(common > 0, common).otherwise(F.lit(default)).cast("long")


def settings(hooks: DataFrame, common: dict[str, int]) -> DataFrame:
    """Every setting of DEFAULTS resolved; time-outs and retries have no global value."""
    layered = ("batch_max_items", "batch_flush_interval_sec", "batch_max_queue_items")
    return hooks.withColumns({c: setting(F.col(c), F.lit(common.get(c, 0) if c in layered else 0), d) for c, d in DEFAULTS.items()})
