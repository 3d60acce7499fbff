"""Packets, runs, samples and counters: gaps, streaks, edges, rates and reports.

Rows are ordered by (ms, event_id); a null ms comes first. Windows are by stream (or the key that is named).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: HTTP answers that no retry mends, states of a push as numbers.
FATAL_CODES = (401, 403, 404, 410, 429, 500, 502, 503, 504)
PUSH_STATES = {"failed": 0, "reconnecting": 1, "starting": 2, "active": 3}

#: Rows of a block. A pair of blocks makes at most the square of it, which a task holds at once.
BLOCK = 200


def by_time(key: str = "stream_code") -> Window:
    return Window.partitionBy(key).orderBy("ms", "event_id")


def gaps(packets: DataFrame, silence_ms: int) -> DataFrame:
    """(stream_code, from_ms, to_ms, gap_ms): from the timer's end, ``silence_ms`` after the last packet, to the next packet."""
    rows = packets.withColumn("_before", F.lag("ms").over(by_time())).where(F.col("ms") - F.col("_before") > silence_ms)
    start = F.col("_before") + silence_ms
    return rows.select("stream_code", start.alias("from_ms"), F.col("ms").alias("to_ms"), (F.col("ms") - start).alias("gap_ms"))


def reconnects(packets: DataFrame, silence_ms: int) -> DataFrame:
    """(stream_code, event_id) of the first packet of each connection; a longer silence is taken for a new one."""
    before = F.lag("ms").over(by_time())
    return packets.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("ms") - F.col("_before") > silence_ms)).select("stream_code", "event_id")


def verdict(text: Column) -> Column:
    """fatal if retrying can't help (certificates, TLS, unknown hosts, some HTTP answers), else retry."""
    code = F.regexp_extract(text, r"(?i)\bhttp (\d{3})\b", 1)
    hopeless = text.contains("x509:") | text.contains("tls:") | text.contains("no such host") | code.isin(*map(str, FATAL_CODES))
    return F.when(F.coalesce(hopeless, F.lit(False)), "fatal").otherwise("retry")


def newest(rows: DataFrame, count: int) -> DataFrame:
    """Add ``place``: the newest ``count`` rows of each stream, newest first."""
    place = F.row_number().over(Window.partitionBy("stream_code").orderBy(F.desc("ms"), F.desc("event_id"))).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= count)


def tails(runs: DataFrame, count: int) -> DataFrame:
    """(stream_code, tail): the last ``count`` messages in order, parted by bars."""
    held = F.array_sort(F.collect_list(F.struct("ms", "event_id", "message")))
    return newest(runs, count).groupBy("stream_code").agg(F.array_join(F.transform(held, lambda r: r["message"]), " | ").alias("tail"))


def shown_errors(runs: DataFrame, most: int = 3) -> DataFrame:
    """Add attempt, same (length of the run of equal messages) and visible: the first ``most`` of a run, and attempts that are powers of two."""
    order = by_time()
    fresh = F.when(F.col("message").eqNullSafe(F.lag("message").over(order)) & (F.row_number().over(order) > 1), 0).otherwise(1)
    rows = runs.withColumn("attempt", F.row_number().over(order).cast("long")).withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order))
    rows = rows.withColumn("same", F.row_number().over(Window.partitionBy("stream_code", "_run").orderBy("ms", "event_id")).cast("long"))
    return rows.withColumn("visible", (F.col("same") <= most) | (F.col("attempt").bitwiseAND(F.col("attempt") - 1) == 0)).drop("_fresh", "_run")


def crash_streaks(runs: DataFrame, fast_sec: int, most: int, keys: tuple[str, ...] = ("stream_code",)) -> DataFrame:
    """Add streak (fast crashes since the last long run) and unhealthy (``most`` or more)."""
    order = Window.partitionBy(*keys).orderBy("ms", "event_id")
    rows = runs.withColumn("_island", F.sum(F.when(F.col("run_sec") >= fast_sec, 1).otherwise(0)).over(order))
    streak = F.sum(F.when(F.col("run_sec") < fast_sec, 1).otherwise(0)).over(Window.partitionBy(*keys, "_island").orderBy("ms", "event_id")).cast("long")
    return rows.withColumn("streak", streak).withColumn("unhealthy", F.col("streak") >= most).drop("_island")


def health_edges(runs: DataFrame, fast_sec: int, most: int) -> DataFrame:
    """(stream_code, event_id, unhealthy) of rows after which the set of a stream's unhealthy profiles has become non-empty or empty."""
    order = Window.partitionBy("stream_code", "profile").orderBy("ms", "event_id")
    rows = crash_streaks(runs, fast_sec, most, ("stream_code", "profile"))
    rows = rows.withColumn("_step", F.col("unhealthy").cast("int") - F.coalesce(F.lag("unhealthy").over(order), F.lit(False)).cast("int")).where("_step != 0")
    rows = rows.withColumn("_size", F.sum("_step").over(by_time()))
    return rows.where("(_step = 1 AND _size = 1) OR (_step = -1 AND _size = 0)").select("stream_code", "event_id", (F.col("_step") == 1).alias("unhealthy"))


def push_states(sessions: DataFrame, limit: int) -> DataFrame:
    """Add attempts and state after each push session (ended: error or discontinuity), and the state's number.

    A discontinuity sets the attempts back and starts a session at once; the limit (0: none) fails the push for good.
    """
    order = by_time()
    broken = F.col("ended") == "discontinuity"
    rows = sessions.withColumn("_island", F.coalesce(F.sum(broken.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("attempts", F.when(broken, 0).otherwise(F.row_number().over(Window.partitionBy("stream_code", "_island").orderBy("ms", "event_id"))).cast("long"))
    failed = F.max((F.lit(limit > 0) & ~broken & (F.col("attempts") >= limit)).cast("int")).over(order) == 1
    state = F.when(failed, "failed").when(broken, "starting").otherwise("reconnecting")
    return rows.withColumn("state", state).withColumn("number", state_number(F.col("state"))).drop("_island")


def state_number(state: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in PUSH_STATES.items() for x in p]), state), F.lit(0)).cast("long")


def sources_apart(packets: DataFrame, jump_ms: int = 1000) -> DataFrame:
    """(stream_code, event_id, source_no): a clock that jumps back by more than ``jump_ms`` begins a new source; video (dts) and audio (pts) have their own clocks."""
    clock = F.when(F.col("codec") == "aac", "audio").otherwise("video")
    time = F.when(F.col("codec") == "aac", F.col("pts")).otherwise(F.col("dts"))
    rows = packets.withColumn("_clock", clock).withColumn("_time", time)
    before = F.lag("_time").over(Window.partitionBy("stream_code", "_clock").orderBy("ms", "event_id"))
    rows = rows.withColumn("_jump", F.coalesce((F.col("_time") - before < -jump_ms).cast("int"), F.lit(0)))
    return rows.select("stream_code", "event_id", F.sum("_jump").over(by_time()).cast("long").alias("source_no"))


def sample_durations(frames: DataFrame, target_sec: int) -> DataFrame:
    """Add ``dur`` in 90 kHz ticks to frames (stream_code, segment, event_id, dts): up to the next one of the segment, else an even share of its length, else of the target."""
    order, whole = Window.partitionBy("stream_code", "segment").orderBy("dts", "event_id"), Window.partitionBy("stream_code", "segment")
    step = F.lead("dts").over(order) - F.col("dts")
    even = F.floor((F.max("dts").over(whole) - F.min("dts").over(whole)) * 90 / F.count(F.lit(1)).over(whole))
    share = F.floor(F.lit(target_sec * 90_000) / F.count(F.lit(1)).over(whole))
    return frames.withColumn("dur", F.when(step > 0, step * 90).when(even > 0, even).otherwise(share).cast("long"))


def from_first_keyframe(packets: DataFrame) -> DataFrame:
    """Packets from the first keyframe of their stream on, that one included."""
    first = packets.where("key_frame").groupBy("stream_code").agg(F.min(F.struct("ms", "event_id")).alias("_first"))
    return packets.join(first, "stream_code").where(F.struct("ms", "event_id") >= F.col("_first")).drop("_first")


def counters(packets: DataFrame) -> DataFrame:
    return packets.groupBy("stream_code").agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"), F.count_if("discontinuity").alias("errors"))


def total_bitrates(packets: DataFrame) -> DataFrame:
    """(stream_code, kbps): rates of codecs over the time seen, rounded half up after they are added."""
    codec = packets.groupBy("stream_code", "codec").agg((F.sum("size") * 8).cast("double").alias("bits"), (F.max("ms") - F.min("ms")).cast("double").alias("span"))
    return codec.groupBy("stream_code").agg(F.floor(F.sum("bits") / F.greatest(F.max("span"), F.lit(1.0)) + 0.5).cast("long").alias("kbps"))


def window_bitrates(packets: DataFrame, window_ms: int) -> DataFrame:
    slot = F.floor(F.col("ms") / window_ms)
    return packets.groupBy("stream_code", "codec", slot.alias("slot")).agg(F.floor(F.sum("size") * 8 * 1000 / window_ms).cast("long").alias("bps"))


def nearest_ranks(samples: DataFrame) -> DataFrame:
    """(metric, n, average, median, p95, highest) of whole values ``v``, at places (n + 1) / 2 and 0.95 n, cut to whole ones and 1 at least.

    Values are counted first, so a metric is a row for each distinct value and no list of all is made.
    """
    counted = samples.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("k"))
    ordered, whole = Window.partitionBy("metric").orderBy("v"), Window.partitionBy("metric")
    placed = counted.withColumn("upto", F.sum("k").over(ordered)).withColumn("n", F.sum("k").over(whole))
    places = {"median": F.floor((F.col("n") + 1) / 2), "p95": F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.95)))}
    return placed.groupBy("metric").agg(
        F.max("n").alias("n"), (F.sum(F.col("v") * F.col("k")).cast("double") / F.max("n")).alias("average"),
        *[F.min(F.when(F.col("upto") >= at, F.col("v"))).alias(c) for c, at in places.items()], F.max("v").alias("highest"),
    )


def counter_deltas(samples: DataFrame) -> DataFrame:
    """(metric, delta, highest, n): last value less the first, by (ms, event_id)."""
    order = F.struct("ms", "event_id")
    return samples.groupBy("metric").agg((F.max_by("v", order) - F.min_by("v", order)).alias("delta"), F.max("v").alias("highest"), F.count(F.lit(1)).alias("n"))


def runtime_counts(snapshots: DataFrame) -> DataFrame:
    """(stream_code, degraded, switches) of snapshots (JSON): inputs whose status is degraded, and switches that are listed."""
    shape = "struct<inputs:array<struct<status:string>>,switches:array<struct<reason:string>>>"
    held = snapshots.withColumn("_s", F.from_json("snapshot", shape))
    degraded = F.size(F.filter(F.coalesce(F.col("_s.inputs"), F.array()), lambda i: i["status"] == "degraded"))
    return held.groupBy("stream_code").agg(F.sum(degraded).cast("long").alias("degraded"), F.sum(F.size(F.coalesce(F.col("_s.switches"), F.array()))).cast("long").alias("switches"))


def phase_report(runs: DataFrame) -> DataFrame:
    """(phase, runs, names): runs (name such as A-25 or B2-x) by the letter that they begin with."""
    phase = F.regexp_extract("name", "^([A-Z])", 1)
    return runs.where(phase != "").groupBy(phase.alias("phase")).agg(F.count(F.lit(1)).alias("runs"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def rates(samples: DataFrame) -> DataFrame:
    """(metric, event_id, mbps) between samples of a counter of bytes (total)."""
    order = by_time("metric")
    rows = samples.withColumns({"_before": F.lag("total").over(order), "_since": F.lag("ms").over(order)}).where("_before IS NOT NULL")
    seconds = F.greatest((F.col("ms") - F.col("_since")).cast("double") / 1000.0, F.lit(0.001))
    return rows.select("metric", "event_id", ((F.col("total") - F.col("_before")) * 8).cast("double").__truediv__(1000000.0).__truediv__(seconds).alias("mbps"))


def process_deltas(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Differences of successive samples of one process."""
    before = F.lag(value).over(by_time(key))
    return samples.withColumn("_before", before).where("_before IS NOT NULL").select(key, "event_id", (F.col(value) - F.col("_before")).alias("delta"))


def mixed(packets: DataFrame, video: str, audio: str, goes_on: bool = False) -> DataFrame:
    """(event_id, part): video of one stream and audio of another, whose end ends both unless ``goes_on``."""
    heard = packets.where((F.col("stream_code") == audio) & (F.col("codec") == "aac"))
    seen = packets.where((F.col("stream_code") == video) & F.col("codec").isin("h264", "h265"))
    if not goes_on:
        end = heard.agg(F.max("ms").alias("_end"))
        seen = seen.join(F.broadcast(end), F.col("ms") <= F.col("_end"))  # one row
    return seen.select("event_id", F.lit("video").alias("part")).unionByName(heard.select("event_id", F.lit("audio").alias("part")))


def blocks(rows: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """(key, name): the rows of a key as arrays of at most BLOCK structs of ``columns``, gathered within input partitions."""
    held = rows.where(F.col(key).isNotNull()).groupBy(key, F.spark_partition_id().alias("_part")).agg(F.collect_list(F.struct(*columns)).alias("_all"))
    begins = F.sequence(F.lit(1), F.size("_all"), F.lit(BLOCK))
    return held.select(key, F.explode(F.transform(begins, lambda k: F.slice("_all", k, F.lit(BLOCK)))).alias(name))


def audio_fanout(packets: DataFrame, renditions: DataFrame) -> DataFrame:
    """(event_id, stream_code, slug): the audio of a source (renditions.audio_code) to every rendition of the streams that mix it.

    Blocks of packets meet blocks of renditions, and pairs of blocks are dealt over tasks in turn: few sources and a small
    input make many rows, so neither keys nor bytes say how to deal them. A stream meets its renditions row by row.
    """
    audio = packets.where("codec = 'aac'").select("event_id", F.col("stream_code").alias("audio_code"))
    if packets.isStreaming or renditions.isStreaming:
        return audio.join(renditions.select("stream_code", "slug", "audio_code"), "audio_code").select("event_id", "stream_code", "slug")
    pairs = blocks(audio, "audio_code", ["event_id"], "_heard").join(blocks(renditions, "audio_code", ["stream_code", "slug"], "_rungs"), "audio_code")
    dealt = pairs.repartition(max(1, int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    each = dealt.select("_rungs", F.explode("_heard").alias("_packet")).select("_packet", F.explode("_rungs").alias("_rung"))
    return each.select("_packet.event_id", "_rung.stream_code", "_rung.slug")


def overridden(reported: DataFrame, known: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``reported`` with the best known value where there is one."""
    best = known.select(*keys, F.col(value).alias("_known"))
    return reported.join(best, keys, "left").withColumn(value, F.coalesce("_known", value)).drop("_known")
