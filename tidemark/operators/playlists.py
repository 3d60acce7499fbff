"""Segments (stream_code, idx, ms, duration_ms, size, discontinuity) to playlists, windows and what is kept.

A live window is at most some dozens of rows a stream. Recordings have a line a segment; their playlists are one
text a stream, as a player asks for one. Nulls of duration and size count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tail(segments: DataFrame, count: int) -> DataFrame:
    """The last ``count`` segments of each stream; all if count is 0."""
    if not count:
        return segments
    back = F.row_number().over(Window.partitionBy("stream_code").orderBy(F.desc("idx")))
    return segments.withColumn("_back", back).where(F.col("_back") <= count).drop("_back")


def beyond(segments: DataFrame, count: int) -> DataFrame:
    """Segments that are trimmed from disk: all but the last ``count`` of each stream."""
    back = F.row_number().over(Window.partitionBy("stream_code").orderBy(F.desc("idx")))
    return segments.withColumn("_back", back).where(F.col("_back") > count).drop("_back")


def index(segments: DataFrame) -> DataFrame:
    return segments.groupBy("stream_code").agg(F.count(F.lit(1)).alias("segments"), F.sum("size").alias("bytes"), F.max("ms").alias("last_ms"))


def target_durations(segments: DataFrame, least_sec: int) -> DataFrame:
    """Whole seconds that no segment passes: live playlists say one more than needed and than the target at least, recordings round up."""
    second = F.col("duration_ms") / 1000
    return segments.groupBy("stream_code").agg(
        F.greatest(F.lit(least_sec + 1).cast("long"), F.max(F.floor(second).cast("long") + 1)).alias("hls_sec"), F.max(F.ceil(F.greatest(F.lit(1.0), second)).cast("long")).alias("dvr_sec")
    )


def _joined(lines: Column, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by), lines.alias("line")))), lambda r: r["line"]), "")


def _seconds(ms: Column, digits: int) -> Column:
    """Milliseconds as seconds with so many digits, by integers alone."""
    return F.concat((F.floor(ms / 1000)).cast("string"), F.lit("."), F.rpad(F.lpad((ms % 1000).cast("string"), 3, "0"), digits, "0"))


def live_playlists(segments: DataFrame, window: int, target_sec: int) -> DataFrame:
    """(stream_code, manifest): the live window; the media sequence counts from 0, names from 1."""
    line = F.concat(
        F.when(F.col("discontinuity"), "#EXT-X-DISCONTINUITY\n").otherwise(""), F.lit("#EXTINF:"), _seconds(F.col("duration_ms"), 6), F.lit(",\nseg_"), F.lpad(F.col("idx").cast("string"), 6, "0"), F.lit(".ts\n")
    )
    target = F.greatest(F.lit(target_sec + 1).cast("long"), F.max(F.floor(F.col("duration_ms") / 1000).cast("long") + 1))
    first = F.greatest(F.max("idx") - F.count(F.lit(1)), F.lit(0).cast("long"))
    text = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:"), target.cast("string"), F.lit("\n#EXT-X-MEDIA-SEQUENCE:"), first.cast("string"), F.lit("\n"), _joined(line, "idx"))
    return tail(segments, window).groupBy("stream_code").agg(text.alias("manifest"))


def master_playlists(renditions: DataFrame) -> DataFrame:
    """(stream_code, manifest) of ladders (slug, width, height, kbps), sorted by slug."""
    from . import media

    size = F.when((F.col("width") > 0) & (F.col("height") > 0), F.concat(F.lit(",RESOLUTION="), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))).otherwise("")
    line = F.concat(
        F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), media.bandwidth(F.col("kbps")).cast("string"), size, F.lit(',CODECS="'), media.codec_string(F.col("width"), F.col("height")), F.lit('"\n'), F.col("slug"), F.lit("/index.m3u8\n")
    )
    return renditions.groupBy("stream_code").agg(F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:3\n\n"), _joined(line, "slug")).alias("manifest"))


def dated(segments: DataFrame) -> DataFrame:
    """Segments that get a date: the first of a stream and each after a discontinuity."""
    first = F.col("idx") == F.min("idx").over(Window.partitionBy("stream_code"))
    return segments.where(F.col("discontinuity")).select("stream_code", "idx").unionByName(segments.withColumn("_first", first).where("_first").select("stream_code", "idx")).distinct()


def recording_playlists(segments: DataFrame, ended: bool = False) -> DataFrame:
    """(stream_code, entries, playlist) of recordings: dated, and closed if they have ended."""
    first = F.col("idx") == F.min("idx").over(Window.partitionBy("stream_code"))
    date = F.concat(F.lit("#EXT-X-PROGRAM-DATE-TIME:"), F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("\n"))
    line = F.concat(
        F.when(F.col("discontinuity"), "#EXT-X-DISCONTINUITY\n").otherwise(""), F.when(F.col("_first") | F.col("discontinuity"), date).otherwise(""),
        F.lit("#EXTINF:"), _seconds(F.col("duration_ms"), 3), F.lit(",\n"), F.lpad(F.col("idx").cast("string"), 6, "0"), F.lit(".ts\n"),
    )
    target = F.max(F.ceil(F.greatest(F.lit(1.0), F.col("duration_ms") / 1000)).cast("long"))
    head = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:"), target.cast("string"), F.lit(f"\n#EXT-X-PLAYLIST-TYPE:{'VOD' if ended else 'EVENT'}\n\n"))
    text = F.concat(head, _joined(line, "idx"), F.lit("#EXT-X-ENDLIST\n" if ended else ""))
    return segments.withColumn("_first", first).groupBy("stream_code").agg(F.count(F.lit(1)).alias("entries"), text.alias("playlist"))


def dash_timeline(segments: DataFrame) -> DataFrame:
    """(stream_code, idx, t, dur) in 90 kHz ticks: the time of the first entry alone; entries without length are left out."""
    first = F.col("idx") == F.min("idx").over(Window.partitionBy("stream_code"))
    return segments.withColumn("_first", first).where("duration_ms > 0").select(
        "stream_code", "idx", F.when(F.col("_first"), F.col("ms") * 90).alias("t"), (F.col("duration_ms") * 90).alias("dur")
    )


def segment_number(name: Column, track: str) -> Column:
    """The number in a segment's name (``track`` v or a); 0 for other names."""
    return F.coalesce(F.regexp_extract(name, rf"^seg_{track}_(-?[0-9]+)[.]m4s$", 1).try_cast("long"), F.lit(0).cast("long"))


def earliest(renditions: DataFrame) -> DataFrame:
    """(stream_code, earliest): the first time (avail_ms) at which any rendition was to be had; 0 means not yet."""
    return renditions.groupBy("stream_code").agg(F.min(F.when(F.col("avail_ms") != 0, F.col("avail_ms"))).alias("earliest"))


def dash_manifests(segments: DataFrame, tracks: DataFrame, window: int, segment_sec: int, published: str) -> DataFrame:
    """(stream_code, mpd): the live manifest of all renditions of a stream, one video representation each and the first audio.

    ``segments`` have slug and kind (video or audio) too; ``tracks`` (stream_code, slug, kind, codec, bandwidth, width, height, timescale,
    avail_ms) tell what their times are counted in. ``published`` is the time that the manifest names.
    """
    keys = ["stream_code", "slug", "kind"]
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("idx")))
    shown = segments.withColumn("_back", back).where(F.col("_back") <= window).join(tracks, keys)
    scale = lambda name: F.expr(f"{name} * timescale div 1000").cast("string")
    first = F.col("idx") == F.min("idx").over(Window.partitionBy(*keys))
    entry = F.when(F.coalesce("duration_ms", F.lit(0)) <= 0, "").otherwise(F.concat(F.lit("<S"), F.when(first, F.concat(F.lit(' t="'), scale("ms"), F.lit('"'))).otherwise(""), F.lit(' d="'), scale("duration_ms"), F.lit('"></S>')))
    lists = shown.withColumn("_entry", entry).groupBy(*keys, "codec", "bandwidth", "width", "height", "timescale", "avail_ms").agg(F.min("idx").alias("start"), _joined(F.col("_entry"), "idx").alias("timeline"))
    video = F.col("kind") == "video"
    number = (F.row_number().over(Window.partitionBy("stream_code", "kind").orderBy("slug")) - 1).cast("string")
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))
    size = F.when(video, F.concat(attribute("width", F.col("width")), attribute("height", F.col("height")))).otherwise(attribute("audioSamplingRate", F.col("timescale")))
    initial, media = (F.when(video, f"{name}_v{tail_}").otherwise(f"{name}_a{tail_}") for name, tail_ in (("init", ".mp4"), ("seg", "_$Number%05d$.m4s")))
    shape = F.concat(
        F.lit("<Representation"), attribute("id", F.concat(F.when(video, "v").otherwise("a"), number)), attribute("mimeType", F.concat("kind", F.lit("/mp4"))), attribute("codecs", F.col("codec")),
        attribute("bandwidth", F.col("bandwidth")), size, F.lit("><BaseURL>"), F.col("slug"), F.lit("/</BaseURL><SegmentTemplate"), attribute("timescale", F.col("timescale")),
        attribute("initialization", initial), attribute("media", media), attribute("startNumber", F.greatest(F.col("start"), F.lit(1))), F.lit("><SegmentTimeline>"), F.col("timeline"),
        F.lit("</SegmentTimeline></SegmentTemplate></Representation>"),
    )
    shapes = lists.withColumn("_number", number).withColumn("_shape", shape).where(video | (F.col("_number") == "0"))
    sets = shapes.groupBy("stream_code", "kind").agg(_joined(F.col("_shape"), "slug").alias("shapes"), F.min(F.when(F.col("avail_ms") != 0, F.col("avail_ms"))).alias("avail_ms"))
    adaptation = F.concat(F.lit("<AdaptationSet"), attribute("id", F.when(video, "0").otherwise("1")), attribute("contentType", F.col("kind")), attribute("mimeType", F.concat("kind", F.lit("/mp4"))), F.lit(' segmentAlignment="true" startWithSAP="1">'), F.col("shapes"), F.lit("</AdaptationSet>"))
    start = F.coalesce(F.concat(F.lit(' availabilityStartTime="'), F.date_format(F.timestamp_millis(F.min("avail_ms")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"')), F.lit(""))
    s = segment_sec
    head = f'<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="dynamic" profiles="urn:mpeg:dash:profile:isoff-live:2011" minBufferTime="PT{max(4, 2 * s)}S" suggestedPresentationDelay="PT{max(6, 3 * s)}S" maxSegmentDuration="PT{max(3 * s, s + 1)}S"'
    rest = f' minimumUpdatePeriod="PT{s}S" timeShiftBufferDepth="PT{s * window}S" publishTime="{published}"><Period id="0" start="PT0S">'
    foot = f'</Period><UTCTiming schemeIdUri="urn:mpeg:dash:utc:direct:2014" value="{published}"></UTCTiming></MPD>'
    sets = sets.withColumn("_set", adaptation).withColumn("_order", F.when(video, 0).otherwise(1))
    return sets.groupBy("stream_code").agg(F.concat(F.lit(head), start, F.lit(rest), _joined(F.col("_set"), "_order"), F.lit(foot)).alias("mpd"))


def overlapping(segments: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Segments that overlap a window; one that starts exactly at its end is kept."""
    return segments.where((F.col("ms") + F.col("duration_ms") > start_ms) & (F.col("ms") <= end_ms))


def kept(segments: DataFrame, now_ms: int, retention_ms: int, cap_bytes: int) -> DataFrame:
    """Segments that retention leaves: the oldest go while they are too old or all from them on hold too much (0: no limit); one always stays."""
    onward = F.sum(F.coalesce("size", F.lit(0))).over(Window.partitionBy("stream_code").orderBy(F.desc("idx")))
    stays = F.lit(True)
    if retention_ms:
        stays = stays & (F.col("ms") >= now_ms - retention_ms)
    if cap_bytes:
        stays = stays & (F.col("_onward") <= cap_bytes)
    whole = Window.partitionBy("stream_code")
    first = F.coalesce(F.min(F.when(stays, F.col("idx"))).over(whole), F.max("idx").over(whole))
    return segments.withColumn("_onward", onward).withColumn("_first", first).where("idx >= _first").drop("_onward", "_first")


def gaps_kept(gaps: DataFrame, segments: DataFrame) -> DataFrame:
    """Gaps (stream_code, from_ms, to_ms) that end after the oldest segment that is left."""
    oldest = segments.groupBy("stream_code").agg(F.min_by("ms", "idx").alias("oldest"))
    return gaps.join(oldest, "stream_code").where("to_ms > oldest").select("stream_code", "from_ms", "to_ms")


def decode_times(segments: DataFrame) -> DataFrame:
    """(stream_code, idx, decode_time): the sum of all earlier lengths, in 90 kHz ticks."""
    before = Window.partitionBy("stream_code").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return segments.select("stream_code", "idx", (F.coalesce(F.sum("duration_ms").over(before), F.lit(0).cast("long")) * 90).alias("decode_time"))
