"""Playlist text as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def media_playlist(lines: DataFrame) -> DataFrame:
    """Segments of media playlists given as (playlist, line_no, line).

    A length or a discontinuity holds for the next address; sequence numbers count from the declared one.
    """
    order = Window.partitionBy("playlist").orderBy("line_no")
    is_address = (F.col("line") != "") & ~F.col("line").startswith("#")
    marked = lines.withColumn("is_address", is_address).withColumn("entry", F.coalesce(F.sum(F.col("is_address").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    entry = marked.groupBy("playlist", "entry").agg(
        F.max(F.when(F.col("is_address"), F.col("line"))).alias("uri"),
        F.max(F.regexp_extract("line", r"^#EXTINF:([0-9.]+)", 1)).alias("length"),
        F.max(F.col("line") == "#EXT-X-DISCONTINUITY").alias("discontinuity"),
        F.max(F.when(F.col("line").startswith("#EXT-X-MEDIA-SEQUENCE:"), F.split_part("line", F.lit(":"), F.lit(2)).cast("long"))).alias("first"),
    )
    whole = Window.partitionBy("playlist")
    return entry.where("uri is not null").select(
        "playlist", (F.coalesce(F.max("first").over(whole), F.lit(0)) + F.col("entry")).alias("sequence"), "uri",
        F.expr("try_cast(length AS double)").alias("duration"), "discontinuity",
    )


def variants(lines: DataFrame) -> DataFrame:
    """Variants of master playlists: the address after each stream tag, with its bandwidth."""
    order = Window.partitionBy("playlist").orderBy("line_no")
    tagged = lines.where("line != ''").withColumn("tag", F.lag("line").over(order))
    return tagged.where("tag LIKE '#EXT-X-STREAM-INF:%' AND line NOT LIKE '#%'").select(
        "playlist", "line_no", F.col("line").alias("uri"), F.expr("try_cast(regexp_extract(tag, '(?:^|[:,])BANDWIDTH=([0-9]+)', 1) AS bigint)").alias("bandwidth")
    )


def lines_of(texts: DataFrame) -> DataFrame:
    """(playlist, text) to (playlist, line_no, line)."""
    return texts.select("playlist", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def recording_playlist(lines: DataFrame) -> DataFrame:
    """Segments of recordings' playlists given as (playlist, line_no, line): idx, wall_ms, duration_ms and discontinuity.

    The number is the file's name; a date holds on for the segments after it, and entries whose name is no number, or
    that have no length, are left out.
    """
    order = Window.partitionBy("playlist").orderBy("line_no")
    date = F.when(F.col("line").startswith("#EXT-X-PROGRAM-DATE-TIME:"), F.unix_millis(F.expr("try_to_timestamp(substr(line, 26), \"yyyy-MM-dd'T'HH:mm:ss.SSSX\")")))
    lines = lines.withColumn("line", F.trim("line")).withColumn("wall_ms", F.last(date, ignorenulls=True).over(order))
    lines = lines.withColumn("is_address", (F.col("line") != "") & ~F.col("line").startswith("#"))
    lines = lines.withColumn("entry", F.coalesce(F.sum(F.col("is_address").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    entry = lines.groupBy("playlist", "entry").agg(
        F.max(F.when(F.col("is_address"), F.regexp_extract("line", r"^(?:.*/)?([0-9]+)(?:[.]ts)?$", 1))).alias("name"), F.max(F.when(F.col("is_address"), F.col("wall_ms"))).alias("wall_ms"),
        F.max(F.expr("try_cast(nullif(regexp_extract(line, '^#EXTINF:([^,]*),?$', 1), '') AS double)")).alias("seconds"), F.max(F.col("line") == "#EXT-X-DISCONTINUITY").alias("discontinuity"),
    )
    return entry.where("name != '' AND seconds IS NOT NULL").select("playlist", F.col("name").cast("long").alias("idx"), "wall_ms", F.round(F.col("seconds") * 1000).cast("long").alias("duration_ms"), "discontinuity")
