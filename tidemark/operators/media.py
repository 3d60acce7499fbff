"""Tracks, ladders and encoder settings; columns in, columns out, without any window but by stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rate of a profile that names none, codec labels, presets and their counterparts, stream types.
DEFAULT_KBPS, DEFAULT_FPS = 2500, 25
CODECS = ("h264", "h265", "aac")
CPU_PRESETS = ("ultrafast", "superfast", "veryfast", "faster", "fast", "medium", "slow", "slower", "veryslow", "placebo")
GPU_PRESETS = ("p1", "p2", "p3", "p4", "p5", "p6", "p7", "default", "hp", "hq", "bd", "ll", "llhq", "llhp", "lossless", "losslesshp", "slow", "medium", "fast")
CPU_TO_GPU = {
    "ultrafast": "p1", "superfast": "p1", "veryfast": "p2", "faster": "p3", "fast": "p3", "medium": "p4", "slow": "p5", "slower": "p6", "veryslow": "p7", "placebo": "p7",
}
GPU_TO_CPU = {"p1": "ultrafast", "p2": "veryfast", "p3": "fast", "p4": "medium", "p5": "slow", "p6": "slower", "p7": "veryslow"}
ENCODER_CODECS, ACCELERATORS = ("h264", "h265", "vp9", "av1"), ("none", "nvenc", "vaapi", "qsv", "videotoolbox")
STREAM_TYPES = {0x1B: "h264", 0x24: "h265", 0x0F: "aac"}
AUDIO_ENCODERS = {"": "aac", "copy": "aac", "aac": "aac", "mp3": "libmp3lame", "opus": "libopus", "ac3": "ac3"}
RESIZE_MODES = ("pad", "crop", "stretch", "fit")


def _mapped(key: Column, pairs: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def codec_label(codec: Column) -> Column:
    """The codec's name if it is a known one, else empty."""
    return F.when(codec.isin(*CODECS), codec).otherwise("")


def codec_class(codec: Column) -> Column:
    return F.when(codec.isin("h264", "h265"), "video").when(codec == "aac", "audio").otherwise("unknown")


def codec_string(width: Column, height: Column) -> Column:
    """Profile and level that a master playlist names for a picture size."""
    return F.when(width * height >= 1920 * 1080, "avc1.640028").when(width * height >= 1280 * 720, "avc1.4d401f").otherwise("avc1.42e01e")


def bandwidth(kbps: Column) -> Column:
    return F.when(kbps > 0, kbps * 1000).otherwise(DEFAULT_KBPS * 1000)


def ladder(profiles: DataFrame) -> DataFrame:
    """Renditions of (stream_code, idx, width, height, kbps, video_copy, audio_copy): slugs count from 1.

    If both are copied there are none; if only the video is, one without a size.
    """
    place = F.row_number().over(Window.partitionBy("stream_code").orderBy("idx"))
    copied = F.coalesce("video_copy", F.lit(False))
    rows = profiles.where(~(copied & F.coalesce("audio_copy", F.lit(False)))).withColumn("place", place).where(~copied | (F.col("place") == 1))
    zero = F.lit(0).cast("long")
    size = {c: F.when(copied, zero).otherwise(F.col(c)) for c in ("width", "height")}
    kbps = F.when(copied, zero).when(F.col("kbps") > 0, F.col("kbps")).otherwise(DEFAULT_KBPS)
    slug = F.concat(F.lit("track_"), F.col("place").cast("string"))
    return rows.select("stream_code", "idx", slug.alias("slug"), *[e.alias(c) for c, e in size.items()], kbps.alias("kbps"))


def output_tracks(profiles: DataFrame) -> DataFrame:
    """(stream_code, place, kind, codec, width, height, kbps): audio first unless it is off, then a track a profile.

    Profiles carry their stream's audio_codec (empty: off), audio_copy, audio_kbps and video_copy.
    """
    zero, copied = F.lit(0).cast("long"), F.coalesce("audio_copy", F.lit(False))
    first = profiles.groupBy("stream_code").agg(F.max("audio_codec").alias("audio_codec"), F.bool_or(copied).alias("audio_copy"), F.max("audio_kbps").alias("kbps"))
    audio = first.where("audio_copy OR audio_codec != ''").select(
        "stream_code", zero.alias("place"), F.lit("audio").alias("kind"), F.when(F.col("audio_copy"), "copy").otherwise(F.col("audio_codec")).alias("codec"), zero.alias("width"), zero.alias("height"), "kbps"
    )
    place = F.row_number().over(Window.partitionBy("stream_code").orderBy("idx")).cast("long")
    codec = F.when(F.coalesce("video_copy", F.lit(False)) | (F.col("codec") == "copy"), "copy").otherwise(F.col("codec"))
    return audio.unionByName(profiles.select("stream_code", place.alias("place"), F.lit("video").alias("kind"), codec.alias("codec"), "width", "height", "kbps"))


def best_renditions(renditions: DataFrame, score: Column, last: bool = False) -> DataFrame:
    """The row of the highest score of each stream; among equal ones the first by idx, or the last."""
    tie = F.col("idx") if last else -F.col("idx")
    top = renditions.groupBy("stream_code").agg(F.max_by(F.struct("idx", "slug"), F.struct(score.alias("score"), tie.alias("tie"))).alias("top"))
    return top.select("stream_code", "top.idx", "top.slug")


def gop_frames(common: Column, interval: Column, rate: Column, common_fps: Column) -> Column:
    """Frames of a group of pictures: the global number, else interval times rate, half up and 1 at least, else 0."""
    fps = F.when(rate > 0, rate).when(common_fps > 0, common_fps).otherwise(DEFAULT_FPS).cast("double")
    return F.when(common > 0, common).when(interval > 0, F.greatest(F.lit(1), F.floor(interval * fps + 0.5))).otherwise(0).cast("long")


def preset_for(preset: Column, encoder: Column) -> Column:
    """The preset as the encoder's family spells it; empty where it has none like it, as typed for unknown families."""
    p, e = F.lower(F.trim(F.coalesce(preset, F.lit("")))), F.lower(F.coalesce(encoder, F.lit("")))
    gpu = F.when(p.isin(*GPU_PRESETS), p).otherwise(F.coalesce(_mapped(p, CPU_TO_GPU), F.lit("")))
    cpu = F.when(p.isin(*CPU_PRESETS), p).otherwise(F.coalesce(_mapped(p, GPU_TO_CPU), F.lit("")))
    return F.when(p == "", "").when(e.contains("nvenc"), gpu).when(e.startswith("libx264") | e.startswith("libx265") | e.contains("qsv"), cpu).when(e.contains("vaapi") | e.contains("videotoolbox"), "").otherwise(preset)


def video_encoder(codec: Column, accelerator: Column) -> Column:
    """The encoder of a codec's name and an accelerator; full encoder names stay as they are."""
    c, gpu = F.lower(F.trim(F.coalesce(codec, F.lit("")))), F.coalesce(accelerator == "nvenc", F.lit(False))
    spelt = c.rlike("nvenc|qsv|videotoolbox|264|265|hevc")
    return (
        F.when(c.isin("", "h264", "avc"), F.when(gpu, "h264_nvenc").otherwise("libx264")).when(c.isin("h265", "hevc"), F.when(gpu, "hevc_nvenc").otherwise("libx265"))
        .when(c == "vp9", "libvpx-vp9").when(c == "av1", "libsvtav1").when(spelt, codec).otherwise("libx264")
    )


def audio_encoder(codec: Column) -> Column:
    return F.coalesce(_mapped(F.lower(F.trim(F.coalesce(codec, F.lit("")))), AUDIO_ENCODERS), F.lit("aac"))


def resize_mode(mode: Column) -> Column:
    m = F.lower(F.trim(F.coalesce(mode, F.lit(""))))
    return F.when(m.isin(*RESIZE_MODES), m).otherwise("pad")


def encoder_matrix(spark) -> DataFrame:
    """(codec, accelerator, encoder): every codec family with every accelerator."""
    rows = spark.createDataFrame([(c, a) for c in ENCODER_CODECS for a in ACCELERATORS], "codec string, accelerator string")
    return rows.withColumn("encoder", video_encoder(F.col("codec"), F.col("accelerator")))


def resize_filter(width: Column, height: Column, mode: Column, gpu: str | None = None) -> Column:
    """The scale filter of a picture box; ``gpu`` is the name of the accelerator's filter, which can only fit or stretch."""
    w, h, name = width.cast("string"), height.cast("string"), gpu or "scale"
    one = F.when(width > 0, F.concat(F.lit(f"{name}="), w, F.lit(":-2"))).otherwise(F.concat(F.lit(f"{name}=-2:"), h))
    box = F.concat(F.lit(f"{name}="), w, F.lit(":"), h)
    fit = F.concat(box, F.lit(":force_original_aspect_ratio=decrease:force_divisible_by=2"))
    crop = F.concat(box, F.lit(":force_original_aspect_ratio=increase,crop="), w, F.lit(":"), h)
    pad = F.concat(box, F.lit(":force_original_aspect_ratio=decrease,pad=ceil(iw/2)*2:ceil(ih/2)*2:(ow-iw)/2:(oh-ih)/2"))
    both = F.when(mode == "stretch", box).otherwise(fit) if gpu else F.when(mode == "stretch", box).when(mode == "fit", fit).when(mode == "crop", crop).otherwise(pad)
    return F.when((width <= 0) | (height <= 0), one).otherwise(both)


def overlay_place(position: Column, x: Column, y: Column, text: bool) -> dict[str, Column]:
    """x and y expressions of a text or a picture laid over the frame; unknown positions are the lower right corner."""
    (w, own_w, h, own_h) = ("w", "tw", "h", "th") if text else ("W", "w", "H", "h")
    left, top = x.cast("string"), y.cast("string")
    right, bottom = F.concat(F.lit(f"{w}-{own_w}-"), left), F.concat(F.lit(f"{h}-{own_h}-"), top)
    return {
        "x": F.when(position.isin("top_left", "bottom_left"), left).when(position == "center", f"({w}-{own_w})/2").otherwise(right),
        "y": F.when(position.isin("top_left", "top_right"), top).when(position == "center", f"({h}-{own_h})/2").otherwise(bottom),
    }


def stream_type_codec(kind: Column) -> Column:
    """Codec of a transport stream's type; null for those that are dropped."""
    return _mapped(kind.cast("int"), STREAM_TYPES)


def rtp_payload_at(packet: Column) -> Column:
    """Where the payload of an RTP packet begins, in bytes; null if it is none of version 2 or holds no transport stream."""

    def byte(at: Column | int) -> Column:
        return F.conv(F.hex(F.substring(packet, (at if isinstance(at, Column) else F.lit(at)) + 1, F.lit(1))), 16, 10).cast("int")

    length = F.octet_length(packet)
    fixed = F.lit(12) + byte(0).bitwiseAND(15) * 4
    extended = byte(0).bitwiseAND(16) != 0
    words = byte(fixed + 2) * 256 + byte(fixed + 3)
    at = F.when(extended, F.when(length >= fixed + 4, fixed + 4 + words * 4)).otherwise(fixed)
    return F.when((length >= 12) & (byte(0).bitwiseAND(192) == 128) & (at < length) & (byte(at) == 0x47), at)


def listed(lines: DataFrame, kind: str) -> DataFrame:
    """Names that a listing of ``encoders``, ``muxers`` or ``filters`` (lines) holds: the second word of its rows."""
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    flags = {"encoders": F.get(words, F.lit(0)).rlike("[VAS]"), "muxers": F.get(words, F.lit(0)).rlike("[DE]"), "filters": F.get(words, F.lit(2)).contains("->")}[kind]
    return lines.where((F.size(words) >= 2) & flags).select(F.get(words, F.lit(1)).alias("name")).distinct()


def encoder_version(text: Column) -> Column:
    """Version of the first line of the encoder's own report, else empty."""
    return F.regexp_extract(F.split_part(text, F.lit("\n"), F.lit(1)), r"(?i)^ffmpeg version\s+(\S+)", 1)


def track_places(tracks: DataFrame) -> DataFrame:
    """(stream_code, codec, place): h264, h265, aac in this order; others are left out."""
    order = reduce(lambda c, k: c.when(F.col("codec") == CODECS[k], k), range(len(CODECS)), F)
    held = tracks.where(F.col("codec").isin(*CODECS)).select("stream_code", "codec").distinct()
    return held.withColumn("place", F.row_number().over(Window.partitionBy("stream_code").orderBy(order)).cast("long"))


def frame_scales(renditions: DataFrame) -> DataFrame:
    """(stream_code, idx, scale): each width as a share of the stream's widest."""
    return renditions.select("stream_code", "idx", (F.col("width").cast("double") / F.max("width").over(Window.partitionBy("stream_code"))).alias("scale"))
