"""Small cases with the rows that must come out: functions of one row whose edges no stored table reaches.

Each case is a query over the rows that it lists; its oracle is the list of what is expected, typed in by hand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clients, configs, media, playlists, segmenters, sessions, signals, urls

COL = F.col


@dataclass(frozen=True)
class Case:
    """``rows`` begin with the ``given`` columns and end with those that are expected."""

    given: str
    expected: str
    rows: tuple[tuple, ...]
    apply: Callable[[DataFrame], DataFrame]

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        n = len(self.given.split(","))
        given = spark.createDataFrame([(k, *r[:n]) for k, r in enumerate(self.rows)], "case long, " + self.given)
        return self.apply(given).select("case", *[c.split()[0] for c in self.expected.split(", ")])

    @property
    def oracle(self) -> str:
        n = len(self.given.split(","))
        names, kinds = zip(*(c.split() for c in self.expected.split(", ")))
        kinds = [{"string": "VARCHAR", "long": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}[k] for k in kinds]

        def literal(value: object, kind: str) -> str:
            if value is None:
                return f"CAST(NULL AS {kind})"
            return f"CAST('{str(value).replace(chr(39), chr(39) * 2)}' AS {kind})"

        lines = [f"SELECT CAST({k} AS BIGINT) AS \"case\", " + ", ".join(f"{literal(v, t)} AS {c}" for v, t, c in zip(r[n:], kinds, names)) for k, r in enumerate(self.rows)]
        return " UNION ALL ".join(lines)


def _with(columns: Callable[[], dict]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.withColumns(columns())




CASES = {
    "case_url_kind": Case("url string", "kind string, listens boolean", (
        ("rtmp://h/live", "rtmp", False), ("RTMPS://h/x", "rtmp", False), ("srt://h:9000", "srt", False), ("udp://239.0.0.1:5000", "udp", False), ("rtsps://h/a", "rtsp", False),
        ("http://h/a.m3u8?t=1", "hls", False), ("https://h/A.M3U8#x", "hls", False), ("http://h/a.m3u", "hls", False), ("http://h/x?y=.m3u8", "unknown", False), ("http://h/a.ts", "unknown", False),
        ("file:///v/a.ts", "file", False), ("/v/a.ts", "file", False), ("v/a.ts", "unknown", False), ("", "unknown", False), (None, None, None), ("publish://", "publish", True), ("copy://x", "copy", False),
        ("mixer://a,b", "mixer", False), ("s3://b/k", "unknown", False), ("http://h/%zz.m3u8", "unknown", False), ("rtmp://h:port/a", "unknown", False),
        ("rtmp://0.0.0.0:1935/live", "rtmp", True), ("srt://0.0.0.0:9999", "srt", True), ("rtmp://0.0.0.0.example/live", "rtmp", False), ("rtmp://127.0.0.1/live", "rtmp", True), ("rtmp://127.9.8.7/x", "rtmp", True),
        ("rtmp://[::]:1935/live", "rtmp", True), ("srt://[::1]:9000", "srt", True), ("rtmp://[2001:db8::1]/x", "rtmp", False), ("srt://:9000", "srt", True), ("rtmp://localhost/x", "rtmp", False), ("udp://0.0.0.0:1", "udp", False),
    ), _with(lambda: dict(kind=urls.kind(COL("url")), listens=urls.listens(COL("url"))))),
    "case_codes_of_url": Case("url string", "first_code string, second_code string, reason string, goes_on boolean", (
        ("copy://news", "news", None, "ok", False), ("COPY://news/", "news", None, "ok", False), ("copy://", None, None, "missing", False), ("copy://a:80", None, None, "port", False), ("copy://a:b", None, None, "malformed", False),
        ("copy://u:p@a", None, None, "userinfo", False), ("copy://a/raw", None, None, "path", False), ("copy://a?x", None, None, "query", False), ("copy://a#f", None, None, "fragment", False),
        ("mixer://cam,mic", "cam", "mic", "ok", False), ("mixer://cam,mic?audio_failure=continue", "cam", "mic", "ok", True), ("mixer://cam,mic?audio_failure=down", "cam", "mic", "ok", False), ("mixer://cam,mic?audio_failure=", "cam", "mic", "ok", False),
        ("mixer://cam", None, None, "two codes", False), ("mixer://a,b,c", None, None, "two codes", False), ("mixer://,b", None, None, "no video", False), ("mixer://a,", None, None, "no audio", False), ("mixer://", None, None, "missing", False),
        ("mixer://a,b:80", None, None, "port", False), ("mixer://a,b?x=1", None, None, "unknown parameter", False), ("mixer://a,b?audio_failure=down&audio_failure=continue", None, None, "repeated parameter", False),
        ("mixer://a,b?audio_failure=up", None, None, "bad value", False), ("mixer://a,b/x", None, None, "path", False),
    ), urls.upstreams),
    "case_path": Case("path string", "proto string, stream_code string", (
        ("/Live1/index.m3u8", "hls", "Live1"), ("/a/seg_1.TS", "hls", "a"), ("/a/b/manifest.mpd", "dash", "a"), ("/a/x.m4s", "dash", "a"), ("/a/x.mp4", "dash", "a"), ("/index.m3u8", "hls", ""), ("/a.b/x", "", "a.b"), ("", "", ""), ("//x.ts", "hls", ""),
    ), _with(lambda: dict(proto=urls.media_proto(COL("path")), stream_code=urls.path_code(COL("path"))))),
    "case_client": Case("forwarded string, real string, remote string", "client string", (
        ("1.2.3.4, 10.0.0.1", "", "9.9.9.9:1", "1.2.3.4"), ("1.2.3.4:55 , x", None, "9.9.9.9:1", "1.2.3.4"), ("", "5.6.7.8:80", "9.9.9.9:1", "5.6.7.8"), (None, None, "9.9.9.9:1", "9.9.9.9"), ("", "", "[::1]:80", "::1"),
        ("", "", "2001:db8::7", "2001:db8::7"), ("2001:db8::7", "", "x:1", "2001:db8::7"), ("[2001:db8::8]:443", "", "x:1", "2001:db8::8"), ("", "", "host", "host"), ("", "", None, ""), ("  ", " ", "a:1", "a"), (":81", "7.7.7.7", "a:1", "7.7.7.7"),
    ), _with(lambda: dict(client=clients.client_address(COL("forwarded"), COL("real"), COL("remote"))))),
    "case_token": Case("query string", "token string", (
        ("token=abc", "abc"), ("a=1&token=x%20y+z&token=second", "x y z"), ("token=%20t%20", "t"), ("tokens=1", ""), ("", ""), (None, ""), ("token", ""), ("a=token", ""),
    ), _with(lambda: dict(token=urls.query_token(COL("query"))))),
    "case_resolved_url": Case("base string, ref string", "url string", (
        ("http://h/live/index.m3u8?t=1", "seg.ts", "http://h/live/seg.ts"), ("http://h/live/index.m3u8", "/a/b.ts", "http://h/a/b.ts"), ("http://h/live/x/index.m3u8", "../seg.ts", "http://h/live/seg.ts"),
        ("http://h/live/index.m3u8", "https://o/x.ts", "https://o/x.ts"), ("http://h/live/index.m3u8", "//cdn/x.ts", "http://cdn/x.ts"), (None, "seg.ts", "seg.ts"), ("http://h/live/index.m3u8", "?v=2", "http://h/live/index.m3u8?v=2"),
    ), urls.resolved),
    "case_stream_code": Case("code string", "problem string", (
        ("news_1", "ok"), (" news ", "ok"), ("", "required"), ("  ", "required"), (None, "required"), ("a-b", "bad characters"), ("é", "bad characters"), ("a b", "bad characters"), ("x" * 128, "ok"), ("x" * 129, "too long"),
    ), _with(lambda: dict(problem=configs.code_problem(COL("code"))))),
    "case_error": Case("text string", "verdict string", (
        ("x509: certificate signed by unknown authority", "fatal"), ("x509 without a colon", "retry"), ("remote error: tls: bad", "fatal"), ("lookup h: no such host", "fatal"), ("HTTP 404", "fatal"), ("Http 503 Service", "fatal"),
        ("http 418", "retry"), ("status 404", "retry"), ("xhttp 404", "retry"), ("http 4040", "retry"), ("http 500x", "retry"), ("EOF", "retry"), (None, "retry"), ("", "retry"),
    ), _with(lambda: dict(verdict=signals.verdict(COL("text"))))),
    "case_codec_string": Case("width long, height long", "codecs string", (
        (1920, 1080, "avc1.640028"), (3840, 2160, "avc1.640028"), (1280, 720, "avc1.4d401f"), (1919, 1080, "avc1.4d401f"), (854, 480, "avc1.42e01e"), (0, 0, "avc1.42e01e"),
    ), _with(lambda: dict(codecs=media.codec_string(COL("width"), COL("height"))))),
    "case_gop": Case("common long, step long, rate double, fps long", "frames long", (
        (60, 2, 30.0, 25, 60), (0, 2, 30.0, 25, 60), (0, 2, 0.0, 50, 100), (0, 2, 0.0, 0, 50), (0, 2, 29.97, 0, 60), (0, 0, 30.0, 25, 0), (0, 1, 0.2, 0, 1), (0, -1, 30.0, 0, 0),
    ), _with(lambda: dict(frames=media.gop_frames(COL("common"), COL("step"), COL("rate"), COL("fps"))))),
    "case_preset": Case("preset string, encoder string", "spelt string", (
        ("veryfast", "h264_nvenc", "p2"), ("p4", "h264_nvenc", "p4"), ("medium", "hevc_nvenc", "medium"), ("placebo", "h264_nvenc", "p7"), ("bogus", "h264_nvenc", ""), ("llhq", "h264_nvenc", "llhq"),
        ("p5", "libx264", "slow"), ("p1", "libx265", "ultrafast"), ("VeryFast ", "libx264", "veryfast"), ("hq", "libx264", ""), ("p7", "h264_qsv", "veryslow"), ("fast", "h264_vaapi", ""), ("fast", "h264_videotoolbox", ""),
        ("", "libx264", ""), (None, "libx264", ""), ("Odd", "libsvtav1", "Odd"),
    ), _with(lambda: dict(spelt=media.preset_for(COL("preset"), COL("encoder"))))),
    "case_encoder": Case("codec string, accelerator string", "video string, audio string, mode string", (
        ("", "none", "libx264", "aac", "pad"), ("H264", "nvenc", "h264_nvenc", "aac", "pad"), ("hevc", "nvenc", "hevc_nvenc", "aac", "pad"), ("h265", "vaapi", "libx265", "aac", "pad"), ("vp9", "nvenc", "libvpx-vp9", "aac", "pad"),
        ("av1", "none", "libsvtav1", "aac", "pad"), ("h264_vaapi", "vaapi", "h264_vaapi", "aac", "pad"), ("h264_qsv", "qsv", "h264_qsv", "aac", "pad"), ("mp3", "none", "libx264", "libmp3lame", "pad"), ("opus", "none", "libx264", "libopus", "pad"),
        ("ac3", "none", "libx264", "ac3", "pad"), (" Crop", "none", "libx264", "aac", "crop"), ("fit", "none", "libx264", "aac", "fit"), (None, None, "libx264", "aac", "pad"),
    ), _with(lambda: dict(video=media.video_encoder(COL("codec"), COL("accelerator")), audio=media.audio_encoder(COL("codec")), mode=media.resize_mode(COL("codec"))))),
    "case_resize": Case("width long, height long, mode string", "cpu string, gpu string", (
        (1280, 0, "fit", "scale=1280:-2", "scale_cuda=1280:-2"), (0, 720, "pad", "scale=-2:720", "scale_cuda=-2:720"), (640, 360, "stretch", "scale=640:360", "scale_cuda=640:360"),
        (640, 360, "fit", "scale=640:360:force_original_aspect_ratio=decrease:force_divisible_by=2", "scale_cuda=640:360:force_original_aspect_ratio=decrease:force_divisible_by=2"),
        (640, 360, "crop", "scale=640:360:force_original_aspect_ratio=increase,crop=640:360", "scale_cuda=640:360:force_original_aspect_ratio=decrease:force_divisible_by=2"),
        (640, 360, "pad", "scale=640:360:force_original_aspect_ratio=decrease,pad=ceil(iw/2)*2:ceil(ih/2)*2:(ow-iw)/2:(oh-ih)/2", "scale_cuda=640:360:force_original_aspect_ratio=decrease:force_divisible_by=2"),
    ), _with(lambda: dict(cpu=media.resize_filter(COL("width"), COL("height"), COL("mode")), gpu=media.resize_filter(COL("width"), COL("height"), COL("mode"), "scale_cuda")))),
    "case_overlay": Case("position string, left long, top long", "text_x string, text_y string, x string, y string", (
        ("top_left", 10, 20, "10", "20", "10", "20"), ("top_right", 10, 20, "w-tw-10", "20", "W-w-10", "20"), ("bottom_left", 10, 20, "10", "h-th-20", "10", "H-h-20"), ("center", 10, 20, "(w-tw)/2", "(h-th)/2", "(W-w)/2", "(H-h)/2"),
        ("bottom_right", 10, 20, "w-tw-10", "h-th-20", "W-w-10", "H-h-20"), ("custom", 1, 2, "w-tw-1", "h-th-2", "W-w-1", "H-h-2"), (None, 1, 2, "w-tw-1", "h-th-2", "W-w-1", "H-h-2"),
    ), lambda rows: rows.withColumns({f"text_{k}": v for k, v in media.overlay_place(COL("position"), COL("left"), COL("top"), True).items()} | media.overlay_place(COL("position"), COL("left"), COL("top"), False))),
    "case_segment_number": Case("name string", "video long, audio long", (
        ("seg_v_00042.m4s", 42, 0), ("seg_a_00012.m4s", 0, 12), ("seg_v_.m4s", 0, 0), ("seg_v_00042.mp4", 0, 0), ("x", 0, 0), (None, 0, 0),
    ), _with(lambda: dict(video=playlists.segment_number(COL("name"), "v"), audio=playlists.segment_number(COL("name"), "a")))),
    "case_push_number": Case("state string", "number long", (("active", 3), ("starting", 2), ("reconnecting", 1), ("failed", 0), ("odd", 0), (None, 0)), _with(lambda: dict(number=signals.state_number(COL("state"))))),
    "case_stream_type": Case("kind long", "codec string", ((0x1B, "h264"), (0x24, "h265"), (0x0F, "aac"), (0x03, None), (0x04, None), (0x81, None), (None, None)), _with(lambda: dict(codec=media.stream_type_codec(COL("kind"))))),
    "case_rtp": Case("packet string", "at long", (
        ("80 21 0001 00000001 00000002 47 00", 12), ("82 21 0001 00000001 00000002 0a0a0a0a 0b0b0b0b 47 01", 20), ("90 21 0001 00000001 00000002 beef 0001 cccccccc 47", 20), ("40 21 0001 00000001 00000002 47", None),
        ("80 21 0001 00000001 00000002 48", None), ("80 21 0001 00000001 00000002", None), ("80 21", None), ("90 21 0001 00000001 00000002 be", None), ("", None),
    ), lambda rows: rows.withColumn("at", media.rtp_payload_at(F.unhex(F.replace("packet", F.lit(" "), F.lit("")))).cast("long"))),
    "case_version": Case("text string", "version string", (
        ("ffmpeg version 6.1.1-3ubuntu5 Copyright (c) 2000\nbuilt", "6.1.1-3ubuntu5"), ("FFmpeg version n7.0 x", "n7.0"), ("avconv 1", ""), ("", ""),
    ), _with(lambda: dict(version=media.encoder_version(COL("text"))))),
    "case_listing_line": Case("kind string, line string", "name string", (
        ("encoders", " V..... libx264              H.264", "libx264"), ("encoders", " A..... aac    AAC", "aac"), ("encoders", " ------", None), ("muxers", "  E mpegts   MPEG-TS", "mpegts"), ("muxers", " -- x", None),
        ("filters", " T.. drawtext  V->V  Draw", "drawtext"), ("filters", "  T.. = Timeline support", None), ("filters", " ... overlay VV->V Overlay", "overlay"),
    ), lambda rows: _listing_lines(rows)),
    "case_session_request": Case("proto string, status string, lim string", "verdict string, most long", (
        ("", "", "", "ok", 0), ("hls", "active", "10", "ok", 10), ("dash", "closed", "5000", "ok", 1000), ("ftp", "", "", "invalid proto", None), ("", "open", "", "invalid status", None), ("", "", "-1", "invalid limit", None),
        ("", "", "x", "invalid limit", None), (None, None, None, "ok", 0), ("rtsp", "", "0", "ok", 0), ("", "", "99999999999999999999", "invalid limit", None),
    ), lambda rows: rows.withColumns(sessions.request_verdict(COL("proto"), COL("status"), COL("lim")))),
    "case_push_order": Case("url string", "place long", (("rtmp://b", 1), ("rtmp://a", 0), ("srt://c", 2)), lambda rows: _places(rows, "url")),
    "case_document": Case("section string, text string", "keys string, first_problem string", (
        ("streams", '{"streams":{"b":{"code":"b","name":"B"},"a":{"code":"a-1","name":"A"}}}', "a,b", "bad characters"), ("streams", "{}", "", None), ("streams", "not json", "", None),
    ), lambda rows: _documents(rows)),
    "case_global": Case("text string", "found string", (
        ('{"global_config":{"server":{"http_addr":":8080","cors":{"allowed_origins":["*"],"allow_credentials":true}},"buffer":{"capacity":0},"log":{"level":"LOUD","format":"JSON"}}}', "global_config.buffer.capacity=not above 0,global_config.log.level=unknown,global_config.server.cors.allow_credentials=with any origin"),
        ('{"global_config":{"server":{},"hooks":{},"publisher":{"hls":{"dir":"a","live_segment_sec":-1},"dash":{"dir":"a"}}}}', "global_config.hooks.worker_count=not above 0,global_config.publisher.dash.dir=same as hls,global_config.publisher.hls.live_segment_sec=below 0,global_config.server.http_addr=required"),
        ('{"global_config":{"server":{"http_addr":"nowhere"},"listeners":{"rtmp":{"enabled":true},"rtsp":{"enabled":false,"port":99999},"srt":{"enabled":true,"port":70000,"latency_ms":-5}}}}', "global_config.listeners.rtmp.port=required,global_config.listeners.srt.latency_ms=below 0,global_config.listeners.srt.port=not a port,global_config.server.http_addr=not host:port"),
        ('{"global_config":{"server":{"http_addr":"[::1]:80"}}}', ""), ("{}", ""), ("not json", ""), (None, ""),
    ), lambda rows: _globals(rows)),
    "case_segment_cut": Case("event_id long, ms long, pts_ms long", "segment long", (
        (1, 0, 100, 1), (2, 10, 3100, 1), (3, 20, 4100, 1), (4, 30, 4200, 2), (5, 40, 8099, 2), (6, 50, 8100, 2), (7, 60, 8200, 3), (8, None, 9000, None), (9, 70, None, 3),
    ), lambda rows: _back(rows, segmenters.span_segments(rows.withColumn("stream_code", F.lit("a")), 4000), "segment")),
    "case_clock_cut": Case("event_id long, ms long, pts_ms long", "segment long", (
        (1, 0, 0, 1), (2, 3999, None, 1), (3, 4000, 0, 1), (4, 4500, 0, 2), (5, 8000, 0, 2), (6, 8001, 0, 3),
    ), lambda rows: _back(rows, segmenters.span_segments(rows.withColumn("stream_code", F.lit("a")), 4000), "segment")),
    "case_waiting_video": Case("event_id long, ms long, codec string, key_frame boolean, pts_ms long", "segment long", (
        (1, 0, "h264", True, 0, 1), (2, 10, "aac", False, 0, 1), (3, 20, "h264", False, 1000, 1), (4, 30, "h264", False, 2000, 1), (5, 40, "h264", False, 2040, 2), (6, 2040, "aac", False, 0, 2), (7, 2050, "h264", True, 2100, 3),
    ), lambda rows: _back(rows, segmenters.dash_segments(rows.withColumn("stream_code", F.lit("a")), 2000, 3), "segment")),
    "case_bitrate": Case("event_id long, ms long, size long", "kbps double", (
        (1, 0, 1000, 0.0), (2, 4000, 3000, 8.0), (3, 6000, 1000, 8.0), (4, 8000, 3000, 8.0), (5, 12000, 0, 4.0), (6, None, 9999, None),
    ), lambda rows: _back(rows, segmenters.smoothed_bitrate(rows.withColumns({"stream_code": F.lit("a"), "codec": F.lit("aac")})), "kbps")),
    "case_suppression": Case("event_id long, message string", "attempt long, same long, visible boolean", tuple(
        (k, "x" if k <= 2 else "y", k, k if k <= 2 else k - 2, k in (1, 2, 3, 4, 5, 8)) for k in range(1, 11)
    ), lambda rows: signals.shown_errors(rows.withColumns({"stream_code": F.lit("a"), "ms": COL("event_id")}))),
}


def _back(rows: DataFrame, found: DataFrame, column: str) -> DataFrame:
    return rows.join(found.select("event_id", column), "event_id")


def _places(rows: DataFrame, by: str) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("place", (F.row_number().over(Window.orderBy(by)) - 1).cast("long"))


def _listing_lines(rows: DataFrame) -> DataFrame:
    found = None
    for kind in ("encoders", "muxers", "filters"):
        own = rows.where(COL("kind") == kind)
        names = media.listed(own.select("line"), kind)
        part = own.join(names, own["line"].contains(names["name"]), "left").select("case", "name")
        found = part if found is None else found.unionByName(part)
    return found


def _documents(rows: DataFrame) -> DataFrame:
    entries = rows.select("case", F.explode_outer(F.from_json(F.get_json_object("text", "$.streams"), "map<string,struct<code:string,name:string>>")).alias("key", "entry"))
    problem = F.when(COL("entry").isNotNull(), configs.code_problem(COL("entry.code")))
    held = entries.groupBy("case").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"), F.min(F.when(problem != "ok", problem)).alias("first_problem"))
    return held


def _globals(rows: DataFrame) -> DataFrame:
    found = configs.global_errors(rows).groupBy("case").agg(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit("="), "problem"))), ",").alias("found"))
    return rows.join(found, "case", "left").withColumn("found", F.coalesce("found", F.lit("")))
