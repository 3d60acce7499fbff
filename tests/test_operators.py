"""Stateful operators, readers and sinks against loops and written-out cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tidemark import functions
from tidemark.operators import configs, failover, hooks, media, playlists, segmenters, signals, urls
from tidemark.operators import sessions as play
from tidemark.plans import oracles
from tidemark.sources import readers, views
from tidemark.streaming import sessions, sinks


def packets(spark, rows):
    return spark.createDataFrame(rows, "stream_code string, event_id long, ms long, key_frame boolean, discontinuity boolean")


def numbers(frame, column="segment"):
    return [r[column] for r in frame.orderBy("event_id").collect()]


def test_keyframes_force_and_discontinuity(spark):
    rows = [(0, True, False), (1900, False, False), (2100, False, False), (2200, True, False), (5300, False, False), (5400, False, False), (5500, False, True)]
    frame = packets(spark, [("a", i, *r) for i, r in enumerate(rows)])
    assert numbers(segmenters.keyframe_segments(frame, 2000)) == [1, 1, 1, 2, 3, 3, 4]


def test_session_life(spark):
    hits = spark.createDataFrame([(1, i, 10 * i) for i in range(7)], "user_id long, event_id long, ms long")
    assert numbers(segmenters.bounded_sessions(hits, 10, 30), "session") == [1, 1, 1, 1, 2, 2, 2]
    assert numbers(segmenters.bounded_sessions(hits, 9, 1000), "session") == [1, 2, 3, 4, 5, 6, 7]


def ts(fill: bytes) -> bytes:
    return b"\x47" + fill * 187


def test_aligned_packets(spark):
    a, b, c = ts(b"a"), ts(b"b"), ts(b"c")
    for chunks, found in [([b"xx" + a + b + c], [a, b, c]), ([b"\x47zz" + a[:180], a[180:] + b + c], [a, b, c]), ([a[:100], a[100:] + b], [a, b]), ([b""], []), ([b"\x47" * 10], []), ([b"z" * 500, a + b], [a, b])]:
        aligner = segmenters.Aligner()
        assert [p for chunk in chunks for p in aligner.feed(chunk)] == found
    # Without the packet after it in sight, a packet is taken at its first sync byte.
    assert segmenters.Aligner().feed(b"\x47zz" + a) == [(b"\x47zz" + a)[:188]]
    frame = spark.createDataFrame([("s", 2, b[50:]), ("s", 1, a + b[:50]), ("t", 1, c), ("t", 2, None)], "stream_code string, seq long, data binary")
    assert sorted((r.stream_code, r.seq, bytes(r.packet)) for r in segmenters.aligned_packets(frame).collect()) == [("s", 1, a), ("s", 2, b), ("t", 1, c)]


def test_best_input():
    assert failover.best_input({0: 0, 1: 0}, 10) == 0
    assert failover.best_input({0: 0, 1: 0}, 10, override=1) == 1
    assert failover.best_input({0: 0, 1: 9}, 10, timeout_ms=5) == 1
    assert failover.best_input({0: 0}, 10, timeout_ms=5) is None


def test_rows_without_times_change_nothing(spark):
    kind = "stream_code string, event_id long, ms long, input_priority long"
    rows = [("a", 1, 0, 0), ("a", 2, 50, 1), ("a", 3, 400, 1)]
    plain, odd = (spark.createDataFrame(r, kind) for r in (rows, [*rows, ("a", 9, None, 0), ("a", 8, 30, None), (None, 7, 5, 0)]))
    seen = [sorted(map(str, failover.switch_history(f, timeout_ms=100, cooldown_ms=100, until_ms=1000).collect())) for f in (plain, odd)]
    assert seen[0] == seen[1] and failover.timeline(plain.limit(0)).count() == 0
    hits = spark.createDataFrame([(1, 1, 0), (1, 2, None), (1, 3, 5), (None, 4, 7)], "user_id long, event_id long, ms long")
    assert numbers(segmenters.bounded_sessions(hits, 10, 30), "session") == [1, None, 1, 1]
    assert segmenters.bounded_sessions(hits.limit(0), 10, 30).count() == 0


def test_failover_waits_for_the_cooldown(spark):
    rows = [("a", 1, 0, 0), ("a", 2, 50, 1), ("a", 3, 200, 1), ("a", 4, 210, 0), ("a", 5, 310, 0)]
    frame = spark.createDataFrame(rows, "stream_code string, event_id long, ms long, input_priority long")
    assert numbers(failover.active_inputs(frame, timeout_ms=100, cooldown_ms=100), "active") == [0, 0, 1, 1, 0]


def switches(spark, packets, commands=()):
    kind = "stream_code string, event_id long, ms long, input_priority long"
    frame = failover.switch_history(spark.createDataFrame(packets, kind), overrides=spark.createDataFrame(list(commands), kind), timeout_ms=100, cooldown_ms=100, until_ms=1000)
    return [(r.ms, r.from_input, r.to_input, r.reason) for r in frame.orderBy(F.desc("place")).collect()]


def test_failover_in_a_silence(spark):
    rows = [("a", 1, 0, 0), ("a", 2, 50, 1), ("a", 3, 400, 1), ("a", 4, 420, 0)]
    assert switches(spark, rows) == [
        (0, -1, 0, "initial"), (101, 0, 1, "timeout"), (151, 1, -1, "exhausted"), (400, -1, 1, "recovery"), (500, 1, 0, "failback"), (521, 0, -1, "exhausted"),
    ]


def test_failover_obeys_healthy_overrides(spark):
    rows = [("a", k, 10 * k, k % 2) for k in range(40)]
    commands = [("a", 1, 105, 1), ("a", 2, 115, 7), ("b", 3, 5, 0)]
    assert switches(spark, rows, commands) == [(0, -1, 0, "initial"), (105, 0, 1, "manual"), (491, 1, -1, "exhausted")]
    back = switches(spark, rows, [*commands, ("a", 4, 300, None)])
    assert back[2:] == [(300, 1, 0, "failback"), (481, 0, 1, "timeout"), (491, 1, -1, "exhausted")]


def test_failover_on_errors_and_removed_inputs(spark):
    kind = "stream_code string, event_id long, ms long, input_priority long"
    rows = spark.createDataFrame([("a", k, 10 * k, k % 2) for k in range(20)], kind)
    told = spark.createDataFrame([("a", 1, 31, 0, "error"), ("a", 2, 165, 1, "remove"), ("a", 3, 166, 9, "error")], kind + ", kind string")
    history = failover.switch_history(rows, overrides=told, timeout_ms=100, cooldown_ms=1000, until_ms=1000)
    assert [(r.ms, r.from_input, r.to_input, r.reason) for r in history.orderBy(F.desc("place")).collect()] == [(0, -1, 0, "initial"), (31, 0, 1, "error"), (165, 1, 0, "input_removed"), (281, 0, 1, "timeout"), (291, 1, -1, "exhausted")]


def test_failover_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.failover import switch_stream

    start = 1_700_000_000_000
    rows = [("a", 1, 0, 0), ("a", 2, 50_000, 1), ("a", 3, 400_000, 1), ("a", 4, 420_000, 0), ("b", 5, 410_000, 2), ("a", 6, 2_000_000, 1), ("b", 7, 2_000_000, 2), ("b", 8, 4_000_000, 2), ("a", 9, 4_000_000, 0)]
    rows = [(code, k, start + ms, p) for code, k, ms, p in rows]
    frame = spark.createDataFrame(rows, "stream_code string, event_id long, ms long, input_priority long").withColumn("kind", F.lit("packet"))
    for k in range(3):  # a micro-batch each
        frame.where(f"event_id > {3 * k} AND event_id <= {3 * k + 3}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    got = []
    stream = switch_stream(source, 100_000, 100_000, "1 second")
    query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").foreachBatch(lambda batch, n: got.extend(map(tuple, batch.collect()))).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = failover.switch_history(frame, keep=99, timeout_ms=100_000, cooldown_ms=100_000).select("stream_code", "ms", "from_input", "to_input", "reason")
    told = {tuple(r) for r in batch.collect()}
    # What is due after the last watermark is still to come.
    assert set(got) == {t for t in told if t[1] <= start + 4_000_000} and len(got) == len(set(got)) > 6


@pytest.mark.parametrize("scan", [segmenters.span_scan(3_600_000), segmenters.keyframe_scan(3_600_000), segmenters.dash_scan(3_600_000, 5), segmenters.bitrate_scan()], ids="span keyframe dash bitrate".split())
def test_cuts_of_a_stream_are_those_of_a_batch(spark, tmp_path, scan):
    from tidemark.streaming.scans import scan_stream

    frame = views.logical(spark, DATA, "packets").where("stream_code IN ('stream_1', 'stream_2')").select("stream_code", "event_id", "ms", "pts_ms", "codec", "size", "key_frame", "discontinuity").cache()
    middle = frame.selectExpr("percentile_approx(ms, 0.5)").first()[0]
    for k, part in enumerate(("ms <= {0}", "ms > {0}")):  # a micro-batch each
        frame.where(part.format(middle)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = []
    stream = scan_stream(source, scan).writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint")
    stream.foreachBatch(lambda batch, n: got.extend(map(tuple, batch.collect()))).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got, key=str) == sorted(map(tuple, scan.over(frame).collect()), key=str) and len(got) == frame.count() > 50


def test_playlists(spark):
    text = "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:7\n#EXTINF:4.0,\nseg_8.ts\n#EXT-X-DISCONTINUITY\n#EXTINF:3.5,\nseg_9.ts\n"
    lines = readers.lines_of(spark.createDataFrame([("p", text)], "playlist string, text string"))
    rows = readers.media_playlist(lines).orderBy("sequence").collect()
    assert [(r.sequence, r.uri, r.duration, r.discontinuity) for r in rows] == [(7, "seg_8.ts", 4.0, False), (8, "seg_9.ts", 3.5, True)]
    master = "#EXTM3U\n#EXT-X-STREAM-INF:AVERAGE-BANDWIDTH=1,BANDWIDTH=900\na.m3u8\n"
    assert readers.variants(readers.lines_of(spark.createDataFrame([("m", master)], "playlist string, text string"))).collect()[0].bandwidth == 900


def test_retention_is_the_loop(spark):
    from tidemark.plans import catalog

    kept = {(r.stream_code, r.idx) for r in catalog.QUERIES["dvr_retention"](spark, DATA).collect()}
    streams = {}
    for r in views.logical(spark, DATA, "segments").orderBy("idx").collect():
        streams.setdefault(r.stream_code, []).append(r)
    for code, rows in streams.items():
        total = sum(r["size"] for r in rows)
        while len(rows) > 1 and (rows[0].ms < oracles.NOW - oracles.RETENTION or total > oracles.CAP_BYTES):
            total -= rows.pop(0)["size"]
        assert {i for c, i in kept if c == code} == {r.idx for r in rows}


def test_audio_goes_to_every_rendition(spark):
    from tidemark.plans import catalog

    audio = {}
    for r in views.logical(spark, DATA, "packets").where("codec = 'aac'").collect():
        audio.setdefault(r.stream_code, []).append(r.event_id)
    renditions = views.logical(spark, DATA, "renditions").collect()
    rows = catalog.QUERIES["fanout_audio"](spark, DATA).collect()
    want = [(e, r.stream_code, r.slug) for r in renditions for e in audio[f"stream_{int(r.stream_code[6:]) % 10}"]]
    assert len(renditions) == 200 and sorted((r.event_id, r.stream_code, r.slug) for r in rows) == sorted(want)


def test_audio_of_one_source_is_dealt_over_tasks(spark):
    size, n, m = signals.BLOCK, 5 * signals.BLOCK + 1, 2 * signals.BLOCK + 3
    heard = [(k, "a", "aac") for k in range(n)] + [(7, "a", "aac"), (None, "a", "aac"), (1, "a", "h264"), (2, "b", "aac"), (3, None, "aac")]
    rungs = [("x", f"track_{k}", "a") for k in range(m)] + [("x", "track_1", "a"), (None, None, "a"), ("y", "track_1", "c"), ("z", "track_1", None)]
    packets = spark.createDataFrame(heard, "event_id long, stream_code string, codec string").coalesce(1)
    renditions = spark.createDataFrame(rungs, "stream_code string, slug string, audio_code string").coalesce(1)
    found = signals.audio_fanout(packets, renditions)
    want = sorted(str((e, *r[:2])) for e, code, codec in heard for r in rungs if codec == "aac" and code == r[2] == "a")
    assert sorted(str(tuple(r)) for r in found.collect()) == want and len(want) == (n + 2) * (m + 2) > 10 * size * size
    held = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == len(want) and max(held) < len(want) / 2  # of four tasks


def test_audio_of_a_stream_goes_to_every_rendition(spark, tmp_path):
    packets, renditions = (views.logical(spark, DATA, name) for name in ("packets", "sourced_renditions"))
    packets.select("event_id", "stream_code", "codec").write.parquet(f"{tmp_path}/in")
    got = []
    stream = signals.audio_fanout(spark.readStream.schema("event_id long, stream_code string, codec string").parquet(f"{tmp_path}/in"), renditions)
    stream.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").foreachBatch(lambda batch, n: got.extend(map(tuple, batch.collect()))).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == sorted(map(tuple, signals.audio_fanout(packets, renditions).collect())) and len(got) > 1000


def test_full_hook_queue_drops_its_oldest(spark):
    pairs = spark.range(12_000).selectExpr("id * 3 AS id", "CASE WHEN id % 5 = 0 THEN 'few' ELSE 'many' END AS hook_id")
    for cap in (10_000, 7, 100, 1):
        own = {}
        for r in hooks.queued(pairs, cap).collect():
            own.setdefault(r.hook_id, []).append(r.id)
        for name, held in own.items():
            every = [3 * k for k in range(12_000) if (k % 5 == 0) == (name == "few")]
            assert sorted(held) == every[-cap:]


def test_hook_batches_are_whole_but_the_last(spark):
    pairs = spark.range(1000).selectExpr("id * 7 AS id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS hook_id")
    for size, ids in ((100, 1 << 16), (30, 50)):
        rows = hooks.batched(pairs, size, ids).collect()
        for name in "ab":
            every = [7 * k for k in range(1000) if (k % 3 == 0) == (name == "a")]
            want = [(k // size, len(every[k : k + size]), every[k]) for k in range(0, len(every), size)]
            assert sorted((r.batch, r.items, r.first_id) for r in rows if r.hook_id == name) == want


def test_playlists_as_text(spark):
    kind = "stream_code string, idx long, ms long, duration_ms long, size long, discontinuity boolean"
    segments = spark.createDataFrame([("a", 8, 1_700_000_000_000, 2000, 5, False), ("a", 9, 1_700_000_002_000, 2000, 5, True), ("a", 10, 1_700_000_004_000, 3999, 5, False), ("a", 7, 1_699_999_998_000, 2000, 5, False)], kind)
    live = playlists.live_playlists(segments, 3, 2).first().manifest
    assert live == "#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:4\n#EXT-X-MEDIA-SEQUENCE:7\n#EXTINF:2.000000,\nseg_000008.ts\n#EXT-X-DISCONTINUITY\n#EXTINF:2.000000,\nseg_000009.ts\n#EXTINF:3.999000,\nseg_000010.ts\n"
    ended = playlists.recording_playlists(segments.where("idx > 8"), ended=True).first().playlist
    assert ended == "#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:4\n#EXT-X-PLAYLIST-TYPE:VOD\n\n#EXT-X-DISCONTINUITY\n#EXT-X-PROGRAM-DATE-TIME:2023-11-14T22:13:22.000Z\n#EXTINF:2.000,\n000009.ts\n#EXTINF:3.999,\n000010.ts\n#EXT-X-ENDLIST\n"
    ladder = spark.createDataFrame([("a", "track_2", 1280, 720, 0), ("a", "track_1", 1920, 1080, 5000), ("a", "track_3", 0, 0, 100)], "stream_code string, slug string, width long, height long, kbps long")
    assert playlists.master_playlists(ladder).first().manifest == (
        '#EXTM3U\n#EXT-X-VERSION:3\n\n#EXT-X-STREAM-INF:BANDWIDTH=5000000,RESOLUTION=1920x1080,CODECS="avc1.640028"\ntrack_1/index.m3u8\n'
        '#EXT-X-STREAM-INF:BANDWIDTH=2500000,RESOLUTION=1280x720,CODECS="avc1.4d401f"\ntrack_2/index.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=100000,CODECS="avc1.42e01e"\ntrack_3/index.m3u8\n'
    )
    lines = readers.lines_of(playlists.recording_playlists(segments).select("stream_code", "playlist").toDF("playlist", "text"))
    assert [(r.idx, r.wall_ms, r.duration_ms, r.discontinuity) for r in readers.recording_playlist(lines).orderBy("idx").collect()] == [
        (7, 1_699_999_998_000, 2000, False), (8, 1_699_999_998_000, 2000, False), (9, 1_700_000_002_000, 2000, True), (10, 1_700_000_002_000, 3999, False),
    ]
    assert playlists.live_playlists(segments.limit(0), 3, 2).count() == 0


def test_dash_manifest_is_a_document(spark):
    import xml.etree.ElementTree as tree

    from tidemark.plans import catalog

    root = tree.fromstring(catalog.QUERIES["dash_mpd"](spark, DATA).first().mpd)
    name = "{urn:mpeg:dash:schema:mpd:2011}"
    kinds = [[r.get("id") for r in s] for s in root.iter(f"{name}AdaptationSet")]
    assert root.tag == f"{name}MPD" and kinds == [["v0", "v1"], ["a0"]] and len(list(root.iter(f"{name}S"))) == 3 * oracles.WINDOW
    assert [s.get("t") is not None for s in next(root.iter(f"{name}SegmentTimeline"))] == [True] + [False] * (oracles.WINDOW - 1)


def test_health_is_told_by_its_edges(spark):
    """Two profiles of one stream: told when the first fails and when the last one is well again."""
    rows = [(1, 0, 1), (2, 0, 1), (3, 0, 1), (4, 1, 1), (5, 1, 1), (6, 1, 1), (7, 0, 60), (8, 0, 1), (9, 1, 60), (10, 1, 99)]
    frame = spark.createDataFrame([("a", k, k, p, s) for k, p, s in rows], "stream_code string, event_id long, ms long, profile long, run_sec long")
    assert [(r.event_id, r.unhealthy) for r in signals.health_edges(frame, 30, 3).orderBy("event_id").collect()] == [(3, True), (9, False)]


def test_shapes_and_plans(spark):
    ladders = spark.createDataFrame([("abr", 3), ("one", 0)], "code string, rungs long")
    cases = {
        "self": (["copy://self"], "self copy"), "s2": (["copy://one", "rtmp://h"], "ok"), "s3": (["copy://abr"], "ok"), "s4": (["copy://abr", "rtmp://h"], "ladder not alone"), "s5": (["copy://gone", "rtmp://h"], "ok"),
        "s6": (["mixer://one,abr"], "ok"), "s7": (["mixer://one,abr", "rtmp://h"], "mixer not alone"), "s8": (["mixer://one,s8"], "self mix"),
    }
    inputs = spark.createDataFrame([(c, k, u) for c, (us, _) in cases.items() for k, u in enumerate(us)], "code string, pos long, url string")
    assert {r.code: r.verdict for r in configs.shape_verdicts(inputs, ladders).collect()} == {c: v for c, (_, v) in cases.items()}
    flags = configs.FLAGS
    asked = {1: ["special", "disabled"], 2: ["special"], 3: ["disabled", "inputs"], 4: ["topology", "dvr"], 5: ["profiles_updated"], 6: ["profiles_moved", "inputs", "push"], 7: ["dvr", "profiles_moved"], 8: []}
    want = {1: "stop", 2: "stop,start", 3: "stop", 4: "reload", 5: "profiles,master", 6: "profiles,inputs,hls and dash,protocols,dvr if moved", 7: "profiles,hls and dash,dvr", 8: ""}
    rows = spark.createDataFrame([(k, *[f in on for f in flags]) for k, on in asked.items()], "stream long, " + ", ".join(f"{f} boolean" for f in flags))
    assert {r.stream: r.actions for r in configs.update_plan(rows).collect()} == want


def test_differences_see_nulls(spark):
    old = spark.createDataFrame([(1, "x"), (2, None), (3, None), (4, "y")], "k long, url string")
    new = spark.createDataFrame([(1, None), (2, None), (3, "z"), (5, "y")], "k long, url string")
    assert {r.k: r.change for r in configs.difference(old, new, "k", "url").collect()} == {1: "updated", 3: "updated", 4: "removed", 5: "added"}
    assert configs.difference(old.limit(0), new.limit(0), "k", "url").count() == 0


def test_push_fails_for_good(spark):
    rows = [("a", k, k, e) for k, e in enumerate(["error", "discontinuity", "error", "error", "error", "discontinuity", "error"])]
    frame = spark.createDataFrame(rows, "stream_code string, event_id long, ms long, ended string")
    states = [(r.attempts, r.state) for r in signals.push_states(frame, 3).orderBy("event_id").collect()]
    assert states == [(1, "reconnecting"), (0, "starting"), (1, "reconnecting"), (2, "reconnecting"), (3, "failed"), (0, "failed"), (1, "failed")]
    assert {r.state for r in signals.push_states(frame, 0).collect()} == {"reconnecting", "starting"}


def test_ladders_and_tracks(spark):
    kind = "stream_code string, idx long, width long, height long, kbps long, codec string, video_copy boolean, audio_copy boolean, audio_codec string, audio_kbps long"
    rows = [("a", 1, 640, 360, 0, "h264", False, False, "aac", 96), ("a", 0, 1280, 720, 3000, "copy", False, False, "aac", 96), ("b", 0, 1, 1, 1, "h264", True, False, "", 0), ("b", 1, 1, 1, 1, "h264", True, False, "", 0), ("c", 0, 1, 1, 1, "h264", True, True, "", 64)]
    profiles = spark.createDataFrame(rows, kind)
    assert sorted((r.stream_code, r.slug, r.width, r.kbps) for r in media.ladder(profiles).collect()) == [("a", "track_1", 1280, 3000), ("a", "track_2", 640, 2500), ("b", "track_1", 0, 0)]
    tracks = sorted((r.stream_code, r.place, r.kind, r.codec, r.kbps) for r in media.output_tracks(profiles).collect())
    assert tracks == [("a", 0, "audio", "aac", 96), ("a", 1, "video", "copy", 3000), ("a", 2, "video", "h264", 0), ("b", 1, "video", "copy", 1), ("b", 2, "video", "copy", 1), ("c", 0, "audio", "copy", 64), ("c", 1, "video", "copy", 1)]
    matrix = {(r.codec, r.accelerator): r.encoder for r in media.encoder_matrix(spark).collect()}
    assert len(matrix) == 20 and matrix["h265", "nvenc"] == "hevc_nvenc" and matrix["h264", "vaapi"] == "libx264" and matrix["av1", "qsv"] == "libsvtav1"


def test_polls_deliver_what_is_new(spark):
    rows = [("a", 0, s) for s in (1, 2, 3)] + [("a", 1, s) for s in (2, 3, 4)] + [("a", 2, s) for s in (1, 2)] + [("a", 3, s) for s in (4, 5)] + [("b", 1, 1)]
    found = urls.unseen(spark.createDataFrame(rows, "stream_code string, poll long, sequence long")).collect()
    assert sorted((r.stream_code, r.poll, r.sequence) for r in found) == [("a", 0, 1), ("a", 0, 2), ("a", 0, 3), ("a", 1, 4), ("a", 3, 5), ("b", 1, 1)]


def test_ties_of_time_go_by_id(spark):
    hits = spark.createDataFrame([(1, 2, 0, 5, "b", "s", "i"), (1, 1, 0, 0, "a", "s", "i"), (1, 3, None, 7, "c", "s", "i")], "user_id long, event_id long, ms long, bytes long, proto string, stream_code string, ip string")
    row = play.rolled_up(hits.where("ms IS NOT NULL"), 10, 100).first()
    assert (row.proto, row.hits, row.bytes, row.started_ms, row.closed) == ("a", 2, 5, 0, True)
    assert play.rolled_up(hits, 10, 100).count() == 1 and play.rolled_up(hits.limit(0), 10, 100).count() == 0
    samples = spark.createDataFrame([("m", 1, 0, 5), ("m", 2, 0, 9), ("m", 3, 4, 7), ("m", 4, 4, 6)], "metric string, event_id long, ms long, v long")
    assert (signals.counter_deltas(samples).first().delta, signals.nearest_ranks(samples).first().median, signals.nearest_ranks(samples).first().p95) == (1, 6, 7)


def test_functions(spark):
    row = spark.range(1).select(
        functions.fingerprint(F.lit("s"), F.lit(" A "), F.lit("u"), F.lit("")).alias("a"), functions.fingerprint(F.lit("s"), F.lit("a"), F.lit("u "), F.lit(None)).alias("b"),
        functions.backoff(F.lit(10)).alias("cap"), functions.backoff(F.lit(1)).alias("first"),
        functions.event_passes(F.lit("x"), F.lit("s"), F.array().cast("array<string>"), F.array(F.lit("s")), F.array(F.lit("s"))).alias("only"),
    ).first()
    assert row.a == row.b and len(row.a) == 16 and (row.cap, row.first, row.only) == (30.0, 2.0, True)


def test_signed_sink(spark):
    assert [len(b) for b in sinks.batches(iter(range(250)))] == [100, 100, 50]
    # A known value of HMAC-SHA256.
    assert sinks.signature("key", b"The quick brown fox jumps over the lazy dog") == "sha256=f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"
    assert sinks.headers_of(b"[]", 3, "") == {"Content-Type": "application/json", "X-Batch-Size": "3"} and "X-Signature" in sinks.headers_of(b"[]", 3, "k")
    slept, tried = [], []

    class Part:
        @staticmethod
        def foreachPartition(send):
            send(iter([type("Row", (), {"asDict": lambda self, recursive: {"id": 1}})()]))

    with pytest.raises(RuntimeError, match="not taken"):
        sinks.signed_sink(lambda body, headers: tried.append(body) or 500, "k", retries=9, sleep=slept.append)(Part, 0)
    assert slept == [1, 5, 30] and tried == [b'[{"id":1}]'] * 4
    with pytest.raises(Exception, match="not taken"):
        sinks.signed_sink(lambda body, headers: 500, "k", retries=0)(spark.range(3), 0)


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(u, start + timedelta(minutes=m), 10) for u in (1, 2) for m in (0, 5, 400 * u, 900, 5000)]
    frame = spark.createDataFrame(rows, "user_id long, ts timestamp, bytes long")
    frame.write.parquet(f"{tmp_path}/in")
    stream = sessions.session_stream(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"))
    got = []
    sessions.deliver(stream, lambda batch, n: got.extend(batch.collect()), f"{tmp_path}/checkpoint").awaitTermination()
    batch = sessions.session_stream(frame).collect()
    closed = lambda found: sorted((r.user_id, r.opened, r.updated, r.hits, r.bytes) for r in found if r.updated < start + timedelta(minutes=4000))
    assert closed(got) == closed(batch) and closed(batch)
