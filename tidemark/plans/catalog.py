"""All queries by name, with the SQL that states the same result where there is one.

A query is operators of ``tidemark.operators`` over logical inputs (``tidemark.sources.views``); what it must
return is written by itself in ``oracles``, and for cases of few rows as the expected rows in ``cases``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clients, configs, failover, hooks, media, playlists, segmenters, sessions, signals, urls
from ..sources import readers, views
from . import cases, dialect
from . import oracles as said

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COL = F.col
LONG_CUT, TARGET_SEC = 6 * 3_600_000, 2


def _query(*inputs: str):
    """Register a function over logical inputs under its name."""

    def add(function):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(*[views.logical(spark, sf_dir, name) for name in inputs])

        query.__name__, query.__doc__ = function.__name__, function.__doc__
        QUERIES[function.__name__] = query
        return function

    return add


def _simple(name: str, inputs: str, function) -> None:
    if name != function.__name__:
        shared = function
        function = lambda *frames: shared(*frames)
        function.__name__ = name
    _query(*inputs.split())(function)


# Addresses and viewers -----------------------------------------------------------------------------------

_simple("url_kind", "source_urls", lambda u: u.select("id", urls.kind(COL("url")).alias("kind")))
_simple("is_push_listen", "source_urls", lambda u: u.select("id", urls.listens(COL("url")).alias("listens")))
_simple("classify_source", "source_urls", lambda u: u.select("id", urls.reader(COL("url")).alias("reader")))
_simple("copy_mixer_grammar", "source_urls", lambda u: urls.upstreams(u).select("id", "kind", "first_code", "second_code", "reason", "goes_on"))
_simple("dedup_by_sequence", "polls", urls.unseen)
_simple("push_registry", "stream_inputs", lambda i: urls.holders(i.select(COL("url").alias("push_key"), "id")))
_simple("vod_listing", "files", lambda f: urls.listing(f).select("mount", "name", "is_dir", "place"))
_simple("copied_stream", "packets", lambda p: p.where("stream_code = 'stream_3'").select("event_id", "ms", F.lit("copy_of_3").alias("stream_code")))


def _key(token=None):
    return clients.fingerprint(COL("stream_code"), COL("ip"), COL("user_agent"), COL("token") if token is None else token)


_simple("fingerprint", "hits", lambda h: h.select("event_id", _key().alias("session_key")))
_simple("session_label", "hits", lambda h: h.select("stream_code", "ip", "user_agent", clients.label(_key()).alias("label")).distinct())
_simple("client_ip", "headers", lambda h: h.select("event_id", clients.client_address(COL("forwarded"), COL("real_ip"), COL("remote")).alias("client")))


@_query("hits")
def session_user(hits):
    token = F.when(COL("event_id") % 4 == 0, F.concat(F.lit("tok-"), "user_agent")).otherwise("")
    return hits.select("event_id", *[c.alias(name) for name, c in clients.named(token, _key(token)).items()])


@_query("source_urls")
def proto_from_path(rows):
    path = urls.parts(COL("url"))["path"]
    return rows.select("id", urls.media_proto(path).alias("proto"), urls.path_code(path).alias("stream_code"))


@_query("hits")
def geo(hits):
    ranges = hits.sparkSession.createDataFrame([(0, 49, "AA"), (50, 99, "BB")], "low long, high long, country string")
    return clients.country(hits, F.broadcast(ranges), "user_id").select("event_id", "country")


_simple("credited_bytes", "hits", lambda h: h.select("event_id", clients.credited(COL("http_status"), COL("bytes")).alias("credited")))

# Sessions ------------------------------------------------------------------------------------------------


def _sessions(hits: DataFrame) -> DataFrame:
    return sessions.rolled_up(hits, said.IDLE, said.NOW)


_simple("sessionize", "hits", lambda h: sessions.numbered(h, said.IDLE).select("event_id", "user_id", "session"))
_simple("session_rollup", "hits", _sessions)
_simple("sessions_by_reason", "hits", lambda h: sessions.by_reason(_sessions(h)))
_simple("sessions_filter", "hits", lambda h: sessions.chosen(_sessions(h), "stream_3", "hls", "closed").select("user_id", "session"))
_simple("sessions_topn", "hits", lambda h: sessions.newest_first(_sessions(h), 50).select("user_id", "session", "opened_ms"))
_simple("session_max_life", "hits", lambda h: segmenters.bounded_sessions(h, said.IDLE, 2 * 86_400_000))


@_query("hits")
def session_stats(hits):
    rows = _sessions(hits)
    return sessions.stats(rows, rows.where("user_id % 10 = 3 AND session = 0"))


# Packets, runs, samples ----------------------------------------------------------------------------------

_simple("drop_empty", "packets", lambda p: p.where("size > 0").select("event_id", "stream_code", "size"))
_simple("ingest_counters", "packets", signals.counters)
_simple("bitrate_total", "packets", signals.total_bitrates)
_simple("bitrate_windows", "packets", lambda p: signals.window_bitrates(p, 3000))
_simple("bitrate_ewma", "packets", segmenters.smoothed_bitrate)
_simple("dvr_gaps", "packets", lambda p: signals.gaps(p, said.GAP))
_simple("mark_discontinuity", "packets", lambda p: signals.reconnects(p, said.GAP))
_simple("dts_regressions", "clock_packets", signals.sources_apart)
_simple("sample_durations", "frames", lambda f: signals.sample_durations(f, 3600).select("stream_code", "event_id", "dur"))
_simple("from_first_keyframe", "packets", lambda p: signals.from_first_keyframe(p).select("stream_code", "event_id"))
_simple("dvr_segments", "packets", lambda p: segmenters.span_segments(p, LONG_CUT))
_simple("hls_segments", "packets", lambda p: segmenters.keyframe_segments(p, LONG_CUT))
_simple("dash_segments", "packets", lambda p: segmenters.dash_segments(p, LONG_CUT, 20))
_simple("mix_streams", "packets", lambda p: signals.mixed(p, "stream_1", "stream_2"))
_simple("fanout_audio", "packets sourced_renditions", signals.audio_fanout)
_simple("failover", "packets", lambda p: failover.timeline(p, until_ms=said.NOW))
_simple("switch_history", "packets", lambda p: failover.switch_history(p, until_ms=said.NOW))
_simple("classify_error", "messages", lambda m: m.select("event_id", signals.verdict(COL("message")).alias("verdict")))
_simple("recent_errors", "runs", lambda r: signals.newest(r, 5).select("stream_code", "event_id", "place"))
_simple("stderr_tail", "runs", lambda r: signals.tails(r, 8))
_simple("error_suppression", "runs", lambda r: signals.shown_errors(r).select("stream_code", "event_id", "attempt", "same", "visible"))
_simple("crash_streak", "runs", lambda r: signals.crash_streaks(r, said.FAST_RUN_SEC, said.CRASHES).select("stream_code", "event_id", "streak", "unhealthy"))
_simple("health_edges", "profile_runs", lambda r: signals.health_edges(r, said.FAST_RUN_SEC, said.CRASHES))
_simple("push_states", "push_sessions", lambda s: signals.push_states(s, 8).select("stream_code", "event_id", "attempts", "state", "number"))
_simple("bench_stats", "whole_samples", signals.nearest_ranks)
_simple("counter_delta", "whole_samples", signals.counter_deltas)
_simple("net_rate", "totals", signals.rates)
_simple("cpu_delta", "hits", lambda h: signals.process_deltas(h, "user_id", "bytes"))
_simple("runtime_counts", "snapshots", signals.runtime_counts)
_simple("phase_report", "bench_runs", signals.phase_report)


@_query("runs")
def backoff(runs):
    from ..functions import backoff as wait

    attempt = F.row_number().over(signals.by_time()).cast("long")
    return runs.withColumn("attempt", attempt).select("stream_code", "event_id", "attempt", wait(COL("attempt")).alias("wait_sec"))


@_query("packets")
def stale_inputs(packets):
    newest = packets.groupBy("stream_code").agg(F.max("ms").alias("now_ms"))
    return configs.input_states(packets.join(newest, "stream_code"), said.STALE)


# Ladders and tracks --------------------------------------------------------------------------------------

_simple("codec_class", "packets", lambda p: p.groupBy("stream_code", "codec").count().select("stream_code", media.codec_class(COL("codec")).alias("class"), media.codec_label(COL("codec")).alias("label"), COL("count").alias("packets")))
_simple("renditions_default", "profiles", lambda p: media.ladder(p).withColumn("bandwidth", media.bandwidth(COL("kbps"))))
_simple("output_tracks", "profiles", media.output_tracks)
_simple("codec_string", "renditions", lambda r: r.select("stream_code", "idx", media.codec_string(COL("width"), COL("height")).alias("codecs")))
_simple("gop_frames", "profiles", lambda p: p.select("stream_code", "idx", media.gop_frames(COL("gop"), COL("step"), COL("rate"), COL("fps")).alias("frames")))
_simple("frame_scale", "renditions", media.frame_scales)
_simple("best_rendition", "renditions", lambda r: media.best_renditions(r, COL("width") * COL("height") * 1000 + COL("kbps")))
_simple("best_variant", "renditions", lambda r: media.best_renditions(r, COL("kbps"), last=True).select("stream_code", "idx"))
_simple("best_known", "renditions known_renditions", lambda r, k: signals.overridden(r, k, ["stream_code", "slug"], "kbps").select("stream_code", "slug", "kbps"))
_simple("track_order", "packets", media.track_places)
_simple("worker_count", "renditions", lambda r: r.groupBy("stream_code").agg(F.count(F.lit(1)).alias("workers")))
_simple("earliest_available", "availability", playlists.earliest)


@_query("profiles")
def encoders(profiles):
    accelerator = F.when(COL("idx") % 2 == 0, "nvenc").otherwise("none")
    return profiles.select("stream_code", "idx", media.video_encoder(COL("codec"), accelerator).alias("encoder"), accelerator.alias("accelerator"))


@_query("renditions")
def abr_copy(renditions):
    ids = [F.concat(F.lit(f"$r${mark}"), "stream_code", F.lit("$"), "slug").alias(name) for mark, name in (("", "from_id"), ("copy-", "to_id"))]
    return renditions.select("idx", *ids)


# Segments and playlists ----------------------------------------------------------------------------------


def _kept(segments: DataFrame) -> DataFrame:
    return playlists.kept(segments, said.NOW, said.RETENTION, said.CAP_BYTES)


_simple("live_window", "segments", lambda s: playlists.tail(s, said.WINDOW).select("stream_code", "idx", "ms"))
_simple("disk_trim", "segments", lambda s: playlists.beyond(s, 2 * said.WINDOW).select("stream_code", "idx"))
_simple("dvr_index", "segments", playlists.index)
_simple("target_duration", "segments", lambda s: playlists.target_durations(s, TARGET_SEC))
_simple("hls_manifest", "segments", lambda s: playlists.live_playlists(s, said.WINDOW, TARGET_SEC))
_simple("hls_master", "renditions", playlists.master_playlists)
_simple("dvr_playlist", "segments", lambda s: playlists.recording_playlists(_kept(s)))
_simple("dash_timeline", "segments", playlists.dash_timeline)
_simple("decode_timeline", "segments", playlists.decode_times)
_simple("pdt_tags", "segments", playlists.dated)
_simple("timeshift", "segments", lambda s: playlists.overlapping(s, said.NOW - 10 * 86_400_000, said.NOW - 9 * 86_400_000).select("stream_code", "idx", "ms", "duration_ms"))
_simple("dvr_retention", "segments", lambda s: _kept(s).select("stream_code", "idx", "ms", "size"))
_simple("dvr_gap_prune", "segments packets", lambda s, p: playlists.gaps_kept(signals.gaps(p, said.GAP), _kept(s)))
_simple("parse_media_playlist", "segments", lambda s: readers.media_playlist(readers.lines_of(playlists.live_playlists(s, said.WINDOW, TARGET_SEC).toDF("playlist", "text"))))
_simple("parse_master_playlist", "renditions", lambda r: readers.variants(readers.lines_of(playlists.master_playlists(r).toDF("playlist", "text"))))
_simple("parse_recording_playlist", "segments", lambda s: readers.recording_playlist(readers.lines_of(playlists.recording_playlists(_kept(s)).select("stream_code", "playlist").toDF("playlist", "text"))))


@_query("segments")
def dash_mpd(segments):
    spark = segments.sparkSession
    kinds = [("track_1", "video", "avc1.640028", 5_000_000, 1920, 1080, 90_000), ("track_2", "video", "avc1.4d401f", 2_500_000, 1280, 720, 90_000), ("track_1", "audio", "mp4a.40.2", 128_000, 0, 0, 48_000)]
    tracks = F.broadcast(spark.createDataFrame(kinds, "slug string, kind string, codec string, bandwidth long, width long, height long, timescale long"))
    available = 1_704_067_200_000
    rows = segments.crossJoin(tracks.select("slug", "kind"))  # three rows
    known = segments.select("stream_code").distinct().crossJoin(tracks).withColumn("avail_ms", F.lit(available).cast("long"))
    return playlists.dash_manifests(rows, known, said.WINDOW, TARGET_SEC, "2024-02-01T00:00:00Z")


# Configurations ------------------------------------------------------------------------------------------

_simple("valid_codes", "streams", lambda s: s.select("title", configs.code_problem(COL("title")).alias("problem")))
_simple("stream_status", "streams hits", lambda s, h: configs.status(s, configs.running(h)))
_simple("streams_by_status", "streams hits", lambda s, h: configs.status(s, configs.running(h)).where("status = 'degraded'").select("code", "status"))
_simple("stream_rollup", "stream_inputs", lambda i: configs.rolled_up(i.withColumn("crashing", COL("id") % 9 == 0)))
_simple("diff_inputs", "config_old config_new", lambda o, n: configs.difference(o, n, "k", "url"))
_simple("added_removed", "config_old config_new", lambda o, n: configs.difference(o, n, "k", "k"))
_simple("diff_stream", "config_old config_new", configs.stream_difference)
_simple("reconcile", "config_old config_new", lambda o, n: configs.reconciled(o, n, "k", "url", COL("k") % 6 != 5))
_simple("update_plan", "updates", configs.update_plan)
_simple("service_diff", "services_old services_new", configs.service_difference)
_simple("validate_shape", "shapes ladders", configs.shape_verdicts)
_simple("dup_inputs", "shapes", configs.duplicate_inputs)
_simple("priority_position", "shapes", configs.misplaced_inputs)
_simple("bootable", "streams stream_inputs", configs.bootable)
_simple("config_errors", "configured_streams shapes config_hooks mounts", configs.config_errors)
_simple("select_best_input", "stream_inputs", lambda i: configs.best_inputs(i.withColumn("override", F.lit(2))))
_simple("recordings_of", "recordings", lambda r: configs.recordings_of(r, "stream_4").select("id", "status"))


@_query("config_old", "config_new")
def diff_profiles(old, new):
    touched = old.select("stream").union(new.select("stream")).distinct().where("stream % 4 = 0")
    return configs.profile_difference(configs.positioned(old), configs.positioned(new), touched)


@_query("streams")
def streams_by_code(streams):
    """Place of each stream by code; streams are configuration, so one task orders them."""
    from pyspark.sql import Window

    return streams.select("code", F.row_number().over(Window.orderBy("code")).cast("long").alias("place"))


@_query("stream_inputs")
def media_summary(inputs):
    tracks = inputs.select(COL("id").alias("input_id"), (COL("id") % 100).alias("kbps")).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(3))))
    outputs = inputs.where("code LIKE '%1'").select("code").distinct().withColumn("kbps", F.explode(F.array(F.lit(1000).cast("long"), F.lit(1000).cast("long"))))
    return configs.media_summaries(inputs, tracks, outputs)


# Hooks ---------------------------------------------------------------------------------------------------

_simple("hook_dispatch", "domain_events hooks", hooks.dispatched)
_simple("hook_match", "domain_events hooks", lambda e, h: hooks.matched(hooks.dispatched(e, h)))
_simple("hook_queue", "domain_events hooks", lambda e, h: hooks.queued(hooks.dispatched(e, h), said.QUEUE))
_simple("hook_batches", "domain_events hooks", lambda e, h: hooks.batched(hooks.dispatched(e, h), said.BATCH))
_simple("events_jsonl", "domain_events", lambda e: e.select("id", hooks.json_line("id", "type", "stream_code", "ms").alias("line")))


@_query("domain_events")
def with_metadata(events):
    merged = hooks.with_metadata(COL("payload"), F.create_map(F.lit("region"), F.lit("eu"), F.lit("k"), F.lit("7")))
    return events.select("id", F.explode(merged).alias("key", "value"))


@_query("hooks")
def merge_defaults(held):
    rows = held.sparkSession.range(20)
    own = {c: F.lit(0).cast("long") for c in hooks.DEFAULTS} | {"batch_max_items": COL("id") % 3, "max_retries": COL("id") % 4 - 1}
    common = {"batch_max_items": 50}
    set_, unset = (hooks.settings(rows.where(f"id % 2 = {k}").withColumns(own), c).select("id", "batch_max_items", "max_retries") for k, c in ((1, common), (0, {})))
    return set_.unionByName(unset)


for _name, (_views, _body) in said.ALL.items():
    ORACLES[_name] = views.with_views(dialect.Duck, _views, _body(dialect.Duck))
for _name, _case in cases.CASES.items():
    QUERIES[_name] = _case.query
    ORACLES[_name] = _case.oracle
