"""What the queries must return, said a second time in SQL for DuckDB: name -> (logical inputs, statement).

Nothing here is run by Spark: the queries are made of the DataFrame operators, and these statements are
written by themselves from the same rules. Ordering ties end with an id and "now" is a constant.
"""

from __future__ import annotations

#: Settings of the queries (milliseconds unless named otherwise), chosen for the stored tables.
IDLE = 21_600_000
SEGMENT = 600_000
GAP = 2 * SEGMENT
NOW = 1_706_600_000_000
RETENTION = 15 * 86_400_000
CAP_BYTES = 20_000_000
WINDOW = 5
BATCH = 100
QUEUE = 10_000
STALE = 30_000
FAST_RUN_SEC = 30
CRASHES = 3

ALL: dict = {}


def _op(*views):
    def add(function):
        ALL[function.__name__] = (views, function)
        return function

    return add


def _long(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


# Sources -------------------------------------------------------------------------------------------------


# Projections, filters ------------------------------------------------------------------------------------


@_op("hits")
def fingerprint(d):
    return f"""SELECT event_id, substr({d.sha("stream_code || chr(0) || lower(trim(ip)) || chr(0) || trim(user_agent) || chr(0) || trim(token)")}, 1, 16) AS session_key FROM hits"""


@_op("hits")
def session_label(d):
    return f"""SELECT DISTINCT stream_code, ip, user_agent, substr({d.sha("stream_code || chr(0) || lower(trim(ip)) || chr(0) || trim(user_agent) || chr(0) || trim(token)")}, 1, 8) AS label FROM hits"""


@_op("hits")
def credited_bytes(d):
    return f"SELECT event_id, {_long('CASE WHEN http_status BETWEEN 200 AND 299 THEN bytes ELSE 0 END')} AS credited FROM hits"


@_op("packets")
def drop_empty(d):
    return "SELECT event_id, stream_code, size FROM packets WHERE size > 0"


@_op("renditions")
def frame_scale(d):
    return f"SELECT stream_code, idx, CAST(width AS DOUBLE) / max(width) OVER (PARTITION BY stream_code) AS scale FROM renditions"


@_op("runs")
def backoff(d):
    """2 s doubled by each attempt, 30 s at most."""
    return f"""SELECT stream_code, event_id, attempt, least(30.0, 2.0 * power(2.0, least(attempt - 1, 10))) AS wait_sec
      FROM (SELECT stream_code, event_id, {_long('row_number() OVER (PARTITION BY stream_code ORDER BY ms, event_id)')} AS attempt FROM runs) r"""


# Joins ---------------------------------------------------------------------------------------------------


@_op("streams", "hits")
def stream_status(d):
    """Configuration with what is running, left by code."""
    return f"""SELECT s.code, s.disabled, coalesce(r.viewers, {_long('0')}) AS viewers, CASE WHEN s.disabled THEN 'stopped' WHEN r.code IS NULL THEN 'idle' WHEN r.errors > 0 THEN 'degraded' ELSE 'active' END AS status
      FROM streams s LEFT JOIN (SELECT stream_code AS code, count(DISTINCT user_id) AS viewers, {_long("sum(CASE WHEN http_status >= 500 THEN 1 ELSE 0 END)")} AS errors FROM hits GROUP BY stream_code) r ON s.code = r.code"""


@_op("streams", "hits")
def streams_by_status(d):
    return f"SELECT code, status FROM ({stream_status(d)}) x WHERE status = 'degraded'"


@_op("domain_events", "hooks")
def hook_dispatch(d):
    """Each event goes to every enabled hook whose type list and stream filter let it pass; "only" wins."""
    return f"""SELECT e.id, h.hook_id FROM domain_events e JOIN hooks h ON h.enabled AND ({d.size('h.event_types')} = 0 OR array_contains(h.event_types, e.type))
      AND CASE WHEN {d.size('h.only_streams')} > 0 THEN array_contains(h.only_streams, e.stream_code) ELSE NOT array_contains(h.except_streams, e.stream_code) END"""


@_op("domain_events", "hooks")
def hook_match(d):
    return f"SELECT hook_id, count(*) AS events FROM ({hook_dispatch(d)}) m GROUP BY hook_id"


@_op("config_old", "config_new")
def reconcile(d):
    return "SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL THEN 'delete' WHEN o.k IS NULL THEN CASE WHEN n.k % 6 = 5 THEN 'store' ELSE 'start' END WHEN o.url = n.url THEN 'keep' ELSE 'update' END AS action FROM config_old o FULL OUTER JOIN config_new n ON o.k = n.k"


@_op("segments")
def timeshift(d):
    """Segments that overlap a window; one that starts exactly at its end is kept."""
    start, end = NOW - 10 * 86_400_000, NOW - 9 * 86_400_000
    return f"SELECT stream_code, idx, ms, duration_ms FROM segments WHERE ms + duration_ms > {start} AND ms <= {end}"


@_op("config_old", "config_new")
def added_removed(d):
    return "SELECT k, 'added' AS change FROM config_new n WHERE NOT EXISTS (SELECT 1 FROM config_old o WHERE o.k = n.k) UNION ALL SELECT k, 'removed' FROM config_old o WHERE NOT EXISTS (SELECT 1 FROM config_new n WHERE n.k = o.k)"


@_op("streams", "stream_inputs")
def bootable(d):
    return "SELECT s.code FROM streams s WHERE NOT s.disabled AND EXISTS (SELECT 1 FROM stream_inputs i WHERE i.code = s.code)"


# Aggregations --------------------------------------------------------------------------------------------


def _sessions(d) -> str:
    return f""", marked AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) > {IDLE} THEN 1 ELSE 0 END AS fresh FROM hits),
      numbered AS (SELECT *, {_long('sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id)')} AS session FROM marked),
      sessions AS (SELECT user_id, session, count(*) AS hits, {_long('sum(bytes)')} AS bytes, min(ms) AS opened_ms, max(ms) AS updated_ms, min(CASE WHEN bytes > 0 THEN ms END) AS started_ms,
        min_by(proto, (ms, event_id)) AS proto, min_by(stream_code, (ms, event_id)) AS stream_code, min_by(ip, (ms, event_id)) AS ip FROM numbered GROUP BY user_id, session),
      closed AS (SELECT *, updated_ms < {NOW} - {IDLE} AS closed, {d.div('greatest(updated_ms - opened_ms, 0)', '1000')} AS duration_sec FROM sessions)"""


@_op("hits")
def sessionize(d):
    """A silence longer than the idle time closes a session; one of exactly that length does not."""
    return f"{_sessions(d)} SELECT event_id, user_id, session FROM numbered"


@_op("hits")
def session_rollup(d):
    return f"{_sessions(d)} SELECT user_id, session, hits, bytes, opened_ms, updated_ms, started_ms, proto, stream_code, ip, duration_sec, closed FROM closed"


@_op("hits")
def sessions_by_reason(d):
    return f"{_sessions(d)} SELECT stream_code, proto, CASE WHEN closed THEN 'idle' ELSE 'open' END AS reason, count(*) AS sessions FROM closed GROUP BY stream_code, proto, closed"


@_op("hits")
def sessions_filter(d):
    return f"{_sessions(d)} SELECT user_id, session FROM closed WHERE stream_code = 'stream_3' AND proto = 'hls' AND closed"


@_op("hits")
def sessions_topn(d):
    return f"{_sessions(d)} SELECT user_id, session, opened_ms FROM closed ORDER BY opened_ms, user_id, session LIMIT 50"


@_op("packets")
def ingest_counters(d):
    return f"SELECT stream_code, count(*) AS packets, {_long('sum(size)')} AS bytes, {_long('sum(CASE WHEN discontinuity THEN 1 ELSE 0 END)')} AS errors FROM packets GROUP BY stream_code"


@_op("packets")
def bitrate_total(d):
    """Rates of codecs over the time seen, in kbps, rounded half up after they are added."""
    return f"""SELECT stream_code, {_long('floor(sum(bits) / greatest(max(span), 1) + 0.5)')} AS kbps FROM (
      SELECT stream_code, codec, CAST(sum(size) * 8 AS DOUBLE) AS bits, CAST(max(ms) - min(ms) AS DOUBLE) AS span FROM packets GROUP BY stream_code, codec) c GROUP BY stream_code"""


@_op("segments")
def dvr_index(d):
    return f"SELECT stream_code, count(*) AS segments, {_long('sum(size)')} AS bytes, max(ms) AS last_ms FROM segments GROUP BY stream_code"


@_op("samples")
def bench_stats(d):
    """Nearest ranks: the value at (n + 1) / 2 and at 0.95 n, cut to whole places, the first at least."""
    v = f"{_long('floor(value * 1000)')}"
    return f"""SELECT metric, count(*) AS n, CAST(sum({v}) AS DOUBLE) / count(*) AS average, {d.ith(v, d.div('count(*) + 1', '2'))} AS median, {d.ith(v, 'greatest(1, floor(count(*) * 0.95))')} AS p95, max({v}) AS highest
      FROM samples GROUP BY metric"""


@_op("hits")
def cpu_delta(d):
    """Successive samples of one process."""
    return "SELECT user_id, event_id, bytes - before AS delta FROM (SELECT user_id, event_id, bytes, lag(bytes) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS before FROM hits) h WHERE before IS NOT NULL"


@_op("renditions")
def worker_count(d):
    return "SELECT stream_code, count(*) AS workers FROM renditions GROUP BY stream_code"


# Windows and sequences -----------------------------------------------------------------------------------


@_op("packets")
def dvr_gaps(d):
    """A gap runs from the timer's end, two segments after the last packet, to the next packet."""
    return f"SELECT stream_code, before + {GAP} AS from_ms, ms AS to_ms, ms - before - {GAP} AS gap_ms FROM (SELECT stream_code, ms, lag(ms) OVER (PARTITION BY stream_code ORDER BY ms, event_id) AS before FROM packets) p WHERE ms - before > {GAP}"


@_op("segments")
def live_window(d):
    return f"SELECT stream_code, idx, ms FROM (SELECT *, row_number() OVER (PARTITION BY stream_code ORDER BY idx DESC) AS back FROM segments) s WHERE back <= {WINDOW}"


@_op("packets")
def bitrate_windows(d):
    """Rates of fixed three-second windows, in whole bits."""
    w = d.div("ms", "3000")
    return f"SELECT stream_code, codec, {w} AS slot, {d.div(_long('sum(size) * 8'), '3')} AS bps FROM packets GROUP BY stream_code, codec, {w}"


@_op("runs")
def recent_errors(d):
    return f"SELECT stream_code, event_id, place FROM (SELECT stream_code, event_id, {_long('row_number() OVER (PARTITION BY stream_code ORDER BY ms DESC, event_id DESC)')} AS place FROM runs) r WHERE place <= 5"


@_op("runs")
def stderr_tail(d):
    return f"""SELECT stream_code, {d.agg('message', "' | '", 'ms, event_id')} AS tail FROM (SELECT *, row_number() OVER (PARTITION BY stream_code ORDER BY ms DESC, event_id DESC) AS back FROM runs) r WHERE back <= 8 GROUP BY stream_code"""


@_op("packets")
def mark_discontinuity(d):
    """The first packet after each reconnect; a silence longer than the gap is one."""
    return f"SELECT stream_code, event_id FROM (SELECT *, lag(ms) OVER (PARTITION BY stream_code ORDER BY ms, event_id) AS before FROM packets) p WHERE before IS NULL OR ms - before > {GAP}"


@_op("segments")
def dash_timeline(d):
    """The time is told for the first entry of a stream only; entries without length are left out."""
    return f"SELECT stream_code, idx, CASE WHEN k = 1 THEN t END AS t, dur FROM (SELECT stream_code, idx, ms * 90 AS t, duration_ms * 90 AS dur, row_number() OVER (PARTITION BY stream_code ORDER BY idx) AS k FROM segments WHERE duration_ms > 0) s"


@_op("segments")
def decode_timeline(d):
    return f"SELECT stream_code, idx, {_long('coalesce(sum(duration_ms) OVER (PARTITION BY stream_code ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} * 90 AS decode_time FROM segments"


@_op("packets")
def from_first_keyframe(d):
    return "SELECT stream_code, event_id FROM (SELECT *, max(CASE WHEN key_frame THEN 1 ELSE 0 END) OVER (PARTITION BY stream_code ORDER BY ms, event_id) AS begun FROM packets) p WHERE begun = 1"


@_op("segments")
def pdt_tags(d):
    return "SELECT stream_code, idx FROM (SELECT *, row_number() OVER (PARTITION BY stream_code ORDER BY idx) AS k FROM segments) s WHERE k = 1 OR discontinuity"


# Top-k, retention ----------------------------------------------------------------------------------------


@_op("renditions")
def best_rendition(d):
    return "SELECT stream_code, idx, slug FROM (SELECT *, row_number() OVER (PARTITION BY stream_code ORDER BY width * height * 1000 + kbps DESC, idx) AS k FROM renditions) r WHERE k = 1"


@_op("renditions")
def best_variant(d):
    return "SELECT stream_code, idx FROM (SELECT *, row_number() OVER (PARTITION BY stream_code ORDER BY kbps DESC, idx DESC) AS k FROM renditions) r WHERE k = 1"


@_op("streams")
def streams_by_code(d):
    return f"SELECT code, {_long('row_number() OVER (ORDER BY code)')} AS place FROM streams"


@_op("packets")
def track_order(d):
    return f"SELECT stream_code, codec, {_long('''row_number() OVER (PARTITION BY stream_code ORDER BY CASE codec WHEN 'h264' THEN 0 WHEN 'h265' THEN 1 ELSE 2 END)''')} AS place FROM (SELECT DISTINCT stream_code, codec FROM packets) t"


def _retention(d) -> str:
    """Oldest segments go while they are too old or all from them on hold too much; one always stays."""
    return f""", sized AS (SELECT *, {_long('sum(size) OVER (PARTITION BY stream_code ORDER BY idx DESC)')} AS onward, max(idx) OVER (PARTITION BY stream_code) AS last_idx FROM segments),
      firsts AS (SELECT *, coalesce(min(CASE WHEN ms >= {NOW} - {RETENTION} AND onward <= {CAP_BYTES} THEN idx END) OVER (PARTITION BY stream_code), last_idx) AS first_idx FROM sized),
      kept AS (SELECT stream_code, idx, ms, size FROM firsts WHERE idx >= first_idx)"""


@_op("segments")
def dvr_retention(d):
    return f"{_retention(d)} SELECT stream_code, idx, ms, size FROM kept"


@_op("segments", "packets")
def dvr_gap_prune(d):
    return f"{_retention(d)}, gaps AS ({dvr_gaps(d)}) SELECT g.stream_code, g.from_ms, g.to_ms FROM gaps g JOIN (SELECT stream_code, min(ms) AS oldest FROM kept GROUP BY stream_code) k ON g.stream_code = k.stream_code WHERE g.to_ms > k.oldest"


@_op("segments")
def disk_trim(d):
    return f"SELECT stream_code, idx FROM (SELECT *, row_number() OVER (PARTITION BY stream_code ORDER BY idx DESC) AS back FROM segments) s WHERE back > {2 * WINDOW}"


# Sets, fan-out, sinks ------------------------------------------------------------------------------------


@_op("packets")
def mix_streams(d):
    """Video of one stream and audio of another, which ends both."""
    return """, audio AS (SELECT * FROM packets WHERE stream_code = 'stream_2' AND codec = 'aac')
      SELECT event_id, 'video' AS part FROM packets WHERE stream_code = 'stream_1' AND codec <> 'aac' AND ms <= (SELECT max(ms) FROM audio) UNION ALL SELECT event_id, 'audio' FROM audio"""


@_op("renditions")
def abr_copy(d):
    return "SELECT idx, '$r$' || stream_code || '$' || slug AS from_id, '$r$copy-' || stream_code || '$' || slug AS to_id FROM renditions"


@_op("domain_events", "hooks")
def hook_queue(d, cap: int = QUEUE):
    """A full queue drops its oldest."""
    return f"SELECT hook_id, id FROM (SELECT hook_id, id, row_number() OVER (PARTITION BY hook_id ORDER BY id DESC) AS back FROM ({hook_dispatch(d)}) m) q WHERE back <= {cap}"


@_op("domain_events", "hooks")
def hook_batches(d):
    return f"SELECT hook_id, batch, count(*) AS items, min(id) AS first_id FROM (SELECT hook_id, id, {d.div('row_number() OVER (PARTITION BY hook_id ORDER BY id) - 1', str(BATCH))} AS batch FROM ({hook_dispatch(d)}) m) q GROUP BY hook_id, batch"


# Sources -------------------------------------------------------------------------------------------------


def _kind() -> str:
    path = "split_part(split_part(url, '#', 1), '?', 1)"
    return f"""CASE WHEN regexp_matches(url, ':80$') AND url LIKE 'copy%' THEN 'copy' WHEN lower(url) LIKE 'copy:%' THEN 'copy' WHEN lower(url) LIKE 'mixer:%' THEN 'mixer'
      WHEN lower(url) LIKE 'publish:%' THEN 'publish' WHEN lower(url) LIKE 'udp:%' THEN 'udp' WHEN regexp_matches(lower(url), '^rtmps?:') THEN 'rtmp' WHEN regexp_matches(lower(url), '^rtsps?:') THEN 'rtsp'
      WHEN lower(url) LIKE 'srt:%' THEN 'srt' WHEN lower(url) LIKE 'file:%' THEN 'file' WHEN regexp_matches(lower({path}), '^https?://[^/]*/.*[.]m3u8?$') THEN 'hls' WHEN url LIKE '/%' THEN 'file' ELSE 'unknown' END"""


_LOCAL = r"regexp_matches(lower(url), '^((rtmps?|srt)://(|0[.]0[.]0[.]0|127[.][0-9.]+|\[::1?\])(:[0-9]*)?(/|$)|publish:)')"


@_op("source_urls")
def url_kind(d):
    return f"SELECT id, {_kind()} AS kind FROM source_urls"


@_op("source_urls")
def is_push_listen(d):
    return f"SELECT id, {_LOCAL} AS listens FROM source_urls"


@_op("source_urls")
def classify_source(d):
    return f"SELECT id, CASE WHEN {_LOCAL} THEN 'push' WHEN {_kind()} = 'unknown' THEN 'error' ELSE {_kind()} END AS reader FROM source_urls"


@_op("source_urls")
def copy_mixer_grammar(d):
    return r"""SELECT id, kind, CASE WHEN reason = 'ok' THEN codes[1] END AS first_code, CASE WHEN reason = 'ok' AND kind = 'mixer' THEN codes[2] END AS second_code, reason, reason = 'ok' AND query = 'audio_failure=continue' AS goes_on
      FROM (SELECT *, CASE WHEN host LIKE '%@%' THEN 'userinfo' WHEN path NOT IN ('', '/') THEN 'path' WHEN kind = 'copy' AND query <> '' THEN 'query' WHEN url LIKE '%#%' THEN 'fragment' WHEN host = '' THEN 'missing'
          WHEN kind = 'copy' AND host LIKE '%:%' THEN 'port' WHEN kind = 'copy' THEN 'ok' WHEN len(codes) <> 2 THEN 'two codes' WHEN codes[1] = '' THEN 'no video' WHEN codes[2] = '' THEN 'no audio' WHEN host LIKE '%:%' THEN 'port'
          WHEN query = '' THEN 'ok' WHEN query NOT LIKE 'audio_failure=%' THEN 'unknown parameter' WHEN query NOT IN ('audio_failure=continue', 'audio_failure=down') THEN 'bad value' ELSE 'ok' END AS reason
        FROM (SELECT id, url, split_part(url, ':', 1) AS kind, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, string_split(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ',') AS codes,
            regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM source_urls WHERE regexp_matches(url, '^(copy|mixer):')) p) q"""


@_op("polls")
def dedup_by_sequence(d):
    return "SELECT p.stream_code, p.poll, p.sequence FROM polls p WHERE NOT EXISTS (SELECT 1 FROM polls e WHERE e.stream_code = p.stream_code AND e.poll < p.poll AND e.sequence >= p.sequence)"


@_op("stream_inputs")
def push_registry(d):
    return "SELECT url AS push_key, min(id) AS holder FROM stream_inputs GROUP BY url"


@_op("files")
def vod_listing(d):
    return f"""SELECT mount, name, is_dir, {_long('row_number() OVER (PARTITION BY mount ORDER BY CASE WHEN is_dir THEN 0 ELSE 1 END, name)')} AS place FROM files
      WHERE is_dir OR regexp_matches(name, '(?i)[.](mp4|m4v|mov|mkv|webm|avi|flv|ts|mts|m2ts|mpg|mpeg|wmv|3gp)$')"""


# Clients -------------------------------------------------------------------------------------------------


@_op("headers")
def client_ip(d):
    bare = lambda x: f"CASE WHEN {x} LIKE '[%]:%' THEN regexp_extract({x}, '^.([^]]*)', 1) WHEN len({x}) - len(replace({x}, ':', '')) = 1 THEN split_part({x}, ':', 1) ELSE {x} END"
    return f"SELECT event_id, CASE WHEN trim(forwarded) <> '' THEN {bare('head')} WHEN real_ip <> '' THEN {bare('real_ip')} ELSE {bare('remote')} END AS client FROM (SELECT *, trim(split_part(forwarded, ',', 1)) AS head FROM headers) h"


@_op("hits")
def session_user(d):
    key = "sha256(stream_code || chr(0) || ip || chr(0) || user_agent || chr(0) || tok)"
    return f"SELECT event_id, CASE WHEN tok = '' THEN 'fingerprint' ELSE 'token' END AS named_by, CASE WHEN tok = '' THEN left({key}, 8) ELSE tok END AS user_name FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'tok-' || user_agent ELSE '' END AS tok FROM hits) h"


@_op("source_urls")
def proto_from_path(d):
    return """SELECT id, CASE WHEN regexp_matches(path, '(?i)[.](m3u8|ts)$') THEN 'hls' WHEN regexp_matches(path, '(?i)[.](mpd|m4s|mp4)$') THEN 'dash' ELSE '' END AS proto, regexp_extract(path, '^/?([^/]+)/', 1) AS stream_code
      FROM (SELECT id, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/]*)?', '') AS path FROM source_urls) u"""


@_op("hits")
def geo(d):
    return "SELECT event_id, CASE WHEN user_id BETWEEN 0 AND 49 THEN 'AA' WHEN user_id BETWEEN 50 AND 99 THEN 'BB' ELSE '' END AS country FROM hits"


@_op("messages")
def classify_error(d):
    return """SELECT event_id, CASE WHEN contains(message, 'x509:') OR contains(message, 'tls:') OR contains(message, 'no such host') OR regexp_matches(message, '(?i)(^|[^0-9a-z_])http (401|403|404|410|429|500|502|503|504)([^0-9a-z_]|$)')
      THEN 'fatal' ELSE 'retry' END AS verdict FROM messages"""


@_op("domain_events", "hooks")
def with_metadata(d):
    return f"""SELECT id, 'k' AS key, json_extract_string(payload, '$.k') AS value FROM domain_events UNION ALL SELECT id, 'meta.region', 'eu' FROM domain_events UNION ALL SELECT id, 'meta.k', '7' FROM domain_events"""


# Tracks and ladders --------------------------------------------------------------------------------------


@_op("packets")
def codec_class(d):
    return "SELECT stream_code, CASE codec WHEN 'aac' THEN 'audio' ELSE 'video' END AS class, codec AS label, count(*) AS packets FROM packets GROUP BY stream_code, codec"


@_op("profiles")
def renditions_default(d):
    return """SELECT stream_code, idx, slug, width, height, kbps, CASE WHEN kbps > 0 THEN kbps * 1000 ELSE 2500000 END AS bandwidth FROM (
      SELECT stream_code, idx, 'track_' || k AS slug, CASE WHEN video_copy THEN 0 ELSE width END AS width, CASE WHEN video_copy THEN 0 ELSE height END AS height,
        CASE WHEN video_copy THEN 0 WHEN kbps > 0 THEN kbps ELSE 2500 END AS kbps
      FROM (SELECT *, row_number() OVER (PARTITION BY stream_code ORDER BY idx) AS k FROM profiles WHERE NOT (video_copy AND audio_copy)) p WHERE NOT video_copy OR k = 1) q"""


@_op("profiles")
def output_tracks(d):
    zero = _long("0")
    return f"""SELECT DISTINCT stream_code, {zero} AS place, 'audio' AS kind, CASE WHEN audio_copy THEN 'copy' ELSE audio_codec END AS codec, {zero} AS width, {zero} AS height, audio_kbps AS kbps FROM profiles WHERE audio_copy OR audio_codec <> ''
      UNION ALL SELECT stream_code, row_number() OVER (PARTITION BY stream_code ORDER BY idx), 'video', CASE WHEN video_copy THEN 'copy' ELSE codec END, width, height, kbps FROM profiles"""


@_op("renditions")
def codec_string(d):
    return "SELECT stream_code, idx, CASE WHEN width * height >= 2073600 THEN 'avc1.640028' WHEN width * height >= 921600 THEN 'avc1.4d401f' ELSE 'avc1.42e01e' END AS codecs FROM renditions"


@_op("profiles")
def gop_frames(d):
    fps = "CASE WHEN rate > 0 THEN rate WHEN fps > 0 THEN fps ELSE 25 END"
    return f"SELECT stream_code, idx, {_long(f'CASE WHEN gop > 0 THEN gop WHEN step > 0 THEN greatest(1, floor(step * ({fps}) + 0.5)) ELSE 0 END')} AS frames FROM profiles"


@_op("profiles")
def encoders(d):
    hw = "CASE WHEN idx % 2 = 0 THEN 'nvenc' ELSE 'none' END"
    return f"SELECT stream_code, idx, CASE WHEN codec = 'h265' THEN CASE WHEN idx % 2 = 0 THEN 'hevc_nvenc' ELSE 'libx265' END WHEN codec = 'h264' THEN CASE WHEN idx % 2 = 0 THEN 'h264_nvenc' ELSE 'libx264' END ELSE 'libx264' END AS encoder, {hw} AS accelerator FROM profiles"


@_op("renditions")
def best_known(d):
    return "SELECT stream_code, slug, CASE WHEN idx % 4 = 0 THEN kbps + 1 ELSE kbps END AS kbps FROM renditions"


@_op("sourced_renditions", "tracks")
def fanout_audio(d):
    return "SELECT t.event_id, r.stream_code, r.slug FROM sourced_renditions r, tracks t WHERE t.codec = 'aac' AND t.stream_code = r.audio_code"


# Configurations ------------------------------------------------------------------------------------------


@_op("hooks")
def merge_defaults(d):
    return """SELECT n AS id, CASE WHEN n % 3 > 0 THEN n % 3 WHEN n % 2 = 1 THEN 50 ELSE 100 END AS batch_max_items, CASE WHEN n % 4 > 1 THEN n % 4 - 1 ELSE 3 END AS max_retries FROM range(20) t(n)"""


@_op("streams")
def valid_codes(d):
    return "SELECT title, CASE WHEN regexp_full_match(title, '[a-zA-Z0-9_]{1,128}') THEN 'ok' ELSE 'bad characters' END AS problem FROM streams"


@_op("config_old", "config_new")
def diff_inputs(d):
    return """SELECT k, CASE WHEN side = 3 THEN 'updated' WHEN side = 2 THEN 'added' ELSE 'removed' END AS change FROM (
      SELECT k, sum(side) AS side, count(DISTINCT url) AS urls FROM (SELECT k, url, 1 AS side FROM config_old UNION ALL SELECT k, url, 2 FROM config_new) b GROUP BY k) g WHERE side < 3 OR urls > 1"""


@_op("config_old", "config_new")
def diff_profiles(d):
    place = "SELECT stream, url, row_number() OVER (PARTITION BY stream ORDER BY k) AS pos, {0} AS side FROM {1}"
    return f"""SELECT stream, pos, CASE WHEN side = 3 THEN 'updated' WHEN side = 2 THEN 'added' ELSE 'removed' END AS change FROM (
      SELECT stream, pos, sum(side) AS side, count(DISTINCT url) AS urls FROM ({place.format(1, 'config_old')} UNION ALL {place.format(2, 'config_new')}) b GROUP BY stream, pos) g WHERE side < 3 OR urls > 1 OR stream % 4 = 0"""


@_op("config_old", "config_new")
def diff_stream(d):
    side = "SELECT stream, count(*) AS n, string_agg(k || ' ' || url, ',' ORDER BY k) AS urls FROM {0} GROUP BY stream"
    return f"""SELECT coalesce(o.stream, n.stream) AS stream, o.n IS DISTINCT FROM n.n AS count_changed, o.urls IS DISTINCT FROM n.urls AS inputs_changed
      FROM ({side.format('config_old')}) o FULL OUTER JOIN ({side.format('config_new')}) n ON o.stream = n.stream"""


@_op("updates")
def update_plan(d):
    steps = "concat_ws(',', CASE WHEN profiles_updated OR profiles_moved THEN 'profiles' END, CASE WHEN profiles_updated THEN 'master' END, CASE WHEN inputs THEN 'inputs' END, CASE WHEN profiles_moved THEN 'hls and dash' END, CASE WHEN protocols OR push THEN 'protocols' END, CASE WHEN dvr THEN 'dvr' WHEN profiles_moved THEN 'dvr if moved' END)"
    return f"SELECT stream, CASE WHEN special THEN CASE WHEN disabled THEN 'stop' ELSE 'stop,start' END WHEN disabled THEN 'stop' WHEN topology THEN 'reload' ELSE {steps} END AS actions FROM updates"


@_op("services_old", "services_new")
def service_diff(d):
    return """SELECT service, CASE WHEN was IS NOT NULL AND now IS NULL THEN 'stop' WHEN was IS NULL AND now IS NOT NULL THEN 'start' WHEN was <> now THEN 'restart' ELSE 'none' END AS action FROM (
      SELECT service, max(settings) FILTER (WHERE side = 1) AS was, max(settings) FILTER (WHERE side = 2) AS now FROM (SELECT *, 1 AS side FROM services_old UNION ALL SELECT *, 2 FROM services_new) b GROUP BY service) g"""


@_op("shapes", "ladders")
def validate_shape(d):
    return """, m AS (SELECT s.code, trim(s.url) LIKE 'copy:%' AS copies, trim(s.url) LIKE 'mixer:%' AS mixes, regexp_extract(url, '//([^,]*)', 1) AS a, regexp_extract(url, ',(.*)$', 1) AS b, count(*) OVER (PARTITION BY s.code) AS n FROM shapes s),
      f AS (SELECT m.*, coalesce(rungs, 0) > 0 AS ladder FROM m LEFT JOIN ladders l ON l.code = m.a WHERE copies OR mixes)
      SELECT code, CASE WHEN bool_or(copies AND a = code) THEN 'self copy' WHEN bool_or(copies AND ladder AND n > 1) THEN 'ladder not alone' WHEN bool_or(mixes AND n > 1) THEN 'mixer not alone' WHEN bool_or(mixes AND (a = code OR b = code)) THEN 'self mix' ELSE 'ok' END AS verdict FROM f GROUP BY code"""


@_op("shapes")
def dup_inputs(d):
    return "SELECT code, trim(url) AS url, count(*) AS times FROM shapes GROUP BY 1, 2 HAVING count(*) > 1"


@_op("shapes")
def priority_position(d):
    return "SELECT code, pos, priority FROM shapes WHERE priority <> pos"


@_op("stream_inputs", "packets", "profiles")
def media_summary(d):
    return f"""SELECT code, input_id, {_long('3')} AS input_tracks, {_long('input_id % 100 * 3')} AS input_kbps, {_long("CASE WHEN code LIKE '%1' THEN 2 ELSE 3 END")} AS output_tracks, {_long("CASE WHEN code LIKE '%1' THEN 2000 ELSE input_id % 100 * 3 END")} AS output_kbps FROM (
      SELECT code, id AS input_id, row_number() OVER (PARTITION BY code ORDER BY CASE WHEN status = 'active' THEN 0 ELSE 1 END, priority) AS k FROM stream_inputs) i WHERE k = 1"""


@_op("configured_streams", "shapes", "config_hooks", "mounts")
def config_errors(d):
    return """SELECT 'streams[' || idx || '].code' AS path, CASE WHEN code LIKE '% %' THEN 'bad characters' ELSE 'duplicate' END AS problem FROM configured_streams c WHERE code LIKE '% %' OR EXISTS (SELECT 1 FROM configured_streams e WHERE e.code = c.code AND e.idx < c.idx)
      UNION ALL SELECT 'streams[' || idx || '].inputs', 'priority is not the place' FROM configured_streams c WHERE EXISTS (SELECT 1 FROM shapes s WHERE s.code = c.code AND s.pos <> s.priority)
      UNION ALL SELECT 'streams[' || idx || '].inputs', 'duplicate url' FROM configured_streams c WHERE EXISTS (SELECT 1 FROM shapes s JOIN shapes t ON s.code = t.code AND trim(s.url) = trim(t.url) AND s.pos < t.pos WHERE s.code = c.code)
      UNION ALL SELECT 'hooks[' || idx || '].id', CASE WHEN trim(hook_id) = '' THEN 'required' ELSE 'duplicate' END FROM (SELECT *, min(idx) OVER (PARTITION BY hook_id) AS first FROM config_hooks) h WHERE trim(hook_id) = '' OR first < idx
      UNION ALL SELECT 'hooks[' || idx || '].target', p FROM (SELECT idx, CASE WHEN target = '' THEN 'required' WHEN kind = 'http' AND target NOT LIKE 'http%' THEN 'not http' WHEN kind = 'file' AND target NOT LIKE '/%' THEN 'not absolute' WHEN kind = 'kafka' THEN 'unsupported type' END AS p FROM config_hooks) h WHERE p IS NOT NULL
      UNION ALL SELECT 'hooks[' || idx || '].max_retries', 'below 0' FROM config_hooks WHERE max_retries < 0 UNION ALL SELECT 'hooks[' || idx || '].timeout_sec', 'below 0' FROM config_hooks WHERE timeout_sec < 0
      UNION ALL SELECT 'hooks[' || idx || '].stream_codes', 'only and except' FROM config_hooks WHERE both_lists
      UNION ALL SELECT 'vod[' || idx || '].name', CASE WHEN name LIKE '% %' THEN 'bad characters' ELSE 'duplicate' END FROM mounts m WHERE name LIKE '% %' OR EXISTS (SELECT 1 FROM mounts e WHERE e.name = m.name AND e.idx < m.idx)
      UNION ALL SELECT 'vod[' || idx || '].storage', 'not absolute' FROM mounts WHERE storage = 'rel'"""


@_op("recordings")
def recordings_of(d):
    return "SELECT id, status FROM recordings WHERE stream_code = 'stream_4'"


@_op("packets")
def copied_stream(d):
    return "SELECT event_id, ms, 'copy_of_3' AS stream_code FROM packets WHERE stream_code = 'stream_3'"


# Aggregates ----------------------------------------------------------------------------------------------


@_op("hits")
def session_stats(d):
    kick = "user_id % 10 = 3 AND session = 0"
    return f"{_sessions(d)} SELECT count(*) AS opened, count(*) FILTER (WHERE closed OR {kick}) AS closed, count(*) FILTER (WHERE closed AND NOT ({kick})) AS idle_closed, count(*) FILTER (WHERE {kick}) AS kicked, count(*) FILTER (WHERE NOT closed AND NOT ({kick})) AS active FROM closed"


@_op("availability")
def earliest_available(d):
    return "SELECT stream_code, min(avail_ms) FILTER (WHERE avail_ms > 0) AS earliest FROM availability GROUP BY stream_code"


@_op("stream_inputs")
def stream_rollup(d):
    return """SELECT code, CASE WHEN count(*) = count(*) FILTER (WHERE status = 'stopped') THEN 'stopped' WHEN count(*) FILTER (WHERE status IN ('active', 'idle')) = 0 OR bool_or(id % 9 = 0) THEN 'degraded' ELSE 'active' END AS status, count(*) AS inputs FROM stream_inputs GROUP BY code"""


@_op("whole_samples")
def counter_delta(d):
    return "SELECT metric, arg_max(v, (ms, event_id)) - arg_min(v, (ms, event_id)) AS delta, max(v) AS highest, count(*) AS n FROM whole_samples GROUP BY metric"


@_op("snapshots")
def runtime_counts(d):
    return f"SELECT stream_code, {_long('sum(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END)')} AS degraded, {_long('sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END)')} AS switches FROM snapshots GROUP BY stream_code"


@_op("bench_runs")
def phase_report(d):
    return "SELECT substr(name, 1, 1) AS phase, count(*) AS runs, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM bench_runs WHERE name SIMILAR TO '[A-Z].*' GROUP BY 1"


@_op("totals")
def net_rate(d):
    return """SELECT metric, event_id, CAST((total - before) * 8 AS DOUBLE) / 1000000.0::DOUBLE / greatest(CAST(ms - before_ms AS DOUBLE) / 1000.0::DOUBLE, 0.001::DOUBLE) AS mbps FROM (
      SELECT *, lag(total) OVER w AS before, lag(ms) OVER w AS before_ms FROM totals WINDOW w AS (PARTITION BY metric ORDER BY ms, event_id)) t WHERE before IS NOT NULL"""


@_op("packets")
def stale_inputs(d):
    return f"SELECT p.stream_code, input_priority, CASE WHEN max(newest) - max(ms) <= {STALE} THEN 'active' ELSE 'degraded' END AS status FROM packets p JOIN (SELECT stream_code, max(ms) AS newest FROM packets GROUP BY stream_code) n ON n.stream_code = p.stream_code GROUP BY p.stream_code, input_priority"


@_op("stream_inputs")
def select_best_input(d):
    return "SELECT code, id FROM (SELECT code, id, row_number() OVER (PARTITION BY code ORDER BY CASE WHEN priority = 2 THEN 0 ELSE 1 END, priority) AS k FROM stream_inputs WHERE status IN ('active', 'idle')) i WHERE k = 1"


# Sequences -----------------------------------------------------------------------------------------------


@_op("runs")
def crash_streak(d):
    return f"""SELECT stream_code, event_id, {_long('k - coalesce(max(CASE WHEN run_sec >= 30 THEN k END) OVER w, 0)')} AS streak, k - coalesce(max(CASE WHEN run_sec >= 30 THEN k END) OVER w, 0) >= {CRASHES} AS unhealthy
      FROM (SELECT *, row_number() OVER (PARTITION BY stream_code ORDER BY ms, event_id) AS k FROM runs) r WINDOW w AS (PARTITION BY stream_code ORDER BY k)"""


@_op("runs")
def error_suppression(d):
    return f"""SELECT stream_code, event_id, {_long('k')} AS attempt, {_long('k - coalesce(max(CASE WHEN changed THEN k END) OVER w, 1) + 1')} AS same,
        k - coalesce(max(CASE WHEN changed THEN k END) OVER w, 1) + 1 <= 3 OR log2(k) = floor(log2(k)) AS visible
      FROM (SELECT *, row_number() OVER v AS k, message IS DISTINCT FROM lag(message) OVER v AS changed FROM runs WINDOW v AS (PARTITION BY stream_code ORDER BY ms, event_id)) r WINDOW w AS (PARTITION BY stream_code ORDER BY k)"""


@_op("profile_runs")
def health_edges(d):
    return f""", a AS (SELECT *, row_number() OVER (PARTITION BY stream_code, profile ORDER BY ms, event_id) AS k FROM profile_runs),
      b AS (SELECT *, k - coalesce(max(CASE WHEN run_sec >= 30 THEN k END) OVER (PARTITION BY stream_code, profile ORDER BY k), 0) >= {CRASHES} AS bad FROM a),
      c AS (SELECT e.stream_code, e.event_id, e.ms, e.profile, (SELECT count(*) FROM (SELECT arg_max(bad, (ms, event_id)) AS bad FROM b i WHERE i.stream_code = e.stream_code AND (i.ms, i.event_id) <= (e.ms, e.event_id) GROUP BY profile) s WHERE s.bad) AS held FROM b e),
      f AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY stream_code ORDER BY ms, event_id), 0) AS before FROM c)
      SELECT stream_code, event_id, held > 0 AS unhealthy FROM f WHERE (held > 0) <> (before > 0)"""


@_op("clock_packets")
def dts_regressions(d):
    return f""", a AS (SELECT *, CASE WHEN codec = 'aac' THEN pts - lag(pts) OVER (PARTITION BY stream_code, codec = 'aac' ORDER BY ms, event_id) ELSE dts - lag(dts) OVER (PARTITION BY stream_code, codec = 'aac' ORDER BY ms, event_id) END AS step FROM clock_packets)
      SELECT stream_code, event_id, {_long('count(CASE WHEN step < -1000 THEN 1 END) OVER (PARTITION BY stream_code ORDER BY ms, event_id)')} AS source_no FROM a"""


@_op("frames")
def sample_durations(d):
    return f""", a AS (SELECT *, lead(dts) OVER (PARTITION BY stream_code, segment ORDER BY dts, event_id) AS next, count(*) OVER s AS n, max(dts) OVER s - min(dts) OVER s AS span FROM frames WINDOW s AS (PARTITION BY stream_code, segment))
      SELECT stream_code, event_id, {_long('CASE WHEN next > dts THEN (next - dts) * 90 WHEN span * 90 // n > 0 THEN span * 90 // n ELSE 3600 * 90000 // n END')} AS dur FROM a"""


@_op("push_sessions")
def push_states(d):
    return """, a AS (SELECT *, count(CASE WHEN ended = 'discontinuity' THEN 1 END) OVER (PARTITION BY stream_code ORDER BY ms, event_id) AS island FROM push_sessions),
      b AS (SELECT *, CASE WHEN ended = 'discontinuity' THEN 0 ELSE count(CASE WHEN ended = 'error' THEN 1 END) OVER (PARTITION BY stream_code, island ORDER BY ms, event_id) END AS attempts FROM a),
      c AS (SELECT *, bool_or(attempts >= 8) OVER (PARTITION BY stream_code ORDER BY ms, event_id) AS over FROM b)
      SELECT stream_code, event_id, attempts, CASE WHEN over THEN 'failed' WHEN attempts = 0 THEN 'starting' ELSE 'reconnecting' END AS state, CAST(CASE WHEN over THEN 0 WHEN attempts = 0 THEN 2 ELSE 1 END AS BIGINT) AS number FROM c"""


# Cuts that depend on the last cut, row by row ------------------------------------------------------------


def _walk(rows: str, key: str, first: str, state: str, step: str) -> str:
    """Rows of one key one after the other: r is the next row, w the state after the one before."""
    return f""", r AS (SELECT *, {key} AS key_, row_number() OVER (PARTITION BY {key} ORDER BY ms, event_id) AS rn FROM {rows}),
      w AS (SELECT key_, rn, {first} FROM r WHERE rn = 1 UNION ALL SELECT key_, rn, {state} FROM (SELECT r.key_, r.rn, {step} FROM r JOIN w ON r.key_ = w.key_ AND r.rn = w.rn + 1) s)"""


@_op("packets")
def dvr_segments(d):
    t = 6 * 3_600_000
    walk = _walk(
        "packets", "stream_code", "event_id, ms, pts_ms, CAST(1 AS BIGINT) AS segment, CAST(1 AS BIGINT) AS n, ms AS opened, nullif(pts_ms, 0) AS since",
        "event_id, ms, pts_ms, n, n + CASE WHEN cut THEN 1 ELSE 0 END, CASE WHEN cut THEN ms ELSE opened END, CASE WHEN cut THEN nullif(pts_ms, 0) ELSE since END",
        f"r.event_id, r.ms, r.pts_ms, w.n, w.opened, coalesce(w.since, nullif(r.pts_ms, 0)) AS since, CASE WHEN coalesce(w.since, nullif(r.pts_ms, 0)) IS NOT NULL THEN r.pts_ms - coalesce(w.since, nullif(r.pts_ms, 0)) >= {t} ELSE r.ms - w.opened >= {t} END AS cut",
    )
    return f"{walk} SELECT key_ AS stream_code, event_id, ms, pts_ms, segment FROM w"


@_op("packets")
def hls_segments(d):
    t = 6 * 3_600_000
    walk = _walk(
        "packets", "stream_code", "event_id, ms, CAST(1 AS BIGINT) AS segment, ms AS since", "event_id, ms, segment + CASE WHEN cut THEN 1 ELSE 0 END, CASE WHEN cut THEN ms ELSE since END",
        f"r.event_id, r.ms, w.segment, w.since, r.discontinuity OR (r.key_frame AND r.ms - w.since >= {t}) OR 2 * (r.ms - w.since) >= {3 * t} AS cut",
    )
    return f"{walk} SELECT key_ AS stream_code, event_id, ms, segment FROM w"


@_op("packets")
def dash_segments(d):
    t, frames = 6 * 3_600_000, 20
    video = "codec <> 'aac'"
    due = f"ms - opened >= {t} OR (coalesce(last - first >= {t}, FALSE) AND (n > 1 OR key)) OR (NOT seen AND frames >= {frames})"
    walk = _walk(
        "packets", "stream_code",
        f"event_id, ms, codec, CAST(1 AS BIGINT) AS segment, CAST(1 AS BIGINT) AS n, ms AS opened, CASE WHEN {video} THEN pts_ms END AS first, CASE WHEN {video} THEN pts_ms END AS last, {video} AND key_frame AS key, CASE WHEN {video} THEN 0 ELSE 1 END AS frames, {video} AS seen",
        f"event_id, ms, codec, n, n + CASE WHEN {due} THEN 1 ELSE 0 END, CASE WHEN {due} THEN NULL ELSE opened END, CASE WHEN {due} THEN NULL ELSE first END, CASE WHEN {due} THEN NULL ELSE last END, key, CASE WHEN {due} THEN 0 ELSE frames END, seen",
        f"r.event_id, r.ms, r.codec, w.n, coalesce(w.opened, r.ms) AS opened, coalesce(w.first, CASE WHEN r.{video} THEN r.pts_ms END) AS first, CASE WHEN r.{video} THEN r.pts_ms ELSE w.last END AS last, CASE WHEN w.first IS NULL AND r.{video} THEN r.key_frame ELSE w.key END AS key, w.frames + CASE WHEN r.{video} THEN 0 ELSE 1 END AS frames, w.seen OR r.{video} AS seen",
    )
    return f"{walk} SELECT key_ AS stream_code, event_id, ms, codec, segment FROM w"


@_op("hits")
def session_max_life(d):
    idle, life = IDLE, 2 * 86_400_000
    walk = _walk(
        "hits", "user_id", "event_id, ms, CAST(1 AS BIGINT) AS session, ms AS since", "event_id, ms, session + CASE WHEN cut THEN 1 ELSE 0 END, CASE WHEN cut THEN ms ELSE since END",
        f"r.event_id, r.ms, w.session, w.since, r.ms - w.ms > {idle} OR r.ms - w.since > {life} AS cut",
    )
    return f"{walk} SELECT key_ AS user_id, event_id, ms, session FROM w"


@_op("packets")
def bitrate_ewma(d):
    fresh = "CAST(bytes * 8 AS DOUBLE) / elapsed"
    walk = _walk(
        "packets", "stream_code || ' ' || codec", "event_id, ms, size, ms AS since, size AS bytes, CAST(0 AS DOUBLE) AS rate",
        f"event_id, ms, size, CASE WHEN elapsed >= 3000 THEN ms ELSE since END, CASE WHEN elapsed >= 3000 THEN 0 ELSE bytes END, CASE WHEN elapsed < 3000 THEN rate WHEN rate = 0 THEN {fresh} ELSE 0.5::DOUBLE * rate + 0.5::DOUBLE * ({fresh}) END",
        "r.event_id, r.ms, r.size, w.since, w.bytes + r.size AS bytes, r.ms - w.since AS elapsed, w.rate",
    )
    return f"{walk} SELECT key_ AS track, event_id, ms, size, floor(rate + 0.5::DOUBLE) AS kbps FROM w"


# Playlists -----------------------------------------------------------------------------------------------


@_op("segments")
def target_duration(d):
    return f"SELECT stream_code, greatest(3, max({_long('duration_ms // 1000')}) + 1) AS hls_sec, max({_long('ceil(greatest(1.0, duration_ms / 1000.0))')}) AS dvr_sec FROM segments GROUP BY stream_code"


@_op("segments")
def hls_manifest(d):
    line = "CASE WHEN discontinuity THEN '#EXT-X-DISCONTINUITY' || chr(10) ELSE '' END || printf('#EXTINF:%.6f,', duration_ms / 1000.0::DOUBLE) || chr(10) || printf('seg_%06d.ts', idx) || chr(10)"
    return f"""SELECT stream_code, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:' || greatest(3, max(duration_ms // 1000) + 1) || chr(10) || '#EXT-X-MEDIA-SEQUENCE:' || (max(idx) - count(*)) || chr(10) || string_agg({line}, '' ORDER BY idx) AS manifest
      FROM (SELECT *, row_number() OVER (PARTITION BY stream_code ORDER BY idx DESC) AS back FROM segments) s WHERE back <= {WINDOW} GROUP BY stream_code"""


@_op("renditions")
def hls_master(d):
    line = """printf('#EXT-X-STREAM-INF:BANDWIDTH=%d,RESOLUTION=%dx%d,CODECS="%s"', CASE WHEN kbps > 0 THEN kbps * 1000 ELSE 2500000 END, width, height, CASE WHEN width * height >= 2073600 THEN 'avc1.640028' WHEN width * height >= 921600 THEN 'avc1.4d401f' ELSE 'avc1.42e01e' END) || chr(10) || slug || '/index.m3u8' || chr(10)"""
    return f"SELECT stream_code, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || chr(10) || string_agg({line}, '' ORDER BY slug) AS manifest FROM renditions GROUP BY stream_code"


@_op("segments")
def dvr_playlist(d):
    line = """CASE WHEN discontinuity THEN '#EXT-X-DISCONTINUITY' || chr(10) ELSE '' END || CASE WHEN discontinuity OR place = 1 THEN '#EXT-X-PROGRAM-DATE-TIME:' || strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || chr(10) ELSE '' END
      || printf('#EXTINF:%.3f,', duration_ms / 1000.0::DOUBLE) || chr(10) || printf('%06d.ts', idx) || chr(10)"""
    return f"""{_retention(d)}, lines AS (SELECT s.*, row_number() OVER (PARTITION BY s.stream_code ORDER BY s.idx) AS place FROM segments s JOIN kept k ON k.stream_code = s.stream_code AND k.idx = s.idx)
      SELECT stream_code, count(*) AS entries, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:' || CAST(ceil(greatest(1.0, max(duration_ms) / 1000.0)) AS BIGINT) || chr(10) || '#EXT-X-PLAYLIST-TYPE:EVENT' || chr(10) || chr(10) || string_agg({line}, '' ORDER BY idx) AS playlist FROM lines GROUP BY stream_code"""


@_op("segments")
def dash_mpd(d):
    s = "printf('<S%s d=\"%d\"></S>', CASE WHEN place = 1 THEN printf(' t=\"%d\"', ms * scale // 1000) ELSE '' END, duration_ms * scale // 1000)"
    shape = """printf('<Representation id="%s%d" mimeType="%s/mp4" codecs="%s" bandwidth="%d"%s><BaseURL>%s/</BaseURL><SegmentTemplate timescale="%d" initialization="init_%s.mp4" media="seg_%s_$Number%%05d$.m4s" startNumber="%d"><SegmentTimeline>%s</SegmentTimeline></SegmentTemplate></Representation>',
      letter, number, kind, codec, bandwidth, size, slug, scale, letter, letter, start, entries)"""
    return f""", t AS (SELECT stream_code, idx, ms, duration_ms, unnest(['track_1', 'track_2', 'track_1']) AS slug, unnest(['video', 'video', 'audio']) AS kind, unnest([0, 1, 0]) AS number, unnest(['v', 'v', 'a']) AS letter, unnest(['avc1.640028', 'avc1.4d401f', 'mp4a.40.2']) AS codec,
        unnest([5000000, 2500000, 128000]) AS bandwidth, unnest([' width="1920" height="1080"', ' width="1280" height="720"', ' audioSamplingRate="48000"']) AS size, unnest([90000, 90000, 48000]) AS scale FROM segments),
      v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_code, slug, kind ORDER BY idx DESC) AS back FROM t) b WHERE back <= 5),
      p AS (SELECT *, row_number() OVER (PARTITION BY stream_code, slug, kind ORDER BY idx) AS place FROM v),
      l AS (SELECT stream_code, slug, kind, number, letter, codec, bandwidth, size, scale, min(idx) AS start, string_agg({s}, '' ORDER BY idx) AS entries FROM p GROUP BY ALL),
      a AS (SELECT stream_code, kind, string_agg({shape}, '' ORDER BY slug) AS shapes FROM l GROUP BY stream_code, kind),
      e AS (SELECT stream_code, printf('<AdaptationSet id="%d" contentType="%s" mimeType="%s/mp4" segmentAlignment="true" startWithSAP="1">%s</AdaptationSet>', CASE kind WHEN 'video' THEN 0 ELSE 1 END, kind, kind, shapes) AS held, kind FROM a)
      SELECT stream_code, '<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="dynamic" profiles="urn:mpeg:dash:profile:isoff-live:2011" minBufferTime="PT4S" suggestedPresentationDelay="PT6S" maxSegmentDuration="PT6S" availabilityStartTime="2024-01-01T00:00:00Z" minimumUpdatePeriod="PT2S" timeShiftBufferDepth="PT10S" publishTime="2024-02-01T00:00:00Z"><Period id="0" start="PT0S">'
        || string_agg(held, '' ORDER BY kind DESC) || '</Period><UTCTiming schemeIdUri="urn:mpeg:dash:utc:direct:2014" value="2024-02-01T00:00:00Z"></UTCTiming></MPD>' AS mpd FROM e GROUP BY stream_code"""


@_op("segments")
def parse_media_playlist(d):
    return f"""SELECT stream_code AS playlist, idx - 1 AS sequence, printf('seg_%06d.ts', idx) AS uri, duration_ms / 1000.0::DOUBLE AS duration, discontinuity FROM (SELECT *, row_number() OVER (PARTITION BY stream_code ORDER BY idx DESC) AS back FROM segments) s WHERE back <= {WINDOW}"""


@_op("renditions")
def parse_master_playlist(d):
    return "SELECT stream_code AS playlist, CAST(4 + 2 * (row_number() OVER (PARTITION BY stream_code ORDER BY slug) - 1) AS BIGINT) AS line_no, slug || '/index.m3u8' AS uri, CASE WHEN kbps > 0 THEN kbps * 1000 ELSE 2500000 END AS bandwidth FROM renditions"


@_op("segments")
def parse_recording_playlist(d):
    return f"""{_retention(d)}, k AS (SELECT s.* FROM segments s JOIN kept k ON k.stream_code = s.stream_code AND k.idx = s.idx), m AS (SELECT *, discontinuity OR idx = min(idx) OVER (PARTITION BY stream_code) AS dated FROM k)
      SELECT stream_code AS playlist, idx, last_value(CASE WHEN dated THEN ms END IGNORE NULLS) OVER (PARTITION BY stream_code ORDER BY idx) AS wall_ms, duration_ms, discontinuity FROM m"""


@_op("domain_events")
def events_jsonl(d):
    return "SELECT id, CAST(json_object('id', id, 'type', type, 'stream_code', stream_code, 'ms', ms, 'payload', CAST(payload AS JSON)) AS VARCHAR) AS line FROM domain_events"
