"""Logical inputs as common table expressions over the stored tables, in either dialect.

Every view is a projection or a keyed window of one table, so filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans import dialect

#: Which stored tables a view reads.
TABLES = {
    "hits": "events", "packets": "events", "segments": "events", "domain_events": "events", "runs": "events", "samples": "events",
    "renditions": "part", "config_old": "customer", "config_new": "customer", "source_urls": "pages", "streams": "nation",
    "stream_inputs": "supplier", "headers": "events", "polls": "events", "files": "part", "messages": "events", "availability": "events", "frames": "events",
    "push_sessions": "events", "profile_runs": "events", "shapes": "supplier", "ladders": "nation", "services_old": "customer", "services_new": "customer",
    "updates": "customer", "profiles": "part", "snapshots": "events", "bench_runs": "customer", "recordings": "orders", "clock_packets": "events", "tracks": "events",
    "sourced_renditions": "part", "known_renditions": "part", "whole_samples": "events", "totals": "events", "configured_streams": "nation", "config_hooks": "customer", "mounts": "nation",
}

#: One address of each kind that the URL rules tell apart.
URLS = (
    "udp://239.0.0.1:5000", "http://h/live/index.m3u8", "https://h/a.M3U8?x=1", "http://h/x.ts", "file:///v/a.ts", "/var/v/a.mp4",
    "rtmp://h/live/a", "rtmps://h/live/a", "rtsp://h/a", "rtsps://h/a", "srt://h:9000", "publish://", "copy://news", "copy://",
    "mixer://cam,mic", "mixer://cam,mic?audio_failure=continue", "mixer://cam", "rtmp://0.0.0.0:1935/live/a", "srt://0.0.0.0:9999", "ftp://h/a", "",
    "http://h/live/b.m3u8#t", "http://h/x?y=.m3u8", "rtmp://[::]:1935/live", "rtmps://127.0.0.1/live", "rtmp://0.0.0.0.example/live", "srt://:9000", "copy://a:80", "copy://a/b", "copy://u@a",
    "copy://a?x=1", "copy://a#f", "mixer://a,b,c", "mixer://,b", "mixer://a,", "mixer://a,b?x=1", "mixer://a,b?audio_failure=up",
)


def view(d, name: str) -> str:
    """The body of a view in dialect ``d``."""
    events, stream = d.table("events"), "'stream_' || CAST(user_id % 10 AS VARCHAR(20))"
    size = "CAST(floor(value * 1000) AS BIGINT)"
    if name == "hits":
        return f"""SELECT event_id, user_id, event_type, {stream} AS stream_code, {d.ms('ts')} AS ms,
          CASE event_type WHEN 'click' THEN 'hls' WHEN 'view' THEN 'dash' WHEN 'purchase' THEN 'rtmp' WHEN 'signup' THEN 'srt' ELSE 'rtsp' END AS proto,
          '10.0.0.' || CAST(user_id AS VARCHAR(20)) AS ip, 'ua-' || CAST(user_id % 3 AS VARCHAR(20)) AS user_agent, '' AS token,
          CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status,
          CASE WHEN event_type = 'error' THEN CAST(0 AS BIGINT) ELSE greatest({size}, CAST(0 AS BIGINT)) END AS bytes
          FROM {events}"""
    if name == "packets":
        return f"""SELECT event_id, {stream} AS stream_code, CAST(user_id % 3 AS BIGINT) AS input_priority,
          CASE event_id % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'h265' ELSE 'aac' END AS codec, event_id % 5 = 0 AS key_frame,
          {size} AS size, {d.ms('ts')} AS ms, event_type = 'error' AS discontinuity,
          {d.ms('ts')} - min({d.ms('ts')}) OVER (PARTITION BY user_id % 10) AS pts_ms
          FROM {events}"""
    if name == "segments":
        return f"""SELECT {stream} AS stream_code, CAST(row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS BIGINT) AS idx,
          {d.ms('ts')} AS ms, CAST(3000 + event_id % 3001 AS BIGINT) AS duration_ms, {size} AS size, event_type = 'error' AS discontinuity
          FROM {events}"""
    if name == "domain_events":
        return f"SELECT event_id AS id, event_type AS type, {stream} AS stream_code, {d.ms('ts')} AS ms, props AS payload FROM {events}"
    if name == "runs":
        return f"""SELECT {stream} AS stream_code, event_id, {d.ms('ts')} AS ms, CAST(event_id % 97 AS BIGINT) AS run_sec,
          CASE WHEN user_id % 4 = 0 THEN 'exit 1' ELSE 'exit ' || CAST(event_id % 2 AS VARCHAR(20)) END AS message
          FROM {events} WHERE event_type = 'error'"""
    if name == "samples":
        return f"SELECT event_type AS metric, {d.ms('ts')} AS ms, event_id, value FROM {events}"
    if name == "hooks":
        none, two = d.strings(), d.array
        rows = (
            ("h1", none, none, none, "TRUE"), ("h2", two("'click'", "'view'"), none, none, "TRUE"), ("h3", none, two("'stream_1'", "'stream_2'"), none, "TRUE"),
            ("h4", none, none, two("'stream_3'"), "TRUE"), ("h5", two("'error'"), two("'stream_4'"), two("'stream_4'"), "TRUE"), ("h6", none, none, none, "FALSE"),
        )
        return " UNION ALL ".join(f"SELECT '{i}' AS hook_id, {t} AS event_types, {o} AS only_streams, {e} AS except_streams, {on} AS enabled" for i, t, o, e, on in rows)
    if name == "renditions":
        return f"""SELECT p_brand AS stream_code, p_partkey AS idx, 'track_' || CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS VARCHAR(20)) AS slug,
          CAST(p_size * 16 AS BIGINT) AS width, CAST(p_size * 9 AS BIGINT) AS height,
          CASE WHEN p_partkey % 11 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(p_retailprice) AS BIGINT) END AS kbps FROM {d.table('part')}"""
    if name == "config_old":
        return f"SELECT c_custkey AS k, c_mktsegment AS url, c_nationkey AS stream FROM {d.table('customer')} WHERE c_custkey % 7 <> 0"
    if name == "config_new":
        return f"SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment || '-new' ELSE c_mktsegment END AS url, c_nationkey AS stream FROM {d.table('customer')} WHERE c_custkey % 11 <> 0"
    if name == "source_urls":
        fixed = " UNION ALL ".join(f"SELECT CAST({-1 - k} AS BIGINT) AS id, '{u}' AS url" for k, u in enumerate(URLS))
        return f"SELECT page_id AS id, url FROM {d.table('pages')} UNION ALL {fixed}"
    if name == "streams":
        return f"SELECT 'stream_' || CAST(n_nationkey AS VARCHAR(20)) AS code, n_nationkey % 6 = 5 AS disabled, n_nationkey AS num, n_name AS title FROM {d.table('nation')}"
    if name == "stream_inputs":
        return f"""SELECT 'stream_' || CAST(s_nationkey AS VARCHAR(20)) AS code,
          CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS BIGINT) AS priority, s_suppkey AS id,
          'rtmp://h/' || CAST(s_suppkey % 20 AS VARCHAR(20)) AS url, CASE s_suppkey % 4 WHEN 0 THEN 'degraded' WHEN 1 THEN 'active' WHEN 2 THEN 'idle' ELSE 'stopped' END AS status
          FROM {d.table('supplier')}"""
    if name == "headers":
        return f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ' ' || ip || ':81 , 10.9.9.9' WHEN event_id % 7 = 0 THEN '2001:db8::7' ELSE '' END AS forwarded,
          CASE WHEN event_id % 3 = 1 THEN '[2001:db8::8]:443' ELSE '' END AS real_ip,
          CASE event_id % 4 WHEN 0 THEN ip || ':80' WHEN 1 THEN '[::1]:80' WHEN 2 THEN '::1' ELSE ip END AS remote FROM ({view(d, "hits")}) h"""
    if name == "polls":
        offsets = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k" for k in range(5))
        return f"""SELECT stream_code, {d.div("idx", "3")} AS poll, idx - k AS sequence FROM ({view(d, "segments")}) s CROSS JOIN ({offsets}) o WHERE idx % 3 = 0 AND idx > k"""
    if name == "files":
        kinds = ("mp4", "srt", "MKV", "m2ts", "txt", "webm", "ts", "3gp", "json")
        kind = "CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(kinds)) + " END"
        return f"""SELECT p_brand AS mount, p_partkey AS id, p_partkey % 11 = 0 AS is_dir,
          CASE WHEN p_partkey % 11 = 0 THEN 'dir-' || CAST(p_partkey AS VARCHAR(20)) ELSE 'v' || CAST(p_partkey AS VARCHAR(20)) || '.' || {kind} END AS name FROM {d.table("part")}"""
    if name == "messages":
        texts = ("x509: bad certificate", "dial: no such host", "unexpected HTTP 404", "got http 503 back", "tls: handshake failure", "http 418", "connection reset", "status 404", "xhttp 404", "HTTP 4040")
        return f"SELECT event_id, CASE event_id % {len(texts)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(texts)) + f" END AS message FROM {events}"
    if name == "availability":
        return f"""SELECT stream_code, input_priority AS rendition, CASE WHEN input_priority = 1 THEN CAST(0 AS BIGINT) ELSE min(ms) END AS avail_ms FROM ({view(d, "packets")}) p GROUP BY stream_code, input_priority"""
    if name == "frames":
        return f"""SELECT stream_code, {d.div("ms", "3600000")} AS segment, event_id, ms - (event_id % 4) * 10000 AS dts FROM ({view(d, "packets")}) p"""
    if name == "push_sessions":
        return f"SELECT stream_code, event_id, ms, CASE WHEN event_id % 6 = 0 THEN 'discontinuity' ELSE 'error' END AS ended FROM ({view(d, 'runs')}) r"
    if name == "profile_runs":
        return f"SELECT r.*, CAST({d.div('event_id', '7')} % 3 AS BIGINT) AS profile FROM ({view(d, 'runs')}) r"
    if name == "shapes":
        return f"""SELECT 'stream_' || CAST(s_nationkey AS VARCHAR(20)) AS code, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS BIGINT) AS pos,
          CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 + CASE WHEN s_suppkey % 6 = 5 THEN 1 ELSE 0 END AS BIGINT) AS priority,
          CASE s_suppkey % 4 WHEN 0 THEN 'copy://stream_' || CAST(s_suppkey % 30 AS VARCHAR(20)) WHEN 1 THEN 'mixer://stream_' || CAST(s_nationkey + s_suppkey % 3 AS VARCHAR(20)) || ',stream_9'
          ELSE ' rtmp://h/' || CAST(s_suppkey % 3 AS VARCHAR(20)) END AS url FROM {d.table("supplier")}"""
    if name == "ladders":
        return f"SELECT 'stream_' || CAST(n_nationkey AS VARCHAR(20)) AS code, CAST(n_nationkey % 3 AS BIGINT) AS rungs FROM {d.table('nation')}"
    if name in ("services_old", "services_new"):
        inner = view(d, "config_" + name[-3:])
        return f"SELECT k AS service, CASE WHEN k % 4 = 0 THEN NULL ELSE url END AS settings FROM ({inner}) c"
    if name == "updates":
        flags = zip(("special", "disabled", "topology", "profiles_updated", "profiles_moved", "inputs", "protocols", "push", "dvr"), (13, 11, 7, 3, 5, 2, 4, 9, 6))
        return "SELECT c_custkey AS stream, " + ", ".join(f"c_custkey % {n} = 0 AS {f}" for f, n in flags) + f" FROM {d.table('customer')}"
    if name == "profiles":
        return f"""SELECT p_brand AS stream_code, p_partkey AS idx, CAST(p_size * 16 AS BIGINT) AS width, CAST(p_size * 9 AS BIGINT) AS height,
          CASE WHEN p_partkey % 11 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(p_retailprice) AS BIGINT) END AS kbps, CASE p_partkey % 4 WHEN 0 THEN 'copy' WHEN 1 THEN 'h265' ELSE 'h264' END AS codec,
          p_brand LIKE '%5' AS video_copy, p_brand LIKE '%55' OR p_brand LIKE '%1' AS audio_copy, CASE WHEN p_brand LIKE '%3' THEN '' ELSE 'aac' END AS audio_codec, CAST(128 AS BIGINT) AS audio_kbps,
          CASE WHEN p_brand LIKE '%2' THEN CAST(60 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS gop, CAST(p_partkey % 4 AS BIGINT) AS step, CASE WHEN p_partkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(p_partkey % 60 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS rate,
          CASE WHEN p_brand LIKE '%4' THEN CAST(30 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS fps FROM {d.table("part")}"""
    if name == "snapshots":
        # chr() spells the braces, which both dialects' callers would read as names.
        return f"""SELECT stream_code, event_id, chr(123) || '"inputs":[' || chr(123) || '"status":"' || CASE WHEN event_id % 3 = 0 THEN 'degraded' ELSE 'active' END || '"' || chr(125) || ',' || chr(123) || '"status":"degraded"' || chr(125) || '],"switches":['
          || CASE WHEN event_id % 2 = 0 THEN chr(123) || '"reason":"timeout"' || chr(125) ELSE '' END || ']' || chr(125) AS snapshot FROM ({view(d, "packets")}) p"""
    if name == "bench_runs":
        letters = "CASE c_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C2' WHEN 3 THEN 'x' ELSE 'H' END"
        return f"SELECT {letters} || '-' || CAST(c_nationkey AS VARCHAR(20)) AS name FROM {d.table('customer')}"
    if name == "recordings":
        return f"SELECT o_orderkey AS id, 'stream_' || CAST(o_custkey % 10 AS VARCHAR(20)) AS stream_code, o_orderstatus AS status FROM {d.table('orders')}"
    if name == "clock_packets":
        return f"SELECT stream_code, event_id, ms, codec, ms - (event_id % 50) * 60000 AS dts, ms - (event_id % 30) * 90000 AS pts FROM ({view(d, 'packets')}) p"
    if name == "tracks":
        return f"SELECT stream_code, codec, event_id FROM ({view(d, 'packets')}) p"
    if name == "sourced_renditions":
        return f"SELECT stream_code, slug, 'stream_' || CAST(CAST(substr(stream_code, 7) AS BIGINT) % 10 AS VARCHAR(20)) AS audio_code FROM ({view(d, 'renditions')}) r"
    if name == "known_renditions":
        return f"SELECT stream_code, slug, kbps + 1 AS kbps FROM ({view(d, 'renditions')}) r WHERE idx % 4 = 0"
    if name == "whole_samples":
        return f"SELECT event_type AS metric, event_id, {d.ms('ts')} AS ms, {size} AS v FROM {events}"
    if name == "totals":
        return f"SELECT metric, event_id, ms, CAST(sum(v) OVER (PARTITION BY metric ORDER BY ms, event_id) AS BIGINT) AS total FROM ({view(d, 'whole_samples')}) w"
    if name == "configured_streams":
        return f"SELECT n_nationkey AS idx, CASE WHEN n_nationkey % 9 = 8 THEN n_name || ' x' WHEN n_nationkey % 7 = 6 THEN 'stream_0' ELSE 'stream_' || CAST(n_nationkey AS VARCHAR(20)) END AS code FROM {d.table('nation')}"
    if name == "config_hooks":
        return f"""SELECT c_custkey AS idx, CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE 'h' || CAST(c_custkey % 1000 AS VARCHAR(20)) END AS hook_id, CASE c_custkey % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'kafka' ELSE 'http' END AS kind,
          CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN '/var/log/x' ELSE 'https://h/x' END AS target, CAST(c_custkey % 10 - 1 AS BIGINT) AS max_retries, CAST(c_custkey % 12 - 1 AS BIGINT) AS timeout_sec, c_custkey % 8 = 0 AS both_lists
          FROM {d.table("customer")}"""
    if name == "mounts":
        return f"SELECT n_nationkey AS idx, CASE WHEN n_nationkey % 5 = 4 THEN 'a b' ELSE 'm' || CAST(n_nationkey % 10 AS VARCHAR(20)) END AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'rel' ELSE '/srv' END AS storage FROM {d.table('nation')}"
    raise KeyError(name)


def logical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical input as a DataFrame."""
    if (table := TABLES.get(name)) is None:
        return spark.sql(view(dialect.Spark, name))
    return spark.sql(view(dialect.Spark, name), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def with_views(d, names: tuple[str, ...], body: str) -> str:
    head = ",\n".join(f"{n} AS ({view(d, n)})" for n in names)
    return f"WITH RECURSIVE {head}\n{body}"
