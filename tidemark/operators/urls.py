"""Addresses: kinds, push-listen hosts, copy and mixer grammar, paths, tokens, listings.

Column functions give null for a null address; operators over DataFrames keep all other columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: File extensions of videos that a listing shows.
VIDEO_EXTENSIONS = ("mp4", "m4v", "mov", "mkv", "webm", "avi", "flv", "ts", "mts", "m2ts", "mpg", "mpeg", "wmv", "3gp")
#: Schemes that name one kind each.
KINDS = {
    "rtmp": "rtmp", "rtmps": "rtmp", "srt": "srt", "udp": "udp", "rtsp": "rtsp", "rtsps": "rtsp", "file": "file", "publish": "publish", "copy": "copy", "mixer": "mixer",
}

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_BAD = r"[\x00-\x1f\x7f]|%([^0-9A-Fa-f]|$|[0-9A-Fa-f]([^0-9A-Fa-f]|$))"


def parts(url: Column) -> dict[str, Column]:
    """scheme (lower case), authority, user, host, port, path, query, fragment and malformed."""
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1))
    rest = F.regexp_replace(url, _SCHEME, "")
    fragment = F.regexp_extract(rest, "(?s)#(.*)$", 1)
    body = F.regexp_replace(rest, "(?s)#.*$", "")
    query = F.regexp_extract(body, r"(?s)[?](.*)$", 1)
    body = F.regexp_replace(body, r"(?s)[?].*$", "")
    authority = F.regexp_extract(body, "(?s)^//([^/]*)", 1)
    path = F.when(body.startswith("//"), F.regexp_replace(body, "(?s)^//[^/]*", "")).otherwise(body)
    hostport = F.regexp_replace(authority, "(?s)^.*@", "")
    host = F.when(hostport.startswith("["), F.regexp_extract(hostport, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(hostport, ":[^:]*$", ""))
    port = F.regexp_extract(hostport, r":([^:\]]*)$", 1)
    malformed = F.regexp_replace(url, r"(?s)[?][^#]*", "").rlike(_BAD) | port.rlike("[^0-9]") | hostport.rlike(r"[ <>\"]") | (hostport.startswith("[") & ~hostport.rlike(r"^\[[^\]]*\](:[0-9]*)?$"))
    malformed = malformed | url.startswith(":")
    return {"scheme": scheme, "authority": authority, "hostport": hostport, "host": host, "port": port, "path": path, "query": query, "fragment": fragment, "malformed": malformed}


def kind(url: Column) -> Column:
    """Protocol kind of an address by its scheme; a bare path is a file."""
    p = parts(url)
    named = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), p["scheme"])
    web = F.when(F.lower(p["path"]).rlike("[.]m3u8?$"), "hls").otherwise("unknown")
    bare = F.when(url.startswith("/"), "file").otherwise("unknown")
    found = F.when(p["scheme"].isin("http", "https"), web).when(p["scheme"] == "", bare).otherwise(F.coalesce(named, F.lit("unknown")))
    return F.when(url.isNotNull(), F.when(p["malformed"], "unknown").otherwise(found))


def listens(url: Column) -> Column:
    """Whether a push is awaited: publish, or a push scheme whose host is empty, unspecified or a loopback address."""
    p = parts(url)
    four = p["host"].rlike(r"^(0\.0\.0\.0|127(\.(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])){3})$")
    six = F.lower(p["host"]).rlike(r"^(0{0,4}:){2,7}0{0,3}[01]?$") | F.lower(p["host"]).rlike(r"^(0{0,4}:){2,6}ffff:(127(\.[0-9]{1,3}){3}|0\.0\.0\.0)$")
    local = p["scheme"].isin("rtmp", "rtmps", "srt") & ((p["host"] == "") | four | six)
    return ~p["malformed"] & ((p["scheme"] == "publish") | local)


def reader(url: Column) -> Column:
    """Which reader takes the address: push, a kind, or error."""
    return F.when(listens(url), "push").when(kind(url) == "unknown", "error").otherwise(kind(url))


def upstreams(rows: DataFrame, url: str = "url") -> DataFrame:
    """copy and mixer addresses with first_code, second_code, goes_on (without audio) and the reason why one is refused, or ok."""
    p = parts(F.col(url))
    copy = p["scheme"] == "copy"
    codes = F.split(p["hostport"], ",")
    first, second = F.get(codes, F.lit(0)), F.get(codes, F.lit(1))
    pairs = F.filter(F.split(p["query"], "&"), lambda x: x != "")
    names = F.transform(pairs, lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    values = F.transform(pairs, lambda x: F.regexp_extract(x, "(?s)=(.*)$", 1))
    reason = (
        F.when(p["malformed"], "malformed").when(p["authority"].contains("@"), "userinfo").when(~p["path"].isin("", "/"), "path")
        .when(copy & (p["query"] != ""), "query").when(p["fragment"] != "", "fragment").when(p["hostport"] == "", "missing")
        .when(copy & p["hostport"].contains(":"), "port").when(copy, "ok").when(F.size(codes) != 2, "two codes").when(first == "", "no video")
        .when(second == "", "no audio").when(p["hostport"].contains(":"), "port").when(F.exists(names, lambda x: x != "audio_failure"), "unknown parameter")
        .when(F.size(pairs) > 1, "repeated parameter").when(~F.coalesce(F.get(values, F.lit(0)), F.lit("")).isin("continue", "down", ""), "bad value").otherwise("ok")
    )
    rows = rows.where(p["scheme"].isin("copy", "mixer")).withColumns({"kind": p["scheme"], "reason": reason})
    good = F.col("reason") == "ok"
    return rows.withColumns({
        "first_code": F.when(good, first), "second_code": F.when(good & ~copy, second), "goes_on": good & ~copy & (F.coalesce(F.get(values, F.lit(0)), F.lit("")) == "continue"),
    })


def media_proto(path: Column) -> Column:
    """hls or dash by the extension of a path's last element, else empty."""
    extension = F.lower(F.regexp_extract(path, "[.]([^./]*)$", 1))
    return F.when(extension.isin("m3u8", "ts"), "hls").when(extension.isin("mpd", "m4s", "mp4"), "dash").otherwise("")


def path_code(path: Column) -> Column:
    """The stream code of a path: its first element if another follows, as it is spelt, else empty."""
    return F.regexp_extract(path, "(?s)^/?([^/]+)/", 1)


def query_token(query: Column) -> Column:
    """The first token of a query string, decoded and trimmed; empty without one."""
    pairs = F.filter(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)) == "token")
    value = F.regexp_replace(F.regexp_extract(F.get(pairs, F.lit(0)), "(?s)=(.*)$", 1), "[+]", " ")
    return F.coalesce(F.trim(F.try_url_decode(value)), F.lit(""))


def unseen(polls: DataFrame) -> DataFrame:
    """Of (stream_code, poll, sequence) the rows whose sequence lies above all that earlier polls of the stream saw."""
    earlier = Window.partitionBy("stream_code").orderBy("poll").rangeBetween(Window.unboundedPreceding, -1)
    return polls.withColumn("seen", F.max("sequence").over(earlier)).where("seen IS NULL OR sequence > seen").drop("seen")


def holders(claims: DataFrame) -> DataFrame:
    """Who holds each push key of (push_key, id): the first to claim it."""
    return claims.groupBy("push_key").agg(F.min("id").alias("holder"))


def listing(files: DataFrame) -> DataFrame:
    """Place of each directory and video of (mount, name, is_dir) in its mount's list: directories first, then by name."""
    shown = files.where(F.col("is_dir") | F.lower(F.regexp_extract("name", "[.]([^.]*)$", 1)).isin(*VIDEO_EXTENSIONS))
    order = Window.partitionBy("mount").orderBy(F.desc("is_dir"), "name")
    return shown.withColumn("place", F.row_number().over(order).cast("long"))


def resolved(rows: DataFrame, base: str = "base", ref: str = "ref") -> DataFrame:
    """Add ``url``, the reference as seen from the base address; an absolute one stays as it is."""
    @F.pandas_udf("string")
    def join(bases: pd.Series, refs: pd.Series) -> pd.Series:
        from urllib.parse import urljoin

        return pd.Series([r if b is None or r is None or r.startswith(("http://", "https://")) else urljoin(b, r) for b, r in zip(bases, refs)], dtype=object)

    return rows.withColumn("url", join(F.col(base), F.col(ref)))
