"""Configurations of streams: validation, differences, plans of updates, and what runs.

Configuration tables are small; the operators are joins and windows by stream all the same. Comparisons are
null-safe: a change between null and a value is a change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the longest stream code.
LONGEST_CODE = 128


def code_problem(code: Column) -> Column:
    """What is wrong with a stream code, or ok; white space around it does not count."""
    bare = F.regexp_replace(F.coalesce(code, F.lit("")), r"^\s+|\s+$", "")
    return F.when(bare == "", "required").when(F.octet_length(bare) > LONGEST_CODE, "too long").when(~bare.rlike("^[a-zA-Z0-9_]+$"), "bad characters").otherwise("ok")


def status(streams: DataFrame, running: DataFrame) -> DataFrame:
    """Streams (code, disabled) with the state of those that run (code, viewers, errors)."""
    joined = streams.select("code", "disabled").join(running, "code", "left")
    state = F.when(F.col("disabled"), "stopped").when(F.col("viewers").isNull(), "idle").when(F.col("errors") > 0, "degraded").otherwise("active")
    return joined.withColumn("status", state).withColumn("viewers", F.coalesce("viewers", F.lit(0).cast("long"))).drop("errors")


def running(hits: DataFrame) -> DataFrame:
    """(code, viewers, errors) of streams that are watched."""
    return hits.groupBy(F.col("stream_code").alias("code")).agg(F.countDistinct("user_id").alias("viewers"), F.count_if(F.col("http_status") >= 500).alias("errors"))


def rolled_up(inputs: DataFrame) -> DataFrame:
    """Per stream of (code, status, crashing): stopped if nothing runs, degraded if its transcoder crashes or no input is healthy, else active."""
    runs, healthy = F.bool_or(F.col("status") != "stopped"), F.bool_or(~F.col("status").isin("degraded", "stopped"))
    state = F.when(~runs, "stopped").when(~healthy | F.bool_or("crashing"), "degraded").otherwise("active")
    return inputs.groupBy("code").agg(state.alias("status"), F.count(F.lit(1)).alias("inputs"))


def difference(old: DataFrame, new: DataFrame, key: str | list[str], *values: str) -> DataFrame:
    """(key, change): added, removed and updated rows of two tables, by key and the values that count."""
    keys = [key] if isinstance(key, str) else key
    o = old.select(*keys, F.struct(*values).alias("_old"), F.lit(True).alias("_o"))
    n = new.select(*keys, F.struct(*values).alias("_new"), F.lit(True).alias("_n"))
    both = o.join(n, keys, "full_outer").where("_o IS NULL OR _n IS NULL OR NOT (_old <=> _new)")
    return both.select(*keys, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("updated").alias("change"))


def profile_difference(old: DataFrame, new: DataFrame, touched: DataFrame, value: str = "url") -> DataFrame:
    """Changes of lists by position (stream, pos); ``touched`` streams had a change that restarts all they kept."""
    changed = difference(old, new, ["stream", "pos"], value)
    kept = old.select("stream", "pos").join(new.select("stream", "pos"), ["stream", "pos"]).join(touched.select("stream").distinct(), "stream", "left_semi")
    return changed.unionByName(kept.withColumn("change", F.lit("updated"))).distinct()


def positioned(rows: DataFrame, order: str = "k") -> DataFrame:
    """Add the place (from 1) of each row in its stream's list."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("stream").orderBy(order)).cast("long"))


def stream_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per stream: whether the number of its rows and whether any of them (k, url) changed; digests stand for the lists."""
    digest = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("k", "url")).alias("x"), F.sum(F.xxhash64("url", "k").cast("decimal(38,0)")).alias("y")]
    o, n = (t.groupBy("stream").agg(F.struct(*digest).alias(name)) for t, name in ((old, "o"), (new, "w")))
    return o.join(n, "stream", "full_outer").select("stream", (~F.col("o.n").eqNullSafe(F.col("w.n"))).alias("count_changed"), (~F.col("o").eqNullSafe(F.col("w"))).alias("inputs_changed"))


def reconciled(old: DataFrame, new: DataFrame, key: str, value: str, startable: Column) -> DataFrame:
    """What to do with each row to get from the stored to the wanted table; new rows that can't start are only stored."""
    o, n = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_o")), new.withColumn("_new", F.col(value)).withColumn("_starts", startable).select(key, "_new", "_starts", F.lit(True).alias("_n"))
    action = F.when(F.col("_n").isNull(), "delete").when(F.col("_o").isNull(), F.when(F.col("_starts"), "start").otherwise("store")).when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    return o.join(n, key, "full_outer").select(key, action.alias("action"))


#: The flags of an update and what each leads to, in order; the first three leave nothing else to do.
FLAGS = ("special", "disabled", "topology", "profiles_updated", "profiles_moved", "inputs", "protocols", "push", "dvr")


def update_plan(changes: DataFrame) -> DataFrame:
    """(stream, actions): the steps of an update in order, from the flags of FLAGS (special: a copied or mixed ladder)."""
    f = {name: F.coalesce(F.col(name), F.lit(False)) for name in FLAGS}
    steps = F.concat(
        F.when(f["profiles_updated"] | f["profiles_moved"], F.array(F.lit("profiles"))).otherwise(F.array()),
        F.when(f["profiles_updated"], F.array(F.lit("master"))).otherwise(F.array()),
        F.when(f["inputs"], F.array(F.lit("inputs"))).otherwise(F.array()),
        F.when(f["profiles_moved"], F.array(F.lit("hls and dash"))).otherwise(F.array()),
        F.when(f["protocols"] | f["push"], F.array(F.lit("protocols"))).otherwise(F.array()),
        F.when(f["dvr"], F.array(F.lit("dvr"))).when(f["profiles_moved"], F.array(F.lit("dvr if moved"))).otherwise(F.array()),
    )
    whole = F.when(f["special"] & f["disabled"], F.array(F.lit("stop"))).when(f["special"], F.array(F.lit("stop"), F.lit("start"))).when(f["disabled"], F.array(F.lit("stop"))).when(f["topology"], F.array(F.lit("reload")))
    return changes.select("stream", F.array_join(F.coalesce(whole, steps), ",").alias("actions"))


def service_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(service, action) of two states (service, settings; a service without settings is off): start, stop, restart or none."""
    joined = old.select("service", F.col("settings").alias("_old")).join(new.select("service", F.col("settings").alias("_new")), "service", "full_outer")
    was, now = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    return joined.select("service", F.when(was & ~now, "stop").when(~was & now, "start").when(was & now & (F.col("_old") != F.col("_new")), "restart").otherwise("none").alias("action"))


def shape_verdicts(inputs: DataFrame, ladders: DataFrame) -> DataFrame:
    """(code, verdict) of streams with inputs (code, pos, url) that copy or mix others; ``ladders`` (code, rungs) are the known upstreams.

    An unknown upstream skips the rule that needs it.
    """
    from . import urls

    parsed = urls.upstreams(inputs)
    known = ladders.select(F.col("code").alias("first_code"), (F.col("rungs") > 0).alias("ladder"))
    n = inputs.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    own = parsed.join(known, "first_code", "left").join(n, "code")
    copies, mixes = F.col("kind") == "copy", F.col("kind") == "mixer"
    ruled = own.groupBy("code").agg(
        F.bool_or(copies & F.coalesce(F.col("first_code") == F.col("code"), F.lit(False))).alias("self_copy"),
        F.bool_or(copies & F.coalesce("ladder", F.lit(False)) & (F.col("n") > 1)).alias("ladder_not_alone"),
        F.bool_or(mixes & (F.col("n") > 1)).alias("mixer_not_alone"),
        F.bool_or(mixes & F.coalesce((F.col("first_code") == F.col("code")) | (F.col("second_code") == F.col("code")), F.lit(False))).alias("self_mix"),
    )
    verdict = F.when(F.col("self_copy"), "self copy").when(F.col("ladder_not_alone"), "ladder not alone").when(F.col("mixer_not_alone"), "mixer not alone").when(F.col("self_mix"), "self mix").otherwise("ok")
    return ruled.select("code", verdict.alias("verdict"))


def duplicate_inputs(inputs: DataFrame) -> DataFrame:
    """(code, url, times) of addresses that a stream has more than once, white space around them aside."""
    bare = F.regexp_replace("url", r"^\s+|\s+$", "")
    return inputs.groupBy("code", bare.alias("url")).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def misplaced_inputs(inputs: DataFrame) -> DataFrame:
    """(code, pos, priority) of inputs whose priority is not their place (from 0) in the stream's list."""
    return inputs.where(~F.col("priority").eqNullSafe(F.col("pos"))).select("code", "pos", "priority")


def bootable(streams: DataFrame, inputs: DataFrame) -> DataFrame:
    """Codes of streams that are not disabled and have an input."""
    return streams.where(~F.coalesce("disabled", F.lit(False))).join(inputs.select("code").distinct(), "code", "left_semi").select("code")


def config_errors(streams: DataFrame, inputs: DataFrame, hooks: DataFrame, mounts: DataFrame) -> DataFrame:
    """(path, problem) of a whole configuration: streams (idx, code), inputs (code, pos, priority, url), hooks (idx, hook_id, kind, target,
    max_retries, timeout_sec, both_lists) and mounts (idx, name, storage)."""

    def said(rows: DataFrame, section: str, field: str, problem: Column) -> DataFrame:
        path = F.concat(F.lit(section + "["), F.col("idx").cast("string"), F.lit("]" + field))
        return rows.withColumn("problem", problem).where("problem IS NOT NULL").select(path.alias("path"), "problem")

    def repeated(key: str) -> Column:
        return F.row_number().over(Window.partitionBy(key).orderBy("idx")) > 1

    target = F.regexp_replace(F.coalesce("target", F.lit("")), r"^\s+|\s+$", "")
    codes = streams.withColumn("own", code_problem(F.col("code"))).withColumn("again", repeated("code"))
    numbers = streams.select("idx", "code")
    wrong = numbers.join(misplaced_inputs(inputs).select("code").distinct(), "code", "left_semi")
    twice = numbers.join(duplicate_inputs(inputs).select("code").distinct(), "code", "left_semi")
    ids = hooks.withColumn("again", repeated("hook_id"))
    names = mounts.withColumn("again", repeated("name"))
    found = [
        said(codes, "streams", ".code", F.when(F.col("own") != "ok", F.col("own")).when(F.col("again"), "duplicate")),
        said(wrong, "streams", ".inputs", F.lit("priority is not the place")), said(twice, "streams", ".inputs", F.lit("duplicate url")),
        said(ids, "hooks", ".id", F.when(F.trim(F.coalesce("hook_id", F.lit(""))) == "", "required").when(F.col("again"), "duplicate")),
        said(hooks, "hooks", ".target", F.when(target == "", "required").when(F.col("kind") == "http", F.when(~target.rlike("^https?://"), "not http"))
             .when(F.col("kind") == "file", F.when(~target.startswith("/"), "not absolute")).otherwise("unsupported type")),
        said(hooks, "hooks", ".max_retries", F.when(F.col("max_retries") < 0, "below 0")), said(hooks, "hooks", ".timeout_sec", F.when(F.col("timeout_sec") < 0, "below 0")),
        said(hooks, "hooks", ".stream_codes", F.when(F.col("both_lists"), "only and except")),
        said(names, "vod", ".name", F.when(~F.coalesce("name", F.lit("")).rlike("^[a-zA-Z0-9_-]+$"), "bad characters").when(F.col("again"), "duplicate")),
        said(mounts, "vod", ".storage", F.when(~F.coalesce("storage", F.lit("")).startswith("/"), "not absolute")),
    ]
    return reduce(DataFrame.unionByName, found)


_LISTENER = "enabled:boolean,port:int"
#: The global section of a configuration document.
GLOBAL = (
    "server struct<http_addr:string,cors:struct<allowed_origins:array<string>,allow_credentials:boolean>>, buffer struct<capacity:int>, hooks struct<worker_count:int>, log struct<level:string,format:string>, "
    "publisher struct<hls:struct<dir:string,live_segment_sec:int>,dash:struct<dir:string,live_segment_sec:int>>, "
    f"listeners struct<rtmp:struct<{_LISTENER}>,rtsp:struct<{_LISTENER}>,srt:struct<{_LISTENER},latency_ms:int>>"
)


def global_errors(texts: DataFrame) -> DataFrame:
    """Add ``path`` and ``problem`` of the global section of documents (JSON text): a row each; sections that are not there have none."""
    rows = texts.withColumn("_g", F.from_json(F.get_json_object("text", "$.global_config"), GLOBAL))

    def at(path: str) -> Column:
        return F.col(f"_g.{path}")

    def number(path: str) -> Column:
        return F.coalesce(at(path), F.lit(0))

    address, level, form = (F.coalesce(at(p), F.lit("")) for p in ("server.http_addr", "log.level", "log.format"))
    hls, dash = (F.coalesce(at(f"publisher.{k}.dir"), F.lit("")) for k in ("hls", "dash"))
    rules = {
        "server.http_addr": F.when(at("server").isNotNull(), F.when(F.trim(address) == "", "required").when(~address.rlike(r"^([^:\[\]]*|\[[^\[\]]*\]):[^:\[\]]*$"), "not host:port")),
        "server.cors.allow_credentials": F.when(at("server.cors.allow_credentials") & F.array_contains(at("server.cors.allowed_origins"), "*"), "with any origin"),
        "buffer.capacity": F.when(at("buffer").isNotNull() & (number("buffer.capacity") <= 0), "not above 0"),
        "publisher.hls.live_segment_sec": F.when(at("publisher.hls.live_segment_sec") < 0, "below 0"),
        "publisher.dash.live_segment_sec": F.when(at("publisher.dash.live_segment_sec") < 0, "below 0"),
        "publisher.dash.dir": F.when((hls != "") & (hls == dash), "same as hls"),
        "hooks.worker_count": F.when(at("hooks").isNotNull() & (number("hooks.worker_count") <= 0), "not above 0"),
        "log.level": F.when(~F.lower(level).isin("", "debug", "info", "warn", "error"), "unknown"),
        "log.format": F.when(~F.lower(form).isin("", "text", "json"), "unknown"),
        "listeners.srt.latency_ms": F.when(at("listeners.srt.latency_ms") < 0, "below 0"),
    }
    for name in ("rtmp", "rtsp", "srt"):
        port = number(f"listeners.{name}.port")
        rules[f"listeners.{name}.port"] = F.when(at(f"listeners.{name}.enabled"), F.when(port == 0, "required").when(~port.between(1, 65535), "not a port"))
    found = F.filter(F.array(*[F.struct(F.lit(f"global_config.{p}").alias("path"), c.alias("problem")) for p, c in rules.items()]), lambda r: r["problem"].isNotNull())
    return rows.withColumn("_e", F.explode(found)).select(*texts.columns, "_e.path", "_e.problem")


def best_inputs(inputs: DataFrame) -> DataFrame:
    """(code, id) of the input to play, of (code, id, priority, status, override): a healthy override, else the healthy one of least priority."""
    healthy = inputs.where(~F.col("status").isin("degraded", "stopped"))
    rank = F.struct((~F.coalesce(F.col("override") == F.col("priority"), F.lit(False))).alias("other"), "priority", "id")
    return healthy.groupBy("code").agg(F.min_by("id", rank).alias("id"))


def media_summaries(inputs: DataFrame, tracks: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per stream: the active input (else the first), its tracks and kbps, and the outputs', which mirror the input without a transcoder."""
    rank = F.struct((F.col("status") != "active").alias("idle"), "priority", "id")
    active = inputs.groupBy("code").agg(F.min_by("id", rank).alias("input_id"))

    def summed(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_tracks"), F.sum("kbps").alias(f"{name}_kbps"))

    joined = active.join(summed(tracks, "input_id", "input"), "input_id", "left").join(summed(outputs, "code", "output"), "code", "left")
    zero = F.lit(0).cast("long")
    ins = {c: F.coalesce(c, zero) for c in ("input_tracks", "input_kbps")}
    return joined.select("code", "input_id", *[e.alias(c) for c, e in ins.items()], *[F.coalesce(f"output_{c}", ins[f"input_{c}"]).alias(f"output_{c}") for c in ("tracks", "kbps")])


def input_states(inputs: DataFrame, stale_ms: int) -> DataFrame:
    """(stream_code, input_priority, status): active if the last packet (ms) is at most ``stale_ms`` before now_ms, else degraded, also without one."""
    last = inputs.groupBy("stream_code", "input_priority").agg(F.max("ms").alias("last"), F.max("now_ms").alias("now_ms"))
    return last.select("stream_code", "input_priority", F.when(F.col("now_ms") - F.col("last") <= stale_ms, "active").otherwise("degraded").alias("status"))


def documents(texts: DataFrame, section: str, shape: str) -> DataFrame:
    """Entries of one section of configuration documents (JSON text, each an object of objects by key): key and the fields of ``shape``."""
    held = F.from_json(F.get_json_object("text", f"$.{section}"), f"map<string,struct<{shape}>>")
    return texts.select(F.explode(held).alias("key", "entry")).select("key", "entry.*")


def recordings_of(recordings: DataFrame, stream_code: str) -> DataFrame:
    return recordings.where(F.col("stream_code") == stream_code)
