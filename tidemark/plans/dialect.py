"""One statement in two dialects: Spark SQL for the engine, DuckDB's SQL as its oracle."""

from __future__ import annotations


class Spark:
    """Words that differ; tables are given to ``spark.sql`` as DataFrames."""

    table = staticmethod(lambda name: "{" + name + "}")
    div = staticmethod(lambda a, b: f"(({a}) div {b})")
    ms = staticmethod(lambda ts: f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")
    matches = staticmethod(lambda s, p: f"regexp_like({s}, '{p}')")
    sha = staticmethod(lambda s: f"sha2({s}, 256)")
    array = staticmethod(lambda *x: f"array({', '.join(x)})")
    strings = staticmethod(lambda: "CAST(array() AS ARRAY<STRING>)")
    size = staticmethod(lambda x: f"size({x})")
    agg = staticmethod(lambda x, sep, order: f"listagg({x}, {sep}) WITHIN GROUP (ORDER BY {order})")
    item = staticmethod(lambda x, sep, n: f"split_part({x}, '{sep}', {n})")
    json_long = staticmethod(lambda x, key: f"CAST(get_json_object({x}, '$.{key}') AS BIGINT)")
    ith = staticmethod(lambda values, n: f"element_at(array_sort(collect_list({values})), CAST({n} AS INT))")
    newline = "chr(10)"


class Duck:
    table = staticmethod(lambda name: name)
    div = staticmethod(lambda a, b: f"(({a}) // {b})")
    ms = staticmethod(lambda ts: f"(epoch_us({ts}) // 1000)")
    matches = staticmethod(lambda s, p: f"regexp_matches({s}, '{p}')")
    sha = staticmethod(lambda s: f"sha256({s})")
    array = staticmethod(lambda *x: f"[{', '.join(x)}]")
    strings = staticmethod(lambda: "CAST([] AS VARCHAR[])")
    size = staticmethod(lambda x: f"len({x})")
    agg = staticmethod(lambda x, sep, order: f"string_agg({x}, {sep} ORDER BY {order})")
    item = staticmethod(lambda x, sep, n: f"split_part({x}, '{sep}', {n})")
    json_long = staticmethod(lambda x, key: f"CAST(json_extract({x}, '$.{key}') AS BIGINT)")
    ith = staticmethod(lambda values, n: f"list_extract(list_sort(list({values})), CAST({n} AS INT))")
    newline = "chr(10)"
