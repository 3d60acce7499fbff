"""Viewers: addresses, session keys and names. All functions are over columns and take nulls as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fingerprint

__all__ = ["client_address", "country", "credited", "fingerprint", "label", "named", "without_port"]


def without_port(address: Column) -> Column:
    """host of host:port or [host]:port; anything else, such as a bare IPv6 address, as it is."""
    bracketed = F.regexp_extract(address, r"^\[([^\[\]]*)\]:[^:\[\]]*$", 1)
    plain = F.regexp_extract(address, r"^([^:\[\]]*):[^:\[\]]*$", 1)
    return F.when(address.rlike(r"^\[[^\[\]]*\]:[^:\[\]]*$"), bracketed).when(address.rlike(r"^[^:\[\]]*:[^:\[\]]*$"), plain).otherwise(address)


def client_address(forwarded: Column, real: Column, remote: Column) -> Column:
    """Head of X-Forwarded-For, then X-Real-IP, then the remote address, each without its port."""
    forwarded, real = (F.trim(F.coalesce(c, F.lit(""))) for c in (forwarded, real))
    head = without_port(F.trim(F.regexp_replace(forwarded, "(?s)^([^,]+),.*$", "$1")))
    return F.when(head != "", head).when(without_port(real) != "", without_port(real)).otherwise(without_port(F.coalesce(remote, F.lit(""))))


def label(key: Column) -> Column:
    return F.substring(key, 1, 8)


def named(token: Column, key: Column) -> dict[str, Column]:
    """named_by and user_name of a session: its token, else the label of its key."""
    has = F.coalesce(token, F.lit("")) != ""
    return {"named_by": F.when(has, "token").otherwise("fingerprint"), "user_name": F.when(has, token).otherwise(label(key))}


def credited(status: Column, size: Column) -> Column:
    """Bytes that count: those of answers of 200 to 299."""
    return F.when(status.between(200, 299), size).otherwise(F.lit(0)).cast("long")


def country(rows: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Add the country of the range (low, high, country) that holds ``key``; ranges do not overlap; empty where there is none."""
    joined = rows.join(ranges, F.col(key).between(F.col("low"), F.col("high")), "left")
    return joined.withColumn("country", F.coalesce("country", F.lit(""))).drop("low", "high")
