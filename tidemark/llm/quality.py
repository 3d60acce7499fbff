"""Quality rules for documents and for the hosts that they come from.

Each document's whole text is measured and fails or passes rules of its own.  Failures of every rule are
then added up by host.  A host's rate of failures is shrunk towards the rate of all hosts by a beta prior
whose strength is fitted to the spread of the hosts (method of moments: what the rates differ more than
chance alone would make them), so a host of few documents is not condemned by chance.  A host one of
whose shrunk rates passes the limit is rejected, and its verdict is joined back to its documents.

Only counts by host are shuffled, and only rejected hosts, which are few or else are joined by a shuffle,
meet the documents again.

Defined cases: a null text has no words (and so fails for its length); a null host is a host of its own;
repeated rows are separate documents; empty tables give no rows; `verdicts` reads the columns that are
named and no others, `kept_documents` carries all along, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import covered, uncovered
from .scratch import stage
from .words import raw_texts

MIN_WORDS = 10
#: Percent of words in repeated windows of WINDOW words that a document may have.
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Shrunk failure rate over which a host is rejected, and bounds of the prior's strength (in documents).
HOST_LIMIT = 0.5
WEAKEST, STRONGEST = 1.0, 1e6

#: Rules by name.  The first two fail the document itself, all count against its host.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > 3 * word_chars",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
OWN_RULES = ("short", "repeats")
#: n_lines: lines with a word.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SPACES = np.frombuffer(b" \t\n\v\f\r", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more in the text."""
    if len(words) <= window:
        return 0
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    n = len(ids) - window + 1
    # Equal windows have equal hashes, so a text without equal hashes is done.
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIXERS[0]
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n, np.uint64)
    for k in range(window):
        hashes += mixed[k : k + n] * _MIXERS[k % 5] << np.uint64(k // 5)
    hashes.sort()
    if not (hashes[1:] == hashes[:-1]).any():
        return 0
    # Exact names of windows of 1, 2, ... words.
    names = ids
    for k in range(1, window):
        longer = names[:-1] * len(ids) + ids[k:]
        names = np.unique(longer, return_inverse=True)[1]
    twice = (np.bincount(names) > 1)[names].astype(np.int64)
    cover = np.zeros(len(ids) + 1, np.int64)
    cover[:n] += twice
    cover[window:] -= twice
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(raw: bytes) -> tuple[int, int, int, int, int, int]:
    """The measures of a text, in the order of MEASURES."""
    words = raw.split()
    if not words:
        return 0, 0, int(np.isin(np.frombuffer(raw, np.uint8), _SYMBOLS).sum()), 0, 0, 0
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(raw) - int(by_byte[0x80:0xC0].sum()) - int(by_byte[_SPACES].sum())
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), chars, int(by_byte[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the measures; a column of their names is replaced."""
    kept = [f for f in docs.schema if f.name != text and f.name not in MEASURES]
    schema = T.StructType(kept + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(raw) for raw in raw_texts(batch.column(0))], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(rows[:, k]) for k in range(len(MEASURES)))], names=schema.names)

    return docs.select(F.col(text), *[f.name for f in kept]).mapInArrow(run, schema)


def base_failed() -> Column:
    return F.expr(" OR ".join(RULES[r] for r in OWN_RULES))


def host_rates(measures: DataFrame, host: str = "source") -> DataFrame:
    """One row a host: n_docs, failures and shrunk rate of each rule, ``host_rejected``."""
    counts = measures.groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.expr(f"CAST({rule} AS BIGINT)")).alias(f"{name}_failures") for name, rule in RULES.items()]
    )
    counts = stage(counts, "host-counts")
    rate = {name: F.col(f"{name}_failures") / F.col("n_docs") for name in RULES}
    # One row of sums, whatever the number of hosts.
    sums = counts.agg(
        F.sum("n_docs").alias("docs"), F.avg(F.lit(1.0) / F.col("n_docs")).alias("noise"),
        *[f(x).alias(f"{name}_{k}") for name, r in rate.items() for k, f, x in (("sum", F.sum, F.col(f"{name}_failures")), ("mean", F.avg, r), ("square", F.avg, r * r))],
    ).first()
    shrunk = {}
    for name in RULES:
        if not sums["docs"]:
            shrunk[name] = F.lit(0.0)
            continue
        mean, spread = sums[f"{name}_sum"] / sums["docs"], sums[f"{name}_square"] - sums[f"{name}_mean"] ** 2
        between = spread - mean * (1 - mean) * sums["noise"]
        strength = min(max(mean * (1 - mean) / between - 1, WEAKEST), STRONGEST) if between > 0 else STRONGEST
        shrunk[name] = (F.col(f"{name}_failures") + mean * strength) / (F.col("n_docs") + strength)
    rated = counts.withColumns({f"{name}_rate": r for name, r in shrunk.items()})
    return rated.withColumn("host_rejected", F.expr(" OR ".join(f"{name}_rate > {HOST_LIMIT}" for name in RULES)))


def rejected_hosts(measures: DataFrame, host: str = "source") -> DataFrame:
    """The hosts to reject, staged, so that its true size decides how it is joined."""
    return stage(host_rates(measures, host).where("host_rejected").select(F.col(host).alias("_rejected_host"), F.lit(True).alias("_rejected")), "hosts")


def verdicts(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, host, the measures, base_failed, kept."""
    measures = stage(measured(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("source"), F.col(text).alias("text"))), "measures")
    measures = measures.withColumn("base_failed", base_failed())
    judged = measures.join(rejected_hosts(measures), F.col("source").eqNullSafe(F.col("_rejected_host")), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("_rejected").isNull()).drop("_rejected_host", "_rejected")


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, in their own columns.

    Texts are measured twice, once for the hosts and once to filter, so that no text is shuffled.
    """
    hosts = rejected_hosts(measured(docs.select(F.col(host).alias("source"), F.col(text).alias("text"))))
    rows, own = covered(docs)
    place = docs.columns.index(text)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for raw in raw_texts(batch.column(place)):
                n, _, _, _, repeats, _ = measure(raw)
                keep.append(n >= MIN_WORDS and 100 * repeats <= MAX_REPEAT_PERCENT * n)
            yield batch.filter(pa.array(keep, pa.bool_()))

    kept = rows.mapInArrow(passing, rows.schema).join(hosts, F.col(own[host]).eqNullSafe(F.col("_rejected_host")), "left_anti")
    return uncovered(kept, docs)
