"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, hnsw, jaccard, langid, lengths, mixing, packing, planes, quality, warc
from .scratch import new_path, short_batches

QUERIES: dict = {}
ORACLES: dict = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return short_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


ORACLES["op1_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null ' || coalesce(text, ''))) AS ord,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM sizes),
weighted AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
ratios AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM weighted),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
     - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
     / CAST(sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ratios),
filled AS (SELECT source, source_size, ratio, weight, max(level) OVER () AS level FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN ratio < level THEN CAST(3 * source_size AS DOUBLE) ELSE level * weight END AS target
  FROM filled),
epochs AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(target / source_size, 3.0::DOUBLE) END AS e FROM targets),
marks AS (SELECT source, source_size, target, CAST(floor(e) AS BIGINT) AS whole, (e - floor(e)) * source_size AS mark FROM epochs),
placed AS (
  SELECT s.*, m.source_size, m.target, m.whole, m.mark,
         sum(size) OVER (PARTITION BY s.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN marks m ON s.source IS NOT DISTINCT FROM m.source),
lasts AS (SELECT source, max(ord) AS last FROM placed WHERE mark > 0 AND 2 * upto - size <= 2 * mark GROUP BY source),
drawn AS (SELECT p.*, coalesce(p.ord <= l.last, FALSE) AS extra FROM placed p LEFT JOIN lasts l ON p.source IS NOT DISTINCT FROM l.source),
offs AS (SELECT *, target - sum((whole + CAST(extra AS BIGINT)) * size) OVER (PARTITION BY source) AS off FROM drawn),
rests AS (SELECT *, abs(off - CASE WHEN extra THEN -size ELSE size END) AS rest FROM offs),
turns AS (
  SELECT source, ord AS turn FROM (
    SELECT source, ord, row_number() OVER (PARTITION BY source ORDER BY rest, ord) AS k FROM rests WHERE mark > 0 AND rest < abs(off))
  WHERE k = 1)
SELECT doc_id, size, source_size, target, times * size AS taken, times, source FROM (
  SELECT r.doc_id, r.size, r.source_size, r.target, r.source,
         r.whole + CASE WHEN r.extra <> coalesce(r.ord = t.turn, FALSE) THEN 1 ELSE 0 END AS times
  FROM rests r LEFT JOIN turns t ON r.source IS NOT DISTINCT FROM t.source)
"""


@_query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 4096 tokens."""
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "round", "bucket", "partition_bins", "partition_bound")


@_query
def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantiles and truncated totals of all documents for every length as a context limit."""
    return lengths.limit_table(lengths.length_histogram(_table(spark, sf_dir, "documents")))


@_query
def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as shards of byte planes and read back."""
    folder = new_path(spark, "planes")
    return planes.read_shards(spark, folder, planes.write_shards(_table(spark, sf_dir, "documents"), folder))


@_query
def op5_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, own failure and final verdict of all documents."""
    return quality.verdicts(_table(spark, sf_dir, "documents"))


ORACLES["op5_host_quality"] = r"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT r, doc_id, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM raw),
positions AS (SELECT r, unnest(generate_series(1, len(w))) AS i, w FROM split),
windows AS (SELECT r, i, len(w) AS n, CASE WHEN i + 4 <= len(w) THEN array_to_string(w[i:i + 4], ' ') END AS win FROM positions),
counted AS (SELECT r, i, win IS NOT NULL AND count(*) OVER (PARTITION BY r, win) > 1 AS twice FROM windows),
covered AS (SELECT r, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM counted),
repeats AS (SELECT r, sum(CAST(inside AS BIGINT)) AS n_repeat_words FROM covered GROUP BY r),
measures AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM split LEFT JOIN repeats USING (r)),
failures AS (
  SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2, 10 * n_symbols > 3 * word_chars AS f3, 10 * n_dup_lines > 3 * n_lines AS f4
  FROM measures),
long AS (SELECT source, unnest([1, 2, 3, 4]) AS rule, unnest([f1, f2, f3, f4]) AS f FROM failures),
hosts AS (SELECT source, rule, sum(CAST(f AS DOUBLE)) AS k, CAST(count(*) AS DOUBLE) AS n FROM long GROUP BY source, rule),
moments AS (
  SELECT rule, sum(k) / sum(n) AS m, avg((k / n) * (k / n)) - avg(k / n) * avg(k / n) AS spread, avg(1.0::DOUBLE / n) AS noise FROM hosts GROUP BY rule),
priors AS (
  SELECT rule, m, CASE WHEN spread - m * (1 - m) * noise > 0
    THEN least(greatest(m * (1 - m) / (spread - m * (1 - m) * noise) - 1, 1.0::DOUBLE), 1e6::DOUBLE) ELSE 1e6::DOUBLE END AS s
  FROM moments),
verdicts AS (SELECT source, bool_or((k + m * s) / (n + s) > 0.5) AS rejected FROM hosts JOIN priors USING (rule) GROUP BY source)
SELECT doc_id, f.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND NOT rejected AS kept
FROM failures f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source
"""


@_query
def op10_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that quotes the template, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    quoting = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    folder = new_path(spark, "chat")
    return chat.read_summaries(spark, folder, chat.write_examples(turns.unionByName(quoting), folder))


ORACLES["op10_prefix_targets"] = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
clean AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns),
sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n,
         14 + length(replace(replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ': ', '\: '))
            + length(replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>')) AS chars
  FROM clean),
running AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars,
       CAST(count(*) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS n_examples
FROM running GROUP BY conv_id
"""


@_query
def op3_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of all documents, at 3-word shingles and 90 percent."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back through the data source."""
    folder = new_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.page_captures(spark, folder)


ORACLES["op6_warc_archives"] = """
WITH hashed AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM hashed GROUP BY payload_digest),
judged AS (
  SELECT h.*, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS revisit, first
  FROM hashed h JOIN firsts USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN first END AS refers_to
FROM judged
"""


@_query
def op9_sharded_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every fiftieth vector among all others."""
    return hnsw.nearest(_table(spark, sf_dir, "embeddings"))


@_query
def op4_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    return langid.identify(_table(spark, sf_dir, "documents"))
