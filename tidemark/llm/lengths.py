"""Token counts as an exact length histogram.

Documents are encoded, counted by encoded length and forgotten.  Running sums over the histogram, which
has one row for each distinct length and not for each document, then answer for every context limit how
many documents and tokens fit, how many are longer, and how many tokens stay if longer ones are cut.

Defined cases: a null or empty text has length 0; repeated rows count each; an empty table gives an empty
histogram; columns other than the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .words import raw_texts


def encoded_lengths(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) of each Arrow batch, to be added up."""
    path = vocabulary or tokens.vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            found, times = np.unique(np.fromiter((len(encoder.ids(raw)) // 4 for raw in raw_texts(batch.column(0))), np.int64, batch.num_rows), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], names=["n_tokens", "n_docs"])

    return docs.select(F.col(text)).mapInArrow(count, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, **how) -> DataFrame:
    """One row a distinct length: n_tokens, n_docs."""
    return encoded_lengths(docs, **how).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit: what fits, what is longer, and what is left if that is cut.

    docs_longer and tokens_longer are suffix sums; docs_within / n_docs of all is the length's quantile.
    """
    upward = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero, held = F.lit(0).cast("long"), F.col("n_tokens") * F.col("n_docs")
    table = histogram.select(
        "n_tokens", "n_docs", F.sum("n_docs").over(upward).alias("docs_within"), F.sum(held).over(upward).alias("tokens_within"),
        F.coalesce(F.sum("n_docs").over(onward), zero).alias("docs_longer"), F.coalesce(F.sum(held).over(onward), zero).alias("tokens_longer"),
    )
    return table.withColumn("truncated_total", F.col("tokens_within") + F.col("docs_longer") * F.col("n_tokens")).withColumn(
        "quantile", F.col("docs_within") / (F.col("docs_within") + F.col("docs_longer"))
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: tokens that stay if every document is cut to ``limit``, and documents that are cut."""
    return histogram.agg(
        F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
    )


def length_quantile(table: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least the share ``q`` of documents does not pass."""
    return table.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
