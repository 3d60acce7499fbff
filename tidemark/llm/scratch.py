"""Shared working tables.

Lineage is cut by writing a table to the folder that the session names in
``spark.checkpoint.dir``, which every executor and the driver can reach, so a lost executor costs a
re-read and never a result.  Only where that setting is absent and the session runs within one machine
(local tests) a temporary folder of this machine stands in for it; a cluster without the setting is refused.

Tables that only led to later ones are removed with `release`, all that a session still holds with `clean`.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder's URI, without a slash at its end."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or _local_folder()).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_folder(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


#: Paths by application, to be removed by `clean`.
_made: dict[str, set[str]] = {}


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*staged: DataFrame) -> None:
    """Remove staged tables; nothing that is still to run may read them."""
    for df in staged:
        path = df._tidemark_path
        _remove(df.sparkSession, path)
        _made.get(df.sparkSession.sparkContext.applicationId, set()).discard(path)


def clean(spark: SparkSession) -> None:
    """Remove all that this application has left in the shared folder; results that read it must be done."""
    for path in _made.pop(spark.sparkContext.applicationId, set()):
        _remove(spark, path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what is run inside; texts may be very long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: The most rows and bytes of an Arrow batch, and rows that the Parquet reader decodes at a time.
SHORT = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 1000,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
    "spark.sql.parquet.columnarReaderBatchSize": 512,
}


def short_batches(spark: SparkSession) -> SparkSession:
    """The session, from now on with batches of at most the sizes of SHORT (a row is never divided).

    Texts may be very long, and frames that are run by the caller can't be run under `arrow_rows`.
    """
    for name, most in SHORT.items():
        if not 0 < int(spark.conf.get(name).rstrip("bB")) <= most:
            spark.conf.set(name, most)
    return spark


#: The most bytes of rows that are sent to all tasks.
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """Bytes that a row takes in a broadcast table, about."""
    size = F.lit(16 + 16 * len(df.columns)).cast("long")
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 16 * F.coalesce(F.size(F.col(f.name)), F.lit(0))
    return size


def small_side(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the staged ``df`` has at most so many rows and bytes; else leave it to a shuffle."""
    rows = df.limit(max_rows + 1)
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df
