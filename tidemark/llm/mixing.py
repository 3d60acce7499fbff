"""Mixing sources to target weights: capped water-filling with seeded repetition. DataFrame operations only.

*Water-filling.*  Sources share a budget of words by weight, but none may pass ``max_epochs`` times its
own size.  Clamping the sources above their cap, resharing the excess by weight and repeating until no
source is above ends at one water level ``v``: a source gets ``min(cap, v * weight)``.  A source is
clamped in some round exactly if its cap / weight lies under that level, so the rounds are run in order
of cap / weight, each as a row of one ordered pass over the table of sources: the row's level is what
is left after all caps before it, shared by the weights from it on.  The table of sources has one row a source.

*Sampling.*  A source with target / size = w + f gives each document w times, and once more to the
documents that come first in a seeded order of all its documents until they hold f of its words.  Where
that order crosses the mark is found in two steps, so that no source is ever sorted as a whole: words by
(source, slice of the hash range) place the mark in one slice, and only that slice is ordered; slices are
as many as keep one of them at about SLICE_ROWS rows.  At last one document a source changes sides where
that brings the source nearer to its target.

Defined cases: a null text has no words and is a document of size 0 (taken 0); a null source is a source
of its own, ranked last; rows that share a doc_id (or, with a
null doc_id, a text) are separate documents that are taken equally often; an empty table, or one without words,
gives targets of 0.  `mix` reads the three columns that are named and no others; `mixed_rows` carries all
columns along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import covered, uncovered
from .scratch import stage
from .words import WORD

#: Weights by rank of the source, repeated.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Documents of a slice of the hash range, about: slices are named by the first hexadecimal digits of a hash, 3 to 8.
SLICE_ROWS = 1 << 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def ranked_weight(rank: Column, weights: tuple[int, ...] = WEIGHTS) -> Column:
    """The weight of the source with this rank, from 0."""
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights)).cast("int") + 1)


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Add ``target`` (double) to one row a source with ``source_size``, ``weight`` and ``_mix_rank``.

    ``share`` times the total size is the budget; what no source can hold is left over.  The level that a
    round would set rises from round to round while sources are clamped and falls after that, so the
    level at which clamping ends is the highest.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("_mix_ratio", "_mix_rank")
    cap = F.col("source_size") * max_epochs
    rounds = (
        sources.withColumn("_mix_ratio", cap.cast("double") / F.col("weight"))
        .withColumn("_mix_left", F.sum("source_size").over(everything) * share - F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_mix_level", F.col("_mix_left") / F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_mix_level", F.max("_mix_level").over(everything))
    )
    target = F.when(F.col("_mix_ratio") < F.col("_mix_level"), cap.cast("double")).otherwise(F.col("_mix_level") * F.col("weight"))
    return rounds.withColumn("target", target).drop("_mix_ratio", "_mix_left", "_mix_level")


def source_targets(sized: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """Per source: ``source_size``, ``weight`` by rank in code-point order with null last, ``target``."""
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    sizes = sized.groupBy(source).agg(F.sum(size).alias("source_size")).withColumn("_mix_rank", rank)
    return water_fill(sizes.withColumn("weight", ranked_weight(F.col("_mix_rank"))))


def _order(text: Column, doc_id: Column, seed: str) -> Column:
    identity = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null "), F.coalesce(text, F.lit(""))))
    return F.md5(F.concat(F.lit(seed + ":"), identity))


def _sized(docs: DataFrame, text: str, source: str, doc_id: str, seed: str) -> DataFrame:
    """The one pass over the texts, staged: doc_id, source, size and place in the seeded order."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _order(F.col(text), F.col(doc_id), seed).alias("_mix_order"))
    return stage(rows, "mix-sizes")


def slice_digits(rows: int) -> int:
    return min(8, max(3, -(-max(rows // SLICE_ROWS, 1).bit_length() // 4)))


def _extra() -> Column:
    """Whether a document has one more turn than the whole ones, from its order and its source's marks."""
    return F.coalesce(F.col("_mix_order") <= F.col("_mix_upto"), F.lit(False))


def _times() -> Column:
    extra = _extra() != F.coalesce(F.col("_mix_order") == F.col("_mix_turn"), F.lit(False))
    return F.col("_mix_whole") + extra.cast("long")


def _marks(sized: DataFrame, max_epochs: int) -> DataFrame:
    """Staged, one row a source (``_mix_s``): its size, its target, and what `_times` needs of it."""
    slim = sized.select(F.col("source").alias("_mix_source"), "size", "_mix_order").withColumn("_mix_slice", F.substring("_mix_order", 1, slice_digits(sized.count())))
    epochs = F.coalesce(F.least(F.try_divide("target", "source_size"), F.lit(float(max_epochs))), F.lit(0.0))
    targets = stage(source_targets(slim, "_mix_source"), "mix-targets")
    targets = targets.select(
        F.col("_mix_source").alias("_mix_s"), "source_size", "target",
        F.floor(epochs).alias("_mix_whole"), ((epochs - F.floor(epochs)) * F.col("source_size")).alias("_mix_mark"),
    )
    same_source = F.col("_mix_source").eqNullSafe(F.col("_mix_s"))

    running = Window.partitionBy("_mix_source").orderBy("_mix_slice")
    slices = slim.groupBy("_mix_source", "_mix_slice").agg(F.sum("size").alias("_mix_words"))
    slices = slices.withColumn("_mix_end", F.sum("_mix_words").over(running)).withColumn("_mix_start", F.col("_mix_end") - F.col("_mix_words"))
    # The one slice a source that the mark falls into; all slices before it are taken whole.
    cuts = slices.join(targets, same_source).where("_mix_start < _mix_mark and _mix_mark <= _mix_end")
    cuts = stage(cuts.select("_mix_s", F.col("_mix_slice").alias("_mix_cut"), (F.col("_mix_mark") - F.col("_mix_start")).alias("_mix_inside")), "mix-cuts")
    # In it, a document is taken while the middle of its words lies before the mark, so the mark is missed by
    # half a document at most.
    within = Window.partitionBy("_mix_source").orderBy("_mix_order", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = slim.join(cuts, same_source & (F.col("_mix_slice") == F.col("_mix_cut"))).withColumn("_mix_to", F.sum("size").over(within))
    last = ordered.where("2 * _mix_to - size <= 2 * _mix_inside").groupBy("_mix_source").agg(F.max("_mix_order").alias("_mix_last"))
    # Hashes of earlier slices sort before the bare name of the slice, and hashes of the slice after it.
    upto = cuts.join(last, same_source, "left").select("_mix_s", F.coalesce("_mix_last", "_mix_cut").alias("_mix_upto"))
    marks = stage(targets.join(upto.withColumnRenamed("_mix_s", "_mix_source"), same_source, "left").drop("_mix_source"), "mix-marks")

    # What is still missing or too much is mended by one document a source: the one whose turn in or out of
    # the extra pass leaves the least.
    drawn = slim.join(marks, same_source).withColumn("_mix_extra", _extra())
    off = drawn.groupBy("_mix_source").agg((F.first("target") - F.sum((F.col("_mix_whole") + F.col("_mix_extra").cast("long")) * F.col("size"))).alias("_mix_off"))
    off = stage(off.select(F.col("_mix_source").alias("_mix_s"), "_mix_off"), "mix-off")
    turned = F.when(F.col("_mix_extra"), -F.col("size")).otherwise(F.col("size"))
    rest = F.abs(F.col("_mix_off") - turned)
    turns = drawn.where("_mix_mark > 0").drop("_mix_s").join(off, same_source).where(rest < F.abs("_mix_off"))
    turns = turns.groupBy("_mix_source").agg(F.min(F.struct(rest.alias("rest"), "_mix_order"))["_mix_order"].alias("_mix_turn"))
    return stage(marks.join(turns, same_source, "left").drop("_mix_source"), "mix-turns")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, ``size``, ``source_size``, ``target``, ``times`` (repetitions) and ``taken`` (words taken).

    Texts are read once.
    """
    sized = _sized(docs, text, source, doc_id, seed)
    drawn = sized.join(_marks(sized, max_epochs), F.col("source").eqNullSafe(F.col("_mix_s"))).withColumn("times", _times())
    return drawn.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, in the columns of ``docs``."""
    marks = _marks(_sized(docs, text, source, doc_id, seed), max_epochs)
    rows, own = covered(docs)
    rows = rows.withColumn("_mix_order", _order(F.col(own[text]), F.col(own[doc_id]), seed))
    drawn = rows.join(marks, F.col(own[source]).eqNullSafe(F.col("_mix_s"))).withColumn("_mix_times", _times()).where("_mix_times > 0")
    return uncovered(drawn.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times").cast("int")))), docs)
