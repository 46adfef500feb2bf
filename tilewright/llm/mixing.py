"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash; a source's share of a budget is all its documents below a hash threshold. The threshold
is found without sorting: sizes are summed by source and hash bucket, the bucket in which the budget ends is the
only one that is split again by the next hash bits, until it holds a single hash. Thresholds are nested: a larger
budget takes a superset.

Cases: null text or a text without words has size 0; null sources form one source, the last; rows with equal
doc_id have equal hashes and are taken together, and so are null ids; very long texts count whole; an empty table gives
an empty result; other columns are ignored by `mix` and kept by `mixed_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, quoted, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: The hash has 60 bits, found 10 at a time: at most 1024 histogram rows for a source and level, however large it is.
LEVEL_BITS, LEVELS = 10, 6


def doc_hash(doc_id: Column | str = "doc_id") -> Column:
    """60 bits of the md5 of the id in decimal, the same in any engine."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target): targets fill up in proportion to weights until most * source_size.

    There is one row per source here, already summed; the level at which uncapped sources stop is found by running
    sums over the sources in the order in which they reach their caps.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)) + 1)
    sources = sources.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - capped) / left
    sources = sources.withColumn("level", level)
    stop = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every)
    return sources.select("source", "source_size", "weight", F.least("cap", F.coalesce(stop * F.col("weight"), "cap")).alias("target"))


def mix_bounds(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source of rows (source, h, size): its target, whole passes, and the hash where the last pass ends.

    A source whose target is k whole passes and a rest takes every document k times and those below its
    threshold once more; the document on the boundary is taken if that brings the source nearer to its target.
    """
    targets = source_targets(rows, weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = materialize(targets.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-targets")
    bound = targets.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("at_bound"))
    for level in range(LEVELS):
        bound = materialize(_refine(rows, bound, LEVEL_BITS * (LEVELS - 1 - level)), "mix-bound")
    ends = bound.select(F.col("source").alias("of"), F.col("prefix").alias("end"), (F.col("at_bound") <= 2 * F.col("rest")).alias("with_end"))
    return targets.join(ends, F.col("source").eqNullSafe(F.col("of"))).select("of", "source_size", "target", "passes", "end", "with_end")


def _times(h, size_of=F.col):
    more = (h < size_of("end")) | ((h == size_of("end")) & size_of("with_end"))
    return (size_of("passes") + more.cast("long")).cast("long")


def _small(bounds: DataFrame) -> DataFrame:
    """Broadcast one row per source only while there are few; else the join shuffles."""
    return F.broadcast(bounds) if bounds.count() <= 100_000 else bounds


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, h, size, source_size, target, times, taken): how many times the mix takes each document."""
    rows = materialize(docs.select("doc_id", "source", doc_hash().alias("h"), word_count(F.col("text")).alias("size")), "mix-sizes")
    out = rows.join(_small(mix_bounds(rows, weights, share, most)), F.col("source").eqNullSafe(F.col("of")))
    out = out.withColumn("times", _times(F.col("h")))
    return out.select("doc_id", "source", "h", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The documents as the mix takes them: none, one or more rows each, with their own columns; texts stay where they are."""
    rows = materialize(docs.select("source", doc_hash().alias("h"), word_count(F.col("text")).alias("size")), "mix-sizes")
    bounds = mix_bounds(rows, weights, share, most)
    names = {c: fresh(docs, f"mix_{c}") for c in bounds.columns}
    bounds = _small(bounds.toDF(*names.values()))
    out = docs.join(bounds, F.col("source").eqNullSafe(F.col(names["of"])))
    times, copy = _times(doc_hash(), lambda c: F.col(names[c])), fresh(docs, "mix_copy")
    return out.select(*[quoted(c) for c in docs.columns], F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias(copy)).drop(copy)


def _refine(rows: DataFrame, bound: DataFrame, shift: int) -> DataFrame:
    """The bucket, one level finer, in which each source's rest ends, and what is left of the rest in it.

    A rest that no bucket exceeds ends after the last one.
    """
    b = bound.select(F.col("source").alias("of"), "rest", "prefix")
    bucket = F.shiftright("h", shift)
    inside = rows.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("n"))  # summed before it meets the bounds
    inside = inside.join(b, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("bucket", LEVEL_BITS) == F.col("prefix")))
    run = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    # The last bucket of all stands in where no bucket passes the rest: nothing is above it, so the order ends there.
    found = inside.withColumn("run", run).groupBy("source").agg(
        F.min(F.when(F.col("run") > F.col("rest"), F.struct("bucket", (F.col("rest") - F.col("run") + F.col("n")).alias("rest"), "n"))).alias("x"),
        F.max(F.struct("bucket", (F.col("rest") - F.col("run") + F.col("n")).alias("rest"), "n")).alias("last"),
    )
    x = F.coalesce("x", "last")
    return found.select("source", x["rest"].alias("rest"), x["bucket"].alias("prefix"), x["n"].alias("at_bound"))
