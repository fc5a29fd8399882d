"""Exact order statistics of every coordinate of updates (cid, k, w), without sorting a coordinate.

The bits of a double, with the sign turned, are a whole number in the order of the values. The first 16 bits
make a histogram of each coordinate, combined in the task; its cumulative counts show in which bucket a rank
lies. Only values of such buckets are looked at again, by their next 16 bits, until a bucket is one value or
holds few. Equal values are counted, so ties are exact.

Defined results: nulls don't count; NaN is the largest value (as in a sort by numpy); -0 equals 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.storage import sized_join, written

#: Values of a bucket that may be sorted in one group instead of being split further.
FEW = 4096
STEP = 16


def _keyed(upd: DataFrame) -> DataFrame:
    """k, w and key: a whole number in the order of w."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            w = batch.column("w").to_numpy(zero_copy_only=False) + 0.0  # no negative zero
            w[np.isnan(w)] = np.nan  # one NaN, the positive one
            bits = w.view(np.int64)
            key = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(w), pa.array(key)], names=["k", "w", "key"])

    kind = upd.schema["k"].dataType.simpleString()
    return upd.select("k", F.col("w").cast("double").alias("w")).where("w is not null").mapInArrow(run, f"k {kind}, w double, key long")


def at_ranks(upd: DataFrame, ranks: DataFrame) -> DataFrame:
    """k, r and w: the value of rank r (from 0) of coordinate k, for distinct (k, r) below its number of values."""
    rows = _keyed(upd)
    state = ranks.select("k", "r", F.lit(0).cast("long").alias("parent"), F.col("r").cast("long").alias("left"))
    for shift in range(64 - STEP, -1, -STEP):
        # The first histogram has one parent a coordinate; a parent has at most 2 ** STEP buckets.
        parent = F.lit(0).cast("long") if shift == 64 - STEP else F.shiftright("key", shift + STEP)
        hist = rows.groupBy("k", parent.alias("parent"), F.shiftright("key", shift).alias("bucket")).agg(F.count("*").alias("n"), F.first("w").alias("w"))
        upto = F.sum("n").over(Window.partitionBy("k", "parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        found = hist.withColumn("before", upto - F.col("n")).join(state, ["k", "parent"]).where("before <= left and left < before + n")
        found = written(found.select("k", "r", F.col("bucket").alias("parent"), (F.col("left") - F.col("before")).alias("left"), "n", "w"), "selected")
        if shift == 0:
            return found.select("k", "r", "w")
        most = found.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        state = found.drop("n", "w")
        boundary = found.select("k", F.col("parent").alias("bucket")).distinct()
        rows = sized_join(rows.withColumn("bucket", F.shiftright("key", shift)), boundary, ["k", "bucket"])
        if most <= FEW:
            few = rows.groupBy("k", F.col("bucket").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("key", "w"))).alias("of"))
            return few.join(state, ["k", "parent"]).select("k", "r", F.element_at("of", (F.col("left") + 1).cast("int"))["w"].alias("w"))
        rows = written(rows.drop("bucket"), "boundary")
    raise AssertionError


def _sizes(upd: DataFrame) -> DataFrame:
    """k and m, its number of values; written, as both sides of the joins come from it."""
    return written(upd.where("w is not null").groupBy("k").agg(F.count("*").alias("m"), F.max(F.isnan(F.col("w").cast("double"))).alias("nan")), "sizes")


def coordinate_median(upd: DataFrame) -> DataFrame:
    """k and w: the middle value, or the mean of the two in the middle; NaN where there is one. A coordinate of nulls
    alone has null."""
    sizes = _sizes(upd)
    middle = F.array_distinct(F.array(F.floor((F.col("m") - 1) / 2), F.floor(F.col("m") / 2)))
    found = at_ranks(upd, sizes.select("k", F.explode(middle).alias("r")))
    mid = found.groupBy("k").agg(F.min("w").alias("lo"), F.max("w").alias("hi")).join(sizes, "k")
    # Halves first only where the sum would overflow.
    mean = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.when(F.abs("lo") + F.abs("hi") < 1e308, (F.col("lo") + F.col("hi")) / 2).otherwise(F.col("lo") / 2 + F.col("hi") / 2))
    known = mid.select("k", F.when(F.col("nan"), F.lit(float("nan"))).otherwise(mean).alias("w"))
    return upd.select("k").distinct().join(known, "k", "left")


def trimmed_mean(upd: DataFrame, trim: float = 0.1) -> DataFrame:
    """Per coordinate the mean without the largest and least max(1, int(m x trim)) of its m values; null if none is
    left. Copies of a value at the cut stay as far as they lie inside it."""
    sizes = _sizes(upd).withColumn("cut", F.greatest(F.lit(1), F.floor(F.col("m") * F.lit(trim)))).withColumn("kept", F.col("m") - 2 * F.col("cut"))
    ends = sizes.where("kept > 0")
    found = at_ranks(upd, ends.select("k", F.explode(F.array_distinct(F.array("cut", F.col("m") - F.col("cut") - 1))).alias("r")))
    span = written(found.groupBy("k").agg(F.min("w").alias("lo"), F.max("w").alias("hi")).join(ends, "k").drop("nan"), "span")
    w = F.col("w").cast("double")
    sums = sized_join(upd.where("w is not null"), span, ["k"]).groupBy("k").agg(
        F.coalesce(F.sum(F.when((w > F.col("lo")) & (w < F.col("hi")), w)), F.lit(0.0)).alias("inner"), F.count_if(w <= F.col("lo")).alias("upto"), F.count_if(w < F.col("hi")).alias("below"),
        *[F.first(c).alias(c) for c in ("lo", "hi", "m", "cut", "kept")],
    )
    least, most = F.least("upto", F.col("m") - F.col("cut")) - F.col("cut"), F.col("m") - F.col("cut") - F.col("below")
    mean = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.col("inner") + F.col("lo") * least + F.col("hi") * most) / F.col("kept"))
    return upd.select("k").distinct().join(sums.select("k", mean.alias("w")), "k", "left")
