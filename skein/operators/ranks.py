"""Ranks without a task that sorts everything.

Rows fall into buckets that follow the order. Each bucket counts its rows, a running sum over the few buckets
gives every bucket its first rank, and a window ranks inside buckets. Buckets are functions of the row, so
rows need not be kept between the two readings.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bucket(digest: Column) -> Column:
    """4096 buckets of equal share in the order of hexadecimal digests."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def number_bucket(rows: DataFrame, column: str, parts: int = 64) -> Column:
    """About ``parts`` buckets of equal share in the order of a numeric column, nulls first."""
    bounds = rows.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 2000).alias("b")).first()["b"] or []
    known = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else None
    if known is None:
        return F.lit(0)
    return F.when(F.col(column).isNull(), -1).otherwise(F.size(F.filter(known, lambda b: b < F.col(column))))


#: Texts that are sampled at most (about twice as many in bad luck) to find splitters, and rows for a bucket.
SAMPLED, BUCKET_ROWS, MOST_BUCKETS = 20_000, 100_000, 1024


def text_bucket(rows: DataFrame, column: str, parts: int | None = None) -> Column:
    """About ``parts`` buckets (by default one for BUCKET_ROWS rows, 64 at least) of equal share in the order of a text
    column, nulls first, whatever prefix the texts share. Splitters come from a sample by hash of bounded size; any
    splitters give the same ranks."""
    total = rows.count()
    parts = parts or min(MOST_BUCKETS, max(64, total // BUCKET_ROWS))
    share = min(1.0, SAMPLED / max(total, 1))
    some = rows.where(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = sorted(r[0].encode() for r in some.where(F.col(column).isNotNull()).select(column).collect())  # SAMPLED, about
    splitters = sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []
    if not splitters:
        return F.when(F.col(column).isNull(), -1).otherwise(0)
    known = F.array(*[F.lit(x.decode()) for x in splitters])
    # Halving, as the splitters are in order: about ten comparisons a row.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(splitters).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= len(splitters)) & (F.element_at(known, F.least(low + step, F.lit(len(splitters)))) < F.col(column)), low + step).otherwise(low))
    return F.when(F.col(column).isNull(), -1).otherwise(at)


def ranked(rows: DataFrame, order: list[Column], buckets: list[Column], group: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """``rows`` with their rank from 0 by ``order`` within ``group``; ``buckets`` must follow that order."""
    named = [f"_bucket{i}" for i in range(len(buckets))]
    keys = [*group, *named]
    dealt = rows.select("*", *[b.alias(n) for b, n in zip(buckets, named, strict=True)])
    inside = dealt.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    counts = dealt.groupBy(*keys).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    first = counts.withColumn("_first", F.sum("_n").over(upto.orderBy(*named).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    joined = inside.join(first, reduce(and_, [inside[k].eqNullSafe(first[k]) for k in keys]))
    return joined.select(*[inside[c] for c in rows.columns], (F.col("_first") + F.col("_inside") - 1).cast("long").alias(name))

