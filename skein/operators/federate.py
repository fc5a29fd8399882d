"""Combining client updates (cid, k, w, n, loss): weighted, fair and robust."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.robust import distances, krum_scores
from skein.operators.selection import coordinate_median, trimmed_mean

__all__ = ["METHODS", "add_scaled", "aggregate", "clip_update", "coordinate_median", "distances", "fedavg", "flattened", "krum", "krum_scores", "qfedavg", "trimmed_mean", "unflattened"]


def fedavg(upd: DataFrame) -> DataFrame:
    """Weighted by n; without any n the first client's weights."""
    total = F.sum("n")
    return upd.groupBy("k").agg(F.when(total > 0, F.sum(F.col("w") * F.col("n")) / total).otherwise(F.min_by("w", "cid")).alias("w"))


def qfedavg(upd: DataFrame, q: float = 0.3, alpha: float = 1.0, tau: float = 1e-3) -> DataFrame:
    """Weighted by n ** alpha x (loss + tau) ** q."""
    weight = F.pow(F.col("n").cast("double"), F.lit(alpha)) * F.pow(F.col("loss") + tau, F.lit(q))
    rows = upd.withColumn("wt", weight)
    return rows.groupBy("k").agg((F.sum(F.col("w") * F.col("wt")) / (F.sum("wt") + 1e-10)).alias("w"))


def krum(upd: DataFrame, f: int = 1) -> DataFrame:
    """The weights of the client of least score; with fewer than 2 f + 3 clients the weighted mean."""
    if upd.select("cid").distinct().count() < 2 * f + 3:
        return fedavg(upd)
    winner = krum_scores(upd, f).orderBy(F.round("score", 9), "cid").limit(1).select("cid")  # rounding noise breaks no tie
    return upd.join(F.broadcast(winner), "cid", "left_semi").select("k", "w")


METHODS = {"fedavg": fedavg, "qfedavg": qfedavg, "krum": krum, "trimmed_mean": trimmed_mean, "median": coordinate_median}


def aggregate(upd: DataFrame, method: str, **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown aggregation {method!r}; there are {', '.join(METHODS)}")
    return METHODS[method](upd, **options)


def clip_update(upd: DataFrame, most: float = 1.0) -> DataFrame:
    """Each client's whole update scaled to a norm of at most ``most``."""
    norms = upd.groupBy("cid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scale = F.when(F.col("norm") > most, F.lit(most) / F.col("norm")).otherwise(1.0)
    return upd.join(norms, "cid").select("cid", "k", (F.col("w") * scale).alias("w"))


def flattened(parts: DataFrame) -> DataFrame:
    """Matrices (cid, path, i, j, w) as one vector a client (cid, k, w): paths in order, each row by row."""
    shapes = parts.groupBy("path").agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("cols"))  # one row a matrix
    sizes = shapes.withColumn("size", F.col("rows") * F.col("cols"))
    offsets = sizes.withColumn("first", F.sum("size").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    place = F.col("first") + F.col("i") * F.col("cols") + F.col("j")
    return parts.join(F.broadcast(offsets), "path").select("cid", place.cast("long").alias("k"), "w")


def unflattened(upd: DataFrame, shapes: list[tuple[str, int, int]]) -> DataFrame:
    """The inverse, given (path, rows, columns) in order of path."""
    first, known = 0, []
    for path, rows, cols in sorted(shapes):
        known.append((path, first, first + rows * cols, cols))
        first += rows * cols
    table = upd.sparkSession.createDataFrame(known, "path string, first long, last long, cols long")
    at = F.col("k") - F.col("first")
    return upd.join(F.broadcast(table), (F.col("k") >= F.col("first")) & (F.col("k") < F.col("last"))).select("cid", "path", F.floor(at / F.col("cols")).cast("long").alias("i"), (at % F.col("cols")).cast("long").alias("j"), "w")


def add_scaled(a: DataFrame, b: DataFrame, scale: float) -> DataFrame:
    """a + scale x b over (k, w); what b lacks counts as 0."""
    return a.join(b.select("k", F.col("w").alias("w2")), "k", "left").select("k", (F.col("w") + scale * F.coalesce("w2", F.lit(0.0))).alias("w"))
