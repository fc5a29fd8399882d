"""Exact sampling by thresholds on digests, without ranking the rows.

Every row has a digest (hexadecimal, of its key). A histogram of the digests' first digits, combined in the task,
shows in which cell a rank lies; only rows of such cells are looked at again, by their next digits, until a
cell holds few. The boundary is the row at that rank, and what lies before it is told by a comparison where
each row is.

Keys (and so digests) are distinct within a group; of repeated rows all or none lie before a boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.storage import sized_join, written

#: Rows of a cell that may be sorted in one group, and hexadecimal digits of each histogram.
FEW, DIGITS, ALL_DIGITS = 4096, 3, 64


def boundaries(rows: DataFrame, ranks: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """group, r, by and key: the row at rank r (from 0) in the order of (by, key) of rows (group, by, key); ranks
    (group, r) beyond the last row have none."""
    state = ranks.select(*group, "r", F.lit("").alias("prefix"), F.col("r").cast("long").alias("left"))
    for start in range(0, ALL_DIGITS, DIGITS):
        hist = rows.groupBy(*group, F.substring("by", 1, start).alias("prefix"), F.substring("by", 1, start + DIGITS).alias("cell")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*group, "prefix").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))  # 4096 cells at most
        found = hist.withColumn("before", upto - F.col("n")).join(state, [*group, "prefix"]).where("before <= left and left < before + n")
        found = written(found.select(*group, "r", F.col("cell").alias("prefix"), (F.col("left") - F.col("before")).alias("left"), "n"), "cells")
        most = found.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        state = found.drop("n")
        cells = found.select(*group, F.col("prefix").alias("cell")).distinct()
        rows = sized_join(rows.withColumn("cell", F.substring("by", 1, start + DIGITS)), cells, [*group, "cell"])
        if most <= FEW or start + DIGITS >= ALL_DIGITS:
            few = rows.groupBy(*group, F.col("cell").alias("prefix")).agg(F.array_sort(F.collect_list(F.struct("by", "key"))).alias("of"))
            at = F.element_at("of", (F.col("left") + 1).cast("int"))
            return written(few.join(state, [*group, "prefix"]).select(*group, "r", at["by"].alias("by"), at["key"].alias("key")), "boundaries")
        rows = written(rows.drop("cell"), "inside")
    raise AssertionError


def before(by: Column, key: Column, edge_by: Column, edge_key: Column) -> Column:
    """Whether a row lies before a boundary; with none (null) it does."""
    return edge_by.isNull() | (by < edge_by) | ((by == edge_by) & (key < edge_key))


def first_rows(rows: DataFrame, count: int, by: Column, key: str) -> DataFrame:
    """The ``count`` rows of least (by, key)."""
    if count <= 0:
        return rows.limit(0)
    keyed = rows.select(by.alias("by"), F.col(key).alias("key"))
    edge = boundaries(keyed, rows.sparkSession.range(count, count + 1).withColumnRenamed("id", "r")).select(F.col("by").alias("_by"), F.col("key").alias("_key"))
    edge = edge.agg(F.first("_by").alias("_by"), F.first("_key").alias("_key"))  # one row
    return rows.join(F.broadcast(edge)).where(before(by, F.col(key), F.col("_by"), F.col("_key"))).drop("_by", "_key")
