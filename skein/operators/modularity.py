"""Communities by modularity as rounds of merges over a contracted edge table.

An edge table of communities has a row for every two that are linked, with the number of edges between them.
In a round every community names the neighbour it would gain most from joining. Communities are told apart by
the flip of a coin (a hash of seed, round and community): those on one side join those on the other that they
named, as long as the sum of all that name the same one still leaves each of them a gain, or two that named
each other join. So every merge raises modularity, a hub takes all its leaves in a few rounds, and no round needs
a row to know more than its own neighbours. The edge table shrinks with every round; it ends when no pair
would gain.

Defined results: loops and null ends don't count, repeated edges count once; a node without edges is a community
of its own; a community's label is its least node; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.storage import removed, sized_join, written

#: Rounds in which nothing merges, by bad luck of the coin, before the search ends anyway.
IDLE = 64


def _gain(w: Column, d: Column, other: Column, m: float) -> Column:
    """What modularity gains when two communities of degrees d and other with w edges between them join."""
    return w / m - d * other / (2.0 * m * m)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def modularity_communities(edges: DataFrame, nodes: DataFrame, seed: int = 42) -> DataFrame:
    """id, label of every node."""
    links = written(edges.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct().withColumn("w", F.lit(1).cast("long")), "links")
    degrees = written(_both(links).groupBy("a").agg(F.sum("w").alias("d")), "degrees")
    labels = written(nodes.select("id").distinct().select("id", F.col("id").alias("c")), "labels")
    m, idle, turn = float(links.count()), 0, 0
    while m:
        turn += 1
        side = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), F.col("a")), F.lit(2)) == 0
        rows = sized_join(_both(links), degrees, ["a"])
        rows = sized_join(rows, degrees.select(F.col("a").alias("b"), F.col("d").alias("other")), ["b"])
        rows = rows.withColumn("gain", _gain(F.col("w"), F.col("d"), F.col("other"), m)).where("gain > 1e-15")
        # Of equal gains the least pair, so that two communities agree on which is best.
        best = F.max_by(F.struct("b", "w", "d", "other", "gain"), F.struct(F.col("gain"), -F.least("d", "other"), F.xxhash64(F.least("a", "b"), F.greatest("a", "b")))).alias("x")
        named = written(rows.groupBy("a").agg(best).select("a", "x.*", side.alias("joins")), "named")
        if named.isEmpty():
            removed(named)
            break
        others = named.select(F.col("a").alias("b"), F.col("b").alias("named"), F.col("joins").alias("b_joins"))
        met = sized_join(named, others, ["b"]).withColumn("mutual", F.col("a") == F.col("named"))
        asking = written(met.where("joins and not b_joins"), "asking")
        # A lower bound: links among those that join the same community only add.
        sums = asking.groupBy("b").agg(F.sum("d").alias("sum"), F.count("*").alias("n"))
        enough = _gain(F.col("w"), F.col("d"), F.col("other") + F.col("sum") - F.col("d"), m) > 0
        moves = written(asking.join(sums, "b").where(enough | F.col("mutual") & (F.col("n") == 1)).select("a", "b"), "moves")
        if moves.isEmpty():  # too many ask for the same: those that were named in turn go alone
            removed(moves)
            moves = written(asking.where("mutual").select("a", "b"), "moves")
        idle = 0 if not moves.isEmpty() else idle + 1
        if idle > IDLE:
            break
        old = [links, degrees, labels]
        if idle == 0:
            to = lambda c: moves.select(F.col("a").alias(c), F.col("b").alias(f"{c}_to"))
            moved = sized_join(sized_join(links, to("a"), ["a"], "left"), to("b"), ["b"], "left").select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y"), "w").where("x <> y")
            degrees = written(sized_join(degrees, to("a"), ["a"], "left").groupBy(F.coalesce("a_to", "a").alias("a")).agg(F.sum("d").alias("d")), "degrees")
            labels = written(sized_join(labels, to("c"), ["c"], "left").select("id", F.coalesce("c_to", "c").alias("c")), "labels")
            links = written(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")), "links")
        for table in [named, asking, moves, *(old if idle == 0 else [])]:
            removed(table)
    least = labels.groupBy("c").agg(F.min("id").alias("label"))
    return labels.join(least, "c").select("id", "label")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """modularity: the share of edges inside communities (id, label) less what degrees alone would put there."""
    pairs = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    of = lambda c, name: labels.select(F.col("id").alias(c), F.col("label").alias(name))
    rows = pairs.join(of("u", "x"), "u").join(of("v", "y"), "v")
    ends = rows.select(F.explode(F.array("x", "y")).alias("label"), (F.col("x") == F.col("y")).cast("double").alias("inside"))
    per = ends.groupBy("label").agg(F.count("*").alias("d"), (F.sum("inside") / 2).alias("inside"))
    total = per.agg(F.sum("d").alias("twice"))
    return per.join(F.broadcast(total)).agg(F.sum(F.col("inside") * 2 / F.col("twice") - F.pow(F.col("d") / F.col("twice"), F.lit(2.0))).alias("modularity"))  # one row and one row a community
