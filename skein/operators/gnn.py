"""Graph networks as relational plans: one forward pass or one gradient over a graph of any size.

Features are (id, x array<double>); weights are small matrices (lists of rows) that reach the rows by
broadcast. ``train`` has the same networks for a client that fits one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.storage import written
from skein.operators import graph, learn

Matrix = Sequence[Sequence[float]]


class Head(NamedTuple):
    """One attention head: projection, and the two halves of the scoring vector."""

    w: Matrix
    source: Sequence[float]
    target: Sequence[float]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _projected(x: DataFrame, heads: Sequence[Head]) -> DataFrame:
    """id, h, z (projected) and the scores s and t of every node as source and as target."""
    rows = [([[float(r[c]) for r in head.w] for c in range(len(head.w[0]))], [float(a) for a in head.source], [float(a) for a in head.target]) for head in heads]
    known = x.sparkSession.createDataFrame([(rows,)], "heads array<struct<w array<array<double>>, source array<double>, target array<double>>>")
    each = x.join(F.broadcast(known)).select("id", "x", F.posexplode("heads").alias("h", "w"))
    z = each.select("id", "h", F.transform("w.w", lambda c: _dot(F.col("x"), c)).alias("z"), "w.source", "w.target")
    return z.select("id", "h", "z", _dot(F.col("z"), F.col("source")).alias("s"), _dot(F.col("z"), F.col("target")).alias("t"))


def attention(edges: DataFrame, x: DataFrame, heads: Sequence[Head]) -> DataFrame:
    """u, v, h, alpha: the softmax over each node's out-neighbours of the leaky score of both ends, and the
    target's projection z."""
    nodes = _projected(x, heads)
    sources, targets = nodes.select(F.col("id").alias("u"), "h", "s"), nodes.select(F.col("id").alias("v"), "h", "t", "z")
    total = F.col("s") + F.col("t")
    scored = edges.select("u", "v").join(sources, "u").join(targets, ["v", "h"]).select("u", "v", "h", "z", F.when(total >= 0, total).otherwise(total * 0.2).alias("score"))
    top = scored.groupBy("u", "h").agg(F.max("score").alias("top"))
    shifted = scored.join(top, ["u", "h"]).withColumn("e", F.exp(F.col("score") - F.col("top")))
    sums = shifted.groupBy("u", "h").agg(F.sum("e").alias("total"))
    return shifted.join(sums, ["u", "h"]).select("u", "v", "h", (F.col("e") / (F.col("total") + 1e-10)).alias("alpha"), "z")


def gat_layer(edges: DataFrame, x: DataFrame, heads: Sequence[Head]) -> DataFrame:
    """id, x: the heads' outputs one after the other; a node without out-neighbours keeps its own projection."""
    mixed = attention(edges, x, heads).select(F.col("u").alias("id"), "h", "alpha", array_to_vector("z").alias("z"))
    mixed = mixed.groupBy("id", "h").agg(Summarizer.sum(F.col("z"), F.col("alpha")).alias("m")).select("id", "h", vector_to_array("m").alias("m"))
    own = _projected(x, heads).select("id", "h", "z").join(mixed, ["id", "h"], "left")
    parts = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("h", F.coalesce("m", "z").alias("z")))).alias("parts"))  # one item a head
    return parts.select("id", F.flatten("parts.z").alias("x"))


def gat_forward(edges: DataFrame, x: DataFrame, first: Sequence[Head], second: Head) -> DataFrame:
    """id, p: class probabilities of two layers of attention."""
    hidden = gat_layer(edges, x, first).select("id", learn.relu(F.col("x")).alias("x"))
    return gat_layer(edges, hidden, [second]).select("id", learn.softmax(F.col("x")).alias("p"))


def gcn_forward(a_hat: DataFrame, x: DataFrame, w0: Matrix, w1: Matrix) -> DataFrame:
    """id, p: softmax(A relu(A X W0) W1). Vectors are projected before they travel, so few numbers do."""
    hidden = graph.propagate(a_hat, graph.multiply(x, w0)).select("id", learn.relu(F.col("x")).alias("x"))
    return graph.propagate(a_hat, graph.multiply(hidden, w1)).select("id", learn.softmax(F.col("x")).alias("p"))


def _outer(rows: DataFrame, name: str) -> DataFrame:
    """matrix, r, c, g: the sum over rows (a, b) of the products of a's and b's places. A task multiplies its rows as
    matrices, so it passes on one product."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                a, b = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("a", "b"))
                total = a.T @ b if total is None else total + a.T @ b
        if total is not None:
            r, c = (x.ravel() for x in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(total.ravel())], names=["r", "c", "g"])

    products = rows.select("a", "b").mapInArrow(run, "r int, c int, g double")
    return products.groupBy("r", "c").agg(F.sum("g").alias("g")).select(F.lit(name).alias("matrix"), "r", "c", "g")


def clipped(gradient: DataFrame, most: float = 1.0) -> DataFrame:
    """matrix, r, c, g with every matrix scaled to a norm of at most ``most``."""
    norms = gradient.groupBy("matrix").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("norm"))  # one row a matrix
    scale = F.when(F.col("norm") > most, F.lit(most) / F.col("norm")).otherwise(1.0)
    return gradient.join(F.broadcast(norms), "matrix").select("matrix", "r", "c", (F.col("g") * scale).alias("g"))


class Pass(NamedTuple):
    """One forward pass and its gradient, with the tables that both read."""

    probs: DataFrame
    gradient: DataFrame
    tables: list[DataFrame]


def around(a_hat: DataFrame, ax: DataFrame, w0: Matrix) -> DataFrame:
    """id, x: A relu(AX W0), from rows (id, x) of AX."""
    return graph.propagate(a_hat, graph.multiply(ax, w0).select("id", learn.relu(F.col("x")).alias("x")))


def gcn_pass(a_hat: DataFrame, ax: DataFrame, labels: DataFrame, w0: Matrix, w1: Matrix, masked: bool = False) -> Pass:
    """As ``gcn_gradient``, from rows (id, x) of AX, which no step of training changes. What several steps read is written,
    so that a pass moves two sets of sums along edges: of hidden values and of errors of classes."""
    second = written(around(a_hat, ax, w0), "around")
    probs = graph.multiply(second, w1).select("id", learn.softmax(F.col("x")).alias("p"))
    size = labels.agg(F.greatest(F.count_if("train"), F.lit(1)).alias("k"))
    wrong = lambda p, i: F.when(F.col("train"), (p - F.when(i == F.col("y"), 1.0).otherwise(0.0)) / F.col("k")).otherwise(0.0 if masked else p)
    delta = written(probs.join(labels, "id").join(F.broadcast(size)).select("id", F.transform("p", wrong).alias("x")), "delta")
    back = graph.multiply(graph.propagate(a_hat, delta), [list(r) for r in zip(*w1, strict=True)]).select("id", F.col("x").alias("back"))
    hidden = graph.multiply(ax.join(back, "id").select("id", "x", "back", F.col("x").alias("a")), w0, ("back", "a"))
    # Where the hidden value is above 0, so is its sum of products.
    first = hidden.select("a", F.zip_with("back", "x", lambda b, h: F.when(h > 0, b).otherwise(0.0)).alias("b"))
    pairs = second.select("id", F.col("x").alias("a")).join(delta.select("id", F.col("x").alias("b")), "id").select("a", "b")
    return Pass(probs, _outer(first, "W0").unionByName(_outer(pairs, "W1")), [second, delta])


def gcn_gradient(a_hat: DataFrame, x: DataFrame, labels: DataFrame, w0: Matrix, w1: Matrix, masked: bool = False) -> DataFrame:
    """matrix (W0, W1), r, c, g: the gradient of the cross entropy, from labels (id, y, train), without dropout.

    Rows outside the training mask contribute their probabilities unless ``masked``; the results to match have
    them in. The adjacency and its product with X are written."""
    a_hat = written(a_hat, "adjacency")
    return gcn_pass(a_hat, written(graph.propagate(a_hat, x), "ax"), labels, w0, w1, masked).gradient
