"""Training of a GCN on a whole graph, however large, as relational steps.

The normalised adjacency is dealt out by its column once and kept so; a layer brings the vectors to it, and only the
sums, combined where they arise, are shuffled on. No step or epoch moves an edge again, and the product of the adjacency
with the features, which no epoch changes, is made once. The model (a few matrices) is
on the driver, as large as it is and no larger; features, hidden layers and gradients of rows never are.

Defined results: a node without a row in labels takes part in the layers but not in the gradient; an empty graph leaves
the weights as they are, with a loss of 0.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.storage import removed, written
from skein.operators import gnn, graph, learn
from skein.operators.train import Config, cut, initial, shapes


class Trained(NamedTuple):
    """The final weights, flat, and the loss (over the training mask) before every epoch and after the last."""

    weights: np.ndarray
    losses: list[float]


def dealt(a_hat: DataFrame) -> DataFrame:
    """The adjacency (i, j, a) kept on the executors' disks, one part for every shuffle partition, by j. A part that is
    lost with its executor is made again."""
    parts = int(a_hat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a_hat.repartition(parts, "j").persist(StorageLevel.DISK_ONLY)


def loss(probs: DataFrame, labels: DataFrame) -> float:
    """The mean cross entropy of the training nodes of labels (id, y, train), from probabilities (id, p); 0 without any."""
    found = probs.join(labels.where("train"), "id").agg(F.avg(-F.log(F.get("p", F.col("y").cast("int")) + 1e-10)).alias("l")).first()["l"]
    return float(found or 0.0)


def train_gcn(a_hat: DataFrame, x: DataFrame, labels: DataFrame, cfg: Config, classes: int, epochs: int) -> Trained:
    """Gradient steps over (id, x array<double>) and labels (id, y, train), without dropout: what one client that holds
    the whole graph does in ``epochs`` local epochs."""
    features = x.agg(F.max(F.size("x"))).first()[0] or 1
    sizes = shapes(cfg, features, classes)
    flat, losses, kept = initial(sizes, cfg.seed), [], dealt(a_hat)
    starts = {"W0": (0, sizes[0][1]), "W1": (sizes[0][0] * sizes[0][1], sizes[1][1])}
    ax = written(graph.propagate(kept, x), "ax")
    try:
        for _ in range(epochs):
            step = gnn.gcn_pass(kept, ax, labels, *(w.tolist() for w in cut(flat, sizes)), cfg.masked)
            losses.append(loss(step.probs, labels))
            change = np.zeros_like(flat)
            for r in gnn.clipped(step.gradient, cfg.clip).collect():  # one row a weight
                first, cols = starts[r["matrix"]]
                change[first + r["r"] * cols + r["c"]] = r["g"]
            flat = flat - cfg.rate * change
            for table in step.tables:
                removed(table)
        w0, w1 = (w.tolist() for w in cut(flat, sizes))
        last = graph.multiply(gnn.around(kept, ax, w0), w1).select("id", learn.softmax(F.col("x")).alias("p"))
        losses.append(loss(last, labels))
    finally:
        kept.unpersist()
        removed(ax)
    return Trained(flat, losses)
