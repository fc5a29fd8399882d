import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import gnn, graph, train, whole_graph


def small(spark):
    rng = np.random.default_rng(4)
    n = 40
    x = np.eye(4)[np.arange(n) % 4] + rng.normal(0, 0.2, (n, 4))
    pairs = {(a, b) for a in range(n) for b in (a + 4, a + 8) if b < n} | {(0, k) for k in range(1, 20)}
    rows = [(0, k, x[k].tolist(), k % 4, "train" if k % 3 else "test") for k in range(n)]
    nodes = spark.createDataFrame(rows, "cid long, gid long, x array<double>, y int, split string")
    return nodes, spark.createDataFrame(sorted(pairs), "u long, v long")


@pytest.mark.parametrize("masked", [True, False])
def test_whole_graph_equals_one_client(spark, masked):
    nodes, edges = small(spark)
    cfg = train.Config(hidden=6, dropout=0.0, local_epochs=4, rate=0.3, masked=masked, noise=False)
    flat = train.initial(train.shapes(cfg, 4, 4), cfg.seed)
    client = train.client_updates(nodes, edges.select(F.lit(0).cast("long").alias("cid"), "u", "v"), flat, cfg, 4).first()
    ids = nodes.select(F.col("gid").alias("id"))
    labels = nodes.select(F.col("gid").alias("id"), "y", (F.col("split") == "train").alias("train"))
    found = whole_graph.train_gcn(graph.norm_adj(edges, ids), nodes.select(F.col("gid").alias("id"), "x"), labels, cfg, 4, 4)
    assert found.weights == pytest.approx(np.array(client["w"]), rel=1e-8, abs=1e-12)
    assert np.mean(found.losses[:-1]) == pytest.approx(client["train_loss"], rel=1e-8)
    if masked:
        assert found.losses[-1] < found.losses[0]


def test_layers_dont_move_edges(spark):
    nodes, edges = small(spark)
    ids = nodes.select(F.col("gid").alias("id"))
    kept = whole_graph.dealt(graph.norm_adj(edges, ids))
    kept.count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if nothing were small
        probs = gnn.gcn_forward(kept, nodes.select(F.col("gid").alias("id"), "x"), np.ones((4, 6)).tolist(), np.ones((6, 4)).tolist())
        plan = probs._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        kept.unpersist()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    scans = [k for k, line in enumerate(plan) if "InMemoryTableScan" in line]
    assert len(scans) == 2  # a layer reads the dealt table
    for k in scans:  # what is right above, up to the join, is no exchange
        above = [line for line in plan[:k] if depth(line) < depth(plan[k])]
        nearest = next(line for line in reversed(above) if "Join" in line or "Exchange" in line)
        assert "Join" in nearest


def test_empty_graph(spark):
    nodes, edges = small(spark)
    nodes, edges = nodes.limit(0), edges.limit(0)
    ids = nodes.select(F.col("gid").alias("id"))
    found = whole_graph.train_gcn(graph.norm_adj(edges, ids), nodes.select(F.col("gid").alias("id"), "x"), nodes.select(F.col("gid").alias("id"), "y", F.lit(True).alias("train")), train.Config(hidden=2), 3, 1)
    assert found.losses == [0.0, 0.0]


@pytest.mark.parametrize("epochs", [1, 3])
def test_features_are_propagated_once(spark, monkeypatch, epochs):
    nodes, edges = small(spark)
    ids, calls, propagate = nodes.select(F.col("gid").alias("id")), [], graph.propagate
    monkeypatch.setattr(graph, "propagate", lambda a, x: calls.append(x) or propagate(a, x))
    labels = nodes.select(F.col("gid").alias("id"), "y", (F.col("split") == "train").alias("train"))
    whole_graph.train_gcn(graph.norm_adj(edges, ids), nodes.select(F.col("gid").alias("id"), "x"), labels, train.Config(hidden=6), 4, epochs)
    assert len(calls) == 1 + 2 * epochs + 1  # features; hidden values and errors an epoch; hidden values for the last loss
