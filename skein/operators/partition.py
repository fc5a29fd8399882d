"""From one graph to federated clients.

A graph is nodes (id, x array<double>, y) and edges (u, v). Communities go to clients in turn; a rate of all
nodes is given to a second client; every client splits its nodes for training, validation and test. All
choices are functions of (seed, ids), so clients are the same however often and wherever they are computed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.hashing import digest, uniform
from skein.functions.storage import written
from skein.operators import generate, graph
from skein.operators.modularity import modularity_communities


@dataclass(frozen=True)
class GraphData:
    """nodes (id, x, y), edges (u, v) and the label of every code y, in order."""

    nodes: DataFrame
    edges: DataFrame
    classes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Clients:
    """nodes (cid, gid, lid, x, y, split, is_overlap) and edges (cid, u, v by gid) of every client."""

    nodes: DataFrame
    edges: DataFrame


def spread_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Communities for graphs of any size: id, label after five rounds of label propagation."""
    return graph.label_propagation(graph.adjacency(edges, nodes), nodes, 5)


#: Ways to find communities: two for graphs of any size, and the exact greedy one for graphs that fit one task.
COMMUNITIES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"labels": spread_labels, "greedy": generate.greedy_communities, "modularity": modularity_communities}


def assigned(labels: DataFrame, clients: int, rate: float, seed: str) -> DataFrame:
    """cid, gid, lid, split and is_overlap of every node of every client, from communities (id, label)."""
    members = graph.community_clients(labels, clients)
    both = written(graph.overlapping(members, clients, rate, digest(f"{seed}-overlap", F.col("gid")), uniform(F.lit(f"{seed}-second"), F.col("gid"))), "members")
    splits = graph.split_masks(both, digest(f"{seed}-split", F.col("cid"), F.col("gid")))
    return both.join(graph.local_ids(both), ["cid", "gid"]).join(splits, ["cid", "gid"]).select("cid", "gid", "lid", "split", "is_overlap")


def partition_federated(data: GraphData, clients: int = 5, rate: float = 0.1, seed: str = "42", communities: str = "labels") -> Clients:
    nodes = data.nodes.select("id")
    members = written(assigned(written(COMMUNITIES[communities](data.edges, nodes), "labels"), clients, rate, seed), "assigned")
    rows = members.join(data.nodes.withColumnRenamed("id", "gid"), "gid").select("cid", "gid", "lid", "x", "y", "split", "is_overlap")
    return Clients(rows, graph.induced(data.edges, members.select("cid", "gid")))


def client_stats(clients: Clients) -> DataFrame:
    """cid, nodes, edges, overlap, train, val and test counts."""
    counts = clients.nodes.groupBy("cid").agg(F.count("*").alias("nodes"), F.count_if("is_overlap").alias("overlap"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")])
    edges = clients.edges.groupBy("cid").agg(F.count("*").alias("edges"))
    return counts.join(edges, "cid", "left").select("cid", "nodes", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), "overlap", "train", "val", "test")


def global_summary(data: GraphData, clients: int) -> DataFrame:
    """One row: num_nodes, num_edges, num_classes, in_dim, num_clients, label_classes."""
    nodes = data.nodes.agg(F.count("*").alias("num_nodes"), (F.max("y") + 1).cast("int").alias("num_classes"), F.max(F.size("x")).alias("in_dim"))
    edges = data.edges.agg(F.count("*").alias("num_edges"))
    classes = F.array(*[F.lit(c) for c in data.classes]) if data.classes else F.array().cast("array<string>")
    return nodes.join(F.broadcast(edges)).select("num_nodes", "num_edges", "num_classes", "in_dim", F.lit(clients).alias("num_clients"), classes.alias("label_classes"))


def save(data: GraphData, clients: Clients, n_clients: int, path: str, **more: object) -> None:
    """Writes clients (partitioned by cid) and the summary (with ``more`` keys) below ``path``."""
    for name, frame in (("nodes", clients.nodes), ("edges", clients.edges)):
        frame.write.mode("overwrite").partitionBy("cid").parquet(f"{path}/{name}")
    row = {**global_summary(data, n_clients).first().asDict(), **more}
    spark = clients.nodes.sparkSession
    spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/global_summary")


def load(spark: SparkSession, path: str, cids: list[int] | None = None) -> Clients:
    """The clients written below ``path``; with ``cids`` only those folders are read."""
    found = []
    for name in ("nodes", "edges"):
        try:
            rows = spark.read.parquet(f"{path}/{name}")
        except Exception as e:  # noqa: BLE001 - the class of a missing path differs between sessions
            raise FileNotFoundError(f"no clients below {path}; run the preprocess command first") from e
        found.append(rows if cids is None else rows.where(F.col("cid").isin(cids)))
    return Clients(*found)


def summary(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/global_summary").first()["value"])
