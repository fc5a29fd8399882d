"""Degree-adaptive noise and the privacy ledger; edge sketches are in ``sketches``."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.hashing import laplace
from skein.operators.sketches import bloom_encode, client_salt, edge_key, might_contain, sketch, sketch_stats

__all__ = ["bloom_encode", "client_epsilon", "client_salt", "edge_key", "epsilon", "ledger", "might_contain", "na_encode", "noisy", "overlap_merge", "sensitivity", "sketch", "sketch_stats"]


def sensitivity(degrees: DataFrame) -> DataFrame:
    """id, sens: degree over the largest degree (1 if that is 0)."""
    most = degrees.agg(F.max("degree").alias("m"))
    return degrees.join(F.broadcast(most)).select("id", (F.col("degree") / F.when(F.col("m") > 0, F.col("m")).otherwise(1)).alias("sens"))


def epsilon(sens: Column, least: float = 0.5, most: float = 2.0) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.lit(most) - sens * (most - least)))


def noisy(x: DataFrame, clip: float = 1.0, seed: str = "42") -> DataFrame:
    """(id, k, x, eps) clipped to [-clip, clip] and with Laplace noise of scale clip / eps: id, k, x."""
    scale = F.lit(clip) / F.greatest(F.col("eps"), F.lit(1e-8))
    noise = laplace(scale, F.lit(seed), F.col("id"), F.col("k"))
    return x.select("id", "k", (F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("x"))) + noise).alias("x"))


def client_epsilon(nodes: DataFrame, edges: DataFrame, least: float = 0.5, most: float = 2.0) -> DataFrame:
    """cid, gid, eps: by the degree of a node among its client's edges (cid, u, v), over the client's largest."""
    ends = edges.select("cid", F.explode(F.array("u", "v")).alias("gid")).groupBy("cid", "gid").agg(F.count("*").alias("d"))
    degrees = nodes.select("cid", "gid").join(ends, ["cid", "gid"], "left").fillna(0, ["d"])
    largest = degrees.groupBy("cid").agg(F.max("d").alias("m"))  # one row a client
    sens = F.col("d") / F.when(F.col("m") > 0, F.col("m")).otherwise(1)
    return degrees.join(F.broadcast(largest), "cid").select("cid", "gid", epsilon(sens, least, most).alias("eps"))


def na_encode(nodes: DataFrame, edges: DataFrame, least: float = 0.5, most: float = 2.0, clip: float = 1.0, seed: str = "42") -> DataFrame:
    """cid, gid, is_overlap, eps and the noisy embedding z of every node of every client, from nodes (cid, gid,
    is_overlap, x array<double>). Noise depends on seed, client, node and place alone."""
    rows = nodes.select("cid", "gid", "is_overlap", "x").join(client_epsilon(nodes, edges, least, most), ["cid", "gid"])
    scale = F.lit(clip) / F.greatest(F.col("eps"), F.lit(1e-8))
    noise = lambda v, k: F.greatest(F.lit(-clip), F.least(F.lit(clip), v)) + laplace(scale, F.lit(seed), F.col("cid"), F.col("gid"), k)
    return rows.select("cid", "gid", "is_overlap", "eps", F.transform("x", noise).alias("z"))


def overlap_merge(packs: DataFrame) -> DataFrame:
    """gid, clients and z: the mean of all clients' noisy embeddings of a shared node (cid, gid, z)."""
    rows = packs.select("gid", array_to_vector("z").alias("z"))
    return rows.groupBy("gid").agg(F.count("*").alias("clients"), Summarizer.mean(F.col("z")).alias("z")).select("gid", "clients", vector_to_array("z").alias("z"))


def ledger(log: DataFrame) -> DataFrame:
    """round, mean_eps over clients and its running sum, of (round, cid, eps)."""
    per = log.groupBy("round").agg(F.coalesce(F.avg("eps"), F.lit(0.0)).alias("mean_eps"))
    return per.withColumn("cumulative_eps", F.sum("mean_eps").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)))
