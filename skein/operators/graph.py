"""Graphs as edge tables (u <= v, distinct) and node tables.

Null ends of edges make no edge; empty tables give empty results; columns besides those named are ignored.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.storage import sized_join, written
from skein.operators.ranks import number_bucket, ranked, text_bucket
from skein.operators.thresholds import before, boundaries, first_rows


def undirected_edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def node_set(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def node_index(nodes: DataFrame) -> DataFrame:
    """id (a number or a text) and its rank from 0."""
    bucket = text_bucket(nodes, "id") if nodes.schema["id"].dataType.typeName() == "string" else number_bucket(nodes, "id")
    return ranked(nodes.select("id"), [F.col("id")], [bucket], name="idx")


def reindexed(edges: DataFrame, index: DataFrame) -> DataFrame:
    one = index.select(F.col("id").alias("u"), F.col("idx").alias("iu"))
    two = index.select(F.col("id").alias("v"), F.col("idx").alias("iv"))
    return edges.join(one, "u").join(two, "v").select("iu", "iv")


def degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both ends of every edge count, so a loop counts twice; other nodes have 0."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    return nodes.join(ends, "id", "left").select("id", F.coalesce("d", F.lit(0)).cast("long").alias("degree"))


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both directions and a loop at every node, each once."""
    both = edges.select(F.col("u").alias("i"), F.col("v").alias("j")).unionByName(edges.select(F.col("v").alias("i"), F.col("u").alias("j")))
    return both.unionByName(nodes.select(F.col("id").alias("i"), F.col("id").alias("j"))).distinct()


def norm_adj(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The symmetrically normalised adjacency with loops: i, j, a."""
    adj = adjacency(edges, nodes)
    d = adj.groupBy("i").agg(F.count("*").alias("d"))
    left, right = d.select("i", F.col("d").alias("di")), d.select(F.col("i").alias("j"), F.col("d").alias("dj"))
    return adj.join(left, "i").join(right, "j").select("i", "j", (1 / F.sqrt((F.col("di") * F.col("dj")).cast("double"))).alias("a"))


def vectors(x: DataFrame) -> DataFrame:
    """Features (id, k, x), complete, as (id, x array<double>)."""
    return x.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", F.col("x").cast("double").alias("x")))).alias("kx")).select("id", F.col("kx.x").alias("x"))


def long_form(rows: DataFrame) -> DataFrame:
    """(id, x array<double>) as (id, k, x)."""
    return rows.select("id", F.posexplode("x").alias("k", "x"))


def propagate(a_hat: DataFrame, x: DataFrame) -> DataFrame:
    """A x X for features (id, x array<double>), in the same form. Whole vectors pass the join; weighted sums are
    combined in the task before they are shuffled, so a hub costs no more than any node."""
    rows = a_hat.join(x.select(F.col("id").alias("j"), array_to_vector("x").alias("x")), "j")
    return rows.groupBy(F.col("i").alias("id")).agg(Summarizer.sum(F.col("x"), F.col("a")).alias("x")).select("id", vector_to_array("x").alias("x"))


def multiply(x: DataFrame, weights: list[list[float]], more: tuple[str, ...] = ()) -> DataFrame:
    """X x W for features (id, x array<double>) and a model's matrix (rows of W): no shuffle. Columns ``more`` stay."""
    columns = x.sparkSession.createDataFrame([([[float(row[c]) for row in weights] for c in range(len(weights[0]))],)], "_w array<array<double>>")
    dot = lambda w: F.aggregate(F.zip_with("x", w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return x.join(F.broadcast(columns)).select("id", F.transform("_w", dot).alias("x"), *more)


def label_propagation(adj: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """id, label after so many synchronous rounds; the most frequent neighbour label wins, then the least. Ids may be
    of any type that has an order."""
    labels = nodes.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = adj.join(labels.select(F.col("id").alias("j"), "label"), "j").groupBy("i", "label").agg(F.count("*").alias("n"))
        labels = votes.groupBy("i").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")).withColumnRenamed("i", "id")
    return labels


def induced(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """cid, u, v of the edges with both ends in a client (cid, gid)."""
    one = membership.select("cid", F.col("gid").alias("u"))
    two = membership.select(F.col("cid").alias("cid2"), F.col("gid").alias("v"))
    return edges.join(one, "u").join(two, "v").where("cid = cid2").select("cid", "u", "v")


def local_ids(membership: DataFrame) -> DataFrame:
    """cid, gid, lid: the rank of gid in its client."""
    return ranked(membership.select("cid", "gid"), [F.col("gid")], [number_bucket(membership, "gid")], ("cid",), "lid")


def community_clients(labels: DataFrame, clients: int) -> DataFrame:
    """Communities from large to small go to the clients in turn: gid, cid."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    bucket = text_bucket(sizes, "label") if sizes.schema["label"].dataType.typeName() == "string" else number_bucket(sizes, "label")
    rank = ranked(sizes, [F.desc("n"), F.col("label")], [-F.col("n"), bucket])
    return labels.join(rank.select("label", (F.col("rank") % clients).cast("int").alias("cid")), "label").select(F.col("id").alias("gid"), "cid")


def equal_clients(membership: DataFrame, clients: int, by: Column) -> DataFrame:
    """gid and cid: in the order of the digests ``by``, chunks of one size; the last client takes the rest."""
    by, size = by.cast("string"), max(1, membership.count() // clients)
    ranks = membership.sparkSession.range(1, clients).select((F.col("id") * size).alias("r"))
    edges = boundaries(membership.select(by.alias("by"), F.col("gid").alias("key")), ranks).agg(F.collect_list(F.struct("by", "key")).alias("_edges"))  # one row of ``clients`` edges
    passed = F.filter("_edges", lambda e: ~before(by, F.col("gid"), e["by"], e["key"]))
    return membership.join(F.broadcast(edges)).select("gid", F.size(passed).alias("cid"))


def split_masks(membership: DataFrame, by: Column) -> DataFrame:
    """cid, gid, split: 60 % train, 20 % val (both rounded down), the rest test, in the order of the digests ``by``."""
    by, sizes = by.cast("string"), membership.groupBy("cid").agg(F.count("*").alias("n"))  # one row a client
    train, val = F.floor(F.lit(0.6) * F.col("n")), F.floor(F.lit(0.2) * F.col("n"))
    ranks = written(sizes.select("cid", train.alias("train"), (train + val).alias("val")), "splits")
    edges = boundaries(membership.select("cid", by.alias("by"), F.col("gid").alias("key")), ranks.select("cid", F.explode(F.array_distinct(F.array("train", "val"))).alias("r")), ("cid",))
    edge = edges.select("cid", "r", F.struct("by", "key").alias("e"))
    both = ranks.join(edge.withColumnsRenamed({"r": "train", "e": "t"}), ["cid", "train"], "left").join(edge.withColumnsRenamed({"r": "val", "e": "v"}), ["cid", "val"], "left").select("cid", "t", "v")
    inside = lambda e: before(by, F.col("gid"), F.col(f"{e}.by"), F.col(f"{e}.key"))
    split = F.when(inside("t"), "train").when(inside("v"), "val").otherwise("test")
    return sized_join(membership, both, ["cid"]).select("cid", "gid", split.alias("split"))


def sampled(rows: DataFrame, rate: float, by: Column, key: str = "gid") -> DataFrame:
    """Exactly int(count x rate) rows: those of least digest ``by``."""
    return first_rows(rows, int(rows.count() * rate), by.cast("string"), key)


def second_client(pool: DataFrame, clients: int, pick: Column) -> DataFrame:
    """gid, owner and the other client (cid) that a node is given to as well; ``pick`` is uniform in (0, 1)."""
    other = (F.col("cid") + 1 + F.floor(pick * (clients - 1))) % clients if clients > 1 else F.col("cid")
    return pool.select("gid", F.col("cid").alias("owner"), other.cast("int").alias("cid"))


def overlapping(membership: DataFrame, clients: int, rate: float, by: Column, pick: Column) -> DataFrame:
    """membership with a rate of its nodes given to a second client: cid, gid, is_overlap."""
    pool = sampled(membership.select("cid", "gid"), rate, by)
    second = second_client(pool, clients, pick).select("cid", "gid")
    flags = pool.select("gid", F.lit(True).alias("is_overlap"))
    return membership.select("cid", "gid").unionByName(second).distinct().join(flags, "gid", "left").select("cid", "gid", F.coalesce("is_overlap", F.lit(False)).alias("is_overlap"))
