"""Graphs with features and labels from files, and the catalogue of public social networks.

Every loader gives a ``GraphData``: nodes numbered from 0 in the order of their ids, scaled features, labels
as codes. A node without a label is ``unknown``; features of nodes that no edge has are dropped; of labels
that name a node twice the last one in the file counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.storage import written
from skein.operators import generate, graph, learn
from skein.operators.partition import COMMUNITIES, GraphData
from skein.sources import files

# Key, name, nodes, edges, classes, task, size, prefix of the files, label column.
CATALOGUE = [
    ("facebook", "Facebook Page-Page Network", "~22,470", "~171,002", 4, "Node classification (page category)", "~5 MB", "facebook", "page_type"),
    ("github", "GitHub Social Network", "~37,700", "~289,003", 2, "Node classification (ML vs web developer)", "~15 MB", "git", "ml_target"),
    ("twitch_de", "Twitch Germany", "~9,498", "~153,138", 2, "Node classification (mature content streamer yes/no)", "~8 MB", "DE", "mature"),
    ("twitch_en", "Twitch England", "~7,126", "~35,324", 2, "Node classification (mature content streamer)", "~3 MB", "ENGB", "mature"),
    ("lastfm", "LastFM Asia Social Network", "~7,624", "~27,806", 18, "Node classification (country of user)", "~2 MB", "lastfm_asia", "target"),
    ("deezer", "Deezer Europe Social Network", "~28,281", "~185,504", 2, "Node classification (gender)", "~10 MB", "deezer_europe", "target"),
]
#: Features of files with sparse ids are at most so many where a cap is asked for.
CAP = 1024


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "key string, name string, nodes string, edges string, classes int, task string, size string, prefix string, label string")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def suffix(path: str) -> str:
    """The lower-case ending of a path; compressed files keep both (.gexf.gz)."""
    name = path.rsplit("/", 1)[-1].lower()
    parts = name.split(".")
    if len(parts) > 2 and parts[-1] in ("gz", "bz2"):
        return "." + ".".join(parts[-2:])
    return "." + parts[-1] if len(parts) > 1 else ""


def feature_size(fids: DataFrame, cap: int | None = None, default: int = 64) -> int:
    """The largest feature id and one, at most ``cap``; ``default`` without any."""
    most = fids.agg(F.max("fid")).first()[0]
    size = default if most is None else most + 1
    return size if cap is None else min(size, cap)


def binary_features(fids: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """id, x: 1 at the feature ids (id, fid) of a node, 0 elsewhere; ids beyond ``size`` are dropped."""
    held = fids.where((F.col("fid") >= 0) & (F.col("fid") < size)).groupBy("id").agg(F.collect_set("fid").alias("on"))
    rows = nodes.select("id").join(held, "id", "left")
    # A map makes a lookup of every place; a node's features are few.
    on = F.map_from_arrays(F.col("on"), F.transform("on", lambda f: F.lit(1.0)))
    one = lambda k: F.coalesce(F.when(F.col("on").isNull(), 0.0).otherwise(F.try_element_at(on, k)), F.lit(0.0))
    return rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one).alias("x"))


def scaled(x: DataFrame) -> DataFrame:
    """(id, x array) centred and divided by the population deviation of each place (1 where that is 0)."""
    return learn.standard_scale_vectors(x)


def coded(labels: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """(id, label) as (id, y), and the labels in the order of their codes. There is one row a label on the driver."""
    codes = learn.label_codes(labels, "label")
    known = tuple(str(r["label"]) for r in codes.orderBy("code").collect())
    return labels.join(F.broadcast(codes), "label").select("id", F.col("code").alias("y")), known


def looked_up(nodes: DataFrame, labels: DataFrame, default: str = "unknown") -> DataFrame:
    """id, label of every node; of repeated labels the last read counts."""
    last = labels.withColumn("_at", F.monotonically_increasing_id()).groupBy("id").agg(F.max_by("label", "_at").alias("label"))
    return nodes.select("id").join(last, "id", "left").select("id", F.coalesce(F.col("label").cast("string"), F.lit(default)).alias("label"))


def assembled(pairs: DataFrame, features: DataFrame, labels: DataFrame, numeric: bool = False) -> GraphData:
    """A graph from edges (src, dst), features (id, x) and labels (id, label), ids as in the files.

    With ``numeric`` labels sort as numbers, as text otherwise."""
    edges = written(graph.undirected_edges(pairs, "src", "dst"), "edges")
    nodes = graph.node_set(edges)
    index = written(graph.node_index(nodes), "index")
    named = looked_up(nodes, labels)
    if numeric and named.where(F.expr("try_cast(label AS double)").isNull()).isEmpty():
        named = named.withColumn("label", F.col("label").cast("double"))
    y, classes = coded(named)
    rows = index.join(scaled(features), "id").join(y, "id").select(F.col("idx").alias("id"), "x", "y")
    return GraphData(rows, graph.reindexed(edges, index).select(F.least("iu", "iv").alias("u"), F.greatest("iu", "iv").alias("v")), classes)


def sparse_graph(spark: SparkSession, edges: str, features: str, target: str, label: str | None = None, cap: int | None = CAP, default: int = 64) -> GraphData:
    """Edges (CSV), {"node": [feature ids]} (JSON) and labels (CSV); nodes are numbers, or texts if one isn't."""
    kind = files.id_kind(spark, edges)
    pairs, fids = files.edge_list(spark, edges, kind), files.sparse_features(spark, features, kind=kind)
    nodes = graph.node_set(graph.undirected_edges(pairs, "src", "dst"))
    return assembled(pairs, binary_features(fids, nodes, feature_size(fids, cap, default)), files.labels(spark, target, label, kind=kind), numeric=True)


def page_graph(spark: SparkSession, folder: str) -> GraphData | None:
    """The page network's three files of fixed names; None if one of them is missing."""
    names = [f"{folder}/musae_facebook_{part}" for part in ("edges.csv", "features.json", "target.csv")]
    if not all(exists(spark, n) for n in names):
        return None
    return sparse_graph(spark, *names, label="page_type", cap=None, default=128)


def catalogue_graph(spark: SparkSession, key: str, folder: str) -> GraphData:
    """A network of the catalogue from its files in ``folder``."""
    known = {row[0]: row for row in CATALOGUE}
    if key not in known:
        raise ValueError(f"unknown dataset {key!r}; there are {', '.join(known)}")
    prefix, label = known[key][7:]
    return sparse_graph(spark, *[f"{folder}/{prefix}_{part}" for part in ("edges.csv", "features.json", "target.csv")], label=label)


def synthetic_graph(spark: SparkSession, nodes: int = 1000, classes: int = 4, size: int = 64, seed: int = 42) -> GraphData:
    """Preferential attachment, communities as labels (modulo classes), block features."""
    edges = generate.preferential_graph(spark, nodes, 3, seed)
    ids = spark.range(nodes)
    labels = graph.community_clients(generate.greedy_communities(edges, ids), classes).select(F.col("gid").alias("id"), F.col("cid").alias("y"))
    x = graph.vectors(generate.block_features(labels, size, classes, seed=str(seed)))
    rows = scaled(x).join(labels, "id").select("id", "x", "y")
    return GraphData(rows, edges, tuple(map(str, range(classes))))


def format_a(spark: SparkSession, edges: str, features: str, labels: str, label: str | None = None, node: str | None = None) -> GraphData:
    """Edges (CSV), features (CSV of numbers or JSON of feature ids), labels (CSV)."""
    if suffix(features).startswith(".json"):
        return sparse_graph(spark, edges, features, labels, label)
    kind = files.id_kind(spark, edges)
    pairs = files.edge_list(spark, edges, kind)
    nodes = graph.node_set(graph.undirected_edges(pairs, "src", "dst"))
    dense = files.dense_vectors(spark, features, node, kind)
    size = dense.agg(F.max(F.size("x"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0.0), size)
    x = nodes.join(dense, "id", "left").select("id", F.coalesce("x", zeros).alias("x"))
    return assembled(pairs, x, files.labels(spark, labels, label, node, kind), numeric=True)


def _communities(edges: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """id and the rank of its community by size, as a label."""
    many = 1 << 30
    return graph.community_clients(COMMUNITIES[how](edges, nodes), many).select(F.col("gid").alias("id"), F.col("cid").alias("y"))


def degree_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.degree(edges, nodes).select("id", F.array(F.col("degree").cast("double")).alias("x"))


def format_b(spark: SparkSession, matrix: str, features: str | None = None, labels: str | None = None, label: str | None = None, communities: str = "labels") -> GraphData:
    """An adjacency matrix (CSV with an index column, or .npy); rows of features and labels in its order.

    Without features a node has its degree, without labels the number of its community."""
    edges = files.adjacency_npy(spark, matrix) if suffix(matrix) == ".npy" else files.adjacency_csv(spark, matrix)
    size = files.matrix_size(spark, matrix)
    nodes = spark.range(size)
    if features:
        x = scaled(files.positional(spark, features, lambda names: F.array(*[F.col(f"`{n}`").cast("double") for n in names[1:]]), "x"))
    else:
        x = degree_features(edges, nodes)
    if labels:
        y, classes = coded(files.positional(spark, labels, lambda names: F.col(f"`{label or names[-1]}`"), "label"))
    else:
        y = _communities(edges, nodes, communities)
        classes = tuple(str(c) for c in range((y.agg(F.max("y")).first()[0] or 0) + 1))
    return GraphData(nodes.join(x, "id").join(y, "id").select("id", "x", "y"), edges, classes)


def attribute_names(attributes: DataFrame, label: str | None) -> list[str]:
    """All names of node attributes (id, attrs map) but the label's, in order. There are as many as a file declares."""
    names = attributes.select(F.explode(F.map_keys("attrs")).alias("n")).distinct().orderBy("n").collect()
    return [r["n"] for r in names if r["n"] != label]


def format_c(spark: SparkSession, path: str, label: str | None = None, attributes: list[str] | None = None, communities: str = "labels") -> GraphData:
    """GraphML, GML or GEXF: node attributes as features (0 where they aren't numbers), one of them as label."""
    readers = {".graphml": files.graphml_nodes, ".gml": files.gml_nodes, ".gexf": files.gexf_nodes, ".gexf.gz": files.gexf_nodes}
    ends = {".graphml": files.graphml_edges, ".gml": files.gml_edges, ".gexf": files.gexf_edges, ".gexf.gz": files.gexf_edges}
    kind = suffix(path)
    if kind not in readers:
        raise ValueError(f"unsupported graph file {kind!r}; there are {', '.join(readers)}")
    attrs = written(readers[kind](spark, path), "attributes")
    pairs = ends[kind](spark, path)
    # Nodes are numbered in the order of the file.
    index = written(graph.node_index(attrs.select(F.col("at").alias("id"))).join(attrs.select(F.col("at").alias("id"), F.col("id").alias("name"), "attrs"), "id"), "index")
    number = index.select("name", "idx")
    raw = pairs.join(number.withColumnsRenamed({"name": "source", "idx": "a"}), "source").join(number.withColumnsRenamed({"name": "target", "idx": "b"}), "target")
    edges = graph.undirected_edges(raw, "a", "b")
    nodes = index.select(F.col("idx").alias("id"))
    names = attributes or attribute_names(attrs, label)

    def value(name: str) -> Column:
        return F.coalesce(F.try_element_at("attrs", F.lit(name)).try_cast("double"), F.lit(0.0))

    if names:
        x = scaled(index.select(F.col("idx").alias("id"), F.array(*[value(n) for n in names]).alias("x")))
    else:
        x = degree_features(edges, nodes)
    if label:
        y, classes = coded(index.select(F.col("idx").alias("id"), F.coalesce(F.try_element_at("attrs", F.lit(label)), F.lit("unknown")).alias("label")))
    else:
        y, classes = coded(_communities(edges, nodes, communities).select("id", F.col("y").cast("string").alias("label")))
    return GraphData(nodes.join(x, "id").join(y, "id").select("id", "x", "y"), edges, classes)


FORMATS = """Format A, three files:
  edges     CSV with a header; the first two columns are the ends
  features  CSV (node, then one column a feature) or JSON ({"0": [3, 17], ...})
  labels    CSV (node, label); another label column can be named
Format B, an adjacency matrix:
  matrix    CSV with an index column, or .npy; entries other than 0 are edges
  features  CSV with an index column, rows in the matrix's order (optional)
  labels    CSV, the last column unless another is named, rows in the matrix's order (optional)
Format C, a graph file:
  .graphml, .gml, .gexf or .gexf.gz with node attributes; one of them may be the label
"""
