"""Graphs from files: edge lists, labels, sparse features, adjacency matrices, GraphML, GEXF, GML."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.ranks import ranked


def id_kind(spark: SparkSession, path: str) -> str:
    """long if the ends of all edges are whole numbers, else string."""
    rows = spark.read.option("header", True).csv(path)
    ends = rows.select(F.explode(F.array(*[_column(c) for c in rows.columns[:2]])).alias("id"))
    return "long" if ends.where("id is not null and try_cast(id AS bigint) is null").isEmpty() else "string"


def edge_list(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """The first two columns of a CSV with a header, whatever their names: src, dst."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(_column(rows.columns[0]).cast(kind).alias("src"), _column(rows.columns[1]).cast(kind).alias("dst"))


def _column(name: str):
    return F.col(f"`{name}`")


def labels(spark: SparkSession, path: str, label: str | None = None, node: str | None = None, kind: str = "long") -> DataFrame:
    """id (the first column, or ``node``) and a label column, by default the first other one: id, label."""
    rows = spark.read.option("header", True).csv(path)
    node = node or rows.columns[0]
    label = label if label in rows.columns else next(c for c in rows.columns if c != node)
    return rows.select(_column(node).cast(kind).alias("id"), _column(label).alias("label"))


def sparse_features(spark: SparkSession, path: str, lines: bool = False, kind: str = "long") -> DataFrame:
    """JSON objects of node: [feature ids], one or several a file: id, fid. A value that is no list has no
    features. A file is read as one row; ``lines`` says that every line is an object, for files beyond that."""
    if lines:
        objects = spark.read.text(path)
    else:
        objects = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?<=\})\s*\n\s*(?=\{)")).alias("value"))
    rows = objects.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "fids"))
    return rows.select(F.col("id").try_cast(kind).alias("id"), F.explode(F.from_json("fids", "array<int>")).alias("fid")).where("id is not null")


def dense_features(spark: SparkSession, path: str) -> DataFrame:
    """id (the first column) and the others as k from 0: id, k, x."""
    rows = spark.read.option("header", True).csv(path)
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in rows.columns[1:]])
    return rows.select(F.col(f"`{rows.columns[0]}`").cast("long").alias("id"), F.posexplode(values).alias("k", "x"))


def dense_vectors(spark: SparkSession, path: str, node: str | None = None, kind: str = "long") -> DataFrame:
    """id (the first column, or ``node``) and the others as x array<double>."""
    rows = spark.read.option("header", True).csv(path)
    node = node or rows.columns[0]
    return rows.select(_column(node).cast(kind).alias("id"), F.array(*[_column(c).cast("double") for c in rows.columns if c != node]).alias("x"))


def in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """rows of a scan with their place from 0: by path, split and line. Spark reads the splits of a folder in any order,
    but lines of one split in theirs; a split counts its rows, and only the splits (one row each) are put in a line."""
    own = rows.columns
    read = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    sizes = read.groupBy("_path", "_start").agg(F.count("*").alias("_n"))
    first = sizes.withColumn("_first", F.sum("_n").over(Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    inside = read.withColumn("_inside", F.row_number().over(Window.partitionBy("_path", "_start").orderBy("_line")))
    return inside.join(first, ["_path", "_start"]).select(*own, (F.col("_first") + F.col("_inside") - 1).cast("long").alias(name))


def positional(spark: SparkSession, path: str, value, name: str) -> DataFrame:
    """id (the row's place in the file, from 0) and a value made of its columns."""
    rows = spark.read.option("header", True).csv(path)
    return in_file_order(rows, "_id").select(F.col("_id").alias("id"), value(rows.columns).alias(name))


def _matrix_lines(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The rows of a CSV matrix with a header, each as one text (line), and how many columns the header names. A matrix
    has as many columns as nodes, too many for columns of a frame."""
    rows = spark.read.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    return rows.toDF("line"), len(next(csv.reader(rows.columns)))


def nonzero_cells(line: bytes) -> tuple[str, dict[int, float]]:
    """The first cell of a CSV row, and by their places from 0 those of the others that are neither 0 nor empty."""
    import numpy as np

    if b'"' in line:
        first, *cells = next(csv.reader([line.decode()]))
        return first, {j: float(x) for j, x in enumerate(cells) if x and float(x) != 0}
    text = np.frombuffer(line, np.uint8)
    starts = np.flatnonzero(text == ord(",")) + 1
    ends = np.append(starts[1:] - 1, len(text))[: len(starts)]
    plain = (ends - starts == 1) & (text[np.minimum(starts, len(text) - 1)] == ord("0"))
    cells = ((j, line[starts[j] : ends[j]]) for j in np.flatnonzero(~plain & (ends > starts)).tolist())
    return line.split(b",", 1)[0].decode(), {j: float(x) for j, x in cells if float(x) != 0}


def adjacency_csv(spark: SparkSession, path: str) -> DataFrame:
    """A matrix with an index column; every entry but 0 is an undirected edge: u, v."""
    rows, width = _matrix_lines(spark, path)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for line in batch.column("line"):
                i, cells = nonzero_cells(line.as_py())
                at = [j for j in cells if j < width - 1]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.string()), pa.array(at, pa.int64())], names=["i", "j"])

    found = rows.select(F.col("line").cast("binary").alias("line")).mapInArrow(run, "i string, j long").select(F.when(F.col("i") != "", F.col("i")).cast("long").alias("i"), "j")
    return found.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).distinct()


def graphml_edges(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "edge").load(path)
    return rows.select(F.col("_source").cast("string").alias("source"), F.col("_target").cast("string").alias("target"))


def graphml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """at (the node's place), id and attrs (name to text), by the names that the file's keys declare; a node without
    data for a key has the key's default, if there is one."""
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string, _for string, default string").load(path)
    declared = {r["_id"]: (r["_attr.name"], r["default"]) for r in keys.collect() if r["_id"] and r["_attr.name"] and r["_for"] in (None, "node", "all")}  # as many as the header declares
    rows = spark.read.format("xml").option("rowTag", "node").schema("_id string, data array<struct<_key string, _VALUE string>>").load(path)
    data = F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>"))
    values = {}

    def of(key: str):
        return F.try_element_at(F.filter(data, lambda d: d["_key"] == key), F.lit(-1))["_VALUE"]

    for key, (name, default) in declared.items():
        own = of(key)
        values[name] = F.coalesce(own, F.lit(default), *([values[name]] if name in values else []))
    held = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in values.items()]), lambda e: e["v"].isNotNull()) if values else F.array().cast("array<struct<k:string,v:string>>")
    return in_file_order(rows, "at").select("at", F.col("_id").alias("id"), F.map_from_entries(held).alias("attrs"))


def gexf_edges(spark: SparkSession, path: str) -> DataFrame:
    """The same elements; Spark opens ``.gexf.gz`` itself."""
    return graphml_edges(spark, path)


def gexf_nodes(spark: SparkSession, path: str) -> DataFrame:
    """at, id and attrs (title to text) of the nodes."""
    keys = spark.read.format("xml").option("rowTag", "attribute").schema("_id string, _title string").load(path)
    names = {r["_id"]: r["_title"] for r in keys.collect() if r["_id"]}  # as many as the header declares
    rows = spark.read.format("xml").option("rowTag", "node").schema("_id string, attvalues struct<attvalue array<struct<_for string, _value string>>>").load(path)
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    held = F.filter(F.coalesce("attvalues.attvalue", F.array().cast("array<struct<_for:string,_value:string>>")), lambda d: F.try_element_at(known, d["_for"]).isNotNull())
    return in_file_order(rows, "at").select("at", F.col("_id").alias("id"), F.map_from_entries(F.transform(held, lambda d: F.struct(F.try_element_at(known, d["_for"]), d["_value"]))).alias("attrs"))


def _gml(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """at and of: the keys and plain values (k, v, in order) of every ``kind [ ... ]`` inside the graph's brackets.

    A file is read in splits. A split adds up the brackets in it and passes on its last token; from those of the
    splits before (a row each) it has the depth that it starts at and the token before it. Values in brackets
    (``graphics [ ... ]``) are left out, and what is in them isn't taken for the record's own. A quoted text ends
    in its line; a line that starts with # is none."""
    read = spark.read.text(path).where("not value rlike '^[ \\t]*#'")
    lines = read.select("value", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).alias("split"), F.monotonically_increasing_id().alias("line"))
    tokens = lines.select("split", "line", F.posexplode(F.regexp_extract_all("value", F.lit(r"\"[^\"]*\"?|\[|\]|[^\s\[\]\"]+"), 0)).alias("place", "token"))
    step = F.when(F.col("token") == "[", 1).when(F.col("token") == "]", -1).otherwise(0)
    tokens = tokens.select("split", F.struct("line", "place").alias("order"), "token", step.alias("step"))
    before = Window.partitionBy("split.path").orderBy("split.start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split

    def starts(per: DataFrame, value: str, name: str) -> DataFrame:
        return per.select("split", F.coalesce(F.sum(value).over(before), F.lit(0)).alias(name), *([F.last("last", True).over(before).alias("last")] if "last" in per.columns else []))

    ends = starts(tokens.groupBy("split").agg(F.sum("step").alias("sum"), F.max_by("token", "order").alias("last")), "sum", "base")
    inside = Window.partitionBy("split").orderBy("order")
    deep = tokens.join(ends, "split").withColumn("depth", F.col("base") + F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    deep = deep.withColumn("previous", F.coalesce(F.lag("token").over(inside), "last"))
    opens = (F.col("step") == 1) & (F.col("depth") == 2)
    deep = deep.withColumn("new", opens.cast("int"))
    counts = starts(deep.groupBy("split").agg(F.sum("new").alias("n")), "n", "first")
    numbered = deep.join(counts, "split").withColumn("record", F.col("first") + F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # Of a record: its opening with the name before it, then keys and values at its own depth; a bracket stands for its value.
    own = numbered.where(opens | (F.col("depth") == 2) & (F.col("step") == 0) | (F.col("depth") == 3) & (F.col("step") == 1))
    name = F.when(opens, F.lower("previous"))
    held = own.groupBy("split.path", "record").agg(F.max(name).alias("name"), F.array_sort(F.collect_list(F.when(~opens, F.struct(F.col("split.start").alias("start"), "order", "token")))).alias("items"))
    flat = F.col("items.token")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda i: F.struct(F.get(flat, 2 * i).alias("k"), F.trim(F.get(flat, 2 * i + 1), F.lit('"')).alias("v"), F.get(flat, 2 * i + 1).alias("raw")))
    of = F.when(F.size(flat) >= 2, F.filter(pairs, lambda p: p["raw"] != "[")).otherwise(F.filter(pairs, lambda p: F.lit(False)))
    found = held.where(F.col("name") == kind).select("path", "record", of.alias("of"))
    return found.select(F.struct("path", "record").alias("at"), F.transform("of", lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))).alias("of"))


def _first(of: str, key: str):
    return F.try_element_at(F.filter(of, lambda p: p["k"] == key), F.lit(1))["v"]


def gml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """at (the node's place), id and attrs (key to text, the first of equal keys) of every ``node [ ... ]``."""
    rows = _gml(spark, path, "node")
    keys = F.array_distinct(F.transform(F.filter("of", lambda p: p["k"] != "id"), lambda p: p["k"]))
    attrs = F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter("of", lambda p: p["k"] == k), F.lit(1))["v"]))
    placed = ranked(rows.select("at", _first("of", "id").alias("id"), attrs.alias("attrs")), [F.col("at")], [F.col("at.path"), F.floor(F.col("at.record") / 100_000)], name="place")
    return placed.select(F.col("place").alias("at"), "id", "attrs")


def gml_edges(spark: SparkSession, path: str) -> DataFrame:
    """The ends of every ``edge [ ... ]``: source, target."""
    return _gml(spark, path, "edge").select(_first("of", "source").alias("source"), _first("of", "target").alias("target"))


def matrix_npy(spark: SparkSession, path: str) -> DataFrame:
    """Entries but 0 of ``.npy`` matrices: path, i, j, x. A file is read whole by one task."""

    def entries(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                cells = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False))
                i, j = np.nonzero(cells)
                yield pd.DataFrame({"path": name, "i": i, "j": j, "x": cells[i, j].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(entries, "path string, i long, j long, x double")


def matrix_size(spark: SparkSession, path: str) -> int:
    """Rows of a matrix file."""
    if not path.endswith(".npy"):
        return _matrix_lines(spark, path)[0].count()

    def rows(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"n": [len(np.atleast_2d(np.load(io.BytesIO(c), allow_pickle=False))) for c in batch["content"]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "n long").agg(F.max("n")).first()[0] or 0


def adjacency_npy(spark: SparkSession, path: str) -> DataFrame:
    return matrix_npy(spark, path).select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).distinct()
