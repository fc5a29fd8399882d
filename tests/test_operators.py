import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from skein.functions.hashing import sketch_positions
from skein.operators import federate, graph, learn, privacy
from skein.sources import files
from skein.streaming import round_log


def updates(spark, vectors, n=None, loss=None):
    return spark.createDataFrame([(c, k, float(w), (n or [1] * len(vectors))[c], float((loss or [1.0] * len(vectors))[c])) for c, v in enumerate(vectors) for k, w in enumerate(v)], "cid long, k int, w double, n long, loss double")


def weights(df):
    return [r["w"] for r in df.orderBy("k").collect()]


FIVE = [(0, 0), (1, 0), (0, 1), (1, 1), (9, 9)]


def test_fedavg(spark):
    assert weights(federate.fedavg(updates(spark, [(1, 2, 3, 4), (5, 6, 7, 8)], [10, 20]))) == pytest.approx([11 / 3, 14 / 3, 17 / 3, 20 / 3])
    assert weights(federate.fedavg(updates(spark, [(1, 2), (3, 4)], [0, 0]))) == [1, 2]


def test_qfedavg_weights(spark):
    found = weights(federate.qfedavg(updates(spark, [(1, 0), (0, 1)], [10, 20], [1.0, 0.5])))
    assert found == pytest.approx([0.38095362, 0.61904638])


def test_krum(spark):
    scores = {r["cid"]: r["score"] for r in federate.krum_scores(updates(spark, FIVE)).collect()}
    assert scores == {0: 2, 1: 2, 2: 2, 3: 2, 4: 273}
    assert weights(federate.krum(updates(spark, FIVE))) == [0, 0]
    three = updates(spark, FIVE[:3])
    assert weights(federate.krum(three)) == weights(federate.fedavg(three))


def test_trimmed_mean_and_median(spark):
    assert weights(federate.trimmed_mean(updates(spark, FIVE))) == pytest.approx([2 / 3, 2 / 3])
    assert weights(federate.trimmed_mean(updates(spark, FIVE[:2]))) == [None, None]
    assert weights(federate.coordinate_median(updates(spark, FIVE))) == [1, 1]


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        federate.aggregate(updates(spark, FIVE), "invalid_method")


def star(spark):
    return spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "u long, v long"), spark.range(4)


def test_norm_adj_star(spark):
    a = {(r["i"], r["j"]): r["a"] for r in graph.norm_adj(*star(spark)).collect()}
    assert a[0, 0] == pytest.approx(0.25) and a[0, 1] == a[1, 0] == pytest.approx(0.35355339) and a[1, 1] == pytest.approx(0.5) and len(a) == 10


def test_norm_adj_without_edges_is_identity(spark):
    a = graph.norm_adj(star(spark)[0].limit(0), spark.range(5)).collect()
    assert {(r["i"], r["j"], r["a"]) for r in a} == {(i, i, 1.0) for i in range(5)}


def test_degree_counts_loops_twice(spark):
    edges = spark.createDataFrame([(0, 0), (0, 1)], "u long, v long")
    assert {r["id"]: r["degree"] for r in graph.degree(edges, spark.range(3)).collect()} == {0: 3, 1: 1, 2: 0}


def test_sensitivity_and_epsilon(spark):
    found = privacy.sensitivity(graph.degree(*star(spark))).withColumn("eps", privacy.epsilon(F.col("sens"))).orderBy("id").collect()
    assert [r["eps"] for r in found] == pytest.approx([0.5, 1.5, 1.5, 1.5])


def test_split_sizes(spark):
    for n, sizes in ((10, (6, 2, 2)), (7, (4, 1, 2))):
        m = spark.range(n).select(F.lit(0).alias("cid"), F.col("id").alias("gid"))
        found = {r["split"]: r["count"] for r in graph.split_masks(m, F.col("gid")).groupBy("split").count().collect()}
        assert (found["train"], found["val"], found["test"]) == sizes


def test_activations(spark):
    r = spark.createDataFrame([([-1.0, 0.0, 1.0, 2.0], [1.0, 2.0, 3.0])], "a array<double>, b array<double>")
    row = r.select(learn.relu(F.col("a")).alias("r"), learn.softmax(F.col("b")).alias("s")).first()
    assert row["r"] == [0, 0, 1, 2] and row["s"] == pytest.approx([0.09003057, 0.24472847, 0.66524096])


def test_sketch_positions(spark):
    found = spark.range(1).select(sketch_positions(bytes(16), F.lit("0-1"), 8192, 4).alias("p")).first()["p"]
    assert found == [1275, 889, 3144, 7818]
    assert found[1] == int.from_bytes(hashlib.sha256((1).to_bytes(4, "big") + bytes(16) + b"0-1").digest()[:8], "big") % 8192


def test_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("from,to\n1,2\n2,3\n")
    (tmp_path / "f.json").write_text(json.dumps({"1": [3, 17], "2": [4]}))
    (tmp_path / "a.csv").write_text("n,a,b\n0,0,1\n1,1,0\n")
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="a"/><edge source="a" target="b"/><edge source="b" target="c"/></graph></graphml>')
    at = lambda name: f"file://{tmp_path}/{name}"
    assert {tuple(r) for r in files.edge_list(spark, at("e.csv")).collect()} == {(1, 2), (2, 3)}
    assert {tuple(r) for r in files.sparse_features(spark, at("f.json")).collect()} == {(1, 3), (1, 17), (2, 4)}
    assert [tuple(r) for r in files.adjacency_csv(spark, at("a.csv")).collect()] == [(0, 1)]
    assert {tuple(r) for r in files.graphml_edges(spark, at("g.graphml")).collect()} == {("a", "b"), ("b", "c")}


def test_round_log_stream(spark, tmp_path):
    schema = "round int, global_acc double, comms_mb double"
    spark.createDataFrame([(1, 0.5, 1.0), (2, 0.7, 1.0)], schema).write.parquet(f"file://{tmp_path}/log")
    live = round_log.latest(round_log.round_log(spark, f"file://{tmp_path}/log", schema))
    query = live.writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert tuple(spark.table("live").first()) == (2, 0.7, 2.0)


def test_softmax_of_long_vectors(spark):
    """A cost that grows with the vector, not with its cube, and the same values."""
    from skein.operators import learn

    rows = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, None), (2, []), (3, [0.0] * 2000)], "id int, v array<double>")
    found = {r["id"]: r["p"] for r in rows.select("id", learn.softmax(F.col("v")).alias("p")).collect()}
    e = [math.exp(x - 3) for x in (1, 2, 3)]
    assert found[0] == [x / (sum(e) + 1e-10) for x in e] and found[1] is None and found[2] == [] and found[3] == [1 / (2000 + 1e-10)] * 2000
