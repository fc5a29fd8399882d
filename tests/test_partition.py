import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions.hashing import digest, uniform, uniform_of
from skein.operators import federate, gnn, graph, learn, logs, partition, privacy, sketches, train
from skein.operators.ranks import hash_bucket, number_bucket, ranked
from skein.sources import datasets, files

# The karate club: 34 people, their friendships and the two sides they took.
CLUB = [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (0, 6), (0, 7), (0, 8), (0, 10), (0, 11), (0, 12), (0, 13), (0, 17), (0, 19), (0, 21), (0, 31), (1, 2), (1, 3), (1, 7), (1, 13), (1, 17), (1, 19), (1, 21), (1, 30), (2, 3), (2, 7), (2, 8), (2, 9), (2, 13), (2, 27), (2, 28), (2, 32), (3, 7), (3, 12), (3, 13), (4, 6), (4, 10), (5, 6), (5, 10), (5, 16), (6, 16), (8, 30), (8, 32), (8, 33), (9, 33), (13, 33), (14, 32), (14, 33), (15, 32), (15, 33), (18, 32), (18, 33), (19, 33), (20, 32), (20, 33), (22, 32), (22, 33), (23, 25), (23, 27), (23, 29), (23, 32), (23, 33), (24, 25), (24, 27), (24, 31), (25, 31), (26, 29), (26, 33), (27, 33), (28, 31), (28, 33), (29, 32), (29, 33), (30, 32), (30, 33), (31, 32), (31, 33), (32, 33)]


def club(spark):
    nodes = spark.range(34).select("id", F.array(F.col("id") % 5 * 1.0, F.lit(1.0)).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    return partition.GraphData(nodes, spark.createDataFrame(CLUB, "u long, v long"), ("a", "b"))


@pytest.mark.parametrize("communities", ["labels", "greedy"])
def test_partition_of_the_club(spark, tmp_path, communities):
    data = club(spark)
    found = partition.partition_federated(data, 3, 0.1, "1", communities)
    rows = found.nodes.collect()
    owners = Counter(r["gid"] for r in rows)
    assert set(owners) == set(range(34)) and sorted(owners.values()).count(2) == 3 and max(owners.values()) == 2
    assert {r["gid"] for r in rows if r["is_overlap"]} == {g for g, n in owners.items() if n == 2}
    for cid in {r["cid"] for r in rows}:
        own = sorted((r for r in rows if r["cid"] == cid), key=lambda r: r["gid"])
        n = len(own)
        assert [r["lid"] for r in own] == list(range(n))
        assert Counter(r["split"] for r in own) == +Counter(train=int(0.6 * n), val=int(0.2 * n), test=n - int(0.6 * n) - int(0.2 * n))
        members = {r["gid"] for r in own}
        assert {(r["u"], r["v"]) for r in found.edges.where(F.col("cid") == cid).collect()} == {(u, v) for u, v in CLUB if u in members and v in members}
    stats = {r["cid"]: r for r in partition.client_stats(found).collect()}
    assert sum(r["nodes"] for r in stats.values()) == 37 and sum(r["overlap"] for r in stats.values()) == 6
    partition.save(data, found, 3, f"file://{tmp_path}/store", dataset="club", overlap=0.1)
    again = partition.load(spark, f"file://{tmp_path}/store")
    key = lambda rs: sorted((r["cid"], r["gid"], r["lid"], r["split"], r["is_overlap"], tuple(r["x"]), r["y"]) for r in rs)
    assert key(again.nodes.collect()) == key(rows) and again.edges.count() == found.edges.count()
    assert {r["cid"] for r in partition.load(spark, f"file://{tmp_path}/store", [0]).nodes.collect()} == {0}
    assert partition.summary(spark, f"file://{tmp_path}/store") == {"num_nodes": 34, "num_edges": 78, "num_classes": 2, "in_dim": 2, "num_clients": 3, "label_classes": ["a", "b"], "dataset": "club", "overlap": 0.1}
    with pytest.raises(FileNotFoundError):
        partition.load(spark, f"file://{tmp_path}/nothing")


def test_one_client_has_all(spark):
    rows = partition.partition_federated(club(spark), 1, 0.5).nodes.collect()
    assert Counter(r["gid"] for r in rows) == Counter(range(34)) and {r["cid"] for r in rows} == {0}


def test_ranks(spark):
    rng = np.random.default_rng(0)
    values = [(int(v), int(g)) for v, g in zip(rng.integers(0, 500, 700), rng.integers(0, 3, 700))] + [(None, 1)]
    rows = spark.createDataFrame([(i, v, g) for i, (v, g) in enumerate(values)], "id long, v long, g int").repartition(5)
    found = {r["id"]: r["rank"] for r in ranked(rows, [F.col("v"), F.col("id")], [number_bucket(rows, "v")], ("g",)).collect()}
    for g in range(3):
        order = sorted((i for i, (_, h) in enumerate(values) if h == g), key=lambda i: (values[i][0] is not None, values[i][0] or 0, i))
        assert [found[i] for i in order] == list(range(len(order)))
    hashed = rows.withColumn("h", digest("s", F.col("id")))
    order = [r["rank"] for r in ranked(hashed, [F.col("h")], [hash_bucket(F.col("h"))]).orderBy("h").collect()]
    assert order == list(range(len(values)))
    assert ranked(rows.limit(0), [F.col("v")], [number_bucket(rows.limit(0), "v")]).count() == 0


def test_values_of_hashes_agree(spark):
    row = spark.range(1).select(uniform(F.lit("s"), F.lit(3), F.lit("k")).alias("u")).first()
    assert row["u"] == uniform_of("s", 3, "k")


def test_propagation_is_a_matrix_product(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(34, 6))
    a = np.eye(34)
    for u, v in CLUB:
        a[u, v] = a[v, u] = 1
    d = 1 / np.sqrt(a.sum(1))
    a = a * d[:, None] * d[None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    a_hat = graph.norm_adj(club(spark).edges, spark.range(34))
    found = {r["id"]: r["x"] for r in graph.propagate(a_hat, rows).collect()}
    assert np.allclose([found[i] for i in range(34)], a @ x)
    w = rng.normal(size=(6, 3))
    found = {r["id"]: r["x"] for r in graph.multiply(rows, w.tolist()).collect()}
    assert np.allclose([found[i] for i in range(34)], x @ w)
    found = {r["id"]: r["x"] for r in learn.standard_scale_vectors(rows.withColumn("x", F.array_append("x", F.lit(7.0)))).collect()}
    assert np.allclose([found[i][:6] for i in range(34)], (x - x.mean(0)) / x.std(0)) and all(found[i][6] == 0 for i in range(34))


def test_relational_networks_equal_a_client(spark):
    """Forward passes and the gradient as plans and in one task."""
    rng = np.random.default_rng(2)
    x, y, mask = rng.normal(size=(34, 5)), np.arange(34) % 3, np.arange(34) < 20
    u, v = np.array(CLUB).T
    g = train.Graph(x, y, np.where(mask, "train", "test"), u, v)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    edges = club(spark).edges
    cfg = train.Config(hidden=4, dropout=0.0, clip=0.05)
    sizes = train.shapes(cfg, 5, 3)
    flat = train.initial(sizes, 1)
    w0, w1 = (m.tolist() for m in train.cut(flat, sizes))
    a_hat = graph.norm_adj(edges, spark.range(34))
    found = {r["id"]: r["p"] for r in gnn.gcn_forward(a_hat, rows, w0, w1).collect()}
    assert np.allclose([found[i] for i in range(34)], train.forward(cfg, g, train.cut(flat, sizes))[0])
    labels = spark.createDataFrame([(i, int(c), bool(m)) for i, (c, m) in enumerate(zip(y, mask))], "id long, y int, train boolean")
    want, _ = train.gradient(cfg, g, flat, sizes, mask, rng)
    found = sorted((r["matrix"], r["r"], r["c"], r["g"]) for r in gnn.clipped(gnn.gcn_gradient(a_hat, rows, labels, w0, w1), 0.05).collect())
    assert np.allclose([r[3] for r in found], want)
    cfg = train.Config(model="gat", hidden=4, heads=2)
    sizes = train.shapes(cfg, 5, 3)
    parts = train.cut(train.initial(sizes, 1), sizes)
    heads = [gnn.Head(*(parts[3 * k].tolist(), parts[3 * k + 1][:, 0].tolist(), parts[3 * k + 2][:, 0].tolist())) for k in range(3)]
    found = {r["id"]: r["p"] for r in gnn.gat_forward(edges, rows, heads[:2], heads[2]).collect()}
    assert np.allclose([found[i] for i in range(34)], train.forward(cfg, g, parts)[0])
    alone = {r["id"]: r["x"] for r in gnn.gat_layer(edges.limit(0), rows, heads[:1]).collect()}
    assert np.allclose([alone[i] for i in range(34)], x @ parts[0])


def test_clip_update_leaves_zero_and_small_updates(spark):
    rows = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0), (1, 0, 3.0), (1, 1, 4.0), (2, 0, 0.1), (2, 1, 0.0)], "cid long, k int, w double")
    found = {(r["cid"], r["k"]): r["w"] for r in federate.clip_update(rows).collect()}
    assert found == pytest.approx({(0, 0): 0, (0, 1): 0, (1, 0): 0.6, (1, 1): 0.8, (2, 0): 0.1, (2, 1): 0})


def test_noise_and_sketches_of_clients(spark):
    nodes = spark.createDataFrame([(c, g, g == 1, [0.5, -3.0]) for c, g in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 3))], "cid long, gid long, is_overlap boolean, x array<double>")
    edges = spark.createDataFrame([(0, 0, 1), (0, 0, 2)], "cid long, u long, v long")
    eps = {(r["cid"], r["gid"]): r["eps"] for r in privacy.client_epsilon(nodes, edges).collect()}
    assert eps == pytest.approx({(0, 0): 0.5, (0, 1): 1.25, (0, 2): 1.25, (1, 1): 2.0, (1, 3): 2.0})
    noisy = privacy.na_encode(nodes, edges).collect()
    assert sorted((r["cid"], r["gid"], r["z"]) for r in noisy) == sorted((r["cid"], r["gid"], r["z"]) for r in privacy.na_encode(nodes.repartition(3), edges).collect())
    both = [np.array(r["z"]) for r in noisy if r["gid"] == 1]
    merged = privacy.overlap_merge(privacy.na_encode(nodes, edges).where("is_overlap")).collect()
    assert [(r["gid"], r["clients"]) for r in merged] == [(1, 2)] and merged[0]["z"] == pytest.approx(sum(both) / 2)
    same = spark.createDataFrame([(0, 5, 6), (1, 6, 5)], "cid long, u long, v long")
    bits = privacy.bloom_encode(same)
    assert {(r["cid"], len(r["bits"])) for r in bits.collect()} == {(0, 1024), (1, 1024)}
    assert Counter(r["cid"] for r in sketches.positions(bits).collect()) == {0: 4, 1: 4}  # other salts, other bits
    stats = privacy.sketch_stats(bits).first()
    assert stats["density"] == pytest.approx(8 / 8192) and stats["est_fpr"] == pytest.approx((8 / 8192) ** 4) and stats["num_clients"] == 2


def write(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_three_files(spark, tmp_path):
    edges = write(tmp_path / "x_edges.csv", "id_1,id_2\n10,2\n2,10\n2,30\n30,30\n")
    features = write(tmp_path / "x_features.json", json.dumps({"2": [0, 2], "10": [2], "99": [1], "30": "none"}))
    target = write(tmp_path / "x_target.csv", "id,page_type,other\n2,tv,1\n10,film,2\n10,tv,3\n")
    data = datasets.sparse_graph(spark, edges, features, target)
    assert data.classes == ("tv", "unknown") and {(r["u"], r["v"]) for r in data.edges.collect()} == {(0, 1), (0, 2), (2, 2)}
    rows = {r["id"]: r for r in data.nodes.collect()}
    raw = np.array([[1.0, 0, 1], [0, 0, 1], [0, 0, 0]])
    deviation = raw.std(0)
    deviation[deviation == 0] = 1
    assert np.allclose([rows[i]["x"] for i in range(3)], (raw - raw.mean(0)) / deviation) and [rows[i]["y"] for i in range(3)] == [0, 0, 1]
    assert datasets.page_graph(spark, f"file://{tmp_path}") is None
    for part, name in (("edges.csv", edges), ("features.json", features), ("target.csv", target)):
        (tmp_path / f"musae_facebook_{part}").write_text(open(name[7:]).read())
        (tmp_path / f"git_{part}").write_text(open(name[7:]).read())
    assert datasets.page_graph(spark, f"file://{tmp_path}").nodes.count() == datasets.catalogue_graph(spark, "github", f"file://{tmp_path}").nodes.count() == 3
    with pytest.raises(ValueError):
        datasets.catalogue_graph(spark, "nothing", ".")
    dense = write(tmp_path / "f.csv", "node_id,a,b\n2,1.5,2\n30,0.5,1\n")
    data = datasets.format_a(spark, edges, dense, target, "page_type")
    assert data.nodes.agg(F.max(F.size("x"))).first()[0] == 2 and data.nodes.count() == 3
    numbers = write(tmp_path / "n_target.csv", "id,label\n2,10\n10,9\n30,9\n")
    assert datasets.format_a(spark, edges, dense, numbers).classes == ("9.0", "10.0")


def test_nodes_that_are_texts(spark, tmp_path):
    edges = write(tmp_path / "e.csv", "a,b\nzoe,amy\namy,7\nümit,zoe\n")
    target = write(tmp_path / "t.csv", "n,kind\nzoe,x\n7,y\n")
    data = datasets.format_a(spark, edges, write(tmp_path / "f.json", json.dumps({"zoe": [1], "nobody": [0]})), target)
    order = ["7", "amy", "zoe", "ümit"]
    assert {(r["u"], r["v"]) for r in data.edges.collect()} == {(1, 2), (0, 1), (2, 3)} and data.classes == ("unknown", "x", "y")
    assert {order[r["id"]]: r["y"] for r in data.nodes.collect()} == {"7": 2, "amy": 0, "zoe": 1, "ümit": 0}
    dense = datasets.format_a(spark, edges, write(tmp_path / "d.csv", "n,f\namy,3\n"), target)
    assert [r["x"][0] > 0 for r in dense.nodes.orderBy("id").collect()] == [False, True, False, False]


def test_matrix(spark, tmp_path):
    matrix = write(tmp_path / "m.csv", "n,a,b,c\n0,0,1,0\n1,1,0,2\n2,0,0,0\n")
    data = datasets.format_b(spark, matrix, labels=write(tmp_path / "l.csv", "n,kind\nx,b\ny,a\nz,b\n"))
    assert {(r["u"], r["v"]) for r in data.edges.collect()} == {(0, 1), (1, 2)} and data.classes == ("a", "b")
    assert {r["id"]: (r["x"], r["y"]) for r in data.nodes.collect()} == {0: ([1.0], 1), 1: ([2.0], 0), 2: ([1.0], 1)}
    np.save(tmp_path / "m.npy", np.array([[0, 1, 0], [1, 0, 2], [0, 0, 0]]))
    data = datasets.format_b(spark, f"file://{tmp_path}/m.npy", write(tmp_path / "f.csv", "n,a\n0,1\n1,2\n2,3\n"), communities="greedy")
    assert sorted(r["x"][0] for r in data.nodes.collect()) == pytest.approx([-np.sqrt(1.5), 0.0, np.sqrt(1.5)])


GRAPHML = """<graphml><key id="d0" for="node" attr.name="age" attr.type="int"/><key id="d1" for="node" attr.name="kind" attr.type="string"/><key id="d2" for="edge" attr.name="w"/>
<graph edgedefault="directed"><node id="a"><data key="d0">3</data><data key="d1">x</data></node><node id="b"><data key="d1">y</data></node><node id="c"/>
<edge source="a" target="b"><data key="d2">1</data></edge><edge source="b" target="a"/><edge source="b" target="c"/></graph></graphml>"""
GML = """graph [ node [ id 5 label "five" age 3 kind "x" ] node [ id 6 kind "y" label "six" ]
 node [ id 7 label "seven" ] edge [ source 5 target 6 ] edge [ source 6 target 7 ] ]"""
GEXF = """<gexf><graph><attributes class="node"><attribute id="0" title="age" type="integer"/><attribute id="1" title="kind" type="string"/></attributes><nodes>
<node id="a"><attvalues><attvalue for="0" value="3"/><attvalue for="1" value="x"/></attvalues></node><node id="b"><attvalues><attvalue for="1" value="y"/></attvalues></node><node id="c"/></nodes>
<edges><edge source="a" target="b"/><edge source="b" target="c"/></edges></graph></gexf>"""


@pytest.mark.parametrize(("name", "text"), [("g.graphml", GRAPHML), ("g.gml", GML), ("g.gexf", GEXF), ("g.gexf.gz", GEXF)])
def test_graph_files_with_attributes(spark, tmp_path, name, text):
    path = tmp_path / name
    if name.endswith(".gz"):
        import gzip

        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    data = datasets.format_c(spark, f"file://{path}", "kind", ["age"])
    assert {(r["u"], r["v"]) for r in data.edges.collect()} == {(0, 1), (1, 2)} and data.classes == ("unknown", "x", "y")
    rows = {r["id"]: r for r in data.nodes.collect()}
    assert [rows[i]["y"] for i in range(3)] == [1, 2, 0] and rows[0]["x"] == pytest.approx([np.sqrt(2)])
    plain = datasets.format_c(spark, f"file://{path}")
    assert plain.nodes.count() == 3 and plain.nodes.agg(F.max(F.size("x"))).first()[0] == (3 if name.endswith("gml") else 2)
    with pytest.raises(ValueError):
        datasets.format_c(spark, f"file://{tmp_path}/g.txt")


def test_suffix():
    assert [datasets.suffix(p) for p in ("a/B.GEXF.gz", "x.json", "a.b/c", "m.NPY")] == [".gexf.gz", ".json", "", ".npy"]


def test_log_tools(spark, tmp_path):
    demo = logs.demo(spark)
    assert demo.count() == 20 and logs.numeric_columns(demo) == ["global_acc", "global_f1", "worst_client_f1", "cumulative_eps", "comms_mb", "fairness_gap"]
    assert logs.first_metric(demo) == "global_acc" and logs.project(demo, logs.SHOWN).columns == ["round", "global_acc", "global_f1", "worst_client_f1", "fairness_gap", "cumulative_eps", "comms_mb"]
    assert demo.select(logs.value_or(demo, "global_test_acc", "global_acc").alias("v")).first()["v"] == demo.first()["global_acc"]
    assert logs.read_csv(spark, f"file://{tmp_path}/none.csv") is None
    demo.write.option("header", True).csv(f"file://{tmp_path}/log")
    assert logs.read_csv(spark, f"file://{tmp_path}/log").count() == 20


def test_flattening(spark):
    parts = spark.createDataFrame([(c, p, i, j, float(100 * c + 10 * i + j + (p == "b") * 1000)) for c in range(2) for p, n, m in (("a", 2, 3), ("b", 3, 1)) for i in range(n) for j in range(m)], "cid long, path string, i long, j long, w double")
    flat = federate.flattened(parts)
    assert [r["w"] for r in flat.where("cid = 1").orderBy("k").collect()] == [100, 101, 102, 110, 111, 112, 1100, 1110, 1120]
    back = federate.unflattened(flat, [("b", 3, 1), ("a", 2, 3)])
    assert Counter(map(tuple, back.select(*parts.columns).collect())) == Counter(map(tuple, parts.collect()))


def test_sparse_features_of_several_objects(spark, tmp_path):
    path = write(tmp_path / "f.json", '{"1": [3, 4]}\n{"2": [5], "3": "x"}\n')
    want = {(1, 3), (1, 4), (2, 5)}
    assert {tuple(r) for r in files.sparse_features(spark, path).collect()} == {tuple(r) for r in files.sparse_features(spark, path, lines=True).collect()} == want
