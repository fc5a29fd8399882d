import itertools
from dataclasses import replace

import numpy as np
import pytest

from skein.operators import generate, train
from skein.sources import files, sinks


def toy(model="gcn", dropout=0.0):
    rng = np.random.default_rng(1)
    y = np.array([0, 1, 2, 0, 1, 2, 0])
    split = np.array(["train"] * 5 + ["val", "test"])
    g = train.Graph(rng.normal(size=(7, 5)), y, split, np.array([0, 1, 2, 3, 4]), np.array([1, 2, 3, 4, 5]))
    cfg = train.Config(model=model, hidden=4, heads=2, dropout=dropout, clip=1e9)
    return cfg, g, train.shapes(cfg, 5, 3)


def test_normalised_adjacency_of_a_star():
    g = train.Graph(np.eye(4), np.zeros(4, int), np.array(["train"] * 4), np.zeros(3, int), np.array([1, 2, 3]))
    a = g.spread(np.eye(4))
    assert a[0] == pytest.approx([0.25, 0.35355339, 0.35355339, 0.35355339]) and np.diag(a)[1:] == pytest.approx(0.5)


def test_masked_gradient_leaves_other_rows_out():
    cfg, g, sizes = toy()
    cfg = replace(cfg, masked=True)
    flat, mask = train.initial(sizes, 3), g.split == "train"
    grad, _ = train.gradient(cfg, g, flat, sizes, mask, np.random.default_rng(0))
    value = lambda w: train.loss_of(train.forward(cfg, g, train.cut(w, sizes))[0], g.y, mask)
    step = np.eye(len(flat))[4] * 1e-6
    assert grad[4] == pytest.approx((value(flat + step) - value(flat - step)) / 2e-6, abs=1e-5)


def test_gradient_with_all_rows_in_the_mask_equals_differences():
    cfg, g, sizes = toy()
    flat, mask = train.initial(sizes, 3), np.ones(7, bool)
    grad, _ = train.gradient(cfg, g, flat, sizes, mask, np.random.default_rng(0))
    value = lambda w: train.loss_of(train.forward(cfg, g, train.cut(w, sizes))[0], g.y, mask)
    for at in range(len(flat)):
        step = np.zeros_like(flat)
        step[at] = 1e-6
        assert grad[at] == pytest.approx((value(flat + step) - value(flat - step)) / 2e-6, abs=1e-5)


def test_attention_equals_a_loop():
    cfg, g, sizes = toy("gat")
    w, to, at = train.cut(train.initial(sizes, 3), sizes)[:3]
    wh = g.x @ w
    for i, row in enumerate(g.attend(g.x, w, to, at)):
        out = g.v[g.u == i]
        s = np.array([(wh[i] @ to + wh[j] @ at)[0] for j in out])
        e = np.exp(np.where(s >= 0, s, 0.2 * s))
        assert row == pytest.approx((e[:, None] * wh[out]).sum(0) / e.sum() if len(out) else wh[i])
    assert train.forward(cfg, g, train.cut(train.initial(sizes, 3), sizes))[0].sum(1) == pytest.approx(1)


def test_unknown_model_and_heads():
    with pytest.raises(ValueError):
        train.shapes(train.Config(model="rgcn"), 5, 3)
    with pytest.raises(ValueError):
        train.shapes(train.Config(model="gat", hidden=5, heads=2), 5, 3)


def test_preferential_graph(spark):
    edges = [tuple(r) for r in generate.preferential_graph(spark, 1000).collect()]
    assert len(edges) == len(set(edges)) == 2991 and all(u < v for u, v in edges)
    assert min(np.bincount(np.array(edges).ravel(), minlength=1000)) >= 1


def test_greedy_communities(spark):
    cliques = [[(a, b) for a, b in itertools.combinations(range(5 * k, 5 * k + 5), 2)] for k in range(3)]
    edges = spark.createDataFrame([*itertools.chain(*cliques), (4, 5), (9, 10)], "u long, v long")
    found = dict(map(tuple, generate.greedy_communities(edges, spark.range(16)).collect()))
    assert found == {k: k // 5 * 5 for k in range(16)}


def test_training_learns(spark):
    rng = np.random.default_rng(0)
    rows = [(c, 100 * c + k, (np.eye(4)[k % 3] * 3 + rng.normal(0, 0.1, 4)).tolist(), k % 3, "train" if k < 18 else "val" if k < 24 else "test") for c in range(3) for k in range(30)]
    nodes = spark.createDataFrame(rows, "cid long, gid long, x array<double>, y int, split string")
    edges = spark.createDataFrame([(c, 100 * c + k, 100 * c + k + 3) for c in range(3) for k in range(27)], "cid long, u long, v long")
    cfg = train.Config(hidden=8, dropout=0.0, rounds=4, local_epochs=40, rate=0.5, masked=True)
    found = train.federated_run(nodes, edges, cfg)
    assert len(found.weights) == 4 * 8 + 8 * 3 and [r["round"] for r in found.log.orderBy("round").collect()] == [1, 2, 3, 4]
    assert found.log.orderBy("round").collect()[-1]["global_acc"] > 0.9
    assert found.overlaps.count() == 0 and found.sketches.select("cid").distinct().count() == 3


def test_client_sends_noise_and_sketches(spark, tmp_path):
    """Shared nodes' embeddings come noisy from every client that has them; the store keeps log and checkpoints."""
    rows = [(c, 10 * c + k, [float(k == j) for j in range(3)], k % 3, "train" if k < 6 else "val", k < 2) for c in range(2) for k in range(9)]
    rows += [(1, 0, [1.0, 0.0, 0.0], 0, "train", True)]
    nodes = spark.createDataFrame(rows, "cid long, gid long, x array<double>, y int, split string, is_overlap boolean")
    edges = spark.createDataFrame([(c, 10 * c + k, 10 * c + k + 1) for c in range(2) for k in range(8)], "cid long, u long, v long")
    store = sinks.RunStore(spark, f"file://{tmp_path}/run", "a")
    cfg = train.Config(hidden=4, rounds=10, local_epochs=1)
    found = train.federated_run(nodes, edges, cfg, store)
    shared = {r["gid"]: r for r in found.overlaps.collect()}
    assert set(shared) == {0, 1, 10, 11} and shared[0]["clients"] == 2 and len(shared[0]["z"]) == 4
    log = found.log.orderBy("round").collect()
    assert len(log) == 10 and log[0].asDict().keys() == {"round", "global_acc", "global_test_acc", "global_f1", "worst_client_f1", "best_client_f1", "fairness_gap", "mean_eps", "cumulative_eps", "comms_mb", "round_time_s"}
    assert log[0]["comms_mb"] == round(2 * (4 * (3 * 4 + 4 * 3) + 8192) / 1024 / 1024, 4) and log[-1]["cumulative_eps"] == pytest.approx(10 * log[0]["mean_eps"], abs=1e-3)
    assert store.read_log().count() == 10 and spark.read.option("header", True).csv(f"file://{tmp_path}/run/log_csv").count() == 10
    assert len(spark.read.parquet(f"file://{tmp_path}/run/checkpoints").first()["weights"]) == len(found.weights)
    silent = train.federated_run(nodes, edges, replace(cfg, rounds=1, noise=False, sketch=False))
    assert silent.overlaps is None and silent.sketches is None and silent.log.first()["mean_eps"] == 2.0
    assert silent.log.first()["comms_mb"] == round(2 * 4 * 24 / 1024 / 1024, 4)


def test_empty_clients(spark):
    nodes = spark.createDataFrame([], "cid long, gid long, x array<double>, y int, split string")
    edges = spark.createDataFrame([], "cid long, u long, v long")
    assert train.federated_run(nodes, edges, train.Config(rounds=2)).log.count() == 0


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.gml").write_text('graph [ node [ id 0 ] node [ id 1 ]\n edge [ source 0 target 1 ]\n edge [\n source 1\n target 2 ] ]')
    (tmp_path / "g.gexf").write_text('<gexf><graph><edges><edge source="a" target="b"/><edge source="b" target="c"/></edges></graph></gexf>')
    np.save(tmp_path / "a.npy", np.array([[0, 1], [1, 0]]))
    at = lambda name: f"file://{tmp_path}/{name}"
    assert [tuple(r) for r in files.gml_edges(spark, at("g.gml")).collect()] == [("0", "1"), ("1", "2")]
    assert {tuple(r) for r in files.gexf_edges(spark, at("g.gexf")).collect()} == {("a", "b"), ("b", "c")}
    assert [tuple(r) for r in files.adjacency_npy(spark, at("a.npy")).collect()] == [(0, 1)]


def small_clients(spark):
    rows = [(c, 10 * c + k, [float(k == j) for j in range(3)], k % 3, "train" if k < 6 else "val", k < 2) for c in range(3) for k in range(9)] + [(1, 0, [1.0, 0.0, 0.0], 0, "train", True)]
    nodes = spark.createDataFrame(rows, "cid long, gid long, x array<double>, y int, split string, is_overlap boolean")
    return nodes, spark.createDataFrame([(c, 10 * c + k, 10 * c + k + 1) for c in range(3) for k in range(8)], "cid long, u long, v long")


class Stopped(Exception):
    pass


@pytest.mark.parametrize("where", ["training", "between log and marker"])
def test_a_stopped_run_goes_on_as_if_it_never_stopped(spark, tmp_path, monkeypatch, where):
    nodes, edges = small_clients(spark)
    cfg = train.Config(hidden=4, rounds=6, local_epochs=2, fraction=0.7)
    whole = train.federated_run(nodes, edges, cfg)
    store = sinks.RunStore(spark, f"file://{tmp_path}/run", "a")
    store.log(spark.createDataFrame([(9, *[0.0] * 10)], train.LOG))  # of an older run; a new one starts anew
    with monkeypatch.context() as m:
        if where == "training":
            real = train.client_updates

            def client_updates(*args):
                if args[-1] == 4:
                    raise Stopped
                return real(*args)

            m.setattr(train, "client_updates", client_updates)
        else:
            log = sinks.RunStore.log

            def stop(self, rows):
                log(self, rows)
                if rows.count() == 4:
                    raise Stopped

            m.setattr(sinks.RunStore, "log", stop)
        with pytest.raises(Stopped):
            train.federated_run(nodes, edges, cfg, store)
    assert store.read_log().count() == (3 if where == "training" else 4)
    again = sinks.RunStore(spark, f"file://{tmp_path}/run", "a")
    assert again.committed()[0] == 3 and again.read_log().count() == 3
    found = train.federated_run(nodes, edges, cfg, again, resume=True)
    plain = lambda log: sorted(tuple(r)[:-1] for r in log.collect())  # noqa: E731 - without the seconds
    assert found.weights.tolist() == pytest.approx(whole.weights.tolist(), rel=1e-12)
    assert plain(found.log) == plain(whole.log) == plain(again.read_log())
    assert sorted(map(tuple, found.merges.collect())) == sorted(map(tuple, whole.merges.collect()))
    assert train.federated_run(nodes, edges, cfg, again, resume=True).weights.tolist() == found.weights.tolist()  # nothing is left to do
    assert again._numbers(f"file://{tmp_path}/run/state/run=a") == [5, 6]


def test_every_round_is_merged(spark):
    nodes, edges = small_clients(spark)
    found = train.federated_run(nodes, edges, train.Config(hidden=4, rounds=3, local_epochs=1))
    merges = found.merges.orderBy("round").collect()
    assert [r["round"] for r in merges] == [1, 2, 3] and {r["shared_nodes"] for r in merges} == {found.overlaps.count()} == {6}
    assert all(r["sketches"] == 3 and 0 < r["density"] <= 3 * 8 * 4 / 8192 and r["est_fpr"] == pytest.approx(r["density"] ** 4) for r in merges)
    silent = train.federated_run(nodes, edges, train.Config(hidden=4, rounds=1, local_epochs=1, noise=False, sketch=False)).merges.first()
    assert tuple(silent) == (1, 0, None, None, 0)


def test_features_are_spread_once_a_client(monkeypatch):
    r, calls, spread = np.random.default_rng(1), [], train.Graph.spread
    u, v = r.integers(0, 30, (2, 90))
    g = train.Graph(r.normal(size=(30, 5)), r.integers(0, 3, 30), np.array(["train"] * 30), u, v)
    dense = np.eye(30)
    dense[u, v] = dense[v, u] = 1
    dense /= np.sqrt(np.outer(dense.sum(1), dense.sum(1)))
    assert np.allclose(g.spread(g.x), dense @ g.x, rtol=1e-12, atol=1e-14)
    monkeypatch.setattr(train.Graph, "spread", lambda self, h: calls.append(h is self.x) or spread(self, h))
    cfg = train.Config(hidden=4, dropout=0.5)
    sizes = train.shapes(cfg, 5, 3)
    for _ in range(4):
        train.gradient(cfg, g, train.initial(sizes, 1), sizes, np.ones(30, bool), r)
    assert sum(calls) == 1 and len(calls) == 1 + 3 * 4
    assert train.Graph(np.zeros((0, 5)), np.zeros(0, int), np.zeros(0, str), np.zeros(0, int), np.zeros(0, int)).spread(np.zeros((0, 5))).shape == (0, 5)
