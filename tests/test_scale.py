"""Operators that used to rank rows or hold a graph in one task, against plain versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import generate, graph, modularity, ranks, thresholds


def digest(c):
    return F.sha2(F.concat(F.lit("s|"), c.cast("string")).cast("binary"), 256)


def hashed(x):
    return hashlib.sha256(f"s|{x}".encode()).hexdigest()


@pytest.mark.parametrize("few", [4096, 2, 0])
def test_sampling_by_thresholds(spark, monkeypatch, few):
    monkeypatch.setattr(thresholds, "FEW", few)
    ids = list(range(700)) if few else list(range(40))
    rows = spark.createDataFrame([(i, "x") for i in ids], "gid long, by string").repartition(4)
    order = sorted(ids, key=hashed)
    for rate in (0.0, 0.1, 0.5, 1.0):
        found = graph.sampled(rows, rate, digest(F.col("gid")))
        assert found.columns == rows.columns and {r["gid"] for r in found.collect()} == set(order[: int(len(ids) * rate)])
    for clients in (1, 3, 7):
        size = len(ids) // clients
        found = {r["gid"]: r["cid"] for r in graph.equal_clients(rows, clients, digest(F.col("gid"))).collect()}
        assert found == {i: min(k // size, clients - 1) for k, i in enumerate(order)}


def test_split_masks_by_thresholds(spark):
    rows = [(c, 1000 * c + i) for c, n in enumerate((1, 2, 3, 7, 10, 200)) for i in range(n)]
    found = {(r["cid"], r["gid"]): r["split"] for r in graph.split_masks(spark.createDataFrame(rows, "cid int, gid long"), digest(F.col("gid"))).collect()}
    for c, n in enumerate((1, 2, 3, 7, 10, 200)):
        order = sorted((g for d, g in rows if d == c), key=hashed)
        for k, g in enumerate(order):
            assert found[c, g] == ("train" if k < int(0.6 * n) else "val" if k < int(0.6 * n) + int(0.2 * n) else "test")
    assert len(found) == len(rows)
    assert graph.split_masks(spark.createDataFrame([], "cid int, gid long"), digest(F.col("gid"))).count() == 0


def test_sampling_has_no_window_over_rows(spark):
    rows = spark.range(1000).select(F.col("id").alias("gid"))
    for df in (graph.sampled(rows, 0.3, digest(F.col("gid"))), graph.equal_clients(rows, 3, digest(F.col("gid")))):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_text_buckets_are_even_whatever_the_prefix(spark):
    ids = spark.range(20_000).select(F.concat(F.lit("user_"), F.col("id").cast("string")).alias("id"))
    sizes = [r["count"] for r in ids.groupBy(ranks.text_bucket(ids, "id").alias("b")).count().collect()]
    assert len(sizes) > 32 and max(sizes) < 4 * 20_000 / 64
    found = {r["id"]: r["idx"] for r in graph.node_index(ids).collect()}
    assert found == {x: k for k, x in enumerate(sorted(f"user_{i}" for i in range(20_000)))}
    odd = ["", "a", "aa", "é", "日本", "𝒳", "￿", "Z", "user_1"]
    index = graph.node_index(spark.createDataFrame([(x,) for x in odd], "id string"))
    assert [r["id"] for r in index.orderBy("idx").collect()] == sorted(odd, key=str.encode)
    assert graph.node_index(spark.createDataFrame([], "id string")).count() == 0


def test_labels_of_text_nodes(spark):
    pairs = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    name = lambda k: f"n{k}"
    numbers = spark.createDataFrame(pairs, "u long, v long")
    texts = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "u string, v string")
    want = {r["id"]: r["label"] for r in graph.label_propagation(graph.adjacency(numbers, graph.node_set(numbers)), graph.node_set(numbers), 3).collect()}
    labels = graph.label_propagation(graph.adjacency(texts, graph.node_set(texts)), graph.node_set(texts), 3)
    assert {r["id"]: r["label"] for r in labels.collect()} == {name(a): name(b) for a, b in want.items()}
    assert {r["cid"] for r in graph.community_clients(labels, 2).collect()} <= {0, 1}


def score(spark, edges, labels):
    return modularity.modularity(edges, labels).first()["modularity"]


def plain_score(pairs, label):
    m, deg = len(pairs), {}
    for a, b in pairs:
        deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
    inside = sum(label[a] == label[b] for a, b in pairs) / m
    return inside - sum((sum(d for x, d in deg.items() if label[x] == c) / (2 * m)) ** 2 for c in set(label.values()))


CLUB = "1-0 2-0 2-1 3-0 3-1 3-2 4-0 5-0 6-0 6-4 6-5 7-0 7-1 7-2 7-3 8-0 8-2 9-2 10-0 10-4 10-5 11-0 12-0 12-3 13-0 13-1 13-2 13-3 16-5 16-6 17-0 17-1 19-0 19-1 21-0 21-1 25-23 25-24 27-2 27-23 27-24 28-2 29-23 29-26 30-1 30-8 31-0 31-24 31-25 31-28 32-2 32-8 32-14 32-15 32-18 32-20 32-22 32-23 32-29 32-30 32-31 33-8 33-9 33-13 33-14 33-15 33-18 33-19 33-20 33-22 33-23 33-26 33-27 33-28 33-29 33-30 33-31 33-32"


def graphs():
    r = np.random.default_rng(6)
    blocks = {(int(a), int(b)) for k in range(8) for a, b in 40 * k + r.integers(0, 40, (160, 2)) if a != b} | {(int(a), int(b)) for a, b in r.integers(0, 320, (120, 2)) if a != b}
    return {
        "club": [tuple(map(int, p.split("-"))) for p in CLUB.split()], "blocks": sorted(blocks), "star": [(0, k) for k in range(1, 300)],
        "cliques": [(8 * c + i, 8 * c + j) for c in range(12) for i in range(8) for j in range(i)] + [(8 * c, (8 * c + 8) % 96) for c in range(12)],
    }


@pytest.mark.parametrize("name, share", [("club", 0.95), ("blocks", 0.95), ("star", 1.0), ("cliques", 0.95)])
def test_modularity_is_near_the_greedy_one(spark, name, share):
    pairs = sorted({(min(a, b), max(a, b)) for a, b in graphs()[name]})
    edges = spark.createDataFrame(pairs, "u long, v long")
    nodes = graph.node_set(edges)
    greedy = {r["id"]: r["label"] for r in generate.greedy_communities(edges, nodes).collect()}
    found = modularity.modularity_communities(edges, nodes)
    label = {r["id"]: r["label"] for r in found.collect()}
    assert score(spark, edges, found) == pytest.approx(plain_score(pairs, label)) and set(label) == set(greedy)
    assert all(min(x for x, c in label.items() if c == label[y]) == label[y] for y in label)
    assert plain_score(pairs, label) >= share * plain_score(pairs, greedy) - 1e-9


def test_modularity_of_odd_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), (None, "a")], "u string, v string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"] + [("a",)], "id string")
    assert {r["id"]: r["label"] for r in modularity.modularity_communities(edges, nodes).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}
    assert modularity.modularity_communities(edges.limit(0), nodes.limit(0)).count() == 0
    assert modularity.modularity_communities(edges.limit(0), nodes).select("label").distinct().count() == 4


def test_greedy_merges_keep_two_entries_an_edge(monkeypatch):
    import numpy as np

    from skein.operators import generate

    r, most = np.random.default_rng(2), 0
    u = r.integers(0, 2000, 6000)
    pairs = np.unique(np.stack([np.minimum(u, 6001), (u * 7 + 3) % 2000, u, u + 1]).T.reshape(-1, 2), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]

    class Heap:
        heapify, heappop = staticmethod(generate.heapq.heapify), staticmethod(generate.heapq.heappop)

        @staticmethod
        def heappush(heap, x, push=generate.heapq.heappush):
            nonlocal most
            push(heap, x)
            most = max(most, len(heap))

    monkeypatch.setattr(generate, "heapq", Heap)
    nodes = np.unique(pairs)
    found = generate.merged_communities(pairs[:, 0], pairs[:, 1], nodes)
    assert len(found) == len(nodes) and (found <= nodes).all() and most <= 2 * len(pairs)


def test_greedy_merges_put_few_old_entries_back(monkeypatch):
    """A community keeps its pairs in an order that its own growth leaves as it is."""
    import numpy as np

    from skein.operators import generate

    r, pops = np.random.default_rng(4), 0
    u, n = np.arange(20_000), 20_000
    pairs = np.concatenate([np.stack([u, (u + k) % n], axis=1) for k in (1, 2)] + [np.stack([u, r.permutation(n)], axis=1)])
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)

    class Heap:
        heapify, heappush = staticmethod(generate.heapq.heapify), staticmethod(generate.heapq.heappush)

        @staticmethod
        def heappop(heap, pop=generate.heapq.heappop):
            nonlocal pops
            pops += 1
            return pop(heap)

    monkeypatch.setattr(generate, "heapq", Heap)
    found = generate.merged_communities(pairs[:, 0], pairs[:, 1], u)
    assert (found <= u).all() and pops < 4 * len(pairs)
