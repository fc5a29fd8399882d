import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import federate, robust, selection


def frame(spark, x):
    rows = [(i, k, None if v is None else float(v)) for i, row in enumerate(x) for k, v in enumerate(row)]
    return spark.createDataFrame(rows, "cid long, k int, w double").repartition(5)


def near(a, b):
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)))


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    x = r.normal(size=(41, 9)) * 10.0 ** r.integers(-6, 6, 9)
    x[5] = x[7]  # equal updates
    x[9] = x[7] * (1 + 1e-12)
    return x


@pytest.mark.parametrize("side, values", [(256, 1 << 21), (6, 24), (7, 14)])
def test_distances_by_blocks(spark, monkeypatch, vectors, side, values):
    monkeypatch.setattr(robust, "CHUNK_VALUES", values)
    want = ((vectors[:, None] - vectors[None]) ** 2).sum(axis=2)
    found = {(r["i"], r["j"]): r["d"] for r in robust.distances(frame(spark, vectors), side).collect()}
    assert len(found) == 41 * 40
    for (i, j), d in found.items():
        assert d == pytest.approx(want[i, j], rel=1e-6, abs=0) if want[i, j] else d == 0


@pytest.mark.parametrize("f", [0, 1, 3, 38])
def test_krum_scores_by_blocks(spark, vectors, f):
    want = np.sort(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2) + np.diag([np.inf] * 41), axis=1)[:, : 41 - f - 2].sum(axis=1)
    found = {r["cid"]: r["score"] for r in robust.krum_scores(frame(spark, vectors), f, side=6).collect()}
    assert len(found) == 41 and [found[i] for i in range(41)] == pytest.approx(want.tolist(), rel=1e-6)


def test_what_one_client_lacks_doesnt_count(spark):
    x = [[1, 2, None], [4, None, 5], [None, 7, float("nan")], [None, None, 1], [3, None, None]]
    found = {(r["i"], r["j"]): r["d"] for r in robust.distances(frame(spark, x), 2).collect()}
    for i, a in enumerate(x):
        for j, b in enumerate(x):
            if i != j:
                assert near(found[i, j], float(sum((p - q) ** 2 for p, q in zip(a, b) if p is not None and q is not None)))
    scores = {r["cid"]: r["score"] for r in robust.krum_scores(frame(spark, x), 1).collect()}
    assert len(scores) == 5 and not any(map(math.isnan, scores.values()))  # NaN is among the largest, which go


def test_distances_make_no_rows_by_coordinate(spark, vectors):
    """The only joins and shuffles are of vectors by client and by pair of blocks."""
    plan = robust.distances(frame(spark, vectors))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("few", [4096, 3, 0])
def test_order_statistics_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    r = np.random.default_rng(4)
    inf, nan = float("inf"), float("nan")
    x = np.column_stack([
        r.normal(size=60), r.integers(0, 3, 60), np.zeros(60), -np.abs(r.normal(size=60)) * 1e-310, r.choice([-0.0, 0.0, 1e300, -1e300], 60),
        np.where(np.arange(60) < 3, nan, r.normal(size=60)), np.where(np.arange(60) < 20, nan, 1.0), np.where(np.arange(60) % 7 == 0, -inf, r.normal(size=60)), 1 + np.arange(60) * 2.0**-52, r.normal(size=60) * 10.0 ** r.integers(-300, 300, 60),
    ])
    upd = frame(spark, x)
    for trim in (0.1, 0.3, 0.45, 0.49):
        cut = max(1, int(60 * trim))
        found = {q["k"]: q["w"] for q in selection.trimmed_mean(upd, trim).collect()}
        for k in range(x.shape[1]):
            some = np.sort(x[:, k])[cut:-cut]
            want = float(some[0]) if some[0] == some[-1] else float(np.mean(some))
            assert near(found[k], want), (k, trim)
    found = {q["k"]: q["w"] for q in selection.coordinate_median(upd).collect()}
    for k in range(x.shape[1]):
        assert near(found[k], float(np.median(x[:, k]))), k


def test_order_statistics_of_few_values(spark):
    x = [[1, None, 2, float("nan")], [3, None, None, 1], [2, None, 7, 0]]
    upd = frame(spark, x)
    assert {q["k"]: q["w"] for q in federate.trimmed_mean(upd).collect()} == {0: 2, 1: None, 2: None, 3: 1}
    found = {q["k"]: q["w"] for q in federate.coordinate_median(upd).collect()}
    assert found.pop(3) != found.get(3) and found == {0: 2, 1: None, 2: 4.5}
    assert federate.coordinate_median(upd.limit(0)).count() == federate.trimmed_mean(upd.limit(0)).count() == 0
    ranks = upd.select("k").distinct().where("k = 0").select("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("r"))
    assert {q["r"]: q["w"] for q in selection.at_ranks(upd, ranks).collect()} == {0: 1, 1: 2, 2: 3}


def test_no_rows_are_numbered_by_coordinate(spark, vectors):
    for f in (selection.trimmed_mean, selection.coordinate_median):
        plan = f(frame(spark, vectors))._jdf.queryExecution().executedPlan().toString()
        assert "row_number" not in plan and "percentile" not in plan


def test_short_vectors_are_copied_to_few_blocks():
    """However many clients there are, until they are more than a block's values hold."""
    assert robust._layout(100_000, 64, 256, 12) == (10, 8192) and robust._layout(1_000_000, 64, 256, 12)[0] == 31
    assert robust._layout(500, 64, 256, 12)[0] == 2 and robust._layout(1000, 10_000, 256, 12) == (4, 8192)


@pytest.mark.parametrize("tile", [1, 5, 512])
def test_tiles_equal_the_whole_square(spark, monkeypatch, vectors, tile):
    monkeypatch.setattr(robust, "TILE", tile)
    want = ((vectors[:, None] - vectors[None]) ** 2).sum(axis=2)
    found = {(r["i"], r["j"]): r["d"] for r in robust.distances(frame(spark, vectors), 30).collect()}
    assert len(found) == 41 * 40 and all(d == pytest.approx(want[p], rel=1e-6, abs=0) for p, d in found.items())
    for f in (1, 30):
        most = np.sort(want + np.diag([np.inf] * 41), axis=1)[:, : 41 - f - 2].sum(axis=1)
        scores = {r["cid"]: r["score"] for r in robust.krum_scores(frame(spark, vectors), f, 30).collect()}
        assert [scores[i] for i in range(41)] == pytest.approx(most.tolist(), rel=1e-6)


@pytest.mark.parametrize("same", [False, True])
def test_rows_of_both_directions_lie_together(same):
    """A distance has two rows; as columns are compressed in blocks of 64 KB, the second costs little only if it's near."""
    import io

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql import types as T

    d = np.random.default_rng(5).normal(size=(512, 512)) ** 2
    d = d + d.T
    ids = [list(range(512)), list(range(512) if same else range(512, 1024))]
    table = pa.Table.from_batches(robust._Rows(T.LongType()).tile(0, ids[0], 0, ids[1], d, same))
    found = {(i, j): x for i, j, x in zip(*[table.column(c).to_pylist() for c in "ijd"], strict=True)}
    pairs = [(i, j) for i in range(512) for j in range(512) if not (same and i == j)]
    want = {(ids[0][i], ids[1][j]): d[i, j] for i, j in pairs}
    assert len(found) == table.num_rows and found == want | {(j, i): x for (i, j), x in want.items()}
    pq.write_table(table, out := io.BytesIO(), compression="snappy", use_dictionary=["i", "j"])
    assert out.tell() / table.num_rows < 7
