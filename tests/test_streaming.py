import random

import pytest
from pyspark.sql import functions as F

from skein.streaming import run_totals


def records(seed, runs=6, rounds=25):
    r = random.Random(seed)
    return [(f"run{i}", n, r.choice([None, round(r.random(), 1)]), r.choice([None, r.random()]), r.random()) for i in range(runs) for n in range(1, rounds + 1) if r.random() < 0.9]


def same(found, want):
    key = lambda x: (x["run"], x["round"])
    found, want = sorted(found, key=key), sorted(want, key=key)
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert (a["run"], a["round"], a["best_acc"], a["best_round"]) == (b["run"], b["round"], b["best_acc"], b["best_round"])
        assert (a["cumulative_eps"], a["total_mb"]) == pytest.approx((b["cumulative_eps"], b["total_mb"]))


def test_three_batches_with_restarts_equal_the_whole_log(spark, tmp_path):
    """Late rounds are put in their place, repeated ones ignored, rows without run or round left out."""
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    rows = records(1)
    r = random.Random(2)
    parts = [[], [], []]
    for row in rows:
        parts[r.choice([0, 0, 1, 2])].append(row)
    parts[1] += [(run, n, 99.0, 99.0, 99.0) for run, n, *_ in parts[0][::3]] + [(None, 1, 1.0, 1.0, 1.0), ("run0", None, 1.0, 1.0, 1.0)]
    parts[2] += parts[1][:10] + [x for x in parts[2][:5] for _ in range(2)]
    taken = {}
    for part in parts:
        spark.createDataFrame(part, run_totals.INPUT).repartition(2).write.mode("append").parquet(source)
        run_totals.feed(spark, source, out, state)  # a new query each time, from the checkpoint on
        for x in part:
            if x[0] and x[1]:
                taken.setdefault(x[:2], x)
        want = run_totals.batch_totals(spark.createDataFrame(list(taken.values()), run_totals.INPUT)).collect()
        same(run_totals.totals(spark, out).collect(), want)
    assert len(taken) == len(rows)
    before = spark.read.parquet(out).count()
    run_totals.feed(spark, source, out, state)  # nothing new
    assert spark.read.parquet(out).count() == before


def test_batch_totals_by_hand(spark):
    log = spark.createDataFrame([("a", 1, None, 1.0, None), ("a", 2, 0.5, None, 2.0), ("a", 3, 0.5, 2.0, 1.0), ("a", 5, 0.7, 0.0, 0.0), ("b", 1, 0.1, 0.0, 0.0)], run_totals.INPUT)
    found = {(r["run"], r["round"]): tuple(r)[2:] for r in run_totals.batch_totals(log).collect()}
    assert found == {("a", 1): (1.0, 0.0, None, None), ("a", 2): (1.0, 2.0, 0.5, 2), ("a", 3): (3.0, 3.0, 0.5, 2), ("a", 5): (3.0, 3.0, 0.7, 5), ("b", 1): (0.0, 0.0, 0.1, 1)}


def test_what_follows_the_latest_round_sends_one_row(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    for n in (1, 2, 4, 3):
        spark.createDataFrame([("a", n, 0.1 * n, 1.0, 1.0)], run_totals.INPUT).write.mode("append").parquet(source)
        run_totals.feed(spark, source, out, state)
    sent = spark.read.parquet(out).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()
    assert [r["n"] for r in sent] == [1, 1, 1, 2]  # the late round 3 sends 4 again
