"""Scaling, encoding, activations and metrics over long tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def standard_scale(x: DataFrame) -> DataFrame:
    """(id, k, x) centred and divided by the population deviation of k (1 where that is 0)."""
    stats = x.groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return x.join(F.broadcast(stats), "k").select("id", "k", ((F.col("x") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("x"))


def standard_scale_vectors(x: DataFrame) -> DataFrame:
    """The same for (id, x array<double>): one aggregate of whole vectors, no explode."""
    stats = x.agg(Summarizer.metrics("mean", "count", "variance").summary(array_to_vector("x")).alias("s"))
    # Its variance is the sample's; the population's has n instead of n - 1.
    stats = stats.select(vector_to_array("s.mean").alias("_m"), F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (F.col("s.count") - 1) / F.col("s.count"))).alias("_s"))
    centred = F.zip_with("x", "_m", lambda a, m: a - m)
    return x.join(F.broadcast(stats)).select("id", F.zip_with(centred, "_s", lambda a, s: a / F.when(s == 0, 1.0).otherwise(s)).alias("x"))


def label_codes(labels: DataFrame, name: str) -> DataFrame:
    """Each distinct label with its rank from 0."""
    return labels.select(name).distinct().select(name, (F.dense_rank().over(Window.orderBy(name)) - 1).cast("int").alias("code"))


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(0.0), x))


def leaky_relu(v: Column, slope: float = 0.2) -> Column:
    return F.transform(v, lambda x: F.when(x >= 0, x).otherwise(x * slope))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once a row, however often ``then`` names it: inside lambdas Spark repeats
    whatever doesn't depend on their variables for every item."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def softmax(v: Column) -> Column:
    """Shifted by the largest value; the sum has 1e-10 added."""
    exps = lambda v: _bound(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    shares = lambda e: _bound(F.aggregate(e, F.lit(0.0), lambda a, b: a + b) + 1e-10, lambda total: F.transform(e, lambda x: x / total))
    return _bound(v, lambda v: _bound(exps(v), shares))


def argmax(v: Column) -> Column:
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def cross_entropy(probs: str, truth: str) -> Column:
    """Mean of -ln(p of the true class + 1e-10) over rows; 0 without rows."""
    return F.coalesce(F.avg(-F.log(F.element_at(F.col(probs), F.col(truth) + 1) + 1e-10)), F.lit(0.0))


def macro_f1(rows: DataFrame) -> DataFrame:
    """Mean F1 over the classes that occur as truth, of rows (y, pred): f1."""
    truth = rows.groupBy(F.col("y").alias("c")).agg(F.count("*").alias("pos"), F.count_if(F.col("pred") == F.col("y")).alias("tp"))
    said = rows.groupBy(F.col("pred").alias("c")).agg(F.count("*").alias("said"))
    both = truth.join(said, "c", "left").fillna(0, ["said"])
    p, r = F.col("tp") / (F.col("said") + 1e-10), F.col("tp") / (F.col("pos") + 1e-10)
    return both.select((2 * p * r / (p + r + 1e-10)).alias("f")).agg(F.coalesce(F.avg("f"), F.lit(0.0)).alias("f1"))
