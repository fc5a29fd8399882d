"""Analytics over round logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.hashing import uniform


def weighted_metrics(log: DataFrame, metrics: list[str]) -> DataFrame:
    return log.groupBy("round").agg(*[(F.sum(F.col(m) * F.col("n")) / F.sum("n")).alias(m) for m in metrics])


def fairness(log: DataFrame) -> DataFrame:
    acc = F.col("val_acc")
    return log.groupBy("round").agg(F.avg(acc).alias("mean_acc"), F.min(acc).alias("min_acc"), F.max(acc).alias("max_acc"), F.stddev_pop(acc).alias("std_acc"), (F.max(acc) - F.min(acc)).alias("gap"))


def communication(log: DataFrame, parameters: int, sketch_bytes: int) -> DataFrame:
    """round, comms_mb: four bytes a parameter and the sketch, from every client."""
    return log.groupBy("round").agg((F.count("*") * (4 * parameters + sketch_bytes) / 1024 / 1024).alias("comms_mb"))


def cumulative(log: DataFrame, name: str, out: str) -> DataFrame:
    return log.select("round", F.sum(name).over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)).alias(out))


def round_records(updates: DataFrame, seconds: DataFrame) -> DataFrame:
    """The eleven columns of a round log, from one row a client and round (round, cid, n, val_acc, test_acc, val_f1,
    eps, bytes) and the seconds of every round. worst_client_f1 and best_client_f1 hold validation accuracies, as
    readers of the log expect."""
    weighted = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    per = updates.groupBy("round").agg(
        weighted("val_acc").alias("global_acc"), weighted("test_acc").alias("global_test_acc"), weighted("val_f1").alias("global_f1"),
        F.min("val_acc").alias("worst_client_f1"), F.max("val_acc").alias("best_client_f1"), (F.max("val_acc") - F.min("val_acc")).alias("fairness_gap"),
        F.avg("eps").alias("mean_eps"), (F.sum("bytes") / 1024 / 1024).alias("comms_mb"),
    )
    per = per.withColumn("cumulative_eps", F.sum("mean_eps").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)))  # one row a round
    rounded = [F.round(c, 4).alias(c) for c in ("global_acc", "global_test_acc", "global_f1", "worst_client_f1", "best_client_f1", "fairness_gap", "mean_eps", "cumulative_eps", "comms_mb")]
    return per.join(seconds, "round").select("round", *rounded, F.round("seconds", 2).alias("round_time_s"))


def best_round(log: DataFrame) -> DataFrame:
    """The round of greatest global_acc, the earliest of equals."""
    return log.agg(F.max_by("round", F.struct("global_acc", -F.col("round"))).alias("best_round"), F.max("global_acc").alias("best_acc"))


def run_summary(log: DataFrame) -> DataFrame:
    """best_round, best_acc and its test accuracy, worst_client, total_mb and final_eps of a round log."""
    first_best = F.struct("global_acc", -F.col("round"))
    return log.agg(
        F.max_by("round", first_best).alias("best_round"), F.max("global_acc").alias("best_acc"), F.max_by("global_test_acc", first_best).alias("test_acc"),
        F.min("worst_client_f1").alias("worst_client"), F.sum("comms_mb").alias("total_mb"), F.max_by("cumulative_eps", "round").alias("final_eps"),
    )


def ablation_summary(log: DataFrame) -> DataFrame:
    """One row for each config of tagged round logs."""
    first_best = F.struct("global_acc", -F.col("round"))
    return log.groupBy("config").agg(
        F.max("global_acc").alias("best_val_acc"), F.max_by("global_test_acc", first_best).alias("best_test_acc"), F.min("worst_client_f1").alias("worst_client"),
        F.max("fairness_gap").alias("fairness_gap"), F.max_by("cumulative_eps", "round").alias("final_eps"), F.sum("comms_mb").alias("total_comms_mb"),
    )


def project(log: DataFrame, names: list[str]) -> DataFrame:
    """Those of the columns that the log has, in the order of ``names``."""
    return log.select(*[c for c in names if c in log.columns])


def numeric_columns(log: DataFrame) -> list[str]:
    """Columns of floating point but the round."""
    return [f.name for f in log.schema.fields if f.name != "round" and f.dataType.typeName() in ("double", "float")]


def first_metric(log: DataFrame) -> str | None:
    """The first column that isn't the round."""
    return next((c for c in log.columns if c != "round"), None)


def value_or(log: DataFrame, name: str, other: str) -> Column:
    """The column ``name``, or ``other`` in a log without it."""
    return F.col(name if name in log.columns else other)


#: The table of the latest rounds shows these columns where a log has them.
SHOWN = ["round", "global_acc", "global_f1", "worst_client_f1", "fairness_gap", "cumulative_eps", "comms_mb", "round_time_s"]


def demo(spark: SparkSession, rounds: int = 20, seed: str = "demo") -> DataFrame:
    """A made-up log: linear trends and a little noise."""
    noise = lambda name: F.sqrt(-2 * F.log(1 - uniform(F.lit(f"{seed}-{name}-a"), F.col("round")))) * F.cos(2 * 3.141592653589793 * uniform(F.lit(f"{seed}-{name}-b"), F.col("round"))) * 0.01
    r = F.col("round")
    return spark.range(1, rounds + 1).select(F.col("id").cast("int").alias("round")).select(
        "round", (0.3 + 0.03 * r + noise("acc")).alias("global_acc"), (0.25 + 0.025 * r + noise("f1")).alias("global_f1"), (0.2 + 0.02 * r + noise("worst")).alias("worst_client_f1"),
        (0.8 * r).alias("cumulative_eps"), (0.5 + 0.01 * r).alias("comms_mb"), (0.15 - 0.005 * r + noise("gap")).alias("fairness_gap"),
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A log or an ablation table of any columns; None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def tail(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("round")).limit(n)


def highlighted(log: DataFrame, name: str) -> DataFrame:
    both = log.agg(F.max(name).alias("hi"), F.min(name).alias("lo"))
    return log.join(F.broadcast(both)).select("round", name, (F.col(name) == F.col("hi")).alias("is_max"), (F.col(name) == F.col("lo")).alias("is_min"))
