"""What a run leaves behind: its log after every round, history, checkpoints, ablation table."""

from __future__ import annotations

import json
import logging
import logging.handlers
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RunStore:
    """Tables of one run below ``path``. Every round is a folder of its own in the log, so that a stream or a poll can
    read along and a round that is written twice replaces itself; the CSV is rewritten, as plain readers expect
    one file.

    A round counts once it is committed: its log and state are written first, a marker under its number last, by
    a rename. What a run that broke off has written beyond its last marker is replaced when it goes on."""

    EVERY = 10  # rounds between checkpoints
    STATES = 2  # committed states that are kept

    def __init__(self, spark: SparkSession, path: str, run: str = "run"):
        self.spark, self.path, self.run = spark, path.rstrip("/"), run

    def _at(self, folder: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, folder: str) -> list[int]:
        """Rounds that have an entry in a folder, in order."""
        at, files = self._at(folder)
        if not files.exists(at):
            return []
        names = [x.getPath().getName() for x in files.listStatus(at)]
        return sorted(int(n.removeprefix("round=")) for n in names if n.startswith("round=") and n.removeprefix("round=").isdigit())

    def log(self, rows: DataFrame) -> None:
        """The log so far; its last round replaces itself in the table."""
        last = rows.agg(F.max("round")).first()[0]
        rows.where(F.col("round") == last).drop("round").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/run={self.run}/round={last}")
        rows.orderBy("round").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{self.path}/log_csv")

    def commit(self, turn: int, weights: list[float], rows: DataFrame, **state: float) -> None:
        """Round ``turn`` is done: its log, the weights after it and sums that go on (``state``)."""
        self.log(rows)
        home = f"{self.path}/state/run={self.run}"
        one = self.spark.createDataFrame([([float(w) for w in weights], json.dumps(state))], "weights array<double>, state string")
        one.coalesce(1).write.mode("overwrite").parquet(f"{home}/round={turn}")
        (draft, files), (marker, _) = (self._at(f"{self.path}/committed/run={self.run}/{name}={turn}") for name in ("draft", "round"))
        files.create(draft, True).close()
        files.delete(marker, True)
        files.rename(draft, marker)
        for old in self._numbers(home)[: -self.STATES]:
            at, _ = self._at(f"{home}/round={old}")
            files.delete(at, True)

    def committed(self) -> tuple[int, list[float], dict] | None:
        """The last committed round, its weights and sums; rounds beyond it leave the log. None without one."""
        done = self._numbers(f"{self.path}/committed/run={self.run}")
        for n in self._numbers(f"{self.path}/log/run={self.run}"):
            if n > max(done, default=0):
                at, files = self._at(f"{self.path}/log/run={self.run}/round={n}")
                files.delete(at, True)
        if not done:
            return None
        row = self.spark.read.parquet(f"{self.path}/state/run={self.run}/round={done[-1]}").first()
        return done[-1], list(row["weights"]), json.loads(row["state"])

    def forget(self) -> None:
        """Nothing of the run is committed any more."""
        for folder in ("committed", "state", "log"):
            at, files = self._at(f"{self.path}/{folder}/run={self.run}")
            files.delete(at, True)

    def checkpoint(self, turn: int, weights: list[float]) -> None:
        if turn % self.EVERY == 0:
            self.spark.createDataFrame([(turn, [float(w) for w in weights])], "round int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/checkpoints/round={turn}/run={self.run}")

    def history(self, rows: DataFrame) -> None:
        text = json.dumps([r.asDict() for r in rows.orderBy("round").collect()], indent=2)  # one item a round
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/history/run={self.run}")

    def ablation(self, table: DataFrame) -> None:
        table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{self.path}/ablation_csv")

    def read_log(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/log").where(F.col("run") == self.run).drop("run")
        return rows.select(F.col("round").cast("int").alias("round"), *[c for c in rows.columns if c != "round"])


def setup_logging(name: str, level: int = logging.INFO, file: str | None = None, folder: str = "logs") -> logging.Logger:
    """A logger on the console and, if a file is named, in files of 10 MB of which five older ones are kept.
    Asked for again it stays as it is; nothing is made on import."""
    logger = logging.getLogger(name)
    if logger.handlers:
        return logger
    logger.setLevel(level)
    shape = logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s")
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        os.makedirs(folder, exist_ok=True)
        handlers.append(logging.handlers.RotatingFileHandler(os.path.join(folder, file), maxBytes=10 << 20, backupCount=5))
    for handler in handlers:
        handler.setFormatter(shape)
        logger.addHandler(handler)
    return logger
