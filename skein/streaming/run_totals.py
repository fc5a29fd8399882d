"""Running totals of every run's rounds as a keyed stateful stream.

State is kept by run: the record of each round that was taken, and the totals up to the latest. A round
that follows the latest one costs one look at the totals, however long the run.

Defined results: the first record of a round counts, later ones (a resumed run's, say) are ignored; of
several in one micro-batch the least. A late round is put in its place: its row and those of all later
rounds are sent again. ``totals`` reads, of each round, the row that was sent last. Rounds and runs are
never null (such rows are ignored); null figures count as 0, a null accuracy is never the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

INPUT = "run string, round int, global_acc double, mean_eps double, comms_mb double"
OUTPUT = "run string, round int, cumulative_eps double, total_mb double, best_acc double, best_round int"
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


class RunTotals(StatefulProcessor):
    """See the module. A totals row is (latest round, eps, mb, best accuracy, best round)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rounds = handle.getMapState("rounds", "round int", "acc double, eps double, mb double")
        self.totals = handle.getValueState("totals", "last int, eps double, mb double, acc double, best int")

    @staticmethod
    def _after(totals: tuple | None, number: int, record: tuple) -> tuple:
        _, eps, mb, acc, best = totals or (None, 0.0, 0.0, None, None)
        if record[0] is not None and (acc is None or record[0] > acc):
            acc, best = record[0], number
        return number, eps + (record[1] or 0.0), mb + (record[2] or 0.0), acc, best

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any = None) -> Iterator[Row]:  # noqa: N802
        low = lambda x: (x is not None, x or 0.0)
        arrived: dict[int, tuple] = {}
        for r in rows:
            record = (r.global_acc, r.mean_eps, r.comms_mb)
            if r.round not in arrived or tuple(map(low, record)) < tuple(map(low, arrived[r.round])):
                arrived[r.round] = record
        fresh = {n: x for n, x in sorted(arrived.items()) if not self.rounds.containsKey((n,))}
        if not fresh:
            return
        for n, record in fresh.items():
            self.rounds.updateValue((n,), record)
        totals = tuple(self.totals.get()) if self.totals.exists() else None
        first = next(iter(fresh))
        todo = list(fresh.items())
        if totals is not None and first < totals[0]:  # late: from the start to its place, then on from there
            known = sorted((k[0], tuple(v)) for k, v in self.rounds.iterator())
            totals = None
            for n, record in known:
                if n < first:
                    totals = self._after(totals, n, record)
            todo = [x for x in known if x[0] >= first]
        for n, record in todo:
            totals = self._after(totals, n, record)
            yield Row(run=key[0], round=n, cumulative_eps=totals[1], total_mb=totals[2], best_acc=totals[3], best_round=totals[4])
        self.totals.update(totals)

    def close(self) -> None:
        pass


def feed(spark: SparkSession, source: str, out: str, checkpoint: str) -> None:
    """Takes the files (INPUT) that have come to ``source`` since the last call, from the checkpoint on. What a
    micro-batch sends is a folder of its own, so a batch that is repeated after a failure replaces itself."""
    before = {k: spark.conf.get(k, None) for k in _STORE}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    try:
        for k, v in _STORE.items():
            spark.conf.set(k, v)
        rows = spark.readStream.schema(INPUT).parquet(source).where("run is not null and round is not null")
        sent = rows.groupBy("run").transformWithState(RunTotals(), OUTPUT, "Update", "None")
        query = sent.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def totals(spark: SparkSession, out: str) -> DataFrame:
    """The latest row (OUTPUT) of every round of every run."""
    rows = spark.read.schema(f"{OUTPUT}, batch long").parquet(out)
    names = [c.split()[0] for c in OUTPUT.split(", ")][2:]
    return rows.groupBy("run", "round").agg(F.max_by(F.struct(*names), "batch").alias("row")).select("run", "round", "row.*")


def batch_totals(log: DataFrame) -> DataFrame:
    """The same of a whole log without repeated rounds, by windows over each run's rounds."""
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max_by(F.struct("global_acc", "round"), F.when(F.col("global_acc").isNotNull(), F.struct("global_acc", -F.col("round")))).over(w)
    sums = [F.sum(F.coalesce(c, F.lit(0.0))).over(w).alias(name) for c, name in (("mean_eps", "cumulative_eps"), ("comms_mb", "total_mb"))]
    return log.select("run", "round", *sums, best["global_acc"].alias("best_acc"), best["round"].alias("best_round"))
