"""Shared pieces: the shared scratch folder, written intermediate tables and skew-safe joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six characters that separate words, as a regex class body (Java, DuckDB and Python agree on it).
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"
#: Tables of at most this many rows, counted before use, may be broadcast.
BROADCAST_ROWS = 20_000
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000
#: Input for one file of an intermediate table, at least about so much.
FILE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets a
    temporary one; on a cluster every executor would write to a disk of its own, so that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='skein-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark)}/skein/{label}-{uuid.uuid4().hex}"
    if open_scopes := _OPEN.get():
        open_scopes[-1].append(path)
    return path


#: Paths made in every scope that is open, the innermost last. A thread has scopes of its own, so queries may run side
#: by side in one session.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open scopes", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is written inside goes at the end, but tables given to the function that it yields.

    A written table reads its own files alone, so those that it was made from can go."""
    made: list[str] = []
    kept: list[str] = []
    outer = _OPEN.set((*_OPEN.get(), made))

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._written)
        return df

    try:
        yield keep
    finally:
        _OPEN.reset(outer)
        for path in made:
            if path not in kept:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if open_scopes := _OPEN.get():
            open_scopes[-1].extend(kept)


def _read_bytes(df: DataFrame) -> int:
    """Bytes of all tables that df reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and outlives executors.

    Each task writes a file. There are no more of them than FILE_BYTES of input each or two a core ask for:
    a table of many tiny files costs more to open than to read.
    """
    spark = df.sparkSession
    path, tasks = scratch(spark, label), 2 * spark.sparkContext.defaultParallelism
    df.coalesce(max(tasks, min(_read_bytes(df) // FILE_BYTES, 1 << 24))).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def long_rows(spark: SparkSession) -> None:
    """Rows that go to Python are whole texts here, so the session's Arrow batches get fewer of them (its default
    is meant for narrow rows): a batch and what is made of it are held twice, in the JVM and in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Renamed:
    """A frame whose columns are renamed by position, so that none of their names can clash.

    ``rows`` has them as _c0, _c1, ...; ``self[name]`` is the column that had the name (a null where the
    frame has none), ``back`` restores the frame's own columns.
    """

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.rows = docs.toDF(*[f"_c{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> Column:
        return F.col(f"_c{self.names.index(name)}") if name in self.names else F.lit(None)

    def back(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(self.names)])


def _plain_scan(docs: DataFrame) -> bool:
    """Whether docs is files with at most filters and projections, so that file and place name a row."""
    try:
        plan = docs._jdf.queryExecution().analyzed()
    except Exception:  # noqa: BLE001 - a session that doesn't show its plans
        return False
    while True:
        name = plan.nodeName()
        if name.startswith(("LogicalRelation", "Relation")):
            return bool(docs.inputFiles())
        if name not in ("Project", "Filter", "SubqueryAlias") or plan.children().size() != 1:
            return False
        plan = plan.children().head()


def located(docs: DataFrame) -> Renamed:
    """docs, renamed, with ``_row``: a number that tells rows apart, the same however often it is read. It
    is that of the file and the place in it; a frame that isn't a file scan is written first."""
    own = Renamed(docs)
    if any(n.lower() == "_metadata" for n in own.names) or not _plain_scan(docs):
        own.rows = written(own.rows, "rows")
        if not own.rows.inputFiles():
            own.rows = own.rows.withColumn("_row", F.lit(0).cast("long"))
            return own
    # The whole path: files of one name may lie in several folders.
    placed = own.rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # One row a file, numbered in the order of their paths; no Python worker has to start for it.
    files = written(placed.select("_file").distinct().select("_file", F.row_number().over(Window.orderBy("_file")).cast("long").alias("_number")), "files")
    own.rows = placed.join(F.broadcast(files), "_file").withColumn("_row", F.shiftleft("_number", 40) + F.col("_row")).drop("_file", "_number")
    return own


def grouped_rows(docs: DataFrame, rows: int) -> DataFrame:
    """doc_id (long), text (binary, null as empty) and group of every row: ``rows`` rows of a file that follow each
    other, the same however often it is read; a frame that isn't a file scan is written first. Two groups may by
    chance have one number."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    if any(n.lower() == "_metadata" for n in docs.columns) or not _plain_scan(docs):
        own = written(own, "rows")
        if not own.inputFiles():
            return own.withColumn("group", F.lit(0).cast("long"))
        docs = own
    group = F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / rows))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), group.alias("group"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``_rank`` from 0 in the given order, without one task that sorts every row.

    Rows are dealt out by range; each range counts its rows, the counts (one a partition) give every
    range its first rank, and a window ranks inside ranges.
    """
    spark = df.sparkSession
    dealt = written(df.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    firsts, total = {}, 0
    for part, n in sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()):
        firsts[part], total = total, total + n
    first = F.create_map(*[F.lit(x) for kv in firsts.items() for x in kv])[F.col("_range")] if firsts else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_rank", (place - 1 + first).cast("long")).drop("_range")


def joined(big: DataFrame, small: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``big`` (``total`` rows) joined to ``small`` (one row a key) where a key may hold many rows of ``big``: keys
    with more than a thousandth of all rows, at most a thousand, are joined by broadcast."""
    hot = big.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * 1000 > total).select(key)
    hot = written(hot, "hot")
    few = F.broadcast(hot)
    found = big.join(few, key, "left_semi").join(F.broadcast(small.join(few, key, "left_semi")), key, how)
    return found.unionByName(big.join(few, key, "left_anti").join(small, key, how))


def lookup(big: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "inner", salts: int = 32, rows: int | None = None) -> DataFrame:
    """``big`` joined to ``small`` (one row a key) where any key may hold most rows of ``big``.

    Broadcast when ``small`` has at most BROADCAST_ROWS rows (counted); beyond that each key of
    ``small`` is repeated for the salts that ``big`` uses, at most ``salts`` times.
    """
    rows = small.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    need = dealt.select(key, "_salt").distinct()
    return dealt.join(need.join(small, key), [key, "_salt"], how).drop("_salt")
