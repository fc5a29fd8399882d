"""Exact dedup with keyed streaming state on disk (DataFrame and Structured Streaming only).

A file stream feeds (digest, length, id, locator) of every document into a streaming aggregation
whose state is a RocksDB store without expiry: per digest the number of members and the identifier
and content locator of the member that stays. The final state is read with the state data source.
Every digest that was hit more than once has its whole normalised texts compared; where they differ
(a digest collision), that digest's documents are grouped by the texts themselves.

Defined results: a null text counts as empty; texts of white space alone equal the empty text; of
equal texts the one with most code points in the original stays, then the smallest doc_id (null ids
last), then the smallest locator, so exactly one row of each group stays even when rows repeat; an
empty table gives no rows; other columns pass through ``dedup`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import located, scope, scratch, written

#: State on disk. No store reserves megabytes ahead or uploads whole snapshots, all of an executor share
#: STORE_MB of memory, and a store is closed once its batch is done. There is a store for about so many rows,
#: and one a core at least: an open store costs native memory however little it holds.
STORE_MB, STORE_ROWS = 96, 1_000_000
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STORE_MB),
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: A digest with more than 1/HOT of all rows is joined apart; there can be at most HOT of them.
HOT = 1000
#: So many digests that were hit, counted, may be broadcast (about 100 bytes each), so that texts that no
#: other row equals never move; beyond it they meet by digest.
HITS = 200_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _state(feed: DataFrame, total: int) -> DataFrame:
    """digest, group_size and keep (neg_len, no_id, id, loc) after the stream has read the whole feed."""
    spark = feed.sparkSession
    settings = STORE | {"spark.sql.shuffle.partitions": str(max(spark.sparkContext.defaultParallelism, -(-total // STORE_ROWS)))}
    path = sorted({f.rsplit("/", 1)[0] for f in feed.inputFiles()})
    checkpoint = scratch(spark, "dedupstate")
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(feed.schema).parquet(path[0])
        state = stream.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("neg_len", "no_id", "id", "loc")).alias("keep"))
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    store = spark.read.format("statestore").load(checkpoint)
    count, keep = (F.col(f"value.`{x.name}`") for x in store.schema["value"].dataType.fields)
    return store.select(F.col("key.digest").alias("digest"), count.alias("group_size"), keep.alias("keep"))


def _resolved(rows: DataFrame, doc_id: Column, text: Column, digest: Callable[[Column], Column]) -> DataFrame:
    """Every row of rows (with ``_row``) as loc, id, keep_id, group_size, kept and digest."""
    keyed = rows.select(digest(normalised(text)).alias("digest"), (-F.length(F.coalesce(text, F.lit("")))).alias("neg_len"), doc_id.isNull().alias("no_id"), doc_id.alias("id"), F.col("_row").alias("loc"), normalised(text).alias("norm"))
    feed = written(keyed.drop("norm"), "dedupfeed")
    total = feed.count()
    if not total:
        return feed.select("loc", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    state = written(_state(feed, total), "dedupgroups")

    # Full bytes on hits: least and greatest text are combined where they lie, before the shuffle.
    hits = state.where("group_size > 1")
    texts = keyed.select("digest", "norm")
    span = [F.min("norm").alias("a"), F.max("norm").alias("b")]
    if hits.count() <= HITS:
        compared = texts.join(F.broadcast(hits.select("digest")), "digest", "left_semi").groupBy("digest").agg(*span)
    else:  # members of hot digests (at most HOT, so broadcast) are compared where they lie, all others meet by digest
        is_hot = F.col("group_size") * HOT > total
        hot, cold = F.broadcast(hits.where(is_hot).select("digest")), hits.where(~is_hot).select("digest")
        compared = texts.join(hot, "digest", "left_semi").groupBy("digest").agg(*span).unionByName(texts.join(hot, "digest", "left_anti").join(cold, "digest", "left_semi").groupBy("digest").agg(*span))
    collided = written(compared.where("a <> b").select("digest"), "collided")
    keys = ["digest"]
    if not collided.isEmpty():
        clash = keyed.join(collided, "digest", "left_semi")
        apart = clash.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), F.min(F.struct("neg_len", "no_id", "id", "loc")).alias("keep"))
        state = state.join(collided, "digest", "left_anti").select("digest", F.lit("").alias("norm"), "group_size", "keep").unionByName(apart)
        feed = feed.join(collided, "digest", "left_anti").withColumn("norm", F.lit("")).unionByName(clash.select(*feed.columns, "norm"))
        keys = ["digest", "norm"]
    is_hot = F.col("group_size") * HOT > total
    joined = feed.join(F.broadcast(state.where(is_hot)), keys).unionByName(feed.join(F.broadcast(state.where(is_hot).select(*keys)), keys, "left_anti").join(state.where(~is_hot), keys))
    return joined.select("loc", "id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("keep.loc") == F.col("loc")).alias("kept"), "digest")


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    own = located(docs)
    found = _resolved(own.rows, own["doc_id"], own["text"], digest)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    own = located(docs)
    with scope(docs.sparkSession) as keep:
        gone = keep(written(_resolved(own.rows, own["doc_id"], own["text"], digest).where("not kept").select(F.col("loc").alias("_row")), "gone"))
    # The rows that go are as a rule the fewer; written, so that their size is known before docs would be shuffled.
    return own.back(own.rows.join(gone, "_row", "left_anti"))
