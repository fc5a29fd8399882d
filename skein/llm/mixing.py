"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each document hashes to 60 bits. A histogram of words by source and leading hash bits finds, for
every source, the bucket in which its budget runs out; only that bucket is split further, by the next
bits, until it holds a single hash. Documents below it get one more copy than the others, and so does the
document beyond whose size comes nearest to what is left of the budget: the mix is a filter, nothing is sorted, and two runs agree.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its
own, last in order; equal rows hash alike and stand or fall together; an empty table gives no rows;
columns besides doc_id, text and source pass through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import WORD, Renamed, lookup, ranked, scope, written

BITS, LEVELS = 12, 5  # 5 x 12 = the 60 bits of the hash


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Never null: joins must match null sources too."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def targets(sized: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Per source: _key, source_size, target. The weights repeat over the sources in code-point order;
    targets stop at ``cap`` times the source's size and the excess is shared anew by weight."""
    sizes = sized.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    order = (F.col("_key") == "n", F.col("_key"))
    sources = ranked(sizes, *order)
    sources = written(sources.withColumn("_w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))), "sources")
    total, weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    rest, open_weight = total, weight
    while True:  # each turn caps at least one source more, or ends
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        full = wide("source_size") * F.lit(cap) * F.lit(open_weight) < wide("_w") * F.lit(rest)
        spent, gone = sources.where(full).agg(F.coalesce(F.sum("source_size"), F.lit(0)) * cap, F.coalesce(F.sum("_w"), F.lit(0))).first()
        if (total - spent, weight - gone) == (rest, open_weight):
            break
        rest, open_weight = total - spent, weight - gone
    share = F.col("_w") * (F.lit(float(rest)) / F.lit(float(max(open_weight, 1))))
    return sources.select("_key", "source_size", F.when(full, (F.col("source_size") * cap).cast("double")).otherwise(share).alias("target"))


def thresholds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with copies (what every document of the source gets), threshold (documents with a hash
    up to it get one more) and filler (so does this hash beyond it, the one whose size comes nearest
    to what is left of the budget, if it brings the source nearer to its target)."""
    n_sources = sources.count()
    live = F.col("source_size") > 0
    sources = sources.withColumn("copies", F.when(live, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    need = written(sources.select("_key", (F.col("target") - F.col("copies") * F.col("source_size")).alias("_need"), F.lit(0).cast("long").alias("_prefix")).where("_need > 0"), "needs")
    full, done = sized.where("_size > 0").select("_key", "_size", "_hash"), []
    for level in range(LEVELS):
        shift = 60 - BITS * (level + 1)
        part = lookup(full, need, "_key", F.col("_hash"), rows=n_sources)
        part = part.withColumn("_bucket", F.shiftright("_hash", shift)).where(F.shiftright("_bucket", BITS) == F.col("_prefix"))
        counted = part.groupBy("_key", "_bucket").agg(F.sum("_size").alias("_in"), F.min("_hash").alias("_low"), F.max("_hash").alias("_high"), F.first("_need").alias("_need"))
        upto = F.sum("_in").over(Window.partitionBy("_key").orderBy("_bucket"))
        edge = counted.withColumn("_upto", upto).where("_upto >= _need and _upto - _in < _need")
        edge = written(edge.withColumn("_left", F.col("_need") - (F.col("_upto") - F.col("_in"))), "edges")
        done.append(edge.where("_low = _high").select("_key", (F.col("_low") - 1).alias("threshold"), "_left"))
        need = edge.where("_low < _high").select("_key", F.col("_left").alias("_need"), F.col("_bucket").alias("_prefix"))
        if need.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = written(found, "edges")
    beyond = lookup(full, found, "_key", F.col("_hash"), rows=n_sources).where("_hash > threshold")
    nearest = beyond.groupBy("_key").agg(F.min(F.struct(F.abs(F.col("_size") - F.col("_left")).alias("gap"), F.col("_hash").alias("hash"))).alias("_near"), F.first("_left").alias("_left"))
    nearest = written(nearest.select("_key", "_left", F.col("_near.hash").alias("filler")), "fillers")
    whole = lookup(full, nearest, "_key", F.col("_hash"), rows=n_sources).where("_hash = filler").groupBy("_key", "filler", "_left").agg(F.sum("_size").alias("_in"))
    filler = whole.where("abs(_in - _left) < _left").select("_key", "filler")
    none = F.lit(-1).cast("long")
    return sources.join(found.drop("_left"), "_key", "left").join(filler, "_key", "left").withColumn("threshold", F.coalesce("threshold", none)).withColumn("filler", F.coalesce("filler", none))


def _decided(own: Renamed, weights: tuple[int, ...], cap: int) -> DataFrame:
    """own's rows with _size, _source_size, _target and _copies (how often the mix holds the row)."""
    rows = own.rows.select("*", source_key(own["source"]).alias("_key"), n_words(own["text"]).alias("_size"), hash60(own["doc_id"], own["text"]).alias("_hash"))
    with scope(own.rows.sparkSession) as keep:
        sized = written(rows.select("_key", "_size", "_hash"), "sized")
        plan = keep(written(thresholds(sized, targets(sized, weights, cap)), "mixplan"))
    plan = plan.withColumnsRenamed({"source_size": "_source_size", "target": "_target"})
    extra = ((F.col("_hash") <= F.col("threshold")) | (F.col("_hash") == F.col("filler"))).cast("long")
    copies = F.when(F.col("_size") > 0, F.col("copies") + extra).otherwise(F.lit(0).cast("long"))
    return lookup(rows, plan, "_key", F.col("_hash")).withColumn("_copies", copies)


def decided(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every row."""
    own = Renamed(docs)
    return _decided(own, weights, cap).select(own["doc_id"].alias("doc_id"), own["source"].alias("source"), *[F.col(f"_{c}").alias(c) for c in ("size", "source_size", "target", "copies")])


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    own = Renamed(docs)
    rows = _decided(own, weights, cap).where("_copies > 0")
    return own.back(rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))))
