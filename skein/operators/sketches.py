"""Bloom sketches of edges as packed bits.

A sketch of m bits is a row for each part of 32,768 bits: ``part`` and ``bits``, a binary of at most 4 KB whose
bit ``i % 8`` of byte ``i / 8`` stands for position i of the part. Clients build theirs where their edges lie
(bits are combined in the task), the merge is a bitwise OR of binaries, so it moves m / 8 bytes a client,
and a look-up tests bits.

Defined results: no edges make no rows, and no bits; an edge counts in either direction; an edge with a null end
has no key and is left out; repeated edges set the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.hashing import digest, sketch_positions

#: Bits of Spark's bitmaps.
PART = 1 << 15


def edge_key(u: Column, v: Column) -> Column:
    return F.concat_ws("-", F.least(u, v).cast("string"), F.greatest(u, v).cast("string"))


def client_salt(cid: Column) -> Column:
    """16 bytes of a client's own."""
    return F.unhex(F.substring(digest("salt", cid), 1, 32))


def packed(edges: DataFrame, salt: bytes | Column, m: int = 8192, k: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """by, part and bits: a sketch of the edges (u, v) for each group of ``by`` (all edges, without)."""
    rows = edges.where("u is not null and v is not null")
    rows = rows.select(*by, F.explode(sketch_positions(salt, edge_key(F.col("u"), F.col("v")), m, k)).alias("pos"))
    built = rows.groupBy(*by, F.expr(f"cast(pos div {PART} as int)").alias("part")).agg(F.bitmap_construct_agg((F.col("pos") % PART).cast("long")).alias("bits"))
    size = F.least(F.lit(PART), F.lit(m) - F.col("part") * PART)
    return built.select(*by, "part", F.substr("bits", F.lit(1), F.ceil(size / 8).cast("int")).alias("bits"))


def sketch(edges: DataFrame, salt: bytes, m: int = 8192, k: int = 4) -> DataFrame:
    """One sketch of all edges: part, bits."""
    return packed(edges, salt, m, k)


def bloom_encode(edges: DataFrame, m: int = 8192, k: int = 4) -> DataFrame:
    """cid, part, bits: every client's sketch of its edges (cid, u, v by gid), salted by client."""
    return packed(edges, client_salt(F.col("cid")), m, k, ("cid",))


def merged(bits: DataFrame) -> DataFrame:
    """part, bits: the bitwise OR of sketches."""
    width = F.max(F.length("bits"))
    return bits.groupBy("part").agg(F.bitmap_or_agg("bits").alias("all"), width.alias("width")).select("part", F.substr("all", F.lit(1), F.col("width")).alias("bits"))


def is_set(bits: Column, at: Column) -> Column:
    """Whether the bit at a place is set; places beyond the binary aren't."""
    byte = F.conv(F.hex(F.substr(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", byte, (at % 8).cast("int")) == 1, F.lit(False))


def positions(bits: DataFrame) -> DataFrame:
    """The set positions (pos) of each row of sketches, with what else the rows have."""
    others = [c for c in bits.columns if c not in ("part", "bits")]
    places = F.filter(F.sequence(F.lit(0), F.length("bits") * 8 - 1), lambda i: is_set(F.col("bits"), i))
    return bits.select(*others, "part", F.explode(places).alias("i")).select(*others, (F.col("part") * PART + F.col("i")).cast("int").alias("pos"))


def might_contain(edges: DataFrame, bits: DataFrame, salt: bytes, m: int = 8192, k: int = 4) -> DataFrame:
    """u, v, found. The sketch is one row of m / 8 bytes, which ``m`` bounds, so it is broadcast; edges stay where they are."""
    whole = bits.agg(F.map_from_entries(F.collect_list(F.struct("part", "bits"))).alias("_parts"))  # m / PART entries
    asked = edges.select("u", "v", sketch_positions(salt, edge_key(F.col("u"), F.col("v")), m, k).alias("_pos")).join(F.broadcast(whole))
    hit = lambda p: is_set(F.col("_parts")[F.floor(p / PART).cast("int")], p % PART)
    return asked.select("u", "v", F.forall("_pos", hit).alias("found"))


def density(bits: DataFrame, m: int = 8192) -> DataFrame:
    """density: the share of the set bits of one sketch."""
    return bits.agg((F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)) / m).alias("density"))


def sketch_stats(bits: DataFrame, m: int = 8192, k: int = 4) -> DataFrame:
    """Of clients' sketches (cid, part, bits) joined by OR: density, est_fpr, num_clients, m."""
    clients = bits.agg(F.count_distinct("cid").alias("num_clients"))
    return density(merged(bits), m).join(clients).select("density", F.pow("density", F.lit(float(k))).alias("est_fpr"), "num_clients", F.lit(m).alias("m"))  # one row and one row
