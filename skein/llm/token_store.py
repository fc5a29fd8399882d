"""Token ids in directly addressable codes, written as shards and read back.

An id is split into chunks of eight bits. Level k holds chunk k of every id that has one; a
continuation bitmap tells which ids go on to level k + 1, and a directory of running bit counts turns
a place in one level into the place in the next. Any token is read with one look at each level.

A shard is a row of a Parquet file (Spark commits it whole, on whatever store the shared folder is
in): the code, the shard's documents and their lengths. Shards follow each other in doc_id order.

Defined results: a null or empty text has the end id alone; null ids come last; equal ids keep no
particular order; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import long_rows, scratch

MAGIC, CHUNK, RANK_BITS = b"DAC1", 8, 512
#: A shard closes once it has this many tokens.
SHARD_TOKENS = 1 << 20
#: Text for one range of ids, and so for one task that writes shards.
RANGE_BYTES = 32 << 20
SHARD = "range int, shard int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, code binary"


def dac_encode(ids: np.ndarray) -> bytes:
    """Header (magic, levels, then ids per level), then per level: chunks, bitmap, rank directory."""
    values, sizes, body = np.asarray(ids, np.uint32), [], []
    while True:
        chunk, rest = (values & 0xFF).astype(np.uint8), values >> CHUNK
        more = rest > 0
        ones = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)])[:-1].astype("<u4") if len(more) else np.zeros(0, "<u4")
        sizes.append(len(values))
        body += [chunk.tobytes(), np.packbits(more, bitorder="little").tobytes(), ranks.tobytes()]
        values = rest[more]
        if not len(values):
            return MAGIC + struct.pack(f"<I{len(sizes)}Q", len(sizes), *sizes) + b"".join(body)


class Dac:
    """Reads a code; ``dac[i]`` decodes one id, ``dac.read(a, b)`` a run of them."""

    def __init__(self, code: bytes):
        if code[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        (n,) = struct.unpack_from("<I", code, 4)
        sizes, at, self.levels = struct.unpack_from(f"<{n}Q", code, 8), 8 + 8 * n, []
        for size in sizes:
            chunks = np.frombuffer(code, np.uint8, size, at)
            bits = np.frombuffer(code, np.uint8, -(-size // 8), at + size)
            ranks = np.frombuffer(code, "<u4", -(-size // RANK_BITS), at + size + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += size + len(bits) + 4 * len(ranks)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before place i."""
        if i >> 9 >= len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(bits[(len(ranks) - 1) * 64 :]).sum()) if len(ranks) else 0
        block = i >> 9
        rank = int(ranks[block]) + int(np.bitwise_count(bits[block * 64 : i >> 3]).sum())
        return rank + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else rank

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i = self._rank(bits, ranks, i)
        return value

    def read(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = len(self) if b is None else b
        value, places = np.zeros(b - a, "<u4"), np.arange(b - a)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value[places] |= chunks[a:b].astype(np.uint32) << (CHUNK * k)
            more = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            places = places[more]
            if not len(places):
                break
            a = self._rank(bits, ranks, a)
            b = a + len(places)
        return value


def _ranges(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Bounds of doc_id that cut docs into ranges of about RANGE_BYTES of text (an id that fills several ranges is
    as many bounds), and how many more ranges the rows without an id take."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    total, none = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), size)), F.lit(0))).first()
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // RANGE_BYTES))
    parts = max(1, round(n * (total - none) / max(total, 1)))
    marks = [i / parts for i in range(1, parts)]
    found = docs.select(F.percentile_approx("doc_id", marks, max(10_000, 20 * parts)).alias("b")).first()["b"] if marks else None
    return np.array(sorted(found or []), np.int64), max(1, n - parts)


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Writes the shards of docs to ``path``."""
    long_rows(docs.sparkSession)
    bounds, without = _ranges(docs)

    def encode(batches):
        import pyarrow as pa

        from skein.llm.tokens import encoder, slices

        code = encoder(tokenizer)
        end = np.array([end_id], code.dtype).tobytes()
        for piece in slices(batches):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            known, spread = piece.column("doc_id").is_valid().to_numpy(zero_copy_only=False), np.array([zlib.crc32(t.encode()) for t in texts], np.int64)
            ids = piece.column("doc_id").fill_null(0).to_numpy()
            low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
            part = np.where(known, low + spread % np.maximum(high - low, 1), len(bounds) + 1 + spread % without)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), piece.column("doc_id"), pa.array([x + end for x in code(texts)], pa.binary())], names=["range", "doc_id", "ids"])

    def shards(batches):
        import pyarrow as pa

        from skein.llm.tokens import encoder

        kind, at = encoder(tokenizer).dtype, {"range": None, "shard": 0, "start": 0, "n": 0, "docs": [], "lengths": [], "ids": []}

        def flush():
            row = [at["range"], at["shard"], at["start"], at["n"], at["docs"], at["lengths"], dac_encode(np.frombuffer(b"".join(at["ids"]), kind))]
            at.update(shard=at["shard"] + 1, start=at["start"] + at["n"], n=0, docs=[], lengths=[], ids=[])
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in SHARD.split(", ")])

        for batch in batches:
            for r, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "ids")), strict=True):
                if at["docs"] and (r != at["range"] or at["n"] >= SHARD_TOKENS):
                    yield flush()
                if r != at["range"]:
                    at.update(range=r, shard=0, start=0)
                at["docs"].append(doc_id)
                at["lengths"].append(len(ids) // kind.itemsize)
                at["ids"].append(ids)
                at["n"] += at["lengths"][-1]
        if at["docs"]:
            yield flush()

    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "range int, doc_id long, ids binary")
    # A partition for every range.
    dealt = coded.repartitionById(len(bounds) + 1 + without, F.col("range")).sortWithinPartitions("range", F.col("doc_id").asc_nulls_last())
    dealt.mapInArrow(shards, SHARD).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """One row per document, decoded from the shards at ``path``: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARD).parquet(path)
    firsts, total = [], 0
    for r in sorted(shards.groupBy("range").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["range"]):  # one a range
        firsts.append((r["range"], total))
        total += r["n"]
    first = spark.createDataFrame(firsts, "range int, first long")

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for start, docs, lengths, code in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_ids", "lengths", "code")), strict=True):
                ids, ends = Dac(code).read(), np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(F.broadcast(first), "range").select((F.col("start") + F.col("first")).alias("start"), "doc_ids", "lengths", "code").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes docs to a fresh place in the shared folder and reads them back."""
    path = scratch(docs.sparkSession, "tokens")
    write(docs, tokenizer, end_id, path)
    return read(docs.sparkSession, path)
