"""Packing documents into fixed-length sequences by bounded-space online best fit.

Pieces arrive one by one, in the order of their documents. Each goes to the open sequence with the least
free space that still holds it, found in a bitset keyed by free space; where none holds it a new one is
opened, and beyond a fixed number of open ones the fullest closes first. Tokenisation runs where the texts
lie; only the narrow piece rows move, to as many packers as their count asks for, so that few sequences
stay part-filled.

Defined results: a null or empty text is a document of the end id alone; only documents longer than a
sequence are cut, the first piece taking the remainder; equal rows are packed each on its own; an
empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import long_rows, written

#: Pieces for one packer, at most about so many, and its open sequences.
PER_PACKER, OPEN = 100_000, 64


class BestFit:
    """Open sequences of ``size`` by free space; ``most`` are open at any time."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free = [[] for _ in range(size + 1)]
        self.bits, self.n_open, self.next = 0, 0, 0

    def _open(self, free: int, sequence: int) -> None:
        self.free[free].append(sequence)
        self.bits |= 1 << free
        self.n_open += 1

    def _take(self, free: int) -> int:
        sequence = self.free[free].pop()
        if not self.free[free]:
            self.bits ^= 1 << free
        self.n_open -= 1
        return sequence

    def put(self, length: int) -> tuple[int, int]:
        """The sequence that takes the piece and the piece's place in it."""
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.size, self.next
            self.next += 1
            if length < self.size and self.n_open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        if free > length:
            self._open(free - length, sequence)
        return sequence, self.size - free


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and _slot (a number of the row's own) of every piece."""

    def cut(batches):
        import pyarrow as pa

        from skein.llm.tokens import encoder, slices

        encode, slot = encoder(tokenizer), None
        for part in slices(batches):
            slot = part.column("part")[0].as_py() << 40 if slot is None else slot
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "_slot")}
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                ids = np.append(np.frombuffer(ids, encode.dtype), end_id).astype("<u4")
                first = len(ids) % size or size
                edges = [0, *range(first, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for name, v in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), slot), strict=True):
                        out[name].append(v)
                    slot += 1
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_slot", pa.int64())]))

    long_rows(docs.sparkSession)
    # The plan's own number of a partition: tasks may read several of them.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.spark_partition_id().cast("long").alias("part")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, _slot long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, open_sequences: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""

    def place(batches):
        import pyarrow as pa

        fit = BestFit(size, open_sequences)
        for batch in batches:
            base = batch.column("_packer")[0].as_py() << 40 if batch.num_rows else 0
            put = [fit.put(n) for n in batch.column("length").to_pylist()]
            added = {"sequence_id": pa.array([base + s for s, _ in put], pa.int64()), "offset": pa.array([o for _, o in put], pa.int64())}
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *added.values()], names=[*batch.schema.names[:5], *added])

    cut = written(pieces(docs, tokenizer, end_id, size), "pieces")
    packers = max(1, -(-cut.count() // PER_PACKER))
    dealt = cut.repartition(packers, "_slot").sortWithinPartitions("_slot").withColumn("_packer", F.spark_partition_id().cast("long"))
    return dealt.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
