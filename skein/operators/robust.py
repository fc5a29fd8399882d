"""Distances between clients' updates (cid, k, w) by blocks, and the client that lies nearest to the others.

Updates become vectors. Clients are dealt into blocks; a task takes two blocks at a time and forms all distances
between them from local matrix products. Where vectors are short, blocks have so many clients as fill CHUNK_VALUES,
and a task works through tiles of their square; longer vectors are cut into chunks of coordinates, and a task holds two
small blocks of one chunk and a square of sums. Every vector is shuffled once for each block: a few copies that deal
the pairs out to all cores, until there are more clients than such blocks hold.

Defined results: a coordinate that one of two clients lacks (or has null) doesn't count for them; two
clients without a coordinate in common are at distance 0; a NaN makes every distance of its client NaN,
the largest of all; (cid, k) is unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Clients of a block of long vectors, about, values of a block's chunk (16 MB), and clients of a tile's side.
SIDE, CHUNK_VALUES, TILE = 256, 1 << 21, 512
#: Distances whose rows are made at once, and of a run of them.
BATCH, RUN = 1 << 16, 256


def _vectors(upd: DataFrame, width: int) -> DataFrame:
    """cid, chunk, at (places in the chunk) and w: each client's update in chunks of ``width`` coordinates."""
    k = F.col("k").cast("long")
    rows = upd.where("w is not null").select("cid", F.floor(k / width).alias("chunk"), F.struct(F.pmod(k, F.lit(width)).cast("int").alias("at"), F.col("w").cast("double").alias("w")).alias("v"))
    return rows.groupBy("cid", "chunk").agg(F.collect_list("v").alias("v")).select("cid", "chunk", F.col("v.at").alias("at"), F.col("v.w").alias("w"))


def _block(part) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where there is none) and presence of the vectors of one chunk."""
    lists = [part.column(c).combine_chunks() for c in ("at", "w")]
    at, w = (np.asarray(x.flatten()) for x in lists)
    row = np.repeat(np.arange(part.num_rows), np.asarray(lists[0].value_lengths()))
    values, has = np.zeros((part.num_rows, 1 + int(at.max()))), np.zeros((part.num_rows, 1 + int(at.max())), bool)
    values[row, at], has[row, at] = w, True
    return values, has


def squared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Squared distances of all rows of a and b over the coordinates that both have."""
    size = max(a[0].shape[1], b[0].shape[1])
    (x, in_x), (y, in_y) = ((np.pad(v, ((0, 0), (0, size - v.shape[1]))), np.pad(h, ((0, 0), (0, size - h.shape[1])))) for v, h in (a, b))
    with np.errstate(invalid="ignore", over="ignore"):
        if in_x.all() and in_y.all():
            left, right = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[None, :]
        else:
            left, right = (x * x) @ in_y.T.astype(float), in_x.astype(float) @ (y * y).T
        found = left + right - 2 * (x @ y.T)
        # What cancels out, or isn't finite, is summed coordinate by coordinate.
        i, j = np.nonzero(~(found > 1e-6 * (left + right)))
        for part in np.array_split(np.arange(len(i)), 1 + len(i) * size // CHUNK_VALUES):
            apart = np.where(in_x[i[part]] & in_y[j[part]], x[i[part]] - y[j[part]], 0)
            found[i[part], j[part]] = (apart * apart).sum(axis=1)
    return found


def _layout(clients: int, coordinates: int, side: int, cores: int, kept: int = 1) -> tuple[int, int]:
    """Blocks, and coordinates of a chunk, for so many values that are kept of a client."""
    width = max(1, CHUNK_VALUES // side)
    if coordinates > width:
        return max(1, -(-clients // side)), width
    rows = max(side, CHUNK_VALUES // max(coordinates, kept, 1))
    # Four pairs of blocks a core, if there are as many clients.
    return max(1, -(-clients // rows), min(-(-clients // side), int(np.ceil(np.sqrt(8 * cores))))), width


class _Rows:
    """What a task makes of the distances between two blocks: here rows i, j, d."""

    def __init__(self, kind):
        self.kind = _arrow_type(kind)

    def tile(self, first: int, rows: list, second: int, cols: list, d: np.ndarray, same: bool) -> Iterator:
        """The clients (ids, and the place of their first in its block), their distances, and whether they are the same."""
        import pyarrow as pa

        i, j = np.triu_indices(len(d), 1) if same else (x.ravel() for x in np.indices(d.shape))
        d = d[i, j]
        a, b = (pa.array(x, self.kind).take(pa.array(at)) for x, at in ((rows, i), (cols, j)))
        for at in range(0, len(d), BATCH):
            here = slice(at, at + BATCH)
            # A run of distances, then the same with i and j exchanged, so near that what compresses columns finds them.
            size = len(d[here])
            order = pa.array(np.argsort(np.tile(np.arange(size) // RUN, 2), kind="stable"))
            x, y = a[here], b[here]
            both = [pa.concat_arrays([x, y]), pa.concat_arrays([y, x]), pa.array(np.tile(d[here], 2))]
            yield pa.RecordBatch.from_arrays([c.take(order) for c in both], names=["i", "j", "d"])

    def end(self, rows: list, cols: list, same: bool) -> Iterator:
        yield from ()


class _Largest:
    """Rows cid, rest, most: the ``most`` largest distances of each client to the other block, and the sum of the rest."""

    def __init__(self, kind, most: int):
        self.kind, self.most, self.sides = _arrow_type(kind), most, ({}, {})

    def _add(self, side: int, first: int, d: np.ndarray) -> None:
        rest, held = self.sides[side].get(first, (np.zeros(len(d)), np.zeros((len(d), 0))))
        d = np.concatenate([held, d], axis=1)
        cut = max(d.shape[1] - self.most, 0)
        if 0 < cut:
            d = np.partition(d, cut, axis=1)  # NaN last
        self.sides[side][first] = rest + d[:, :cut].sum(axis=1), d[:, cut:]

    def tile(self, first: int, rows: list, second: int, cols: list, d: np.ndarray, same: bool) -> Iterator:
        if same:
            d = d[~np.eye(len(d), dtype=bool)].reshape(len(d), -1)
        self._add(0, first, d)
        if not same:
            self._add(1, second, d.T)
        yield from ()

    def end(self, rows: list, cols: list, same: bool) -> Iterator:
        import pyarrow as pa

        for ids, side in zip((rows, cols), self.sides, strict=True):
            for first, (rest, most) in side.items():
                yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + len(rest)], self.kind), pa.array(rest), pa.array(list(most), pa.list_(pa.float64()))], names=["cid", "rest", "most"])
        self.sides = ({}, {})


def _by_blocks(upd: DataFrame, side: int, made: Callable, schema: str, kept: int = 1) -> DataFrame:
    """What ``made(type of cid)`` makes of the distances of every two blocks, as rows of ``schema``."""
    cores, known = upd.sparkSession.sparkContext.defaultParallelism, upd.agg(F.count_distinct("cid").alias("n"), F.max(F.col("k").cast("long")).alias("k")).first()
    blocks, width = _layout(known["n"], (known["k"] or 0) + 1, side, cores, kept)
    whole, kind = (known["k"] or 0) < width, upd.schema["cid"].dataType
    own = _vectors(upd, width).withColumn("own", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "chunk", "cid", "at", "w")
    # More than there are pairs of blocks, so that few tasks get several.
    tasks = max(cores, min(2 * blocks * (blocks + 1), 1 << 16))
    ordered = dealt.repartition(tasks, "p", "q").sortWithinPartitions("p", "q", "chunk", "cid")

    def tiles(sides, ids, same, out):
        """All tiles of two blocks whose vectors are whole; of a block with itself those on and above the diagonal."""
        left, right = (_block(x) for x in sides)
        for a in range(0, len(ids[0]), TILE):
            for b in range(a if same else 0, len(ids[1]), TILE):
                d = squared(*[tuple(m[at : at + TILE] for m in x) for x, at in ((left, a), (right, b))])
                yield from out.tile(a, ids[0][a : a + TILE], b, ids[1][b : b + TILE], d, same and a == b)

    def run(batches) -> Iterator:
        for (p, q), parts in _runs(batches, ("p", "q")):
            ids, out = ({}, {}), made(kind)
            total = np.zeros((0, 0))
            for _, rows in _chunks(parts):
                sides = [rows.filter(_equal(rows, "own", x)) for x in (p, q)]
                if not all(x.num_rows for x in sides):
                    continue
                at = []
                for known, x in zip(ids, sides, strict=True):
                    at.append(np.array([known.setdefault(c, len(known)) for c in x.column("cid").to_pylist()]))
                if whole:
                    yield from tiles(sides, [list(x) for x in ids], p == q, out)
                    continue
                total = np.pad(total, [(0, len(known) - n) for known, n in zip(ids, total.shape, strict=True)])
                total[np.ix_(*at)] += squared(*map(_block, sides))
            names = [list(x) for x in ids]
            if total.size:
                yield from out.tile(0, names[0], 0, names[1], total, p == q)
            yield from out.end(*names, p == q)

    return ordered.mapInArrow(run, schema)


def _equal(rows, column: str, value: int):
    import pyarrow.compute as pc

    return pc.equal(rows.column(column), value)


def _runs(batches, keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator]]:
    """Runs of rows with equal keys: the keys and an iterator of record batches, to be used up before the next run."""
    pieces = _pieces(batches, keys)
    held = next(pieces, None)
    while held is not None:
        key, after = held[0], []

        def parts(first=held, key=key, after=after):
            yield first[1]
            for piece in pieces:
                if piece[0] != key:
                    after.append(piece)
                    return
                yield piece[1]

        run = parts()
        yield key, run
        for _ in run:  # what the user left over
            pass
        held = after[0] if after else None


def _pieces(batches, keys: tuple[str, ...]) -> Iterator[tuple[tuple, object]]:
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield tuple(c[a].item() for c in columns), batch.slice(a, b - a)


def _chunks(parts) -> Iterator[tuple[tuple, object]]:
    """The rows of each chunk of a run, as one table."""
    import pyarrow as pa

    for key, rows in _runs(parts, ("chunk",)):
        yield key, pa.Table.from_batches(list(rows))


def _arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def distances(upd: DataFrame, side: int = SIDE) -> DataFrame:
    """Squared distances of all pairs of clients: i, j, d. There is a row for every two clients, as the method asks."""
    kind = upd.schema["cid"].dataType.simpleString()
    return _by_blocks(upd, side, _Rows, f"i {kind}, j {kind}, d double")


def _clients(upd: DataFrame) -> int:
    return upd.select("cid").distinct().count()


def krum_scores(upd: DataFrame, f: int = 1, side: int = SIDE) -> DataFrame:
    """cid, score: the sum of the n - f - 2 least distances to others, that is of all but the f + 1 largest.

    A task keeps of each client the f + 1 largest distances to the other block apart from the sum of the rest, so
    a client has a row a block, not one for every other client."""
    n = _clients(upd)
    kind = upd.schema["cid"].dataType.simpleString()
    if n - f - 2 < 1:
        return upd.sparkSession.createDataFrame([], f"cid {kind}, score double")
    parts = _by_blocks(upd, side, lambda kind: _Largest(kind, f + 1), f"cid {kind}, rest double, most array<double>", f + 1)
    joined = parts.groupBy("cid").agg(F.sum("rest").alias("rest"), F.array_sort(F.flatten(F.collect_list("most"))).alias("most"))  # at most f + 1 values a block
    kept = F.slice("most", F.lit(1), F.greatest(F.size("most") - (f + 1), F.lit(0)))
    return joined.select("cid", (F.col("rest") + F.aggregate(kept, F.lit(0.0), lambda s, d: s + d)).alias("score"))
