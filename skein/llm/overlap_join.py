"""Components of documents whose sets of five-word shingles overlap, by T-occurrence search.

Documents with equal sets are one node. A node of n shingles can only link with one that shares T of
them or more (T: ``similar`` x n, rounded up). Every group of rows asks the hash buckets in how many
documents its shingles are; a node with fewer than T shingles that others have links with nothing. The
others put their shingles in one order, from short inverted lists to long ones. As DivideSkip has it, a
node leaves its L longest lists out, L = T / (MU log2 M + 1) for a longest list of M, and is posted in the
rest. Two nodes that link share as many of those short lists as the overlap they need less the larger L.

Short lists of a node alone, or of one component, are dropped, so how many are left also bounds what two nodes can
share. They have one order, too: as the pairs of a passage that many texts have would grow with the square of
these, two nodes only meet in a list if as many as they need in common can still follow it in both.

First every node is held against the node that most of its lists name as their leader, twice, so that a
group of near copies costs one test each and becomes one component. Then the lists that still hold several
components are searched: a task merges, by a heap, the lists of each node in its bucket. In a list only
members outside its largest component ask, and a long list, both its members and those that ask, is dealt
over several tasks. Pairs that meet in a short list are probed in the others, by binary search in the
other's sorted set, which decides exactly. Shingles are 64-bit hashes, nodes 128-bit ones.

Defined results: a null, empty or blank text has no shingles, links with nothing and is a component of its
own (with its own doc_id, if null a null one); other components have their smallest doc_id (null only if
all are); repeated rows are one node; an empty table gives no rows; columns besides doc_id and text are
ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.caches import only
from skein.llm.common import _read_bytes, grouped_rows, joined, long_rows, scope, written
from skein.llm.minhash import _mixed, _odd, _WordHashes, components

WORDS, SIMILAR = 5, (80, 100)
#: The cost of probing a long list against that of merging a short one.
MU = 0.01
#: Rows of a group, and shingles for a hash bucket, about; postings for a bucket of the search; members of a list that one task searches; pairs that it holds.
GROUP_ROWS, BUCKET_SHINGLES, BUCKET_POSTS, LIST_PART, PAIRS = 256, 2_000_000, 200_000, 20_000, 20_000
TURNS = 2


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = text.lower().split()  # A-Z; on the six ASCII separators
    n, found = len(words), only("word hashes", _WordHashes)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.zeros(max(n, WORDS), np.uint64)
    h[:n] = np.fromiter(map(found.__getitem__, words), np.uint64, n)
    last = len(h) - WORDS + 1
    total = np.zeros(last, np.uint64)
    for k in range(WORDS):
        total += h[k : k + last] * _odd(k)
    return np.unique(_mixed(total))


def needed(n: int, similar: tuple[int, int] = SIMILAR) -> int:
    """T: the least overlap of a set of n with any that links with it."""
    return -(-n * similar[0] // similar[1])


def skipped(n: int, longest: int, similar: tuple[int, int] = SIMILAR) -> int:
    """L: how many of the longest lists are probed instead of merged."""
    t = needed(n, similar)
    return max(0, min(t - 1, int(t / (MU * np.log2(max(longest, 1)) + 1))))


def links(a: np.ndarray, b: np.ndarray, similar: tuple[int, int] = SIMILAR) -> bool:
    """Whether two sorted sets link: the smaller one's shingles are probed in the other."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) * similar[1] < len(b) * similar[0]:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    both = int((b[at] == a).sum())
    return both * similar[1] >= similar[0] * (len(a) + len(b) - both)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in order as differences, the bytes of equal weight together: those of high weight are nearly all
    zero, which Spark's shuffle compresses away."""
    return np.diff(numbers.astype(np.uint64), prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _answered(batches):
    """The answers of a task. Its rows come bucket by bucket, and by chance several buckets have one task: it holds
    one of them at a time, so that its memory doesn't grow with their number."""
    bucket, asked = None, []
    for batch in batches:
        for name, *row in zip(*[batch.column(c).to_pylist() for c in ("bucket", "group", "h", "n")], strict=True):
            if name != bucket and asked:
                yield from _counted(asked)
                asked = []
            bucket = name
            asked.append(row)
    if asked:
        yield from _counted(asked)


def _counted(asked: list[list]):
    """group, h and n of what the groups ask for in one bucket, as far as several documents have it."""
    import pyarrow as pa

    parts = [_unpacked(x[1]) for x in asked]
    h, n = np.concatenate(parts), np.frombuffer(b"".join(x[2] for x in asked), np.uint8)
    found, number = np.unique(h, return_inverse=True)
    total = np.bincount(number, n, len(found)).astype(np.int64)
    several, at = total > 1, 0
    for first in range(0, len(asked), 1000):
        groups, hashes, counts = [], [], []
        for (g, _, _), part in zip(asked[first : first + 1000], parts[first : first + 1000], strict=True):
            mine = number[at : at + len(part)]
            at += len(mine)
            mine = mine[several[mine]]
            if len(mine):
                groups.append(g), hashes.append(_packed(found[mine])), counts.append(np.ascontiguousarray(np.minimum(total[mine], 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["group", "h", "n"])


def _shared(rows: DataFrame, bits: int, buckets: int) -> DataFrame:
    """group, h and n: of the shingles of each group those (their highest bits) that several documents have, and
    how many do. A group asks once for a shingle, so one that every document has is no large bucket."""

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            group, texts = batch.column("group").to_numpy(), batch.column("text").to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(edges, edges[1:]):
                sets = [shingle_set(t) for t in texts[a:b]]
                h, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)  # in order, so buckets are too
                if not len(h):
                    continue
                bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                h >>= np.uint64(64 - bits)
                names, starts = np.unique(bucket, return_index=True)
                ends = [*starts[1:].tolist(), len(h)]
                n = np.minimum(n, 255).astype(np.uint8)
                parts = list(zip(starts.tolist(), ends, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.repeat(pa.scalar(int(group[a]), pa.int64()), len(names)), pa.array([_packed(h[i:j]) for i, j in parts], pa.binary()), pa.array([n[i:j].tobytes() for i, j in parts], pa.binary())], names=["bucket", "group", "h", "n"])

    asked = rows.select("group", "text").mapInArrow(ask, "bucket int, group long, h binary, n binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return asked.mapInArrow(_answered, "group long, h binary, n binary")


def _signed(rows: DataFrame, shared: DataFrame, bits: int, similar: tuple[int, int]) -> DataFrame:
    """doc_id, key and n (shingles) of every row; of those that may link, once in a group, also the set, skip (L)
    and the shingles of the short lists that several documents are in."""

    def sign(part, answers):
        import pyarrow as pa
        import xxhash

        h = np.concatenate([np.zeros(0, np.uint64), *map(_unpacked, answers.column("h").to_pylist())])
        count = np.concatenate([np.zeros(0, np.uint32), *(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel() for x in answers.column("n").to_pylist())])
        h, first = np.unique(h, return_index=True)  # a group that two tasks asked for has two answers
        count, seen, out = count[first].astype(np.int64), set(), {c: [] for c in ("key", "n", "set", "skip", "posts")}
        for text in part.column("text").to_pylist():
            found = shingle_set(text)
            n, key = len(found), xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
            row = (key, n, None, None, None)
            if n and key not in seen and len(h):
                seen.add(key)
                high = found >> np.uint64(64 - bits)
                at = np.minimum(np.searchsorted(h, high), len(h) - 1)
                often = np.where(h[at] == high, count[at], 1)
                if int((often > 1).sum()) >= needed(n, similar):
                    skip = skipped(n, int(often.max()), similar)
                    order = np.lexsort((found, often))[: n - skip]
                    row = (key, n, found.tobytes(), skip, found[order[often[order] > 1]].view(np.int64))
            for c, x in zip(out, row, strict=True):
                out[c].append(x)
        types = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        return pa.table({"doc_id": part.column("doc_id")} | {c: pa.array(x, t) for (c, x), t in zip(out.items(), types, strict=True)})

    return rows.groupBy("group").cogroup(shared.groupBy("group")).applyInArrow(sign, "doc_id long, key binary, n long, set binary, skip long, posts array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Those pairs (a, b) that link. A node in most pairs is dealt out by salt."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            both = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)
            near = [i for i, (x, y) in enumerate(both) if links(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), similar)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(near, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(64)).alias("s"))
    leaders = salted.select("a", "s").distinct().join(sets.select(F.col("key").alias("a"), F.col("set").alias("sa")), "a")
    both = salted.join(sets.select(F.col("key").alias("b"), F.col("set").alias("sb")), "b").join(leaders, ["a", "s"])
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _led(posts: DataFrame) -> DataFrame:
    """a, b: every node with the leader that most of its lists name. A list's leader is the member that shares most
    lists with others, as a text has that the copies near it were made from."""
    lead = posts.groupBy("e").agg(F.max(F.struct("mates", "key")).alias("l"), F.count("*").alias("m")).where("m > 1").select("e", F.col("l.key").alias("lead"))
    votes = posts.join(lead, "e").where("key <> lead").groupBy("key", "lead").agg(F.count("*").alias("c"))
    best = votes.groupBy("key").agg(F.min(F.struct(-F.col("c"), F.col("lead"))).alias("v"))
    return best.select(F.least("key", "v.lead").alias("a"), F.greatest("key", "v.lead").alias("b")).distinct()


def occurrences(lists: list[list[int]]) -> list[tuple[int, int]]:
    """Members of sorted lists and in how many of them they are, by a heap of the lists' heads."""
    heads = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heads)
    out = []
    while heads:
        member, n = heads[0][0], 0
        while heads and heads[0][0] == member:
            _, i, at = heads[0]
            n += 1
            if at + 1 < len(lists[i]):
                heapq.heapreplace(heads, (lists[i][at + 1], i, at + 1))
            else:
                heapq.heappop(heads)
        out.append((member, n))
    return out


def _groups(batches):
    """The rows of each group (bucket, part, turn), which follow each other, as one table."""
    import pyarrow as pa

    group, held = None, []
    for batch in batches:
        names = np.stack([batch.column(c).to_numpy() for c in ("bucket", "part", "turn")])
        edges = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for first, end in zip(edges, edges[1:]):
            if first == end:
                continue
            if (name := tuple(names[:, first].tolist())) != group and held:
                yield pa.Table.from_batches(held)
                held = []
            group = name
            held.append(batch.slice(first, end - first))
    if held:
        yield pa.Table.from_batches(held)


def _searched(batches, similar: tuple[int, int]):
    """a, b: what the lists of each group bring together, at most about PAIRS rows at once."""
    import pyarrow as pa

    for table in _groups(batches):
        asks, rest = (np.array(table.column(c).to_pylist(), bool) for c in ("asks", "rest"))
        keys, number = np.unique(np.array(table.column("key").to_pylist(), object), return_inverse=True)
        n, skip, left, root = (np.zeros(len(keys), t) for t in (np.int64, np.int64, np.int64, object))
        for c, x in (("n", n), ("skip", skip), ("left", left), ("root", root)):
            x[number] = np.array(table.column(c).to_pylist(), x.dtype)
        root = np.unique(root, return_inverse=True)[1]
        e, place = table.column("e").to_numpy(), table.column("place").to_numpy()
        order = np.flatnonzero(~asks)
        order = order[np.lexsort((number[order], e[order]))]
        names, starts = np.unique(e[order], return_index=True)
        lists = dict(zip(names.tolist(), np.split(order, starts[1:]), strict=True))
        wanted: dict[int, list[int]] = {}
        for i in np.flatnonzero(asks).tolist():
            wanted.setdefault(int(number[i]), []).append(i)
        low, high = [], []
        for r, its in wanted.items():
            short = []
            for i in its:
                rows = lists.get(int(e[i]))
                if rows is None:
                    continue
                s = number[rows]
                least = -(-(n[s] + n[r]) * similar[0] // (similar[0] + similar[1])) - np.maximum(skip[s], skip[r])
                # As many lists as the two need in common must be left from this one on.
                may = (least <= left[r] - place[i]) & (least <= left[s] - place[rows])
                # Of two members that both ask, the lesser does; members of the largest component never do.
                may &= (root[s] != root[r]) & (rest[rows] | (s > r)) & (np.minimum(n[s], n[r]) * similar[1] >= np.maximum(n[s], n[r]) * similar[0])
                short.append(s[may].tolist())
            for s, _ in occurrences(short):
                low.append(min(r, s)), high.append(max(r, s))
                if len(low) >= PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[x], pa.binary()) for x in (low, high)], names=["a", "b"])
                    low, high = [], []
        if low:
            yield pa.RecordBatch.from_arrays([pa.array(keys[x], pa.binary()) for x in (low, high)], names=["a", "b"])


def _met(posts: DataFrame, roots: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """a, b: pairs of different components that have short lists in common so early in both that they may have enough."""
    placed = posts.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    sizes = placed.groupBy("e", "root").agg(F.count("*").alias("c"))
    several = sizes.groupBy("e").agg(F.count("*").alias("roots"), F.sum("c").alias("m"), F.max("c").alias("largest"), F.max_by("root", F.struct("c", "root")).alias("most")).where("roots > 1").drop("roots")
    # A list has parts, of which one task searches one, and members that ask in turns.
    several = several.select("e", "m", "most", F.ceil(F.col("m") / LIST_PART).alias("parts"), F.ceil((F.col("m") - F.col("largest")) / LIST_PART).alias("turns"))
    own = Window.partitionBy("key")  # no more rows than the text has shingles
    # Written: lists of one component, as a rule nearly all, are gone.
    placed = placed.join(several, "e").select("*", F.count("*").over(own).alias("left"), (F.row_number().over(own.orderBy("m", "e")) - 1).alias("place"))
    placed = written(placed, "lists")
    buckets = max(1, placed.count() // BUCKET_POSTS)
    bucket = F.pmod(F.xxhash64("e"), F.lit(buckets)).alias("bucket")
    dealt = lambda parts: F.pmod(F.xxhash64("key"), parts).cast("long")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts).cast("long") - 1))
    columns = ["key", "root", "n", "skip", "left", F.col("place").cast("long").alias("place")]
    members = placed.select("e", bucket, dealt("parts").alias("part"), all_of("turns").alias("turn"), *columns, (F.col("root") == F.col("most")).alias("rest"), F.lit(False).alias("asks"))
    asking = placed.where("root <> most").select("e", bucket, all_of("parts").alias("part"), dealt("turns").alias("turn"), *columns, F.lit(False).alias("rest"), F.lit(True).alias("asks"))
    group = ["bucket", "part", "turn"]
    rows = members.unionByName(asking).repartition(*group).sortWithinPartitions(*group)
    return rows.mapInArrow(lambda batches: _searched(batches, similar), "a binary, b binary").distinct()


def _links(nodes: DataFrame, similar: tuple[int, int]) -> DataFrame | None:
    """Links between nodes that give the same components as all links."""
    posts = nodes.select("key", "n", "skip", F.explode("posts").alias("e"))
    several = posts.groupBy("e").agg(F.count("*").alias("m")).where("m > 1")
    posts = written(posts.join(several, "e"), "lists")
    posts = written(posts.join(posts.groupBy("key").agg(F.sum("m").alias("mates")), "key").drop("m"), "posts")
    sets, left, found, tested = nodes.select("key", "set"), posts, None, None
    for _ in range(TURNS):
        pairs = written(_led(left) if tested is None else _led(left).join(tested, ["a", "b"], "left_anti"), "pairs")
        near = written(_verified(pairs, sets, similar), "links")
        found, tested = (near, pairs) if found is None else (found.unionByName(near), tested.unionByName(pairs))
        settled = found.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        left = posts.join(settled, "key", "left_anti")
    met = written(_met(posts, components(found), similar).join(tested, ["a", "b"], "left_anti"), "pairs")
    return found.unionByName(written(_verified(met, sets, similar), "links"))


def linked(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs; ``similar`` is a fraction as two whole numbers."""
    spark = docs.sparkSession
    with scope(spark) as keep:
        long_rows(spark)
        rows = grouped_rows(docs, GROUP_ROWS)
        size = max(_read_bytes(rows), 1)
        # So many bits of a hash that few are equal by chance among so many shingles; equal ones only cost time.
        bits = int(np.clip(np.ceil(np.log2(size)) + 8, 40, 64))
        buckets = max(spark.sparkContext.defaultParallelism, size * 2 // 10 // BUCKET_SHINGLES)
        signed = written(_signed(rows, _shared(rows, bits, buckets), bits, similar), "signed")
        nodes = signed.where("set is not null").groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "set", "skip", "posts")])
        found = components(_links(written(nodes, "nodes"), similar))
        members = signed.select("doc_id", "key", "n")
        blank = members.where("key is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        full = members.where("key is not null")
        total = full.count()
        placed = written(joined(full, found, "key", total, "left").select("doc_id", "n", F.coalesce("root", "key").alias("root")), "placed")
        least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        out = joined(placed, least, "root", total).select("doc_id", "n", "component_id").unionByName(blank)
        out = keep(written(out, "components"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT i, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[k:k + 4], ' ') for k in range(1, len(w) - 3)] END) AS e FROM d WHERE len(w) > 0),
n AS (SELECT i, count(*) AS n FROM s GROUP BY i),
h AS (SELECT s.i, hash(string_agg(e, chr(10) ORDER BY e)) AS h, min(n) AS n FROM s JOIN n USING (i) GROUP BY s.i),
r AS (SELECT h, min(i) AS i, min(n) AS n FROM h GROUP BY h),
p AS (SELECT a.i AS x, b.i AS y FROM s AS a JOIN r AS ra ON ra.i = a.i JOIN s AS b ON a.e = b.e JOIN r AS rb ON rb.i = b.i AND ra.i < rb.i
  GROUP BY a.i, b.i, ra.n, rb.n HAVING 100 * count(*) >= 80 * (ra.n + rb.n - count(*))),
l AS (SELECT x, y FROM p UNION SELECT y, x FROM p UNION SELECT h.i, r.i FROM h JOIN r USING (h) UNION SELECT r.i, h.i FROM h JOIN r USING (h)),
c (i, j) AS (SELECT i, i FROM n UNION SELECT c.i, l.y FROM c JOIN l ON l.x = c.j),
m AS (SELECT c.i, min(d.doc_id) AS component_id FROM c JOIN d ON d.i = c.j GROUP BY c.i)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id FROM d LEFT JOIN n USING (i) LEFT JOIN m USING (i)
"""
