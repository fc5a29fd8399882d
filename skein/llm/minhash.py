"""Near-duplicate classes by weighted MinHash over five-word shingles.

A document is the multiset of its five-word shingles (all its words, if it has fewer). Its signature
comes from Poisson processes over the weights of each shingle, arranged in dyadic levels (0, 1],
(1, 2], (2, 4], ...: a level that the weight covers whole counts with all its points, the one in which
the weight ends with those up to it. A point lands in a random component, which keeps the earliest; a
process stops once it passes the latest of them. Two components are then equal with exactly the
weighted Jaccard similarity, at a cost that doesn't grow with the weights.

Equal signatures in a band of components make candidates. A bucket holds all its members against one
leader, the member that shares most buckets, so n near copies cost n comparisons; those that its
largest class doesn't hold are then held against a leader of their own. Members of buckets that still
hold several classes meet by a prefix filter: two texts that are near share one of their rarest
shingles, early enough in both of them, so that texts with one frequent passage in common don't meet
all of each other. Candidates are verified on whole texts. Classes are the connected components of
the verified links.

Defined results: texts of equal words are one node; a null, empty or blank text has no shingles and is
a class of its own; similarity at the bound counts as near; class_id is the smallest doc_id of the
class (null only if all are); a null doc_id that has no words is its own class with a null id; of a
class ``dedup`` keeps the row with the smallest doc_id (null ids last), then the smallest locator, so
one row stays even when ids or rows repeat; an empty table gives no rows; other columns pass through
``dedup`` untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.caches import only
from skein.llm.common import WS, joined, located, long_rows, scope, written

WORDS, SIMILAR = 5, 0.8
#: 40 bands of 6: at similarity 0.8 a link is missed with probability 5e-6, at 0.85 with 5e-9.
BANDS, ROWS = 40, 6
#: Of 64 bits, one for each of as many components, so many may differ: at similarity 0.8, 6.4 do on
#: average with a deviation of 2.4.
APART = 22
#: Turns of leaders in each bucket.
TURNS = 2
#: log2 of the counters by which rare shingles are told from frequent ones: a table of fixed size, and
#: any order of the shingles gives the same links.
COUNTERS = 20
#: Words whose hashes a worker keeps (about 200 bytes each).
KEPT_WORDS = 150_000
NEVER = np.int64((1 << 63) - 1)
_G, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _odd(k: int) -> np.uint64:
    """The k-th of a row of odd multipliers."""
    return np.uint64((0x94D049BB133111EB + 2 * k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)


def _mixed(z: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of all distinct shingles of up to 4096 texts, sorted."""
    parts, sizes, hashes = [], np.zeros(len(texts), np.int64), only("word hashes", _WordHashes)
    pad = np.zeros(WORDS - 1, np.uint64)
    for i, text in enumerate(texts):
        words = text.split()  # on the six ASCII separators
        sizes[i] = len(words)
        if words:
            parts += [np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), pad]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = np.concatenate(parts)
    last = len(flat) - WORDS + 1
    mixed = np.zeros(last, np.uint64)
    for k in range(WORDS):
        mixed += flat[k : k + last] * _odd(k)
    has = np.flatnonzero(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes[has] + WORDS - 1)[:-1]])
    windows = np.maximum(sizes[has] - WORDS + 1, 1)
    which = np.repeat(np.arange(len(has)), windows)
    at = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[which]
    keys = np.sort((has[which].astype(np.uint64) << np.uint64(52)) | (_mixed(mixed[at]) >> np.uint64(12)))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    return (keys >> np.uint64(52)).astype(np.int64), keys & np.uint64((1 << 52) - 1), counts


def signatures(n: int, text: np.ndarray, shingle: np.ndarray, count: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """n x size earliest points, in units of 2**-44 (whole numbers, so that sums don't depend on how a
    process is cut into blocks); NEVER where a text has no shingles."""
    sig = np.full((n, size), NEVER)
    if not len(text):
        return sig
    docs, seeds, rates, shares = [text], [_mixed(shingle * _G + _M1)], [np.ones(len(text))], [np.ones(len(text))]
    level, low = 1, 1
    while (deep := np.flatnonzero(count > low)).size:
        docs.append(text[deep])
        seeds.append(_mixed(shingle[deep] * _G + _odd(level)))
        rates.append(np.full(deep.size, float(low)))
        shares.append(np.minimum((count[deep] - low) / low, 1.0))
        level, low = level + 1, low * 2
    doc, seed, rate, share = (np.concatenate(x) for x in (docs, seeds, rates, shares))
    x, flat, done = np.zeros(len(doc), np.int64), sig.reshape(-1), 0
    while len(doc):
        block = int(np.clip(300_000 // len(doc), 1, 64)) if done else 1
        z = _mixed(seed[:, None] + np.arange(done + 1, done + block + 1, dtype=np.uint64) * _G)
        z2 = _mixed(z + _M1)
        steps = np.log(((z >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) * (-(2.0**44) / rate[:, None])
        points = x[:, None] + np.cumsum(np.rint(steps).astype(np.int64), axis=1)
        place = ((z2 >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        inside = (z2 & np.uint64(0xFFFFFFFF)) * 2.0**-32 < share[:, None]
        np.minimum.at(flat, (doc[:, None] * size + place.astype(np.int64))[inside], points[inside])
        x, done = points[:, -1], done + block
        left = np.flatnonzero(x < sig.max(axis=1)[doc])
        doc, seed, rate, share, x = doc[left], seed[left], rate[left], share[left], x[left]
    return sig


def banded(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text its band hashes, and a bit for each of the first 64 components."""
    bits = _mixed(np.ascontiguousarray(sig).view(np.uint64))
    rows = bits.reshape(len(sig), BANDS, ROWS)
    total = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(ROWS):
        total = _mixed(total + rows[:, :, k] + _odd(k))
    sketch = ((bits[:, :64] & np.uint64(1)) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return _mixed(total + np.arange(1, BANDS + 1, dtype=np.uint64) * _M2).view(np.int64), sketch.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted shingles, counts) that aren't empty."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    both = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


class Multisets(dict):
    """The shingles of texts met lately."""

    def __missing__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(self) >= 1000:
            self.clear()
        self[text] = found = shingles([text])[1:]
        return found


def word_key(text: Column) -> Column:
    """16 bytes that tell texts apart by their words."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " ")).cast("binary")))


def _texts(batch, name: str) -> list[bytes]:
    return [t or b"" for t in batch.column(name).to_pylist()]


def _signed(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, key (and the whole-number columns ``more``) of every row; n (shingles), sketch and bands where the
    task meets the key first."""

    def run(batches):
        import pyarrow as pa

        from skein.llm.tokens import slices

        seen: set[bytes] = set()
        for batch in slices(batches, 3_000_000):
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys, texts = part.column("key").to_pylist(), _texts(part, "text")
                first = []
                for i, k in enumerate(keys):
                    if k not in seen and texts[i]:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(k)
                        first.append(i)
                text, shingle, count = shingles([texts[i] for i in first])
                sizes = np.bincount(text, weights=count, minlength=len(first)).astype(np.int64)
                bands, sketch = banded(signatures(len(first), text, shingle, count))
                n, bits, rows = ([None] * len(keys) for _ in range(3))
                for j, i in enumerate(first):
                    if sizes[j]:
                        n[i], bits[i], rows[i] = int(sizes[j]), int(sketch[j]), bands[j]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(n, pa.int64()), pa.array(bits, pa.int64()), pa.array(rows, pa.list_(pa.int64())), *[part.column(c) for c in more]], names=["doc_id", "key", "n", "sketch", "bands", *more])

    long_rows(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"), *more)
    return rows.mapInArrow(run, ", ".join(["doc_id long, key binary, n long, sketch long, bands array<long>", *[f"{c} long" for c in more]]))


def _may_link(a: str, b: str) -> Column:
    n = (F.col(f"{a}n"), F.col(f"{b}n"))
    return (F.least(*n) >= F.greatest(*n) * SIMILAR) & (F.bit_count(F.col(f"{a}sketch").bitwiseXOR(F.col(f"{b}sketch"))) <= APART)


def elements(text: bytes) -> np.ndarray:
    """A multiset's shingles as a set: a shingle and which occurrence of it, as one number."""
    _, shingle, count = shingles([text])
    turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return _mixed(np.repeat(shingle, count) * _G + turn.astype(np.uint64))


def _slots(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _prefix_pairs(texts: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of ``texts`` (key, root, text) with different roots that may be near; all that are.

    Elements are ordered from rare to frequent. If texts of m <= n elements are near, they share at
    least ``similar / (1 + similar) * (m + n)``, so the first element that they share leaves as many in
    each of them. The shorter text meets others by no more than its first ninth (at 0.8).
    """

    def count(batches):
        import pyarrow as pa

        n = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for text in _texts(batch, "text"):
                np.add.at(n, _slots(elements(text)), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])

    met = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()  # at most 2 ** COUNTERS rows
    table = np.ones(1 << COUNTERS, np.int32)
    table[met.column("slot").to_numpy()] = np.minimum(met.column("n").to_numpy(), (1 << 31) - 1)
    shared, share = texts.sparkSession.sparkContext.broadcast(table), similar / (1 + similar)

    def prefixes(batches):
        import pyarrow as pa

        for batch in batches:
            for i, text in enumerate(_texts(batch, "text")):
                found = elements(text)
                often = shared.value[_slots(found)]
                order = np.lexsort((found, often))
                order = order[: len(found) - int(np.ceil(similar * len(found) - 1e-6)) + 1]
                pos = np.flatnonzero(often[order] > 1)  # no other text has the rest
                one = [pa.repeat(batch.column(c)[i], len(pos)) for c in ("key", "root")]
                yield pa.RecordBatch.from_arrays([*one, pa.repeat(pa.scalar(len(found), pa.int64()), len(pos)), pa.array(pos), pa.array(found[order[pos]].view(np.int64))], names=["key", "root", "n", "pos", "e"])

    rows = written(texts.mapInArrow(prefixes, "key binary, root binary, n long, pos long, e long"), "prefixes")
    a, b = (rows.select("e", *[F.col(c).alias(f"{side}_{c}") for c in ("key", "root", "n", "pos")]) for side in "ab")
    a = a.where(F.col("a_n") - F.col("a_pos") >= F.col("a_n") * (2 * share) - 1e-6)
    shorter = F.struct("a_n", "a_key") < F.struct("b_n", "b_key")
    enough = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) >= (F.col("a_n") + F.col("b_n")) * share - 1e-6
    met = a.join(b, (a["e"] == b["e"]) & (F.col("a_root") != F.col("b_root")) & shorter & (F.col("a_n") >= F.col("b_n") * similar - 1e-6) & enough)
    return met.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Those pairs (a, b) whose texts are near. A key in most pairs is dealt out by salt."""

    def run(batches):
        import pyarrow as pa

        known = Multisets()
        for batch in batches:
            near = [i for i, (x, y) in enumerate(zip(_texts(batch, "ta"), _texts(batch, "tb"), strict=True)) if overlap(known[x], known[y]) >= similar]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(near, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    salted = pairs.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(64)))
    leaders = salted.select("a", "s").distinct().join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    both = salted.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").join(leaders, ["a", "s"])
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """key and root (the least key of its component) for every end of a link (a, b), by alternating
    large and small stars; a key's links are only ever reduced by aggregates that combine first."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("root"))).distinct()


def _links(docs: DataFrame, signed: DataFrame, similar: float) -> DataFrame | None:
    """Links (a, b) between keys that give the same components as all links."""
    nodes = signed.where("bands is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    rows = written(nodes, "nodes").select(F.explode("bands").alias("band"), "key", "n", "sketch")
    full = rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    shared = written(rows.join(full, "band"), "buckets")
    if shared.isEmpty():
        return None
    shared = written(shared.join(shared.groupBy("key").agg(F.sum("members").alias("mates")), "key").drop("members"), "ranked")
    texts = docs.select(word_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    texts = written(texts.join(shared.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "texts")
    group, links, tested = shared, None, None
    for _ in range(TURNS):
        lead = group.groupBy("band").agg(F.max(F.struct("mates", "key", "n", "sketch")).alias("l")).select("band", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("key", "n", "sketch")])
        pairs = group.join(lead, "band").where(_may_link("", "l_") & (F.col("key") != F.col("l_key")))
        pairs = pairs.select(F.least("key", "l_key").alias("a"), F.greatest("key", "l_key").alias("b")).distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = _verified(pairs, texts, similar)
        links = written(found if links is None else links.unionByName(found), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        placed = written(shared.join(components(links), "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
        sizes = placed.groupBy("band", "root").agg(F.count("*").alias("c"))
        several = sizes.groupBy("band").agg(F.count("*").alias("classes"), F.max_by("root", F.struct("c", "root")).alias("most")).where("classes > 1").select("band", "most")
        apart = written(placed.join(several, "band"), "apart")
        group = apart.where("root <> most")
        if group.isEmpty():
            return links
    members = apart.groupBy("key").agg(F.first("root").alias("root"))
    rest = _prefix_pairs(written(texts.join(members, "key"), "rest"), similar)
    rest = written(rest.join(tested, ["a", "b"], "left_anti"), "pairs")
    return links.unionByName(_verified(rest, texts, similar))


def _members(docs: DataFrame, similar: float, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, root (a key that only its class has) and the columns ``more`` of every row of docs."""
    with scope(docs.sparkSession) as keep:
        signed = written(_signed(docs, more), "signed")
        links = _links(docs, signed, similar)
        members = signed.select("doc_id", "key", *more)
        if links is not None:
            members = joined(members, components(links), "key", signed.count(), "left")
        else:
            members = members.withColumn("root", F.lit(None).cast("binary"))
        return keep(written(members.select("doc_id", F.coalesce("root", "key").alias("root"), *more), "members"))


def _blank() -> Column:
    """Whether a row of ``_members`` has no words."""
    return F.col("root") == F.unhex(F.md5(F.lit("").cast("binary")))


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size (rows) and _root (a key that only the
    class has)."""
    members, empty = _members(docs, similar), _blank()
    sizes = members.where(~empty).groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    out = joined(members.where(~empty), sizes, "root", members.count())
    blank = members.where(empty).select("root", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.select("root", "doc_id", "class_id", "class_size").unionByName(blank).withColumnRenamed("root", "_root")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, class_size and kept (the smallest doc_id of its class; of equal ids all)."""
    return classes(docs, similar).select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def dedup(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs that stay: one of each class, that with the smallest doc_id."""
    own = located(docs)
    keyed = own.rows.select(own["doc_id"].alias("doc_id"), own["text"].alias("text"), "_row")
    with scope(docs.sparkSession) as kept:
        members = _members(keyed, similar, ("_row",)).where(~_blank())
        least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("keep")
        gone = members.join(members.groupBy("root").agg(least).select("keep._row"), "_row", "left_anti").select("_row")
        # Written, so that its size is known before docs would be shuffled.
        gone = kept(written(gone, "gone"))
    return own.back(own.rows.join(gone, "_row", "left_anti"))
