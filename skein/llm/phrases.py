"""Phrases of each language by how firmly their words hold together.

Texts are cut into pieces at punctuation and line ends. Equal pieces become one with a multiplicity, so
a copied text is counted, not read again. N-grams of the pieces are counted with those weights in
duckdb, one hash bucket a task, out of core. So that few of them have to be dealt out, two-word n-grams
go first: every group of pieces asks the buckets which of its pairs are frequent (by hashes, at most a
wrong yes), and what holds an infrequent pair is no phrase. The n-grams that are left are counted as
they are spelled. Then every phrase is cut in two in all ways; requests for the counts of both parts
are dealt to where the parts lie. Products that can pass 64 bits are decimals.

Defined results: a null text is empty, a null language is ``und``; pieces without words count nothing;
repeated rows count as often as they come; phrases of equal score and count go by their bytes; an
empty table gives no rows; columns besides lang and text are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import long_rows, lookup, scope, written
from skein.llm.quality_rules import _Numbers

#: Characters that end a piece become line ends, tabs spaces.
_CUT = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", b"\n\n\n\n\n\n\n\n\n\n ")
#: Bytes of pieces in a group, about; pieces that a task gathers before it passes them on.
GROUP_BYTES, HELD_PIECES = 8_000_000, 200_000
#: Words (all occurrences) for one hash bucket, about.
BUCKET_WORDS = 4_000_000
#: Memory of duckdb in a task; beyond it, it goes to the task's own scratch folder.
DUCK_MB = 160
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def _pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (words with one space between), w (how often) and group (a few megabytes of pieces)."""

    def cut(batches):
        import pyarrow as pa

        from skein.llm.tokens import slices

        def out():
            keys = list(found)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["lang", "piece", "w"])

        found: Counter = Counter()
        for part in slices(batches):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                for piece in text.lower().translate(_CUT).split(b"\n"):
                    if words := piece.split():
                        found[lang, b" ".join(words)] += 1
            if len(found) > HELD_PIECES:
                yield out()
                found = Counter()
        if found:
            yield out()

    def grouped(batches):
        import pyarrow as pa

        from skein.llm.tokens import slices

        group, size = int.from_bytes(os.urandom(6)) << 15, 0  # kept once the table is written
        for part in slices(batches, GROUP_BYTES, "piece"):
            if size > GROUP_BYTES:
                group, size = group + 1, 0
            size += part.column("piece").nbytes
            yield pa.RecordBatch.from_arrays([*part.columns, pa.repeat(pa.scalar(group, pa.int64()), part.num_rows)], names=["lang", "piece", "w", "group"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counted = rows.mapInArrow(cut, "lang string, piece binary, w long").groupBy("lang", "piece").agg(F.sum("w").alias("w"))
    return counted.mapInArrow(grouped, "lang string, piece binary, w long, group long")


def _by_lang(langs: list[str], pieces: list[bytes], w: np.ndarray) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """Per language its distinct words, and for every place the word (-1 between pieces) and the piece's weight."""
    of = defaultdict(list)
    for i, lang in enumerate(langs):
        of[lang].append(i)
    for lang, at in of.items():
        numbers = _Numbers()
        numbers[b"\n"]  # 0: no word holds it
        tokens = b" \n ".join([pieces[i] for i in at]).split(b" ")
        ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)) - 1
        which = np.cumsum(ids < 0)
        yield lang, list(numbers)[1:], ids, w[np.array(at)][which]


def _hashes(lang: str, words: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, places at which two words of a piece stand, and the hashes of those pairs."""
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang.encode()) & 0xFFFFFFFF
    own = np.array([xxhash.xxh3_64_intdigest(x, seed) for x in words], np.uint64)
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return own, at, _mixed(own[ids[at]] * _M2 + _mixed(own)[ids[at + 1]])


def _summed(keys: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and their weights."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(w[order], new) if len(keys) else w


def _total(ids: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    """Weights by number, exact (sums of doubles aren't, beyond 2 ** 53)."""
    out = np.zeros(size, np.int64)
    np.add.at(out, ids, w)
    return out


@contextmanager
def _duck():
    """A duckdb in a scratch folder of the task, which goes with it."""
    import duckdb

    with tempfile.TemporaryDirectory(prefix="phrases-") as folder:
        con = duckdb.connect(f"{folder}/db", config={"threads": 1, "memory_limit": f"{DUCK_MB}MB", "temp_directory": f"{folder}/spill", "preserve_insertion_order": False})
        try:
            yield con
        finally:
            con.close()


def _insert(con, table: str, rows) -> None:
    con.register("arrived", rows)
    con.execute(f"INSERT INTO {table} SELECT * FROM arrived")
    con.unregister("arrived")


def _cut(h: np.ndarray, width: int) -> bytes:
    """The highest ``width`` bytes of each hash."""
    return np.ascontiguousarray((h >> np.uint64(64 - 8 * width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _whole(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return wide.reshape(-1).view("<u8")


def _groups(batches) -> Iterator[tuple[int, object]]:
    """group and rows (an Arrow table) of each run of rows of one group."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        group = batch.column("group").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for a, b in zip(edges, edges[1:]):
            if b == a:
                continue
            if held and group[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held, last = [*held, batch.slice(a, b - a)], int(group[a])
    if held:
        yield last, pa.Table.from_batches(held)


def _frequent(pieces: DataFrame, least: int, buckets: int, width: int) -> DataFrame:
    """group and the hashes (their highest ``width`` bytes) of its words and pairs that come ``least`` times or more:
    all such, and hardly others. A group asks once for each, with its weight in the group."""
    weight = np.min_scalar_type(least).newbyteorder("<")

    def ask(batches):
        import pyarrow as pa

        for group, part in _groups(batches):
            hashes, weights = [], []
            for lang, words, ids, w in _by_lang(part.column("lang").to_pylist(), part.column("piece").to_pylist(), part.column("w").to_numpy()):
                own, at, pairs = _hashes(lang, words, ids)
                here = ids >= 0
                hashes += [own, pairs]
                weights += [_total(ids[here], w[here], len(words)), w[at]]
            h, w = _summed(np.concatenate(hashes), np.concatenate(weights))
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # in order, as h is
            names, starts = np.unique(bucket, return_index=True)
            ends = [*starts[1:].tolist(), len(h)]
            w = np.minimum(w, least).astype(weight)
            blobs = [(_cut(h[i:j], width), w[i:j].tobytes()) for i, j in zip(starts.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.repeat(pa.scalar(group, pa.int64()), len(names)), pa.array([x for x, _ in blobs], pa.binary()), pa.array([x for _, x in blobs], pa.binary())], names=["bucket", "group", "h", "w"])

    def answer(batches):
        import pyarrow as pa

        with _duck() as con:
            con.execute("CREATE TABLE asked (grp BIGINT, h UBIGINT, w BIGINT)")
            for batch in batches:
                hashes = [_whole(h, width) for h in batch.column("h").to_pylist()]
                group = np.repeat(batch.column("group").to_numpy(), [len(h) for h in hashes])
                w = np.frombuffer(b"".join(batch.column("w").to_pylist()), weight)
                _insert(con, "asked", pa.table({"grp": group, "h": np.concatenate(hashes), "w": w}))
            found = con.sql(f"SELECT grp, h FROM asked WHERE h IN (SELECT h FROM asked GROUP BY h HAVING sum(w) >= {int(least)})")
            for batch in found.to_arrow_reader(200_000):
                group, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                order = np.argsort(group, kind="stable")
                group, h = group[order], h[order]
                edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
                yield pa.RecordBatch.from_arrays([pa.array(group[edges[:-1]]), pa.array([h[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], names=["group", "h"])

    asked = pieces.mapInArrow(ask, "bucket int, group long, h binary, w binary").repartition(buckets, "bucket")
    return asked.mapInArrow(answer, "group long, h binary")


def _among(h: np.ndarray, known: np.ndarray, width: int) -> np.ndarray:
    """Whether the highest bytes of each hash are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(h), bool)
    high = h >> np.uint64(64 - 8 * width)
    return known[np.minimum(np.searchsorted(known, high), len(known) - 1)] == high


def _ngrams(pieces: DataFrame, frequent: DataFrame, longest: int, width: int) -> DataFrame:
    """lang, phrase, k (words) and f of every group: its frequent words, and n-grams of frequent pairs alone."""

    def spell(part, answers):
        import pyarrow as pa

        rows = {"lang": [], "phrase": [], "k": [], "f": []}
        known = np.unique(np.frombuffer(b"".join(answers.column("h").to_pylist()), "<u8"))

        def put(lang, phrases, k, f):
            rows["lang"] += [lang] * len(phrases)
            rows["phrase"] += phrases
            rows["k"] += [k] * len(phrases)
            rows["f"] += f.tolist()

        if part.num_rows:
            for lang, words, ids, w in _by_lang(part.column("lang").to_pylist(), part.column("piece").to_pylist(), part.column("w").to_numpy()):
                own, at, pairs = _hashes(lang, words, ids)
                here = np.flatnonzero(ids >= 0)
                some = np.flatnonzero(_among(own, known, width))
                put(lang, [words[i] for i in some.tolist()], 1, _total(ids[here], w[here], len(words))[some])
                at = at[_among(pairs, known, width)]
                linked = np.zeros(len(ids) + longest, bool)
                linked[at] = True
                keys = ids.copy()  # exact numbers of the n-gram that starts at each place
                for k in range(2, longest + 1):
                    at = at[linked[at + k - 2]] if k > 2 else at
                    if not len(at):
                        break
                    found, number = np.unique(keys[at] * (len(words) + 1) + ids[at + k - 1], return_inverse=True)
                    keys[at] = number
                    first = np.zeros(len(found), np.int64)
                    first[number] = at
                    total = _total(number, w[at], len(found))
                    put(lang, [b" ".join([words[i] for i in ids[j : j + k]]) for j in first.tolist()], k, total)
        return pa.table(rows, schema=pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("k", pa.int32()), ("f", pa.int64())]))

    return pieces.groupBy("group").cogroup(frequent.groupBy("group")).applyInArrow(spell, "lang string, phrase binary, k int, f long")


def _counted(ngrams: DataFrame, least: int, buckets: int) -> DataFrame:
    """The n-grams that come ``least`` times or more, counted by duckdb, a hash bucket a task."""

    def count(batches):
        import pyarrow as pa

        kind = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("k", pa.int32()), ("f", pa.int64())])
        with _duck() as con:
            con.register("arrived", pa.RecordBatchReader.from_batches(kind, batches))  # read once, as it comes
            found = con.sql(f"SELECT lang, phrase, any_value(k) AS k, sum(f)::BIGINT AS f FROM arrived GROUP BY lang, phrase HAVING sum(f) >= {int(least)}")
            yield from found.to_arrow_reader(50_000)

    dealt = ngrams.repartition(buckets, "lang", "phrase")
    return dealt.mapInArrow(count, "lang string, phrase binary, k int, f long").withColumn("phrase", F.col("phrase").cast("string"))


def _key(lang: Column, phrase: Column) -> Column:
    return F.concat(lang, F.lit("\n"), phrase)  # no phrase holds it


def _cut_scores(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """phrases with l, r and score of their lowest cut. A part is asked for by as many phrases as hold it."""
    known = counts.select(_key(F.col("lang"), F.col("phrase")).alias("part"), "f")
    rows = known.limit(20_001).count()
    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "k", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    part = lambda first, size: _key(F.col("lang"), F.array_join(F.slice("words", first, size), " "))
    asked = cuts.select("lang", "phrase", "k", "a", "cut", part(F.lit(1), F.col("cut")).alias("part"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    left = lookup(asked, known, "part", F.col("phrase"), rows=rows).withColumnRenamed("f", "l").drop("part").withColumnRenamed("rest", "part")
    both = lookup(left, known, "part", F.col("phrase"), rows=rows).withColumnRenamed("f", "r").drop("part")
    score = F.expr("cast(a as decimal(20,0)) * 2000000BD div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = both.withColumn("score", score.cast("long")).groupBy("lang", "phrase").agg(F.first("k").alias("k"), F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return lowest.select("lang", "phrase", "k", "a", "low.l", "low.r", "low.score")


def _inside_longer(phrases: DataFrame, share: int) -> DataFrame:
    """lang and phrase of those that lie in a longer one of ``share`` hundredths of their count or more."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice(words, at, size), " "))))
    inner = phrases.where("k > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("f"))
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    return most.join(phrases, ["lang", "phrase"]).where(F.expr(f"cast(f as decimal(20,0)) * 100BD >= cast(a as decimal(20,0)) * {int(share)}BD")).select("lang", "phrase")


def mine(docs: DataFrame, least: int = 30, longest: int = 4, share: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language."""
    spark = docs.sparkSession
    with scope(spark) as keep:
        long_rows(spark)
        pieces = written(_pieces(docs), "pieces")
        totals = pieces.groupBy("lang").agg(F.sum(F.col("w") * F.size(F.split(F.col("piece").cast("string"), " "))).alias("n"))
        totals = keep(written(totals, "totals"))
        n = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        buckets = max(spark.sparkContext.defaultParallelism, n // BUCKET_WORDS)
        # So many bytes of a hash that few differ among so many words and pairs.
        width = int(np.clip(-(-(np.log2(max(n, 1)) + 12) // 8), 5, 8))
        frequent = _frequent(pieces, least, buckets, width)
        counts = written(_counted(_ngrams(pieces, frequent, longest, width), least, buckets), "ngrams")
        phrases = counts.where("k > 1").withColumnRenamed("f", "a")
        judged = written(_cut_scores(phrases, counts), "phrases")
        left = judged.join(_inside_longer(phrases, share), ["lang", "phrase"], "left_anti")
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        # The first of each language are among the first of its shares.
        some = left.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "_share")
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        best = keep(written(best.join(totals, "lang"), "best"))
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') for i in range(1, len(ws) - k + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.k, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM u
  JOIN f AS x ON x.lang = u.lang AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN f AS y ON y.lang = u.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, unnest(flatten([[array_to_string(ws[j:j + z - 1], ' ') for j in range(1, k - z + 2)] for z in range(2, k)])) AS phrase FROM c WHERE k > 2),
m AS (SELECT lang, phrase, max(a) AS f FROM i GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN m USING (lang, phrase) WHERE m.f IS NULL OR 100::HUGEINT * m.f < 80::HUGEINT * a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) WHERE rank <= 2000
"""
