"""Language-model scores by online logistic context mixing.

A text is its lower-cased words and one end. Every token is coded bit by bit. First comes its symbol: a
frequent word (a share of 1 / HEAD of the training tokens or more) is one, any other word has the symbol of
its first byte. Symbols have a binary code, short for frequent ones. After a first byte, one more decision
tells whether training has the word (by the share of words that it has once). If so the word follows by its
count among the words of that first byte; if not the rest of it is spelled, with a closing byte; bytes have
a binary code too.

Bit predictors look at a place in the code together with a context: for symbols none, the last one and the
last two of the most frequent words, the word before, and the two words before; for bytes the last one to
four bytes of the word and the whole word so far. A context is hashed into a table of bit counts. Weights,
chosen by how often the longer contexts were seen, mix the predictors' log-odds, and a last table refines
the mix by what bits really followed. Learning is online and in text order: a batch is predicted, then the
weights take a step, then its bits are counted. Tasks learn side by side; their counts are added up and
their weights averaged by the bits behind them. A text's score is the sum of the logarithms of its bits'
probabilities.

What is gathered grows with the corpus: the table of words and counts is exact, and the tables of contexts
grow with the number of training tokens up to SYMBOL_BITS and BYTE_BITS, which bounds a worker's memory.
What follows the first byte depends on the word alone, so it is scored once for every distinct word. Words
that at least one token in LISTED is (so at most LISTED of them) reach the documents by broadcast, others
by a join.

Defined results: a null, empty or blank text is the end alone; equal rows get equal scores; without
training documents the counts are 0, so are N and V; null ids take the remainder of the empty text; an
empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import crc_mod, long_rows, scope, written

HEAD, LISTED, MARKERS = 1 << 16, 700_000, 32
#: Longer words are neither frequent nor listed, which bounds what is broadcast.
LONGEST = 200
LEAST_BITS = 12
#: Symbols learnt or scored at once, at most.
BATCH = 30_000
#: Symbols and words for one learning task, at least about so many if there are as many as cores.
TASK_SYMBOLS, TASK_WORDS = 20_000_000, 1_000_000
#: Tokens and their bytes that a counting task holds, about, before it passes their counts on.
KEPT_TOKENS, KEPT_BYTES = 4_000_000, 32_000_000
BLOCK = 1 << 16
#: Tasks that add up the parts of one block side by side.
MERGED = 16
CELLS, DEPTHS = 24, 16
PRIOR = np.float32(0.2)
#: A step of the weights, and the weight of what they were.
RATE, STIFF = 0.1, 20.0
END = b"\n"  # no word holds it
_STRETCH = np.float32(2**0.42)
_C1, _C2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def tokens(texts):
    """The lower-cased words of an Arrow array of binary texts, each text closed by the empty word, as one Arrow
    array; and how many every text has."""
    import pyarrow as pa

    texts = [t or b"" for t in texts.to_pylist()]
    data = np.frombuffer(b"".join([t + b"\n\n" for t in texts]).lower(), np.uint8)  # ASCII letters
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 2) - 1
    inside = (data != 32) & (data - np.uint8(9) > 4)  # of words: between the six ASCII separators
    edge = inside.copy()
    edge[1:] ^= inside[:-1]
    first, stop = edge & inside, edge & ~inside
    first[ends] = stop[ends] = True  # a text's last word stops before that
    first, stop = np.flatnonzero(first), np.flatnonzero(stop)
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(stop - first, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words, np.diff(np.searchsorted(first, ends), prepend=-1)


def _binary(words) -> tuple:
    """Words as an Arrow array, where each starts, and their bytes."""
    import pyarrow as pa

    words = pa.array(words, pa.binary()) if isinstance(words, list) else words.cast(pa.binary())
    if not len(words):
        return words, np.zeros(1, np.int32), np.zeros(0, np.uint8)
    _, offsets, data = words.buffers()
    starts = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    return words, starts, np.frombuffer(data or b"", np.uint8)


class Code:
    """A binary code for symbols by their counts: the place and bit at every step, and log-odds without context."""

    def __init__(self, counts: np.ndarray):
        counts = np.maximum(np.asarray(counts, float), 0.5)
        n = len(counts)
        heap = [(c, i) for i, c in enumerate(counts.tolist())]
        heapq.heapify(heap)
        above, total = np.zeros((2 * n - 1, 2), np.int64), np.zeros((n, 2))
        for node in range(n - 1):
            for bit in (0, 1):
                c, child = heapq.heappop(heap)
                above[child] = node, bit
                total[node, bit] = c
            heapq.heappush(heap, (total[node].sum(), n + node))
        paths = []
        for s in range(n):
            path, at = [], s
            while at < 2 * n - 2:
                node, bit = above[at].tolist()
                path.append(2 * node + bit)
                at = n + node
            paths.append(path[::-1])
        self.size = np.array([len(p) for p in paths], np.int64)
        self.depth = int(self.size.max()) if n > 1 else 0
        self.turn = (np.minimum(self.depth, 255) - np.minimum(self.size, 255)).astype(np.uint8)  # long codes first
        self.steps = np.zeros((self.depth, n), np.uint32)  # 2 x place + bit
        for s, path in enumerate(paths):
            self.steps[: len(path), s] = path
        self.odds = np.log((total[: n - 1, 1] + 1e-9) / (total[: n - 1, 0] + 1e-9)).astype(np.float32)


def _seen(n: np.ndarray, most: int) -> np.ndarray:
    """0, 1, 2-4, 5-10, 11-22, ... as 0, 1, 2, 3, 4, ..., at most ``most``: log2(n + 1) + 0.42, whole, by the exponent."""
    n = n * _STRETCH
    n += _STRETCH
    steps = n.view(np.uint32)
    steps >>= np.uint32(23)
    steps -= np.uint32(127)
    return np.minimum(steps, np.uint32(most), out=steps)


class Mixer:
    """Bit predictors over hashed contexts, their gated weights and the refining table, for one code.

    ``bits`` says for each table log2 of its places, ``gates`` how many steps of its counts choose the
    weights (1: none).
    """

    def __init__(self, code: Code, bits: list[int], gates: list[int]):
        self.code, self.bits, self.gates = code, bits, gates
        self.k, self.n_gates = len(gates) + 1, int(np.prod(gates))
        self.weights = np.full((self.k, self.n_gates), 0.3, np.float32)
        self.weights[0] = 0.6
        self.refine = np.zeros(2 * CELLS * DEPTHS)
        self.tables: list[np.ndarray] = []

    def start(self) -> None:
        """Empty tables to learn with, and the sums that make weights in the end."""
        self.tables = [np.zeros(2 << b, np.float32) for b in self.bits]
        self.mass = np.zeros(self.n_gates)

    @staticmethod
    def _slots(contexts: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
        return Mixer._spread(contexts, place * _C1, bits)

    @staticmethod
    def _spread(contexts: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
        at = contexts + place
        at *= _C2
        at >>= np.uint32(32 - bits)
        return at.astype(np.int64)

    def _order(self, symbols: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Places of the symbols, long codes first, and how many have a bit at each level."""
        sizes = np.bincount(self.code.size[symbols], minlength=self.code.depth + 1)
        active = len(symbols) - np.cumsum(sizes)[: self.code.depth]
        return np.argsort(self.code.turn[symbols], kind="stable"), active[active > 0].tolist()

    def _mixed(self, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = self.weights[0].take(gate)
        z *= odds[0]
        for w, o in zip(self.weights[1:], odds[1:], strict=True):
            part = w.take(gate)
            part *= o
            z += part
        return np.clip(z, np.float32(-11), np.float32(11), out=z)

    @staticmethod
    def _squashed(z: np.ndarray) -> np.ndarray:
        p = np.negative(z)
        np.exp(p, out=p)
        p += np.float32(1)
        return np.divide(np.float32(1), p, out=p)

    @staticmethod
    def _cells(z: np.ndarray, level: int) -> np.ndarray:
        step = z * np.float32(CELLS / 16)
        step += np.float32(CELLS / 2)
        np.clip(step, np.float32(0), np.float32(CELLS - 1), out=step)
        return step.astype(np.int64) + min(level, DEPTHS - 1) * CELLS

    def learn(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> None:
        """Predicts a batch from what was learnt before it, lets the weights take a step, then counts its bits."""
        order, active = self._order(symbols)
        symbols, contexts = symbols[order], [c[order] for c in contexts]
        slope, bend, mass = np.zeros((self.k, self.n_gates)), np.zeros((self.k, self.n_gates)), np.zeros(self.n_gates)
        later = []
        for level, n in enumerate(active):
            step = self.code.steps[level].take(symbols[:n])
            bit, place = step & np.uint32(1), step >> np.uint32(1)
            odds, gate = [self.code.odds.take(place.astype(np.int64))], np.zeros(n, np.uint32)
            place *= _C1
            places = [self._spread(context[:n], place, bits) for context, bits in zip(contexts, self.bits, strict=True)]
            bit = bit.astype(np.int64)
            for table, at, most in zip(self.tables, places, self.gates, strict=True):
                both = table.view(np.complex64).take(at)
                ratio = both.imag + PRIOR
                ratio /= both.real + PRIOR
                odds.append(np.log(ratio, out=ratio))
                if most > 1:
                    gate *= np.uint32(most)
                    gate += _seen(both.real + both.imag, most - 1)
                at *= 2
                at += bit
            later.append(places)
            gate = gate.astype(np.int64)
            z = self._mixed(odds, gate)
            p = self._squashed(z)
            wrong, sure = bit.astype(np.float32) - p, np.maximum(p * (1 - p), np.float32(0.01))
            cell = self._cells(z, level)
            cell *= 2
            cell += bit
            self.refine += np.bincount(cell, minlength=len(self.refine))
            mass += np.bincount(gate, minlength=self.n_gates)
            for k, o in enumerate(odds):
                slope[k] += np.bincount(gate, wrong * o, self.n_gates)
                bent = sure * o
                bent *= o
                bend[k] += np.bincount(gate, bent, self.n_gates)
        self.weights += (RATE * slope / (bend + STIFF)).astype(np.float32)
        self.mass += mass
        for table, places in zip(self.tables, zip(*later, strict=True), strict=True):  # one table after the other, for the cache
            for at in places:
                np.add.at(table, at, np.float32(1))

    def sums(self) -> np.ndarray:
        """What tasks add up besides the tables."""
        return np.concatenate([self.mass, (self.weights * self.mass).ravel(), self.refine])

    def settle(self, tables: np.ndarray, sums: np.ndarray) -> None:
        """The model of all tasks, ready to score: log-odds by place, their last three bits the steps of the count."""
        mass, weights, refine = np.split(sums, [self.n_gates, self.n_gates * (1 + self.k)])
        seen = mass > 0
        self.weights[:, seen] = (weights.reshape(self.k, -1)[:, seen] / mass[seen]).astype(np.float32)
        self.tables = []
        for both, most in zip(np.split(tables, np.cumsum([2 << b for b in self.bits])[:-1]), self.gates, strict=True):
            both = both.reshape(-1, 2)
            odds = np.log((both[:, 1] + PRIOR) / (both[:, 0] + PRIOR)).astype(np.float32)
            steps = _seen(both.sum(axis=1, dtype=np.float32), max(most - 1, 0))
            self.tables.append(((odds.view(np.uint32) & np.uint32(0xFFFFFFF8)) | steps).view(np.float32))
        middle = 1 / (1 + np.exp(-((np.arange(CELLS) + 0.5) * 16 / CELLS - 8)))
        n = refine.reshape(DEPTHS, CELLS, 2) + 4 * np.stack([1 - middle, middle], axis=1)
        self.last = (n[..., 1] / n.sum(axis=2)).astype(np.float32).ravel()

    def log2p(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """log2 of the probability of every symbol in its contexts."""
        out = np.zeros(len(symbols))
        for first in range(0, len(symbols), BATCH):
            part = slice(first, first + BATCH)
            order, active = self._order(symbols[part])
            some, got = symbols[part][order], np.zeros(len(order), np.float32)
            near = [c[part][order] for c in contexts]
            for level, n in enumerate(active):
                step = self.code.steps[level].take(some[:n])
                place = step >> np.uint32(1)
                odds, gate = [self.code.odds.take(place.astype(np.int64))], np.zeros(n, np.uint32)
                place *= _C1
                for table, context, bits, most in zip(self.tables, near, self.bits, self.gates, strict=True):
                    found = table.take(self._spread(context[:n], place, bits))
                    odds.append(found)
                    if most > 1:
                        gate *= np.uint32(most)
                        gate += found.view(np.uint32) & np.uint32(7)
                z = self._mixed(odds, gate.astype(np.int64))
                p = self._squashed(z)
                p += self.last.take(self._cells(z, level))
                p *= np.float32(0.5)
                p -= (np.uint32(1) - (step & np.uint32(1))).astype(np.float32)
                np.abs(p, out=p)
                got[:n] += np.log2(p, out=p)
            out[first + order] = got
        return out


def _hash(*parts: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """A hash of the parts, which goes on from that of the parts before them."""
    h = np.full(len(parts[0]), 0x2545F491, np.uint32) if after is None else after
    for p in parts:
        h = h ^ p.astype(np.uint32)
        h *= _C2
        h ^= h >> np.uint32(15)
        h *= _C1
        h ^= h >> np.uint32(13)
    return h


class Symbols:
    """Frequent words (from most to least frequent, the end among them) and the 256 first bytes of others."""

    def __init__(self, heads: list[bytes]):
        import pyarrow as pa

        self.heads = pa.array(heads, pa.binary())
        self.n_heads, self.end = len(heads), heads.index(b"")

    def of(self, words) -> np.ndarray:
        """Symbols of a list or an Arrow array of words, the end among them."""
        import pyarrow.compute as pc

        words, starts, data = _binary(words)
        found = pc.fill_null(pc.index_in(words, value_set=self.heads), -1).to_numpy().astype(np.int64)
        rest = np.flatnonzero(found < 0)
        found[rest] = data[starts[rest]].astype(np.int64) + self.n_heads
        return found

    def contexts(self, symbols: np.ndarray) -> list[np.ndarray]:
        """For every token of whole texts (each closed by an end): the last and the last two of the most frequent
        words, the word before, the two words before."""
        n, end = len(symbols), self.end
        one = np.concatenate([[end], symbols])[:n]
        two = np.where(one == end, end, np.concatenate([[end, end], symbols])[:n])
        mark = (symbols < MARKERS) | (symbols == end)
        last = np.maximum.accumulate(np.concatenate([[-1], np.where(mark, np.arange(n), -1)]))  # before token i
        padded = np.concatenate([symbols, [end]])
        near = last[:n]
        far = np.where(near >= 0, last[near], -1)
        a = padded[near]
        b = np.where(a == end, end, padded[far])
        mark, word = _hash(a), _hash(one)
        return [mark, _hash(b, after=mark), word, _hash(two, after=word)]


def spelled(words) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The bytes after the first of every word (a list or an Arrow array), with a closing one: word, byte and contexts."""
    words, upto, letters = _binary(words)
    sizes = np.diff(upto).astype(np.int64) + 1
    starts = np.cumsum(sizes) - sizes
    data = np.full(int(sizes.sum()), END[0], np.uint8)
    inner = np.ones(len(data), bool)
    inner[starts + sizes - 1] = False
    data[inner] = letters[upto[0] : upto[-1]]
    which = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(data)) - starts[which]
    contexts, wide = [], data.astype(np.uint32)
    for k in range(1, 5):
        shifted = np.concatenate([np.zeros(k, np.uint32), wide[:-k]])[: len(wide)]
        contexts.append(_hash(np.where(place < k, np.uint32(256), shifted), after=contexts[-1] if contexts else None))
    each = _hash(wide, place).astype(np.uint64)
    upto = np.cumsum(each) - each
    contexts.append(_hash((upto - upto[starts][which]) & np.uint64(0xFFFFFFFF), place))
    rest = np.flatnonzero(place > 0)
    return which[rest], data[rest].astype(np.int64), [c[rest] for c in contexts]


#: Steps of the counts of each table that choose the weights (at most 8 each).
SYMBOL_GATES, BYTE_GATES = [1, 4, 6, 5], [1, 1, 4, 5, 7]
#: log2 of the places that each table may have at most.
SYMBOL_BITS, BYTE_BITS = [20, 21, 21, 21], [17, 20, 21, 22, 22]


def _bits(events: float, most: list[int]) -> list[int]:
    """log2 of the places of each table for so many training events."""
    return [int(np.clip(np.ceil(np.log2(max(events, 1))) + 1, LEAST_BITS, b)) for b in most]


def _words(docs: DataFrame, mod: int, held: int) -> DataFrame:
    """word, t (training tokens) and a (all tokens)."""

    def run(batches):
        import pyarrow as pa

        from skein.llm.tokens import slices

        def out():
            coded = pa.concat_arrays([words for words, _ in kept]).dictionary_encode()
            word, train, n = coded.indices.to_numpy(), np.concatenate([t for _, t in kept]), len(coded.dictionary)
            counts = [pa.array(np.bincount(found, minlength=n)) for found in (word[train], word)]
            return pa.RecordBatch.from_arrays([coded.dictionary, *counts], names=["word", "t", "a"])

        kept, n_tokens, n_bytes = [], 0, 0
        for part in slices(batches):
            words, sizes = tokens(part.column("text"))
            kept.append((words, np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), sizes)))
            n_tokens, n_bytes = n_tokens + len(words), n_bytes + words.nbytes
            if n_tokens > KEPT_TOKENS or n_bytes > KEPT_BYTES:
                yield out()
                kept, n_tokens, n_bytes = [], 0, 0
        if kept:
            yield out()

    counted = _rows(docs, mod, held).mapInArrow(run, "word binary, t long, a long")
    return counted.groupBy("word").agg(F.sum("t").alias("t"), F.sum("a").alias("a"))


def _rows(docs: DataFrame, mod: int, held: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), mod) == held).alias("held_out"), F.col("text").cast("binary").alias("text"))


def _summed(parts: DataFrame, mixer: Mixer) -> None:
    """Adds up what tasks learnt (block, used, n; block -1 the sums) and settles the mixer."""

    def add(batches):
        """Running sums of the parts of each block, one part at a time."""
        import pyarrow as pa

        def out(last, n):
            used = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([zlib.compress(used.astype("<u4").tobytes(), 1)]), pa.array([zlib.compress(n[used].astype("<f8").tobytes(), 1)])], names=["block", "used", "n"])

        last, n = None, np.zeros(0)
        for batch in batches:
            for block, used, part in zip(*(batch.column(c).to_pylist() for c in ("block", "used", "n")), strict=True):
                if block != last:
                    if last is not None:
                        yield out(last, n)
                    last, n = block, np.zeros(BLOCK)
                at = np.frombuffer(zlib.decompress(used), "<u4")
                if at[-1] >= len(n):
                    n = np.pad(n, (0, int(at[-1]) + 1 - len(n)))
                n[at] += np.frombuffer(zlib.decompress(part), "<f8")
        if last is not None:
            yield out(last, n)

    def summed(rows: DataFrame, *keys: str) -> DataFrame:
        tasks = rows.sparkSession.sparkContext.defaultParallelism
        return rows.repartition(tasks, *keys).sortWithinPartitions(*keys).select("block", "used", "n").mapInArrow(add, _PARTS)

    size = sum(2 << b for b in mixer.bits)
    tables, sums = np.zeros(-(-size // BLOCK) * BLOCK, np.float32), np.zeros(mixer.n_gates * (1 + mixer.k) + 2 * CELLS * DEPTHS)
    # First the parts of some tasks each, then what came of those; a block's parts are added up by several tasks.
    some = parts.withColumn("some", F.spark_partition_id() % MERGED)
    for r in summed(summed(some, "block", "some"), "block").toLocalIterator():  # as many as the tables have blocks
        used, found = np.frombuffer(zlib.decompress(r["used"]), "<u4"), np.frombuffer(zlib.decompress(r["n"]), "<f8")
        if r["block"] < 0:
            sums[used] = found
        else:
            tables[r["block"] * BLOCK + used.astype(np.int64)] = found
    mixer.settle(tables[:size], sums)


def _emitted(mixer: Mixer):
    """What a task has learnt, as record batches for ``_summed``."""
    import pyarrow as pa

    flat = np.concatenate(mixer.tables)
    parts = [(-1, mixer.sums())] + [(b // BLOCK, flat[b : b + BLOCK]) for b in range(0, len(flat), BLOCK)]
    for block, part in parts:
        if (used := np.flatnonzero(part)).size:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(used.astype("<u4").tobytes(), 1)]), pa.array([zlib.compress(part[used].astype("<f8").tobytes(), 1)])], names=["block", "used", "n"])


_PARTS = "block int, used binary, n binary"


def _tasks(df: DataFrame, least: int) -> DataFrame:
    """Every task has tables of its own, so there are no more than run at once, or ``least``."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, least))


def _train_bytes(vocab: DataFrame, n_words: int) -> Mixer:
    """Learns to spell from every training word once: what is spelled is new."""
    rows = vocab.where("t > 0 and length(word) > 0").select("word")
    mixer = Mixer(Code(_byte_counts(rows)), _bits(16.0 * n_words, BYTE_BITS), BYTE_GATES)

    def run(batches):
        mixer.start()
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                mixer.learn(*spelled(batch.column("word").slice(at, 4000))[1:])
        yield from _emitted(mixer)

    _summed(_tasks(rows, n_words // TASK_WORDS).sortWithinPartitions(F.xxhash64("word"), "word").mapInArrow(run, _PARTS), mixer)
    return mixer


def _train_symbols(rows: DataFrame, symbols: Symbols, counts: np.ndarray, n_tokens: int) -> Mixer:
    mixer = Mixer(Code(counts), _bits(n_tokens, SYMBOL_BITS), SYMBOL_GATES)

    def run(batches):
        from skein.llm.tokens import slices

        mixer.start()
        done = 0
        for part in slices(batches, 1_000_000):
            found = symbols.of(tokens(part.column("text"))[0])
            contexts, at = symbols.contexts(found), 0
            while at < len(found):
                size = min(BATCH, 1000 + done // 20)  # many small steps first
                mixer.learn(found[at : at + size], [c[at : at + size] for c in contexts])
                at, done = at + size, done + size
        yield from _emitted(mixer)

    _summed(_tasks(rows.where("not held_out"), n_tokens // TASK_SYMBOLS).mapInArrow(run, _PARTS), mixer)
    return mixer


def _byte_counts(words: DataFrame) -> np.ndarray:
    """How often the words have each byte, and how many there are."""

    def run(batches):
        import pyarrow as pa

        n = np.zeros(256)
        for batch in batches:
            n += np.bincount(np.frombuffer(END.join([*batch.column("word").to_pylist(), b""]), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n)], names=["byte", "n"])

    out = np.zeros(256)
    for r in words.mapInArrow(run, "byte long, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def scored(docs: DataFrame, mod: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, total_bits and bits_per_byte (null for an
    empty text) of every document."""
    with scope(docs.sparkSession) as keep:
        n, judged, scores = _scored(docs, mod, held)
        keep(judged), keep(scores)
    # Words of the tail are too rare to be hot, and there is one row a word on the smaller side.
    tail = scores.select("row", F.explode("tail").alias("e")).select("row", "e.*").join(judged.where("not listed").hint("shuffle_hash"), "word")
    tail = tail.select("row", F.when(F.col("known"), F.col("times")).otherwise(0).cast("long").alias("n_known"), (F.col("base") * F.col("times")).alias("base_score"), (F.col("s") * F.col("times")).alias("score"))
    parts = scores.drop("tail").unionByName(tail, allowMissingColumns=True)
    summed = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.max("n_bytes").alias("n_bytes"), *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
    total_bits = -F.col("score") * float(np.log2(10))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", total_bits.alias("total_bits"), F.when(F.col("n_bytes") > 0, total_bits / F.col("n_bytes")).alias("bits_per_byte"))


def _scored(docs: DataFrame, mod: int, held: int) -> tuple[int, DataFrame, DataFrame]:
    """Training tokens; every word's share of a score; every document's score but for its rare words (tail)."""
    sc = docs.sparkSession.sparkContext
    long_rows(docs.sparkSession)
    vocab = written(_words(docs, mod, held), "words")
    n, v, a = vocab.agg(F.coalesce(F.sum("t"), F.lit(0)), F.count_if(F.col("t") > 0), F.coalesce(F.sum("a"), F.lit(0))).first()
    is_head = (F.col("t") > 0) & (F.col("t") * HEAD >= n) & (F.length("word") <= LONGEST) | (F.length("word") == 0)
    heads = sorted(((-r["t"], bytes(r["word"])) for r in vocab.where(is_head).select("word", "t").collect()))  # at most HEAD + 1
    heads = heads or [(0, b"")]
    symbols = Symbols([w for _, w in heads])
    # A first byte is as likely as the tokens that start with it and aren't frequent; every frequent word was new once.
    first, tail, once = np.full(256, 0.5), np.zeros(256), np.zeros(256)
    rare = F.when(~is_head, F.col("t"))
    bytes_ = vocab.where("t > 0 and length(word) > 0").groupBy(F.conv(F.hex(F.substring("word", 1, 1)), 16, 10).cast("int").alias("b"))
    for r in bytes_.agg(F.sum(F.when(is_head, 1).otherwise(F.col("t"))).alias("n"), F.coalesce(F.sum(rare), F.lit(0)).alias("tail"), F.count_if(rare == 1).alias("once")).collect():
        first[r["b"]], tail[r["b"]], once[r["b"]] = r["n"] + 0.5, r["tail"], r["once"]
    new = np.where(tail > 0, (once + 1) / (tail + 2), 1)
    rows = _rows(docs, mod, held)
    speller = _train_bytes(vocab, v)
    mixer = _train_symbols(rows, symbols, np.concatenate([[-t for t, _ in heads], first]), n)
    shared_speller = sc.broadcast(speller)

    def judge(batches):
        import pyarrow as pa

        model = shared_speller.value
        for batch in batches:
            words, starts, _ = _binary(batch.column("word"))
            c, sizes, own = batch.column("t").to_numpy(), np.diff(starts), symbols.of(words)
            out = np.zeros(len(words))
            rare = np.flatnonzero(own >= symbols.n_heads)
            byte = own[rare] - symbols.n_heads
            seen = c[rare] > 0
            out[rare[seen]] = np.log10((1 - new[byte[seen]]) * c[rare[seen]] / tail[byte[seen]])
            out[rare[~seen]] = np.log10(new[byte[~seen]])
            for at in range(0, int((~seen).sum()), 4000):
                some = rare[~seen][at : at + 4000]
                which, rest, contexts = spelled(words.take(pa.array(some)))
                out[some] += np.bincount(which, model.log2p(rest, contexts), len(some)) * np.log10(2)
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(c > 0), pa.array(base), pa.array(out), pa.array((batch.column("a").to_numpy() * LISTED >= a) & (sizes <= LONGEST))], names=["word", "known", "base", "s", "listed"])

    judged = written(vocab.mapInArrow(judge, "word binary, known boolean, base double, s double, listed boolean"), "judged")
    shared_speller.destroy()
    listed = judged.where("listed").drop("listed").toArrow()  # at most LISTED rows
    words = listed.column("word").combine_chunks().cast("binary")
    table = np.stack([listed.column(c).to_numpy().astype(float) for c in ("known", "base", "s")], axis=1).reshape(-1, 3)
    shared = sc.broadcast((mixer, words, table, symbols.of(words)))

    def add(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from skein.llm.tokens import slices

        model, listed, known, listed_as = shared.value
        n_listed, tail = len(listed), pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
        known = np.vstack([known, np.zeros((1, 3))]).T.copy()
        for part in slices(batches, 2_000_000):
            (words, sizes), m = tokens(part.column("text")), part.num_rows
            text = np.repeat(np.arange(m), sizes)
            at = pc.fill_null(pc.index_in(words, value_set=listed), n_listed).to_numpy().astype(np.int64)
            rare = np.flatnonzero(at == n_listed)
            others = words.take(pa.array(rare)).dictionary_encode()
            place, others = others.indices.to_numpy(), others.dictionary
            own = np.concatenate([listed_as, [0]])[at]
            own[rare] = symbols.of(others)[place]
            sums = [np.bincount(text, column.take(at), m) for column in known]
            sums[2] += np.bincount(text, model.log2p(own, symbols.contexts(own)), m) * np.log10(2)
            lengths, size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64()), max(len(others), 1)
            keys, times = np.unique(text[rare] * size + place, return_counts=True)
            names = others.take(pa.array(keys % size))
            rests = pa.StructArray.from_arrays([names, pa.array(times, pa.int64())], names=["word", "times"])
            ends = np.searchsorted(keys // size, np.arange(m + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(sizes), lengths, pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rests).cast(tail)], names=["row", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base_score", "score", "tail"])

    scores = written(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(add, "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, score double, tail array<struct<word binary, times long>>"), "scores")
    shared.destroy()
    return n, judged, scores
