"""Each operator against a brute-force version on a small fixture with all the awkward cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import common, context_mixing, exact_dedup, license_scan, minhash, mixing, packing, quality_model, quality_rules, site_style, token_store
from skein.llm.tokens import UnitEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_mix_comes_near_its_targets(stored):
    found = rows(mixing.decided(stored))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in found) == Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in rows(stored))
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        assert 0 <= r["copies"] <= 3
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s, t in target.items():
        most = max(r["size"] for r in found if r["source"] == s)
        assert t <= 3 * sizes[s] + 1e-6 and abs(taken[s] - t) <= most / 2 + 1
    again = rows(mixing.decided(stored.repartition(5)))
    key = lambda rs: sorted((str(r["doc_id"]), r["copies"]) for r in rs)
    assert key(again) == key(found)


VOCABULARIES = (P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"))
#: Names that operators use inside; a frame may have columns of these names.
INSIDE = ["_mix", "_mixkey", "_mixjoin", "_plan", "_mixcopy", "_loc", "_loc_kept", "_gone", "_rules", "_metadata", "_row", "_file", "_number", "_c0", "_c1", "_size", "_copies", "_key", "loc", "digest", "norm", "col", "root", "key", "threshold"]


def test_stages_pass_columns_of_any_name(spark):
    """Every row that a stage returns is a row of its input, value by value."""
    texts = ["one text of five words and more words than that " * 9, "another text, quite unlike the first of them " * 9, None, "", "third " * 60]
    table = [(i % 7 if i % 5 else None, texts[i % len(texts)], f"s{i % 3}", *[f"{n}{i % 11}" for n in INSIDE]) for i in range(60)]
    docs = spark.createDataFrame(table, ["doc_id", "text", "source", *INSIDE])
    given = Counter(map(tuple, table))
    mixed = Counter(tuple(r) for r in mixing.mix(docs).collect())
    assert set(mixed) <= set(given) and mixed and all(mixed[r] <= 3 * given[r] for r in mixed)
    kept = Counter(tuple(r) for r in quality_rules.keep(docs, *VOCABULARIES, {"LATIN": (0, 0, 1, 0), "OTHER": (0, 0, 1, 0)}).collect())
    want = Counter(r for r in given.elements() if not quality_rules.base_measures((r[1] or "").encode(), (r[1] or "").encode().split(), np.unique((r[1] or "").split(), return_inverse=True)[1] if r[1] else np.zeros(0, np.int64))[-1])
    assert kept == want
    for stage in (exact_dedup.dedup, minhash.dedup):
        found = Counter(tuple(r) for r in stage(docs).collect())
        assert found <= given and stage(docs).columns == docs.columns
    assert exact_dedup.dedup(docs).count() == 4  # null and empty are one text


def exact_want(table):
    groups = defaultdict(list)
    for r in table:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    return {text: (min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)), members) for text, members in groups.items()}


@pytest.mark.parametrize("digest", [None, lambda text: (F.length(text) % 3).cast("string")])
def test_exact_dedup(stored, digest):
    found = rows(exact_dedup.groups(stored) if digest is None else exact_dedup.groups(stored, digest))
    groups = exact_want(rows(stored))
    assert len(found) == stored.count() and sum(r["kept"] for r in found) == len(groups)
    want = Counter()
    for text, (keep, members) in groups.items():
        for r in members:
            want[r["doc_id"], keep["doc_id"], len(members), hashlib.sha256(text.encode()).hexdigest() if digest is None else None] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"] if digest is None else None) for r in found) == want


def test_exact_dedup_keeps_one_row_of_each_text_of_any_frame(spark, docs, stored, tmp_path):
    docs.coalesce(1).write.partitionBy("source").parquet(f"file://{tmp_path}/parts")  # files of one name in several folders
    parts = spark.read.parquet(f"file://{tmp_path}/parts")
    two = spark.createDataFrame([(1, "a b"), (2, "ab "), (2, "c"), (None, "c"), (None, "d")], "doc_id long, text string")
    frames = [docs, stored, parts, stored.unionByName(stored), stored.groupBy("doc_id", "text").agg(F.max("lang").alias("lang")), stored.where("doc_id > 3").select("text", "doc_id"), stored.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2)))), two]
    for frame in frames:
        found, want = rows(exact_dedup.dedup(frame)), exact_want(rows(frame))
        assert Counter((r["doc_id"], r["text"]) for r in found) == Counter((keep["doc_id"], keep["text"]) for keep, _ in want.values())


def test_near_classes(stored):
    def bag(text):
        w = (text or "").encode().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None

    all_rows = rows(stored)
    bags = [bag(r["text"]) for r in all_rows]
    root = list(range(len(bags)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            if a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = Counter()
    for i, r in enumerate(all_rows):
        members = [all_rows[j]["doc_id"] for j in range(len(bags)) if find(j) == find(i)]
        want[r["doc_id"], min((m for m in members if m is not None), default=None), len(members)] += 1
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in rows(minhash.near_duplicates(stored))) == want
    assert minhash.dedup(stored).columns == stored.columns


def test_near_dedup_keeps_one_row_of_each_class(spark, tmp_path):
    words = lambda n: " ".join(f"w{n}x{k}" for k in range(40))
    copies = lambda n: (words(n), words(n) + " more")
    table = [
        (1, copies(0)[0], "a"), (2, copies(0)[1], "a"), (2, words(1), "b"),  # id 2 is a copy and a text of its own
        (3, copies(2)[0], "a"), (None, copies(2)[1], "a"), (None, words(3), "b"), (None, None, "a"),  # so is null
        (4, copies(4)[0], "a"), (4, copies(4)[1], "b"), (None, copies(5)[0], "a"), (None, copies(5)[1], "b"),  # copies share an id
        *[(6, words(6), "a")] * 3, (7, "", "a"), (7, " ", "b"), (1, words(7), "a"),
    ]
    bags = [Counter(tuple((t or "").split()[i : i + 5]) for i in range(len((t or "").split()) - 4)) for _, t, _ in table]
    near = lambda a, b: sum((a & b).values()) >= 0.8 * sum((a | b).values())
    classes = {frozenset(j for j, other in enumerate(bags) if j == i or bag and other and near(bag, other)) for i, bag in enumerate(bags)}
    assert {i for c in classes for i in c} == set(range(len(table))) and sum(map(len, classes)) == len(table)

    def least(ids):
        return min((i for i in ids if i is not None), default=None)

    frame = spark.createDataFrame(table, "doc_id long, text string, part string").coalesce(1)
    frame.write.partitionBy("part").parquet(f"file://{tmp_path}/parts")  # files of one name in two folders
    for docs in (frame, spark.read.parquet(f"file://{tmp_path}/parts")):
        found = Counter((r["doc_id"], r["text"]) for r in rows(minhash.dedup(docs)))
        left = [Counter({(table[i][0], table[i][1]): found[table[i][0], table[i][1]] for i in c}) for c in classes]
        assert found.total() == len(classes) and all(c.total() == 1 for c in left)
        for c, one in zip(classes, left, strict=True):
            assert next(k for k, n in one.items() if n)[0] == least(table[i][0] for i in c)


def test_signatures_do_not_depend_on_the_batch():
    texts = [f"{'a b c d ' * k} w{k} tail {k}".encode() for k in range(1, 40)]
    one = np.vstack([minhash.signatures(1, *minhash.shingles([t])) for t in texts])
    assert (one == minhash.signatures(len(texts), *minhash.shingles(texts))).all()


def test_packing(stored):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = rows(packing.pack(stored, P.path("byte_bpe_50k.json")))
    whole = Counter()
    for r in rows(stored):
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            whole[r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == whole
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= sum(r["length"] for r in found) / 1024 * 1.1 + 1


@pytest.mark.parametrize("most", [1, 3, 8])
def test_best_fit_closes_the_fullest(most):
    """The bitset against a list of open sequences, piece by piece; the bound binds."""
    rng, size = np.random.default_rng(most), 50
    fit, opened, closed, n = packing.BestFit(size, most), [], 0, 0  # opened: (free, sequence), the latest last
    for length in rng.integers(1, size + 1, 3000).tolist():
        fits = [x for x in opened if x[0] >= length]
        if fits:
            least = min(x[0] for x in fits)
            free, sequence = next(x for x in reversed(opened) if x[0] == least)
            opened.remove((free, sequence))
        else:
            free, sequence, n = size, n, n + 1
            if length < size and len(opened) >= most:
                fullest = min(x[0] for x in opened)
                opened.remove(next(x for x in reversed(opened) if x[0] == fullest))
                closed += 1
        if free > length:
            opened.append((free - length, sequence))
        assert fit.put(length) == (sequence, size - free)
        assert len(opened) == fit.n_open <= most
    assert closed > 10


def test_rows_keep_apart_when_tasks_read_several_partitions(stored):
    """Numbers that tell rows or sequences apart don't depend on how partitions are dealt to tasks."""
    many = stored.repartition(7)
    packed = rows(packing.pack(many, P.path("byte_bpe_50k.json"), size=64).coalesce(1))
    places = Counter((r["sequence_id"], r["offset"]) for r in packed)
    assert max(places.values()) == 1 and max(r["offset"] + r["length"] for r in packed) <= 64
    assert packing.pieces(many, P.path("byte_bpe_50k.json"), 2, 64).coalesce(1).select("_slot").distinct().count() == len(packed)
    assert context_mixing.scored(many.coalesce(1)).count() == context_mixing.scored(many).count() == stored.count()


def test_packing_is_online_and_bounded(spark):
    """The query's own bound binds, pieces keep the order of their documents, few sequences are wasted."""
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 600, 20_000)
    fit = packing.BestFit(1024, packing.OPEN)
    most = 0
    for length in lengths.tolist():
        fit.put(length)
        most = max(most, fit.n_open)
    assert most == packing.OPEN and fit.next <= 1.05 * lengths.sum() / 1024
    docs = spark.createDataFrame([(i, "word " * (i % 90)) for i in range(300)], "doc_id long, text string").coalesce(1)
    found = rows(packing.pack(docs, P.path("byte_bpe_50k.json"), size=64, open_sequences=2))
    fit = packing.BestFit(64, 2)
    want = [fit.put(r["length"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["piece"]))]
    assert [(r["sequence_id"] & ((1 << 40) - 1), r["offset"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["piece"]))] == want


def test_token_store(stored):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    found = rows(token_store.stored(stored, P.path("word_bpe_49k.json")))
    want = Counter()
    for r in rows(stored):
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is None, i or 0))


def test_token_store_splits_hot_ids(spark, monkeypatch):
    """An id, or none, of a third of all rows fills several ranges; the order of ids holds."""
    monkeypatch.setattr(token_store, "RANGE_BYTES", 400)
    table = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text number {i} " * (i % 5)) for i in range(300)] + [(8, "x " * 30_000)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    bounds, without = token_store._ranges(docs)
    assert (np.diff(bounds) == 0).sum() > 3 and without > 3
    path = common.scratch(spark, "hot")
    token_store.write(docs, P.path("word_bpe_49k.json"), 1, path)
    shards = spark.read.parquet(path)
    assert shards.groupBy("range").agg(F.sum(F.size("doc_ids")).alias("n")).agg(F.max("n")).first()[0] < 100
    found = sorted(rows(token_store.read(spark, path)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((i for i, _ in table), key=lambda i: (i is None, i or 0))
    code, at = UnitEncoder(P.path("word_bpe_49k.json")), 0
    want = Counter((i, zlib.crc32(np.append(np.frombuffer(code.text(t), code.dtype), 1).astype("<u4").tobytes())) for i, t in table)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in found) == want
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]


def test_directly_addressable_codes():
    rng = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 1 << 30), (5000, 300), (3000, 1 << 31), (1024, 256)):
        ids = rng.integers(0, top, n).astype("<u4")
        dac = token_store.Dac(token_store.dac_encode(ids))
        assert (dac.read() == ids).all() and all(dac[i] == ids[i] for i in range(0, n, 7))
        for a, b in ((0, n), (n // 3, n // 2), (n // 2, n)):
            assert (dac.read(a, b) == ids[a:b]).all()


def test_unit_ids_equal_whole_ids():
    odd = ["", " ", "\n", "a  b", "a.\nB, c", "x, . , .", " lead", "trail ", "nl\n", "tab\tb", "it's, don't.", "Ä, Über.", "1, 2.", "İstanbul, Σας. ", "x\n, y", "é x", "w&&& !!", " x y"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        code = UnitEncoder(P.path(name))
        for text in odd:
            assert code.text(text) == code.whole(text), text


def test_quality_rules(stored):
    table = rows(stored)
    got = rows(quality_rules.judged(stored, *VOCABULARIES))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter()
    for r in table:
        text = r["text"] or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))
        fertility, kept = fertility_want(words, r["lang"])
        want[r["doc_id"], *base, *fertility, kept and not base[-1]] += 1
    assert Counter((r["doc_id"], *(r[k] for k in names), *(f"{r[k]:.9f}" for k in ("chars_per_token", "chars_per_byte_token", "byte_share", "entropy")), r["band"], r["kept"]) for r in got) == want
    assert quality_rules.keep(stored, *VOCABULARIES).columns == stored.columns


def fertility_want(words, lang):
    """Measures and verdict on fertility, token by token."""
    import unicodedata

    vocab = quality_rules.Vocabularies(*VOCABULARIES)
    if not words:
        return ("0.000000000",) * 4 + ("",), False
    ids = [i for w in words for i in vocab.pieces.encode(w)]
    n_bpe, chars = sum(len(vocab.bpe.encode_ordinary(f" {w}")) for w in words), sum(map(len, words))
    counts = Counter(ids)
    bits = -sum(c / len(ids) * np.log2(c / len(ids)) for c in counts.values()) / np.log2(min(len(ids), quality_rules.FULL)) if len(ids) > 1 else 0.0
    found = (chars / len(ids), chars / n_bpe, sum(vocab.pieces.is_byte(i) for i in ids) / len(ids), bits + 0.0)
    firsts = [c for c in {w[0] for w in " ".join(words).split()} if c.isalpha()]
    latin = sum(unicodedata.name(c, "").startswith("LATIN") for c in firsts)
    band = lang if lang in quality_rules.BANDS else "LATIN" if 2 * latin >= len(firsts) else "OTHER"
    a, b, c, d = quality_rules.BANDS[band]
    return (*(f"{x:.9f}" for x in found), band), found[0] >= a and found[1] >= b and found[2] <= c and found[3] >= d


def test_quality_model(spark, stored):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    found = rows(quality_model.scored(stored, labels))
    assert len(found) == stored.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert {r["score"] for r in rows(quality_model.scored(stored, labels.limit(0)))} == {0.5}


def features_want(text):
    """The features one by one, over characters."""
    import math

    words = WORD.findall(text)
    if not words:
        return [0.0] * len(quality_model.FEATURES)
    n, chars, bag = len(words), sum(map(len, words)), Counter(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    covered = {i + k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    share = lambda signs: sum(c in signs for c in text) / chars
    counts = sorted(bag.values(), reverse=True)
    entropy = -sum(c / n * math.log2(c / n) for c in counts) / math.log2(max(2, min(n, 512)))
    odd = sum(1 for i, c in enumerate(text) if c.isascii() and not c.isalnum() and c not in "_ \t\n\x0b\x0c\r.,;:!?'\")" and (i + 1 == len(text) or text[i + 1] in " \t\n\x0b\x0c\r"))
    return [
        math.log(1 + n), chars / n, share("#*$%&<>{}[]~^_=+\\@"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("!?"), share("0123456789"), share("|"),
        1 - len(set(lines)) / len(lines), len(covered) / n, len(bag) / n, sum(len(w.encode()) <= 3 for w in words) / n, math.log(1 + chars / len(lines)), odd / n,
        counts[0] / n, n / (1 + sum(text.count(c) for c in ".!?")), entropy, sum(len(c.encode()) - 1 for c in text) / chars, sum(counts[:3]) / n,
    ]


def test_quality_features_by_hand(stored):
    for r in rows(stored):
        text = r["text"] or ""
        want = features_want(text)
        got = quality_model.features(text.encode())
        for name, a, b in zip(quality_model.FEATURES, got, want, strict=True):
            assert a == pytest.approx(b), (name, text[:40])


def test_quality_scores_by_hand(spark, stored):
    """A score is the sum of one entry of each table; the model rests on the labelled rows that aren't held out."""
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    table = {r["doc_id"]: r["text"] or "" for r in rows(stored) if r["doc_id"] is not None and r["doc_id"] < 40}
    train = [i for i in table if zlib.crc32(str(i).encode()) % 3 != 1]
    x = np.array([quality_model.features(table[i].encode()) for i in train])
    model = quality_model.fit(x, np.array([float(i % 3 > 0) for i in train]))
    for r in rows(quality_model.scored(stored, labels)):
        if r["doc_id"] in table and r["doc_id"] is not None:
            f = quality_model.features(table[r["doc_id"]].encode())
            total, bins = model.intercept, [sum(v >= e for e in edges) for v, edges in zip(f, model.edges, strict=True)]
            total += sum(t[b] for t, b in zip(model.tables, bins, strict=True))
            total += sum(t[bins[i] // model.coarse, bins[j] // model.coarse] for i, j, t in model.pairs)
            assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_quality_model_learns_pairs():
    rng = np.random.default_rng(2)
    x = rng.random((4000, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_context_mixing(stored):
    found = rows(context_mixing.scored(stored))
    key = lambda i: b"" if i is None else str(i).encode()
    train, texts = Counter(), rows(stored)
    for r in texts:
        if zlib.crc32(key(r["doc_id"])) % 5 != 1:
            train.update([*(r["text"] or "").encode().lower().split(), b""])
    n, v, want = sum(train.values()), len(train), Counter()
    for r in texts:
        words = [*(r["text"] or "").encode().lower().split(), b""]
        base = sum(np.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want[r["doc_id"], len(words), sum(w in train for w in words), f"{base:.6f}"] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], f"{r['base_score']:.6f}") for r in found) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in found)


def small_mixer(rng, n, bits, gates):
    """A mixer that has learnt something at random."""
    mixer = context_mixing.Mixer(context_mixing.Code(rng.integers(1, 90, n)), bits, gates)
    mixer.start()
    for _ in range(5):
        mixer.learn(rng.integers(0, n, 400), [rng.integers(0, 9, 400).astype(np.uint32) for _ in gates])
    mixer.settle(np.concatenate(mixer.tables), mixer.sums())
    return mixer


def test_context_mixing_gives_distributions():
    """In any context the probabilities of all symbols sum to 1, and so do those of one symbol's bits by hand."""
    mixer = small_mixer(np.random.default_rng(0), 37, [12, 13], [1, 5])
    for context in range(4):
        contexts = [np.full(37, context, np.uint32), np.full(37, context + 1, np.uint32)]
        assert (2 ** mixer.log2p(np.arange(37), contexts)).sum() == pytest.approx(1, abs=1e-4)
    code = context_mixing.Code([5])
    assert code.depth == 0 and context_mixing.Mixer(code, [12], [1]).n_gates == 1


def test_context_mixing_bits_by_hand():
    """A symbol's probability from the tables, weights and refinement, one bit after the other."""
    mixer = small_mixer(np.random.default_rng(1), 12, [12, 12], [3, 4])
    for symbol in range(12):
        contexts, bits = [np.array([7 * symbol], np.uint32), np.array([3], np.uint32)], 0.0
        for level in range(int(mixer.code.size[symbol])):
            place, bit = divmod(int(mixer.code.steps[level, symbol]), 2)
            found = [t[int(mixer._slots(c, np.array([place], np.uint32), 12)[0])] for t, c in zip(mixer.tables, contexts)]
            steps = [int(np.float32(x).view(np.uint32)) & 7 for x in found]
            w = mixer.weights[:, steps[0] * 4 + steps[1]]
            z = float(np.clip(w[0] * mixer.code.odds[place] + w[1] * found[0] + w[2] * found[1], -11, 11))
            cell = min(level, context_mixing.DEPTHS - 1) * context_mixing.CELLS + int(np.clip(z * context_mixing.CELLS / 16 + context_mixing.CELLS / 2, 0, context_mixing.CELLS - 1))
            p = (1 / (1 + np.exp(-z)) + mixer.last[cell]) / 2
            bits += np.log2(p if bit else 1 - p)
        assert mixer.log2p(np.array([symbol]), contexts)[0] == pytest.approx(bits, abs=1e-4)


def test_context_mixing_contexts_cross_words():
    """The two words before a word, and the last two frequent ones, choose its contexts; a text starts afresh."""
    symbols = context_mixing.Symbols([b"", *[f"f{i}".encode() for i in range(80)]])
    text = [b"f1", b"f70", b"f2", b"x", b"f71", b"y", b"", b"f1", b"f70", b""]
    own = symbols.of(text)
    last, marks, one, two = symbols.contexts(own)
    again = symbols.contexts(own[7:])
    assert [list(c[7:]) for c in (last, marks, one, two)] == [list(c) for c in again]
    assert one[1] == one[8] and two[1] == two[8] and marks[4] == marks[5] == marks[3] and marks[4] != marks[2] and two[2] != two[4]
    swapped = symbols.contexts(symbols.of([b"f70", b"f1", b"f2", b"x", b"f71", b"y", b""]))
    assert swapped[3][2] != two[2] and swapped[2][2] != one[2] and swapped[2][3] == one[3]


def test_context_mixing_splits_whole_batches():
    """Words and symbols of a batch are what a plain split and look-up give, in a fraction of their time."""
    import time

    import pyarrow as pa

    r = np.random.default_rng(3)
    signs = [*" \t\n\v\f\r", *"abAB", "\0", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", "É", "\u2003"]
    texts = [None, "", " ", "\n\n", "a", " a", "a ", "Ab\n", *["".join(r.choice(signs, 40)) for _ in range(300)], None]
    texts = [None if t is None else t.encode() for t in texts]
    plain = [[*(t or b"").lower().split(), b""] for t in texts]
    words, sizes = context_mixing.tokens(pa.array(texts, pa.binary()))
    assert words.to_pylist() == sum(plain, []) and list(sizes) == [len(p) for p in plain]
    symbols = context_mixing.Symbols([b"a", b"", b"ab"])
    own = {b"a": 0, b"": 1, b"ab": 2}
    assert list(symbols.of(words)) == [own[w] if w in own else 3 + w[0] for w in sum(plain, [])]
    assert list(symbols.of(words.slice(5, 90))) == list(symbols.of(words))[5:95] and len(symbols.of(words[:0])) == 0

    texts = [b" ".join(b"w%d" % i for i in r.zipf(1.3, 300) % 100_000) for _ in range(1000)]
    symbols, column = context_mixing.Symbols([b"", *[b"w%d" % i for i in range(3000)]]), pa.array(texts, pa.binary())
    heads = dict(zip(symbols.heads.to_pylist(), range(symbols.n_heads), strict=True))

    def plainly():
        return [heads[w] if w in heads else 3001 + w[0] for t in column.to_pylist() for w in (*t.lower().split(), b"")]

    def least(run):
        spent = []
        for _ in range(3):
            start = time.process_time()
            run()
            spent.append(time.process_time() - start)
        return min(spent)

    assert list(symbols.of(context_mixing.tokens(column)[0])) == plainly()
    assert least(lambda: symbols.of(context_mixing.tokens(column)[0])) < least(plainly)


def test_context_mixing_steps_of_counts():
    """The exponent gives the steps that the logarithm gives."""
    n = np.arange(1 << 17, dtype=np.float32)
    for most in range(8):
        assert (context_mixing._seen(n, most) == np.minimum(np.log2(n + 1) + np.float32(0.42), most).astype(int)).all()


def test_context_mixing_learns_word_order(spark):
    """Words that always follow each other are likelier than the same words in another order."""
    import random

    r = random.Random(4)
    table = []
    for i in range(400):
        words = []
        for _ in range(60):
            words += r.choice([["alpha", "beta", "gamma"], ["delta", "epsilon", "zeta"], ["eta", "theta", "iota"]])
        table.append((i, " ".join(words if i != 7 and i != 11 else r.sample(words, len(words)))))
    found = {r["doc_id"]: r for r in rows(context_mixing.scored(spark.createDataFrame(table, "doc_id long, text string")))}
    held = [r for i, r in found.items() if r["held_out"] and i not in (7, 11)]
    assert held and all(r["score"] > r["base_score"] for r in held)
    per = lambda r: r["score"] / r["n_tokens"]
    assert max(per(found[7]), per(found[11])) < min(map(per, held)) - 0.2


def license_cases():
    """Texts and the rules that match them; what follows are the same sentences in other clothes."""
    head = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    terms = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    cases = [
        (head, "apache-2.0-header"), ("Some text.\nReleased under the MIT License.", "mit-reference"), (None, ""), ("", ""), (" \n ", ""), ("a license", ""),
        ("All rights reserved. All rights reserved.", "all-rights-reserved"), ("All\nrights reserved.", "all-rights-reserved"), ("ALL   RIGHTS\tRESERVED", "all-rights-reserved"),
        ("This program is free\nsoftware.", ""), ("The tool foo is released under the MIT License.", "mit-reference"), ("Use it under Apache License 2.0.", "apache-2.0-reference"),
        (terms.format("", ";", 3), "gpl-3.0-notice"), (terms.format("", ",", 2), "gpl-2.0-joined-notice"), (terms.format("Lesser ", ";", "2.1"), "lgpl-2.1-notice"), (terms.format("Affero ", ";", 3).replace(" the ", "\nthe "), "agpl-3.0-notice"),
        ("// SPDX-License-Identifier: MIT", "mit-tag"), ("# SPDX-License-Identifier:GPL-3.0-or-later", "gpl-3.0-tag-line"), ("MIT", ""), ("x" * 70_000 + ". Under the ISC License. " + "y " * 30_000, "isc-reference"),
        ("This work is licensed under CC BY-SA 4.0, not under the GNU GPL v3", "gpl-3.0-reference"), ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd-2-text"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "isc-0-text"), ("This is free and unencumbered software released into the public domain.", "unlicense-notice"),
    ]
    return [(i, *case) for i, case in enumerate(cases)]


def test_license_scan(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in license_cases()], "doc_id long, text string, rules string")
    found = {r["doc_id"]: r["rules"] for r in rows(license_scan.scan(docs))}
    assert found == {i: w if "CC BY" not in (t or "") else found[i] for i, t, w in license_cases()}


def test_license_scan_equals_sql(spark):
    """Wherever known sentences and names are broken into lines or joined, Spark and SQL agree."""
    import random

    import duckdb

    r = random.Random(8)
    known = [*license_scan.KNOWN, *(f"this is under {name} for you" for name, _ in license_scan.REFERENCES), "nothing known", "under the sun"]
    texts = [t for _, t, _ in license_cases()]
    for s in known:
        words = s.split()
        texts.append("".join(w + r.choice([" ", " ", "  ", "\n", "-", ", "]) for w in words).strip() + r.choice(["", ".", ";\n", "!\n\n"]) + r.choice(["", " " + r.choice(known).upper() + "."]))
    table = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[1])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", table)
    names = ["doc_id", "n_sentences", "sentences", "rules", "licenses"]
    want = Counter(con.execute(f"SELECT {', '.join(names)} FROM ({license_scan.oracle()})").fetchall())
    found = Counter(tuple(x[n] for n in names) for x in rows(license_scan.scan(spark.createDataFrame(table, "doc_id long, text string"))))
    assert found == want and sum(n for (_, k, *_), n in found.items() if k) > 100


def test_license_anchors_cover_every_known_sentence():
    for s in [*license_scan.KNOWN, *(name for name, _ in license_scan.REFERENCES)]:
        assert set(s.split()) & set(license_scan.ANCHORS), s


PAGE = '<html><body><div class=ad>AD</div><header>H</header><div id="cookie-notice">C</div><main><article class=post><header><h1>T &amp; t</h1></header><p>One<br>two <b>three<p>four</p><ul><li>a<li>b</ul><div class="comments"><p>no</p></div><script>if(a<b){"</p>"}</script><p>f  ive'


def test_extraction(spark):
    assert site_style.main_text(PAGE) == "T & t\n\nOne two three\n\nfour\n\na\n\nb\n\nf ive"
    pages = [(i, f"https://h.example/{i}", f"<body><div class=x1>Read more here</div><div class=x2><p>Story {i} of its own</p><p>and more {i * i}</p></div></body>") for i in range(12)]
    pages += [(90, None, None), (91, "bad url", ""), (92, "https://one.example/", "<p>alone"), (93, "https://c.example/", "<div>copy</div>"), (94, "https://c.example/2", "<div>copy</div>")]
    found = {r["page_id"]: r["text"] for r in rows(site_style.extract(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, low int")))}
    assert found[3] == "Story 3 of its own\n\nand more 9" and found[90] == found[91] == "" and found[92] == "alone" and found[93] == found[94] == "copy"


def planted_site():
    """Pages of one host whose template has no telling names, beside copies, a short host and a host of copies."""
    pages, want = [], {}
    for i in range(30):
        own = [f"Story {i} begins here, part {i * 7 % 13}.", f"It goes on with {i * i} and {i + 5}.", "A sentence that two stories share." if i < 2 else f"Then it ends, {i}."]
        template = f"<div class=x1><div>Home</div><div>World</div></div><div class=x2>{''.join(f'<p>{t}</p>' for t in own[:2])}<p>Read our terms before you go on.</p><p>{own[2]}</p></div><div class=x3><p>Made by us</p></div>"
        pages.append((i, f"https://H.example:80/{i}", f"<body>{template}</body>"))
        want[i] = "\n\n".join(own)
    for i in range(30, 34):  # the first page again
        pages.append((i, f"http://u@h.example/{i}", pages[0][2]))
        want[i] = want[0]
    for i in range(40, 43):  # too few to tell
        pages.append((i, f"https://few.example/{i}", f"<div>Same</div><p>Text {i}</p>"))
        want[i] = f"Same\n\nText {i}"
    for i in range(50, 62):
        pages.append((i, "https://copies.example/x", "<div class=a><p>One.</p><p>Two.</p></div>"))
        want[i] = "One.\n\nTwo."
    return pages, want


def test_extraction_drops_templates_without_telling_names(spark):
    """Menus and lines that come back on most pages go by the tree alone; what few pages share stays."""
    pages, want = planted_site()
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in rows(site_style.extract(frame))} == want
    low = {r["host"]: r for r in rows(site_style.low_nodes(frame))}
    assert low["h.example"]["low"] and low["h.example"]["repeated"]


def test_style_importance_by_hand(spark):
    """Importance of every style node, counted page by page."""
    frame = spark.createDataFrame(planted_site()[0][:30] + [(99, "https://h.example/n", "<body><nav><p>Only here</p></nav><p>Body</p></body>")], "page_id long, url string, html string")
    texts, layouts, paths = defaultdict(Counter), defaultdict(Counter), {}
    for r in rows(frame):
        blocks, nodes = site_style.parse(r["html"])
        for node, text in {(b.nodes[-1], b.text) for b in blocks}:
            texts[node][text] += 1
        for node, layout in {(n.nodes[-1], n.layout) for n in nodes}:
            layouts[node][layout] += 1
        paths.update({n.nodes[-1]: n for n in nodes if not n.kept})
    m, want = 31, {}
    for node, n in paths.items():
        under = [c for leaf, p in paths.items() if node in p.nodes for c in texts[leaf].values()]
        if under:
            content = 1 - sum(np.log(c) for c in under) / len(under) / np.log(m)
            total = sum(layouts[node].values())
            layout = -sum(c / total * np.log(c / total) for c in layouts[node].values()) / np.log(m)
            share = site_style.GAMMA ** len(layouts[node])
            want[node] = site_style.FACTORS[n.level] * ((1 - share) * layout + share * content)
    found = {r["node"]: r["importance"] for r in rows(site_style.importance(site_style._counted(frame)))}
    assert found == pytest.approx(want) and any(v < site_style.LOW for v in want.values())


def test_extraction_drops_inline_elements():
    cases = {
        '<p>Text <span class="ad">Buy now</span> more</p>': "Text more",
        '<p><a class="skip-link" href="#x">Skip</a>One <b>two</b></p>': "One two",
        "<p>a <span class=ad>x <b>y</b><br> z</span> b<p>c": "a b\n\nc",
        "<p>Text <span class=ad>Buy<p>next": "Text\n\nnext",
        "<p>Text <span class=ad>Buy": "Text",
        "<div>a <span class=ad>x<div>y</div></span> b</div>": "a\n\nb",
    }
    assert {page: site_style.main_text(page) for page in cases} == cases


def test_empty_tables(spark, stored, docs):
    none = stored.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vocab = VOCABULARIES
    for df in (
        mixing.decided(none), mixing.mix(none), exact_dedup.groups(none), exact_dedup.dedup(none), minhash.near_duplicates(none), minhash.dedup(none),
        packing.pack(none, P.path("byte_bpe_50k.json")), token_store.stored(none, P.path("word_bpe_49k.json")), quality_rules.judged(none, *vocab),
        quality_model.scored(none, labels), context_mixing.scored(none), license_scan.scan(none), site_style.extract(pages),
    ):
        assert df.count() == 0


def test_prefix_pairs_lose_no_near_pair(spark):
    import random

    rng = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for _ in range(90):
        own = list(passage)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(60)] = f"q{rng.randint(0, 30)}"
        texts.append(" ".join(own[rng.randint(0, 5) :] + ["z"] * rng.randint(0, 12)).encode())
    texts = sorted(set(texts))
    frame = spark.createDataFrame([(bytes([i]), bytes([i]), bytearray(t)) for i, t in enumerate(texts)], "key binary, root binary, text binary")
    found = {(r["a"][0], r["b"][0]) for r in minhash._prefix_pairs(frame, 0.8).collect()}
    bags = [minhash.shingles([t])[1:] for t in texts]
    near = {(i, j) for j in range(len(bags)) for i in range(j) if minhash.overlap(bags[i], bags[j]) >= 0.8}
    assert near and near <= found and len(found) < len(bags) * (len(bags) - 1) / 2
