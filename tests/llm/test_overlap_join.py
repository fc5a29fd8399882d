import random
from collections import Counter

import numpy as np
import pytest

from skein.llm import overlap_join


def brute(table, similar=(80, 100)):
    """All pairs of plain Python sets; (doc_id, n_shingles, component_id) of every row."""
    sets = []
    for _, text in table:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and similar[1] * both >= similar[0] * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(table):
        ids.setdefault(find(i), []).append(doc_id)
    least = {r: min((x for x in some if x is not None), default=None) for r, some in ids.items()}
    return Counter((doc_id, len(s), least[find(i)]) for i, ((doc_id, _), s) in enumerate(zip(table, sets, strict=True)))


def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    table = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "É é"), (None, "no id"), (None, "NO id")]
    i = 100
    for n in (60, 61, 200):  # chains: each text is near the one before, not the first
        chain = text(n)
        for _ in range(30):
            table.append((i := i + 1, " ".join(chain)))
            chain = chain[3:] + text(3)
    for _ in range(3):  # clusters of near copies
        base = text(150)
        for _ in range(40):
            mine = list(base)
            for _ in range(r.randint(0, 6)):
                mine[r.randrange(150)] = r.choice(words)
            table.append((i := i + 1, " ".join(mine)))
    shared = text(60)  # one passage in many texts
    table += [((i := i + 1), " ".join(text(r.randint(5, 60)) + shared + text(r.randint(5, 20)))) for _ in range(120)]
    table += [((i := i + 1), " ".join(text(r.randint(1, 12)) + shared)) for _ in range(40)]
    table += [((i := i + 1), " ".join(text(r.randint(1, 300)))) for _ in range(60)]
    table += r.sample(table, 25) + [(9000, "abc " * 20_000), (9001, "Abc " * 30_000)]
    return table


@pytest.mark.parametrize("part, posts", [(20_000, 200_000), (5, 50)])
def test_components_equal_all_pairs(spark, monkeypatch, part, posts):
    monkeypatch.setattr(overlap_join, "LIST_PART", part)
    monkeypatch.setattr(overlap_join, "BUCKET_POSTS", posts)
    table = corpus()
    frame = spark.createDataFrame([(*r, 1, "x") for r in table], "doc_id long, text string, key int, root string").repartition(5)
    found = overlap_join.linked(frame)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, found.collect())) == brute(table)


def test_the_search_alone_finds_all_links(spark, monkeypatch):
    """Without leaders every link must come from the search, at another bound."""
    monkeypatch.setattr(overlap_join, "_led", lambda posts: posts.select(posts.key.alias("a"), posts.key.alias("b")).limit(0))
    table = corpus()
    frame = spark.createDataFrame(table, "doc_id long, text string")
    assert Counter(map(tuple, overlap_join.linked(frame, (60, 100)).collect())) == brute(table, (60, 100))


def test_no_rows(spark):
    assert overlap_join.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_occurrences_and_bounds():
    lists = [[1, 4, 9], [], [4], [1, 2, 4, 9, 9]]
    assert overlap_join.occurrences(lists) == [(1, 2), (2, 1), (4, 3), (9, 3)]
    for n in (1, 2, 5, 6, 100, 1001):
        assert overlap_join.needed(n) * 100 >= 80 * n > (overlap_join.needed(n) - 1) * 100
        for longest in (1, 2, 50, 10**9):
            assert 0 <= overlap_join.skipped(n, longest) < overlap_join.needed(n)
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 100, np.uint64) * np.uint64(2))
    for bits in (1, 40, 64):
        some = h >> np.uint64(64 - bits)
        assert (overlap_join._unpacked(overlap_join._packed(some)) == some).all()


def test_a_task_holds_one_bucket_at_a_time():
    import pyarrow as pa

    read = []

    def batches():
        for bucket in range(6):
            read.append(bucket)
            h = np.array([bucket * 10 + 1, bucket * 10 + 2], np.uint64)
            rows = [(bucket, 7, overlap_join._packed(h), bytes([1, 1])), (bucket, 8, overlap_join._packed(h[1:]), bytes([1]))]
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "group", "h", "n"), r, strict=True)) for r in rows])

    answers = overlap_join._answered(batches())
    first = next(answers).to_pylist()
    assert max(read) == 1  # the second bucket's first row ends the first bucket
    found = [*first, *[r for b in answers for r in b.to_pylist()]]
    assert [(r["group"], overlap_join._unpacked(r["h"]).tolist()) for r in found] == [(g, [b * 10 + 2]) for b in range(6) for g in (7, 8)]


def test_more_buckets_than_tasks(spark, monkeypatch):
    monkeypatch.setattr(overlap_join, "BUCKET_SHINGLES", 200)
    table = corpus()
    frame = spark.createDataFrame(table, "doc_id long, text string")
    assert Counter(map(tuple, overlap_join.linked(frame).collect())) == brute(table)


def search_rows(n_nodes, passage, own):
    """Rows of one group: nodes of own components that share a passage of lists, and lists that two of them have."""
    rows = []
    for i in range(n_nodes):
        rare = [10_000 + i // 2 * own + j for j in range(own)]
        lists = sorted([(2, e) for e in rare] + [(n_nodes, e) for e in range(passage)])
        for place, (_, e) in enumerate(lists):
            common = {"bucket": 0, "part": 0, "turn": 0, "e": e, "key": bytes([i, 1]), "root": bytes([i, 1]), "n": 100, "skip": 60, "left": len(lists), "place": place}
            rows += [common | {"rest": False, "asks": False}, common | {"rest": False, "asks": True}]
    return rows


def test_a_passage_of_many_texts_makes_no_pairs_of_all(monkeypatch):
    """89 of 100 in common, less 60 that are left out: 29 lists, of which the passage has 25 and the two of a pair 10 more."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist(search_rows(60, 25, 10))
    found = [(r["a"][0], r["b"][0]) for b in overlap_join._searched(iter([batch.slice(0, 700), batch.slice(700)]), (80, 100)) for r in b.to_pylist()]
    assert sorted(found) == [(i, i + 1) for i in range(0, 60, 2)]  # before: all 1770 pairs
    # Where all pairs may link, they leave a task in small batches.
    monkeypatch.setattr(overlap_join, "PAIRS", 100)
    batch = pa.RecordBatch.from_pylist(search_rows(60, 29, 1))
    sizes = [b.num_rows for b in overlap_join._searched(iter([batch]), (80, 100))]
    assert sum(sizes) == 60 * 59 // 2 and max(sizes) == 100
