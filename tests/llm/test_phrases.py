import re
from collections import Counter, defaultdict

import pytest

from skein.llm import phrases


def brute(table, least, longest, share, top):
    """Every n-gram of every text, one by one."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in table:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            score, _, l, r = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            if not any(100 * b >= share * a for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                rows.append((" ".join(p), a, l, r, n[lang], score))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i, *x) for i, x in enumerate(rows[:top], 1)]
    return sorted(out)


def texts():
    import random

    r = random.Random(5)
    words = ["Der", "die", "É", "a\xa0b", "x", "New", "York", "\x1f", "日本", "q z", "#1", "of"]
    table = [(r.choice(["en", "de", None, "und", ""]), " ".join(r.choice(words) + r.choice(["", "", "", ",", ".", "\t", "  "]) for _ in range(r.randint(0, 60)))) for _ in range(150)]
    table += [("en", "Red green\tBLUE  yellow. red green blue"), ("en", None), (None, None), ("en", ""), ("de", " \n.,"), ("de", "alone")] * 5
    return table + [("en", "new york " * 4000), ("fr", "one of " * 40 + "\n" + "one  of\tone")]


@pytest.mark.parametrize("least, longest, share, top", [(5, 4, 80, 2000), (3, 2, 50, 7), (4, 6, 95, 30)])
def test_phrases_equal_brute_force(spark, least, longest, share, top):
    table = texts()
    frame = spark.createDataFrame([(lang, text, 1, 2) for lang, text in table], "lang string, text string, piece int, n int").repartition(5)
    found = phrases.mine(frame, least, longest, share, top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(table, least, longest, share, top)
    assert len(want) > 20 and sorted(tuple(r) for r in found.collect()) == want


def test_no_rows(spark):
    assert phrases.mine(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 9 * 10**18), ("en", "b", 1, 8 * 10**18), ("en", "a b", 2, 7 * 10**18), ("en", "a b a", 3, 5 * 10**18), ("en", "b a", 2, 6 * 10**18)], "lang string, phrase string, k int, f long")
    found = {r["phrase"]: r for r in phrases._cut_scores(counts.where("k > 1").withColumnRenamed("f", "a"), counts).collect()}
    assert found["a b"]["score"] == 2_000_000 * 7 * 10**18 // (17 * 10**18)
    assert found["a b a"]["score"] == min(2_000_000 * 5 // (9 + 6), 2_000_000 * 5 // (7 + 9))
    inside = {r["phrase"] for r in phrases._inside_longer(counts.where("k > 1").withColumnRenamed("f", "a"), 80).collect()}
    assert inside == {"b a"}  # 100 x 5 >= 80 x 6, but not 80 x 7
