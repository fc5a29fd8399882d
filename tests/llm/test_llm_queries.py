import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from compare import connect, rows
from tokenizers import Tokenizer

import corpus_pipeline
from skein.llm import quality_rules, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(connect(SF).execute(queries.oracle_sql()[name]).df())


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {r["doc_id"] for r in queries.op9_quality_rules(spark, SF).where("kept").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        if name == "quality rules":
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == kept
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 1024
    assert sorted(out[out.piece == 0].doc_id) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage again by plain loops, over documents with copies, near copies, junk, nulls and repeated rows."""
    base = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    plant = lambda i, text, source="src1", lang="en": {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": None}
    long = next(r["text"] for r in base if len((r["text"] or "").split()) > 150)
    table = base + [plant(5000, long), plant(5001, " " + long + "\n"), plant(5002, long + " and more words"), plant(None, long.replace(" ", "  ", 3)), plant(5003, None), plant(5004, "", None), plant(5005, "$$ ## " * 90)]
    table += [plant(5006, long[: len(long) // 2], None)] * 2
    frame = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in table], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")

    vocab = quality_rules.Vocabularies(P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"))
    verdicts = quality_rules.measure([(r["text"] or "").encode() for r in table], [r["lang"] for r in table], vocab, quality_rules.BANDS)  # held against loops in its own test
    kept = [r for r, v in zip(table, verdicts, strict=True) if v[-1]]
    groups = defaultdict(list)
    for r in kept:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    kept = [min(g, key=lambda r: (-len(r["text"] or ""), *order(r))) for g in groups.values()]
    bags = [Counter(zip(*[(r["text"] or "").encode().split()[k:] for k in range(5)])) for r in kept]
    root = list(range(len(kept)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            if a and bags[j] and sum((a & bags[j]).values()) >= 0.8 * sum((a | bags[j]).values()):
                root[find(i)] = find(j)
    classes = defaultdict(list)
    for i, r in enumerate(kept):
        classes[find(i)].append(r)
    kept = [min(c, key=order) for c in classes.values()]
    assert len(kept) < len(groups) < len(table)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in kept])
    copies = dict(con.execute(f"SELECT doc_id, CASE WHEN size > 0 THEN taken // size ELSE 0 END FROM ({queries.OP1_SQL})").fetchall())
    tok, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Counter()
    for r in kept:
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += copies[r["doc_id"]]
    found = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == +want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024
