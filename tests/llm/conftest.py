import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _mix string, `odd name` int"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty, blank and very long texts, copies, near copies, repeated rows and
    extra columns whose names clash with those that operators use."""
    import random

    r = random.Random(3)
    words = ["".join(r.choice(["ba", "ri", "to", "nel", "su"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    long, near = text(20_000), text(200)
    rows = [(i, text(r.randint(5, 300)), "en", f"src{i % 4}", 1) for i in range(40)]
    rows += [(100, near, "en", "src0", 1), (101, near + " extra", "en", "src1", 1), (102, near, "de", "src0", 1), (103, near.replace(" ", "\n"), "xx", None, 1)]
    rows += [(110, None, None, None, None), (111, "", "en", "src0", 0), (112, " \t\n", "en", "src1", 3), (None, text(60), "en", "src2", 1), (113, long, "en", "src3", 1)]
    rows += [(120, "one two three", "en", "src0", 1)] * 3 + [(121, "x" * 70_000, "en", "src0", 1), (122, "Été ça ñ “q”   z", "fr", "src1", 1)]
    return spark.createDataFrame([(*row, 7, "clash", None) for row in rows], SCHEMA)


@pytest.fixture(scope="session")
def stored(docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    docs.repartition(3).write.parquet(path)
    return docs.sparkSession.read.parquet(path)
