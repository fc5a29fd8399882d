import hashlib
import re

import pytest
from pyspark.sql import functions as F

from skein.llm import fill_middle

TEXTS = [None, "", " ", "a", "Ab1c", "don't  stop\n\n", "é𝒳𝒴z", "𝒳a𝒴", "a𝒳", "𝒳", "has <S> inside", "<", "<<P", "P><S", "x" * 70_000, "日本 語\r\nabc", "a b " * 5000, "\x00\x85 q"]


def expected(doc_id, text):
    """By plain slicing, as the contract says it."""
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("grammar, pattern", [("letters", r"[A-Za-z]+|[^A-Za-z]"), ("words", r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), ("alphanumerics", r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]"), ("characters", r"(?s).")])
def test_units_are_those_of_a_matching_grammar(spark, grammar, pattern):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", fill_middle.units(F.col("text"), grammar).alias("u"))
    for r in frame.collect():
        assert r["u"] == re.findall(pattern, r["text"] or "")


def test_outputs_equal_plain_slicing_and_restore(spark):
    table = [(i * 40 + j, t) for i, t in enumerate(TEXTS) for j in range(40)] + [(None, "no id here"), (7, "twice"), (7, "twice")]
    frame = spark.createDataFrame([(*r, "old", 3) for r in table], "doc_id long, text string, Form string, _n int")
    out = fill_middle.transform(frame)
    assert out.columns == ["doc_id", "text", "_n", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(table)
    for r in found:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == expected(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_no_rows_and_bad_grammars(spark):
    assert fill_middle.digests(spark.createDataFrame([], "doc_id long, text string, extra int")).count() == 0
    with pytest.raises(ValueError):
        fill_middle.boundary(["a-z", "^0-9"])
