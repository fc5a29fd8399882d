"""Fill-in-the-middle transformation by lookaround splitting (DataFrame functions only).

A unit grammar is a list of character classes whose runs hold together; every other character stands
alone. It becomes a zero-width regex of neighbouring classes: there is a boundary after a character of
no class, and between a character of a class and one outside it. Splitting there keeps every piece. A
document is cut at two unit boundaries drawn from the digest of its id, and written as prefix, suffix,
middle (psm) or suffix, prefix, middle (spm) behind sentinels. Texts that hold a sentinel, empty ones
and a share of all stay plain.

Defined results: a null text counts as empty; an empty text has no units and stays plain; a null
doc_id is digested as the empty text; equal rows give equal outputs; an empty table gives no rows;
other columns pass through ``transform`` unless they have the name of one that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Renamed

#: Classes that run on, by name of the grammar, as bodies of regex classes.
GRAMMARS = {"letters": ["A-Za-z"], "words": [r"\x20\x09-\x0D", r"^\x20\x09-\x0D"], "alphanumerics": ["A-Za-z", "0-9"], "characters": []}
SENTINELS = ("<P>", "<S>", "<M>")
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


def boundary(classes: list[str]) -> str:
    """The regex of the empty places between two units of a text.

    No alternative holds inside a surrogate pair: each looks back at one whole character. The end of the
    text is no boundary (its start never is for ``split``)."""
    inside = [c for c in classes if not c.startswith("^")]
    outside = [c for c in classes if c.startswith("^")]
    if outside and (len(outside) > 1 or {o[1:] for o in outside} != {"".join(inside)}):
        raise ValueError("a negated class must be the complement of the others")
    within = [rf"(?<=[{c}])(?=[^{c}])" for c in inside]
    if outside:  # both kinds run on
        return "|".join([*within, rf"(?<=[{outside[0]}])(?=[{outside[0][1:]}])"])
    alone = rf"(?<=[^{''.join(inside)}])(?!\z)" if inside else r"(?<=[\x{0}-\x{10FFFF}])(?!\z)"
    return "|".join([alone, *within])


def units(text: Column, grammar: str = "letters") -> Column:
    """The units of a text in order; none for an empty or null one (``split`` would give one empty piece)."""
    return F.when(F.length(text) > 0, F.split(text, boundary(GRAMMARS[grammar]), -1)).otherwise(F.array().cast("array<string>"))


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, grammar: str = "letters", seed: int = 1, changed: int = 90, spm: int = 20) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output; ``changed`` of 100 texts are rearranged,
    ``spm`` of 100 of them with the suffix first."""
    own = Renamed(docs)
    new = [c.split()[0] for c in ADDED.split(", ")]
    text, p, s, m = F.coalesce(own["text"], F.lit("")), *SENTINELS
    rows = own.rows.select("*", text.alias("_text"), units(text, grammar).alias("_units"), *[h.alias(f"_h{k}") for k, h in enumerate(_draws(own["doc_id"], seed), 1)])
    n = F.size("_units")
    cuts = [F.col(f"_h{k}") % (n + 1) for k in (1, 2)]
    rows = rows.select("*", n.cast("long").alias("_n"), F.least(*cuts).cast("int").alias("_a"), F.greatest(*cuts).cast("int").alias("_b"))
    held = F.contains("_text", F.lit(p)) | F.contains("_text", F.lit(s)) | F.contains("_text", F.lit(m))
    plain = (F.col("_text") == "") | held | (F.col("_h3") % 100 >= changed)
    rows = rows.withColumn("_form", F.when(plain, "plain").when(F.col("_h4") % 100 < spm, "spm").otherwise("psm"))
    joined = lambda first, size: F.when(F.col("_form") != "plain", F.array_join(F.slice("_units", first, size), ""))
    rows = rows.withColumns({"_prefix": joined(F.lit(1), F.col("_a")), "_middle": joined(F.col("_a") + 1, F.col("_b") - F.col("_a")), "_suffix": joined(F.col("_b") + 1, F.size("_units") - F.col("_b"))})
    psm = F.concat(F.lit(p), "_prefix", F.lit(s), "_suffix", F.lit(m), "_middle")
    output = F.when(F.col("_form") == "psm", psm).when(F.col("_form") == "spm", F.concat(F.lit(s), "_suffix", F.lit(p), "_prefix", F.lit(m), "_middle")).otherwise(F.col("_text"))
    added = [F.col("_n"), F.col("_form"), F.length("_prefix").cast("long"), F.length("_middle").cast("long"), output]
    kept = [F.col(f"_c{i}").alias(c) for i, c in enumerate(own.names) if c.lower() not in new]
    return rows.select(*kept, *[c.alias(name) for c, name in zip(added, new, strict=True)])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No sentinel can arise across the end of a part: none of them ends
    with what another starts with."""
    p, s, m = SENTINELS
    start = len(p) + 1

    def between(opening: str, closing: str | None) -> Column:
        first = F.locate(opening, output) + len(opening)
        return F.substr(output, first) if closing is None else F.substr(output, first, F.locate(closing, output) - first)

    psm = F.concat(F.substr(output, F.lit(start), F.locate(s, output) - start), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), F.substr(output, F.lit(start), F.locate(p, output) - start))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of the text rebuilt from it."""
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    rows = transform(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM g
"""
