"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import context_mixing, exact_dedup, fill_middle, license_scan, minhash, mixing, overlap_join, packing, phrases, quality_model, quality_rules, site_style, token_store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.decided(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(table(spark, sf_dir, "pages"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, size=1024)


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op11_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_join.linked(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_site_style, op3_quality_model, op4_best_fit_packing, op5_context_mixing, op6_license_scan, op7_bag_minhash, op8_token_store, op9_quality_rules, op10_exact_dedup, op11_overlap_join, op12_phrases, op13_fill_middle)}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::UBIGINT::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source),
w AS (SELECT source, source_size, k, (k % 3 + 1)::BIGINT AS w FROM s),
c AS (SELECT *, coalesce(sum(source_size) OVER o, 0) * 3 AS capped, coalesce(sum(w) OVER o, 0) AS gone FROM w
      WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT (SELECT sum(source_size) FROM w) AS total, (SELECT sum(w) FROM w) AS weight),
f AS (SELECT (total - capped)::DOUBLE AS rest, (weight - gone)::DOUBLE AS left_w FROM c, t
      WHERE 3 * source_size * (weight - gone) >= w * (total - capped) ORDER BY gone, capped LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN 3 * source_size::DOUBLE < w * (rest / left_w) THEN (3 * source_size)::DOUBLE ELSE w * (rest / left_w) END AS target FROM c, f),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM g),
m AS (SELECT *, target - copies * source_size AS need FROM n),
x AS (SELECT source, h, sum(size) AS grp, min(size) AS one FROM d WHERE size > 0 GROUP BY source, h),
y AS (SELECT x.*, sum(grp) OVER (PARTITION BY source ORDER BY h) AS upto FROM x),
z AS (SELECT m.source, y.h AS edge, need - (upto - grp) AS remains FROM m JOIN y ON m.source IS NOT DISTINCT FROM y.source WHERE need > 0 AND upto >= need AND upto - grp < need),
r AS (SELECT z.source, edge, remains, y.h, y.grp, row_number() OVER (PARTITION BY z.source ORDER BY abs(y.one - remains), y.h) AS i FROM z JOIN y ON z.source IS NOT DISTINCT FROM y.source AND y.h >= edge),
q AS (SELECT source, edge, CASE WHEN abs(grp - remains) < remains THEN h ELSE -1 END AS filler FROM r WHERE i = 1)
SELECT d.doc_id, d.size, m.source_size, m.target,
  (CASE WHEN d.size = 0 THEN 0 ELSE d.size * (m.copies + CASE WHEN d.h < q.edge OR d.h = q.filler THEN 1 ELSE 0 END) END)::BIGINT AS taken
FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": OP1_SQL, "op6_license_scan": license_scan.oracle(), "op10_exact_dedup": OP10_SQL, "op11_overlap_join": overlap_join.SQL, "op12_phrases": phrases.SQL, "op13_fill_middle": fill_middle.SQL}
