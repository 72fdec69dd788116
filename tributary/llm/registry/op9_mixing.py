"""A mix of all documents by source weights."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import table
from tributary.llm.mixing import mix

NAME = "op9_mixing_sources"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: Documents with the copies that the mix takes; running sums stand for the histograms.
MIXED = r"""
WITH rows AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM {documents}
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3]::DOUBLE AS w
  FROM rows GROUP BY source
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (
      ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sizes
), filled_levels AS (
  SELECT *, first(CASE WHEN level * w <= cap THEN level END IGNORE NULLS) OVER (
    ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flat
  FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN flat IS NULL THEN cap ELSE least(flat * w, cap) END AS target FROM filled_levels
), plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS base FROM targets
), bars AS (
  SELECT source, h, sum(size)::BIGINT AS bar, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS filled
  FROM rows GROUP BY source, h
), cuts AS (
  SELECT p.source, p.source_size, p.target, p.base,
    min(CASE WHEN filled > target - base * source_size THEN h END) AS edge,
    arg_min(filled, h) FILTER (filled > target - base * source_size) AS edge_filled,
    arg_min(bar, h) FILTER (filled > target - base * source_size) AS edge_bar
  FROM plans p JOIN bars b ON p.source IS NOT DISTINCT FROM b.source
  GROUP BY p.source, p.source_size, p.target, p.base
), cut_at AS (
  SELECT *, CASE WHEN edge IS NULL THEN 1152921504606846976
    WHEN edge_bar - (target - base * source_size - (edge_filled - edge_bar)) < target - base * source_size - (edge_filled - edge_bar)
    THEN edge + 1 ELSE edge END AS cut
  FROM cuts
)
SELECT r.* EXCLUDE (h), c.source_size, c.target, least(c.base + (r.h < c.cut)::BIGINT, 2) AS copies
FROM rows r JOIN cut_at c ON r.source IS NOT DISTINCT FROM c.source
"""
SQL = f"SELECT doc_id, size, source_size, target, size * copies AS taken FROM ({MIXED.replace('{documents}', 'documents')})"
