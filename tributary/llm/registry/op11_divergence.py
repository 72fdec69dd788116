"""Divergence of all sources from the other sources of their language."""

from pyspark.sql import DataFrame, SparkSession

from tributary.llm.common import table
from tributary.llm.divergence import audit

NAME = "op11_source_divergence"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lang, source, part, item, value, rank`` over all documents."""
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS lang_occ FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 30
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS occ FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(lang_occ)::HUGEINT AS n FROM kept GROUP BY lang
), sizes AS (
  SELECT lang, source, coalesce(sum(occ), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.occ, 0) AS occ,
    1 + (1000000000 * (coalesce(c.occ, 0) + 5)) // (s.n + 5 * l.v) AS p,
    1 + (1000000000 * (k.lang_occ + 5)) // (l.n + 5 * l.v) AS q
  FROM sizes s JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE occ > 0 AND p > q
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
