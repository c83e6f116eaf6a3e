"""Queries on overlapping and gapped page intervals."""

from __future__ import annotations

from foliolens.operators.intervals import periods_and_gaps
from foliolens.sources.tables import table


def p2_found(spark, base):
    return periods_and_gaps(table(spark, base, "citation_intervals"), ["query_id", "doc_id"])


P2_SQL = """
WITH ok AS (
  SELECT DISTINCT query_id, doc_id, from_page, to_page FROM citation_intervals
  WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND from_page >= 1 AND from_page <= to_page),
m AS (
  SELECT *, CASE WHEN max(to_page) OVER (PARTITION BY query_id, doc_id ORDER BY from_page, to_page
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 >= from_page THEN 0 ELSE 1 END AS fresh FROM ok),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id, doc_id ORDER BY from_page, to_page ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT query_id, doc_id, island, CAST(min(from_page) AS INTEGER) AS from_page, CAST(max(to_page) AS INTEGER) AS to_page FROM i GROUP BY ALL),
n AS (SELECT *, lead(from_page) OVER (PARTITION BY query_id, doc_id ORDER BY from_page) AS next_from FROM p)
SELECT query_id, doc_id, 'period' AS kind, from_page, to_page FROM n
UNION ALL
SELECT query_id, doc_id, 'gap', CAST(to_page + 1 AS INTEGER), CAST(next_from - 1 AS INTEGER) FROM n WHERE next_from IS NOT NULL
"""

QUERIES = {"p2_found": p2_found}
SQL = {"p2_found": P2_SQL}
