"""A registered query over the identity of outside works, beside equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import graph, identity
from lectern.plans.catalogue import query
from lectern.sources import tables as S


def _registered(sql: str, views: str):
    """As :func:`query`, for SQL with a recursive view."""
    from lectern.plans.catalogue import SQL

    def put(f):
        query(sql, views)(f)
        SQL[f.__name__] = SQL[f.__name__].replace("WITH ", "WITH RECURSIVE ", 1)
        return f

    return put


@_registered(
    """, chain AS (SELECT paper_id, part, part // 12 AS b, part % 12 AS k, (part // 12) % 3 = 0 AND part % 12 = 6 AS cut FROM refs),
  named AS (SELECT paper_id, CASE WHEN NOT cut AND k <> 11 THEN '10.0/' || b || '.' || (k // 2) END AS doi, CASE WHEN cut THEN 'Lone work ' || part ELSE 'Work ' || b || ' ' || ((k + 1) // 2) END AS title FROM chain),
  keyed AS (SELECT *, 'd' || doi AS dk, 't' || lower(title) AS tk FROM named),
  edges_ AS (SELECT DISTINCT dk AS a, tk AS b FROM keyed WHERE dk IS NOT NULL UNION SELECT DISTINCT tk, dk FROM keyed WHERE dk IS NOT NULL),
  reach(a, b) AS (SELECT DISTINCT tk, tk FROM keyed UNION SELECT r.a, e.b FROM reach r JOIN edges_ e ON e.a = r.b),
  tops AS (SELECT a, min(b) AS top FROM reach GROUP BY a)
  SELECT substr(top, 2) AS name, arg_min(title, [lpad(paper_id::VARCHAR, 20, '0'), title]) AS display, min(doi) AS doi, count(DISTINCT paper_id) AS papers FROM keyed JOIN tops ON a = tk GROUP BY top""",
    "refs",
)
def work_identities(spark, sf_dir):
    """Outside works that are one through chains of shared DOIs and titles, with the first title and the number of papers."""
    part = F.col("part")
    base, k = F.expr("part div 12").cast("string"), part % 12
    cut = (F.expr("part div 12") % 3 == 0) & (k == 6)
    doi = F.when(~cut & (k != 11), F.concat(F.lit("10.0/"), base, F.lit("."), F.expr("part % 12 div 2").cast("string")))
    title = F.when(cut, F.concat(F.lit("Lone work "), part.cast("string"))).otherwise(F.concat(F.lit("Work "), base, F.lit(" "), F.expr("(part % 12 + 1) div 2").cast("string")))
    # A paper may cite a work in several lines: works are distinct, and papers are counted once each.
    lines = S.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("part"))
    cited = lines.select("paper_id", doi.alias("doi"), title.alias("title"))
    return identity.displayed(cited, graph.works(cited))
