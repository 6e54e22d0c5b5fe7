"""Registered queries over papers with all their children, made of whole documents, each beside equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.ingest import paper_tables
from lectern.plans.catalogue import NEEDS, VIEWS, query
from lectern.sources import tables as S


def nested_papers(spark, sf_dir) -> DataFrame:
    """Documents as papers: three lines are a section, and lines become tables, formulas, images and references by their lengths."""
    docs = S.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.concat(F.lit(" 10.1/"), F.col("doc_id").cast("string"), F.lit(" ")).alias("doi"), F.expr("filter(split(text, '\\n'), x -> trim(x) <> '')").alias("ls"))
    own = "transform(slice(ls, s * 3 + 1, 3), (x, j) -> named_struct('x', x, 'n', length(x), 'i', s * 3 + j))"
    some = lambda n, fields: f"transform(filter({own}, z -> z.n % {n} = 0), z -> named_struct({fields}))"
    sections = f"""
      transform(sequence(0, (size(ls) - 1) div 3), s -> named_struct('heading', ls[s * 3], 'level', 1 + s % 3, 'page_start', s + 1, 'page_end', s + 2, 'paragraphs', slice(ls, s * 3 + 2, 2),
        'tables', {some(7, "'html', concat('<t>', z.x), 'markdown', cast(null as string), 'caption', z.x, 'page', z.i")}, 'formulas', {some(5, "'latex', if(z.n % 10 = 0, '', z.x), 'type', cast(null as string), 'page', z.i")},
        'images', {some(6, "'path', if(z.n % 4 = 0, cast(null as string), concat('img', z.i)), 'caption', z.x, 'page', z.i")}))"""
    references = """
      transform(filter(transform(ls, (x, i) -> named_struct('x', x, 'n', length(x), 'i', i)), z -> z.n % 3 = 0), z -> named_struct('number', z.i, 'text', z.x, 'doi', concat(' 10.2/', z.n),
        'citations', if(z.i % 3 = 0, cast(array() as array<struct<page:int,sentence:string>>), transform(sequence(1, z.i % 3), p -> named_struct('page', p, 'sentence', z.x)))))"""
    return docs.select("key", F.get("ls", F.lit(0)).alias("title"), "doi", F.when(F.size("ls") > 0, F.expr(sections)).alias("sections"), F.expr(references).alias("references"))


VIEWS |= {
    "own_lines": "SELECT doc, i, x, length(x) AS n, i // 3 AS s, dense_rank() OVER (ORDER BY doc) AS paper FROM (SELECT doc_id AS doc, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '') AS ls FROM documents))",
    "sections_": "SELECT row_number() OVER (ORDER BY doc, s) AS id, doc, s, arg_min(x, i) AS heading, string_agg(x, chr(10) || chr(10) ORDER BY i) FILTER (WHERE i % 3 > 0) AS body, any_value(paper) AS paper_id FROM own_lines GROUP BY doc, s",
    "numbered_papers": "SELECT doc_id AS doc, row_number() OVER (ORDER BY doc_id) AS paper_id FROM documents",
}
NEEDS |= {"sections_": ["own_lines"]}


@query("SELECT id, n.paper_id, s::INT AS sort_order, heading, (1 + s % 3)::INT AS level, (s + 1)::INT AS page_start, coalesce(body, '') AS body_text FROM sections_ JOIN numbered_papers n USING (doc)", "sections_ numbered_papers")
def paper_section_rows(spark, sf_dir):
    """Sections of all papers with ids and their papers' ids."""
    return paper_tables(nested_papers(spark, sf_dir))["sections"].select("id", "paper_id", "sort_order", "heading", "level", "page_start", "body_text")


@query(
    """
  , rich AS (
    SELECT 'table' AS kind, doc, s, i, '<t>' || x AS content, x AS caption, true AS kept FROM own_lines WHERE n % 7 = 0
    UNION ALL SELECT 'formula', doc, s, i, x, '', n % 10 <> 0 FROM own_lines WHERE n % 5 = 0
    UNION ALL SELECT 'image', doc, s, i, 'img' || i, x, n % 4 <> 0 FROM own_lines WHERE n % 6 = 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY kind, doc, s ORDER BY i) - 1 AS place FROM rich)
  SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY p.doc, p.i) AS id, q.id AS section_id, r.paper_id, place::INT AS sort_order, content, caption, i::INT AS page FROM placed p JOIN sections_ q USING (doc, s) JOIN numbered_papers r USING (doc) WHERE kept""",
    "sections_ numbered_papers",
)
def paper_rich_rows(spark, sf_dir):
    """Tables, formulas and images of all sections; those without content are left out, and the others keep their places."""
    t = paper_tables(nested_papers(spark, sf_dir))
    row = lambda name, kind, content, caption: t[name].select(F.lit(kind).alias("kind"), "id", "section_id", "paper_id", "sort_order", F.col(content).alias("content"), caption, "page")
    return row("tables", "table", "html", "caption").unionByName(row("formulas", "formula", "latex", F.lit("").alias("caption"))).unionByName(row("images", "image", "image_path", "caption"))


@query("SELECT row_number() OVER (ORDER BY o.doc, i) AS id, r.paper_id, (row_number() OVER (PARTITION BY o.doc ORDER BY i) - 1)::INT AS sort_order, i::INT AS number, x AS text, '10.2/' || n AS doi FROM own_lines o JOIN numbered_papers r USING (doc) WHERE n % 3 = 0", "own_lines numbered_papers")
def paper_reference_rows(spark, sf_dir):
    """References of all papers."""
    return paper_tables(nested_papers(spark, sf_dir))["references"].select("id", "paper_id", "sort_order", "number", "text", "doi")


@query(
    """
  , refs_ AS (SELECT row_number() OVER (ORDER BY o.doc, i) AS reference_id, r.paper_id, i, x FROM own_lines o JOIN numbered_papers r USING (doc) WHERE n % 3 = 0),
  cited AS (SELECT *, unnest(range(1, i % 3 + 1)) AS p FROM refs_)
  SELECT row_number() OVER (ORDER BY reference_id, p) AS id, reference_id, paper_id, (p - 1)::INT AS sort_order, p::INT AS page, x AS sentence FROM cited""",
    "own_lines numbered_papers",
)
def paper_citation_rows(spark, sf_dir):
    """Citations of all references, with the ids of both."""
    return paper_tables(nested_papers(spark, sf_dir))["citations"].select("id", "reference_id", "paper_id", "sort_order", "page", "sentence")
