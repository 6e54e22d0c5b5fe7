"""Listings, filters, statistics, tags, references and exports of a library of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import ascii_lower


def keyword_search(papers: DataFrame, query: str, columns: tuple[str, ...] = ("title", "abstract"), limit: int | None = None) -> DataFrame:
    """Papers that hold a text in any of the columns; only A-Z is folded."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(ascii_lower(F.col(c)).contains(query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))), F.lit(False))
    found = papers.filter(hit)
    return found if limit is None else found.orderBy("paper_id").limit(limit)


def page(papers: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of papers by an allowed order; any other order is the newest first."""
    orders = {
        "ingested_at_desc": [F.desc("ingested_at")], "ingested_at_asc": [F.asc("ingested_at")], "year_desc": [F.desc_nulls_last("publication_year")],
        "year_asc": [F.asc_nulls_first("publication_year")], "id_asc": [], "id_desc": [F.desc("paper_id")],
    }
    return papers.orderBy(*orders.get(order, orders["ingested_at_desc"]), "paper_id").offset(offset).limit(limit)


def tagged(papers: DataFrame, tags: DataFrame) -> DataFrame:
    """Papers whose tag is among those given."""
    return papers.join(tags.select("tag"), "tag", "left_semi")


def without(papers: DataFrame, done: DataFrame) -> DataFrame:
    """Papers that a table of finished ones doesn't hold."""
    return papers.join(done.select("paper_id"), "paper_id", "left_anti")


def tag_usage(papers: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, papers), unused tags included."""
    used = papers.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return tags.select("tag").distinct().join(used, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("papers"))


def most_cited(references: DataFrame, limit: int | None = None) -> DataFrame:
    """(title, papers, year): works that more than one paper cites, with their least year."""
    counts = references.filter("title <> ''").groupBy("title").agg(F.countDistinct("paper_id").alias("papers"), F.min("year").alias("year")).filter("papers > 1")
    return counts if limit is None else counts.orderBy(F.desc("papers"), "title").limit(limit)


def top_references(references: DataFrame, least: float = 0.0, n: int = 15) -> DataFrame:
    """Each paper's n most relevant references of at least some score."""
    order = Window.partitionBy("paper_id").orderBy(F.desc("score"), "part")
    kept = references.filter(F.col("score").isNotNull() & (F.col("score") >= least))
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def coverage(papers: DataFrame, vectors: DataFrame) -> DataFrame:
    """(papers, with_vector, share) in one row."""
    has = papers.select("paper_id").join(vectors.select("paper_id", F.lit(1).alias("has")).distinct(), "paper_id", "left")
    return has.agg(F.count(F.lit(1)).alias("papers"), F.count("has").alias("with_vector")).withColumn("share", F.col("with_vector") / F.col("papers"))


def type_coverage(sections: DataFrame, types: DataFrame) -> DataFrame:
    """(section_type, n, share) for every type, those without sections included."""
    counts = sections.groupBy("section_type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over one row per type
    out = types.join(counts, "section_type", "left").select("section_type", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def export_nested(papers: DataFrame, references: DataFrame) -> DataFrame:
    """(paper_id, json): each paper as a JSON object with its references, by paper and part."""
    refs = references.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("part", "doi", "relationship"))).alias("references"))
    full = papers.join(refs, "paper_id", "left").withColumn("references", F.coalesce("references", F.array().cast("array<struct<part:bigint,doi:string,relationship:string>>")))
    return full.select("paper_id", F.to_json(F.struct("paper_id", "tag", "status", "references"), {"ignoreNullFields": "false"}).alias("json"))


def archive(papers: DataFrame, viewpoints: DataFrame) -> DataFrame:
    """(paper_id, file, markdown): each paper's page with its viewpoints under their categories."""
    from lectern.functions.text import paper_filename

    by = viewpoints.groupBy("paper_id", "category").agg(F.array_sort(F.collect_list(F.struct("seq", "viewpoint"))).alias("v"))
    block = F.concat(F.lit("## "), F.col("category"), F.lit("\n"), F.array_join(F.transform("v", lambda x: F.concat(F.lit("- "), F.regexp_replace(x["viewpoint"], r"\s*\n\s*", " "))), "\n"))
    blocks = by.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list(block)), "\n\n").alias("blocks"))
    title = F.regexp_replace("title", r"\s*\n\s*", " ")
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), title), "blocks")
    return papers.join(blocks, "paper_id").select("paper_id", paper_filename(F.col("paper_id"), title).alias("file"), text.alias("markdown"))


def graph_export(pairs: DataFrame) -> DataFrame:
    """(source, target, json) of each coupled pair, its similarity averaged."""
    edges = pairs.groupBy("paper_a", "paper_b", "relationship").agg(F.count(F.lit(1)).alias("shared"), F.avg("similarity").alias("similarity"))
    return edges.select(F.col("paper_a").alias("source"), F.col("paper_b").alias("target"), "relationship", "shared", "similarity")
