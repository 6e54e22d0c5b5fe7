"""Sources: the scholarly tables as views of the stored tables.

documents are papers (title, abstract, tag = source, field = lang); embeddings are paper, section and viewpoint
vectors; orders with lineitem are papers with references; conversations are viewpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The section types.
SECTION_TYPES = ["abstract", "intro", "related_work", "methods", "experiments", "results", "discussion", "conclusion", "acknowledgments", "references", "appendix", "other"]
#: Embedding columns that may be searched.
EMBEDDING_FIELDS = ("title", "abstract", "fulltext")


def searchable(vectors: DataFrame, field: str) -> DataFrame:
    """(paper_id, embedding) of one embedding column; rows without it are left out, other columns are refused."""
    if field not in EMBEDDING_FIELDS:
        raise ValueError(f"no such embedding column: {field}; one of {', '.join(EMBEDDING_FIELDS)}")
    return vectors.select("paper_id", F.col(f"{field}_embedding").alias("embedding")).filter("embedding is not null")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, title (the first line), abstract (the whole text), keywords (a JSON list), tag, field."""
    keywords = F.concat(F.lit('["'), "source", F.lit('","'), "lang", F.lit('"]'))
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("paper_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"),
        keywords.alias("keywords"), F.col("source").alias("tag"), F.col("lang").alias("field"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, sort_order, body: a paper's sections are its text's lines with a word."""
    lines = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("sort_order", "body"))
    return lines.filter(F.trim("body") != "")


def paper_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, embedding; rows without a vector are left out."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), "embedding").filter("embedding is not null")


def section_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, section_type, embedding."""
    kind = F.element_at(F.array(*map(F.lit, SECTION_TYPES)), F.col("label").cast("int") + 1)
    return load(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null").select(F.expr("vec_id div 5").alias("paper_id"), kind.alias("section_type"), "embedding")


def viewpoint_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, embedding."""
    return load(spark, sf_dir, "embeddings").filter("embedding is not null").select(F.expr("vec_id div 7").alias("paper_id"), "embedding")


def catalogued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with dates: paper_id, ingested_at, publication_year, tag, status."""
    year = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderdate").alias("ingested_at"), year.alias("publication_year"), F.col("o_orderpriority").alias("tag"), F.col("o_orderstatus").alias("status"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per paper and cited work: paper_id, part, doi, score, relationship."""
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("part"))
    lines = lines.agg(F.max(F.col("l_discount") * 10).alias("score"), F.min("l_returnflag").alias("relationship"))
    return lines.withColumn("doi", F.concat(F.lit("10.0/"), F.col("part").cast("string")))


def viewpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, seq, category, viewpoint."""
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("seq"), F.col("role").alias("category"), F.col("text").alias("viewpoint"))


def scan_files(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """Files below a directory with their content and its SHA-256."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.withColumn("sha256", F.sha2("content", 256))


#: Fixed layout: a block of a layout parser's content list.
BLOCK_SCHEMA = "type string, text string, text_level int, img_path string, img_caption array<string>, table_body string, table_caption array<string>, page_idx int"


def scan_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of layout parser files (a JSON array each), in order: file, seq, block."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"array<struct<{BLOCK_SCHEMA.replace(' ', ':').replace(',:', ',')}>>").alias("blocks"))
    return raw.select("file", F.posexplode("blocks").alias("seq", "block"))


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """filename, is_scanned from a CSV with a truthy text column."""
    return spark.read.csv(path, header=True).select("filename", F.lower(F.trim("is_scanned")).isin("1", "true", "yes", "y").alias("is_scanned"))
