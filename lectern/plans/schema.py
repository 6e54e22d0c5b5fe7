"""The store's tables: their columns, creation, and migration of older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.plans.store import VersionedTable

VERSION = 8
VECTOR = "array<float>"
#: The columns of each table.
TABLES = {
    "papers": "paper_id bigint, sha256 string, title string, abstract string, doi string, keywords string, publication_year int, ingested_at timestamp, llm_summary string, llm_research_field string, "
    f"llm_methodology string, llm_key_findings array<string>, llm_analyzed_at timestamp, title_embedding {VECTOR}, abstract_embedding {VECTOR}, fulltext_embedding {VECTOR}, summary_embedding {VECTOR}",
    "sections": f"section_id bigint, paper_id bigint, heading string, level int, body string, page_start int, page_end int, sort_order int, section_type string, section_embedding {VECTOR}",
    "section_chunks": f"section_id bigint, chunk_idx int, text string, char_start int, char_end int, chunk_embedding {VECTOR}",
    "references": f"reference_id bigint, paper_id bigint, number bigint, text string, title string, authors array<string>, year string, identifiers map<string,string>, score double, relationship string, ref_embedding {VECTOR}",
    "citations": "citation_id bigint, paper_id bigint, reference_id bigint, page int, x double, y double, text string, sentence string",
    "tags": "tag_id bigint, name string",
    "paper_tags": "paper_id bigint, tag_id bigint",
    "viewpoints": f"viewpoint_id bigint, paper_id bigint, category string, viewpoint string, viewpoint_embedding {VECTOR}",
    "shared_citations": "paper_a bigint, paper_b bigint, title string, doi string, confidence double, relationship string, similarity double, explanation string",
}
KEYS = {"papers": ["paper_id"], "sections": ["section_id"], "section_chunks": ["section_id", "chunk_idx"], "references": ["reference_id"], "citations": ["citation_id"], "tags": ["tag_id"], "paper_tags": ["paper_id", "tag_id"], "viewpoints": ["viewpoint_id"], "shared_citations": ["paper_a", "paper_b", "title"]}


def table(spark: SparkSession, root: str, name: str) -> VersionedTable:
    return VersionedTable(spark, f"{root}/{name}", KEYS[name])


def migrated(df: DataFrame, name: str) -> DataFrame:
    """Rows of an older table with all columns of today's, absent ones null, in order; columns unknown today stay behind them."""
    wanted = StructType.fromDDL(TABLES[name])
    have = set(df.columns)
    known = [(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted]
    return df.select(*known, *(c for c in df.columns if c not in wanted.names))


def create(spark: SparkSession, root: str) -> int:
    """Make the tables that are missing and bring older ones up to date; nothing changes a second time. Returns the version."""
    for name, columns in TABLES.items():
        store = table(spark, root, name)
        if not store.versions():
            store.replace(spark.createDataFrame([], columns))
        elif not set(StructType.fromDDL(columns).names) <= set(store.read().columns):
            store.replace(migrated(store.read(), name))
    versions = VersionedTable(spark, f"{root}/schema_version", ["version"])
    versions.insert_ignore(spark.createDataFrame([(VERSION,)], "version int"))
    return version(spark, root)


def version(spark: SparkSession, root: str) -> int:
    """The greatest version on record, 0 where there is none."""
    store = VersionedTable(spark, f"{root}/schema_version", ["version"])
    return (store.read().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]) if store.versions() else 0
