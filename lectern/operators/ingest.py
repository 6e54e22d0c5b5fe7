"""Papers with all their children, from nested rows to tables with ids and foreign keys, published together.

A paper is a row (key, title, doi, sections, references): sections are structs with heading, level, page_start, page_end, paragraphs and lists of tables (html,
markdown, caption, page), formulas (latex, type, page) and images (path, caption, page); references are structs with number, text, doi and a list of citations (page, sentence).

Ids follow the order of the papers' keys and, below a paper, of its lists. A range of keys is counted in one task, offsets of ranges are added (one
row a range), and a child's id is its paper's offset plus its place; so no counter runs on the driver, and a rerun gives the same ids however rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import stripped
from lectern.plans.shared import saved

#: Child tables, in the order in which they are written.
KINDS = ("sections", "tables", "formulas", "images", "references", "citations")


def _nested(outer: str, inner: str, keep: str) -> Column:
    """The inner structs of all outer ones as (owner, place, item): an owner's place, and an item's among all before those without content are dropped."""
    return F.expr(
        f"flatten(transform({outer}, (s, i) -> filter(transform(coalesce(s.{inner}, array()), (t, j) -> named_struct('owner', i, 'place', j, 'item', t)), x -> {keep})))"
    )


def flat_children(papers: DataFrame) -> DataFrame:
    """Papers with one list of structs for each kind of child; formulas without LaTeX and images without a path are left out."""
    none = lambda c: F.coalesce(F.col(c), F.array())
    rows = papers.select("key", "title", "doi", none("sections").alias("s"), none("references").alias("r"))
    plain = lambda c: F.expr(f"transform({c}, (s, i) -> named_struct('owner', i, 'place', i, 'item', s))")
    return rows.select(
        "key", "title", "doi", plain("s").alias("sections"), _nested("s", "tables", "true").alias("tables"), _nested("s", "formulas", "coalesce(x.item.latex, '') <> ''").alias("formulas"),
        _nested("s", "images", "coalesce(x.item.path, '') <> ''").alias("images"), plain("r").alias("references"), _nested("r", "citations", "true").alias("citations"),
    )


def numbered(rows: DataFrame, first: dict[str, int] | None = None) -> DataFrame:
    """Rows (key and lists) with ``paper_id`` and, for each kind, ``base_<kind>``: the ids that its children's places are added to. ``first`` has the ids to begin with; others begin with 1."""
    first, n = first or {}, max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = rows.select("key", *(F.size(k).cast("bigint").alias(k) for k in KINDS)).repartitionByRange(n, "key").withColumn("part", F.spark_partition_id())
    counts = saved(counts, "counts")
    in_range, ranges = Window.partitionBy("part").orderBy("key"), Window.orderBy("part")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.groupBy("part").agg(F.count(F.lit(1)).alias("paper"), *(F.sum(k).alias(k) for k in KINDS))
    offsets = offsets.select("part", *(F.coalesce(F.sum(k).over(before(ranges)), F.lit(0)).alias(f"from_{k}") for k in ("paper", *KINDS)))  # one row a range
    own = counts.withColumn("paper", F.row_number().over(in_range) - 1)
    own = own.select("key", "part", "paper", *(F.coalesce(F.sum(k).over(before(in_range)), F.lit(0)).alias(k) for k in KINDS)).join(offsets, "part")
    ids = own.select("key", (F.col("paper") + F.col("from_paper") + first.get("papers", 1)).alias("paper_id"), *((F.col(k) + F.col(f"from_{k}") + first.get(k, 1)).alias(f"base_{k}") for k in KINDS))
    return rows.join(ids, "key")


def paper_tables(papers: DataFrame, first: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The tables papers, sections, tables, formulas, images, references and citations, with ids, foreign keys and places; keys are unique."""
    rows = saved(numbered(flat_children(papers), first), "papers")
    child = lambda k: rows.select("paper_id", "base_sections", "base_references", f"base_{k}", F.posexplode(k).alias("at", "c"))
    own = lambda k: (F.col(f"base_{k}") + F.col("at")).alias("id")
    section, reference = ((F.col(f"base_{k}") + F.col("c.owner")).alias(f"{k[:-1]}_id") for k in ("sections", "references"))
    item, text = lambda c: F.col(f"c.item.{c}"), lambda c: F.coalesce(F.col(f"c.item.{c}"), F.lit("")).alias(c)
    page, place = F.coalesce(item("page"), F.lit(0)).cast("int").alias("page"), F.col("c.place").alias("sort_order")
    return {
        "papers": rows.select("paper_id", "key", "title", stripped(F.col("doi")).alias("doi")),
        "sections": child("sections").select(own("sections"), "paper_id", place, item("heading").alias("heading"), item("level").alias("level"), item("page_start").alias("page_start"), item("page_end").alias("page_end"), F.array_join(item("paragraphs"), "\n\n").alias("body_text")),
        "tables": child("tables").select(own("tables"), section, "paper_id", place, text("html"), text("markdown"), text("caption"), page),
        "formulas": child("formulas").select(own("formulas"), section, "paper_id", place, text("latex"), F.when(F.coalesce(item("type"), F.lit("")) == "", "block").otherwise(item("type")).alias("formula_type"), page),
        "images": child("images").select(own("images"), section, "paper_id", place, item("path").alias("image_path"), text("caption"), page),
        "references": child("references").select(own("references"), "paper_id", place, item("number").alias("number"), text("text"), stripped(item("doi")).alias("doi")),
        "citations": child("citations").select(own("citations"), reference, "paper_id", place, page, text("sentence")),
    }


class Publication:
    """Tables that are written into one version's folder and count together once its marker is there; a failed write leaves the last version as it was."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _folders(self) -> list[int]:
        fs, root = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def versions(self) -> list[int]:
        out = []
        for v in self._folders():
            fs, marker = self._fs(f"{self.root}/v{v}/published")
            if fs.exists(marker):
                out.append(v)
        return out

    def publish(self, tables: dict[str, DataFrame]) -> int:
        version = (self._folders() or [0])[-1] + 1
        for name, rows in tables.items():
            rows.write.mode("error").parquet(f"{self.root}/v{version}/{name}")
        fs, marker = self._fs(f"{self.root}/v{version}/published")
        fs.create(marker, False).close()
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{version or self.versions()[-1]}/{name}")
