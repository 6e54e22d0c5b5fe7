"""From lines with positions to sections with paragraphs.

Lines are rows (doc, page, column, seq, x, y, height, text), pages counted from 0. Everything is window plans over a document's lines in reading order,
with one partitioning by document; lines with their headings are written once, for heads and paragraphs; only a section's own paragraphs are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import matches, stripped
from lectern.operators.extraction import is_noise
from lectern.operators.layout import is_equation, is_heading, level
from lectern.plans.shared import saved

#: Names of a list of references, and how far apart paragraphs stand, in heights of body text, and their least length.
LISTS, GAP, INDENT, SHORTEST = ["references", "bibliography", "参考文献", "reference list"], 2.5, 1.5, 10


def is_list_heading(text: Column) -> Column:
    """Whether a heading opens the list of references."""
    t = stripped(F.regexp_replace(F.lower(stripped(text)), "[.:]+$", ""))
    return t.isin(LISTS) | matches(t, r"^(?:\d+\.\s+)?(?:references|bibliography)\b")


def _most(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows with the height (to a tenth) that most lines of their group have, the first of equals by ``place``."""
    same = Window.partitionBy(*key, "_h")
    counted = rows.withColumn("_h", F.bround("height", 1)).withColumn("_c", F.struct((-F.count(F.lit(1)).over(same)).alias("n"), F.min("place").over(same).alias("at"), F.col("_h").alias("h")))
    return counted.withColumn(name, F.min("_c").over(Window.partitionBy(*key))["h"]).drop("_h", "_c")


def marked_headings(lines: DataFrame) -> DataFrame:
    """Lines without noise, with their ``place``, whether they are a heading (``head``) and the ``level``; past the heading of references, only such headings count."""
    order = Window.partitionBy("doc").orderBy("page", "column", "y", "x", "seq")
    rows = lines.withColumn("text", stripped(F.col("text"))).filter("text <> ''").filter(~is_noise(F.col("text"))).withColumn("place", F.row_number().over(order))
    rows = _most(rows, ["doc"], "body")
    rows = rows.withColumn("head", is_heading(F.col("text"), F.col("height"), F.col("body"), noise=False)).withColumn("lists", F.col("head") & is_list_heading(F.col("text")))
    inside = F.coalesce(F.max("lists").over(Window.partitionBy("doc").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return rows.withColumn("head", F.col("head") & (F.col("lists") | ~inside)).withColumn("level", level(F.col("text"), F.col("height"), F.col("body")))


def section_paragraphs(marked: DataFrame) -> DataFrame:
    """(doc, section, paragraph, text): body lines of each section, joined until the next one is far below or set in; hyphens at line ends close up.

    A piece of an equation is left out, save as a section's first line; paragraphs of ten characters or fewer are dropped.
    """
    within = Window.partitionBy("doc", "section").orderBy("place")
    rows = _most(marked.filter(~F.col("head")).select("doc", "section", "place", "x", "y", "height", "text"), ["doc", "section"], "body")
    rows = rows.withColumn("was", F.lag(F.struct("x", "y", "height", "text")).over(within))
    apart = (F.abs(F.col("y") - F.col("was.y") - F.col("was.height")) > F.col("body") * GAP) | (F.col("x") - F.col("was.x") > F.col("body") * INDENT)
    rows = rows.filter(F.col("was").isNull() | ~is_equation(F.col("text"))).withColumn("opens", F.coalesce(apart, F.lit(False)))
    rows = rows.withColumn("paragraph", F.sum(F.col("opens").cast("int")).over(within))
    glued = ~F.col("opens") & F.coalesce(F.col("was.text").endswith("-"), F.lit(False))
    parts = F.array_sort(F.collect_list(F.struct("place", F.concat(F.when(glued, "\u0001").otherwise(" "), "text").alias("t"))))
    text = F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["t"]), ""), "-*\u0001", "")
    return rows.groupBy("doc", "section", "paragraph").agg(stripped(text).alias("text")).filter(F.length("text") > SHORTEST)


def sections(lines: DataFrame) -> DataFrame:
    """(doc, section, heading, level, page_start, page_end, paragraphs): a section from each heading to the next; pages count from 1.

    Lines before the first heading belong to none. Neighbouring sections with one heading are one section with the first one's level and first page.
    """
    order = Window.partitionBy("doc").orderBy("place")
    marked = marked_headings(lines).withColumn("section", F.sum(F.col("head").cast("int")).over(order)).filter("section > 0")
    marked = saved(marked.select("doc", "section", "place", "page", "x", "y", "height", "text", "head", "level"), "marked")
    heads = marked.groupBy("doc", "section").agg(
        F.max(F.when(F.col("head"), F.col("text"))).alias("heading"), F.max(F.when(F.col("head"), F.col("level"))).alias("level"), (F.min("page") + 1).alias("page_start"), (F.max("page") + 1).alias("page_end")
    )
    by_section = Window.partitionBy("doc").orderBy("section")
    new = F.coalesce(F.col("heading") != F.lag("heading").over(by_section), F.lit(True))
    heads = heads.withColumn("new", new.cast("int")).withColumn("merged", F.sum("new").over(by_section))
    texts = section_paragraphs(marked).groupBy("doc", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda p: p["text"]).alias("paragraphs"))
    both = heads.join(texts, ["doc", "section"], "left")
    none = F.array().cast("array<string>")
    gathered = F.array_sort(F.collect_list(F.struct("section", F.coalesce("paragraphs", none).alias("p"))))
    first = lambda c: F.min_by(c, "section").alias(c)
    out = both.groupBy("doc", "merged").agg(first("heading"), first("level"), first("page_start"), F.max("page_end").alias("page_end"), F.flatten(F.transform(gathered, lambda g: g["p"])).alias("paragraphs"))
    return out.withColumnRenamed("merged", "section")
