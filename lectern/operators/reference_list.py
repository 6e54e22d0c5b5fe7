"""Where a document's list of references stands, and its entries, from lines with positions.

Lines are rows (doc, page, seq, x, y, width, height, text), perhaps with ``heights`` (of a line's spans) and ``url``; pages are rows
(doc, page, width, height), counted from 0; y grows downward. A document is read from its last line backward. All states of that scan are
window sums and last values over a document's lines in that order, so a document is never folded in one piece, and all windows share one
partitioning by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.fixed import LEAST_PAGES, LOADED_PAGES, PAGE_MIDDLE, TALLER_SPAN
from lectern.functions.text import matches, reference_type, stripped
from lectern.operators.extraction import parsed
from lectern.operators.layout import grown_columns, is_caption


def _tight(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def opens_references(text: Column) -> Column:
    """Whether a short line names a list of references."""
    t = _tight(text)
    return matches(t, "(参考文献|reference|bibliography)", any_case=True) & (F.length(t) < 20)


def running_heads(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines with ``head``: outside the middle of the page in both directions, with another page at hand that has the same text, but
    for digits, blanks and short capitals, at the same place.

    At hand are the last three pages and those after the line's own; the size of a page is the largest of those.
    """
    by_doc = Window.partitionBy("doc")
    back = by_doc.orderBy(F.desc("page"))
    # Pages stand among the lines, so that one partitioning by document serves both; lines of pages that aren't there are left out.
    sheets = pages.select("doc", "page", F.col("width").alias("_w"), F.col("height").alias("_h"), F.lit(True).alias("_sheet"))
    sized = lines.unionByName(sheets, allowMissingColumns=True).repartition("doc").withColumn("total", F.max(F.when(F.col("_sheet"), F.col("page"))).over(by_doc) + 1)
    late = F.col("page") >= F.col("total") - LOADED_PAGES
    for c in ("w", "h"):
        sized = sized.withColumn(f"page_{c}", F.greatest(F.max(f"_{c}").over(back), F.max(F.when(late, F.col(f"_{c}"))).over(by_doc), F.lit(1.0)))
    there = F.max("_sheet").over(Window.partitionBy("doc", "page"))
    placed = sized.withColumn("_there", there).filter(F.col("_there") & F.col("_sheet").isNull()).drop("_w", "_h", "_sheet", "_there")
    lo, hi = PAGE_MIDDLE
    inside = (F.col("x") > lo * F.col("page_w")) & (F.col("y") > lo * F.col("page_h")) & (F.col("x") + F.col("width") < hi * F.col("page_w")) & (F.col("y") + F.col("height") < hi * F.col("page_h"))
    plain = F.when(F.col("text").rlike("^[A-Z]{1,3}$"), "").otherwise(F.regexp_replace(F.col("text"), r"(?U)\s+|\d+", ""))
    placed = placed.withColumn("_key", F.struct(plain.alias("t"), *(F.bround(c, 0).alias(c) for c in ("x", "y", "width", "height"))))
    same = Window.partitionBy("doc", "_key")
    after = F.max("page").over(same) > F.col("page")
    before = late & (F.min(F.when(late, F.col("page"))).over(same) < F.col("page"))
    return placed.withColumn("head", ~inside & (after | F.coalesce(before, F.lit(False)))).drop("_key", "page_w", "page_h")


def _started(lines: DataFrame) -> DataFrame:
    """The lines of each page down to its last line at the bottom right; none of a page that ends in a figure."""
    page = Window.partitionBy("doc", "page")
    below = page.orderBy(F.desc("y")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    right, value = F.col("x") + F.col("width"), F.struct("x", "y", "width", "height", "text")
    marked = lines.withColumn("_r", right).withColumn("_v", value)
    widest = F.max(F.struct("_r", "_v")).over(below) == F.struct("_r", "_v")
    alone = F.min(F.struct((-F.col("_r")).alias("_r"), "_v")).over(below) == F.struct((-F.col("_r")).alias("_r"), "_v")
    marked = marked.withColumn("_end", F.when(widest & alone, F.col("seq")))
    marked = marked.withColumn("_end", F.coalesce(F.max("_end").over(page), F.max("seq").over(page)))
    figure = F.max(F.when(F.col("seq") == F.col("_end"), _tight(F.col("text")).rlike(r"(图|fig|Fig|Figure).*\d+"))).over(page)
    return marked.withColumn("_figure", figure).filter((F.col("seq") <= F.col("_end")) & ~F.col("_figure")).drop("_r", "_v", "_end", "_figure")


def text_parts(lines: DataFrame, pages: DataFrame, full_text: bool = False) -> DataFrame:
    """Lines in parts of one kind of text, numbered from a document's end, with ``finished``, ``listed`` (a reference heading stands above the part) and
    ``x`` from the left edge of the part's column (``page_x`` is the line's own).

    A part ends where the height of letters changes or a gap of three lines opens, and below a heading of references; what
    stands above such a heading on its page isn't read. With ``full_text``, headings of references count as text and
    the first page is read too.
    """
    rows = lines if "heights" in lines.columns else lines.withColumn("heights", F.array("height"))
    rows = rows if "url" in rows.columns else rows.withColumn("url", F.lit(None).cast("string"))
    rows = running_heads(rows, pages).filter(~F.col("head") & ~is_caption(F.col("text")))
    rows = rows.filter(F.col("page") >= (0 if full_text else 1)).filter(F.col("total") >= LEAST_PAGES)
    rows = _started(grown_columns(rows))
    scan = Window.partitionBy("doc").orderBy(F.desc("page"), F.desc("seq"))
    page = Window.partitionBy("doc", "page")
    rows = rows.withColumn("low", F.array_min("heights")).withColumn("high", F.array_max("heights"))
    rows = rows.withColumn("was", F.lag(F.struct("page", "column", "y", "height", "low")).over(scan)).withColumn("pos", F.row_number().over(page.orderBy(F.desc("seq"))))
    # Whether letters of the line before, in the order of the scan, are no taller than those of this one.
    level = F.col("was.low") - F.col("high") < F.least("was.low", "high") * TALLER_SPAN
    rows = rows.withColumn("level", level).withColumn("brk", F.lit(False) if full_text else opens_references(F.col("text")))
    rows = rows.withColumn("first_level", F.min(F.when((F.col("pos") > 1) & F.col("level"), F.col("pos"))).over(page))
    rows = rows.withColumn("any_brk", F.min(F.when(F.col("brk"), F.col("pos"))).over(page))
    rows = rows.withColumn("late_brk", F.min(F.when(F.col("brk") & (F.col("pos") >= F.col("first_level")), F.col("pos"))).over(page))
    # A page that begins with a change of height is read on, heading or not, until heights agree; unless the page before it ended
    # at a heading. So whether a page ends at a heading may depend on the one before: the last page for which it doesn't decides.
    opening = F.col("pos") == 1
    sure = F.when(F.coalesce("level", F.lit(True)) | (F.col("any_brk").isNotNull() == F.col("late_brk").isNotNull()), F.col("any_brk").isNotNull())
    rows = rows.withColumn("sure", F.when(opening, sure))
    rows = rows.withColumn("broken", F.when(opening, F.coalesce(F.last("sure", ignorenulls=True).over(scan.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))))
    rows = rows.withColumn("broken", F.max("broken").over(page)).withColumn("changed", F.max(F.when(opening, ~F.coalesce("level", F.lit(True)) & ~F.col("broken"))).over(page))
    rows = rows.withColumn("stop", F.when(F.col("changed"), F.col("late_brk")).otherwise(F.col("any_brk")))
    rows = rows.filter(F.col("stop").isNull() | (F.col("pos") <= F.col("stop"))).withColumn("heading", F.coalesce(F.col("pos") == F.col("stop"), F.lit(False)))
    alone = lambda pos: F.col("changed") & (F.col("first_level").isNull() | (pos < F.col("first_level")))
    gap = (F.col("column") == F.col("was.column")) & (F.abs(F.col("y") - F.col("was.y")) > 3 * F.col("was.height"))
    opens = F.when(opening, F.col("was").isNull() | F.col("broken") | F.col("changed")).otherwise(alone(F.col("pos")) | (~alone(F.col("pos") - 1) & (~F.col("level") | gap)))
    rows = rows.withColumn("part", F.sum(F.when(F.col("heading"), 0).otherwise(opens.cast("int"))).over(scan.rowsBetween(Window.unboundedPreceding, 0)))
    # A heading ends the part below it, if one is open.
    ends = F.col("heading") & (~opening | (F.col("was").isNotNull() & ~F.col("broken")))
    parts = Window.partitionBy("doc", "part")
    rows = rows.withColumn("listed", F.max(ends).over(parts)).withColumn("last", F.max("part").over(Window.partitionBy("doc")))
    rows = rows.filter(~F.col("heading") & (F.col("part") > 0)).withColumn("finished", F.col("listed") | (F.col("part") < F.col("last")))
    left = F.min("x").over(Window.partitionBy("doc", "part", "page", "column"))
    rows = rows.withColumn("page_x", F.col("x")).withColumn("x", F.bround(F.col("x") - left, 1))
    return rows.select("doc", "part", "finished", "listed", "page", "column", "seq", "x", "page_x", "y", "width", "height", "text", "url")


def reference_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """The lines of each document's list of references: (doc, page, column, seq, x, page_x, y, width, height, text, url).

    From the end, parts below a heading of references count until one's first line has number 1 or none. Where there is no such
    part, it is the finished part with most lines that begin like entries, the last one of equals. Documents of fewer than three pages have none.
    """
    rows = text_parts(lines, pages).filter("finished")
    part = Window.partitionBy("doc", "part")
    number = F.regexp_extract(stripped(F.min(F.struct("page", "seq", "text")).over(part)["text"]), r"(?U)^\d+", 0)
    rows = rows.withColumn("whole", F.col("listed") & number.isin("", "1")).withColumn("score", F.sum((reference_type(F.col("text")) >= 0).cast("int")).over(part))
    by_doc = Window.partitionBy("doc")
    rows = rows.withColumn("until", F.min(F.when(F.col("whole"), F.col("part"))).over(by_doc))
    rows = rows.withColumn("best", F.min(F.struct((-F.col("score")).alias("s"), "part")).over(by_doc)["part"])
    chosen = F.when(F.col("until").isNotNull(), F.col("listed") & (F.col("part") <= F.col("until"))).otherwise(F.col("part") == F.col("best"))
    return rows.filter(chosen).drop("part", "finished", "listed", "whole", "score", "until", "best")


def reference_entries(lines: DataFrame) -> DataFrame:
    """(doc, entry, text, url, x, y): the lines of a list joined to entries.

    The first line sets the kind of beginning, and with the first line at another place nearby the indent (positive: entries stand further in than what
    continues them). Lines of that kind begin an entry if it is a bracketed kind, or stands at the first line's place where there is no
    indent, or has a line in the list at the distance of the indent. In the last tenth, a line far from where it should continue its entry ends the
    list. Lines before any entry stay alone. Hyphens at line ends close up.
    """
    order = Window.partitionBy("doc").orderBy("page", "seq")
    by_doc = Window.partitionBy("doc")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = lines.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(by_doc)).withColumn("kind", reference_type(F.col("text")))
    rows = rows.withColumn("head", F.first(F.struct("x", "height", "kind")).over(every)).withColumn("places", F.collect_set("x").over(by_doc))
    near = (F.col("i") > 0) & (F.col("x") != F.col("head.x")) & (F.abs(F.col("x") - F.col("head.x")) < 10 * F.col("head.height"))
    second = F.min(F.when(near, F.struct("i", "x"))).over(by_doc)["x"]
    rows = rows.withColumn("indent", F.coalesce(F.col("head.x") - second, F.lit(0.0)))
    size, x, height = F.abs("indent"), F.col("x"), F.col("height")
    same = F.col("kind") == F.col("head.kind")
    apart = F.exists("places", lambda p: ((x - p) * F.col("indent") > 0) & (F.abs(x - p) >= size) & (F.abs(F.abs(x - p) - size) < 2 * height))
    begins = same & ((F.col("head.kind") <= 2) | F.when(F.col("indent") == 0, (F.col("kind") != -1) & (F.abs(F.col("head.x") - x) < height * 0.5)).otherwise(apart))
    rows = rows.withColumn("begins", begins).withColumn("entry", F.sum(F.col("begins").cast("int")).over(order))
    own = F.last(F.when(F.col("begins"), x), ignorenulls=True).over(order)
    stray = ~F.col("begins") & (F.col("entry") > 0) & (F.col("i") / F.col("n") > 0.9) & (F.abs(F.abs(own - x) - size) > 5 * height)
    rows = rows.withColumn("stray", F.max(stray.cast("int")).over(order)).filter("stray = 0")
    # Lines before any entry count backward from 0.
    rows = rows.withColumn("entry", F.when(F.col("entry") == 0, F.col("i") - F.max(F.when(F.col("entry") == 0, F.col("i"))).over(by_doc)).otherwise(F.col("entry")))
    parts = F.array_sort(F.collect_list(F.struct("i", "text")))
    whole = F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["text"]), "\u0001"), "-+\u0001", "")
    out = rows.groupBy("doc", "entry").agg(
        F.replace(whole, F.lit("\u0001"), F.lit(" ")).alias("text"), F.max(F.when(F.coalesce("url", F.lit("")) != "", F.struct("i", "url")))["url"].alias("url"),
        F.min(F.struct("i", "page_x"))["page_x"].alias("x"), F.min(F.struct("i", (F.col("y") + F.col("height")).alias("y")))["y"].alias("y"),
    )
    return out.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("entry")).alias("entry"), "text", "url", "x", "y")


def unnumbered(text: Column) -> Column:
    """An entry without the number in front of it."""
    t = F.regexp_replace(stripped(text), r"(?U)^[^0-9a-zA-Z]\s*\d+\s*[^0-9a-zA-Z]", "")
    return stripped(F.regexp_replace(t, r"(?U)^\d+[.\s]?", ""))


def references(lines: DataFrame, pages: DataFrame, this_year: Column | None = None) -> DataFrame:
    """(doc, entry, number, text, title, authors, year, venue, identifiers, url, kind, x, y): from lines to parsed references in one call."""
    entries = reference_entries(reference_lines(lines, pages)).withColumnRenamed("url", "link")
    out = parsed(entries.withColumn("raw", F.col("text")).withColumn("text", unnumbered(F.col("text"))), this_year=this_year, number_from="raw")
    return out.withColumn("url", F.coalesce("link", "url")).drop("raw", "link")
