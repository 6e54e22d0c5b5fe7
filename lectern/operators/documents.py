"""Document structure: sections from lines, chunks from paragraphs, citations to sections, page statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.shared import saved

#: A text up to WHOLE is one chunk; larger ones are cut at paragraphs after TARGET, within CAP; a chunk's input is cut at INPUT.
WHOLE, TARGET, CAP, INPUT = 8000, 4000, 8000, 16000
#: A PDF's first pages, and the characters below which it counts as scanned.
SNIFF_PAGES, SPARSE_MEAN, SPARSE_PAGE = 5, 500, 100


def sections(lines: DataFrame, is_heading: Column) -> DataFrame:
    """(paper_id, section, heading, n_lines, n_chars): lines between headings, from (paper_id, seq, line).

    A heading right below another joins it; lines before the first heading are section 0.
    """
    order = Window.partitionBy("paper_id").orderBy("seq")
    marked = lines.withColumn("h", is_heading).withColumn("opens", F.col("h") & ~F.coalesce(F.lag("h").over(order), F.lit(False)))
    numbered = marked.withColumn("section", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    heading = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("h"), F.struct("seq", "line")))), lambda x: x["line"]), " ")
    body = F.when(~F.col("h"), F.length("line"))
    return numbered.groupBy("paper_id", "section").agg(heading.alias("heading"), F.count(body).alias("n_lines"), F.coalesce(F.sum(body), F.lit(0)).alias("n_chars"))


def chunks(paragraphs: Column) -> Column:
    """Array of chunks: paragraphs are joined until a chunk reaches the target; none is cut, save for the input limit."""
    joined = F.array_join(paragraphs, "\n\n")
    state = "struct<done:array<string>,now:string>"
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now")).cast(state)

    def add(acc: Column, p: Column) -> Column:
        both = F.concat_ws("\n\n", acc["now"], p)
        full = acc["now"].isNotNull() & ((F.length(acc["now"]) >= TARGET) | (F.length(both) > CAP))
        return F.when(full, F.struct(F.array_append(acc["done"], acc["now"]).alias("done"), p.alias("now"))).otherwise(F.struct(acc["done"].alias("done"), both.alias("now"))).cast(state)

    packed = F.aggregate(paragraphs, empty, add, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))
    out = F.when(F.length(joined) <= WHOLE, F.array(joined)).otherwise(packed)
    return F.transform(out, lambda c: F.substring(c, 1, INPUT))


#: Rows of either side that are joined in one task, about.
JOINED_ROWS = 250_000


def located(citations: DataFrame, section_pages: DataFrame, per_task: int = JOINED_ROWS) -> DataFrame:
    """Citations (paper_id, citation, page) with the first section (section, page_start, page_end) that spans the page.

    Both sides are dealt by paper to as many tasks as their rows ask for, so what a task sorts and holds doesn't grow with the table.
    """
    n = max(int(citations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(citations.count(), section_pages.count()) // per_task))
    citations, section_pages = citations.repartition(n, "paper_id"), section_pages.repartition(n, "paper_id")
    on = (F.col("c.paper_id") == F.col("s.paper_id")) & (F.col("page") >= F.col("page_start")) & (F.col("page") <= F.col("page_end"))
    found = citations.alias("c").join(section_pages.alias("s"), on, "left").groupBy(F.col("c.paper_id").alias("paper_id"), "citation")
    return found.agg(F.min("section").alias("section"))


#: Parts that a range of values is cut into to find a rank, and the ranks that page statistics ask for, as shares of a group.
RANGE_PARTS, SHARES = 1024, {"median": 0.5, "p10": 0.1, "p25": 0.25}


def order_statistics(rows: DataFrame, by: str, value: str, shares: dict[str, float], parts: int = RANGE_PARTS) -> DataFrame:
    """(by, and a column for each share): exact percentiles of a whole-numbered column in every group, between neighbouring ranks in proportion.

    Values are counted once; then each rank's range is cut into ``parts``, and only the part that holds the rank is looked at again, until parts are single
    values: three or four rounds for any table. A group is only ever counts in ranges, so one group of all rows is spread over all tasks. Nulls don't
    count; a group of nulls has none.
    """
    counts = saved(rows.select(F.col(by).alias("g"), F.col(value).cast("bigint").alias("v")).filter("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), "counts")
    span = counts.groupBy("g").agg(F.min("v").alias("base"), F.max("v").alias("top"), F.sum("n").alias("total"))
    widest = span.agg(F.max(F.col("top") - F.col("base"))).first()[0]
    place = lambda p: (F.col("total") - 1) * F.lit(p)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in shares.values()))))
    found = span.select(F.col("g").alias("k"), "base", F.explode(ranks).alias("rank"), F.lit(0).cast("bigint").alias("before"))
    width = 1
    while width <= (widest or 0):
        width *= parts
    while width > 1:
        size = width // parts
        met = counts.join(found, F.col("g").eqNullSafe(F.col("k"))).filter((F.col("v") >= F.col("base")) & (F.col("v") < F.col("base") + width))
        met = met.groupBy("k", "rank", "base", "before", F.expr(f"(v - base) div {size}").alias("part")).agg(F.sum("n").alias("n"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("k", "rank").orderBy("part"))  # ``parts`` rows at most
        met = met.withColumn("upto", upto).filter(F.col("upto") > F.col("rank"))
        least = met.groupBy("k", "rank").agg(F.min(F.struct("part", "base", "upto", "n")).alias("m"))
        found = saved(least.select("k", (F.col("m.base") + F.col("m.part") * size).alias("base"), "rank", (F.col("m.upto") - F.col("m.n")).alias("before")), "ranks")
        width = size
    values = found.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "base"))).alias("at"))  # two ranks a share
    out = values.join(span.select("g", "total"), F.col("g").eqNullSafe(F.col("k")))
    low = lambda p: F.element_at("at", F.floor(place(p)))
    return out.select(F.col("g").alias(by), *((low(p) + (place(p) - F.floor(place(p))) * (F.element_at("at", F.ceil(place(p))) - low(p))).alias(name) for name, p in shares.items()))


def page_statistics(pages: DataFrame, by: str) -> DataFrame:
    """Mean, median, percentiles and shares of sparse pages, from (by, n_chars)."""
    sparse = lambda n: F.avg(F.when(F.col("n_chars") < n, 1.0).otherwise(0.0))
    sums = pages.groupBy(F.col(by).alias("_k")).agg(
        F.count(F.lit(1)).alias("pages"), F.avg("n_chars").alias("mean"), sparse(50).alias("under_50"), sparse(100).alias("under_100"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most")
    )
    ranks = order_statistics(pages, by, "n_chars", SHARES)
    both = sums.join(ranks, F.col("_k").eqNullSafe(F.col(by)), "left")
    return both.select(F.col("_k").alias(by), "pages", "mean", *SHARES, "under_50", "under_100", "least", "most")


def backend(pages: DataFrame, by: str) -> DataFrame:
    """(by, backend): layout for documents whose first pages hold little text, else text; from (by, page, n_chars)."""
    first = pages.filter(F.col("page") < SNIFF_PAGES).groupBy(by).agg(F.avg("n_chars").alias("mean"), F.avg(F.when(F.col("n_chars") < SPARSE_PAGE, 1.0).otherwise(0.0)).alias("sparse"))
    return first.select(by, F.when((F.col("mean") < SPARSE_MEAN) | (F.col("sparse") > 0.5), "layout").otherwise("text").alias("backend"))


#: Distinct values in one range of a sorted pass.
RANGE_VALUES = 1_000_000


def _ranges(by: DataFrame, per_range: int) -> tuple[DataFrame, DataFrame]:
    """Rows of distinct values dealt to sorted ranges (``part``), and for each range the last value before and the first after it."""
    n = max(2, -(-by.count() // per_range))
    dealt = saved(by.repartitionByRange(n, "value").withColumn("part", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy("part").agg(F.min("value").alias("first"), F.max("value").alias("last"))
    order = Window.orderBy("part")  # one row per range
    return dealt, ends.select("part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))


def best_threshold(samples: DataFrame, per_range: int = RANGE_VALUES) -> DataFrame:
    """(threshold, accuracy): the best cut of ``value`` that calls rows below it ``positive``; the least of equals.

    Counts by distinct value and running sums, range by range, replace a sweep of every threshold over every sample.
    """
    by = samples.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("positive").cast("int")).alias("p"))
    dealt, ends = _ranges(by, per_range)
    sums, order = dealt.groupBy("part").agg(F.sum("n").alias("sn"), F.sum("p").alias("sp")), Window.orderBy("part")
    earlier, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = sums.select(  # one row per range
        "part", F.coalesce(F.sum("sn").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("sp").over(earlier), F.lit(0)).alias("p0"), F.sum("sn").over(every).alias("all_n"), F.sum("sp").over(every).alias("all_p"),
    )
    inner = Window.partitionBy("part").orderBy("value")
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.join(ends, "part").join(sums, "part").withColumn("mid", (F.col("value") + F.coalesce(F.lead("value").over(inner), F.col("after"))) / 2)
    rows = rows.withColumn("tp", F.col("p0") + F.sum("p").over(upto)).withColumn("below", F.col("n0") + F.sum("n").over(upto))
    right = F.col("tp") + (F.col("all_n") - F.col("below")) - (F.col("all_p") - F.col("tp"))
    rows = rows.withColumn("accuracy", right / F.col("all_n")).filter("mid is not null")
    return rows.orderBy(F.desc(F.round("accuracy", 12)), "mid").limit(1).select(F.col("mid").alias("threshold"), "accuracy")


def largest_gap(values: DataFrame, per_range: int = RANGE_VALUES) -> DataFrame:
    """(low, high, gap): neighbours of the sorted distinct values that lie furthest apart."""
    dealt, ends = _ranges(values.select("value").filter("value is not null").distinct(), per_range)
    low = F.coalesce(F.lag("value").over(Window.partitionBy("part").orderBy("value")), F.col("before"))
    gaps = dealt.join(ends, "part").select(low.alias("low"), F.col("value").alias("high")).filter("low is not null")
    return gaps.withColumn("gap", F.col("high") - F.col("low")).orderBy(F.desc("gap"), "low").limit(1)


def table_markdown(html: Column) -> Column:
    """An HTML table's rows as Markdown rows: cells stripped of tags, bars escaped."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cell = lambda c: F.trim(F.replace(F.regexp_replace(c, "<[^>]+>", ""), F.lit("|"), F.lit("\\|")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), cell), " | "), F.lit(" |"))
    return F.array_join(F.transform(rows, line), "\n")


def citation_numbers(text: Column) -> Column:
    """Numbers cited in brackets, ranges expanded, once each and sorted."""
    from lectern.functions.text import expanded_numbers

    groups = F.regexp_extract_all(text, F.lit(r"[\[(［](\d+(?:\s*[,-]\s*\d+)*)[\])］]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(groups, expanded_numbers))))
