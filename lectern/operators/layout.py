"""Lines with positions: reading order, headings and levels, equations, captions, columns, running heads; as window plans over rows of lines.

Lines are rows (doc, page, seq, x, y, width, height, text); y grows downward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.fixed import SECTION_HEADINGS
from lectern.functions.text import matches, stripped
from lectern.operators.extraction import is_noise

#: Characters of mathematics, signs of equations, and letters that fonts put in place of brackets.
MATH, EQUALS, BRACKETS = "∑∫∏√∞≈≠≤≥±×÷∂∇∆∈∉⊂⊆∪∩∧∨→⇒↔∀∃∄‖∣⌊⌋⌈⌉⟨⟩¼½¾°§†‡¶", "=¼≈≃", "ðþ"
#: Headings without a number that open a section of the first level.
TOP_HEADINGS = [
    "introduction", "method", "methods", "methodology", "result", "results", "discussion", "conclusion", "conclusions", "references", "bibliography", "abstract", "acknowledgment", "acknowledgements",
    "acknowledgement", "appendix", "background", "related work", "experimental", "experiment", "experiments", "evaluation", "implementation",
    "引言", "方法", "结果", "讨论", "结论", "摘要", "参考文献", "致谢", "相关工作", "背景", "实验", "分析", "总结",
]
#: How much higher than body text a heading is, and the middle of a page, where lines never run from page to page.
TALLER, MIDDLE = 1.3, (0.2, 0.8)


def _holds(x: Column, characters: str) -> Column:
    return F.length(F.translate(x, characters, "")) < F.length(x)


def is_equation(text: Column) -> Column:
    """Whether a line is a piece of an equation: signs of mathematics in a short line, stray brackets, bare numbers, or words of one letter."""
    t = stripped(text)
    words = F.split(t, r"\s+")
    single = F.size(F.filter(words, lambda w: F.length(w) == 1))
    tests = [
        t == "",
        _holds(t, MATH) & (F.length(t) < 60),
        _holds(t, EQUALS) & matches(t, "[∑∫√∞≈≠≤≥±×÷∂∇∆ðþ]"),
        _holds(t, BRACKETS) & (F.length(t) < 120),
        (F.length(t) < 30) & t.rlike(r"[\x{1D400}-\x{1D7FF}]"),
        (F.length(t) < 20) & t.rlike(r"^[\d\s.,;:!?+\-*/=><()\[\]{}|\\]+$"),
        (F.size(words) >= 3) & (2 * single >= F.size(words)) & (F.length(t) < 100),
        (F.length(t) < 60) & matches(t, r"^[A-Za-z][\w\s]{0,20}[=≈¼]\s*[\d\w\s%]"),
    ]
    hit = F.lit(False)
    for one in tests:
        hit = hit | one
    return hit


def is_caption(text: Column) -> Column:
    """Whether a line is the caption of a figure or a table, with a number."""
    return F.regexp_replace(text, r"(?U)\s+", "").rlike(r"(?i)^(?:Table|Fig|Figure).*\d")


def body_height(lines: DataFrame) -> DataFrame:
    """(doc, body): the height that most lines of a document have, to a tenth; the least of equals."""
    counts = lines.groupBy("doc", F.round("height", 1).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("doc").agg(F.min_by("h", F.struct(-F.col("n"), "h")).alias("body"))


def is_heading(text: Column, height: Column, body: Column, keywords: list[str] = SECTION_HEADINGS, noise: bool = True) -> Column:
    """Whether a line is a heading: numbered, or opened by a known word, or of three words and more in taller letters.

    ``noise`` is false where noise has been left out before.
    """
    t = stripped(text)
    low = stripped(F.regexp_replace(F.lower(t), "[.:]+$", ""))
    words = F.split(low, r"\s+")
    numbered = matches(t, r"^(?:\d+\.\d+\.\d+|\d+\.\d+|\d+|[IVXivx]+)(?:\.|\s|\))\s+[A-Z一-龥]") & (F.length(t) < 120)
    opened = low.isin(keywords) | (F.get(words, F.lit(0)).isin(keywords) & (F.size(words) <= 6))
    for k in keywords:
        if " " in k:
            opened = opened | low.startswith(k + " ") | low.startswith(k + ":")
    tall = (height > body * TALLER) & (F.size(F.split(t, r"\s+")) >= 3) & F.length(t).between(8, 100) & ~t.rlike("[.,;:?!]$") & matches(t, r"^\p{Lu}")
    fit = F.length(t).between(3, 150) & (numbered | opened | tall) & ~is_equation(t)
    return fit & ~is_noise(t) if noise else fit


def level(text: Column, height: Column, body: Column) -> Column:
    """A heading's level: by the parts of its number, else by its height and words."""
    t = stripped(text)
    return (
        F.when(t.rlike(r"^(?:\d+|[A-Z])\.\d+\.\d+") & ~t.rlike(r"^[A-Z]\d"), 3)
        .when(t.rlike(r"^(?:\d+|[A-Z])\.\d+"), 2)
        .when(t.rlike(r"^(?:\d+|[IVXivx]+|[A-Z])(?:\.|\s|\))"), 1)
        .when(height > body * TALLER, 1)
        .when(F.regexp_replace(F.lower(t), r"\.+$", "").isin(TOP_HEADINGS), 1)
        .otherwise(2)
    )


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines with their place in their document: by page, column, y and x."""
    order = Window.partitionBy("doc").orderBy("page", "column", "y", "x", "seq")
    return lines.withColumn("place", F.row_number().over(order))


def columns(lines: DataFrame) -> DataFrame:
    """Lines (in the order of seq on a page) with their column: one begins where a line stands higher than the one before it, or wholly to the right or left of it."""
    order = Window.partitionBy("doc", "page").orderBy("seq")
    before = lambda c: F.lag(c).over(order)
    apart = (F.col("y") < before("y")) | (F.col("x") > before("x") + before("width")) | (F.col("x") + F.col("width") < before("x"))
    return lines.withColumn("_opens", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("column", F.sum("_opens").over(order)).drop("_opens")


def _numbered(rows: DataFrame, name: str, state: str, opens, grown) -> DataFrame:
    """Rows of a page, in the order of seq, with a number that rises where ``opens`` says so of the state so far and the next row.

    The state is what ``grown`` makes of it (None: a new one) and a row. A page's rows are folded together, as the state can't be seen from
    neighbours; a page is all that is ever held.
    """
    own = [c for c in rows.columns if c not in ("doc", "page", "seq")]
    pages = rows.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*own).alias("r")))).alias("rows"))
    kind = f"struct<n:array<int>,s:{state}>"

    def step(acc: Column, row: Column) -> Column:
        r, s = row["r"], acc["s"]
        new = s.isNull() | opens(s, r)
        last = F.coalesce(F.get(acc["n"], F.size(acc["n"]) - 1), F.lit(-1))
        return F.struct(F.array_append(acc["n"], last + new.cast("int")).alias("n"), F.when(new, grown(None, r)).otherwise(grown(s, r)).alias("s")).cast(kind)

    start = F.struct(F.array().cast("array<int>").alias("n"), F.lit(None).cast(state).alias("s")).cast(kind)
    numbered = pages.withColumn("n", F.aggregate("rows", start, step, lambda acc: acc["n"]))
    out = numbered.select("doc", "page", F.explode(F.arrays_zip(F.col("rows"), F.col("n"))).alias("z"))
    return out.select("doc", "page", F.col("z.rows.seq").alias("seq"), "z.rows.r.*", F.col("z.n").alias(name))


def grown_columns(lines: DataFrame) -> DataFrame:
    """Lines with their column: one begins where a line stands higher than the one before it, or wholly to the right or to the left of all
    lines of the column so far."""
    return _numbered(
        lines, "column", "struct<y:double,right:double,left:double>",
        lambda s, r: (r["y"] < s["y"]) | (r["x"] > s["right"]) | (r["x"] + r["width"] < s["left"]),
        lambda s, r: F.struct(r["y"].alias("y"), (r["x"] + r["width"] if s is None else F.greatest(s["right"], r["x"] + r["width"])).alias("right"), (r["x"] if s is None else F.least(s["left"], r["x"])).alias("left")),
    )


def lines_of_spans(spans: DataFrame) -> DataFrame:
    """(doc, page, seq, x, y, width, height, heights, text, url): spans joined to lines, in the order of seq on a page.

    A span joins the line that is open if it begins within the height of the line's first span, or ends within it. A line's width is the sum of its
    spans'; its height is that of most of them, the first of equals; blank spans are left out, and a span of negative width is turned.
    """
    s = spans.withColumn("text", stripped(F.col("text"))).filter("text <> ''")
    s = s if "url" in s.columns else s.withColumn("url", F.lit(None).cast("string"))
    s = s.select("doc", "page", "seq", F.bround("x", 1).alias("x"), F.bround("y", 1).alias("y"), *(F.col(c).cast("double").alias(c) for c in ("width", "height")), "text", "url")
    s = s.withColumn("x", F.when(F.col("width") < 0, F.col("x") + F.col("width")).otherwise(F.col("x"))).withColumn("width", F.abs("width"))
    joins = lambda t, r: ((r["y"] >= t["y"]) & (r["y"] < t["y"] + t["height"])) | (r["y"] == t["y"]) | ((r["y"] + r["height"] > t["y"]) & (r["y"] + r["height"] <= t["y"] + t["height"]))
    s = _numbered(s, "line", "struct<y:double,height:double>", lambda t, r: ~joins(t, r), lambda t, r: F.struct(r["y"].alias("y"), r["height"].alias("height")) if t is None else t)
    parts = F.array_sort(F.collect_list(F.struct("seq", "x", "y", "width", "height", "text", "url")))
    lines = s.groupBy("doc", "page", "line").agg(parts.alias("p"))
    of = lambda c: F.transform("p", lambda r: r[c])
    heights = of("height")
    most = F.array_max(F.transform(F.array_distinct(heights), lambda h: F.struct(F.size(F.filter(heights, lambda x: x == h)).alias("n"), (-F.array_position(heights, h)).alias("at"), h.alias("h"))))["h"]
    first = F.get("p", F.lit(0))
    return lines.select(
        "doc", "page", F.col("line").alias("seq"), first["x"].alias("x"), first["y"].alias("y"), F.aggregate(of("width"), F.lit(0.0), lambda a, b: a + b).alias("width"), most.alias("height"), heights.alias("heights"),
        F.array_join(of("text"), " ").alias("text"), F.get(F.filter(of("url"), lambda u: u.isNotNull()), F.lit(0)).alias("url"),
    )


def paragraphs(lines: DataFrame, gap: float = 1.5, indent: float = 1.0) -> DataFrame:
    """(doc, page, column, paragraph, text): lines joined until the next one is far below or set in."""
    order = Window.partitionBy("doc", "page", "column").orderBy("y", "x", "seq")
    before = lambda c: F.lag(c).over(order)
    opens = (F.col("y") - before("y") > gap * before("height")) | (F.col("x") - before("x") > indent * F.col("height"))
    numbered = lines.withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("paragraph", F.sum("_opens").over(order))
    parts = F.array_sort(F.collect_list(F.struct("y", "x", "seq", "text")))
    return numbered.groupBy("doc", "page", "column", "paragraph").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def joined_spans(spans: DataFrame) -> DataFrame:
    """(doc, page, line, x, y, text): spans whose middles lie within the line of the span before them make one line."""
    order = Window.partitionBy("doc", "page").orderBy("seq")
    before = lambda c: F.lag(c).over(order)
    opens = F.abs((F.col("y") + F.col("height") / 2) - (before("y") + before("height") / 2)) > F.least("height", before("height")) / 2
    numbered = spans.withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("line", F.sum("_opens").over(order))
    parts = F.array_sort(F.collect_list(F.struct("x", "seq", "text")))
    return numbered.groupBy("doc", "page", "line").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def linked(spans: DataFrame, links: DataFrame) -> DataFrame:
    """Spans with the last link (doc, page, number, x0, y0, x1, y1, target) whose box meets theirs."""
    s, k = spans.alias("s"), links.alias("k")
    meets = (F.col("k.x0") < F.col("s.x") + F.col("s.width")) & (F.col("k.x1") > F.col("s.x")) & (F.col("k.y0") < F.col("s.y") + F.col("s.height")) & (F.col("k.y1") > F.col("s.y"))
    both = s.join(k, (F.col("s.doc") == F.col("k.doc")) & (F.col("s.page") == F.col("k.page")) & meets, "left")
    return both.groupBy(F.col("s.doc").alias("doc"), F.col("s.page").alias("page"), F.col("s.seq").alias("seq")).agg(F.max_by("k.target", "k.number").alias("target"))


def running_heads(lines: DataFrame, page_height: float) -> DataFrame:
    """Lines outside the middle of a page that recur on another page, at the same place, but for their digits."""
    outer = lines.filter(~F.col("y").between(MIDDLE[0] * page_height, MIDDLE[1] * page_height))
    keyed = outer.withColumn("key", F.struct(F.regexp_replace("text", r"\d+", "").alias("text"), *(F.round(c).alias(c) for c in ("x", "y", "width", "height"))))
    again = keyed.groupBy("doc", "key").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).filter("lo < hi").select("doc", "key")
    return keyed.join(again, ["doc", "key"], "left_semi").drop("key")
