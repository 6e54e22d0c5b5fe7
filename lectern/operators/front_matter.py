"""Title, authors, affiliations, abstract, keywords and DOI of papers from their first pages.

Blocks are rows (doc, seq, text, size, y0, y1): the text blocks of first pages with the height of their largest letters; pages are rows
(doc, height, text). Choices among a page's blocks are windows and aggregates by document; texts are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fixed as X
from lectern.functions.text import DOI_PATTERN, matches, stripped
from lectern.plans.shared import saved


def bare_title(text: Column) -> Column:
    """A title without the kind of article, and a link, in front of it."""
    cut = stripped(F.regexp_replace(text, rf"(?Ui)^\s*(?:{'|'.join(X.TITLE_PREFIXES)}){X.TITLE_LINK}\s+", ""))
    return F.when(cut == "", text).otherwise(cut)


def clean_name(name: Column) -> Column:
    """A name without a joining word in front and up to five markers of affiliations behind."""
    out = F.regexp_replace(stripped(name), r"(?U)^(?:and|AND|&)\s+", "")
    for _ in range(5):
        out = F.regexp_replace(out, f"(?U){X.NAME_MARKER}", "")
    return stripped(F.regexp_replace(out, r"(?U)\s{2,}", " "))


def first_word(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(text, r"(?U)^\s*(\S+)", 1)), ":+$", "")


def is_name(name: Column) -> Column:
    """Whether a cleaned text can be a name: two letters and more, not digits, no title of membership, no word that opens another part of the page."""
    return (F.length(name) >= 2) & ~matches(name, r"^[\d\s\*\.,]+$") & ~F.lower(name).isin(X.NO_NAMES) & ~first_word(name).isin(X.NO_FIRST_WORDS)


def split_authors(text: Column) -> Column:
    """Names in a line of authors: between bars if there is one, else between commas, and on both sides of *and*; cleaned, and only what can be a name."""
    line = F.regexp_replace(stripped(text), rf"(?Ui)^\s*(?:{'|'.join(X.AUTHOR_LABELS)})", "")
    parts = F.when(F.contains(line, F.lit("|")), F.split(line, r"\|")).otherwise(F.split(line, ","))
    names = F.flatten(F.transform(parts, lambda p: F.split(stripped(p), r"(?U)\s+(?:and|AND|&)\s+")))
    names = F.filter(F.transform(F.filter(F.transform(names, stripped), lambda n: n != ""), clean_name), is_name)
    return F.when(first_word(line).isin(X.NO_FIRST_WORDS) | (line == ""), F.array().cast("array<string>")).otherwise(names)


def split_affiliations(text: Column) -> Column:
    """Affiliations in a block, apart where a letter stands between wide blanks; without the markers in front, and longer than ten characters."""
    parts = F.split(text, r"(?U)\s{2,}(?=[a-z]\s{2,})")
    return F.filter(F.transform(parts, lambda p: stripped(F.regexp_replace(p, r"(?U)^[a-z0-9,\*\s]+", ""))), lambda p: F.length(p) > X.LEAST_AFFILIATION)


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is taken once, however often f names it: a pattern's pass over a whole text is long."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def abstract(text: Column) -> Column:
    """What follows the last label of an abstract on a page, up to what can't belong to it, else 5000 characters; lines joined, blank lines kept."""
    last = lambda parts: F.when(F.size(parts) > 1, F.element_at(parts, -1))
    ended = lambda rest: _once(F.split(rest, "(?Ui)" + "|".join(X.ABSTRACT_ENDS), 2), lambda cut: F.when(F.size(cut) > 1, cut[0]).otherwise(F.substring(rest, 1, X.ABSTRACT_CHARS)))
    out = stripped(_once(_once(F.split(text, f"(?Ui){X.ABSTRACT_LABEL}"), last), ended))
    for pattern, by in ((r"(?U)\n[A-Z][a-z]+(?:\s+[a-z]+){0,3}\s*\n(?=[a-z])", "\n"), (r"\n(?:Dataset link:.*?)(?=\n)", ""), (r"\n[Bb]/.*?(?=\n)", ""), (r"\n{3,}", "\n\n"), (r"\n([^\n])", " $1"), (" {2,}", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.coalesce(stripped(out), F.lit(""))


def keywords(text: Column) -> Column:
    """The terms after a label of keywords, up to a blank line, spaced capitals or the introduction."""
    found = stripped(F.regexp_extract(text, f"(?Uis){X.KEYWORD_LIST}", 1))
    lines = F.filter(F.transform(F.split(found, "\n"), lambda x: F.regexp_replace(stripped(x), "[;,]+$", "")), lambda x: F.length(x) >= 3)
    terms = F.flatten(F.transform(lines, lambda x: F.split(x, "[;,]")))
    return F.filter(F.transform(terms, lambda t: F.regexp_replace(stripped(t), r"\.+$", "")), lambda t: F.length(t) > 1)


def page_doi(text: Column) -> Column:
    found = F.regexp_extract(text, DOI_PATTERN, 0)
    return F.when(found != "", F.regexp_replace(found, r"\.+$", ""))


def titles(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, title, bottom) for every page: the block of the largest letters in the upper third, with the blocks of its size right above and below it.

    Of equal letters more words win, then the first block. A page without a block of four words there gets one of five words from its upper half; a page without
    that has an empty title, which ends at a quarter of the page.
    """
    b = blocks.join(pages.select("doc", F.col("height").alias("page")), "doc").withColumn("at", F.col("y0") / F.col("page"))
    b = b.withColumn("words", F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")))
    by_doc = Window.partitionBy("doc")
    strict = F.col("at").between(*X.TITLE_BAND) & (F.col("words") >= X.TITLE_WORDS)
    loose = (F.col("at") < X.LOOSE_BAND) & (F.col("words") >= X.LOOSE_WORDS)
    b = b.withColumn("pool", F.when(strict, 2).when(loose, 1).otherwise(0)).withColumn("best", F.max("pool").over(by_doc))
    main = F.min(F.when((F.col("pool") == F.col("best")) & (F.col("best") > 0), F.struct((-F.col("size")).alias("s"), (-F.col("words")).alias("w"), "seq"))).over(by_doc)
    b = b.withColumn("main", main).filter("main is not null").withColumn("is_main", F.col("seq") == F.col("main.seq"))
    alike = F.col("at").between(*X.TITLE_PARTS_BAND) & (F.col("words") >= 1) & (F.abs(F.col("size") + F.col("main.s")) < X.SAME_SIZE)
    b = b.filter(alike | F.col("is_main")).withColumn("lone", F.max(F.col("is_main") & ~alike).over(by_doc)).filter(~F.col("lone") | F.col("is_main"))
    down = by_doc.orderBy("y0", "seq")
    opens = F.coalesce(F.col("y0") - F.lag("y1").over(down) >= -F.col("main.s") * X.LINE_GAP, F.lit(False))
    b = b.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(down)).withColumn("own", F.max(F.when(F.col("is_main"), F.col("run"))).over(by_doc)).filter("run = own")
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("y0", "seq", "text"))), lambda p: stripped(p["text"])), lambda t: t != "")
    found = b.groupBy("doc").agg(bare_title(F.array_join(parts, " ")).alias("title"), F.max("y1").alias("bottom"))
    out = pages.select("doc", "height").join(found, "doc", "left")
    return out.select("doc", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("bottom", F.col("height") * X.NO_TITLE_AT).alias("bottom"))


def authors(blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc, authors): from the blocks right below the title, down to the first wide gap or the first block of another kind."""
    lo, hi = X.AUTHORS_BELOW
    b = blocks.join(heads.select("doc", "bottom"), "doc").filter((F.col("y0") > F.col("bottom") + lo) & (F.col("y0") < F.col("bottom") + hi) & (F.col("size") >= X.AUTHORS_SIZE))
    down = Window.partitionBy("doc").orderBy("y0", "seq")
    upto = F.greatest(F.first("y0").over(down), F.max("y1").over(down.rowsBetween(Window.unboundedPreceding, -1)))
    stops = matches(F.col("text"), rf"^\s*(?:{'|'.join(X.AUTHOR_STOPS)})", any_case=True)
    b = b.withColumn("upto", upto).withColumn("stop", ((F.col("y0") - F.col("upto") > X.AUTHORS_GAP) | stops).cast("int")).withColumn("stopped", F.max("stop").over(down)).filter("stopped = 0")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "seq", "text"))), lambda p: p["text"]), " ")
    return b.groupBy("doc").agg(split_authors(line).alias("authors"))


def affiliations(blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc, affiliations): from blocks with a word of institutions below the authors; heads: doc, bottom, authors."""
    lo, hi = X.AFFILIATIONS_BELOW
    b = blocks.join(heads.select("doc", "bottom", (F.size("authors") > 0).alias("any")), "doc")
    own = F.when(F.col("any") & (F.col("y0") > F.col("bottom")) & F.col("size").between(*X.AUTHOR_SIZES), F.col("y1"))
    b = b.withColumn("below", F.greatest(F.col("bottom") + X.AUTHORS_GAP, F.max(own).over(Window.partitionBy("doc"))))
    b = b.filter((F.col("y0") > F.col("below") + lo) & (F.col("y0") < F.col("below") + hi) & F.col("text").rlike("(?Ui)" + "|".join(X.INSTITUTIONS)))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("y0", "seq", split_affiliations(F.col("text")).alias("a")))), lambda p: p["a"])
    return b.groupBy("doc").agg(F.flatten(lists).alias("affiliations"))


def front_matter(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, title, authors, affiliations, abstract, keywords, doi): one row for every first page.

    Blocks, titles and authors are written once each, as every later step reads them again, more than once.
    """
    none = F.array().cast("array<string>")
    blocks = saved(blocks.select("doc", "seq", "text", "size", "y0", "y1"), "blocks")
    heads = saved(titles(blocks, pages), "titles")
    heads = saved(heads.join(authors(blocks, heads), "doc", "left").withColumn("authors", F.coalesce("authors", none)), "heads")
    out = heads.join(affiliations(blocks, heads), "doc", "left").join(pages.select("doc", "text"), "doc")
    return out.select("doc", "title", "authors", F.coalesce("affiliations", none).alias("affiliations"), abstract(F.col("text")).alias("abstract"), keywords(F.col("text")).alias("keywords"), page_doi(F.col("text")).alias("doi"))


#: Fixed value: characters of a layout model's title, at least.
LEAST_TITLE = 8


def block_titles(blocks: DataFrame) -> DataFrame:
    """(doc, title): the first title block of the first level on a document's first page, of layout blocks (doc, seq, block), that doesn't name a list of references."""
    from lectern.operators.section_parser import is_list_heading

    b = blocks.select("doc", "seq", "block.type", "block.text", "block.text_level", F.coalesce("block.page_idx", F.lit(0)).alias("page"))
    left = F.max((F.col("page") > 0).cast("int")).over(Window.partitionBy("doc").orderBy("seq"))
    t = stripped(F.coalesce("text", F.lit("")))
    fit = (F.col("type") == "title") & (F.col("text_level").isNull() | (F.col("text_level") == 1)) & (F.length(t) >= LEAST_TITLE) & ~is_list_heading(t)
    return b.withColumn("left", left).filter((F.col("left") == 0) & fit).groupBy("doc").agg(F.min_by(t, "seq").alias("title"))


def with_block_titles(fronts: DataFrame, titled: DataFrame) -> DataFrame:
    """Front matter with a layout model's title where that is longer."""
    both = fronts.join(titled.withColumnRenamed("title", "_t"), "doc", "left")
    return both.withColumn("title", F.when(F.length("_t") > F.length("title"), F.col("_t")).otherwise(F.col("title"))).drop("_t")
