"""Reads and projections of a library: papers, sections, references, citations, viewpoints; and the texts that are embedded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Characters of an input to an embedding model, of a search hit's abstract, sections of a summary, cited works of a review.
INPUT_CHARS, HIT_CHARS, SUMMARY_SECTIONS, REVIEWED_WORKS = 16_000, 300, 8, 40
#: What a heading holds that makes its section one for a summary, or one of a review of literature.
SUMMARY_HEADINGS = ["introduction", "background", "method", "approach", "model", "result", "experiment", "discussion", "conclusion", "summary", "引言", "方法", "实验", "结果", "讨论", "结论"]
REVIEW_HEADINGS = ["introduction", "background", "related", "literature", "review", "prior work", "previous work", "引言", "相关工作", "文献综述"]


def by_key(papers: DataFrame, column: str, value: object) -> DataFrame:
    """The paper with an id, a SHA-256 or a DOI; at most one row."""
    return papers.filter(F.col(column) == F.lit(value)).orderBy("paper_id").limit(1)


def among(papers: DataFrame, ids: list[int]) -> DataFrame:
    """Papers of a list of ids."""
    return papers.filter(F.col("paper_id").isin(ids))


def for_agent(papers: DataFrame, fields: list[str]) -> DataFrame:
    """Papers as an agent reads them: the fields asked for; findings that are absent are an empty list."""
    return papers.select("paper_id", *(F.coalesce("findings", F.array().cast("array<string>")).alias("findings") if f == "findings" else F.col(f) for f in fields))


def snippets(sections: DataFrame, size: int) -> DataFrame:
    """(paper_id, sort_order, snippet): the beginnings of sections, in order."""
    return sections.select("paper_id", "sort_order", T.truncated(F.col("body"), size).alias("snippet"))


def numbered(references: DataFrame) -> DataFrame:
    """References with their place in their paper: by number, those without one first."""
    order = Window.partitionBy("paper_id").orderBy(F.col("number").asc_nulls_first(), "part")
    return references.withColumn("place", F.row_number().over(order))


def reference_doi(identifiers: Column) -> Column:
    """The DOI in a JSON object of identifiers, under either spelling of the key: trimmed, lower case; null if there is none or it isn't JSON."""
    found = F.lower(T.stripped(F.coalesce(F.get_json_object(identifiers, "$.DOI"), F.get_json_object(identifiers, "$.doi"))))
    return F.when(found != "", found)


def reference_search(references: DataFrame, query: str) -> DataFrame:
    """References that hold a text in title or authors; only A-Z is folded."""
    wanted = query.translate(str.maketrans(*T.ASCII))
    return references.filter(F.coalesce(T.ascii_lower(F.col("title")).contains(wanted), F.lit(False)) | F.coalesce(T.ascii_lower(F.col("authors")).contains(wanted), F.lit(False)))


def summaries(papers: DataFrame, vectors: DataFrame, analysed: DataFrame) -> DataFrame:
    """Papers with flags: whether they have a vector, and whether they have been analysed."""
    has = lambda df, name: df.select("paper_id", F.lit(True).alias(name)).distinct()
    both = papers.join(has(vectors, "has_embedding"), "paper_id", "left").join(has(analysed, "has_analysis"), "paper_id", "left")
    return both.withColumn("has_embedding", F.coalesce("has_embedding", F.lit(False))).withColumn("has_analysis", F.coalesce("has_analysis", F.lit(False)))


def detail(papers: DataFrame, tags: DataFrame, **parts: DataFrame) -> DataFrame:
    """Papers with the sorted names of their tags, and for each further table the number of its rows."""
    names = tags.groupBy("paper_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    out = papers.join(names, "paper_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    for name, df in parts.items():
        out = out.join(df.groupBy("paper_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), "paper_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def lacking(papers: DataFrame, *columns: str) -> DataFrame:
    """Papers that lack any of the columns, by id."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return papers.filter(missing)


def with_titles(pairs: DataFrame, papers: DataFrame) -> DataFrame:
    """Related papers (other_id) with their titles, ``?`` for those that aren't there."""
    named = papers.select(F.col("paper_id").alias("other_id"), "title")
    return pairs.join(named, "other_id", "left").withColumn("title", F.coalesce("title", F.lit("?")))


def viewpoint_text(category: Column, viewpoint: Column) -> Column:
    return T.stripped(F.concat(F.lit("["), F.coalesce(category, F.lit("")), F.lit("] "), F.coalesce(viewpoint, F.lit(""))))


def section_text(heading: Column, body: Column) -> Column:
    text = F.substring(T.stripped(F.concat(F.coalesce(heading, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))), 1, INPUT_CHARS)
    return F.when(text == "", F.lit(" ")).otherwise(text)


def reference_text(title: Column, raw: Column, authors: Column, year: Column) -> Column:
    """A reference as it is embedded: title or raw text, three authors at most, year; a blank if nothing is known."""
    some = lambda x: F.when(x != "", x)
    more = F.when(F.size(authors) > 3, F.lit(", et al.")).otherwise(F.lit(""))
    names = F.when(F.size(authors) > 0, F.concat(F.lit("["), F.array_join(F.slice(authors, 1, 3), ", "), more, F.lit("]")))
    text = F.substring(T.stripped(F.concat_ws(" ", F.coalesce(some(title), some(raw)), names, F.concat(F.lit("("), some(year), F.lit(")")))), 1, INPUT_CHARS)
    return F.when(text == "", F.lit(" ")).otherwise(text)


def summary_text(summary: Column, field: Column, methodology: Column, findings: Column) -> Column:
    """A paper's core as it is embedded: what is known of summary, field, methodology and findings, a line each."""
    line = lambda label, x: F.when(x != "", F.concat(F.lit(label), T.stripped(x)))
    found = F.when(F.size(findings) > 0, F.concat(F.lit("Key findings: "), F.array_join(findings, "; ")))
    return T.stripped(F.concat_ws("\n", line("", summary), line("Field: ", field), line("Methodology: ", methodology), found))


def label(title: Column, authors: Column, year: Column, number: Column) -> Column:
    """A short name of a reference: title, first author and year, or its number."""
    known = lambda x: F.when(x != "", x)
    short = known(T.truncated(F.regexp_replace(title, "\n", " "), 80))
    by = F.when(F.size(authors) > 0, F.concat(F.lit("("), F.get(authors, F.lit(0)), F.when(F.size(authors) > 1, "+").otherwise(""), F.lit(", "), F.coalesce(known(year), F.lit("?")), F.lit(")")))
    text = F.concat_ws(" ", short, F.coalesce(by, F.concat(F.lit("("), known(year), F.lit(")"))))
    return F.when(text == "", F.concat(F.lit("ref#"), F.coalesce(number.cast("string"), F.lit("?")))).otherwise(text)


def yaml_text(x: Column) -> Column:
    """A text as a quoted scalar of a page's head."""
    return F.concat(F.lit('"'), F.coalesce(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("")), F.lit('"'))


def cut_middle(x: Column, budget: int) -> Column:
    """A text within about a budget: its beginning and its end, with a note of how much is left out between."""
    head = max(int(budget * 0.65), 200)
    tail = max(budget - head - 80, 200)
    note = F.concat(F.lit("\n... [truncated "), (F.length(x) - head - tail).cast("string"), F.lit(" chars] ...\n"))
    return F.when(F.length(x) <= budget, x).otherwise(F.concat(F.substring(x, 1, head), note, F.substring(x, -tail, tail)))


def last_name(authors: Column) -> Column:
    """The first author's first word, without a full stop at its end."""
    first = F.regexp_replace(T.stripped(F.get(authors, F.lit(0))), r"\.$", "")
    return F.coalesce(F.regexp_extract(first, r"^[^, ]*", 0), F.lit(""))


def json_object(x: Column) -> Column:
    """The JSON object in a model's answer: without the fence around it, or else what stands from the first to the last brace; null if that isn't JSON."""
    bare = F.regexp_replace(T.stripped(x), r"^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    valid = lambda t: F.when(F.get_json_object(t, "$").isNotNull() & F.regexp_replace(t, r"(?s)\s", "").rlike(r"(?s)^\{.*\}$"), t)
    return F.coalesce(valid(bare), valid(inner))


def summary_sections(sections: DataFrame) -> DataFrame:
    """The sections of each paper that a summary is written from, eight at most, in order: by heading, then those of the first level."""
    heading = F.lower(F.coalesce("heading", F.lit("")))
    hit = F.lit(False)
    for word in SUMMARY_HEADINGS:
        hit = hit | heading.contains(word)
    worth = F.when(hit, 10).when(F.col("level") == 1, 3).otherwise(0)
    order = Window.partitionBy("paper_id").orderBy(worth.desc(), "sort_order")
    return sections.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SUMMARY_SECTIONS).drop("r")


def cited_sentences(citations: DataFrame, references: DataFrame, works: int = REVIEWED_WORKS) -> DataFrame:
    """(paper_id, reference_id, n): each paper's most cited references, from citations (paper_id, reference_id, text).

    A citation's reference is the one that it names, or else that whose number opens its text.
    """
    number = F.expr("try_cast(regexp_extract(text, '^[\\\\[\\\\]()［］ ]*([0-9]+) *[\\\\[\\\\]()［］,-]?', 1) AS bigint)")
    own = references.select("paper_id", "reference_id", F.col("reference_id").alias("known")).distinct()
    found = citations.join(own, ["paper_id", "reference_id"], "left").withColumn("number", number)
    by_number = references.filter("number is not null").groupBy("paper_id", "number").agg(F.max("reference_id").alias("numbered"))
    found = found.join(by_number, ["paper_id", "number"], "left").withColumn("id", F.coalesce("known", "numbered")).filter("id is not null")
    counts = found.groupBy("paper_id", F.col("id").alias("reference_id")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("paper_id").orderBy(F.desc("n"), "reference_id")
    return counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= works).drop("r")


def paper_embeddings(papers: DataFrame, chunks: DataFrame, pooled: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(paper_id, title, abstract, fulltext): a paper's vectors; the full text is the mean of its sections, each the mean of its chunks, or else the abstract.

    papers: paper_id with vectors title and abstract. chunks: paper_id, section_id and vector embedding, from a model.
    """
    keyed = chunks.withColumn("key", F.struct("paper_id", "section_id"))
    by_section = pooled(keyed.select("key", "embedding"), "key").select(F.col("key.paper_id").alias("paper_id"), F.col("pooled").alias("embedding"))
    full = pooled(by_section, "paper_id").withColumnRenamed("pooled", "fulltext")
    return papers.join(full, "paper_id", "left").withColumn("fulltext", F.coalesce("fulltext", F.col("abstract").cast("array<double>")))


def embedding_counts(papers: DataFrame, sections: DataFrame, chunks: DataFrame, viewpoints: DataFrame, references: DataFrame) -> DataFrame:
    """(name, n): how many papers, sections, chunks, viewpoints and references have their vectors."""
    wanted = {
        "papers_title": (papers, "title_embedding"), "papers_abstract": (papers, "abstract_embedding"), "papers_fulltext": (papers, "fulltext_embedding"), "papers_summary": (papers, "summary_embedding"),
        "sections": (sections, "embedding"), "chunks_total": (chunks, None), "chunks": (chunks, "embedding"), "viewpoints_total": (viewpoints, None), "viewpoints": (viewpoints, "embedding"), "references": (references, "embedding"),
    }
    out = None
    for name, (df, column) in wanted.items():
        part = df.agg(F.count(F.lit(1) if column is None else F.col(column)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def index_cards(papers: DataFrame, pairs: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """The index page of an archive: a card for each paper (paper_id, card), and the rows of the pairs that share most (place, row)."""
    name = T.truncated(F.regexp_replace("title", r"\s*\n\s*", " "), 80)
    card = F.concat(F.lit("- ["), name, F.lit("]("), T.paper_filename(F.col("paper_id"), F.col("title")), F.lit(")"), F.coalesce(F.concat(F.lit(" `"), "tag", F.lit("`")), F.lit("")))
    first = pairs.orderBy(F.desc("shared"), "paper_a", "paper_b").limit(most)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("paper_a").cast("string"), F.col("paper_b").cast("string"), F.col("shared").cast("string")), F.lit(" |"))
    place = F.row_number().over(Window.orderBy(F.desc("shared"), "paper_a", "paper_b"))  # at most ``most`` rows
    return papers.select("paper_id", card.alias("card")), first.select(place.alias("place"), row.alias("row"))


def graph_nodes(papers: DataFrame) -> DataFrame:
    """(paper_id, json): the nodes of a graph file; a node's year is that of its arrival."""
    return papers.select("paper_id", F.to_json(F.struct(F.col("paper_id").alias("id"), "title", F.date_format("ingested_at", "yyyy").alias("year"))).alias("json"))


def batch_summary(results: DataFrame) -> DataFrame:
    """(total, succeeded, skipped, failed) of a batch's rows (status)."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return results.agg(F.count(F.lit(1)).alias("total"), n("succeeded"), n("skipped"), n("failed"))
