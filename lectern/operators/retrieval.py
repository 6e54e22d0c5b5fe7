"""Recall paths (vectors, sections, viewpoints, full text), rank fusion, enrichment and filters."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.fixed import INTENT_WEIGHTS, VIEWPOINT_INTENTS
from lectern.functions.vectors import cosine
from lectern.operators import graph as G
from lectern.plans.shared import saved

RRF_K = 60
PER_PATH_K = 50
#: Constants of BM25, and the least inverse document frequency.
BM25_K1, BM25_B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Fixed order of recall paths; it breaks ties.
PATHS = ("vector", "fts", "graph", "section", "viewpoint")


def query_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "paper_id").limit(k)


def vector_search(vectors: DataFrame, query: Column, k: int = PER_PATH_K) -> DataFrame:
    """(paper_id, score) of the k nearest vectors."""
    return top(vectors.select("paper_id", cosine(query, F.col("embedding")).alias("score")), k)


def section_search(vectors: DataFrame, query: Column, weights: Mapping[str, float], k: int = PER_PATH_K) -> DataFrame:
    """The best weighted section of each paper; sections without a positive weight don't count."""
    weight = F.lit(None).cast("double")
    for kind, w in weights.items():
        if w > 0:
            weight = F.when(F.col("section_type") == kind, F.lit(float(w))).otherwise(weight)
    scored = vectors.withColumn("w", weight).filter("w is not null")
    return top(scored.groupBy("paper_id").agg(F.max(F.col("w") * cosine(query, F.col("embedding"))).alias("score")), k)


def viewpoint_search(vectors: DataFrame, query: Column, k: int = PER_PATH_K) -> DataFrame:
    return top(vectors.groupBy("paper_id").agg(F.max(cosine(query, F.col("embedding"))).alias("score")), k)


TOKEN = r"[\p{L}\p{N}]+"
TEXT_COLUMNS = ("title", "abstract", "keywords")


def _accents() -> tuple[str, str]:
    """Latin letters with marks and the bare letters that they decompose to."""
    pairs = [(chr(c), d[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(x: Column) -> Column:
    """Lower case, without accents on Latin letters."""
    return F.translate(F.lower(x), *_accents())


def query_terms(query: str) -> list[str]:
    """Terms of a query, folded: runs of letters, digits and ``_``; single characters only if Chinese. A term may be several words."""
    found = [t for t in re.findall(r"\w+", query) if len(t) > 1 or "一" <= t <= "鿿"]
    table = str.maketrans(*_accents())
    return list(dict.fromkeys(w for t in found if (w := " ".join(re.findall(r"[^\W_]+", t.lower().translate(table))))))


def postings(papers: DataFrame, columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """(paper_id, term, tf, length): the inverted index over the given columns."""
    words = papers.select("paper_id", F.sort_array(F.regexp_extract_all(folded(F.concat_ws(" ", *columns)), F.lit(TOKEN), F.lit(0))).alias("terms"))
    words = words.select("paper_id", "terms", F.size("terms").alias("length")).filter("length > 0")
    # Within a paper's sorted words, a term's number is how far the next term is: nothing is shuffled to count.
    opens = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    words = words.select("paper_id", "terms", "length", opens.alias("opens"))
    counts = F.transform("opens", lambda i, k: F.struct(F.get("terms", i).alias("term"), (F.coalesce(F.get("opens", k + 1), "length") - i).cast("bigint").alias("tf")))
    return words.select("paper_id", "length", F.inline(counts)).select("paper_id", "term", "length", "tf")


def lengths(papers: DataFrame, columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    return papers.select("paper_id", F.regexp_count(folded(F.concat_ws(" ", *columns)), F.lit(TOKEN)).alias("length"))


def _score(terms: int, n: float, mean: float, df: list[int]) -> Column:
    score = F.lit(0.0)
    for i in range(terms):
        tf = F.col(f"tf{i}").cast("double")
        idf = max(math.log((n - df[i] + 0.5) / (df[i] + 0.5)) if n - df[i] + 0.5 > 0 else LEAST_IDF, LEAST_IDF)
        score = score + F.lit(idf) * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.lit(mean)))
    return score


def _best(rows: DataFrame, terms: int, k: int) -> DataFrame:
    """The best of rows (paper_id, length, tf0, tf1, ...): those with all terms, or, if there is none, with any."""
    held = sum(((F.col(f"tf{i}") > 0).cast("int") for i in range(terms)), F.lit(0))
    counts = [F.count(F.when(F.col(f"tf{i}") > 0, 1)) for i in range(terms)]
    n, mean, most, *df = rows.agg(F.count(F.lit(1)), F.avg("length"), F.max(held), *counts).first()  # one row of totals
    need = terms if most == terms else 1
    return top(rows.filter(held >= need).select("paper_id", _score(terms, n, mean or 1.0, df).alias("score")), k)


def bm25_search(papers: DataFrame, query: str, k: int = PER_PATH_K, columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """Papers that hold all terms, or, if none does, any; best BM25 first.

    Only the query's terms are counted, in one scan: no index of all terms is built for one query. The counts, a few numbers a paper, are written, so that
    totals and hits come from the same reading of the texts.
    """
    terms = query_terms(query)
    if not terms:
        return papers.select("paper_id", F.lit(0.0).alias("score")).limit(0)
    rows = papers.select("paper_id", folded(F.concat_ws(" ", *columns)).alias("t"))
    # Java's lookarounds bound a term; the words of a term of several follow each other.
    counted = [F.regexp_count("t", F.lit(r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(t.split()) + r"(?![\p{L}\p{N}])")) for t in terms]
    rows = rows.select("paper_id", F.regexp_count("t", F.lit(TOKEN)).alias("length"), *(F.when(F.col("t").contains(t.split()[0]), c).otherwise(0).alias(f"tf{i}") for i, (t, c) in enumerate(zip(terms, counted, strict=True))))
    return _best(saved(rows, "counted"), len(terms), k)


def indexed_search(index: DataFrame, sizes: DataFrame, query: str, k: int = PER_PATH_K) -> DataFrame:
    """The same over a stored index (paper_id, term, tf, length) and the papers' lengths: only the query's terms are read."""
    terms = query_terms(query)
    found = index.filter(F.col("term").isin(terms)).groupBy("paper_id", "length").agg(*(F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(terms)))
    totals = sizes.agg(F.count(F.lit(1)), F.avg("length")).first()
    held = sum(((F.col(f"tf{i}") > 0).cast("int") for i in range(len(terms))), F.lit(0))
    most, *df = found.agg(F.max(held), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)) for i in range(len(terms)))).first()
    return top(found.filter(held >= (len(terms) if most == len(terms) else 1)).select("paper_id", _score(len(terms), totals[0], totals[1] or 1.0, df).alias("score")), k)


def ranked(paths: Mapping[str, DataFrame]) -> DataFrame:
    """(paper_id, path, score, rank) of all recall lists; each list has a few dozen rows.

    Scores of the graph are sums of parts in any order, so they compare by nine digits, as in the list's own cut; equals rank by id.
    """
    out = None
    for name, hits in paths.items():
        part = hits.select("paper_id", F.lit(name).alias("path"), F.col("score").cast("double").alias("score"))
        out = part if out is None else out.unionByName(part)
    held = F.when(F.col("path") == "graph", F.round("score", 9)).otherwise(F.col("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(held.desc(), "paper_id")))


def fuse(paths: Mapping[str, DataFrame], top_k: int | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (paper_id, score, source_scores, source_ranks), ties by first path and rank there."""
    place = F.create_map(*[x for i, p in enumerate(PATHS) for x in (F.lit(p), F.lit(i))])
    hits = ranked(paths).withColumn("place", F.struct(place[F.col("path")].alias("path"), "rank"))
    entry = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", c))))
    fused = hits.groupBy("paper_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("place").alias("place"), entry("score").alias("source_scores"), entry("rank").alias("source_ranks"))
    fused = fused.orderBy(F.desc(F.round("score", 12)), "place").drop("place")
    return fused if top_k is None else fused.limit(top_k)


def explain(hits: DataFrame) -> DataFrame:
    """Hits with a text that names the rank and score of each path."""
    parts = [F.when(F.col("source_ranks")[p].isNotNull(), F.concat(F.lit(f"{p}#"), F.col("source_ranks")[p].cast("string"), F.lit("("), F.format_string("%.3f", F.col("source_scores")[p]), F.lit(")"))) for p in PATHS]
    text = F.array_join(F.array_compact(F.array(*parts)), " ")
    return hits.withColumn("explain", F.when(text == "", "—").otherwise(text))


def enriched(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """Hits with titles and so on; a paper that is missing leaves them empty."""
    return hits.join(papers, "paper_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


def year_between(papers: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Papers whose publication year, or else the year they came in, lies in a range."""
    year = F.coalesce("publication_year", F.year("ingested_at"))
    out = papers.withColumn("year", year)
    out = out if first is None else out.filter(F.col("year") >= first)
    return out if last is None else out.filter(F.col("year") <= last)


def hybrid_search(paths: Mapping[str, DataFrame], papers: DataFrame, keep: Column | None = None, top_k: int = 20) -> DataFrame:
    """Fuse, enrich, then filter what the cut has left (so fewer than k may remain), then cut to k."""
    hits = enriched(fuse(paths, max(3 * top_k, PER_PATH_K)), papers)
    hits = hits if keep is None else hits.filter(keep)
    return hits.orderBy(F.desc(F.round("score", 12)), "paper_id").limit(top_k)


def hits_per_path(paths: Mapping[str, DataFrame]) -> DataFrame:
    return ranked(paths).groupBy("path").agg(F.count(F.lit(1)).alias("hits"))


@dataclass(frozen=True)
class Library:
    """What a question is asked of; any part may be absent.

    papers: paper_id, title, abstract, keywords and so on; vectors: paper_id, embedding; sections: paper_id, section_type, embedding;
    viewpoints: paper_id, embedding; graph: edges (src, kind, dst).
    """

    papers: DataFrame
    vectors: DataFrame | None = None
    sections: DataFrame | None = None
    viewpoints: DataFrame | None = None
    graph: DataFrame | None = None


def understood(spark: SparkSession, question: str, anchored: bool = False) -> tuple[str, str]:
    """Intent and route of one question, by the same rules as for columns of questions."""
    row = spark.range(1).select(T.intent(F.lit(question)), T.route(F.lit(question), anchored)).first()
    return row[0], row[1]


def recall(library: Library, question: str, query: Column | None, mode: str = "auto", intent: str = "auto", per_path_k: int = PER_PATH_K) -> dict[str, DataFrame]:
    """The recall lists that a question's intent and route ask for.

    Modes: hybrid (vectors and full text), vector, fts, graph, all, and auto, which takes the route. The intent gives the weights of
    sections, and says whether viewpoints are searched; both need a query vector.
    """
    found = None
    if library.graph is not None and mode in ("auto", "graph", "all"):
        found = saved(G.anchors(library.graph, question), "anchors")  # a few rows, read by each hop; else each would look for them in the whole graph again
    if mode == "auto" or intent == "auto":
        guessed, routed = understood(library.papers.sparkSession, question, bool(found is not None and found.take(1)))
        mode, intent = routed if mode == "auto" else mode, guessed if intent == "auto" else intent
    weights = INTENT_WEIGHTS.get(intent, {})
    query = query if mode in ("hybrid", "vector", "all") else None
    paths = {}
    if query is not None and library.vectors is not None:
        paths["vector"] = vector_search(library.vectors, query, per_path_k)
    if mode in ("hybrid", "fts", "all"):
        paths["fts"] = bm25_search(library.papers, question, per_path_k)
    if found is not None and mode in ("graph", "all"):
        paths["graph"] = G.search(library.graph, found, per_path_k)
    if query is not None and weights and library.sections is not None:
        paths["section"] = section_search(library.sections, query, weights, per_path_k)
    if query is not None and intent in VIEWPOINT_INTENTS and library.viewpoints is not None:
        paths["viewpoint"] = viewpoint_search(library.viewpoints, query, per_path_k)
    return paths


def answer(
    library: Library, question: str, query: Column | None, mode: str = "auto", intent: str = "auto", keep: Column | None = None, top_k: int = 20,
    rerank: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Recall, fuse, enrich, filter and cut; with a reranker, ten hits at least go to it before the cut."""
    paths = recall(library, question, query, mode, intent)
    if not paths:
        return library.papers.limit(0)
    hits = hybrid_search(paths, library.papers, keep, max(top_k, 10) if rerank else top_k)
    return hits if rerank is None else rerank(hits).limit(top_k)


def tool_hits(hits: DataFrame, snippet: int = 240) -> DataFrame:
    """Hits as an agent sees them: rounded score and the beginning of the abstract."""
    return hits.select("paper_id", "title", F.round("score", 4).alias("score"), T.truncated(F.coalesce("abstract", F.lit("")), snippet).alias("snippet"))


def within_paper(sections: DataFrame, paper_id: int, query: Column, k: int = 5, snippet: int = 400) -> DataFrame:
    """(section_id, score, snippet) of one paper's sections (paper_id, section_id, body, embedding), nearest first; k from 1 to 30."""
    mine = sections.filter((F.col("paper_id") == paper_id) & F.col("embedding").isNotNull())
    scored = mine.select("section_id", cosine(query, F.col("embedding")).alias("score"), T.truncated(F.coalesce("body", F.lit("")), snippet).alias("snippet"))
    return scored.orderBy(F.desc("score"), "section_id").limit(max(1, min(k, 30))).withColumn("score", F.round("score", 4))
