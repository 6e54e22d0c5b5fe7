"""The knowledge graph: nodes and edges from papers, and searches of up to two hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import graph_title, keyword, stripped
from lectern.operators.identity import identified
from lectern.plans.shared import saved

#: Weights of the first and second hop, terms that a second hop follows, relevance of anchor layers.
HOP_WEIGHTS = (1.0, 0.3)
TOP_COOCCURRING = 10
RELEVANCE = {"phrase": 1.0, "ngram": 0.8, "substring": 0.5}
MAX_NGRAMS, PER_SUBSTRING = 40, 5


#: The least length of a normalised title that names a known paper, and an outside work.
LEAST_LOCAL, LEAST_EXTERNAL = 8, 4
#: Papers that an explanation lists for a term.
LISTED = 50


def doi_key(x: Column) -> Column:
    """A DOI as an identity: trimmed, lower case, null if nothing is left."""
    key = F.lower(stripped(x))
    return F.when(key != "", key)


def _known(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(d, by_doi) and (t, by_title): the last paper of each DOI and of each normalised title."""
    by_doi = papers.select(doi_key(F.col("doi")).alias("d"), "paper_id").filter("d is not null").groupBy("d").agg(F.max("paper_id").alias("by_doi"))
    by_title = papers.select(graph_title(F.col("title")).alias("t"), "paper_id").filter(F.length("t") >= LEAST_LOCAL).groupBy("t").agg(F.max("paper_id").alias("by_title"))
    return by_doi, by_title


def works(references: DataFrame) -> DataFrame:
    """(doi, title, d, t, name): the distinct cited works with a title; name is the least DOI that a work has, directly or through works of its DOI or title, else the title.

    They are written once: their identity reads them several times, and the references but once.
    """
    cited = references.filter(F.col("title").isNotNull() & (F.col("title") != "")).select("doi", "title").distinct()
    cited = saved(cited.withColumn("d", doi_key(F.col("doi"))).withColumn("t", graph_title(F.col("title"))), "works")
    return identified(cited, LEAST_EXTERNAL).select("doi", "title", "d", "t", "name")


def _resolved(cited: DataFrame, papers: DataFrame) -> DataFrame:
    """Works with by_doi and by_title, the papers known by either; works without a DOI don't meet in one task."""
    by_doi, by_title = _known(papers)
    spread = F.coalesce("d", F.concat(F.lit("\n"), "t"))  # no DOI begins with white space
    return cited.withColumn("_d", spread).join(by_doi.withColumnRenamed("d", "_d"), "_d", "left").drop("_d").join(by_title, "t", "left")


def _cites(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges to outside works, and all others: only the former are joined by name, as a term has edges without number."""
    return graph.filter("kind = 'cites'"), graph.filter("kind <> 'cites'")


def cited_edges(papers: DataFrame, references: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """(src, kind, dst): cross_cites to papers known by DOI or else by title, cites to other works. Works (of more references, perhaps) are resolved once each."""
    resolved = _resolved(works(references) if cited is None else cited, papers).select("doi", "title", F.coalesce("by_doi", "by_title").alias("local"), "name")
    r, w = references.select("paper_id", "doi", "title").alias("r"), resolved.alias("w")
    both = r.join(w, F.col("r.doi").eqNullSafe(F.col("w.doi")) & (F.col("r.title") == F.col("w.title"))).filter("w.local is null or w.local <> r.paper_id")
    kind = F.when(F.col("w.local").isNull(), "cites").otherwise("cross_cites")
    return both.select(F.col("r.paper_id").alias("src"), kind.alias("kind"), F.coalesce(F.col("w.local").cast("string"), "w.name").alias("dst"))


def _term_rows(papers: DataFrame, keywords: DataFrame | None) -> DataFrame:
    words = papers.select("paper_id", F.explode("keywords").alias("keyword")) if keywords is None else keywords
    terms = words.select(F.col("paper_id").alias("src"), F.lit("has_keyword").alias("kind"), keyword(F.col("keyword")).alias("dst"))
    fields = papers.select(F.col("paper_id").alias("src"), F.lit("in_field").alias("kind"), keyword(F.col("field")).alias("dst"))
    return terms.unionByName(fields).filter("dst is not null and dst <> ''")


def term_edges(papers: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """The edges of :func:`edges` that lead to terms: all that anchors and searches follow, without resolving any cited work."""
    return _term_rows(papers, keywords).distinct()


def edges(papers: DataFrame, references: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """(src, kind, dst) once each: has_keyword and in_field to terms, cross_cites to known papers, cites to other works.

    papers: paper_id, field, doi, title, and keywords (an array) unless they come as rows (paper_id, keyword). references: paper_id, doi, title.
    """
    return _term_rows(papers, keywords).unionByName(cited_edges(papers, references).filter("dst is not null and dst <> ''")).distinct()


def nodes(papers: DataFrame, graph: DataFrame) -> DataFrame:
    """(kind, name) of all nodes."""
    local = papers.select(F.lit("paper").alias("kind"), F.col("paper_id").cast("string").alias("name"))
    kinds = F.when(F.col("kind") == "has_keyword", "keyword").when(F.col("kind") == "in_field", "field").otherwise("external")
    return local.unionByName(graph.filter("kind <> 'cross_cites'").select(kinds.alias("kind"), F.col("dst").alias("name"))).distinct()


def stats(graph: DataFrame) -> DataFrame:
    return graph.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def orphans(all_nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """Nodes other than papers that no edge reaches."""
    return all_nodes.filter("kind <> 'paper'").join(graph.select(F.col("dst").alias("name")).distinct(), "name", "left_anti")


def cooccurring(graph: DataFrame, terms: DataFrame, k: int = TOP_COOCCURRING) -> DataFrame:
    """(term, other, papers): for each of a few terms, the k keywords that most papers have beside it."""
    has = graph.filter("kind = 'has_keyword'")
    at = has.join(F.broadcast(terms), has["dst"] == terms["term"]).select("src", "term")
    other = has.select(F.col("src").alias("s"), F.col("dst").alias("other"))
    counts = at.join(other, (F.col("src") == F.col("s")) & (F.col("other") != F.col("term"))).groupBy("term", "other").agg(F.countDistinct("src").alias("papers"))
    order = Window.partitionBy("term").orderBy(F.desc("papers"), "other")
    return counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def anchors(graph: DataFrame, query: str) -> DataFrame:
    """(term, relevance, seq): graph terms that a query names; of several layers the first counts."""
    words = [w for w in query.lower().split() if w]
    grams = list(dict.fromkeys(" ".join(words[i : i + n]) for n in (3, 2, 1) for i in range(len(words) - n + 1)))
    grams = [g for g in grams if len(g) >= 2 and g != " ".join(words)][:MAX_NGRAMS]
    names = saved(graph.filter("kind in ('has_keyword', 'in_field')").select(F.col("dst").alias("term")).distinct(), "terms")  # each layer reads them
    exact = names.filter(F.col("term") == " ".join(words)).select("term", F.lit(0).alias("layer"))
    gram = names.filter(F.col("term").isin(grams)).select("term", F.lit(1).alias("layer"))
    parts = [names.filter(F.col("term").contains(w)).orderBy("term").limit(PER_SUBSTRING).select("term", F.lit(2).alias("layer")) for w in words if len(w) >= 3]
    found = exact.unionByName(gram)
    for p in parts:
        found = found.unionByName(p)
    found = found.groupBy("term").agg(F.min("layer").alias("layer"))
    relevance = F.element_at(F.array(*map(F.lit, RELEVANCE.values())), F.col("layer") + 1)
    return found.select("term", relevance.alias("relevance"), F.row_number().over(Window.orderBy("layer", "term")).alias("seq"))  # at most MAX_NGRAMS and a few rows


def search(graph: DataFrame, found: DataFrame, k: int = 50) -> DataFrame:
    """(paper_id, score): papers of the anchors, and, weighted less, of terms that co-occur with them."""
    has = graph.filter("kind in ('has_keyword', 'in_field')").select("src", "dst")
    first = has.join(F.broadcast(found), F.col("dst") == F.col("term")).select(F.col("src").alias("paper_id"), (F.col("relevance") * HOP_WEIGHTS[0]).alias("score"))
    near = cooccurring(graph, found.select("term")).join(F.broadcast(found), "term")
    near = near.join(F.broadcast(found.select(F.col("term").alias("other"))), "other", "left_anti")
    owner = Window.partitionBy("other").orderBy("seq")  # the first anchor to reach a term expands it
    near = near.withColumn("r", F.row_number().over(owner)).filter("r = 1")
    boost = F.col("relevance") * HOP_WEIGHTS[1] * F.col("papers") / (F.col("papers") + 1)
    second = has.join(F.broadcast(near.select("other", boost.alias("score"))), F.col("dst") == F.col("other")).select(F.col("src").alias("paper_id"), "score")
    return first.unionByName(second).groupBy("paper_id").agg(F.sum("score").alias("score")).orderBy(F.desc(F.round("score", 9)), "paper_id").limit(k)


def recommendations(graph: DataFrame, found: DataFrame, k: int = 20) -> DataFrame:
    """(work, papers): the outside works that most papers of the anchors cite."""
    has = graph.filter("kind in ('has_keyword', 'in_field')")
    mine = has.join(F.broadcast(found), F.col("dst") == F.col("term")).select("src").distinct()
    cites = graph.filter("kind = 'cites'").join(mine, "src", "left_semi")
    return cites.groupBy(F.col("dst").alias("work")).agg(F.countDistinct("src").alias("papers")).orderBy(F.desc("papers"), "work").limit(k)


def covers(graph: DataFrame) -> DataFrame:
    """(field, keyword, papers): keywords of the papers of each field."""
    field = graph.filter("kind = 'in_field'").select("src", F.col("dst").alias("field"))
    words = graph.filter("kind = 'has_keyword'").select("src", F.col("dst").alias("keyword"))
    return field.join(words, "src").groupBy("field", "keyword").agg(F.countDistinct("src").alias("papers"))


def promoted(graph: DataFrame, cited: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges after works that have become papers are rewired to them, by DOI or else by title: cites turn into cross_cites, once each.

    cited: the works (:func:`works`) of the graph's references.
    """
    known = _resolved(cited, papers).filter("name is not null").groupBy("name")
    known = known.agg(F.coalesce(F.max("by_doi"), F.max("by_title")).alias("local")).filter("local is not null")
    cites, others = _cites(graph)
    joined = cites.join(known, F.col("dst") == F.col("name"), "left").filter("local is null or local <> src")
    rewired = joined.select("src", F.when(F.col("local").isNull(), F.col("kind")).otherwise("cross_cites").alias("kind"), F.coalesce(F.col("local").cast("string"), "dst").alias("dst"))
    return others.select("src", "kind", "dst").unionByName(rewired).distinct()


def renamed(graph: DataFrame, cited: DataFrame) -> DataFrame:
    """Edges to works whose identity has come to be another one: a DOI is known now, or works turned out to be one."""
    keys = cited.filter("name is not null").select(F.col("t").alias("key"), "name").unionByName(cited.filter("name is not null and d is not null").select(F.col("d").alias("key"), "name"))
    names = keys.filter("name <> key").groupBy("key").agg(F.min("name").alias("now"))
    cites, others = _cites(graph)
    joined = cites.join(names, F.col("dst") == F.col("key"), "left")
    return others.select("src", "kind", "dst").unionByName(joined.select("src", "kind", F.coalesce("now", "dst").alias("dst"))).distinct()


def added(graph: DataFrame, new: DataFrame, papers: DataFrame, references: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """The graph with new papers, or with new versions of papers: their own edges are built anew, those that lead to them are promoted.

    papers: all papers, the new ones among them; references: of all papers; keywords as for :func:`edges`.
    """
    mine = references.join(new.select("paper_id"), "paper_id", "left_semi")
    words = None if keywords is None else keywords.join(new.select("paper_id"), "paper_id", "left_semi")
    terms = edges(new, references.limit(0), words)
    kept = graph.join(new.select(F.col("paper_id").alias("src")), "src", "left_anti")
    # A new paper's own edges resolve against all papers, those of others only against the new ones.
    cited = works(references)
    return promoted(renamed(kept, cited), cited, new).unionByName(terms).unionByName(cited_edges(papers, mine, cited).filter("dst is not null and dst <> ''")).distinct()


def removed(graph: DataFrame, paper_id: int) -> DataFrame:
    """The graph without a paper: neither its own edges stay nor those that lead to it."""
    into = (F.col("kind") == "cross_cites") & (F.col("dst") == str(paper_id))
    return graph.filter((F.col("src") != paper_id) & ~into)


def term_neighbours(graph: DataFrame, term: str, k: int = 20) -> DataFrame:
    """(kind, name, n): a term's papers (n of each is the number of all its papers) and the keywords that most of its papers have, k of each."""
    at = graph.filter(graph["kind"].isin("has_keyword", "in_field") & (F.col("dst") == " ".join(term.lower().split()))).select("src").distinct()
    listed = at.orderBy("src").limit(k).crossJoin(F.broadcast(at.agg(F.count(F.lit(1)).alias("n"))))  # one row of a total
    papers = listed.select(F.lit("paper").alias("kind"), F.col("src").cast("string").alias("name"), "n")
    beside = graph.filter("kind = 'has_keyword'").filter(F.col("dst") != " ".join(term.lower().split())).join(at, "src", "left_semi")
    beside = beside.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(k)
    return papers.unionByName(beside.select(F.lit("keyword").alias("kind"), F.col("dst").alias("name"), "n"))


def paper_neighbours(graph: DataFrame, paper_id: int, k: int = 20) -> DataFrame:
    """(kind, name): a paper's terms and cited works, k of each kind by name, and the papers that cite it, k by id."""
    out = graph.filter(F.col("src") == paper_id).select("kind", F.col("dst").alias("name"), F.lit(0).cast("bigint").alias("place"))
    into = graph.filter((F.col("kind") == "cross_cites") & (F.col("dst") == str(paper_id))).select(F.lit("cited_by").alias("kind"), F.col("src").cast("string").alias("name"), F.col("src").alias("place"))
    order = Window.partitionBy("kind").orderBy("place", "name")
    return out.unionByName(into).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("kind", "name")


def explained(graph: DataFrame, found: DataFrame) -> DataFrame:
    """(term, relevance, n, paper_ids): the anchors of a query with their papers, the first of them by id."""
    has = graph.filter("kind in ('has_keyword', 'in_field')").join(F.broadcast(found), F.col("dst") == F.col("term")).select("term", "relevance", "src").distinct()
    ranked = has.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy("src")))
    return ranked.groupBy("term", "relevance").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= LISTED, F.col("src")))).alias("paper_ids"))
