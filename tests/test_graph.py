"""The knowledge graph, coupling and recall on small libraries."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import coupling, graph, retrieval

PAPERS = "paper_id bigint, keywords array<string>, field string, doi string, title string"


@pytest.fixture(scope="module")
def library(spark):
    papers = spark.createDataFrame(
        [(1, ["Deep  Learning", "Graphs"], "CS", "10.1/A ", "A first paper"), (2, ["graphs"], "cs", None, "The Second: Paper!"), (3, None, None, None, "short"), (4, ["Trees"], "Bio", "10.1/D", "Another second paper")],
        PAPERS,
    )
    refs = spark.createDataFrame(
        [
            (2, "10.1/a", "whatever"), (1, None, "the second paper"), (1, "10.9/x", "The second paper"), (3, None, "Short"), (1, " 10.9/Y", "Outside work"), (2, None, "outside  WORK"), (4, None, "abc"),
            (1, "10.1/A", "itself"), (3, "10.5/q", ""), (4, None, "Lone title"),
        ],
        "paper_id bigint, doi string, title string",
    )
    return papers, refs


def found(df):
    return {tuple(r) for r in df.collect()}


def test_edges_by_doi_and_title(library):
    got = found(graph.edges(*library))
    assert {e for e in got if e[1] == "has_keyword"} == {(1, "has_keyword", "deep learning"), (1, "has_keyword", "graphs"), (2, "has_keyword", "graphs"), (4, "has_keyword", "trees")}
    assert {e for e in got if "cites" in e[1]} == {
        (2, "cross_cites", "1"), (1, "cross_cites", "2"),  # by DOI whatever its case; by title, with a DOI that nobody has or none
        (3, "cites", "short"), (1, "cites", "10.9/y"), (2, "cites", "10.9/y"), (4, "cites", "lone title"),  # too short for a paper; a DOI known through another reference
    }


def test_term_edges_and_anchors_read_once(library, spark, monkeypatch):
    """Searches follow edges to terms only, and a question's anchors are looked for once, not by each hop."""
    whole = graph.edges(*library)
    terms = graph.term_edges(library[0])
    assert found(terms) == {e for e in found(whole) if "cites" not in e[1]}
    calls = []
    monkeypatch.setattr(retrieval, "saved", lambda df, label: calls.append(label) or df)
    paths = retrieval.recall(retrieval.Library(library[0], graph=terms), "deep graphs", None, mode="graph")
    assert "anchors" in calls and found(paths["graph"]) == found(graph.search(whole, graph.anchors(whole, "deep graphs")))


def test_displayed_works_move_names_and_papers_only(spark):
    """Titles are chosen among works, not among references: the count of papers by reference carries no title along."""
    from lectern.operators import identity

    refs = spark.createDataFrame([(7, None, "b"), (7, None, "b"), (3, "D", "c"), (9, "D", "a"), (9, "d", "a"), (4, None, ""), (5, None, None)], "paper_id bigint, doi string, title string")
    works = spark.createDataFrame([(None, "b", None, "b"), ("D", "c", "d", "d"), ("D", "a", "d", "d"), ("d", "a", "d", "d"), (None, "x", None, None)], "doi string, title string, d string, name string")
    out = identity.displayed(refs, works)
    assert found(out) == {("b", "b", None, 1), ("d", "c", "d", 2)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" in plan and not [x for x in plan.splitlines() if "min_by" in x and "count(distinct" in x]


def test_adding_and_removing(library, spark):
    papers, refs = library
    whole = found(graph.edges(papers, refs))
    for new in ([4], [2], [1, 3]):
        early, late = papers.filter(~F.col("paper_id").isin(new)), papers.filter(F.col("paper_id").isin(new))
        old = graph.edges(early, refs.filter(~F.col("paper_id").isin(new)))
        assert found(graph.added(old, late, papers, refs)) == whole, new
        assert found(graph.added(graph.edges(papers, refs), late, papers, refs)) == whole
    assert found(graph.removed(graph.edges(papers, refs), 1)) == {e for e in whole if e[0] != 1 and e != (2, "cross_cites", "1")}
    assert found(graph.term_neighbours(graph.edges(papers, refs), " Graphs ")) == {("paper", "1", 2), ("paper", "2", 2), ("keyword", "deep learning", 1)}
    assert ("cited_by", "2") in found(graph.paper_neighbours(graph.edges(papers, refs), 1))


def test_coupling(spark):
    refs = spark.createDataFrame([(p, d, t) for p, d, t in [(1, "x", "One Title"), (2, "x", "one title"), (3, "x", "Two"), (3, None, "ONE  title"), (4, "", "One title?"), (4, "y", None)]], "paper_id bigint, doi string, title string")
    assert found(coupling.doi_classes(refs)) == {("x", 1, 3), ("x", 2, 3), ("x", 3, 3)}
    assert found(coupling.title_classes(refs)) == {("one title", p, 4) for p in (1, 2, 3, 4)}
    asked = spark.createDataFrame([(3,), (1,)], "paper_id bigint")
    pairs = found(coupling.by_doi(refs, asked).select("paper_a", "paper_b"))
    assert pairs == {(1, 2), (1, 3), (2, 3)} and coupling.by_doi(refs, asked).count() == 3
    rows = spark.createDataFrame([(1, 2, "b", 0.95, None, 0.5, None), (1, 2, "a", 0.95, "uses", None, None), (1, 2, "c", 1.0, None, 0.25, "why")], "paper_a int, paper_b int, title string, confidence double, relationship string, similarity double, explanation string")
    assert found(coupling.pair_detail(rows)) == {(1, 2, 3, "uses", 0.25, "why")}
    assert coupling.stored(rows, rows.filter("title <> 'a'")).count() == 1


def test_vectors_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 3))
    rows = [(i, [float(x) for x in v[i]]) for i in range(60)] + [(60, None), (61, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "paper_id bigint, embedding array<double>")
    got = {(r.paper_a, r.paper_b) for r in coupling.by_embedding(df.filter("paper_id % 5 = 0"), df, 0.9, block=7).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == {(i, j) for i in range(0, 60, 5) for j in range(60) if i != j and unit[i] @ unit[j] >= 0.9}


def test_recall_by_intent_and_route(spark, library):
    papers = spark.createDataFrame([(i, f"title {i}", f"text number {i} about trees", "[]") for i in range(5)], "paper_id bigint, title string, abstract string, keywords string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "paper_id bigint, embedding array<double>")
    lib = retrieval.Library(papers, vectors, vectors.withColumn("section_type", F.lit("abstract")), vectors, graph.edges(*library))
    query = retrieval.query_vector([1.0, 0.0])
    paths = lambda q, **k: set(retrieval.recall(lib, q, k.pop("vector", query), **k))
    assert paths("what about trees", mode="hybrid") == {"vector", "fts"}
    assert paths("summarize trees", mode="all") == {"vector", "fts", "graph", "section", "viewpoint"}
    assert paths("what is trees", mode="vector") == {"vector", "section"}
    assert paths("doi: 10.1/x") == {"fts"} and paths("summarize this", vector=None, mode="all") == {"fts", "graph"}
    assert paths("trees", mode="graph") == {"graph"}
    hits = retrieval.answer(lib, "summarize trees", query, mode="all", top_k=3).collect()
    assert len(hits) == 3 and {"vector", "fts", "section", "viewpoint"} <= set(hits[0].source_ranks)
    reranked = retrieval.answer(lib, "trees", query, mode="hybrid", top_k=2, rerank=lambda h: h.orderBy(F.desc("paper_id"))).collect()
    assert [h.paper_id for h in reranked] == [4, 3]


def test_full_text_folds_accents(spark):
    papers = spark.createDataFrame([(1, "Étude", "le café noir", '["a_b"]'), (2, "x", "caf and noir", "[]"), (3, "for batteries", "", "[]"), (4, "batteries for", "", "[]")], "paper_id bigint, title string, abstract string, keywords string")
    hits = lambda q: [r.paper_id for r in retrieval.bm25_search(papers, q).collect()]
    assert hits("CAFE noir") == [1] and hits("étude") == [1] and set(hits("café missing noir")) == {1, 2}
    assert hits("for_batteries") == [3] and hits("a b") == [] and hits("") == []
    index = retrieval.postings(papers)
    assert [r.paper_id for r in retrieval.indexed_search(index, retrieval.lengths(papers), "CAFÉ noir").collect()] == [1]


def test_identity_through_chains(spark):
    from lectern.operators import identity

    refs = [
        (5, None, "Alpha work"), (1, "10.1/b", "Alpha work"), (2, "10.1/b", "Beta work"), (3, "10.1/A", "Beta Work!"), (4, "10.1/a", "Gamma work"), (6, None, "gamma work"),
        (7, None, "Delta work"), (8, "10.2/x", "Epsilon"), (9, "10.2/x", "Zeta one"), (9, "10.3/y", "abc"),
    ]
    refs = spark.createDataFrame(refs, "paper_id bigint, doi string, title string")
    works = graph.works(refs)
    names = {r.title: r.name for r in works.collect()}
    assert {names[t] for t in ("Alpha work", "Beta work", "Beta Work!", "Gamma work", "gamma work")} == {"10.1/a"}
    assert (names["Delta work"], names["Epsilon"], names["Zeta one"], names["abc"]) == ("delta work", "10.2/x", "10.2/x", None)
    shown = {r.name: (r.display, r.doi, r.papers) for r in identity.displayed(refs, works).collect()}
    assert shown["10.1/a"] == ("Alpha work", "10.1/a", 6) and shown["delta work"] == ("Delta work", None, 1) and shown["10.2/x"][2] == 2
    old = spark.createDataFrame([(3, "cites", "10.1/b"), (5, "cites", "alpha work"), (7, "cites", "delta work")], "src bigint, kind string, dst string")
    assert found(graph.renamed(old, works)) == {(3, "cites", "10.1/a"), (5, "cites", "10.1/a"), (7, "cites", "delta work")}


def test_components_of_long_chains(spark):
    from lectern.operators import identity

    links = [(f"k{i:04d}", f"k{i + 1:04d}") for i in range(300)] + [("z2", "z1"), ("z3", "z1"), ("z4", "z3")]
    got = {r.key: r.component for r in identity.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert len(got) == 305 and {v for k, v in got.items() if k[0] == "k"} == {"k0000"} and {v for k, v in got.items() if k[0] == "z"} == {"z1"}


def test_graph_scores_that_differ_by_the_order_of_a_sum_rank_by_id(spark):
    hits = spark.createDataFrame([(7, 0.1 + 0.2 + 0.3), (3, 0.3 + 0.2 + 0.1), (9, 0.9)], "paper_id long, score double")  # the first sum is the larger one by its last bit
    assert [(r.paper_id, r.source_ranks["graph"]) for r in retrieval.fuse({"graph": hits}).collect()] == [(9, 1), (3, 2), (7, 3)]


def test_only_edges_to_outside_works_are_joined_by_name(spark):
    edges = spark.createDataFrame([(1, "has_keyword", "10.1/x"), (1, "cites", "10.1/x"), (2, "in_field", "10.1/x"), (9, "cites", "10.1/x"), (3, "cites", "other work")], "src long, kind string, dst string")
    cited = spark.createDataFrame([("10.1/X", "A title", "10.1/x", "a title", "10.1/x"), (None, "Other work", None, "other work", "other work")], "doi string, title string, d string, t string, name string")
    papers = spark.createDataFrame([(9, "10.1/x", "something else"), (8, None, "Other work")], "paper_id long, doi string, title string")
    out = graph.promoted(edges, cited, papers)
    assert sorted(map(tuple, out.collect())) == [(1, "cross_cites", "9"), (1, "has_keyword", "10.1/x"), (2, "in_field", "10.1/x"), (3, "cross_cites", "8")]
    # Terms with edges without number would meet in one task of a join.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and "cites" in line for line in plan.splitlines())


def test_postings_are_counted_without_a_shuffle(spark):
    papers = spark.createDataFrame([(1, "b a", "A, b: b", None), (2, None, "...", None), (3, "x", None, "x y")], "paper_id bigint, title string, abstract string, keywords string")
    index = retrieval.postings(papers)
    assert found(index) == {(1, "a", 5, 2), (1, "b", 5, 3), (3, "x", 3, 2), (3, "y", 3, 1)}
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
