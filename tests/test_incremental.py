from pyspark.sql import functions as F

from lectern.operators import coupling, graph
from lectern.plans.store import VersionedTable
from lectern.streaming.incremental import keep_coupling, keep_graph

PAPER, REF = "paper_id bigint, keywords array<string>, field string, doi string, title string", "paper_id bigint, doi string, title string"
PAPERS = [(1, ["graphs"], "cs", "10.1/a", "A first paper on graphs"), (2, ["trees"], "cs", None, "The second paper on trees"), (3, ["graphs"], "bio", "10.9/x", "Outside no longer"), (4, None, None, None, "The fourth paper")]
REFS = [(1, "10.9/x", "Outside no longer"), (1, None, "A shared lone title"), (2, "10.9/x", "Outside no longer"), (2, None, "The fourth paper"), (3, None, "A shared lone title!"), (4, "10.7/q", "Other works"), (3, "10.7/q", "Other works"), (4, None, "a SHARED lone title")]


def found(df):
    return {tuple(r) for r in df.collect()}


def batches(spark, tmp_path, groups):
    """A stream of papers, one file and so one batch for each group of ids; ``seen`` is what has arrived."""
    rows = spark.createDataFrame(PAPERS, PAPER)
    for ids in groups:
        yield rows.filter(F.col("paper_id").isin(ids)), spark.createDataFrame(PAPERS, PAPER).filter(F.col("paper_id") <= max(ids)), spark.createDataFrame(REFS, REF).filter(F.col("paper_id") <= max(ids))


def test_coupling_and_graph_of_batches(spark, tmp_path):
    source, groups = str(tmp_path / "in"), [[1, 2], [3], [4]]
    matches = VersionedTable(spark, str(tmp_path / "matches"), ["paper_a", "paper_b", "title"])
    edges = VersionedTable(spark, str(tmp_path / "edges"), ["src", "kind", "dst"])
    written = []
    for new, papers, refs in batches(spark, tmp_path, groups):
        new.coalesce(1).write.mode("append").parquet(source)
        stream = lambda: spark.readStream.schema(PAPER).parquet(source)
        keep_coupling(stream(), matches, lambda refs=refs: refs, str(tmp_path / "c1")).awaitTermination()
        keep_graph(stream(), edges, lambda papers=papers, refs=refs: (papers, refs), str(tmp_path / "c2")).awaitTermination()
        written.append(tuple(spark.read.parquet(f"{t.root}/v{t.versions()[-1]}/rows").count() for t in (matches, edges)))
    refs, papers = spark.createDataFrame(REFS, REF), spark.createDataFrame(PAPERS, PAPER)
    whole = coupling.analyzed(refs, papers)
    assert found(matches.read().select("paper_a", "paper_b")) == found(whole.select("paper_a", "paper_b")) == {(1, 2), (1, 3), (1, 4), (3, 4)}
    assert found(edges.read().select("src", "kind", "dst")) == found(graph.edges(papers, refs))
    # Paper 3 ends the edges to the work that it is, paper 4 one of paper 2: batches write their own edges and those alone.
    assert sum(w[0] for w in written) == matches.read().count() and written[1][1] == 6 and written[2][1] == 3


def test_matches_by_all_three_ways(spark):
    refs = spark.createDataFrame(REFS, REF)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.05]), (3, [0.0, 1.0]), (4, None)], "paper_id bigint, embedding array<double>")
    got = {tuple(r)[:2] + (r.title, r.confidence) for r in coupling.analyzed(refs, refs.select("paper_id").distinct(), vectors).collect()}
    assert (1, 2, "", 0.9988) in got and (1, 2, "Outside no longer", 1.0) in got and (3, 4, "Other works", 1.0) in got and sum(g[:2] == (3, 4) for g in got) == 2
    mine = spark.createDataFrame([(4,)], "paper_id bigint")
    assert found(coupling.touched(refs, mine).select("paper_id", "title")) == {(p, t) for p, _, t in REFS if "shared" in t.lower() or t == "Other works" or t == "The fourth paper" and False}
