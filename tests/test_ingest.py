import pytest
from pyspark.sql import functions as F

from lectern.operators import ingest

SECTION = "struct<heading:string,level:int,page_start:int,page_end:int,paragraphs:array<string>,tables:array<struct<html:string,markdown:string,caption:string,page:int>>,formulas:array<struct<latex:string,type:string,page:int>>,images:array<struct<path:string,caption:string,page:int>>>"
REFERENCE = "struct<number:int,text:string,doi:string,citations:array<struct<page:int,sentence:string>>>"
PAPER = f"key string, title string, doi string, sections array<{SECTION}>, references array<{REFERENCE}>"


def papers(spark, n):
    rows = [("p0", "empty", None, None, None), ("p1", "t", " 10.1/x ", [], [])]
    for k in range(2, n):
        sections = [(f"h{s}", 1, 1, 2, ["a", "b"], [("<t>", None, None, None)] * (k % 3), [("", None, 1), ("x^2", None, None), (None, "inline", 2), ("y", "inline", 3)][: k % 5], [(None, "c", 1), ("img", None, 2)]) for s in range(k % 4)]
        rows.append((f"p{k:03d}", f"t{k}", None, sections, [(r, f"ref {r}", " d ", [(p, "s") for p in range(r)]) for r in range(k % 3)] + [(None, None, None, None)]))
    return spark.createDataFrame(rows, PAPER)


def found(tables):
    return {k: sorted(map(tuple, v.collect())) for k, v in tables.items()}


def test_ids_and_foreign_keys(spark):
    df = papers(spark, 40)
    whole = found(ingest.paper_tables(df.repartition(1)))
    assert found(ingest.paper_tables(df.repartition(7, F.rand(3)))) == whole
    assert [r[:2] for r in whole["papers"]] == [(i + 1, k) for i, k in enumerate(sorted(r.key for r in df.collect()))]
    for kind in ingest.KINDS:
        assert [r[0] for r in whole[kind]] == list(range(1, len(whole[kind]) + 1)), kind
    section, reference = {r[0]: r[1] for r in whole["sections"]}, {r[0]: r[1] for r in whole["references"]}
    assert all(section[r[1]] == r[2] for kind in ("tables", "formulas", "images") for r in whole[kind])
    assert all(reference[r[1]] == r[2] for r in whole["citations"])
    # The second formula of a section keeps its place though the first one has no LaTeX, and its type is filled in.
    assert {(r[3], r[4], r[5], r[6]) for r in whole["formulas"]} == {(1, "x^2", "block", 0), (3, "y", "inline", 3)} and {r[3] for r in whole["images"]} == {1}
    later = found(ingest.paper_tables(df, {"papers": 101, "sections": 1001}))
    assert later["papers"][0][0] == 101 and later["sections"][0][0] == 1001 and later["tables"][0][1] >= 1001
    assert all(v.count() == 0 for v in ingest.paper_tables(df.limit(0)).values())


def test_tables_count_together(spark, tmp_path):
    store = ingest.Publication(spark, str(tmp_path / "library"))
    tables = ingest.paper_tables(papers(spark, 6))
    assert store.publish(tables) == 1 and store.read("sections").count() == tables["sections"].count()
    broken = tables | {"citations": tables["citations"].withColumn("page", F.raise_error(F.lit("no")))}
    with pytest.raises(Exception, match="no"):
        store.publish(broken)
    assert store.versions() == [1] and store.publish(ingest.paper_tables(papers(spark, 9))) == 3
    assert store.read("papers").count() == 9 and store.read("papers", 1).count() == 6
