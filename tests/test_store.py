from pyspark.sql import functions as F

from lectern.operators import retrieval
from lectern.plans import schema
from lectern.plans.store import MAX_LAYERS, VersionedTable, backfill, cascade, differences, replace_children
from lectern.sources import tables
from lectern.streaming.incremental import ingest_new, keep_postings


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["paper_id"])
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "paper_id bigint, title string")
    assert t.insert_ignore(rows) == 2
    assert t.insert_ignore(rows) == 0
    t.upsert(spark.createDataFrame([(2, "c")], "paper_id bigint, title string"))
    t.update(spark.createDataFrame([(1, None), (2, "d")], "paper_id bigint, title string"), ["title"])
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "d")}
    cascade(spark.createDataFrame([(1,)], "paper_id bigint"), {"t": t})
    assert [r.paper_id for r in t.read().collect()] == [2]
    assert t.read(1).count() == 2


def test_incremental_postings_equal_batch(spark, tmp_path):
    papers = tables.papers(spark, "/root/testdata/sf0.001").select("paper_id", "title", "abstract").limit(20).cache()
    for k in range(2):
        papers.filter(F.col("paper_id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(papers.schema).parquet(str(tmp_path / "in"))
        index = VersionedTable(spark, str(tmp_path / "index"), ["paper_id"])
        keep_postings(stream, index, str(tmp_path / "check")).awaitTermination()
    whole = retrieval.postings(papers, ("title", "abstract"))
    assert index.read().exceptAll(whole).count() == 0 and index.read().count() == whole.count()


def test_ingest_once(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.pdf").write_bytes(b"x")
    (tmp_path / "files" / "b.pdf").write_bytes(b"x")
    found = tables.scan_files(spark, str(tmp_path / "files"))
    assert found.select("sha256").distinct().count() == 1
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).load(str(tmp_path / "files")).withColumn("sha256", F.sha2("content", 256))
    store = VersionedTable(spark, str(tmp_path / "store"), ["sha256"])
    ingest_new(stream, store, str(tmp_path / "c")).awaitTermination()
    assert store.read().count() == 1


def test_blocks_and_labels(spark, tmp_path):
    (tmp_path / "x_content_list.json").write_text('[{"type": "text", "text": "A", "text_level": 1, "page_idx": 0}, {"type": "table", "table_body": "<table></table>", "page_idx": 1}]')
    blocks = tables.scan_blocks(spark, str(tmp_path / "x_content_list.json")).orderBy("seq").collect()
    assert [b.block.type for b in blocks] == ["text", "table"]
    (tmp_path / "l.csv").write_text("filename,is_scanned\na.pdf, Yes\nb.pdf,0\n")
    assert {tuple(r) for r in tables.scan_labels(spark, str(tmp_path / "l.csv")).collect()} == {("a.pdf", True), ("b.pdf", False)}


def test_layers_fold_and_keep_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    t.replace(spark.createDataFrame([(i, "base") for i in range(20)], "k int, v string"))
    expected = dict.fromkeys(range(20), "base")
    for n in range(MAX_LAYERS + 3):
        t.upsert(spark.createDataFrame([(n, f"v{n}"), (100 + n, "new")], "k int, v string"))
        expected |= {n: f"v{n}", 100 + n: "new"}
        if n % 3 == 0:
            t.delete(spark.createDataFrame([(n,)], "k int"))
            del expected[n]
        if n == 2:
            at, then = t.versions()[-1], dict(expected)
        assert {r.k: r.v for r in t.read().collect()} == expected
    assert {r.k: r.v for r in t.read(at).collect()} == then and t.versions()[0] == 1
    t.put(spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([(1,)], "k int"))
    assert sorted(r.v for r in t.read().filter("k = 1").collect()) == ["x", "y"]


def test_maintenance(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["s", "i"])
    t.replace(spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", "x"), (2, 0, "c", None)], "s int, i int, text string, kind string"))
    replace_children(t, spark.createDataFrame([(1, 0, "new", None)], "s int, i int, text string, kind string"), "s")
    assert sorted((r.s, r.i, r.text) for r in t.read().collect()) == [(1, 0, "new"), (2, 0, "c")]
    assert backfill(t, "kind", F.upper("text"), dry_run=True) == 2 and backfill(t, "kind", F.upper("text")) == 2
    assert {r.kind for r in t.read().collect()} == {"NEW", "C"} and backfill(t, "kind", F.upper("text")) == 0
    t.update(spark.createDataFrame([(2, 0, None)], "s int, i int, kind string"), ["kind"], keep=False)
    assert [r.kind for r in t.read().filter("s = 2").collect()] == [None]
    old, new = (spark.createDataFrame(r, "k int, a string, b int") for r in ([(1, "x", 1), (2, None, 2)], [(1, "x", 3), (2, None, 2)]))
    assert [tuple(r) for r in differences(old, new, "k", ["a", "b"]).collect()] == [(1, "b", "1", "3")]


def test_schema_is_made_once_and_migrated(spark, tmp_path):
    root = str(tmp_path)
    assert schema.version(spark, root) == 0
    old = spark.createDataFrame([(1, "Old paper", "2024-01-01", "kept")], "paper_id bigint, title string, ingested_at string, extra string")
    schema.table(spark, root, "papers").replace(old)
    assert schema.create(spark, root) == schema.VERSION == schema.create(spark, root)
    papers = schema.table(spark, root, "papers")
    assert len(papers.versions()) == 2 and "publication_year" in papers.read().columns
    row = papers.read().first()
    assert (row.title, row.publication_year, row.extra, row.ingested_at.year) == ("Old paper", None, "kept", 2024)
    assert all(schema.table(spark, root, n).versions() for n in schema.TABLES)
