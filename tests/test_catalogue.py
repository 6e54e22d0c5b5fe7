"""Every query of the library against its SQL."""

import duckdb
import pytest

from lectern.plans import catalogue, extraction_queries, identity_queries, ingest_queries, reading_queries  # noqa: F401  (the others register more queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    return [plain(y) for y in x] if isinstance(x, list) else x


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(catalogue.SQL[name])
    names = [c[0] for c in result.description]
    expected = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in result.fetchall())
    assert columns == sorted(names)
    assert sorted(repr([plain(row[c]) for c in columns]) for row in df.collect()) == expected


def test_chunks_are_whole_paragraphs(spark):
    from pyspark.sql import functions as F

    from lectern.operators.documents import chunks

    row = spark.range(1).select(chunks(F.array(*[F.repeat(F.lit("x"), 3000)] * 3)).alias("c")).first()
    assert [len(c) for c in row.c] == [6002, 3000]
    assert len(catalogue.chunk_pack(spark, SF).collect()) >= 200


def test_driver_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_keyword_search_and_its_sql_fold_letters(spark, tmp_path):
    rows = [(1, "An IDIOT\nx", "en", "src1", 10), (2, "a\nthe Idiot", "en", "src1", 11), (3, "an idiot", "en", "src1", 8), (4, "ıdıot İDİOT", "en", "src1", 11), (5, None, "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = [tuple(r) for r in catalogue.keyword_search_all(spark, str(tmp_path)).collect()]
    assert found == con.execute(catalogue.SQL["keyword_search_all"]).fetchall() == [(1, "src1"), (2, "src1"), (3, "src1")]


def test_means_that_round_to_zero_have_no_sign(spark, tmp_path):
    rows = [(0, 0, [-1e-7, 0.5]), (1, 0, [-2e-7, -0.25]), (20, 1, [0.0, -0.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = sorted(tuple(r) for r in catalogue.QUERIES["paper_embeddings"](spark, str(tmp_path)).collect())
    assert repr(found) == repr(sorted(con.execute(catalogue.SQL["paper_embeddings"]).fetchall())) == "[(0, [0.0, 0.125]), (1, [0.0, 0.0])]"
