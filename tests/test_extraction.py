from pyspark.sql import functions as F

from lectern.operators import extraction, providers


def test_parsed_references(spark):
    rows = [("[1] Zhou P, Li Q. “Deep models for text,” Journal, 2019. doi: 10.1234/abc.5 ",), ("2. Smith, J. A study of large graph systems. Nature, 2021. arXiv:2101.00001",), ("",)]
    got = extraction.parsed(spark.createDataFrame(rows, "text string"), this_year=F.lit(2024)).collect()
    assert (got[0].number, got[0].title, got[0].year, got[0].authors, got[0].venue) == (1, "Deep models for text", "2019", "Zhou P, Li Q.", "Journal")
    assert got[0].identifiers["DOI"].startswith("10.1234/abc") and got[0].url.startswith("https://doi.org/10.1234")
    assert (got[1].title, got[1].year, got[1].kind, got[1].venue) == ("A study of large graph systems", "2021", "preprint", "Nature")
    assert got[2].number is None and got[2].title == "" and got[2].year is None


def test_citations_and_sentences(spark):
    pages = spark.createDataFrame([(1, 1, "First. As in [2,4-5] we see. Last (7)."), (1, 2, "no³ [9]"), (1, 1, "again [2]")], "doc int, page int, text string")
    got = {(r.page, r.reference): r.sentence for r in extraction.citations(pages).collect()}
    assert set(got) == {(1, 2), (1, 4), (1, 5), (1, 7), (2, 9)} and got[1, 4] == "As in [2,4-5] we see."


def test_author_year(spark):
    pages = spark.createDataFrame([(1, 3, "(Lee, 2020) and Kim et al. (2019), (Roe and Poe, 2018), Nobody (2000)")], "doc int, page int, text string")
    refs = spark.createDataFrame([(1, 10, "Lee", 2020), (1, 11, "Kim", 2019), (1, 12, "Roe", 2018), (1, 13, "Lee", 2019)], "doc int, reference int, first_author string, year int")
    assert {r.reference for r in extraction.author_year_citations(pages, refs).collect()} == {10, 11, 12}


def test_blocks(spark):
    block = "struct<type:string,text:string,text_level:int,img_path:string,img_caption:array<string>,table_body:string,table_caption:array<string>,page_idx:int>"
    b = lambda kind, text, page, table=None: (kind, text, None, None, None, table, None, page)
    rows = [("d", i, x) for i, x in enumerate([b("text", "front", 0), b("title", "Intro", 0), b("text", "a", 0), b("table", None, 1, "<t>"), b("text", "b", 2), b("title", "References", 3), b("text", "[1] a long entry", 3), b("text", "short", 4)])]
    got = extraction.block_sections(spark.createDataFrame(rows, f"doc string, seq int, block {block}")).orderBy("section").collect()
    assert [(r.heading, r.body, r.page_start, r.page_end, r.references) for r in got] == [("(frontmatter)", "front", 1, 1, []), ("Intro", "a b", 1, 3, []), ("References", "", 4, 5, ["[1] a long entry"])]
    assert got[1].tables == ["<t>"]


def test_noise_and_running_lines(spark):
    lines = spark.createDataFrame([(1, 1, "Page 1"), (1, 2, "Page 2"), (1, 2, "text"), (2, 1, "Page 3")], "doc int, page int, line string")
    assert sorted(r.line for r in extraction.running_lines(lines).collect()) == ["Page 1", "Page 2"]
    noise = spark.createDataFrame([("Available online 3 May",), ("a",), ("  ",), ("A sentence.",)], "x string").select(extraction.is_noise(F.col("x")).alias("n"))
    assert [r.n for r in noise.collect()] == [True, True, True, False]


class Counting(providers.NoModel):
    def embed(self, texts):
        assert len(texts) <= providers.BATCH
        return [[float(len(t))] for t in texts]

    def score(self, query, texts):
        return [2.0 if query in t else -1.0 for t in texts]


def test_providers(spark):
    texts = spark.createDataFrame([(i, "x" * i) for i in range(25)], "id int, text string")
    assert {r.id: r.embedding for r in providers.embedded(texts, Counting()).collect()} == {i: [float(max(1, i))] for i in range(25)}
    hits = spark.createDataFrame([(i, float(i), "key" if i == 3 else "none") for i in range(40)], "paper_id bigint, score double, abstract string")
    got = providers.reranked(hits, Counting(), "key", 2).collect()
    assert [(r.paper_id, r.rerank) for r in got] == [(39, 0.0), (38, 0.0)]
    assert [r.paper_id for r in providers.reranked(hits.filter("paper_id < 10"), Counting(), "key", 2).collect()] == [3, 9]
    pairs = spark.createDataFrame([(1, 2)], "paper_a bigint, paper_b bigint")
    assert providers.related(pairs, hits, providers.NoModel()).first().relationship == "other"


def test_reference_scores(spark):
    refs = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "paper_id int, part int")
    scores = spark.createDataFrame([(1, 1, 12.0, "dataset"), (1, 2, 3.0, "nonsense")], "paper_id int, part int, score double, relationship string")
    got = {r.part: (r.score, r.relationship) for r in providers.with_reference_scores(refs, scores).collect()}
    assert got == {1: (10.0, "dataset"), 2: (3.0, "other"), 3: (0.0, "other")}
