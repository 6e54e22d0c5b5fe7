"""Texts, lines with positions, and scalars that the tables don't exercise."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.vectors import mean_pooled
from lectern.operators import documents, layout, reading


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_embedding_texts(spark):
    lit = F.lit
    row = spark.range(1).select(
        reading.reference_text(lit("T"), lit("raw"), F.array(lit("A"), lit("B"), lit("C"), lit("D")), lit("2020")).alias("a"),
        reading.reference_text(lit(""), lit("raw"), F.array().cast("array<string>"), lit("")).alias("b"),
        reading.reference_text(lit(None), lit(None), F.array().cast("array<string>"), lit(None)).alias("c"),
        reading.summary_text(lit(" S "), lit("F"), lit(None), F.array(lit("x"), lit("y"))).alias("d"),
        reading.label(lit(None), F.array().cast("array<string>"), lit(None), lit(7)).alias("e"),
        reading.section_text(lit("H"), lit("b")).alias("f"), reading.yaml_text(lit(None)).alias("g"),
    ).first()
    assert (row.a, row.b, row.c) == ("T [A, B, C, et al.] (2020)", "raw", " ")
    assert (row.d, row.e, row.f, row.g) == ("S\nField: F\nKey findings: x; y", "ref#7", "H\nb", '""')


@pytest.mark.parametrize("raw,doi", [('{"DOI": " 10.1/X "}', "10.1/x"), ('{"doi":"10.1/y\\t"}', "10.1/y"), ("not json", None), ("{}", None), (None, None), ('{"DOI": ""}', None)])
def test_reference_doi(spark, raw, doi):
    assert one(spark, raw, reading.reference_doi) == doi


@pytest.mark.parametrize("raw,found", [('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": {"b": 2}} done', '{"a": {"b": 2}}'), ("none", None), ("{broken", None), ('{"a": 1}', '{"a": 1}')])
def test_model_answers(spark, raw, found):
    assert one(spark, raw, reading.json_object) == found


def test_scalars(spark):
    assert one(spark, ["Zhou P."], reading.last_name, "array<string>") == "Zhou" and one(spark, [], reading.last_name, "array<string>") == ""
    assert one(spark, "10.1234/abc", T.is_doi) and not one(spark, "see 10.1234/abc", T.is_doi) and not one(spark, "10.1234/cnki.5", T.is_doi)
    assert one(spark, "深度 学习 a", T.is_chinese) and not one(spark, "ab 深", T.is_chinese)
    assert one(spark, "\u00a0\t Results \n", T.heading) == "results" and one(spark, " x\t\n", T.stripped) == "x"
    long = "a" * 500 + "b" * 1500 + "c" * 300
    cut = one(spark, long, lambda x: reading.cut_middle(x, 1000))
    assert cut == long[:650] + "\n... [truncated 1380 chars] ...\n" + long[-270:]


@pytest.mark.parametrize("line,kind", [("∑ x", True), ("x ð i Þ y", True), ("12.5, 3", True), ("a b c d", True), ("A plain sentence of words.", False), ("y = 2", True), ("", True)])
def test_equations(spark, line, kind):
    assert one(spark, line, layout.is_equation) is kind


@pytest.mark.parametrize(
    "line,height,head,level",
    [("1. Introduction", 10.0, True, 1), ("2.1. Data sets", 10.0, True, 2), ("3.3.1. Details", 10.0, True, 3), ("Related Work", 10.0, True, 1), ("Results overview", 10.0, True, 2), ("A large title of words", 14.0, True, 1), ("Energy", 14.0, False, 1), ("Available online 3 May 2020", 14.0, False, 1), ("just some body text that goes on.", 10.0, False, 2)],
)
def test_headings(spark, line, height, head, level):
    df = spark.createDataFrame([(line, height)], "t string, h double").select(layout.is_heading(F.col("t"), F.col("h"), F.lit(10.0)).alias("a"), layout.level(F.col("t"), F.col("h"), F.lit(10.0)).alias("b"))
    assert tuple(df.first()) == (head, level)


LINES = "doc int, page int, seq int, x double, y double, width double, height double, text string"


def test_positions(spark):
    rows = [(1, 1, 0, 0.0, 5.0, 90.0, 10.0, "Head 1"), (1, 1, 1, 0.0, 300.0, 90.0, 10.0, "a"), (1, 1, 2, 0.0, 312.0, 90.0, 10.0, "b"), (1, 1, 3, 200.0, 300.0, 90.0, 10.0, "c"), (1, 1, 4, 200.0, 340.0, 90.0, 10.0, "d"), (1, 2, 0, 0.0, 5.0, 90.0, 10.0, "Head 2"), (1, 2, 1, 0.0, 300.0, 90.0, 10.0, "a")]
    lines = spark.createDataFrame(rows, LINES)
    assert {(r.page, r.text) for r in layout.running_heads(lines, 800.0).collect()} == {(1, "Head 1"), (2, "Head 2")}
    placed = layout.columns(lines)
    assert {(r.page, r.text): r["column"] for r in placed.collect()}[1, "c"] == 1
    assert [r.text for r in layout.reading_order(placed).orderBy("place").collect()] == ["Head 1", "a", "b", "c", "d", "Head 2", "a"]
    assert {r.text for r in layout.paragraphs(placed).collect()} == {"Head 1", "a b", "c", "d", "Head 2", "a"}
    assert {(r.doc, r.body) for r in layout.body_height(lines).collect()} == {(1, 10.0)}
    spans = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0, "one"), (1, 1, 1, 12.0, 1.0, 10.0, 10.0, "line"), (1, 1, 2, 0.0, 20.0, 10.0, 10.0, "next")], LINES)
    assert {r.text for r in layout.joined_spans(spans).collect()} == {"one line", "next"}
    links = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 5.0, 5.0, "u"), (1, 1, 1, 8.0, 0.0, 30.0, 9.0, "v")], "doc int, page int, number int, x0 double, y0 double, x1 double, y1 double, target string")
    assert {(r.seq, r.target) for r in layout.linked(spans, links).collect()} == {(0, "v"), (1, "v"), (2, None)}


def test_sorted_ranges(spark):
    values = spark.createDataFrame([(float(v),) for v in [1, 2, 4, 4, 9, 9.5, 20, 21, 21.5]], "value double")
    assert tuple(documents.largest_gap(values, 2).first()) == (9.5, 20.0, 10.5)
    samples = spark.createDataFrame([(float(v), v < 10) for v in [1, 2, 4, 4, 12, 9, 20, 21]], "value double, positive boolean")
    assert tuple(documents.best_threshold(samples, 2).first()) == (10.5, 1.0)


def test_paper_embeddings(spark):
    papers = spark.createDataFrame([(1, [9.0]), (2, [7.0])], "paper_id bigint, abstract array<float>")
    chunks = spark.createDataFrame([(1, 10, [1.0]), (1, 10, [3.0]), (1, 11, [6.0])], "paper_id bigint, section_id bigint, embedding array<float>")
    assert {r.paper_id: r.fulltext for r in reading.paper_embeddings(papers, chunks, mean_pooled).collect()} == {1: [4.0], 2: [7.0]}
