"""The pipeline's stages, each against what it has to do with its own input."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import jaccard_join, mixing, substring_dedup, toxicity
from lectern.llm.common import WORD, table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "suffix-array dedup", "mixing to target weights", "best-fit packing"]
    docs, inputs = table(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == inputs[0].columns
    first, second, third, fourth, fifth = inputs
    model = toxicity.train(first, table(spark, SF, "labels"))
    toxic = {r.doc_id for r in toxicity.score(first, model).filter("predicted = 1").collect()}
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r in first.collect()} - toxic
    kept = {r.component_id for r in jaccard_join.similar_components(second).collect()}
    assert sorted(r.doc_id for r in third.collect()) == sorted(kept)
    found = {r.doc_id: r for r in substring_dedup.find_repeats(third).collect()}
    for r in fourth.collect():
        assert len(r.text.encode()) <= found[r.doc_id].n_bytes - found[r.doc_id].n_removed and r.n_chars == len(r.text)
    assert {i for i, r in found.items() if r.n_removed == 0} <= {r.doc_id for r in fourth.collect()}
    taken = mixing.mix_plan(fourth).agg(F.sum("taken")).first()[0]
    assert sum(len(re.findall(WORD, r.text)) for r in fifth.collect()) == taken
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [tok.encode(r.text, add_special_tokens=False).ids + [0] for r in fifth.collect()]
    pieces = docs.collect()
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    crcs = {zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in ids if len(x) <= 2048}
    assert crcs <= {p.ids_crc32 for p in pieces}


def tables(spark, path, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, `_row` string, shard int, `a.b` string, size string")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns with names that the stages use."""
    rng = np.random.default_rng(2)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    plain = lambda n: " ".join(rng.choice(vocabulary, n))
    row = lambda i, t, s="s1": (i, t, None, s, None if t is None else len(t), "x", 1, None, "y")
    rows = [row(i, plain(60), ["s1", "s2", None][i % 3]) for i in range(60)]
    rows += [row(100 + i, plain(40) + " you absolute moronix fool") for i in range(40)]
    rows += [row(None, None), row(None, plain(30)), row(None, plain(30)), row(200, None), row(201, ""), row(202, " \n\t"), row(203, plain(200_000)), rows[0], rows[0], row(1, rows[1][1]), row(204, "one two"), row(205, "One  two")]
    sf = tables(spark, tmp_path / "odd", rows, [(100 + i, 1, 1) for i in range(40)] + [(i, 1, 0) for i in range(60)] + [(None, None, None)])
    docs, seen = table(spark, sf, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert k == 4 or docs.columns == table(spark, sf, "documents").columns
        seen.append(docs.collect())
    clean, once, cut, mix, pieces = seen
    ids = lambda some: sorted(r.doc_id for r in some if r.doc_id is not None)
    assert not any(100 <= i < 140 for i in ids(clean)) and ids(clean)[:5] == [0, 0, 0, 1, 1] and sum(r.doc_id is None for r in clean) == 3
    # One row for each text's class; rows without an id or a word stay.
    assert ids(once) == sorted([*range(60), 200, 201, 202, 203, 204]) and sum(r.doc_id is None for r in once) == 3
    assert ids(cut) == ids(once) and max(len(r.text or "") for r in cut) > 1_000_000
    assert {200, 201, 202}.isdisjoint(ids(mix)) and {r.doc_id for r in mix} <= {r.doc_id for r in cut}
    assert max(Counter(ids(mix)).values()) <= 3 and {r.row for r in pieces} and len({(r.row, r.piece) for r in pieces}) == len(pieces)
    words = {r.doc_id: len(re.findall(WORD, r.text or "")) for r in cut if r.doc_id is not None}
    assert all(len(re.findall(WORD, r.text)) <= words[r.doc_id] for r in mix if r.doc_id is not None)


def test_empty_table(spark, tmp_path):
    sf = tables(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
