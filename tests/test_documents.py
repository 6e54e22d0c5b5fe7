import random

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import documents


def test_order_statistics_of_skewed_groups(spark):
    r = random.Random(2)
    rows = [("all", r.choice([r.randint(-5, 5), r.randint(0, 10**12), 7])) for _ in range(3000)] + [(None, 4), (None, 9), ("one", 3), ("nulls", None), ("two", -2), ("two", None)]
    df = spark.createDataFrame(rows, "g string, n bigint").repartition(6)
    shares = {"p0": 0.0, "p10": 0.1, "mid": 0.5, "p99": 0.99, "p100": 1.0}
    for parts in (3, 1024):
        got = {x.g: tuple(x)[1:] for x in documents.order_statistics(df, "g", "n", shares, parts).collect()}
        assert set(got) == {"all", None, "one", "two"}
        for g in got:
            want = np.quantile([n for k, n in rows if k == g and n is not None], list(shares.values()))
            assert np.allclose(np.asarray(got[g], float), want, rtol=1e-12), g


def test_one_group_is_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.lit("all").alias("g"), (F.col("id") * 7919 % 100_003).alias("n_chars"))
    got = documents.page_statistics(df, "g").first()
    n = np.arange(20_000) * 7919 % 100_003
    assert (got.pages, got.median, got.p10, got.p25) == (20_000, *(float(np.quantile(n, q)) for q in (0.5, 0.1, 0.25)))
    assert documents.page_statistics(df.limit(0), "g").count() == 0


def test_citations_are_located_in_tasks_of_bounded_rows(spark):
    """As many tasks as the rows ask for, whatever the number of shuffle partitions is."""
    cited = spark.createDataFrame([(p, 100 + p, p % 4) for p in range(40)] + [(1, 7, 9)], "paper_id bigint, citation bigint, page int")
    spans = spark.createDataFrame([(p, s, s, s + 1) for p in range(40) for s in (0, 1, 2)], "paper_id bigint, section int, page_start int, page_end int")
    out = documents.located(cited, spans, per_task=10)
    assert out.rdd.getNumPartitions() == 12
    assert {tuple(r) for r in out.collect()} == {(p, 100 + p, max(0, p % 4 - 1)) for p in range(40)} | {(1, 7, None)}
