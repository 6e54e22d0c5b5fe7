import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with columns whose names the operators use inside."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s1", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in ("size", "block", "node", "spans", "row", "shard", "h1", "token", "_id", "score"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df.repartition(3)

    return build
