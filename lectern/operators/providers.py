"""Pluggable models: embeddings, reranking and relating pairs, run in tasks over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

BATCH = 10
RERANK_CANDIDATES, RERANK_CHARS = 30, 600
#: How a pair of papers, a paper and its reference, and a viewpoint and its source may relate.
RELATIONSHIPS = ("builds_on_same_foundation", "competing_methods", "complementary", "methodological_overlap", "benchmarking_overlap", "weak_overlap", "other")
REFERENCE_RELATIONSHIPS = ("foundational", "comparison", "methodology", "dataset", "background", "extension", "other")
VIEWPOINT_CATEGORIES = ("builds_on", "contrasts", "limitation", "motivation", "method_source", "data_source", "example", "other")


class Provider(Protocol):
    """A model; it is pickled to the tasks, so it opens its connections there."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def score(self, query: str, texts: list[str]) -> list[float]: ...

    def relate(self, a: list[str], b: list[str]) -> list[tuple[str, str | None]]: ...


class NoModel:
    """The default: no vectors, no scores, no relations."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[] for _ in texts]

    def score(self, query: str, texts: list[str]) -> list[float]:
        return [0.0 for _ in texts]

    def relate(self, a: list[str], b: list[str]) -> list[tuple[str, str | None]]:
        return [("other", None) for _ in a]


def embedded(texts: DataFrame, provider: Provider, column: str = "text") -> DataFrame:
    """Rows with their embedding; blank texts are sent as one blank, in batches of BATCH."""
    schema = StructType([*texts.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sent = [t if isinstance(t, str) and t.strip() else " " for t in batch[column]]
            found: list = []
            for at in range(0, len(sent), BATCH):
                found += provider.embed(sent[at : at + BATCH])
            yield batch.assign(embedding=found)

    return texts.mapInPandas(run, schema)


def reranked(hits: DataFrame, provider: Provider, query: str, k: int = 20) -> DataFrame:
    """Hits (paper_id, score, abstract) by the model's score from 0 to 1; only the first candidates are asked about."""
    first = hits.orderBy(F.desc("score"), "paper_id").limit(RERANK_CANDIDATES)
    ranked = first.withColumn("prior", F.row_number().over(Window.orderBy(F.desc("score"), "paper_id")))  # RERANK_CANDIDATES rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = provider.score(query, [(t or "")[:RERANK_CHARS] for t in batch["abstract"]])
            yield pd.DataFrame({"paper_id": batch["paper_id"], "prior": batch["prior"], "rerank": [min(1.0, max(0.0, float(s or 0))) for s in scores]})

    scored = ranked.select("paper_id", "prior", "abstract").mapInPandas(run, "paper_id bigint, prior int, rerank double")
    return ranked.drop("prior").join(scored, "paper_id").orderBy(F.desc("rerank"), "prior").limit(k)


def with_reference_scores(references: DataFrame, scores: DataFrame) -> DataFrame:
    """References (paper_id, part) with a model's scores (paper_id, part, score, relationship) from 0 to 10; those it left out get 0 and other."""
    known = F.col("s.relationship").isin(*REFERENCE_RELATIONSHIPS)
    joined = references.alias("r").join(scores.alias("s"), ["paper_id", "part"], "left")
    score = F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce("s.score", F.lit(0.0))))
    return joined.select("paper_id", "part", score.alias("score"), F.when(known, F.col("s.relationship")).otherwise("other").alias("relationship"))


def related(pairs: DataFrame, papers: DataFrame, provider: Provider) -> DataFrame:
    """Pairs (paper_a, paper_b) with a relationship of the allowed list (else other) and an explanation (null if blank)."""
    side = lambda s: papers.select(F.col("paper_id").alias(f"paper_{s}"), F.col("abstract").alias(f"text_{s}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = provider.relate(batch["text_a"].fillna("").tolist(), batch["text_b"].fillna("").tolist())
            yield pd.DataFrame({"paper_a": batch["paper_a"], "paper_b": batch["paper_b"], "relationship": [r if r in RELATIONSHIPS else "other" for r, _ in found], "explanation": [e or None for _, e in found]})

    return pairs.select("paper_a", "paper_b").join(side("a"), "paper_a").join(side("b"), "paper_b").mapInPandas(run, "paper_a bigint, paper_b bigint, relationship string, explanation string")
