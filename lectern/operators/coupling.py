"""Bibliographic coupling: pairs of papers that cite the same work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import coupling_title
from lectern.functions.vectors import cosine

CONFIDENCE = {"doi": 1.0, "title": 0.95}
LEAST_TITLE = 8


def _classes(cited: DataFrame, key: str) -> DataFrame:
    """(key, paper_id, n_papers): the papers of each work that two papers or more cite. All pairs inside a class are coupled, so they aren't listed."""
    n = cited.groupBy(key).agg(F.count(F.lit(1)).alias("n_papers")).filter("n_papers > 1")
    return cited.join(n, key).select(key, "paper_id", "n_papers")


def _doi_cited(references: DataFrame) -> DataFrame:
    return references.filter("doi is not null and doi <> ''").groupBy("paper_id", "doi").agg(F.min("title").alias("title"))


def _title_cited(references: DataFrame) -> DataFrame:
    cited = references.withColumn("norm", coupling_title(F.col("title"))).filter(F.length("norm") >= LEAST_TITLE)
    return cited.groupBy("paper_id", "norm").agg(F.min("title").alias("title"))


def doi_classes(references: DataFrame) -> DataFrame:
    """(doi, paper_id, n_papers): papers coupled by citing a work by the same DOI."""
    return _classes(_doi_cited(references), "doi")


def title_classes(references: DataFrame) -> DataFrame:
    """(norm, paper_id, n_papers): papers coupled by a work's normalised title, of eight characters or more."""
    return _classes(_title_cited(references), "norm")


def _with(cited: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """Pairs of each query paper and every other that shares the key, each pair once."""
    asked = queries.select("paper_id").distinct()
    a = cited.join(asked, "paper_id").select(F.col("paper_id").alias("p"), F.col(key).alias("key"), F.col("title"))
    b = cited.join(asked.withColumn("asked", F.lit(True)), "paper_id", "left").select(F.col("paper_id").alias("q"), F.col(key).alias("key"), "asked")
    both = a.join(b, "key").filter("p <> q and (asked is null or p < q)")
    return both.select(F.least("p", "q").alias("paper_a"), F.greatest("p", "q").alias("paper_b"), "key", "title")


def by_doi(references: DataFrame, queries: DataFrame) -> DataFrame:
    """(paper_a, paper_b, doi, title, confidence): pairs with a query paper that cite a work by the same DOI."""
    return _with(_doi_cited(references), "doi", queries).select("paper_a", "paper_b", F.col("key").alias("doi"), "title", F.lit(CONFIDENCE["doi"]).alias("confidence"))


def by_title(references: DataFrame, queries: DataFrame) -> DataFrame:
    """The same for works by their normalised titles."""
    return _with(_title_cited(references), "norm", queries).select("paper_a", "paper_b", F.lit(None).cast("string").alias("doi"), "title", F.lit(CONFIDENCE["title"]).alias("confidence"))


def by_embedding(queries: DataFrame, vectors: DataFrame, threshold: float = 0.92, block: int = 2048) -> DataFrame:
    """(paper_a, paper_b, similarity): query vectors and others with a cosine of the threshold or more.

    Both sides (paper_id, embedding) are dealt into blocks of about ``block`` rows; each pair of blocks is one product of matrices, so
    no task holds more than two blocks. Vectors that are null or of another length match nothing.
    """
    n = max(1, -(-queries.count() // block)), max(1, -(-vectors.count() // block))
    spot, each = lambda k: F.pmod(F.xxhash64("paper_id"), F.lit(k)).cast("int"), lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = lambda df, row, col, left: df.filter("embedding is not null").select("paper_id", F.col("embedding").cast("array<double>").alias("v"), row.alias("row"), col.alias("col"), F.lit(left).alias("left"))
    sides = rows(queries, spot(n[0]), each(n[1]), True).unionByName(rows(vectors, each(n[0]), spot(n[1]), False))

    def product(cell: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in cell.groupby(cell["v"].map(len)):
            a, b = same[same["left"]], same[~same["left"]]
            if len(a) and len(b):
                x, y = (np.stack(side["v"].to_numpy()) for side in (a, b))
                found = (x @ y.T) / ((np.linalg.norm(x, axis=1) + 1e-12)[:, None] * (np.linalg.norm(y, axis=1) + 1e-12)[None])
                i, j = np.nonzero(found >= threshold)
                out.append(pd.DataFrame({"paper_a": a["paper_id"].to_numpy()[i], "paper_b": b["paper_id"].to_numpy()[j], "similarity": found[i, j]}))
        found = pd.concat(out, ignore_index=True) if out else pd.DataFrame({"paper_a": [], "paper_b": [], "similarity": []})
        return found[found["paper_a"] != found["paper_b"]]

    return sides.groupBy("row", "col").applyInPandas(product, "paper_a bigint, paper_b bigint, similarity double")


def touched(references: DataFrame, papers: DataFrame) -> DataFrame:
    """The references, of any paper, to works that some of the given papers cite: all that coupling them can read."""
    mine = references.join(papers.select("paper_id").distinct(), "paper_id", "left_semi")
    dois, norms = _doi_cited(mine).select("doi").distinct(), _title_cited(mine).select("norm").distinct()
    rows = references.withColumn("norm", coupling_title(F.col("title"))).join(dois.withColumn("by_doi", F.lit(True)), "doi", "left").join(norms.withColumn("by_norm", F.lit(True)), "norm", "left")
    return rows.filter("by_doi or by_norm").select(*references.columns)


def analyzed(references: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, threshold: float = 0.92) -> DataFrame:
    """(paper_a, paper_b, doi, title, confidence): all matches of the query papers in one call, by DOI, by title and, given vectors (paper_id, embedding), by
    their cosine (to four places, under an empty title); of one pair and title the match of the highest confidence."""
    out = by_doi(references, queries).unionByName(by_title(references, queries))
    if vectors is not None:
        asked = vectors.join(queries.select("paper_id").distinct(), "paper_id", "left_semi")
        near = by_embedding(asked, vectors, threshold).select(F.least("paper_a", "paper_b").alias("paper_a"), F.greatest("paper_a", "paper_b").alias("paper_b"), "similarity").distinct()
        near = near.groupBy("paper_a", "paper_b").agg(F.round(F.max("similarity"), 4).alias("confidence"))
        out = out.unionByName(near.select("paper_a", "paper_b", F.lit(None).cast("string").alias("doi"), F.lit("").alias("title"), "confidence"))
    return best_of(out).select("paper_a", "paper_b", "doi", "title", "confidence")


def best_of(matches: DataFrame) -> DataFrame:
    """For each pair and title the match of the highest confidence."""
    key = F.substring(coupling_title(F.col("title")), 1, 200)
    order = Window.partitionBy("paper_a", "paper_b", "key").orderBy(F.desc("confidence"), F.col("doi").asc_nulls_last(), "title")
    return matches.withColumn("key", key).withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r", "key")


def top_pairs(matches: DataFrame, least: int = 1, limit: int | None = None) -> DataFrame:
    """(paper_a, paper_b, shared, similarity): coupled pairs, most shared works first."""
    out = matches.groupBy("paper_a", "paper_b").agg(F.count(F.lit(1)).alias("shared"), F.max("similarity").alias("similarity")).filter(F.col("shared") >= least)
    return out if limit is None else out.orderBy(F.desc("shared"), F.desc_nulls_last("similarity"), "paper_a", "paper_b").limit(limit)


def partners(matches: DataFrame, paper_id: int) -> DataFrame:
    """(other_id, shared) of one paper."""
    mine = matches.filter((F.col("paper_a") == paper_id) | (F.col("paper_b") == paper_id))
    other = F.when(F.col("paper_a") == paper_id, F.col("paper_b")).otherwise(F.col("paper_a"))
    return mine.groupBy(other.alias("other_id")).agg(F.count(F.lit(1)).alias("shared"))


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs with the cosine of both papers' vectors; pairs that lack one, or differ in size, are left out."""
    a = vectors.select(F.col("paper_id").alias("paper_a"), F.col("embedding").alias("va"))
    b = vectors.select(F.col("paper_id").alias("paper_b"), F.col("embedding").alias("vb"))
    both = pairs.join(a, "paper_a").join(b, "paper_b").filter(F.size("va") == F.size("vb"))
    return both.withColumn("similarity", cosine(F.col("va"), F.col("vb"))).drop("va", "vb")


def stored(matches: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """New matches (paper_a, paper_b, title, ...) that a stored table lacks; its key is the pair and the raw title."""
    once = matches.dropDuplicates(["paper_a", "paper_b", "title"])
    return once if known is None else once.join(known.select("paper_a", "paper_b", "title"), ["paper_a", "paper_b", "title"], "left_anti")


def pair_detail(matches: DataFrame) -> DataFrame:
    """For each pair its number of works and the first relationship, similarity and explanation that is known, by confidence and title."""
    order = F.struct(-F.col("confidence"), "title")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return matches.groupBy("paper_a", "paper_b").agg(F.count(F.lit(1)).alias("shared"), *(first(c) for c in ("relationship", "similarity", "explanation") if c in matches.columns))


def shared_of(references: DataFrame, one: int, other: int) -> DataFrame:
    """(doi, title_a, title_b): the works that both of two papers cite by the same DOI."""
    cited = _doi_cited(references)
    a = cited.filter(F.col("paper_id") == one).select("doi", F.col("title").alias("title_a"))
    return a.join(cited.filter(F.col("paper_id") == other).select("doi", F.col("title").alias("title_b")), "doi")
