"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (one to three letters, words padded by a space), in
order of frequency. A document's own most frequent n-grams are ranked the same way; the out-of-place
distance sums how far each stands from its rank in the profile, and the profile's length for those absent.
The nearest profile wins. Profiles are learned from labelled documents outside the held-out fold: all of a language's, or about
``docs_per_language`` of them chosen by a hash of doc_id, so that no language is lost among larger ones; the counts are summed by
Spark. Languages are compared ``LANGUAGES_PER_PASS`` at a time, which bounds what a task holds; there may be any number of passes.

Cases: null text, empty text and text without a letter give ``und`` with score 0; ties in distance go to the
first language in code-point order, ties in frequency to the smaller n-gram (shorter first, then by code points); repeated rows
are scored each; texts of any length are read whole; without any labelled row everything is ``und``; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fold, lean, short_batches

UNKNOWN = "und"
#: Training documents of one language, about, at most.
DOCS_PER_LANGUAGE = 5_000
PROFILE_SIZE = 400
LANGUAGES_PER_PASS = 5_000
#: Languages whose counts are broadcast; more are joined by a shuffle.
FEW_LANGUAGES = 100_000
#: What stands for a run of characters that aren't letters.
_SPACE = 1

_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a text's n-grams; a key packs up to three code points of 21 bits."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    padded = np.full(len(codes) + 2, _SPACE, np.int64)
    padded[1:-1] = np.where(letter, codes, _SPACE)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != _SPACE) | (padded[:-1] != _SPACE)
    a = padded[keep]
    two = (a[:-1] << 21) | a[1:]
    three = (two[:-1] << 21) | a[2:]
    return np.unique(np.concatenate([a[a != _SPACE], two, three[a[1:-1] != _SPACE]]), return_counts=True)


def top(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, most frequent first; keys come in ascending order."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Languages in code-point order, and for each n-gram the languages that have it with its rank there."""

    languages: list[str]
    keys: np.ndarray
    #: Entries ``bounds[k]`` to ``bounds[k + 1]`` of language and rank are those of key k.
    bounds: np.ndarray
    language: np.ndarray
    rank: np.ndarray
    size: int

    @classmethod
    def of(cls, ranked: pd.DataFrame, size: int) -> Profiles:
        """From rows (lang, gram, place), places from 1 on."""
        languages, language = np.unique(ranked["lang"].to_numpy(str), return_inverse=True)
        grams = ranked["gram"].to_numpy(np.int64)
        order = np.argsort(grams, kind="stable")
        keys, first = np.unique(grams[order], return_index=True)
        return cls(languages.tolist(), keys, np.append(first, len(grams)), language[order], ranked["place"].to_numpy(np.int64)[order] - 1, size)

    def nearest(self, mine: np.ndarray) -> tuple[str | None, int]:
        """The nearest language of n-grams in order of frequency, and its distance."""
        far = self.size * len(mine)
        if not len(mine) or not self.languages:
            return None, far
        at = np.minimum(np.searchsorted(self.keys, mine), len(self.keys) - 1)
        place = np.flatnonzero(self.keys[at] == mine)
        first, count = self.bounds[at[place]], self.bounds[at[place] + 1] - self.bounds[at[place]]
        entry = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        closer = self.size - np.abs(self.rank[entry] - np.repeat(place, count))
        apart = far - np.bincount(self.language[entry], closer, len(self.languages)).astype(np.int64)
        best = int(apart.argmin())
        return self.languages[best], int(apart[best])


@dataclass(frozen=True)
class ProfileTable:
    """A row for each language and place: (lang, gram, place, pass)."""

    rows: DataFrame
    passes: int
    size: int

    def load(self, number: int) -> Profiles:
        """The profiles of one pass: a bounded number of languages and n-grams."""
        return Profiles.of(self.rows.filter(F.col("pass") == number).drop("pass").toPandas(), self.size)


def learn_profiles(docs: DataFrame, size: int = PROFILE_SIZE, docs_per_language: int = DOCS_PER_LANGUAGE, per_pass: int = LANGUAGES_PER_PASS) -> ProfileTable:
    """Profiles from labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "languages")
    known = F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0)
    shares = docs.filter(known).groupBy("lang").agg((F.lit(docs_per_language) / F.count(F.lit(1))).alias("share"))
    shares = scratch.save(shares, "shares")
    few = F.broadcast(shares) if shares.count() <= FEW_LANGUAGES else shares
    labelled = docs.filter(known).select("doc_id", "text", "lang").join(few, "lang")
    labelled = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found = [ngrams(t) for t in texts]
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in found]), len(keys))
                yield pd.DataFrame({"lang": lang, "gram": keys, "n": n.astype(np.int64)})

    counts = labelled.select("lang", "text").mapInPandas(lean(count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # cut at size inside each task first
    best = counts.withColumn("place", place).filter(F.col("place") <= size).select("lang", "gram", "place")
    numbers = shares.select("lang", F.expr(f"(row_number() OVER (ORDER BY lang) - 1) div {per_pass}").alias("pass"))  # one row per language
    best = scratch.save(best.join(numbers, "lang"), "profiles")
    passes = best.agg(F.max("pass")).first()[0]
    return ProfileTable(best, 0 if passes is None else int(passes) + 1, size)


def identify(docs: DataFrame, profiles: ProfileTable) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document."""
    short_batches(docs.sparkSession)
    scratch, size = Scratch(docs.sparkSession, "identify"), profiles.size
    schema = "doc_id bigint, held_out boolean, text string, lang_pred string, score double"

    def nearest(some: Profiles | None, last: bool):
        def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                names, scores = [], []
                for text, name, score in zip(batch["text"], batch["lang_pred"], batch["score"], strict=True):
                    mine = top(*ngrams(text), size)
                    found, apart = some.nearest(mine) if some else (None, 0)
                    # Passes come in code-point order, so the first of equals stays.
                    if found is not None and (name is None or 1.0 - apart / (size * len(mine)) > score):
                        name, score = found, 1.0 - apart / (size * len(mine))
                    names.append(UNKNOWN if last and name is None else name)
                    scores.append(score)
                out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "text": batch["text"], "lang_pred": names, "score": scores})
                yield out.drop(columns="text") if last else out

        return inner

    rows = docs.select("doc_id", (fold() == 0).alias("held_out"), "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("score"))
    for k in range(profiles.passes - 1):
        rows = scratch.save(rows.mapInPandas(lean(nearest(profiles.load(k), False)), schema), f"pass{k}")
    return rows.mapInPandas(lean(nearest(profiles.load(profiles.passes - 1) if profiles.passes else None, True)), schema.replace("text string, ", ""))
