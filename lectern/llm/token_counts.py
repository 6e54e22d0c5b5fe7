"""Token counts of documents from the pieces of their distinct pre-tokens.

A byte-level BPE merges inside pre-tokens only, so a document's number of tokens is the sum, over its distinct pre-tokens, of
occurrences times pieces. Each document is split once, whole, into pre-tokens with their numbers of occurrences; the corpus's distinct
pre-tokens are encoded once each; a join brings both together, and sums by document are all that leaves it. No ids of a document
are ever made. The most frequent pre-tokens (a bounded number of bounded length) are joined where the frequencies lie, so that
only rare ones are shuffled, and no list of a frequent pre-token is anywhere whole.

Cases: null text is an empty document (no bytes, no tokens); the strings of special tokens in a text are one token each, as the library
reads them by default; repeated rows are counted each; a null doc_id stays null; very long texts are read whole, with memory for their
distinct pre-tokens; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, short_batches
from .packing import Encoder


#: Classes of numbers of occurrences between a number and its double.
CLASSES = 16


@dataclass(frozen=True)
class CountSpec:
    limit: int = 512
    #: Pre-tokens joined without a shuffle, at most, and the bytes of one of them at most.
    frequent: int = 300_000
    frequent_bytes: int = 64
    #: Frequencies in one Arrow batch, about.
    batch_rows: int = 100_000
    #: Texts of more characters are split piece by piece in place of all at once.
    long_text: int = 1 << 20


class Splitter:
    """Pre-tokens of whole texts for a byte-level BPE in a file of the ``tokenizers`` library.

    The pattern is matched by ``regex`` where its Unicode tables and the library's agree (the tests compare every letter
    of these ranges); texts with any other letter are split by the library itself.
    """

    AGREED = r"\x00-՗‐-⁯⺀-꓏"

    def __init__(self, path: str, long_text: int = CountSpec.long_text):
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            special = sorted((t["content"] for t in json.load(f)["added_tokens"]), key=lambda s: (-len(s), s))
        self.encoder = Encoder.of(path)
        self.pattern, self.other = regex.compile(PATTERN), regex.compile(f"[^{self.AGREED}]")
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.long_text = long_text

    def _pre_tokens(self, part: str) -> Iterable[str]:
        if not part.isascii() and self.other.search(part):
            return (part[lo:hi] for _, (lo, hi) in self.encoder.tokenizer.pre_tokenizer.pre_tokenize_str(part))
        return (m.group() for m in self.pattern.finditer(part)) if len(part) > self.long_text else self.pattern.findall(part)

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens with their numbers of occurrences, and the number of special tokens."""
        parts = self.special.split(text) if self.special else [text]
        counts: Counter = Counter()
        for part in parts:
            counts.update(self._pre_tokens(part))
        return counts, len(parts) - 1

    def pieces(self, pre_token: str) -> int:
        return len(self.encoder.encode(pre_token)) // 4


_splitters: dict[tuple, Splitter] = {}


def _splitter(path: str, long_text: int) -> Splitter:
    key = (path, long_text)
    if key not in _splitters:
        _splitters[key] = Splitter(path, long_text)
    return _splitters[key]


def frequencies(docs: DataFrame, tokenizer_path: str, spec: CountSpec = CountSpec()) -> DataFrame:
    """(row, doc_id, n_bytes, token, n): a line for each document (token is null, n counts special tokens) and for each of its pre-tokens."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("token", pa.string()), ("n", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(tokenizer_path, spec.long_text)
        rows: list = []
        ids: list = []
        sizes: list = []
        tokens: list = []
        counts: list = []

        def out() -> pa.RecordBatch:
            arrays = [pa.array(v, t) for v, t in zip((rows, ids, sizes, tokens, counts), schema.types, strict=True)]
            for v in (rows, ids, sizes, tokens, counts):
                v.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found, special = splitter.frequencies(text or "")
                n = len(found)
                rows.extend([row] * (n + 1))
                ids.append(doc_id)
                ids.extend([None] * n)
                sizes.append(len((text or "").encode()))
                sizes.extend([None] * n)
                tokens.append(None)
                tokens.extend(found.keys())
                counts.append(special)
                counts.extend(found.values())
                if len(rows) >= spec.batch_rows:
                    yield out()
        if rows:
            yield out()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(lean(split), "row bigint, doc_id bigint, n_bytes bigint, token string, n bigint")


def pieces(tokens: DataFrame, tokenizer_path: str, spec: CountSpec = CountSpec()) -> DataFrame:
    """(token, n, pieces): each distinct pre-token of (token, n), encoded once, with all its occurrences."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(tokenizer_path, spec.long_text)
        for batch in batches:
            n = pa.array([splitter.pieces(t) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["token", "n", "pieces"])

    return tokens.groupBy("token").agg(F.sum("n").alias("n")).mapInArrow(lean(encode), "token string, n bigint, pieces bigint")


def frequent(known: DataFrame, spec: CountSpec = CountSpec()) -> DataFrame:
    """The short pre-tokens of the most occurrences, ``frequent`` at most: those of the highest classes of occurrences that fit together, so nothing is sorted."""
    size = F.floor(F.log2("n") * CLASSES)
    short = known.filter(F.octet_length("token") <= spec.frequent_bytes).withColumn("size", size)
    least, room = None, spec.frequent
    for row in sorted(short.groupBy("size").count().collect(), key=lambda r: -r["size"]):  # 64 * CLASSES rows at most
        if row["count"] > room:
            break
        least, room = row["size"], room - row["count"]
    return short.filter(F.lit(False) if least is None else F.col("size") >= least)


def count_tokens(docs: DataFrame, tokenizer_path: str, spec: CountSpec = CountSpec()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every document."""
    short_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "tokencounts")
    split = scratch.save(frequencies(docs, tokenizer_path, spec), "frequencies")
    found = split.filter("token is not null").select("row", "token", "n")
    known = scratch.save(pieces(found.select("token", "n"), tokenizer_path, spec), "pieces")
    often = F.broadcast(frequent(known, spec).select("token", F.col("pieces").alias("p")))  # spec.frequent rows at most
    rare = found.join(often, "token", "left_anti").join(known.select("token", F.col("pieces").alias("p")), "token")
    parts = [
        split.filter("token is null").select("row", "doc_id", "n_bytes", F.col("n").alias("tokens")),
        *(d.select("row", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n_bytes"), (F.col("n") * F.col("p")).alias("tokens")) for d in (found.join(often, "token"), rare)),
    ]
    sums = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > spec.limit).alias("over_limit"))
