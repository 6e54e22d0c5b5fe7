"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Documents become token ids (a public byte-level BPE) and an end id. Documents above the capacity are cut
into full pieces, of which only the first may be shorter; pieces as long as the capacity are sequences of
their own. All others are dealt by a hash into packing groups of a bounded number of pieces; each group is
packed by best-fit decreasing: a segment tree over remaining capacities finds the tightest open sequence
that a piece fits in. With thousands of pieces in a group, the loss against packing everything in one place
is a few part-filled sequences a group, below a thousandth.

Cases: null text is an empty document (the end id alone); repeated rows are packed each; a special token's string in
a text is that token; very long texts are encoded whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, short_batches

CAPACITY = 2048
END_ID = 0
#: Pieces in one packing group; bounds a task's memory.
GROUP_PIECES = 100_000
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 is itself, others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts as little-endian bytes, for a byte-level BPE in a file of the ``tokenizers`` library.

    In such a vocabulary ids rise with the order of merges, so the same file serves as ranks for ``tiktoken``, whose ids are
    the same (the tests compare both) at a quarter of the cost. Nothing is remembered between texts, so a worker's memory
    doesn't grow. Texts that its matcher gives up on (millions of blanks in a row) go to ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        splits = file["pre_tokenizer"] or {}
        if file["normalizer"] or (splits.get("type"), splits.get("use_regex"), splits.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError(f"not a byte-level vocabulary with the usual splitting rule: {path}")
        special, letters = {t["content"]: t["id"] for t in file["added_tokens"]}, _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.tokenizer = Tokenizer.from_file(path)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except ValueError:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): the pieces of all documents, tokenised whole; ``row`` tells rows of one doc_id apart."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = Encoder.of(tokenizer_path), np.uint32(END_ID).astype("<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, row, text in zip(batch["doc_id"], batch["row"], batch["text"], strict=True):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                start, stop = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    out.append((doc_id, row, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop = stop, stop + capacity
            yield pd.DataFrame(out, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInPandas(lean(cut), "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class CapacityTree:
    """A segment tree over remaining capacities: each node holds whether an open sequence lies below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, sequence: int) -> None:
        self.open[left].append(sequence)
        node = left + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, need: int) -> int:
        """The least remaining capacity of at least ``need``, or -1: up from its leaf, then down to the left."""
        node, count = need + self.size, self.count
        while not count[node]:
            while node & 1:
                node >>= 1
            if node == 0:
                return -1
            node += 1
        while node < self.size:
            node *= 2
            if not count[node]:
                node += 1
        return node - self.size

    def take(self, left: int) -> int:
        node = left + self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.open[left].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    tree, used = CapacityTree(capacity), 0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        left = tree.tightest(n)
        if left < 0:
            number, left, used = used, capacity, used + 1
        else:
            number = tree.take(left)
        sequence[i], offset[i] = number, capacity - left
        if left > n:
            tree.put(left - n, number)
    return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces of all documents with the sequence and the offset that each is packed at."""
    short_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "pack")
    cut = scratch.save(pieces(docs, tokenizer_path, capacity), "pieces")
    open_ = cut.filter(F.col("length") < capacity)
    groups = max(1, math.ceil(open_.count() / group_pieces))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = pd.concat([b for b in batches if len(b)] or [pd.DataFrame()], ignore_index=True)
        for number, part in group.groupby("grp", sort=True) if len(group) else []:
            part = part.sort_values(["length", "doc_id", "row", "piece"], ascending=[False, True, True, True], kind="stable")
            sequence, offset = best_fit_decreasing(part["length"].to_numpy(), capacity)
            # Numbers of groups interleave, and end in 0; those of full pieces end in 1.
            part["sequence_id"], part["offset"] = 2 * (sequence * groups + number), offset
            yield part.drop(columns="grp").astype({"doc_id": "Int64"})

    grp = F.pmod(F.xxhash64("doc_id", "row", "piece", "ids_crc32"), F.lit(groups))
    schema = cut.schema.simpleString().removeprefix("struct<")[:-1].replace(":", " ") + ", sequence_id bigint, offset bigint"
    dealt = open_.withColumn("grp", grp).repartition(groups, "grp")
    packed = dealt.mapInPandas(lean(fit), schema)
    full = cut.filter(F.col("length") >= capacity).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("bigint"))
    return packed.unionByName(full)
