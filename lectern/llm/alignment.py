"""Alignment of two tokenizers' tokens over whole texts, with corpus-wide counts of linked id pairs.

Each text is tokenised whole by both. Where both have a token that begins with a space at the same byte, the ends before it are
shared (this is verified by byte offsets, not assumed): such anchors split a document into windows of token ids. How the tokens
of a window end together depends on its ids alone, so each distinct window, told by its two tuples of ids, is aligned once for a batch of
documents and its alignment is used wherever it stands; a batch has a bounded number of characters, save for a longer document.

A link joins an A token and a B token that end at one byte, so one's bytes end with the other's: the number of different id pairs is
bounded by the two vocabularies (``pair_bound``), whatever the corpus, and their counts are broadcast. Documents' links are summed
by pair where they arise.

Cases: null and empty texts, and texts that either side's tokens don't spell exactly, have no tokens: all numbers are 0 and the hash is ''.
Special tokens' strings are plain text. Repeated rows count each; a null doc_id stays null; an empty table gives an empty result;
further columns are ignored. Very long texts are aligned whole; the second tokenizer reads them in stretches that
begin at single spaces, which no piece of its vocabulary crosses, so the pieces are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, short_batches
from .packing import Encoder

#: What stands for a space in pieces.
SPACE = "\u2581"
#: What follows an id in a list of groups: another id of its side, the other side, another group, or nothing.
MARKS = (",", "|", ";", "")


@dataclass(frozen=True)
class AlignSpec:
    #: Characters of documents whose windows are told apart together, about.
    batch_chars: int = 1_000_000
    #: Characters that the second tokenizer reads at once, about.
    stretch: int = 20_000
    #: Lines in one Arrow batch, about.
    batch_rows: int = 100_000


class ByteTokens:
    """Tokenizer A: a byte-level BPE; ids of space and text, with the bytes of each id."""

    def __init__(self, path: str):
        self.encoder = Encoder.of(path)
        fast = self.encoder.fast
        self.bytes = [fast.decode_single_token_bytes(i) for i in range(fast.n_vocab)]

    def encode(self, text: str) -> list[int]:
        try:
            return self.encoder.fast.encode_ordinary(" " + text)
        except ValueError:  # its matcher gives up on millions of blanks in a row
            tokenizer = self.encoder.tokenizer
            tokenizer.encode_special_tokens = True
            try:
                return tokenizer.encode(" " + text, add_special_tokens=False).ids
            finally:
                tokenizer.encode_special_tokens = False


class PieceTokens:
    """Tokenizer B: a sentencepiece model that puts a space before the text."""

    def __init__(self, path: str, stretch: int):
        from sentencepiece import SentencePieceProcessor

        self.model, self.stretch = SentencePieceProcessor(model_file=path), stretch
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [b"" if self.model.is_control(i) or self.model.is_unknown(i) else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        # No piece goes on past a word's end into a space: then texts may be cut before single spaces.
        self.cuts = not any(regex.search(f"[^{SPACE}]{SPACE}", p) for p in names)
        self.at = regex.compile(f"(?<=[^ {SPACE}]) (?=[^ {SPACE}])")

    def encode(self, text: str) -> list[int]:
        if len(text) <= 2 * self.stretch or not self.cuts:
            return self.model.encode(text, num_threads=1)
        ids, held = [], 0
        while held <= len(text):
            cut = self.at.search(text, held + self.stretch) if len(text) - held > self.stretch else None
            stop = cut.start() if cut else len(text)
            ids += self.model.encode(text[held:stop], num_threads=1)
            held = stop + 1  # the space is the one that the model puts before the next stretch
        return ids


class Aligner:
    """Windows of a text with their alignments, for two tokenizers."""

    def __init__(self, path_a: str, path_b: str, spec: AlignSpec = AlignSpec()):
        self.a, self.b, self.spec = ByteTokens(path_a), PieceTokens(path_b, spec.stretch), spec
        self.sizes = [np.asarray([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        self.spaced = [np.asarray([x[:1] == b" " for x in t.bytes], bool) for t in (self.a, self.b)]
        #: Each id as text with what may follow it: four entries an id.
        self.names = [f"{i}{mark}" for i in range(max(len(self.a.bytes), len(self.b.bytes))) for mark in MARKS]

    def windows(self, a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups as text and their number for each of many windows, and the linked id pairs (A id times 2^32 plus B id) of all, in order.

        The windows' ids follow each other; both sides of a window end together.
        """
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        shared, last_a, last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        # All tokens in one row: those of A and then those of B, group by group.
        marks_a, marks_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        marks_a[last_a], marks_b[last_b], marks_b[np.cumsum(len_b) - 1] = 1, 2, 3
        row = np.empty(len(a) + len(b), np.int64)
        row[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a * len(MARKS) + marks_a
        row[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = b * len(MARKS) + marks_b
        texts, stop = list(map(self.names.__getitem__, row.tolist())), np.cumsum(len_a + len_b).tolist()
        upto = np.searchsorted(shared, end_a[np.cumsum(len_a) - 1], side="right")
        return ["".join(texts[lo:hi]) for lo, hi in zip([0, *stop], stop, strict=False)], np.diff(upto, prepend=0), (a[last_a] << 32) + b[last_b]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides; none where either doesn't spell space and text."""
        if not text:
            return [], []
        a, b, whole = self.a.encode(text), self.b.encode(text), b" " + text.encode()
        if any(b"".join(map(own.bytes.__getitem__, ids)) != whole for own, ids in ((self.a, a), (self.b, b))):
            return [], []
        return a, b

    def cuts(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Where windows begin among each side's tokens, from the first on, and where the last one ends."""
        places = []
        for own, sizes, spaced in zip(ids, self.sizes, self.spaced, strict=True):
            ends = np.cumsum(sizes[own])
            at = np.flatnonzero(spaced[own[1:]])
            places.append((at + 1, ends[at]))
        _, *found = np.intersect1d(places[0][1], places[1][1], assume_unique=True, return_indices=True)
        return [np.concatenate([[0], at[x], [len(own)]]) for own, (at, _), x in zip(ids, places, found, strict=True)]

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For each text the numbers of A tokens, B tokens and groups, and the groups' hash; and of all links the text and the id pair."""
        both = [self.tokens(t) for t in texts]
        counts = np.asarray([[len(a), len(b), 0] for a, b in both], np.int64).reshape(-1, 3)
        if not counts.sum():
            return counts, [""] * len(texts), np.empty(0, np.int64), np.empty(0, np.int64)
        # Every text begins with a space on both sides and spells as many bytes on both, so texts that follow each other are as one.
        ids = [np.fromiter(chain.from_iterable(pair[side] for pair in both), np.int64, int(counts[:, side].sum())) for side in (0, 1)]
        cuts = self.cuts(ids)
        starts, sizes = [c[:-1] for c in cuts], [np.diff(c) for c in cuts]
        first, kind = distinct_windows(ids, starts, sizes)
        parts = [_gathered(own, at[first], n[first]) for own, at, n in zip(ids, starts, sizes, strict=True)]
        groups, n_groups, pairs = self.windows(*parts, *(n[first] for n in sizes))
        owner = np.searchsorted(np.cumsum(counts[:, 0]), starts[0], side="right")
        counts[:, 2] = np.bincount(owner, n_groups[kind], len(texts)).astype(np.int64)
        named, stop = list(map(groups.__getitem__, kind.tolist())), np.cumsum(np.bincount(owner, minlength=len(texts))).tolist()
        hashes = [hashlib.sha256(";".join(named[lo:hi]).encode()).hexdigest() if hi > lo else "" for lo, hi in zip([0, *stop], stop, strict=False)]
        at = np.cumsum(n_groups) - n_groups
        return counts, hashes, np.repeat(owner, n_groups[kind]), _gathered(pairs, at[kind], n_groups[kind])


def _gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of an array that begin at ``start``, one after another."""
    before = np.cumsum(size) - size
    return values[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def distinct_windows(ids: list[np.ndarray], starts: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A window for each distinct pair of id tuples, and for each window the number of its pair.

    Windows are sorted by a hash of their ids, and each is then compared with its hash's first window; those of one hash that differ are told apart
    by their ids themselves.
    """
    hashes = np.zeros(len(starts[0]), np.uint64)
    for own, at, n in zip(ids, starts, sizes, strict=True):
        place = (np.arange(len(own)) - np.repeat(at, n)).astype(np.uint64)
        mixed = (own.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (place + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        hashes = hashes * np.uint64(0x94D049BB133111EB) + np.add.reduceat(mixed, at)
    _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    same = np.ones(len(hashes), bool)
    for own, at, n in zip(ids, starts, sizes, strict=True):
        like = n == n[first[kind]]
        differs = own != own[np.minimum(np.repeat(at[first[kind]] - at, n) + np.arange(len(own)), len(own) - 1)]
        same &= like & (np.add.reduceat(differs.astype(np.int64), at) == 0)
    if not same.all():
        known: dict[tuple, int] = {}
        for i in np.flatnonzero(~same).tolist():
            key = tuple(own[at[i] : at[i] + n[i]].tobytes() for own, at, n in zip(ids, starts, sizes, strict=True))
            if key not in known:
                known[key] = len(first)
                first = np.append(first, i)
            kind[i] = known[key]
    return first, kind


def pair_bound(aligner: Aligner) -> int:
    """Id pairs of which one's bytes end with the other's; no corpus has more different links."""
    from collections import Counter

    a, b = Counter(filter(None, aligner.a.bytes)), Counter(filter(None, aligner.b.bytes))
    ends = lambda own, other: sum(n * sum(other[x[i:]] for i in range(len(x))) for x, n in own.items())
    return ends(a, b) + ends(b, a)


_aligners: dict[tuple, Aligner] = {}


def _aligner(path_a: str, path_b: str, spec: AlignSpec) -> Aligner:
    key = (path_a, path_b, spec)
    if key not in _aligners:
        _aligners[key] = Aligner(path_a, path_b, spec)
    return _aligners[key]


def links(docs: DataFrame, path_a: str, path_b: str, spec: AlignSpec = AlignSpec()) -> DataFrame:
    """A line for each document (pair is null) and for each different id pair that is linked in it, n times."""
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pair", "n"]
    kinds = [pa.string() if x == "groups_sha256" else pa.int64() for x in names]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b, spec)
        heads: list[tuple] = []
        rows: list[np.ndarray] = []
        pairs: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            if heads:
                columns = [*zip(*heads, strict=True), [None] * len(heads), [None] * len(heads)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names)
            if rows:
                row, pair, n = (np.concatenate(v) for v in (rows, pairs, counts))
                yield pa.RecordBatch.from_arrays([pa.array(row), *(pa.nulls(len(row), t) for t in kinds[1:6]), pa.array(pair), pa.array(n)], names)
            for v in (heads, rows, pairs, counts):
                v.clear()

        def aligned(docs: list[tuple]) -> int:
            numbers, hashes, owner, pair = aligner.align([d[2] or "" for d in docs])
            row = np.asarray([d[0] for d in docs], np.int64)
            heads.extend((d[0], d[1], *n, sha) for d, n, sha in zip(docs, numbers.tolist(), hashes, strict=True))
            order = np.lexsort((pair, owner))
            owner, pair = owner[order], pair[order]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])])[: len(pair)])
            rows.append(row[owner[new]])
            pairs.append(pair[new])
            counts.append(np.diff(np.append(new, len(pair))))
            return len(new) + len(docs)

        held, docs, chars = 0, [], 0
        for batch in batches:
            for doc in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                docs.append(doc)
                chars += len(doc[2] or "")
                if chars >= spec.batch_chars:
                    held += aligned(docs)
                    docs, chars = [], 0
                if held >= spec.batch_rows:
                    yield from out()
                    held = 0
        if docs:
            aligned(docs)
        yield from out()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(lean(align), "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pair bigint, n bigint")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, count, best): how many links hold each id pair, and whether no pair of its B id is held by more."""
    counts = linked.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, spec: AlignSpec = AlignSpec()) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every document."""
    short_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "alignment")
    linked = scratch.save(links(docs, path_a, path_b, spec), "links")
    counts = scratch.save(pair_counts(linked), "counts")
    # The vocabularies bound the number of pairs.
    rated = linked.filter("pair is not null").select("row", "pair", "n").join(F.broadcast(counts), "pair")
    zero = F.lit(0).cast("bigint")
    rated = rated.select("row", F.col("n").alias("n_links"), F.when(F.col("best"), F.col("n")).otherwise(zero).alias("n_best"), (F.col("n") * F.col("count")).alias("count_sum"))
    heads = linked.filter("pair is null").select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", zero.alias("n_links"), zero.alias("n_best"), zero.alias("count_sum"))
    sums = heads.unionByName(rated, allowMissingColumns=True).groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")), *(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum"))
    )
    return sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
