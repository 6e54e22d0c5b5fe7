"""Quality rules by line sequence labelling: a linear-chain conditional random field, decoded by Viterbi.

Each line with a word becomes a few binary features of its shape. The field has two labels, content and
boilerplate. Its weights are learned from documents marked good or bad, at most ``max_train_docs`` of them, chosen by a hash
and ``MAX_TRAIN_LINES`` lines, of whole documents. Line labels are latent: a mark only says how likely each line is
boilerplate, so good documents may hold boilerplate and bad ones content; the likelihood sums over all labellings.
Viterbi decoding labels the lines of every document jointly, and a document is kept if content holds at least ``min_share`` of
its words. Two base rules come first: too few words, or
too many words in repeated five-word windows.

Cases: null and empty texts have no words and fail the base rules; without labels of both kinds every line is
content; texts of any length are read whole; of equally likely labellings, that with content at the later lines
wins; a line is what ``\\n`` separates; repeated rows are judged each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, short_batches

MAX_TRAIN_DOCS = 3_000
#: Lines of all training documents together, at most: whole documents in the order of their label rows' hashes, as far as they fit.
MAX_TRAIN_LINES = 300_000
#: Share of boilerplate lines that is expected in good and in bad documents.
EXPECTED = (0.05, 0.8)
#: Training documents in a chain.
CHAIN = 3
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_BLANKS = bytes(range(9, 14)) + b" "
_SYMBOL_BYTES, _DIGITS, _UPPER = SYMBOLS.encode(), b"0123456789", bytes(range(65, 91))
FEATURES = (
    "bias", "words<=2", "words<=5", "words>=12", "symbols>0", "symbols>2%", "symbols>10%", "digits>5%", "digits>25%", "upper>20%", "upper>60%",
    "no end mark", "seen before", "word length<3", "word length>9", "distinct<70%", "distinct<40%", "exclaims", "no plain letters",
)


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[bool]:
    n, size = len(words), len(line) or 1
    symbols = size - len(line.translate(None, _SYMBOL_BYTES))
    digits = size - len(line.translate(None, _DIGITS))
    upper = size - len(line.translate(None, _UPPER))
    letters, distinct = sum(map(len, words)), len(set(words)) / n
    return [
        True, n <= 2, n <= 5, n >= 12, symbols > 0, symbols > 0.02 * size, symbols > 0.1 * size, digits > 0.05 * size, digits > 0.25 * size, upper > 0.2 * size, upper > 0.6 * size,
        words[-1][-1:] not in b".!?:;", seen, letters < 3 * n, letters > 9 * n, distinct < 0.7 and n > 4, distinct < 0.4 and n > 4, line.count(b"!") > 1, line.upper() == line,
    ]


@dataclass(frozen=True)
class Document:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    lines: np.ndarray
    line_words: np.ndarray

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEATED_PERCENT * self.n_words


def repeated_words(words: list[bytes]) -> int:
    """Words in five-word windows that occur twice or more, the first occurrence included."""
    if len(words) < WINDOW + 1:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.fromiter((counts[w] > 1 for w in windows), bool, len(windows)))
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def read_document(text: str | None) -> Document:
    raw = (text or "").encode()
    words, lines, sizes, seen, repeated = raw.split(), [], [], set(), 0
    for line in raw.split(b"\n"):
        if own := line.split():
            again = line in seen
            repeated += again
            seen.add(line)
            lines.append(line_features(line, own, again))
            sizes.append(len(own))
    joined = b"".join(words)
    symbols = len(raw) - len(raw.translate(None, _SYMBOL_BYTES))
    return Document(len(words), len(joined.decode()), symbols, repeated, repeated_words(words), np.asarray(lines, bool).reshape(-1, len(FEATURES)), np.asarray(sizes, np.int64))


@dataclass(frozen=True)
class Field:
    """Weights: the features' scores for boilerplate, and the transitions between (content, boilerplate)."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, documents: list[np.ndarray]) -> list[np.ndarray]:
        """For each document's lines whether they are boilerplate; all documents advance together, line by line."""
        sizes = np.asarray([len(d) for d in documents])
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        scores = (np.concatenate(documents) if longest else np.zeros((0, len(FEATURES)))) @ self.emit
        best, back = np.zeros((len(documents), 2)), np.zeros((int(sizes.sum()), 2), np.int8)
        for t in range(longest):
            live = order[: int((sizes > t).sum())]
            at = start[live] + t
            if t:
                via = best[live][:, :, None] + self.move[None]
                back[at] = via.argmax(axis=1)
                best[live] = via.max(axis=1)
            best[live, 1] += scores[at]
        out = np.zeros(int(sizes.sum()), np.int8)
        state = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            live = order[: int((sizes > t).sum())]
            at = start[live] + t
            out[at] = state[live]
            state[live] = back[at, state[live]]
        return [out[s : s + n].astype(bool) for s, n in zip(start, sizes, strict=True)]


def expectations(potential: np.ndarray, move: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of boilerplate for each line, and sums of label pairs, by forward and backward sums; chains come longest first."""
    n, longest = potential.shape
    live = [int((sizes > t).sum()) for t in range(longest)]
    forward = np.zeros((n, longest, 2))
    forward[:, :, 1] = potential
    for t in range(1, longest):
        k = live[t]
        forward[:k, t] += np.logaddexp(forward[:k, t - 1, :1] + move[0], forward[:k, t - 1, 1:] + move[1])
    last = forward[np.arange(n), sizes - 1]
    norm = np.logaddexp(last[:, 0], last[:, 1])
    backward, pairs, marginal = np.zeros((n, 2)), np.zeros((2, 2)), np.zeros((n, longest))
    for t in range(longest - 1, -1, -1):
        k = live[t]
        marginal[:k, t] = np.exp(forward[:k, t, 1] + backward[:k, 1] - norm[:k])
        if t:
            ahead = backward[:k].copy()
            ahead[:, 1] += potential[:k, t]
            joint = forward[:k, t - 1, :, None] + move[None] + ahead[:, None, :]
            pairs += (np.exp(joint - norm[:k, None, None])).sum(axis=0)
            backward[:k] = np.logaddexp(move[None, :, 0] + ahead[:, :1], move[None, :, 1] + ahead[:, 1:])
    return marginal, pairs


def fit_field(documents: list[np.ndarray], bad: np.ndarray, steps: int = 120, rate: float = 0.1, ridge: float = 1e-3, seed: int = 7) -> Field:
    """Gradient ascent on the likelihood of the marks, with latent line labels.

    Chains join CHAIN documents of either mark, shuffled, so that changes between content and boilerplate are seen; the rarer
    mark's documents recur. The gradient is what the field expects given the marks' evidence less what it expects without.
    """
    emit, move = np.zeros(len(FEATURES)), np.zeros((2, 2))
    bad = np.asarray(bad).astype(int)
    kinds = [[i for i, d in enumerate(documents) if len(d) and bad[i] == k] for k in (0, 1)]
    if not kinds[0] or not kinds[1]:
        emit[0] = -1.0
        return Field(emit, move)
    order = np.concatenate([np.resize(k, max(map(len, kinds))) for k in kinds])
    order = np.random.default_rng(seed).permutation(order)
    chains = sorted((order[i : i + CHAIN] for i in range(0, len(order), CHAIN)), key=lambda c: -sum(len(documents[i]) for i in c))
    sizes = np.asarray([sum(len(documents[i]) for i in c) for c in chains])
    x = np.concatenate([documents[i] for c in chains for i in c]).astype(np.float32)
    mark = np.concatenate([np.full(len(documents[i]), bad[i]) for c in chains for i in c])
    chain, line = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(k) for k in sizes])
    evidence = np.log(np.asarray(EXPECTED) / (1 - np.asarray(EXPECTED)))[mark]
    theta, m, v = np.zeros(len(FEATURES) + 4), 0.0, 0.0
    for step in range(1, steps + 1):
        emit, move = theta[: len(FEATURES)], theta[len(FEATURES) :].reshape(2, 2)
        potential = np.zeros((len(sizes), int(sizes.max())))
        potential[chain, line] = x @ emit.astype(np.float32)
        free, free_pairs = expectations(potential, move, sizes)
        potential[chain, line] += evidence
        told, told_pairs = expectations(potential, move, sizes)
        gradient = np.concatenate([x.T @ (told - free)[chain, line].astype(np.float32), (told_pairs - free_pairs).ravel()]) / len(x) - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[: len(FEATURES)], theta[len(FEATURES) :].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> Field:
    """A field from documents with a quality label: half of the sample good, half bad, as far as they go."""
    short_batches(docs.sparkSession)
    some = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).withColumn("h", F.xxhash64("doc_id"))
    half = [some.filter(F.col("quality") == k).orderBy("h", "doc_id").limit(max_train_docs // 2) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(half[0].unionByName(half[1])), "doc_id").select("text", "quality", "h")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read_document(t).lines for t in batch["text"]]
            yield pd.DataFrame({"h": batch["h"], "lines": [np.packbits(x, axis=None).tobytes() for x in found], "n": [len(x) for x in found], "bad": 1 - batch["quality"].to_numpy()})

    scratch = Scratch(docs.sparkSession, "quality")
    read = scratch.save(rows.mapInPandas(lean(lines), "h bigint, lines binary, n int, bad int"), "lines")
    sizes, room, taken = read.select("h", "n").toPandas().sort_values(["h", "n"]), MAX_TRAIN_LINES, []  # max_train_docs rows at most
    for h, n in zip(sizes["h"].tolist(), sizes["n"].tolist(), strict=True):
        if n <= room:
            taken.append((h, n))
            room -= n
    got = read.filter(F.col("h").isin(sorted({h for h, _ in taken}))).toPandas().sort_values(["h", "n"])
    fits = set(taken)
    got = got[np.asarray([(h, n) in fits for h, n in zip(got["h"], got["n"], strict=True)], bool)]
    scratch.drop()
    k = len(FEATURES)
    documents = [np.unpackbits(np.frombuffer(b, np.uint8), count=n * k).reshape(n, k).astype(bool) for b, n in zip(got["lines"], got["n"], strict=True)]
    return fit_field(documents, got["bad"].to_numpy())


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double, n_lines bigint, n_boilerplate bigint"


def judge(docs: DataFrame, model: Field, min_share: float = 0.5) -> DataFrame:
    """Per document the base figures, whether the base rules fail, whether it is kept, and its content share."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [read_document(t) for t in batch["text"]]
            labelled = model.viterbi([d.lines for d in read])
            share = [float(d.line_words[~b].sum() / d.n_words) if d.n_words else 0.0 for d, b in zip(read, labelled, strict=True)]
            out = pd.DataFrame([(d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed) for d in read], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            out["kept"] = [not d.base_failed and s >= min_share for d, s in zip(read, share, strict=True)]
            out["content_share"], out["n_lines"], out["n_boilerplate"] = share, [len(b) for b in labelled], [int(b.sum()) for b in labelled]
            yield out.astype({"doc_id": "Int64"})

    short_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(lean(one), SCHEMA)
