"""Toxicity scores from a learned lexicon, matched through Levenshtein automata.

The lexicon is learned from labelled documents outside the held-out fold: words, and stems (beginnings of
words), that stand out in toxic documents. It is kept as a trie. A Levenshtein automaton for a word of the text
is intersected with the trie, so misspelled terms are caught too (one edit from five letters on,
two from ten on). Every hit is scored in its context window: hits
inside quotation marks or next to a verb of reporting count apart from those addressed to somebody, and the
densest window is a feature of its own. A logistic regression over these features gives the score.

Labels come from at most ``max_train_docs`` documents, chosen by a hash of doc_id.

Cases: null and empty texts get the score of a text without hits; very long texts are scored whole; repeated rows are scored each; a document
with several labels counts once for each; without labels of both kinds every score is the share of toxic labels
(0 without labels); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, lean, short_batches

MAX_TRAIN_DOCS = 12_000
MAX_TERMS = 5_000
STEMS = range(4, 8)
WINDOW = 12
#: A term's log-likelihood ratio and share of toxic documents among its own, at least.
MIN_EVIDENCE, MIN_SHARE = 16.0, 0.8
#: Terms of chance expected in a lexicon; the evidence asked for grows with the number of terms tried.
CHANCE_TERMS = 0.05
#: Words that a task remembers having looked up: so many lately, and so many before them.
CACHE_ENTRIES = 100_000
#: Verbs of reporting around a quotation, and words of address.
REPORTING = frozenset("said says wrote writes called calls quoted quotes claimed reported dit écrit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your yours u du dein ihr sie tu toi vous te tú usted eres".split())
QUOTES = "\"“”«»„"

_word = re.compile(r"[^\W\d_]+")
FEATURES = ("any", "direct", "quoted", "near", "stems", "densest", "address", "share")


def allowance(n: int) -> int:
    """The edits allowed in a word of n letters."""
    return 0 if n < 5 else 1 if n < 10 else 2


def _parts(term: str, n: int) -> Iterator[tuple[int, str]]:
    """The term in one part more than edits are allowed, at the places that a part without edits has in a word of n letters."""
    count = allowance(n) + 1
    cuts = [len(term) * i // count for i in range(count + 1)]
    for i in range(count):
        # With both outer parts edited, each has one of the two edits.
        shifts = (0,) if i == 0 else (n - len(term),) if i == count - 1 else (-1, 0, 1)
        for shift in shifts:
            yield cuts[i] + shift, term[cuts[i] : cuts[i + 1]]


def _letters(word: str) -> int:
    """A bit for each letter that occurs, by its code modulo 64."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def _grown(root: dict, terms: Iterable[str], kind: str) -> dict:
    for t in terms:
        node = root
        for c in t:
            node = node.setdefault(c, {})
        node[kind] = t
    return root


class Trie:
    """The lexicon: nodes are dicts by letter; ``term`` marks a whole word, ``stem`` the beginning of words."""

    def __init__(self, words: list[str], stems: list[str]):
        self.root = _grown(_grown({}, words, "term"), stems, "stem")
        self.words = frozenset(words)
        # Terms by the parts that the edits allowed leave whole, by length of word, with the parts' places in the word.
        self.parts: dict[int, dict[tuple[int, str], set[str]]] = {}
        for w in words:
            for n in range(len(w) - 2, len(w) + 3):
                if abs(n - len(w)) <= allowance(n):
                    for part in _parts(w, n):
                        self.parts.setdefault(n, {}).setdefault(part, set()).add(w)
        self.places = {n: sorted({(k, k + len(part)) for k, part in found}) for n, found in self.parts.items()}
        self.letters = {w: _letters(w) for w in words}

    def stem(self, word: str) -> str | None:
        node = self.root
        for c in word:
            node = node.get(c)
            if node is None:
                return None
            if "stem" in node:
                return node["stem"]
        return None

    def near(self, word: str) -> tuple[str, int] | None:
        """The nearest term within the word's allowance of edits, by intersecting the word's automaton with a trie of the terms that may be."""
        allowed = allowance(len(word))
        if (parts := self.parts.get(len(word))) is None:
            return None
        # A term within the allowance shares a part with the word, and an edit changes two of the letters that occur.
        some = [found for i, j in self.places[len(word)] if (found := parts.get((i, word[i:j])))]
        if not some:
            return None
        letters = _letters(word)
        terms = {t for found in some for t in found if (letters ^ self.letters[t]).bit_count() <= 2 * allowed}
        if not terms:
            return None
        best = None
        # A state is the set of the automaton's live positions: edits spent at each place in the word.
        todo = [(_grown({}, terms, "term"), {i: i for i in range(allowed + 1)})]
        while todo:
            node, state = todo.pop()
            if "term" in node:
                spent = min((e + len(word) - i for i, e in state.items()), default=allowed + 1)
                if spent <= allowed and (best is None or (spent, node["term"]) < (best[1], best[0])):
                    best = (node["term"], spent)
            for c, child in node.items():
                if len(c) > 1:
                    continue
                after: dict[int, int] = {}
                for i, e in state.items():
                    hit = i < len(word) and word[i] == c
                    for j, f in ((i + 1, e + (not hit)), (i, e + 1)):
                        if j <= len(word) and f <= allowed and f < after.get(j, allowed + 1):
                            after[j] = f
                for j in sorted(after):  # letters of the word that the term lacks
                    e = after[j]
                    while e < allowed and j < len(word):
                        j, e = j + 1, e + 1
                        if e < after.get(j, allowed + 1):
                            after[j] = e
                if after:
                    todo.append((child, after))
        return best


@dataclass
class Lexicon:
    words: list[str]
    stems: list[str]
    seen: set[str] = field(default_factory=set)
    hits: dict[str, tuple[str, str]] = field(default_factory=dict)
    old_seen: set[str] = field(default_factory=set)
    old_hits: dict[str, tuple[str, str]] = field(default_factory=dict)
    trie: Trie | None = None

    def lookup(self, words: set[str]) -> dict[str, tuple[str, str]]:
        """Words that hit the lexicon, these among them, with the kind of hit and the term."""
        self.trie = self.trie or Trie(self.words, self.stems)
        new = words.difference(self.seen)
        if len(self.seen) + len(new) > CACHE_ENTRIES:
            # Words in use are taken over from the older half as they come again; the rest of it goes.
            self.old_seen, self.old_hits, self.seen, self.hits, new = self.seen, self.hits, set(), {}, words
        self.seen |= new
        if self.old_seen:
            known = new & self.old_seen
            self.hits |= {w: self.old_hits[w] for w in known if w in self.old_hits}
            new = new - known
        for w in new:
            if w in self.trie.words:
                self.hits[w] = ("exact", w)
            elif stem := self.trie.stem(w):
                self.hits[w] = ("stem", stem)
            elif found := self.trie.near(w):
                self.hits[w] = ("near", found[0])
        return self.hits

    def features(self, text: str | None) -> list[float]:
        text = (text or "").lower()
        words = _word.findall(text)
        distinct = set(words)
        hits = self.lookup(distinct)
        if distinct.isdisjoint(hits):
            return [0.0] * len(FEATURES)
        n, places = Counter(), []
        around = list(_word.finditer(text))
        quotes = np.asarray([i for i, c in enumerate(text) if c in QUOTES], np.int64)
        for at, m in enumerate(around):
            if (hit := hits.get(m[0])) is None:
                continue
            window = words[max(0, at - WINDOW) : at + WINDOW + 1]
            quoted = bool(np.searchsorted(quotes, m.start()) % 2) or not REPORTING.isdisjoint(window)
            n["quoted" if quoted else hit[0]] += 1
            n["address"] += not quoted and not ADDRESS.isdisjoint(window)
            if not quoted and hit[0] != "near":
                places.append(at)
        densest = max((int(np.searchsorted(places, p + 4 * WINDOW)) - i for i, p in enumerate(places)), default=0)
        direct = n["exact"] + n["stem"]
        return [float(direct > 0), np.log1p(n["exact"]), np.log1p(n["quoted"]), np.log1p(n["near"]), np.log1p(n["stem"]), np.log1p(densest), np.log1p(n["address"]), min(1.0, 20.0 * direct / len(words))]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.asarray([self.lexicon.features(t) for t in texts], float).reshape(-1, len(FEATURES))
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def _terms(text: str) -> set[str]:
    words = set(_word.findall(text.lower()))
    return {f"={w}" for w in words if len(w) > 3} | {w[:k] for w in words for k in STEMS if len(w) > k}


def _evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-likelihood ratio of a term's share of toxic documents against that of all."""
    n, p = toxic + clean, n_toxic / (n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(toxic > 0, toxic * np.log(toxic / (n * p)), 0) + np.where(clean > 0, clean * np.log(clean / (n * (1 - p))), 0))


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Terms of labelled rows (text, toxic); counts are summed by Spark, and the best MAX_TERMS are kept.

    Terms are counted in toxic rows first; only those found there often enough are counted in all others.
    """

    def count(toxic: int, wanted: frozenset[str] | None):
        def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                n: Counter = Counter()
                for text in batch["text"][batch["toxic"] == toxic]:
                    n.update(_terms(text) if wanted is None else _terms(text) & wanted)
                yield pd.DataFrame({"term": list(n), "n": list(n.values())}).astype({"term": str, "n": "int64"})

        return train.select("text", "toxic").mapInPandas(lean(inner), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))

    n_toxic, n_clean = (train.agg(F.count(F.when(F.col("toxic") == k, 1))).first()[0] for k in (1, 0))
    if not n_toxic or not n_clean:
        return Lexicon([], [])
    toxic = count(1, None).filter(F.col("n") > 2).orderBy(F.desc("n"), "term").limit(40 * MAX_TERMS).toPandas().set_index("term")["n"]
    clean = count(0, frozenset(toxic.index)).toPandas().set_index("term")["n"].reindex(toxic.index, fill_value=0)
    t, c = toxic.to_numpy(float), clean.to_numpy(float)
    evidence = _evidence(t, c, n_toxic, n_clean)
    # A term of chance reaches evidence e with a probability of about exp(-e / 2).
    good = (t >= MIN_SHARE * (t + c)) & (evidence >= max(MIN_EVIDENCE, 2 * np.log(max(1, len(t)) / CHANCE_TERMS)))
    terms = set(toxic.index[good][np.argsort(-evidence[good], kind="stable")[:MAX_TERMS]])
    stems = {t for t in terms if t[0] != "=" and not any(t[:k] in terms for k in range(min(STEMS), len(t)))}
    words = [t[1:] for t in terms if t[0] == "="]
    return Lexicon(sorted(words), sorted(stems))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; features only ever raise the score or, if quoted or near, leave it."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(a.shape[1]), np.diag([ridge * len(x) / 100] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> Model:
    """A model from labelled documents outside the held-out fold."""
    some = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold() != 0))
    some = some.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "toxic").limit(max_train_docs).drop("h")
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(some), "doc_id").select("text", "toxic")
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.save(rows, "train")  # max_train_docs texts, read several times below
    lexicon = learn_lexicon(rows)
    blank = Lexicon(lexicon.words, lexicon.stems)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.asarray([blank.features(t) for t in batch["text"]], float).reshape(-1, len(FEATURES))
            yield pd.DataFrame(x, columns=list(FEATURES)).assign(toxic=batch["toxic"].to_numpy())

    schema = ", ".join(f"`{f}` double" for f in FEATURES) + ", toxic int"
    # max_train_docs rows at most.
    found = rows.mapInPandas(lean(features), schema).toPandas()
    scratch.drop()
    y = found.pop("toxic").to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, np.zeros(len(FEATURES)), -40.0 if not len(y) or not y[0] else 40.0)
    return Model(lexicon, *fit_logistic(found.to_numpy(float), y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = model.scores(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": s, "predicted": (s >= 0.5).astype(int)})

    short_batches(docs.sparkSession)
    rows = docs.select("doc_id", (fold() == 0).alias("held_out"), "text")
    return rows.mapInPandas(lean(predict), "doc_id bigint, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not mark as toxic, with all their columns."""

    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(lambda some: (pd.Series(model.scores(t.tolist()) < 0.5) for t in some))(texts)

    short_batches(docs.sparkSession)

    return docs.filter(clean("text"))
