"""Exact Jaccard self-join of word n-gram sets with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct five-word shingles. All sets are read in one global order
(rough frequency class, then hash). For similarity t, two similar sets share at least l tokens among the first
``n - ceil(t n) + l`` of each, for every l >= 1. Each document picks its own l: one that carries frequent
tokens in its prefix has a high estimated candidate cost, and lengthens its prefix; a pair must then share
min(l, l') prefix tokens before it is verified.

1. One pass over the texts keeps per document its set's size, hash and a bitmap, and counts tokens lossily: those
   seen twice in a chunk are summed by Spark, and the most frequent (at most ``max_frequent``) set the order.
2. A second pass emits prefix tokens of distinct sets; one shuffle by token makes the lists, with frequent tokens' lists in
   parts. Tokens of one set only vanish.
3. Each set is paired with the head of the lists that it shares most often with; bitmaps drop impossible pairs and
   the rest are verified on whole texts. This joins large groups of copies through few pairs. Wherever pairs are verified,
   only the texts of their ends are moved, and sketches as long as a set asks for drop most pairs of long texts first.
4. Across the components found so far, each set's likeliest partner is verified, a few times over; then all pairs that are
   left in different components and share enough prefix tokens. Pairs inside a component need no check, so the
   components are exact.

Cases: null and empty texts have no set and link with nothing; fewer than five words make one shingle; identical
sets are one class, whatever its size; repeated rows are rows of one class; rows of one doc_id with different texts are
different documents, each with its own links; rows with a null doc_id take part with no id of their own: they get a null
component_id; very long texts are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, lean_group, short_batches, sweep
from .graph import components, merged
from .rolling import Prefix, mix64, words


@dataclass(frozen=True)
class JoinSpec:
    shingle: int = 5
    #: Similarity in hundredths.
    percent: int = 75
    #: Tokens seen in this many sets at least count as frequent; the order knows so many of them at most.
    frequent_from: int = 8
    max_frequent: int = 200_000
    #: An estimated candidate cost of this much lengthens a prefix by one token, each doubling by more.
    cost_unit: int = 256
    max_match: int = 12
    bitmap_bits: int = 2048
    #: Bits of a sketch for each token of a set, at least.
    sketch_bits: int = 8
    #: Times that each node's likeliest partner is verified before all pairs that are left.
    rounds: int = 2
    #: Pairs that one copy of a text is compared in.
    pairs_per_text: int = 1000
    #: Nodes of a head that goes to a bucket, at most, and rows of a bucket, about.
    small: int = 64
    bucket_rows: int = 20_000
    #: Nodes on one side of a block of a larger head.
    block: int = 1024
    #: Bytes of text that are hashed together.
    chunk_bytes: int = 1_000_000
    #: Tokens that are counted together.
    counted_tokens: int = 2_000_000


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in ascending order within a text, and each text's bounds among them."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    start, stop = words(data)
    owner = np.searchsorted(ends, start, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    # Sequences of word hashes are hashed like strings of symbols.
    seq = Prefix(Prefix(data).of(start, stop))
    n_grams = np.where(n_words > 0, np.maximum(1, n_words - size + 1), 0)
    first_word, first_gram = np.cumsum(n_words) - n_words, np.cumsum(n_grams) - n_grams
    doc = np.repeat(np.arange(len(texts)), n_grams)
    at = first_word[doc] + np.arange(len(doc)) - first_gram[doc]
    grams = seq.of(at, at + np.minimum(size, n_words[doc]))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(texts)))])


def _lower(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [(t or b"").lower() for t in column.cast(pa.binary()).to_pylist()]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows and their lower-case texts, about so many bytes at a time."""
    for batch in batches:
        texts, total, held = _lower(batch.column("text")), 0, 0
        for i, t in enumerate(texts):
            total += len(t)
            if total >= size or i + 1 == len(texts):
                yield batch.slice(held, i + 1 - held), texts[held : i + 1]
                total, held = 0, i + 1


def _set_hashes(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, from sums of mixed tokens."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(grams ^ np.uint64(salt)))]) for salt in (0x51ED270B, 0xA24BAED4963EE407)]
    size = np.diff(bounds).astype(np.uint64)
    return tuple(mix64(s[bounds[1:]] - s[bounds[:-1]] + size).view(np.int64) for s in sums)


def prefix_length(n: int | np.ndarray, match: int | np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of n that a similar set shares ``match`` of, if each has so many."""
    return np.minimum(n, n + (-percent * n) // 100 + match)


#: Parts of a frequent token's list.
SALTS = 256
#: Words of 64 bits that say which nodes' texts are asked for; they are broadcast.
ASKED = 1 << 20
NO_PAIRS = pd.DataFrame({k: np.empty(0, np.int64) for k in ("a", "b", "c", "need")})


def _bits(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["bitmap"]), np.uint64).reshape(len(rows), -1)


def _room(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m with these bitmaps may share enough: each bit that one has alone is a token that the other lacks."""
    most = np.minimum(n - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
    return most * (100 + percent) >= percent * (n + m)


def _sketch(grams: np.ndarray, bits: int) -> bytes:
    """A bitmap of a set with so many bits a token or more, a power of two of at least 64 in all."""
    size = max(64, 1 << (bits * len(grams) - 1).bit_length())
    out = np.zeros(size, bool)
    out[(grams >> np.uint64(20)) & np.uint64(size - 1)] = True
    return np.packbits(out).tobytes()


def _sketch_room(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """Whether sets of sizes n and m with these sketches may share enough; the longer sketch is folded to the other's length."""
    a, b = (np.frombuffer(s, np.uint64) for s in (x, y))
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(s.reshape(-1, size), axis=0)[None] for s in (a, b))
    return bool(_room(a, b, np.asarray([n]), np.asarray([m]), percent)[0])


def _small_pairs(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Possible pairs within each of many small heads, all heads at once."""
    if not len(rows):
        return NO_PAIRS
    rows = rows.sort_values("head", kind="stable")
    head, node, component = (rows[c].to_numpy() for c in ("head", "node", "component"))
    size, need = rows["info"].to_numpy() >> 4, rows["info"].to_numpy() & 15
    last = np.searchsorted(head, head, side="right")
    count = last - np.arange(len(rows)) - 1
    i = np.repeat(np.arange(len(rows)), count)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    keep = (component[i] != component[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
    i, j, bits = i[keep], j[keep], _bits(rows)
    keep = np.concatenate([_room(bits[i[k : k + 50_000]], bits[j[k : k + 50_000]], size[i[k : k + 50_000]], size[j[k : k + 50_000]], percent) for k in range(0, len(i), 50_000)] or [np.empty(0, bool)])
    i, j = i[keep], j[keep]
    tokens = {k: set(rows["tokens"].iloc[k]) for k in {*i.tolist(), *j.tolist()}}
    c = np.fromiter((len(tokens[x] & tokens[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)), np.int64, len(i))
    out = pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j]), "c": c, "need": np.minimum(need[i], need[j])})
    return out[out["c"] > 0]


def _block_pairs(x: pd.DataFrame, y: pd.DataFrame, percent: int) -> list[pd.DataFrame]:
    """Possible pairs of one block of a large head: nodes outside the main component against a part of all nodes."""
    out: list[pd.DataFrame] = []
    if not len(x) or not len(y):
        return out
    places = {t: k for k, t in enumerate(set().union(*x["tokens"]))}
    marks = []
    for side in (x, y):
        m = np.zeros((len(side), len(places)), np.float32)
        for k, own in enumerate(side["tokens"]):
            m[k, [places[t] for t in own if t in places]] = 1
        marks.append(m)
    bx, by, main = _bits(x), _bits(y), x["main"].iloc[0]
    (nx, lx), (ny, ly) = ((s["info"].to_numpy() >> 4, s["info"].to_numpy() & 15) for s in (x, y))
    (ix, iy), (cx, cy) = (x["node"].to_numpy(), y["node"].to_numpy()), (x["component"].to_numpy(), y["component"].to_numpy())
    for i in range(len(x)):
        # Two nodes outside the main component meet twice; one of the meetings counts.
        j = np.flatnonzero((cy != cx[i]) & (100 * np.minimum(nx[i], ny) >= percent * np.maximum(nx[i], ny)) & ((cy == main) | (ix[i] < iy)))
        j = j[_room(bx[i][None], by[j], nx[i], ny[j], percent)] if len(j) else j
        c = (marks[1][j] @ marks[0][i]).astype(np.int64)
        j, c = j[c > 0], c[c > 0]
        out.append(pd.DataFrame({"a": np.minimum(ix[i], iy[j]), "b": np.maximum(ix[i], iy[j]), "c": c, "need": np.minimum(lx[i], ly[j])}))
    return out


@dataclass
class JaccardJoin:
    docs: DataFrame
    spec: JoinSpec = JoinSpec()

    def __post_init__(self):
        self.spark = self.docs.sparkSession
        short_batches(self.spark)
        self.scratch = Scratch(self.spark, "jaccard")
        self.rows = self.docs.select("doc_id", "text")
        self.salt = 0

    def _survey(self) -> DataFrame:
        spec = self.spec

        def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
            tokens, count = np.unique(np.concatenate(held), return_counts=True)
            tokens, count = tokens[count > 1], count[count > 1]
            blank = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([blank, blank, pa.array(count), pa.array(tokens.view(np.int64)), blank, pa.nulls(len(tokens), pa.binary())], names)

        def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for rows, texts in _chunks(batches, spec.chunk_bytes):
                grams, bounds = shingle_sets(texts, spec.shingle)
                h1, h2 = _set_hashes(grams, bounds)
                doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
                bits = np.zeros((len(texts), spec.bitmap_bits), bool)
                bits[doc, (grams >> np.uint64(20)) % np.uint64(spec.bitmap_bits)] = True
                maps = [b.tobytes() for b in np.packbits(bits, axis=1)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(np.diff(bounds)), pa.array(h1), pa.array(h2), pa.array(maps, pa.binary())], names)
                held.append(grams)
                if sum(map(len, held)) >= spec.counted_tokens:
                    yield repeated(held)
                    held = []
            if held:
                yield repeated(held)

        names = ["doc_id", "text_hash", "n", "h1", "h2", "bitmap"]
        rows = self.rows.withColumn("text_hash", F.xxhash64("text"))
        return self.scratch.save(rows.mapInArrow(lean(survey), "doc_id bigint, text_hash bigint, n bigint, h1 bigint, h2 bigint, bitmap binary"), "survey")

    def _frequent(self, survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        counts = survey.filter("h2 is null").groupBy("h1").agg(F.sum("n").alias("n")).filter(F.col("n") >= self.spec.frequent_from)
        top = counts.orderBy(F.desc("n"), "h1").limit(self.spec.max_frequent).toPandas()  # bounded by max_frequent
        top = top.sort_values("h1")
        return top["h1"].to_numpy(np.int64), top["n"].to_numpy(np.int64)

    def _prefixes(self, tokens: np.ndarray, counts: np.ndarray) -> DataFrame:
        spec, shared = self.spec, self.spark.sparkContext.broadcast((tokens, counts))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens, counts = shared.value
            seen: set[int] = set()
            for _, texts in _chunks(batches, spec.chunk_bytes):
                grams, bounds = shingle_sets(texts, spec.shingle)
                h1, _ = _set_hashes(grams, bounds)
                signed, often = grams.view(np.int64), np.zeros(len(grams), np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, signed), len(tokens) - 1)
                    often = np.where(tokens[at] == signed, counts[at], 0)
                rank = np.ceil(np.log2(often + 1)).astype(np.int64)
                out: list[tuple] = []
                for i in range(len(texts)):
                    lo, hi, key = bounds[i], bounds[i + 1], int(h1[i])
                    n = int(hi - lo)
                    if not n or key in seen:
                        continue
                    if len(seen) < 100_000:
                        seen.add(key)
                    mine, match = signed[lo:hi], 1
                    if rank[lo:hi].any():
                        order = np.argsort(rank[lo:hi], kind="stable")
                        mine, cost = mine[order], often[lo:hi][order]
                        spent = int(cost[: int(prefix_length(n, 1, spec.percent))].sum())
                        if spent >= spec.cost_unit:
                            match = min(spec.max_match, 1 + (spent // spec.cost_unit).bit_length())
                    # A pair shares ceil(t n) tokens at least, which bounds the tokens that may be asked for.
                    match = max(1, min(match, -(-spec.percent * n // 100)))
                    size = int(prefix_length(n, match, spec.percent))
                    hot = often[lo:hi][order][:size] > 0 if rank[lo:hi].any() else np.zeros(size, bool)
                    out.append((mine[:size], hot, key, n * 16 + match))
                if out:
                    sizes = [len(o[0]) for o in out]
                    h1, info = (np.repeat(np.asarray([o[k] for o in out], np.int64), sizes) for k in (2, 3))
                    hot = np.concatenate([o[1] for o in out])
                    salt = np.where(hot, 1 + h1 % SALTS, 0).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(h1), pa.array(info), pa.array(salt)], ["token", "h1", "info", "salt"])

        entries = self.rows.mapInArrow(lean(emit), "token bigint, h1 bigint, info bigint, salt int")
        # A frequent token's list is dealt by its sets into SALTS parts, so no window holds a list whole.
        part = Window.partitionBy("token", "salt")
        whole = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        entries = entries.withColumn("head", F.min(F.struct("h1", "info")).over(whole)).withColumn("last", F.max("h1").over(whole)).withColumn("before", F.lag("h1").over(part.orderBy("h1")))
        entries = entries.filter("(salt > 0 or head.h1 < last) and (before is null or before < h1)").drop("before")
        entries = self.scratch.save(entries, "parts")
        sweep(self.spark)
        # At most max_frequent tokens.
        joint = entries.filter("salt > 0").groupBy("token").agg(F.min("head").alias("first"), F.max("last").alias("end"))
        lists = entries.join(F.broadcast(joint), "token", "left").withColumn("head", F.coalesce("first", "head")).withColumn("last", F.coalesce("end", "last"))
        lists = lists.filter("head.h1 < last").select("token", "h1", "info", F.col("head.h1").alias("head"), F.col("head.info").alias("head_info"))
        lists = self.scratch.save(lists, "lists")
        self.scratch.drop("parts")
        shared.unpersist()
        sweep(self.spark)
        return lists

    def _fits(self, a: str, b: str):
        """Whether sets of these sizes can be similar at all; an info is 16 times the size and the match."""
        n, m = F.shiftright(a, 4), F.shiftright(b, 4)
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.spec.percent

    def _possible(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes whose bitmaps leave enough room for shared tokens."""
        percent = self.spec.percent

        def room(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
                keep = _room(x, y, batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])

        of = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("bitmap").alias(f"m{s}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "ma", "mb")
        return both.mapInArrow(lean(room), "a bigint, b bigint").distinct()

    def _linked(self, pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """Those of the pairs whose sets, taken from the whole texts, are similar."""
        spec = self.spec
        pairs = self.scratch.save(self._roomy(pairs, self._sketches(pairs, nodes, name)), f"{name}roomy")
        texts = self._texts(pairs, nodes, name)

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: tuple = (None, None)
            for batch in batches:
                a, b = (batch.column(i).to_pylist() for i in range(2))
                left, right, keep = _lower(batch.column(2)), _lower(batch.column(3)), []
                for i, (x, y) in enumerate(zip(left, right, strict=True)):
                    if last[0] != x:
                        last = (x, shingle_sets([x], spec.shingle)[0])
                    other, _ = shingle_sets([y], spec.shingle)
                    shared = len(np.intersect1d(last[1], other, assume_unique=True))
                    if 100 * shared >= spec.percent * (len(last[1]) + len(other) - shared):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in keep], pa.int64()) for v in (a, b)], ["a", "b"])

        # The end with more pairs comes first: its text is moved once for many pairs, and only the other ends' once for each.
        often = pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        of = lambda end: often.select(F.col("x").alias(end), F.col("n").alias(f"n{end}"))
        turned = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
        pairs = pairs.join(of("a"), "a").join(of("b"), "b").select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))
        # A node with many pairs has its text in several places.
        per = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / spec.pairs_per_text).cast("int").alias("places"))
        dealt = pairs.select("a", "b").join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place"))
        right = dealt.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        left = per.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "ta", F.explode(F.expr("sequence(0, places - 1)")).alias("place"))
        both = right.join(left, ["a", "place"])
        links = self.scratch.save(both.select("a", "b", "ta", "tb").mapInArrow(lean(verify), "a bigint, b bigint").distinct(), name)
        for used in ("sketchesends", "sketches", "roomy", "textsends", "texts"):
            self.scratch.drop(f"{name}{used}")
        sweep(self.spark)
        return links

    def _roomy(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs whose sketches leave enough room for shared tokens: bitmaps of one length are full where sets are large."""
        percent = self.spec.percent

        def room(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = pa.array([_sketch_room(x, y, n, m, percent) for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

        of = lambda s: sketches.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
        both = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").select("a", "b", "na", "nb", "sa", "sb")
        return both.mapInArrow(lean(room), "a bigint, b bigint")

    def _node(self) -> Column:
        """A document's number among the sets: rows of one doc_id with different texts are different nodes."""
        return F.xxhash64(F.lit(self.salt), "doc_id", "text_hash")

    def _nodes(self, sets: DataFrame) -> DataFrame:
        """(node, doc_id, text_hash, h1, h2, n, bitmap): one row for each distinct set, that of its smallest doc_id (and text hash)."""
        named = sets.filter("n > 0 and doc_id is not null")
        least = named.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep")).select("h1", "h2", "rep.doc_id", "rep.text_hash")
        nodes = named.dropDuplicates(["doc_id", "text_hash", "h1", "h2"]).join(least, ["h1", "h2", "doc_id", "text_hash"])
        while True:
            out = self.scratch.save(nodes.select(self._node().alias("node"), "doc_id", "text_hash", "h1", "h2", "n", "bitmap"), f"nodes{self.salt}")
            if not out.groupBy("node").count().filter("count > 1").take(1):
                return out
            self.salt += 1  # two sets got one number: number all anew

    def _ends(self, pairs: DataFrame, nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The pairs' ends (node, own, wanted), and rows (node, doc_id, text_hash, text) that hold those of all ends.

        Other texts are left where they are read: a node's number picks a bit among ASKED words, which are broadcast. Few rows
        pass that aren't an end's, but where ends are far more than bits, all do; a join with the ends decides.
        """
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ends = self.scratch.save(nodes.select("node", F.col("doc_id").alias("own"), F.col("text_hash").alias("wanted")).join(ends, "node", "left_semi"), f"{name}ends")
        word, bit = F.pmod("node", F.lit(ASKED)), F.expr(f"shiftleft(1L, cast(pmod(node div {ASKED}, 64) as int))")
        asked = ends.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
        rows = self.rows.filter("doc_id is not null").withColumn("text_hash", F.xxhash64("text")).select(self._node().alias("node"), "doc_id", "text_hash", "text")
        return ends, rows.withColumn("word", word).join(F.broadcast(asked), "word").filter(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")

    def _of_ends(self, rows: DataFrame, ends: DataFrame, name: str) -> DataFrame:
        """One of the rows of each end."""
        # Dealt by node before the join, so that what follows the join needn't deal them again.
        rows = rows.repartition("node").join(ends, "node").filter("doc_id = own and text_hash = wanted").dropDuplicates(["node"])
        return self.scratch.save(rows.drop("doc_id", "text_hash", "own", "wanted"), name)

    def _texts(self, pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """(node, text) of the pairs' ends."""
        ends, rows = self._ends(pairs, nodes, f"{name}texts")
        return self._of_ends(rows, ends, f"{name}texts")

    def _sketches(self, pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """(node, n, sketch) of the pairs' ends, made where the texts are read."""
        spec = self.spec

        def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, texts in _chunks(batches, spec.chunk_bytes):
                grams, bounds = shingle_sets(texts, spec.shingle)
                maps = [_sketch(grams[lo:hi], spec.sketch_bits) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
                own = [rows.column(c) for c in ("node", "doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(bounds)), pa.array(maps, pa.binary())], ["node", "doc_id", "text_hash", "n", "sketch"])

        ends, rows = self._ends(pairs, nodes, f"{name}sketches")
        rows = rows.mapInArrow(lean(sketches), "node bigint, doc_id bigint, text_hash bigint, n bigint, sketch binary")
        return self._of_ends(rows, ends, f"{name}sketches")

    def _shared(self, lists: DataFrame, keys: DataFrame, found: DataFrame) -> DataFrame:
        """(head, node, info, tokens): the nodes of lists that hold several components, by the lists' head.

        The tokens are a node's own prefix tokens, so the array is bounded by the document.
        """
        named = keys.join(found, "node", "left").select("h1", "node", F.coalesce("component", "node").alias("component"))
        rows = self.scratch.save(lists.select("token", "h1", "info", "head").join(named, "h1"), "named")
        mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
        rows = rows.join(mixed, "token").groupBy("head", "node").agg(F.first("info").alias("info"), F.collect_set("token").alias("tokens"))
        rows = self.scratch.save(rows, "across")
        self.scratch.drop("named")
        sweep(self.spark)
        return rows

    def _across(self, shared: DataFrame, nodes: DataFrame, found: DataFrame, best: bool) -> DataFrame:
        """(a, b, c): possible pairs of nodes in different components, with the prefix tokens that they share; or each node's best of them.

        Lists with one head are read together, so a pair is met once for each head and not for each token. Small heads go to
        buckets. A large head's nodes outside its largest component are compared with all its nodes, as a grid of blocks of
        bounded size. Only pairs that pass the sizes and the bitmaps leave a bucket or block.
        """
        spec, percent = self.spec, self.spec.percent
        rows = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = rows.groupBy("head", "component").agg(F.count(F.lit(1)).alias("n"))
        sizes = sizes.groupBy("head").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("minor")).filter("minor > 0")
        large = F.col("n") > spec.small
        sizes = sizes.select("head", "main", "n", *(F.when(large, F.ceil(F.col(c) / spec.block)).otherwise(1).cast("bigint").alias(k) for c, k in (("minor", "rows"), ("n", "cols"))))
        full = rows.join(sizes, "head").join(nodes.select("node", "bitmap"), "node")
        buckets = max(1, -(-shared.count() // spec.bucket_rows))
        # All cells of a row at once: a union of sides would deal the rows anew for each.
        cell = "named_struct('row', {}, 'col', {}, 'left', {})"
        left = f"if(component <> main, transform(sequence(0L, cols - 1L), c -> {cell.format('pmod(xxhash64(node), rows)', 'c', 'true')}), array())"
        right = f"transform(sequence(0L, rows - 1L), r -> {cell.format('r', 'pmod(xxhash64(node), cols)', 'false')})"
        cells = F.explode(F.expr(f"if(n <= {spec.small}, array({cell.format('0L', '0L', 'true')}), concat({left}, {right}))"))
        sides = full.withColumn("large", large).withColumn("cell", cells).select("*", "cell.*")
        group = F.when(~F.col("large"), F.pmod(F.xxhash64("head"), F.lit(buckets))).otherwise(F.xxhash64("head", "row", "col"))
        sides = sides.select(group.alias("grp"), "head", "row", "col", "left", "large", "node", "info", "component", "main", "tokens", "bitmap")

        def match(rows: pd.DataFrame) -> pd.DataFrame:
            out = [_small_pairs(rows[~rows["large"]], percent)]
            for _, block in rows[rows["large"]].groupby(["head", "row", "col"], sort=False):
                out += _block_pairs(block[block["left"]], block[~block["left"]], percent)
            pairs = pd.concat(out, ignore_index=True).groupby(["a", "b"], as_index=False).agg({"c": "sum", "need": "min"})
            if best and len(pairs):
                ends = pd.concat([pairs.assign(x=pairs["a"]), pairs.assign(x=pairs["b"])], ignore_index=True)
                ends = ends.sort_values(["x", "c", "a", "b"], ascending=[True, False, True, True]).drop_duplicates("x")
                pairs = ends.drop(columns="x").drop_duplicates(["a", "b"])
            return pairs

        pairs = sides.groupBy("grp").applyInPandas(lean_group(match), "a bigint, b bigint, c bigint, need bigint")
        pairs = pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("need").alias("need"))
        # A best pair's count is of one bucket and may be short of what it needs; all pairs are counted whole.
        return (pairs if best else pairs.filter("c >= need")).select("a", "b", "c")

    def run(self) -> DataFrame:
        """(doc_id, text_hash, n_shingles, component_id, kept) for every document; ``kept`` marks one doc_id and text of each component."""
        survey = self._survey()
        sets = survey.filter("h2 is not null")
        lists = self._prefixes(*self._frequent(survey))
        nodes = self._nodes(sets)
        keys = nodes.select("h1", "node")
        # Heads of lists first: the one that a set shares most lists with.
        best = lists.filter("h1 <> head").filter(self._fits("info", "head_info")).groupBy("h1", "head").agg(F.count(F.lit(1)).alias("c"))
        best = best.groupBy("h1").agg(F.max_by("head", F.struct("c", "head")).alias("head"))
        pairs = best.join(keys.withColumnRenamed("node", "b"), "h1").join(keys.select(F.col("h1").alias("head"), F.col("node").alias("a")), "head").select("a", "b")
        pairs = self.scratch.save(self._possible(pairs, nodes), "pairs1")
        links = self._linked(pairs, nodes, "links1")
        found = self.scratch.save(components(links, self.scratch), "found1")
        # Then whatever the lists hold across those components. Each node's likeliest partner elsewhere goes first, a few
        # times over: where links are dense, that joins the components, and the pairs inside them need no check.
        shared = self._shared(lists, keys, found)
        seen = None
        for turn in range(self.spec.rounds):
            pairs = self._across(shared, nodes, found, best=True)
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "c")).groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
            best = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            best = self.scratch.save(best if seen is None else best.join(seen, ["a", "b"], "left_anti"), f"best{turn}")
            seen = best if seen is None else seen.unionByName(best)
            more = self._linked(best, nodes, f"links2{turn}")
            found = merged(found, more, self.scratch, f"found2{turn}")
            sweep(self.spark)
        rest = self._across(shared, nodes, found, best=False).select("a", "b")
        rest = self.scratch.save(rest if seen is None else rest.join(seen, ["a", "b"], "left_anti"), "rest")
        sweep(self.spark)
        final = merged(found, self._linked(rest, nodes, "links3"), self.scratch, "found3")
        # A component is named by its smallest doc_id; the text that stands for it is the first one under that doc_id.
        tops = nodes.select("node", "h1", "h2", "doc_id", "text_hash").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = tops.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"))
        ids = self.scratch.save(tops.join(least, "component").select("h1", "h2", F.col("rep.doc_id").alias("component_id"), F.col("rep.text_hash").alias("kept_text")), "ids")
        self.scratch.keep("survey", "ids")
        out = sets.select("doc_id", "text_hash", "n", "h1", "h2").join(ids, ["h1", "h2"], "left")
        has = (F.col("n") > 0) & F.col("doc_id").isNotNull()
        kept = ~has | ((F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("kept_text")))
        return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(has, F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"), kept.alias("kept"))


def similar_components(docs: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document."""
    return JaccardJoin(docs, spec).run().select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """One row of each component, and all rows without a set or an id.

    It is a row of the component's smallest doc_id; of several texts under that doc_id, one is chosen by its hash, and of rows that agree in both, the
    first in the order of all columns written as JSON. So reruns agree, and rows of one doc_id in different components all stay.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    groups = scratch.save(JaccardJoin(docs, spec).run(), "groups")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = ["_doc", "_text"]
    keyed = docs.select(*columns, F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    linked = groups.filter("n_shingles > 0 and doc_id is not null")
    dropped = linked.filter("not kept").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text")).distinct()
    left = keyed.join(dropped, key, "left_anti")
    repeated = linked.filter("kept").groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text")).count().filter("count > 1").select(*key)
    if not repeated.take(1):
        return left.select(*columns)
    order = F.to_json(F.struct(*columns))
    again = left.join(repeated, key, "left_semi").withColumn("_order", order)
    first = again.groupBy(*key).agg(F.min("_order").alias("_order"))
    once = again.join(first, [*key, "_order"]).dropDuplicates([*key, "_order"])
    return left.join(repeated, key, "left_anti").select(*columns).unionByName(once.select(*columns))
