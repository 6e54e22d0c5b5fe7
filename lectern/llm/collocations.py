"""Collocations: phrases of two to four words whose parts keep each other's company, by language.

Every place in a text where a word begins is a suffix pointer, of which the first four words inside its piece count. Blocks of pointers are
summed where they arise; their suffixes are routed over the cluster by language and two leading words, so that all suffixes that
begin with a phrase meet in one partition. There, a multikey three-way quicksort orders the pointers word by word: the size of an equal
partition is the count of its phrase, and a partition below the least count is abandoned with everything in it.

Two prunings precede the routing and lose nothing: a suffix ends before a word that is itself too rare for any candidate (a bitmap of fixed
size tells; a false hit only costs), and leading pairs that hold a large share of all places (a bounded number can) are routed by the
whole suffix. Parts of their phrases are counted in many partitions, and so are those of a partition that is too large
for one sort; nothing is abandoned there, and the parts are added up afterwards.

Scores are computed in decimals, since products may pass 64 bits.

Cases: null and empty texts have no word; a null language is ``und``, together with rows that say ``und``; repeated rows count each; ties are
ordered by count and then by the phrase's bytes; very long texts are read whole, pieces at a time; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, parallelism, short_batches

#: A word in piece-marked text that stands for a piece's end; no word holds a line feed.
BREAK = "\n"
LONGEST = 4


@dataclass(frozen=True)
class PhraseSpec:
    least: int = 30
    top: int = 2000
    #: A longer candidate with this share (in hundredths) of a phrase's count stands for it.
    inside: int = 80
    scale: int = 2_000_000
    #: Characters of text whose pointers are summed together, about.
    block_chars: int = 8_000_000
    #: Bits of the bitmap of words that are frequent enough, as a power of two.
    bitmap_bits: int = 24
    #: Leading pairs with more than one in so many places are routed by whole suffixes; they can be twice as many at most.
    hot_part: int = 1000
    #: Suffixes of one partition, about, and of one sort at most.
    partition_rows: int = 700_000
    sort_rows: int = 3_000_000
    #: Pointers in a partition of the sort that is finished by a plain sort.
    small: int = 16_384


def word_stream(text: pa.Array) -> pa.Array:
    """All words of the texts in order, with a break after each piece and text."""
    marked = pc.binary_join_element_wise(pc.replace_substring_regex(pc.ascii_lower(text), r"[.,;:!?\x0A-\x0D]", f" {BREAK} "), pa.scalar(f" {BREAK}"), "")
    words = pc.list_flatten(pc.split_pattern_regex(marked, r"[\x20\x09]+"))
    return words.filter(pc.not_equal(words, ""))


class Block:
    """Words of one language's texts as numbers, and the pointers' windows over them; 0 is a piece's end."""

    def __init__(self, lang: str, texts: list[pa.Array]):
        self.lang = lang
        coded = pa.chunked_array([word_stream(t) for t in texts], pa.large_string() if pa.types.is_large_string(texts[0].type) else pa.string()).combine_chunks().dictionary_encode()
        self.words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        broken = pc.index(self.words, BREAK).as_py() + 1
        self.codes = np.where(codes == broken, 0, codes)
        self.counts = np.bincount(self.codes, minlength=len(self.words) + 1)

    def windows(self, keep: np.ndarray | None = None) -> np.ndarray:
        """(pointers, 4): each pointer's words, with 0 from its piece's end, or from a word that isn't kept, on."""
        codes = self.codes if keep is None else np.where(keep[self.codes], self.codes, 0)
        padded = np.concatenate([codes, np.zeros(LONGEST - 1, np.int64)])
        out = np.lib.stride_tricks.sliding_window_view(padded, LONGEST)[codes > 0].copy()
        for k in range(1, LONGEST):
            out[out[:, k - 1] == 0, k] = 0
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Leading pairs as one number each, and their numbers of places."""
        w = self.windows()[:, :2]
        w = w[w[:, 1] > 0]
        return np.unique((w[:, 0] << 32) + w[:, 1], return_counts=True)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Block]:
    """Blocks of about so many characters, each of one language; columns are lang and text."""
    held: dict[str, list[pa.Array]] = {}
    chars: dict[str, int] = {}
    for batch in batches:
        text = batch.column(1).filter(pc.is_valid(batch.column(1)))
        langs = batch.column(0).filter(pc.is_valid(batch.column(1)))
        for lang in pc.unique(langs).to_pylist():
            own = text.filter(pc.equal(langs, lang))
            held.setdefault(lang, []).append(own)
            chars[lang] = chars.get(lang, 0) + (pc.sum(pc.binary_length(own)).as_py() or 0)
        while chars and sum(chars.values()) >= size:
            lang = max(chars, key=chars.get)
            del chars[lang]
            yield Block(lang, held.pop(lang))
    for lang, texts in held.items():
        yield Block(lang, texts)


def _sorted(rows: np.ndarray) -> np.ndarray:
    """The ascending order of rows of numbers below 2 ** 31, two of which are compared at once."""
    wide = rows.astype(np.int64)
    keys = [(wide[:, k] << 32) | wide[:, k + 1] if k + 1 < wide.shape[1] else wide[:, k] for k in range(0, wide.shape[1], 2)]
    return np.lexsort(keys[::-1])


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in ascending order, and how often each stands."""
    rows = rows[_sorted(rows)]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return rows[at], np.diff(np.append(at, len(rows)))


def multikey_quicksort(words: np.ndarray, weight: np.ndarray, least: int, small: int = PhraseSpec.small) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """(pointers, depth, counts): one pointer to each phrase of ``depth`` words that at least ``least`` pointers' weights begin with.

    Partitions are arrays of pointers that agree in the words before their depth. One is split by a pivot word into those below, equal
    and above; what is equal goes on to the next word. No partition of less weight is followed.
    """
    out, todo = [], [(np.arange(len(words)), 0)]
    while todo:
        at, depth = todo.pop()
        if not len(at) or weight[at].sum() < least:
            continue
        if len(at) <= small:
            out += _finished(words, weight, at, depth, least)
            continue
        key = words[at, depth]
        pivot = np.median(key[[0, len(key) // 2, -1]]).astype(key.dtype)
        equal = at[key == pivot]
        todo += [(at[key < pivot], depth), (at[key > pivot], depth)]
        if pivot and (n := weight[equal].sum()) >= least:
            out.append((equal[:1], depth + 1, np.asarray([n])))
            if depth + 1 < words.shape[1]:
                todo.append((equal, depth + 1))
    return out


def _finished(words: np.ndarray, weight: np.ndarray, at: np.ndarray, depth: int, least: int) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """What a small partition holds, by one sort of its pointers by all words that are left."""
    keys = words[at, depth:]
    order = _sorted(keys)
    keys, at = keys[order], at[order]
    total, new, out = np.concatenate([[0], np.cumsum(weight[at])]), np.zeros(len(at), bool), []
    new[0] = True
    for k in range(keys.shape[1]):
        new[1:] |= keys[1:, k] != keys[:-1, k]
        first = np.flatnonzero(new)
        n = total[np.append(first[1:], len(at))] - total[first]
        some = (n >= least) & (keys[first, k] > 0)
        if not some.any():
            break
        out.append((at[first[some]], depth + k + 1, n[some]))
    return out


def _survey(docs: DataFrame, spec: PhraseSpec) -> DataFrame:
    """(lang, words, phrase, n): all words of each block with their counts, and its leading pairs of a large share."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, spec.block_chars):
            n = block.counts[1:]
            some = np.flatnonzero(n)
            pairs, places = block.pairs()
            hot = places * spec.hot_part >= n.sum()
            pairs, places = pairs[hot], places[hot]
            first, second = (block.words.take(pa.array(x - 1)) for x in (pairs >> 32, pairs & 0xFFFFFFFF))
            for size, phrase, value in ((1, block.words.take(pa.array(some)), n[some]), (2, pc.binary_join_element_wise(first, second, " "), places)):
                if len(phrase):
                    yield pa.RecordBatch.from_arrays([pa.array([block.lang] * len(phrase)), pa.array(np.full(len(phrase), size, np.int32)), phrase.cast(pa.string()), pa.array(value.astype(np.int64))], ["lang", "words", "phrase", "n"])

    return docs.mapInArrow(lean(count), "lang string, words int, phrase string, n bigint")


def _bit(spec: PhraseSpec) -> Column:
    return F.crc32(F.concat_ws(" ", "lang", "phrase").cast("binary")).bitwiseAND(F.lit((1 << spec.bitmap_bits) - 1))


def _bitmap(words: DataFrame, spec: PhraseSpec) -> np.ndarray:
    """A bit for the hash of each frequent word: 2 ** bitmap_bits bits, whatever the corpus."""
    lanes = words.select(_bit(spec).alias("bit")).groupBy(F.shiftright("bit", 6).alias("lane")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (spec.bitmap_bits - 6), np.uint64)
    out[lanes["lane"].to_numpy(np.int64)] = lanes["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _suffixes(docs: DataFrame, bitmap: np.ndarray, hot: list[tuple[str, str]], spec: PhraseSpec) -> DataFrame:
    """(lang, suffix, hot, n): the distinct suffixes of two to four frequent words of each block."""
    spark = docs.sparkSession
    shared, mask = spark.sparkContext.broadcast((bitmap, frozenset(hot))), (1 << spec.bitmap_bits) - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = shared.value
        for block in blocks(batches, spec.block_chars):
            bits = np.asarray([zlib.crc32(f"{block.lang} {w}".encode()) & mask for w in block.words.to_pylist()], np.int64)
            keep = np.concatenate([[False], (bitmap[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) > 0])
            rows = block.windows(keep)
            rows, n = distinct_rows(rows[rows[:, 1] > 0])
            pair = (rows[:, 0] << 32) + rows[:, 1]
            place = {w: k + 1 for k, w in enumerate(block.words.to_pylist())} if any(lang == block.lang for lang, _ in hot) else {}
            known = [tuple(place.get(w, 0) for w in p.split(" ")) for lang, p in hot if lang == block.lang]
            crowded = np.isin(pair, np.asarray([(x << 32) + y for x, y in known], np.int64))
            for lo in range(0, len(rows), 200_000):
                part = rows[lo : lo + 200_000]
                words = [block.words.take(pa.array(np.where(part[:, k] > 0, part[:, k] - 1, 0), mask=part[:, k] == 0)) for k in range(LONGEST)]
                suffix = pc.binary_join_element_wise(*words, " ", null_handling="skip").cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([block.lang] * len(part)), suffix, pa.array(crowded[lo : lo + 200_000]), pa.array(n[lo : lo + 200_000].astype(np.int64))], ["lang", "suffix", "hot", "n"])

    return docs.mapInArrow(lean(emit), "lang string, suffix string, hot boolean, n bigint")


def _counted(suffixes: DataFrame, spec: PhraseSpec) -> DataFrame:
    """(lang, words, phrase, n): counts of phrases of two words or more, from whole partitions or parts of them."""

    def sort(langs: pa.Array, suffix: pa.Array, n: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
        for lang in pc.unique(langs).to_pylist():
            at = pc.equal(langs, lang).to_numpy(zero_copy_only=False)
            own = suffix.filter(pa.array(at))
            split = pc.split_pattern(own, " ")
            coded = pc.list_flatten(split).dictionary_encode()
            size = pc.list_value_length(split).to_numpy(zero_copy_only=False)
            words = np.zeros((len(own), LONGEST), np.int32)
            words[np.arange(LONGEST) < size[:, None]] = coded.indices.to_numpy(zero_copy_only=False) + 1
            for pointers, depth, counts in multikey_quicksort(words, n[at], least, spec.small):
                if depth > 1:
                    parts = [coded.dictionary.take(pa.array(words[pointers, k] - 1)) for k in range(depth)]
                    phrase = pc.binary_join_element_wise(*parts, " ")
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase)), pa.array(np.full(len(phrase), depth, np.int32)), phrase.cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "words", "phrase", "n"])

    def both(held: list[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        for hot in (False, True):
            own = table.filter(pc.equal(table["hot"], hot))
            if len(own):
                yield from sort(own["lang"].combine_chunks(), own["suffix"].combine_chunks(), own["n"].to_numpy(), 1 if hot else least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, whole = [], 0, True
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= spec.sort_rows:
                whole = False
                yield from both(held, 1)
                held, rows = [], 0
        if held:
            yield from both(held, spec.least if whole else 1)

    return suffixes.mapInArrow(lean(count), "lang string, words int, phrase string, n bigint")


def phrase_counts(docs: DataFrame, spec: PhraseSpec = PhraseSpec()) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of one to four words with f >= least, and (lang, n) with all words' occurrences."""
    short_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "phrases")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    survey = scratch.save(_survey(texts, spec).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")), "survey")
    single = survey.filter("words = 1")
    totals = scratch.save(single.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    n = totals.agg(F.sum("n")).first()[0] or 0
    often = single.filter(F.col("n") >= spec.least)
    # A pair with two in hot_part places or more is found in blocks that hold half of them at least.
    hot = survey.filter((F.col("words") == 2) & (F.col("n") * 2 * spec.hot_part >= n)).select("lang", "phrase")
    hot = [tuple(r) for r in hot.collect()]  # 2 * hot_part rows at most
    suffixes = _suffixes(texts, _bitmap(often, spec), hot, spec)
    route = F.when(F.col("hot"), F.xxhash64("lang", "suffix")).otherwise(F.xxhash64("lang", F.substring_index("suffix", " ", 2)))
    parts = max(parallelism(docs.sparkSession), -(-n // spec.partition_rows))
    found = _counted(suffixes.repartition(parts, route), spec)
    found = found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= spec.least)
    single = often.select("lang", "words", "phrase", F.col("n").alias("f"))
    return scratch.save(single.unionByName(found), "counts"), totals


def _slice(first: Column | int, size: Column | int) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.array_join(F.slice("w", as_column(first), as_column(size)), " ")


def collocations(docs: DataFrame, spec: PhraseSpec = PhraseSpec()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score."""
    return ranked(*phrase_counts(docs, spec), spec)


def ranked(counts: DataFrame, totals: DataFrame, spec: PhraseSpec = PhraseSpec()) -> DataFrame:
    """Each language's first phrases by score, from the counts of all phrases and words."""
    phrases = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # The cut with the lowest score, the smallest k among equals.
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _slice(1, F.col("k")).alias("first"), _slice(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    of = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("cut", wide("a") * F.lit(spec.scale).cast("decimal(9,0)")).withColumn("sum", wide("l") + wide("r")).withColumn("score", F.expr("cut div sum"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("s")).select("lang", "phrase", "s.score", "s.l", "s.r", "s.a")
    # The largest count of a longer candidate around each phrase.
    places = F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: _slice(i, m)))
    around = phrases.filter("words > 2").select("lang", "a", F.explode(F.flatten(places)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < wide("a") * spec.inside))
    # First within parts of a language, then among the parts' first: no language's phrases are in one place.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parallelism(counts.sparkSession))))
    firsts = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= spec.top)
    out = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= spec.top)
    return out.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
