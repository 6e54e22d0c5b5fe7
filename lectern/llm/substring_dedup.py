"""Removal of repeated substrings: threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that also starts anywhere else is removed. Work is split by
content, so that equal strings meet without any global index:

1. Each window of ``length`` bytes has an anchor, the gram with the least hash in it; equal windows have equal
   anchors. Runs of windows with one anchor are segments. Anchors that occur once are dropped by a join with
   their counts; identical segments are counted together, so copies of a passage collapse to one row, and so do the
   segments of a periodic stretch (a run of blanks, a ruler) inside a text.
2. Where an anchor has different segments, their bytes are gathered in buckets by anchor. Each bucket is small
   text of its own: its suffixes are sorted, and from the transform common prefixes are derived by increasing
   value, breadth first, by backward extension, stopping at ``length``. What has no boundary below it is a class of
   equal strings; a class of two occurrences or more is repeated.
3. Anchors with very many different segments (a passage in a large share of all documents has such at its ends)
   would overfill a bucket. Their windows are dealt by their distance to the anchor, ``fine`` distances at a time, and by the bytes
   that all windows of that distance hold; what coincides collapses again, and the parts are buckets of their own. The last
   step leaves windows that differ in one byte at each end, so a bucket's size is bounded.
4. Repeated windows go back to the documents as spans; texts are cut in place.

Cases: null text is empty; texts shorter than ``length`` keep all bytes; very long texts are read whole, window by window; repeated rows are copies of each other;
an empty table gives an empty result; further columns are ignored by :func:`find_repeats` and carried along by
:func:`remove_repeats`, which also keeps characters whole: bytes of a character that a span cuts stay out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import PLACE_BITS, segments
from .common import Scratch, lean, lean_group, short_batches
from .rolling import Prefix, mix64

#: A byte that no UTF-8 text holds.
BREAK = 0xFF


@dataclass(frozen=True)
class RepeatSpec:
    length: int = 200
    gram: int = 48
    #: Segment bytes in a bucket, about.
    bucket_bytes: int = 1_000_000
    #: Different segments of one anchor that make it a crowded one.
    max_segments: int = 3_000
    #: Distances to the anchor that are dealt together where it is crowded, and where such parts are crowded in turn.
    fine: tuple[int, ...] = (16, 2)
    chunk_bytes: int = 1_000_000


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes at least, and the rank of each; by prefix doubling."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    keys = np.zeros(n, np.uint64)
    for i in range(8):
        keys = (keys << np.uint64(8)) | padded[i : i + n].astype(np.uint64)
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.ones(n, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    # A group's rank is the place of its first member, so finer ranks never disturb coarser ones.
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    size, known = np.diff(np.append(np.flatnonzero(new), n)), 8
    active = np.flatnonzero(np.repeat(size > 1, size))
    while known < depth and len(active):
        suffix = order[active]
        follow = suffix + known
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        key = (rank[suffix] << 32) | second
        by = np.argsort(key)
        order[active] = suffix[by]
        key = key[by]
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        first = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        rank[order[active]] = first
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(active)))
        active = active[np.repeat(size > 1, size)]
        known *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def equal_classes(data: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of data that ends in a BREAK a class number, equal where the first ``length`` bytes are; by interval expansion.

    Boundaries between neighbours in the sorted order are set by the length of their common prefix, in rising
    order. A boundary found at length l is extended backward by every symbol that precedes it in the transform, and
    so gives those at l + 1: directly where a symbol's neighbours stay neighbours, by counting boundaries
    in between where they don't. Nothing beyond ``length`` is expanded.
    """
    n = len(data)
    order, place = suffix_order(data, length)
    after = place[np.minimum(order + 1, n - 1)]
    low, high = np.minimum(after[:-1], after[1:]), np.maximum(after[:-1], after[1:])
    low, high = np.insert(low, 0, 0), np.insert(high, 0, 0)
    head = data[order]
    before = np.where(order > 0, place[np.maximum(order - 1, 0)], 0)
    cut = np.zeros(n, bool)
    cut[0] = True
    cut[1:] = (head[1:] != head[:-1]) | (order[1:] == n - 1) | (order[:-1] == n - 1)
    fresh = np.flatnonzero(cut)
    near = high - low == 1
    far = np.flatnonzero(~near & ~cut)
    for _ in range(1, length):
        reached = before[fresh]
        reached = reached[near[reached] & ~cut[reached] & (high[reached] == fresh)]
        if len(far):
            marks = np.zeros(n + 1, np.int32)
            marks[fresh + 1] = 1
            upto = np.cumsum(marks, dtype=np.int32)
            hit = upto[high[far] + 1] > upto[low[far] + 1]
            reached, far = np.concatenate([reached, far[hit]]), far[~hit]
        if not len(reached):
            break
        cut[reached] = True
        fresh = reached
    return (np.cumsum(cut) - 1)[place]


def repeated_ranges(parts: list[bytes], owned: np.ndarray, weight: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, from, to) of the owned starts whose string occurs twice or more, counting each part so often."""
    data = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8)
    sizes = np.asarray([len(p) + 1 for p in parts])
    begin = np.cumsum(sizes) - sizes
    part = np.repeat(np.arange(len(parts)), owned)
    offset = np.arange(len(part)) - np.repeat(np.cumsum(owned) - owned, owned)
    found = equal_classes(data, length)[begin[part] + offset]
    repeated = np.bincount(found, weight[part])[found] >= 2
    return runs(part, offset, repeated)


def runs(part: np.ndarray, offset: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked, consecutive offsets of a part, as (part, from, to)."""
    part, offset = part[marked], offset[marked]
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (offset[1:] != offset[:-1] + 1)
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(part)) - 1
    return part[start], offset[start], offset[stop[: len(start)]] + 1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _batched(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about so many bytes."""
    total, held = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size or i + 1 == len(texts):
            yield held, i + 1
            total, held = 0, i + 1


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).withColumn("_hash", F.xxhash64("text"))


def _segments(keyed: DataFrame, spec: RepeatSpec) -> DataFrame:
    names = ["g", "h", "_id", "_hash", "start", "owned", "times"]
    longest = (1 << PLACE_BITS) - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, owner, base = [], [], []
            for i, t in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                # A text past what a place can number is read in pieces that overlap by a window less one byte.
                for at in range(0, max(1, len(t or b"") - spec.length + 1), longest // 2):
                    texts.append((t or b"")[at : at + longest // 2 + spec.length - 1])
                    owner.append(i)
                    base.append(at)
            owner, base = np.asarray(owner, np.int64), np.asarray(base, np.int64)
            for lo, hi in _batched(texts, spec.chunk_bytes):
                ends = np.cumsum([len(t) for t in texts[lo:hi]])
                text, first, owned, g, h = segments(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), ends, spec.length, spec.gram)
                begin = ends - [len(t) for t in texts[lo:hi]]
                # In a periodic stretch one segment follows another like it: such a series is one row.
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (text[1:] != text[:-1]) | (first[1:] != first[:-1] + owned[:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(g))).astype(np.int32)
                text, first, owned, g, h = (x[new] for x in (text, first, owned, g, h))
                doc = owner[lo:hi][text]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g.view(np.int64), h.view(np.int64), ids[doc], hashes[doc], base[lo:hi][text] + first - begin[text], owned.astype(np.int32), times)], names)

    return keyed.select("_id", "_hash", "text").filter("text is not null").mapInArrow(lean(emit), "g bigint, h bigint, _id bigint, _hash bigint, start bigint, owned int, times int")


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments' bytes from their documents' texts."""
    names = ["g", "h", "copies", "owned", "crowded", "bytes"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    for batch in batches:
        out: list[tuple] = []
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_buffer().to_pybytes()
            for w in wanted.as_py():
                out.append((w["g"], w["h"], w["copies"], w["owned"], w["crowded"], text[w["start"] : w["start"] + w["bytes"]]))
            if len(out) >= 4_000:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names)


def dealt(data: bytes, owned: int, length: int, gram: int, fine: int, key: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(key, sub, first, owned, size): the parts of a segment's windows, dealt by distance to the anchor.

    ``key`` is the anchor's hash; a part's key is of its distances and of the bytes that every window of such distances holds, and sub of all its bytes.
    """
    sums = Prefix(np.frombuffer(data, np.uint8))
    at = np.arange(len(data) - gram + 1)
    anchor = int(np.flatnonzero(sums.of(at, at + gram).view(np.int64) == key)[0])
    for near in range((anchor - owned + 1) // fine * fine, anchor + 1, fine):
        first, last = max(0, anchor - near - fine + 1), min(owned - 1, anchor - near)
        if first > last:
            continue
        core, whole = sums.of(np.asarray([anchor - near, first]), np.asarray([anchor - near - fine + 1 + length, last + length]))
        part = mix64(np.asarray([core, whole]) + np.asarray([near, anchor - first], np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
        yield int(part[0]), int(part[1]), first, last - first + 1, last - first + length


def _expanded(parts: DataFrame, spec: RepeatSpec) -> DataFrame:
    """(key, sub, lo, hi): repeated starts of distinct parts (key, sub, copies, owned, bytes), bucket by bucket."""
    size = parts.agg(F.sum(F.col("owned") + spec.length)).first()[0] or 0
    buckets = max(1, -(-size // spec.bucket_bytes))

    def expand(group: pd.DataFrame) -> pd.DataFrame:
        part, lo, hi = repeated_ranges(group["bytes"].tolist(), group["owned"].to_numpy(np.int64), group["copies"].to_numpy(np.float64), spec.length)
        return pd.DataFrame({"key": group["key"].to_numpy()[part], "sub": group["sub"].to_numpy()[part], "lo": lo, "hi": hi})

    grouped = parts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket")
    return grouped.applyInPandas(lean_group(expand), "key bigint, sub bigint, lo bigint, hi bigint")


def _crowded_ranges(crowded: DataFrame, spec: RepeatSpec, scratch: Scratch, step: int = 0) -> DataFrame:
    """(g, h, lo, hi) of crowded anchors' segments (g, h, off, copies, owned, bytes), whose windows are dealt anew."""
    length, gram, fine = spec.length, spec.gram, spec.fine[step]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "h", "off", "copies", "owned", "bytes", "key", "sub"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for r in batch.slice(at, 500).to_pylist():
                    for key, sub, first, owned, size in dealt(r["bytes"], r["owned"], length, gram, fine, r["g"]):
                        out.append((r["g"], r["h"], r["off"] + first, r["copies"], owned, r["bytes"][first : first + size], key, sub))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names)

    parts = crowded.mapInArrow(lean(deal), "g bigint, h bigint, off bigint, copies bigint, owned int, bytes binary, key bigint, sub bigint")
    parts = scratch.save(parts, f"dealt{step}")
    distinct = parts.groupBy("key", "sub").agg(F.sum("copies").alias("copies"), F.first("owned").alias("owned"), F.first("bytes").alias("bytes"))
    if step + 1 == len(spec.fine):
        return _back(parts, _expanded(scratch.save(distinct, f"distinct{step}"), spec))
    again = parts.select("key", "sub").distinct().groupBy("key").agg((F.count(F.lit(1)) > spec.max_segments).alias("crowded"))
    distinct = scratch.save(distinct.join(again, "key"), f"distinct{step}")
    out = _back(parts, _expanded(distinct.filter("not crowded"), spec))
    if not distinct.filter("crowded").take(1):
        return out
    finer = parts.join(distinct.filter("crowded").select("key", "sub"), ["key", "sub"], "left_semi")
    return out.unionByName(_crowded_ranges(finer.select("g", "h", "off", "copies", "owned", "bytes"), spec, scratch, step + 1))


def _back(parts: DataFrame, ranges: DataFrame) -> DataFrame:
    found = parts.select("g", "h", "off", "key", "sub").join(ranges, ["key", "sub"])
    return found.select("g", "h", (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi"))


def _spans(keyed: DataFrame, spec: RepeatSpec, scratch: Scratch) -> DataFrame:
    """(_id, _hash, spans): for each text with repeats its array of (s, e)."""
    found = scratch.save(_segments(keyed, spec), "segments")
    again = found.groupBy("g").agg(F.sum("times").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    again = again.filter("n > 1").select(F.col("g").alias("k"), (F.col("lo") < F.col("hi")).alias("mixed"))
    found = scratch.save(found.join(again, F.col("g") == F.col("k")).drop("k"), "repeated")
    scratch.drop("segments")
    mixed = found.filter("mixed")
    kinds = mixed.groupBy("g", "h").agg(F.sum("times").alias("copies"), F.min(F.struct("_id", "_hash", "start", "owned")).alias("at"))
    per_anchor = kinds.groupBy("g").agg((F.count(F.lit(1)) > spec.max_segments).alias("crowded")).withColumnRenamed("g", "k")
    kinds = scratch.save(kinds.join(per_anchor, F.col("g") == F.col("k")).select("g", "h", "copies", "crowded", "at.*"), "kinds")
    # A text's own segments: bounded by the text.
    wanted = kinds.groupBy("_id", "_hash").agg(F.collect_list(F.struct("g", "h", "copies", "start", "owned", "crowded", (F.col("owned") + spec.length - 1).alias("bytes"))).alias("wanted"))
    cut = keyed.select("_id", "_hash", "text").join(wanted, ["_id", "_hash"]).dropDuplicates(["_id", "_hash"])
    cut = cut.select(F.col("text").cast("binary").alias("text"), "wanted").mapInArrow(lean(_cut_out), "g bigint, h bigint, copies bigint, owned int, crowded boolean, bytes binary")
    cut = scratch.save(cut, "cut")
    ranges = _expanded(cut.filter("not crowded").withColumnsRenamed({"g": "key", "h": "sub"}), spec).withColumnsRenamed({"key": "g", "sub": "h"})
    if cut.filter("crowded").take(1):
        crowded = cut.filter("crowded").select("g", "h", F.lit(0).cast("bigint").alias("off"), "copies", "owned", "bytes")
        # Spread by segment: a crowded anchor's segments are many.
        ranges = ranges.unionByName(_crowded_ranges(crowded.repartition("g", "h"), spec, scratch))
    ranges = scratch.save(ranges, "ranges").select(F.col("g").alias("k"), F.col("h").alias("l"), "lo", "hi")
    scratch.keep("repeated", "ranges")
    # All windows of segments that are each other's copies are repeated.
    till = F.col("start") + F.col("owned") * F.col("times") + (spec.length - 1)
    whole = found.filter("not mixed or times > 1").select("_id", "_hash", F.col("start").alias("s"), till.alias("e"))
    parts = mixed.filter("times = 1").join(ranges, (F.col("g") == F.col("k")) & (F.col("h") == F.col("l")))
    parts = parts.select("_id", "_hash", (F.col("start") + F.col("lo")).alias("s"), (F.col("start") + F.col("hi") + (spec.length - 1)).alias("e"))
    return whole.unionByName(parts).groupBy("_id", "_hash").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def find_repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every document."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, removed = text or b"", merged([(x["s"], x["e"]) for x in spans or []])
                out.append((len(text), sum(e - s for s, e in removed), len(removed), hashlib.sha256(_without(text, removed)).hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate(types))], names)

    short_batches(docs.sparkSession)
    keyed = _keyed(docs.select("doc_id", "text"))
    spans = _spans(keyed, spec, Scratch(docs.sparkSession, "repeats"))
    rows = keyed.join(spans, ["_id", "_hash"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(lean(digest), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _without(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in removed:
        kept.append(text[at:s])
        at = e
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """The documents with their repeated strings cut out of the text; documents left without text go."""

    def one(t: str | None, found) -> str | None:
        if t is None or found is None:
            return t
        return _without(t.encode(), merged([(x["s"], x["e"]) for x in found])).decode("utf-8", "ignore")

    @F.pandas_udf("string")
    def cut(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from lean(lambda some: (pd.Series([one(t, s) for t, s in zip(text, spans, strict=True)], dtype=object) for text, spans in some))(rows)

    short_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = _keyed(docs.select("doc_id", "text", row))
    spans = _spans(keyed, spec, Scratch(docs.sparkSession, "repeats"))
    rows = keyed.join(spans, ["_id", "_hash"], "left").withColumn("_text", cut("text", "spans"))
    rows = rows.filter("spans is null or length(_text) > 0")
    return rows.select(*[(F.col("_text") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
