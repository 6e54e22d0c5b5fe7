"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of about ``docs_per_block`` documents. Targets (in words) become exact
block quotas: whole passes over a source, then the first blocks of a seeded permutation, the last of them
cut inside. A binary tree over the output shards splits the vector of block quotas: at each node the left
half draws its share without replacement, i.e. from a multivariate hypergeometric law, seeded by the
node's place. Each shard then takes disjoint ranges of the permuted blocks and is shuffled locally by a seeded hash.

The tree is walked in parallel: a task holds a group of sources and a run of shards, and draws the nodes above and
inside its run. Sources are grouped by a hash, so that only one number for each ``sources_per_group`` sources is on the
driver; a node draws the groups' shares first and then those of a group's sources, which is the same law. Blocks grow with the
corpus once there would be more than ``max_blocks`` of them, which keeps the draws exact at any size.

Cases: null text has size 0 and is never taken; a null source is a source of its own, ordered last; rows without a
doc_id are told apart by their texts; repeated rows are rows of their own that share what is taken of them evenly; very long
texts are documents like others, cut between words; an empty table gives an empty result; further columns of the input
are carried along by :func:`mix` and ignored by :func:`mix_plan`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch


@dataclass(frozen=True)
class MixSpec:
    weights: tuple[int, ...] = (5, 2, 1)
    max_repeats: int = 3
    docs_per_block: int = 16
    seed: int = 17
    words_per_shard: int = 50_000_000
    #: Shards, at least, however few words there are.
    min_shards: int = 32
    sources_per_group: int = 10_000
    #: Drawn blocks, at most: numpy draws exactly below 1,000,000,000.
    max_blocks: int = 800_000_000
    #: Shards whose part of the tree is one task's.
    shards_per_task: int = 1024


def _name(source: str = "source") -> Column:
    """A source as text in which null differs from every name."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, spec: MixSpec) -> DataFrame:
    """Per source its rows, words and target: a water level that no source's cap stands below."""
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weights = F.array(*map(F.lit, spec.weights))
    by = by.withColumn("w", F.element_at(weights, ((F.row_number().over(ordered) - 1) % len(spec.weights) + 1).cast("int")).cast("bigint"))
    every = Window.partitionBy()
    by = by.withColumn("cap", F.col("source_size") * spec.max_repeats).withColumn("total", F.sum("source_size").over(every))
    filling = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    by = by.withColumn("left_w", F.sum("w").over(onward))
    by = by.withColumn("capped", F.col("cap") * F.col("left_w") <= F.col("w") * F.col("left_words"))
    open_words = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    open_w = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * open_words.cast("double") / open_w.cast("double"))
    by = by.withColumn("target", target).withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.col("cap")))
    size = F.greatest(F.col("source_size"), F.lit(1))
    per_block = F.greatest(F.lit(spec.docs_per_block), F.ceil(F.sum("n_docs").over(every) * spec.max_repeats / spec.max_blocks))
    return by.select(
        "source", _name().alias("src"), "n_docs", "source_size", "target", F.ceil(F.col("n_docs") / per_block).cast("bigint").alias("n_blocks"),
        F.floor(F.col("quota") / size).cast("bigint").alias("passes"),
        (F.col("quota") - F.floor(F.col("quota") / size) * F.col("source_size")).cast("bigint").alias("rest"),
    )


def _cumulated(blocks: DataFrame) -> DataFrame:
    """Words and blocks before each block in its source's permutation, in two steps so that no window spans a whole source."""
    blocks = blocks.withColumn("chunk", F.shiftright("perm", 52))
    step = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = blocks.groupBy("src", "chunk").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
    chunks = chunks.select("src", "chunk", F.coalesce(F.sum("w").over(step), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(step), F.lit(0)).alias("n0"))
    inner = Window.partitionBy("src", "chunk").orderBy("perm", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("w1", F.coalesce(F.sum("words").over(inner), F.lit(0))).withColumn("n1", F.count(F.lit(1)).over(inner))
    return blocks.join(chunks, ["src", "chunk"]).withColumn("before", F.col("w0") + F.col("w1")).withColumn("place", F.col("n0") + F.col("n1")).drop("w0", "w1", "n0", "n1", "chunk")


def split(groups: np.ndarray, group: int, quotas: np.ndarray, n_shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, sources, offsets, counts) for shards first to last (excluded) and one group's sources that they draw.

    ``groups`` are the block quotas of all groups, ``quotas`` those of this group's sources. A node of the tree is a run of shards;
    its left half draws as many blocks as its part of the shards, and every task that meets the node draws the same.
    """
    todo = [(0, n_shards, groups, np.arange(len(quotas)), np.zeros(len(quotas), np.int64), quotas)]
    while todo:
        lo, hi, totals, sources, start, have = todo.pop()
        if hi <= first or lo >= last or not len(sources):
            continue
        if hi - lo == 1:
            yield lo, sources, start, have
            continue
        mid = (lo + hi) // 2
        draw = int(totals.sum()) * (mid - lo) // (hi - lo)
        left_totals = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(totals, draw)
        left = np.random.default_rng([seed, lo, hi, group + 1]).multivariate_hypergeometric(have, int(left_totals[group]))
        for side in ((lo, mid, left_totals, start, left), (mid, hi, totals - left_totals, start + left, have - left)):
            some = side[4] > 0
            todo.append((*side[:3], sources[some], side[3][some], side[4][some]))


def _draws(quota: DataFrame, n_shards: int, spec: MixSpec) -> DataFrame:
    """(shard, src, i): the block instances that each shard draws, from block quotas (src, q) of all sources."""
    spark, seed, step = quota.sparkSession, spec.seed, spec.shards_per_task
    n_groups = max(1, -(-quota.count() // spec.sources_per_group))
    quota = quota.filter("q > 0").withColumn("grp", F.pmod(F.xxhash64("src"), F.lit(n_groups)).cast("int"))
    totals = np.zeros(n_groups, np.int64)
    for r in quota.groupBy("grp").agg(F.sum("q").alias("q")).collect():  # one row for each sources_per_group sources
        totals[r.grp] = r.q

    def leaves(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("src", ignore_index=True)
        grp, task = map(int, key)
        found = list(split(totals, grp, rows["q"].to_numpy(np.int64), n_shards, task * step, (task + 1) * step, seed))
        out = [pd.DataFrame({"shard": shard, "src": rows["src"].to_numpy()[at], "first": start, "n": have}) for shard, at, start, have in found]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"shard": [], "src": [], "first": [], "n": []}).astype({"src": str})

    tasks = F.explode(F.expr(f"sequence(0, {(n_shards - 1) // step})")).alias("task")
    drawn = quota.select("grp", "src", "q", tasks).groupBy("grp", "task").applyInPandas(leaves, "shard bigint, src string, first bigint, n bigint")
    return drawn.select("shard", "src", F.explode(F.expr("sequence(first, first + n - 1)")).alias("i"))


@dataclass
class Plan:
    #: (doc_id, source, size, hash) of every row.
    sizes: DataFrame
    #: A row for each source.
    targets: DataFrame
    #: (src, block, pass, shard): the drawn blocks; ``part`` marks those that are cut inside.
    drawn: DataFrame
    #: (src, block, order, take): what the rows of cut blocks give.
    cuts: DataFrame
    scratch: Scratch


def _keyed(rows: DataFrame, targets: DataFrame, spec: MixSpec) -> DataFrame:
    """Rows with their source's figures, block and order inside the block."""
    few = targets.select("src", "n_blocks", "source_size", "target")
    few = F.broadcast(few) if targets.count() <= spec.sources_per_group else few
    keyed = rows.withColumn("src", _name()).join(few, "src")
    return keyed.withColumn("order", F.xxhash64("doc_id", "hash", F.lit(spec.seed))).withColumn("block", F.pmod(F.xxhash64("order"), F.col("n_blocks")))


def _plan(docs: DataFrame, spec: MixSpec) -> Plan:
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.save(docs.select("doc_id", "source", _size().alias("size"), F.xxhash64("text").alias("hash")), "sizes")
    targets = scratch.save(source_targets(sizes, spec).coalesce(1), "targets")
    keyed = _keyed(sizes, targets, spec)
    # Repeated rows have one order, so a block's orders are few though its rows may be many.
    orders = keyed.groupBy("src", "block", "order").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("copies"))
    orders = scratch.save(orders, "orders")
    blocks = orders.groupBy("src", "block").agg(F.sum("words").alias("words"))
    blocks = _cumulated(blocks.withColumn("perm", F.xxhash64("src", "block", F.lit(spec.seed))))
    blocks = blocks.join(targets.select("src", "passes", "rest"), "src")
    cut = F.least(F.col("words"), F.greatest(F.lit(0), F.col("rest") - F.col("before"))).cast("bigint")
    blocks = scratch.save(blocks.withColumn("cut", cut).withColumn("part", F.col("cut") < F.col("words")), "blocks")
    # Block quotas: passes times all blocks, and those that the rest reaches.
    quota = blocks.groupBy("src").agg((F.max("passes") * F.count(F.lit(1)) + F.count(F.when(F.col("cut") > 0, 1))).alias("q"), F.count(F.lit(1)).alias("of"))
    quota = scratch.save(quota, "quota")
    n_shards = max(spec.min_shards, -(-(targets.agg(F.sum("source_size")).first()[0] or 0) // spec.words_per_shard))
    drawn = _draws(quota.select("src", "q"), n_shards, spec).join(quota.select("src", "of"), "src")
    drawn = drawn.select("shard", "src", F.expr("i div of").alias("pass"), (F.col("i") % F.col("of")).alias("place"))
    drawn = drawn.join(blocks.select("src", "block", "place", "passes", "part"), ["src", "place"])
    drawn = scratch.save(drawn.select("src", "block", "pass", "shard", (F.col("part") & (F.col("pass") >= F.col("passes"))).alias("part")), "drawn")
    # Only one block of a source is cut inside, so this window sees few rows.
    cutting = orders.join(blocks.filter("part and cut > 0").select("src", "block", "cut"), ["src", "block"])
    before = F.coalesce(F.sum("words").over(Window.partitionBy("src", "block").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.least(F.col("words"), F.greatest(F.lit(0), F.col("cut") - before))
    cuts = scratch.save(cutting.select("src", "block", "order", F.floor(take / F.col("copies")).cast("bigint").alias("take")), "cuts")
    scratch.keep("sizes", "targets", "drawn", "cuts")
    return Plan(sizes, targets, drawn, cuts, scratch)


def mix_plan(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """Per document its size, its source's size and target, the words that the mix takes of it, and its draws: the shard and the place in the shard's local order of each."""
    plan = _plan(docs, spec)
    # A block is drawn max_repeats times at most, so this groups a few rows.
    draws = plan.drawn.groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "part"))).alias("draws"))
    rows = _keyed(plan.sizes, plan.targets, spec).join(draws, ["src", "block"], "left").join(plan.cuts, ["src", "block", "order"], "left")
    took = lambda d: F.when(d["part"], F.coalesce("take", F.lit(0))).otherwise(F.col("size"))
    draws = F.filter(F.coalesce("draws", F.array().cast("array<struct<pass:bigint,shard:bigint,part:boolean>>")), lambda d: took(d) > 0)
    taken = F.aggregate(draws, F.lit(0).cast("bigint"), lambda a, d: a + took(d))
    seen = F.transform(draws, lambda d: F.struct(d["shard"].alias("shard"), _local(d["pass"], spec).alias("local_order")))
    return rows.select("doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", taken.alias("taken"), seen.alias("draws"))


def _local(number: Column, spec: MixSpec) -> Column:
    return F.xxhash64("order", number, F.lit(~spec.seed))


def mix(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The mixed rows, with the input's columns: a row for each time a document is drawn; documents of a cut block keep their first words.

    ``_shard`` and ``_order`` come last: the rows of a shard lie together in one partition, locally shuffled.
    """
    plan = _plan(docs, spec)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _keyed(docs.select("doc_id", "source", F.xxhash64("text").alias("hash"), row), plan.targets, spec)
    rows = rows.select("src", "block", "order", "row").join(plan.drawn, ["src", "block"]).join(plan.cuts, ["src", "block", "order"], "left")
    n = F.regexp_count("row.text", F.lit(WORD))
    rows = rows.filter(F.when(F.col("part"), F.col("take") > 0).otherwise(n > 0))
    whole = F.regexp_extract(F.col("row.text"), r"^(?s:[\x20\x09-\x0D]*)", 0)
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1)), F.lit(1), F.col("take").cast("int")), "")
    text = F.when(F.col("part") & (F.col("take") < n), F.concat(whole, first)).otherwise(F.col("row.text"))
    columns = [(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return rows.select(*columns, F.col("shard").alias("_shard"), _local(F.col("pass"), spec).alias("_order")).repartition("_shard").sortWithinPartitions("_shard", "_order")
