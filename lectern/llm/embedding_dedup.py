"""Exact near-duplicate vectors by a metric range join over pivot cells.

Vectors are compared when their labels are equal. On the unit sphere, a cosine of at least t is a Euclidean distance of
at most r = sqrt(2 - 2 t). Each label has pivots; a vector's home is its nearest pivot's cell. By the triangle
inequality, whatever lies within r of a vector of cell i is at most 2 r further from pivot i than from its own
pivot (and, in Euclidean space, at most r beyond the plane between both); vectors for which that holds are
replicated to cell i, if it comes before their own: so a pair is met in the first of its two cells. A cell is joined as a
grid of blocks of bounded size, whatever it holds. A block returns link counts per vector and a spanning forest of its
links, not the pairs.

Within a block, a bound from a few leading components decides nearly all pairs: a cosine is at most the leading parts' product and
that of the lengths of the rest (Cauchy-Schwarz). Only pairs above it get their cosine in double precision.

Identical vectors of a label are one class with a count, so a very common vector is one row.

Cases: vectors that are null, zero, or hold null or non-finite components, and those with a null label, link with
nothing and are their own component; rows of one vec_id with different vectors are counted apart; vectors of different lengths aren't compared; repeated rows are copies of each
other, each with its own output row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, lean_group
from .graph import components


@dataclass(frozen=True)
class VectorSpec:
    cosine: float = 0.93
    #: Vectors for each pivot, about: one at least, and so many of a label where it has them. Pivots of all labels are broadcast, so
    #: beyond max_pivots each stands for more vectors, and cells, which are joined in blocks, grow.
    per_pivot: int = 16_384
    least_pivots: int = 4
    max_pivots: int = 2048
    #: Vectors on one side of a block; a vector is moved once for each block that it meets. Rows of a block that are bounded together, and that are compared
    #: in full together where the bound decides too little.
    block: int = 16_384
    bounded_rows: int = 512
    full_rows: int = 64
    #: Share of leading components in the bound.
    leading: float = 0.375
    #: Squared distance of two pivots, at least; far above rounding, so that the plane between them is well defined.
    apart: float = 1e-6


def _unit(vectors: pd.Series) -> np.ndarray:
    a = np.stack([np.asarray(v, np.float64) for v in vectors])
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the links (a, b): each node with its component's least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return nodes, nodes[label]


def _bounding(unit: np.ndarray, leading: int) -> np.ndarray:
    """Rows whose products are at least the unit vectors' cosines, up to float's rounding: leading components, and the length of the rest."""
    head = unit[:, :leading]
    return np.column_stack([head, np.sqrt(np.maximum(0, 1 - (head**2).sum(axis=1)))]).astype(np.float32)


def linked_pairs(a: np.ndarray, b: np.ndarray, spec: VectorSpec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all rows of a and b with enough cosine in double precision, a bounded number at a time."""
    la, lb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    leading = max(1, int(a.shape[1] * spec.leading))
    x, y = _bounding(a / la[:, None], leading), _bounding(b / lb[:, None], leading).T
    # Sums of so many floats of at most 1 together, with their own rounding, are off by far less.
    least = np.float32(spec.cosine - 1e-6 * (leading + 16))
    for s in range(0, len(a), spec.bounded_rows):
        high = x[s : s + spec.bounded_rows] @ y >= least
        if np.count_nonzero(high) > high.size // 64:
            for k in range(s, min(s + spec.bounded_rows, len(a)), spec.full_rows):
                e = min(k + spec.full_rows, s + spec.bounded_rows)
                i, j = np.nonzero(a[k:e] @ b.T / np.outer(la[k:e], lb) >= spec.cosine)
                yield i + k, j
            continue
        i, j = np.divmod(np.flatnonzero(high), high.shape[1])
        for k in range(0, len(i), 50_000):
            p, q = i[k : k + 50_000] + s, j[k : k + 50_000]
            near = np.einsum("ij,ij->i", a[p], b[q]) / (la[p] * lb[q]) >= spec.cosine
            yield p[near], q[near]


def _apart(p: np.ndarray, least: float) -> np.ndarray:
    """The pivots without those that point the same way as one before them (scaled copies, say)."""
    close, kept = 2 - 2 * p @ p.T <= least, np.ones(len(p), bool)
    for i in range(len(p)):
        kept[i] = not (close[i, :i] & kept[:i]).any()
    return p[kept]


def _cells(classes: DataFrame, spec: VectorSpec) -> DataFrame:
    """Vectors with their home's cell and the cells before it that they are replicated to."""
    spark = classes.sparkSession
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
    total, kinds = sizes.agg(F.sum("size"), F.count(F.lit(1))).first()
    share = min(1.0 / spec.per_pivot, spec.max_pivots / 2 / max(1, total or 0))
    # A few of each label first, as far as max_pivots goes, then a share of all vectors.
    few = F.least(F.lit(1.0), F.greatest(F.lit(share), F.lit(min(spec.least_pivots, spec.max_pivots / 2 / max(1, kinds))) * 2 / F.col("size")))
    draw = F.pmod(F.xxhash64("node", "label", "dim"), F.lit(1 << 30)) / float(1 << 30)
    picked = classes.join(sizes, ["label", "dim"]).filter(draw < few).orderBy(draw).limit(spec.max_pivots)
    pivots: dict[tuple, np.ndarray] = {}
    for key, group in picked.select("label", "dim", "embedding").toPandas().groupby(["label", "dim"]):  # max_pivots at most
        pivots[key] = _apart(_unit(group["embedding"]), spec.apart)
    shared, reach = spark.sparkContext.broadcast(pivots), float(np.sqrt(2 - 2 * spec.cosine)) + 1e-6

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, group in batch.groupby(["label", "dim"]):
                p = shared.value.get(key)
                if p is None or len(p) < 2:
                    yield group.assign(home=0, cells=[[]] * len(group))
                    continue
                d = np.sqrt(np.maximum(0, 2 - 2 * _unit(group["embedding"]) @ p.T))
                home, own = d.argmin(axis=1), d.min(axis=1)[:, None]
                between = np.sqrt(np.maximum(spec.apart, 2 - 2 * p @ p.T))[home]  # less only from a pivot to itself
                near = (d - own <= 2 * reach) & ((d**2 - own**2) / (2 * between) <= reach)
                near &= np.arange(len(p)) < home[:, None]
                yield group.assign(home=home, cells=[np.flatnonzero(c) for c in near])

    kind = classes.schema["embedding"].dataType.simpleString()
    schema = f"label string, dim int, node bigint, copies bigint, embedding {kind}, home bigint, cells array<bigint>"
    return classes.select("label", "dim", "node", "copies", "embedding").mapInPandas(lean(assign), schema)


def _in_cells(vectors: DataFrame) -> DataFrame:
    """A row for each cell of a vector, with whether it is its home."""
    cell = F.explode(F.array_append("cells", F.col("home")))
    return vectors.withColumn("cell", cell).withColumn("home", F.col("home") == F.col("cell")).drop("cells")


def _blocks(vectors: DataFrame, spec: VectorSpec) -> DataFrame:
    """Each cell's home vectors by rows and all its vectors by columns of a grid of blocks."""
    key, cells = ["label", "dim", "cell"], _in_cells(vectors)
    size = cells.groupBy(*key).agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count(F.lit(1)).alias("all"))
    grid = size.select(*key, *(F.ceil(F.col(c) / spec.block).cast("int").alias(n) for c, n in (("homes", "rows"), ("all", "cols")))).filter("rows > 0")
    cells = cells.join(grid, key)
    spread = F.xxhash64("node")
    sides = [
        cells.filter("home").withColumn("row", F.pmod(spread, F.col("rows"))).withColumn("col", F.explode(F.expr("sequence(0L, cols - 1L)"))).withColumn("left", F.lit(True)),
        cells.withColumn("col", F.pmod(spread, F.col("cols"))).withColumn("row", F.explode(F.expr("sequence(0L, rows - 1L)"))).withColumn("left", F.lit(False)),
    ]
    columns = [*key, "row", "col", "left", "home", "node", "copies", "embedding"]
    return sides[0].select(*columns).unionByName(sides[1].select(*columns))


def cells_per_vector(vectors: DataFrame, spec: VectorSpec = VectorSpec()) -> DataFrame:
    """(label, vectors, cells, mean_cells): how many cells a label's vectors are in, of how many: near 1 where vectors are clustered, near all where they aren't."""
    classes = _classes(vectors.select("vec_id", "label", "embedding"))[2]
    cells = _in_cells(_cells(classes, spec)).groupBy("label").agg(F.count_distinct("node").alias("vectors"), F.count_distinct("cell").alias("cells"), F.count(F.lit(1)).alias("n"))
    return cells.select("label", "vectors", "cells", (F.col("n") / F.col("vectors")).alias("mean_cells"))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with whether they can link, those that can, and the classes of equal vectors among these."""
    fine = "label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as double)) and exists(embedding, x -> x <> 0)"
    # Floats stay floats, which is less to move; everything else is compared as doubles. A label may be of any type.
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("fine", F.coalesce(F.expr(fine), F.lit(False)) & F.col("vec_id").isNotNull())
    # -0.0 and 0.0 are one value here, as in a cosine.
    good = rows.filter("fine").withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)))
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("embedding"))
    # A number of its own for each class: rows of one vec_id with different vectors are different nodes.
    return rows, good, classes.withColumn("node", F.monotonically_increasing_id())


def near_duplicates(vectors: DataFrame, spec: VectorSpec = VectorSpec()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    # Written once: what makes the vectors may be long, and they are read several times.
    rows, good, classes = _classes(scratch.save(vectors.select("vec_id", "label", "embedding"), "given"))
    classes = scratch.save(classes, "classes")
    blocks = _blocks(scratch.save(_cells(classes, spec), "cells"), spec)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["left"]], group[~group["left"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "other": [], "n": []}).astype("int64")
        (x, y), (cx, cy) = (tuple(side[c].to_numpy(np.int64) for side in (left, right)) for c in ("node", "copies"))
        a, b = (np.stack([np.asarray(v, np.float64) for v in side["embedding"]]) for side in (left, right))
        # Vectors that are both at home here meet twice; one of the meetings counts.
        once, nx, ny = right["home"].to_numpy(bool), np.zeros(len(x)), np.zeros(len(y))
        stars, held = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
        for i, j in linked_pairs(a, b, spec):
            keep = (x[i] < y[j]) | (~once[j] & (x[i] != y[j]))
            i, j = i[keep], j[keep]
            nx += np.bincount(i, weights=cy[j], minlength=len(x))
            ny += np.bincount(j, weights=cx[i], minlength=len(y))
            stars.append(forest(x[i], y[j]))
            held += len(stars[-1][0])
            if held > 1_000_000:
                stars, held = [forest(*(np.concatenate(s) for s in zip(*stars, strict=True)))], 0
        u, v = forest(*(np.concatenate(s) for s in zip(*stars, strict=True)))
        nodes = np.concatenate([x, y, u])
        out = pd.DataFrame({"node": nodes, "other": np.concatenate([x, y, v]), "n": np.concatenate([nx, ny, np.zeros(len(u))])})
        return out.astype("int64").query("n > 0 or node != other")

    found = scratch.save(blocks.groupBy("label", "dim", "cell", "row", "col").applyInPandas(lean_group(join), "node bigint, other bigint, n bigint"), "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = components(found.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    named = classes.select("node", "least").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tops = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.save(named.join(tops, "component").select("node", "component_id"), "named")
    classes = classes.join(counts, "node", "left").join(named, "node")
    classes = classes.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    good = good.join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    scratch.keep("given", "classes", "found", "named")
    lone = rows.filter("not fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def with_noisy_copies(vectors: DataFrame, copies: int = 4, step: float = 0.3) -> DataFrame:
    """The vectors and copies of each, of which the later ones are further off: the k-th adds noise of up to k * step times the vector's mean magnitude."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size("v")
    # Before the copies are made: a mean that is a column of the same step as the noise would be taken anew for each component.
    rows = rows.withColumn("mean", mean).select("*", F.explode(F.sequence(F.lit(0), F.lit(copies))).alias("k"))
    noise = lambda i: F.pmod(F.col("vec_id") * 7919 + F.col("k") * 104_729 + i * 15_485_863 + F.col("k") * i * 611_953, F.lit(2001)) / 1000.0 - 1.0
    noisy = F.transform("v", lambda x, i: x + noise(i.cast("bigint")) * F.col("k") * step * F.col("mean"))
    rows = rows.withColumn("embedding", noisy)
    return rows.select((F.col("vec_id") * (copies + 1) + F.col("k")).alias("vec_id"), "label", "embedding")
