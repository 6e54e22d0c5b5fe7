"""A versioned table: every change is a small layer over those before it, and layers are folded into one from time to time.

A layer holds new rows and the keys that it replaces or removes; a read takes each key from the last layer that names it. Changes
are DataFrame plans over the rows they concern, never rows on the driver, so a small change costs what it changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layers over a base, at most, before they are folded.
MAX_LAYERS = 8


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, key: list[str]):
        self.spark, self.root, self.key = spark, root, key

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _kinds(self) -> dict[int, str]:
        """Versions that are complete, and whether each is a base or a delta."""
        fs, root = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        found = {}
        for n in names:
            for kind in ("base", "delta"):
                if n.startswith("v") and fs.exists(self._fs(f"{self.root}/{n}/{kind}.done")[1]):
                    found[int(n[1:])] = kind
        return dict(sorted(found.items()))

    def versions(self) -> list[int]:
        return list(self._kinds())

    def _put(self, rows: DataFrame, gone: DataFrame | None) -> int:
        """Write a layer; it counts once its marker is there."""
        version = (self.versions() or [0])[-1] + 1
        rows.write.mode("error").parquet(f"{self.root}/v{version}/rows")
        if gone is not None:
            gone.select(*self.key).distinct().write.mode("error").parquet(f"{self.root}/v{version}/gone")
        fs, marker = self._fs(f"{self.root}/v{version}/{'base' if gone is None else 'delta'}.done")
        fs.create(marker, False).close()
        return version

    def read(self, version: int | None = None) -> DataFrame:
        kinds = {v: k for v, k in self._kinds().items() if version is None or v <= version}
        base = max(v for v, k in kinds.items() if k == "base")
        layers = [v for v in kinds if v >= base]
        rows = gone = None
        for v in layers:
            part = self.spark.read.parquet(f"{self.root}/v{v}/rows").withColumn("_layer", F.lit(v))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
            if v > base:
                keys = self.spark.read.parquet(f"{self.root}/v{v}/gone").withColumn("_gone", F.lit(v))
                gone = keys if gone is None else gone.unionByName(keys)
        if gone is None:
            return rows.drop("_layer")
        last = gone.groupBy(*self.key).agg(F.max("_gone").alias("_gone"))
        return rows.join(last, self.key, "left").filter("_gone is null or _layer >= _gone").select(*(c for c in rows.columns if c != "_layer"))

    def replace(self, df: DataFrame) -> int:
        """Write a new base."""
        return self._put(df, None)

    def fold(self) -> int:
        """Make one base of the layers."""
        return self.replace(self.read())

    def put(self, rows: DataFrame, keys: DataFrame) -> int:
        """Put rows in place of all with the given keys; rows may share a key."""
        if not self.versions():
            return self.replace(rows)
        version = self._put(rows, keys)
        kinds = self._kinds()
        return self.fold() if version - max(v for v, k in kinds.items() if k == "base") > MAX_LAYERS else version

    def insert_ignore(self, rows: DataFrame) -> int:
        """Add rows whose key isn't there; returns the true number of new rows."""
        rows = rows.dropDuplicates(self.key)
        if not self.versions():
            version = self.replace(rows)
        else:
            fresh = rows.join(self.read().select(*self.key), self.key, "left_anti").select(*rows.columns)
            version = self._put(fresh, fresh.limit(0))
        return self.spark.read.parquet(f"{self.root}/v{version}/rows").count()

    def upsert(self, rows: DataFrame) -> int:
        """Put rows in place of those with their keys."""
        rows = rows.dropDuplicates(self.key)
        return self.put(rows, rows)

    def delete(self, keys: DataFrame) -> int:
        """Remove the rows that match in the columns given, be they the key or others."""
        gone = keys if set(keys.columns) == set(self.key) else self.read().join(keys.distinct(), keys.columns, "left_semi")
        return self.put(self.read().limit(0), gone)

    def update(self, changes: DataFrame, columns: list[str], keep: bool = True) -> int:
        """Set columns of the rows that changes names; where it has null, the old value stays, or goes if not ``keep``."""
        new = changes.select(*self.key, *[F.col(c).alias(f"_{c}") for c in columns])
        old = self.read()
        changed = old.join(new, self.key).select(*[(F.coalesce(f"_{c}", c) if keep else F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in old.columns])
        return self.put(changed, changes)


def cascade(parent_ids: DataFrame, children: dict[str, VersionedTable], column: str = "paper_id") -> None:
    """Delete the rows of parents that are gone from every child table."""
    for table in children.values():
        table.delete(parent_ids.select(column))


def replace_children(table: VersionedTable, rows: DataFrame, column: str) -> int:
    """Put a parent's rows (chunks of sections, say) in place of all that it had."""
    parents = rows.select(column).distinct()
    return table.put(rows, table.read().join(parents, column, "left_semi").select(*table.key).unionByName(rows.select(*table.key)))


def backfill(table: VersionedTable, column: str, value, missing_only: bool = True, dry_run: bool = False) -> int:
    """Set a column from an expression over the row where it is null (or everywhere it differs); returns how many rows that concerns."""
    rows = table.read()
    wanted = rows.filter(F.col(column).isNull() if missing_only else ~F.col(column).eqNullSafe(value)).withColumn(column, value)
    if dry_run:
        return wanted.count()
    version = table.upsert(wanted)
    return table.spark.read.parquet(f"{table.root}/v{version}/rows").count()


def differences(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, before, after): what a second extraction would change."""
    both = old.alias("o").join(new.alias("n"), key)
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"o.{c}").cast("string").alias("before"), F.col(f"n.{c}").cast("string").alias("after")) for c in columns))
    return both.select(key, F.inline(pairs)).filter("not (before <=> after)")
