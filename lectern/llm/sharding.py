"""Size-tiered compaction of immutable shards under a versioned manifest.

An append writes the rows of its arrivals where they are read, without a shuffle; an arrival's rows are a small shard, and the
manifest names the files that hold it. Compaction groups live shards by tier (the power of two of their size), cuts each
tier, in order of arrival, into runs of about the target size, and rewrites each run of two shards or more as one shard in
one file. Old files stay for readers of old versions until :meth:`ShardStore.vacuum`.

A version is a log entry that names its manifest. It is written under a temporary name and then renamed, never over another,
so readers see the old version or the new one, whole, and of two writers one fails; a writer that dies leaves nothing that counts.

Everything is DataFrame code. Sizes are summed before any window, and running sums take two steps, so no window spans
a whole tier. The driver holds the names of live files, as Spark's own listing of a table does.

Cases: null text has no bytes; rows without a doc_id make arrivals by a hash of their text; repeated rows stay; very long texts are
rows like others; empty tables give a store without shards; all columns are kept, in a struct, so none can clash with the store's own;
later appends may bring further columns, which older rows lack.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, filesystem

LISTED = "shard string, batch string, seq bigint, n_rows bigint, n_bytes bigint, tier int, files array<string>"
#: Shards whose manifest rows are broadcast to a read; more are joined by a shuffle.
FEW_SHARDS = 100_000
#: Arrivals of rows without a doc_id lie below this.
UNNAMED = -(10**12)


@dataclass(frozen=True)
class ShardSpec:
    arrival_rows: int = 64
    #: Tier 0 holds shards below this size; each next tier doubles it.
    min_bytes: int = 64 * 1024
    target_bytes: int = 64 * 1024 * 1024


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


def arrival_of(spec: ShardSpec) -> Column:
    """The arrival of a document whose ids are given out in order."""
    n = spec.arrival_rows
    unnamed = F.lit(UNNAMED) - F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 4), 16, 10).cast("bigint")
    return F.when(F.col("doc_id").isNull(), unnamed).otherwise(F.expr(f"(doc_id - pmod(doc_id, {n})) div {n}"))


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, spec: ShardSpec = ShardSpec()):
        self.spark, self.root, self.spec = spark, root, spec

    def versions(self) -> list[int]:
        fs, log = filesystem(self.spark, f"{self.root}/log")
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        return sorted(int(n) for n in names if n.isdigit())  # others are entries on their way

    def version(self) -> int:
        """The latest version, 0 before the first commit."""
        return (self.versions() or [0])[-1]

    def _entry(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/log/{version:012d}", wholetext=True).first()[0])

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version: shard, batch, seq, n_rows, n_bytes, tier, files."""
        return self.spark.read.schema(LISTED).parquet(f"{self.root}/{self._entry(version or self.version())['manifest']}")

    def _commit(self, manifest: DataFrame, parent: int, schema: str) -> int:
        name = f"manifest/{uuid.uuid4().hex}"
        manifest.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        fs, entry = filesystem(self.spark, f"{self.root}/log/{parent + 1:012d}")
        _, draft = filesystem(self.spark, f"{self.root}/log/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"manifest": name, "parent": parent, "schema": schema}).encode()))
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = gateway.new_array(kind, 1)
        never_over[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(entry.toUri() if entry.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, entry, never_over)
        except Exception as e:
            fs.delete(draft, False)
            raise CommitConflict(f"version {parent + 1} exists") from e
        return parent + 1

    def _schema(self, parent: int, row: StructType | None = None) -> StructType:
        """The row columns of a version, and those that an append adds."""
        known = StructType.fromJson(json.loads(self._entry(parent)["schema"])) if parent else StructType()
        return known if row is None else StructType([*known.fields, *(f for f in row.fields if f.name not in known.names)])

    def _stored(self, schema: StructType) -> StructType:
        return StructType.fromDDL("n_bytes bigint, seq bigint, shard string, batch string").add("row", schema)

    def _listed(self, batch: str) -> DataFrame:
        """Manifest rows of the shards that a batch has written."""
        written = self.spark.read.schema("n_bytes bigint, seq bigint, shard string").parquet(f"{self.root}/data/{batch}")
        sizes = written.select("*", F.col("_metadata.file_name").alias("file")).groupBy("shard").agg(
            F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.collect_set("file").alias("files")
        )
        tier = F.length(F.bin((F.col("n_bytes") - F.col("n_bytes") % self.spec.min_bytes) / self.spec.min_bytes)) - F.when(F.col("n_bytes") < self.spec.min_bytes, 1).otherwise(0)
        return sizes.select("shard", F.lit(batch).alias("batch"), "seq", "n_rows", "n_bytes", tier.cast("int").alias("tier"), "files")

    def append(self, docs: DataFrame, arrival: Column | None = None) -> int:
        """Write the rows of arrivals where they are read, as small shards, and commit."""
        parent, batch = self.version(), uuid.uuid4().hex
        seq = (arrival_of(self.spec) if arrival is None else arrival).cast("bigint")
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
        rows = docs.select(size.alias("n_bytes"), seq.alias("seq"), F.concat(F.lit("a"), seq.cast("string")).alias("shard"), F.lit(batch).alias("batch"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{batch}")
        added = self._listed(batch)
        schema = json.dumps(self._schema(parent, docs.schema).jsonValue())
        return self._commit(added if not parent else self.manifest(parent).unionByName(added), parent, schema)

    def plan(self, version: int | None = None) -> DataFrame:
        """The manifest with the run that each live shard is merged into (a number from 0, and the run's first arrival); null for those that stay."""
        live = self.manifest(version)
        small = live.filter(F.col("n_bytes") < self.spec.target_bytes / 2).withColumn("chunk", F.expr("(seq - pmod(seq, 4096)) div 4096"))
        step = Window.partitionBy("tier").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        chunks = small.groupBy("tier", "chunk").agg(F.sum("n_bytes").alias("w")).select("tier", "chunk", F.coalesce(F.sum("w").over(step), F.lit(0)).alias("w0"))
        inner = Window.partitionBy("tier", "chunk").orderBy("seq", "shard").rowsBetween(Window.unboundedPreceding, -1)
        small = small.withColumn("w1", F.coalesce(F.sum("n_bytes").over(inner), F.lit(0))).join(chunks, ["tier", "chunk"])
        small = small.withColumn("run", F.expr(f"(w0 + w1) div {self.spec.target_bytes}"))
        runs = small.groupBy("tier", "run").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("into")).filter("n > 1")
        runs = runs.withColumn("number", F.row_number().over(Window.orderBy("tier", "run")) - 1)  # a row for each shard of the target size
        into = small.join(runs, ["tier", "run"]).select("shard", "batch", "into", "number")
        return live.join(into, ["shard", "batch"], "left")

    def compact(self) -> int:
        """Merge runs of similarly sized shards and commit; returns the version, unchanged if nothing is to merge."""
        parent, batch = self.version(), uuid.uuid4().hex
        scratch = Scratch(self.spark, "shards")
        plan = scratch.save(self.plan(parent), "plan")
        n = plan.agg(F.max("number")).first()[0]
        if n is None:
            scratch.drop()
            return parent
        schema = self._schema(parent)
        merged = plan.filter("number is not null")
        rows = self._rows(merged.drop("seq", "n_bytes"), schema).select("n_bytes", "seq", F.concat(F.lit("m"), F.col("into").cast("string")).alias("shard"), F.lit(batch).alias("batch"), "row", "number")
        rows.repartitionById(n + 1, F.col("number").cast("int")).drop("number").write.option("compression", "zstd").parquet(f"{self.root}/data/{batch}")  # a file for each merged shard
        version = self._commit(plan.filter("number is null").drop("into", "number").unionByName(self._listed(batch)), parent, json.dumps(schema.jsonValue()))
        scratch.drop()
        return version

    def settle(self) -> int:
        """Compact until nothing is left to merge."""
        version = self.version()
        while (after := self.compact()) != version:
            version = after
        return version

    def _rows(self, shards: DataFrame, schema: StructType) -> DataFrame:
        """The rows of listed shards, with the shards' manifest columns; only files that hold such shards are opened."""
        files = [f"{self.root}/data/{r.batch}/{r.file}" for r in shards.select("batch", F.explode("files").alias("file")).distinct().collect()]
        if not files:
            return self.spark.createDataFrame([], self._stored(schema)).join(shards.drop("n_rows", "files"), ["shard", "batch"])
        listed = shards.drop("n_rows", "files")
        listed = F.broadcast(listed) if shards.count() <= FEW_SHARDS else listed
        return self.spark.read.schema(self._stored(schema)).parquet(*files).join(listed, ["shard", "batch"])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version: their columns in ``row``, with shard, seq (the arrival), n_bytes and tier."""
        version = version or self.version()
        return self._rows(self.manifest(version).drop("n_bytes", "seq"), self._schema(version))

    def vacuum(self, keep: int = 2, min_age: float = 24 * 3600.0) -> int:
        """Delete batches that none of the last ``keep`` versions lists and that are older than ``min_age`` seconds; returns how many.

        The age spares what another writer has written and not yet committed, and readers of versions that are older still.
        """
        live = {r.batch for v in self.versions()[-keep:] for r in self.manifest(v).select("batch").distinct().collect()}
        fs, data = filesystem(self.spark, f"{self.root}/data")
        dead = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in live and time.time() - s.getModificationTime() / 1000 >= min_age]
        return sum(bool(fs.delete(p, True)) for p in dead)


def compacted(docs: DataFrame, spec: ShardSpec = ShardSpec(), commits: int = 3) -> DataFrame:
    """(doc_id, n_bytes, arrival, tier, shard): each document's arrival, its shard after several appends and compactions (named by its first arrival), and that shard's tier."""
    spark, n = docs.sparkSession, spec.arrival_rows
    store = ShardStore(spark, Scratch(spark, "store").root, spec)
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    lo, hi = (0, 1) if lo is None else (lo // n, hi // n + 1)
    ends = [n * (lo - (-k * (hi - lo)) // commits) for k in range(commits + 1)]
    for k in range(commits):
        part = (F.col("doc_id") >= ends[k]) & (F.col("doc_id") < ends[k + 1])
        store.append(docs.filter(part if k else part | F.col("doc_id").isNull()))
        store.settle()
        store.vacuum(keep=1, min_age=0)  # nobody else reads or writes this store
    return store.read().select("row.doc_id", "n_bytes", F.col("seq").alias("arrival"), "tier", F.substring("shard", 2, 20).cast("bigint").alias("shard"))
