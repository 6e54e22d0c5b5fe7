"""Ingest in steps that fail softly: each step of each row has its own outcome, and one that fails leaves the results of the others.

Steps are functions of a row (a model's embedding, an analysis, an archive page); they run in Arrow batches inside Spark's tasks, in their order. A row keeps its results by the hash of its
content, so a second pass runs only what is missing, or everything if forced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.plans.store import VersionedTable

#: Characters of a failure that a warning keeps.
MESSAGE = 500


@dataclass(frozen=True)
class Step:
    """A named function of a row (its columns, and the results of the steps it needs), with the Spark type of its result, which must not be null."""

    name: str
    run: Callable[[dict], object]
    kind: str
    needs: tuple[str, ...] = ()


def run_steps(rows: DataFrame, steps: list[Step]) -> DataFrame:
    """Rows with a column for each step and ``warnings``.

    A step whose column is there and not null has been done and isn't run again; one that needs a result that isn't there is left out, without a warning of its own; one
    that fails gives null and the warning ``<step> failed: <message>``. Results are as good as the functions; rows never fail.
    """
    missing = [s for s in steps if s.name not in rows.columns]
    full = rows.drop("warnings").select("*", *(F.lit(None).cast(s.kind).alias(s.name) for s in missing))
    names = full.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for values in batch.itertuples(index=False, name=None):
                row, warnings = dict(zip(names, values, strict=True)), []
                has = lambda name, row=row: isinstance(row[name], (list, dict)) or hasattr(row[name], "__len__") or not pd.isna(row[name])
                for step in steps:
                    if has(step.name) or not all(has(n) for n in step.needs):
                        continue
                    try:
                        row[step.name] = step.run(dict(row))
                    except Exception as e:  # whatever a step raises is its own outcome
                        warnings.append(f"{step.name} failed: {e}"[:MESSAGE])
                out.append((*(row[n] for n in names), warnings))
            yield pd.DataFrame(out, columns=[*names, "warnings"]).astype({n: object for n in names})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema.fields)
    return full.mapInPandas(run, f"{schema}, warnings array<string>")


def outcomes(done: DataFrame, steps: list[Step]) -> DataFrame:
    """(step, done, failed, left_out): how many rows each step has a result for, failed on, or wasn't run on."""
    failed = lambda s: F.exists("warnings", lambda w: w.startswith(f"{s.name} failed: "))
    each = F.array(*(F.struct(F.lit(s.name).alias("step"), F.when(F.col(s.name).isNotNull(), "done").when(failed(s), "failed").otherwise("left_out").alias("outcome")) for s in steps))
    rows = done.select(F.explode(each).alias("o")).groupBy("o.step")
    return rows.agg(*(F.count(F.when(F.col("o.outcome") == k, 1)).alias(k) for k in ("done", "failed", "left_out")))


def keep_ingested(files: DataFrame, store: VersionedTable, steps: list[Step], checkpoint: str, force: bool = False) -> StreamingQuery:
    """Run the steps on each micro-batch of files (sha256 and any columns) and store rows with their results, keyed by sha256.

    Content that is stored with all results is skipped; of other stored content only the steps without a result run; with ``force`` all run anew.
    """

    def put(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["sha256"])
        if store.versions() and not force:
            known = store.read().select("sha256", *(s.name for s in steps))
            whole = known.filter(" and ".join(f"`{s.name}` is not null" for s in steps)).select("sha256")
            new = new.join(whole, "sha256", "left_anti").join(known, "sha256", "left")
        store.upsert(run_steps(new, steps))

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
