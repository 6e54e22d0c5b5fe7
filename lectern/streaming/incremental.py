"""Incremental upkeep of derived tables with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.coupling import analyzed, touched
from lectern.operators.graph import added
from lectern.operators.graph import edges as built
from lectern.operators.retrieval import TEXT_COLUMNS, lengths, postings
from lectern.plans.shared import saved
from lectern.plans.store import VersionedTable


def keep_postings(papers: DataFrame, index: VersionedTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert the inverted index (keyed by paper_id) for each micro-batch of a stream of papers; a batch writes its own papers' postings only."""
    columns = tuple(c for c in TEXT_COLUMNS if c in papers.columns)

    def put(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates(["paper_id"])
        index.put(postings(batch, columns), batch.select("paper_id"))

    writer = papers.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def checked_postings(papers: DataFrame, index: VersionedTable) -> int:
    """Rebuild the index if papers are missing in it; returns the number of papers that it then holds."""
    if not index.versions() or lengths(papers).join(index.read().select("paper_id").distinct(), "paper_id", "left_anti").filter("length > 0").take(1):
        index.replace(postings(papers))
    return index.read().select("paper_id").distinct().count()


def keep_graph(papers: DataFrame, edges: VersionedTable, library: Callable[[], tuple[DataFrame, DataFrame]], checkpoint: str) -> StreamingQuery:
    """Add each micro-batch of papers to the graph's edges, whose key is the whole edge; ``library`` gives all papers and references by then.

    A batch writes the edges that it adds and the keys of those that it ends (works that have become papers, say); the rest stays where it is.
    """

    def put(batch: DataFrame, _: int) -> None:
        everything, references = library()
        if not edges.versions():
            edges.replace(built(everything, references))
            return
        old = edges.read()
        new = saved(added(old, batch.dropDuplicates(["paper_id"]), everything, references), "edges")
        edges.put(new.join(old, edges.key, "left_anti"), old.join(new, edges.key, "left_anti").select(*edges.key))

    return papers.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_coupling(papers: DataFrame, matches: VersionedTable, library: Callable[[], DataFrame], checkpoint: str) -> StreamingQuery:
    """Add the matches of each micro-batch of papers, keyed by pair and title; ``library`` gives the references of all papers by then.

    Only references to works that the batch cites are joined, and only matches that aren't there yet are written.
    """

    def put(batch: DataFrame, _: int) -> None:
        new = batch.select("paper_id").distinct()
        matches.insert_ignore(analyzed(saved(touched(library(), new), "touched"), new))

    return papers.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_new(files: DataFrame, store: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Add files (sha256 and any columns) that the store doesn't hold yet; a second pass adds nothing."""

    def put(batch: DataFrame, _: int) -> None:
        store.insert_ignore(batch)

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
