"""Identity of outside works: citations that share a DOI or a title, directly or through others, are one work.

Keys (DOIs and titles) are nodes, works that have both are edges; works are connected components. Rounds of least neighbours, each followed by a jump along
the names found so far, are DataFrame joins and aggregates written to the shared folder, so no component is ever in one place; the number of rounds
follows the logarithm of the longest chain and is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.shared import saved

#: Rounds before the search for components is given up with an error; chains of more than 2 ** 30 works would be needed.
MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(key, component) for all keys of the links (a, b): the least key that links lead to."""
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    names = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("component")), "names")
    for _ in range(MOST_ROUNDS):
        near = both.join(names.select(F.col("key").alias("b"), "component"), "b").groupBy(F.col("a").alias("key")).agg(F.min("component").alias("near"))
        # A name's own name is taken over too, by those that had it: chains halve.
        told = names.join(near, "key").select("key", "component", F.least("component", "near").alias("next"))
        hooked = told.groupBy(F.col("component").alias("key")).agg(F.min("next").alias("hook"))
        told = told.join(hooked, "key", "left").select("key", "component", F.least("next", F.coalesce("hook", "next")).alias("next"))
        jump = told.select(F.col("key").alias("next"), F.col("next").alias("far"))
        new = saved(told.join(jump, "next", "left").select("key", F.col("component").alias("was"), F.least("next", F.coalesce("far", "next")).alias("component")), "names")
        names = new.select("key", "component")
        if not new.filter("was <> component").take(1):
            return names
    raise RuntimeError("components did not settle")


def chained(cited: DataFrame) -> bool:
    """Whether some work's identity runs through others: a title with several DOIs of which one has several titles, or the other way round."""
    pairs = cited.filter("d is not null").select("d", "t").distinct()
    many = lambda by, other: pairs.groupBy(by).agg(F.count_distinct(other).alias("n")).filter("n > 1").select(by)
    return bool(pairs.join(many("d", "t"), "d", "left_semi").join(many("t", "d"), "t", "left_semi").take(1))


def identified(cited: DataFrame, least: int) -> DataFrame:
    """Cited works (d, t and more) with ``name``: the least DOI of the work, else its title; null where the title is shorter than ``least``.

    Most libraries have no chains, and then the DOIs of a title, or the titles of a DOI, decide alone.
    """
    usable = cited.filter(F.length("t") >= least)
    if chained(usable):
        links = usable.filter("d is not null").select(F.concat(F.lit("d"), "d").alias("a"), F.concat(F.lit("t"), "t").alias("b")).distinct()
        # DOIs sort before titles, so a component with a DOI is named by one.
        names = components(links).filter("key like 't%'").select(F.expr("substring(key, 2)").alias("t"), F.expr("substring(component, 2)").alias("named"))
    else:
        names = usable.groupBy("t").agg(F.min("d").alias("named"))
    out = cited.join(names, "t", "left")
    return out.withColumn("name", F.when(F.length("t") >= least, F.coalesce("named", "t"))).drop("named")


def displayed(references: DataFrame, works: DataFrame) -> DataFrame:
    """(name, display, doi, papers): each outside work with the title that the first paper gives it, its least DOI and the number of papers that cite it.

    references: paper_id, doi, title; works: doi, title, d, name.
    """
    r, w = references.filter("title is not null and title <> ''"), works.filter("name is not null").alias("w")
    of_work = F.col("r.doi").eqNullSafe(F.col("w.doi")) & (F.col("r.title") == F.col("w.title"))
    # Titles and DOIs are looked at by work, of which there are few; only names and papers are moved by reference.
    first = F.when(F.count(F.lit(1)) == F.count("paper_id"), F.min("paper_id")).alias("first")
    shown = r.groupBy("doi", "title").agg(first).alias("r").join(w, of_work).select("name", "first", F.col("r.title").alias("title"), "d")
    shown = shown.groupBy("name").agg(F.min_by("title", F.struct("first", "title")).alias("display"), F.min("d").alias("doi"))
    counts = r.alias("r").join(w, of_work).groupBy("name").agg(F.count_distinct("paper_id").alias("papers"))
    return shown.join(counts, "name").select("name", "display", "doi", "papers")
