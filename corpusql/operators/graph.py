"""The citation graph: edges by DOI, related papers, breadth-first crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.functions.text import bare_doi
from corpusql.session import staged


def edges(discovery: DataFrame) -> DataFrame:
    """src, dst: distinct citations, from ``cites`` and, turned round, from ``cited_by``; no loops."""
    d = discovery.select(bare_doi("doi").alias("doi"), "cites", "cited_by").filter("doi IS NOT NULL")
    out = d.select(F.col("doi").alias("src"), F.explode("cites").alias("x")).select("src", bare_doi("x").alias("dst"))
    back = d.select(F.explode("cited_by").alias("x"), F.col("doi").alias("dst")).select(bare_doi("x").alias("src"), "dst")
    return out.unionByName(back).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def degrees(links: DataFrame) -> DataFrame:
    """doi, n_cites, n_cited_by."""
    end = lambda c, out, into: links.select(F.col(c).alias("doi"), F.lit(out).alias("o"), F.lit(into).alias("i"))
    return end("src", 1, 0).unionByName(end("dst", 0, 1)).groupBy("doi").agg(F.sum("o").alias("n_cites"), F.sum("i").alias("n_cited_by"))


def related(links: DataFrame, entries: DataFrame) -> DataFrame:
    """doi, direction, other: citations between papers that are both in the catalogue, from the side of either."""
    have = entries.select(bare_doi("doi").alias("doi")).filter("doi IS NOT NULL").distinct()
    inside = links.join(have.withColumnRenamed("doi", "src"), "src", "left_semi").join(have.withColumnRenamed("doi", "dst"), "dst", "left_semi")
    return inside.select(F.col("src").alias("doi"), F.lit("cites").alias("direction"), F.col("dst").alias("other")).unionByName(
        inside.select(F.col("dst").alias("doi"), F.lit("cited_by").alias("direction"), F.col("src").alias("other"))
    )


def crawl(links: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """doi, level: papers reached from the seeds along citations, each at its first level; seeds are level 0.

    A level is a join of the last one with the edges; what is known is anti-joined, and each level is staged.
    """
    links = staged(links, "edges")
    front = staged(seeds.select(F.col(seeds.columns[0]).alias("doi")).filter("doi IS NOT NULL").distinct().withColumn("level", F.lit(0)), "level0")
    known = front
    for level in range(1, depth + 1):
        step = links.join(front.select(F.col("doi").alias("src")), "src").select(F.col("dst").alias("doi")).distinct()
        front = staged(step.join(known.select("doi"), "doi", "left_anti").withColumn("level", F.lit(level)), f"level{level}")
        known = known.unionByName(front)
    return known


def to_backfill(entries: DataFrame, links: DataFrame) -> DataFrame:
    """id, doi of papers with a DOI and no citation in either direction."""
    ends = links.select(F.col("src").alias("d")).unionByName(links.select(F.col("dst").alias("d"))).distinct()
    return entries.filter("type = 'paper'").select("id", bare_doi("doi").alias("d")).filter("d IS NOT NULL").join(ends, "d", "left_anti").select("id", F.col("d").alias("doi"))
