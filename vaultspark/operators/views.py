"""The standing views over papers and findings. Lists that the views show are sorted, so that a view is the same each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, RECENT = 4.0, 20


def all_papers(papers: DataFrame) -> DataFrame:
    return papers.select("slug", "publication_date", "ingested_date", "authors", F.col("quality.overall").alias("overall"), "ingest_mode").orderBy(F.desc("ingested_date"), "slug")


def stats_by_type(tables: list[DataFrame]) -> DataFrame:
    """(type, n) over tables with a type."""
    every = tables[0].select("type")
    for t in tables[1:]:
        every = every.unionByName(t.select("type"))
    return every.groupBy("type").agg(F.count("*").alias("n"))


def recent_papers(papers: DataFrame, n: int = RECENT) -> DataFrame:
    return papers.orderBy(F.desc("ingested_date"), "slug").limit(n).select("slug", "publication_date", "ingested_date", "authors", "fields", F.col("quality.overall").alias("overall"))


def grouped(papers: DataFrame, by: str, exploded: bool = False) -> DataFrame:
    """Papers by their whole list of authors or fields, or by each of its entries; groups with the latest ingest come first."""
    key = F.explode(by) if exploded else F.col(by)
    p = papers.select(key.alias("key"), "slug", "publication_date", "ingested_date", F.col("quality.overall").alias("overall"))
    rows = F.array_sort(F.collect_list(F.struct("slug", "publication_date", "overall")))
    g = p.groupBy("key").agg(F.max("ingested_date").alias("latest"), rows.alias("r"), F.count("*").alias("n"))
    return g.select("key", "n", "latest", F.col("r.slug").alias("papers"), F.col("r.publication_date").alias("published"), F.col("r.overall").alias("overall")).orderBy(F.desc("latest"), "key")


def contradicting(nodes: DataFrame, edges: DataFrame, extra: list[str]) -> DataFrame:
    """Nodes with a contradicts edge and its targets."""
    r = edges.where("etype = 'contradicts'").groupBy(F.col("src").alias("slug")).agg(F.array_sort(F.collect_set("dst")).alias("contradicts"))
    return nodes.join(r, "slug").where(F.size("contradicts") > 0).select("slug", *extra, "contradicts")


def high_credibility(papers: DataFrame, least: float = HIGH) -> DataFrame:
    q = papers.where(F.col("quality.overall") >= least)
    return q.select("slug", "publication_date", "authors", "quality.credibility", "quality.experimental_rigor", "quality.reproducibility", "quality.overall").orderBy(F.desc("overall"), "slug")


def papers_of(papers: DataFrame, listed: str, name: str | None = None) -> DataFrame:
    """(name, slug, publication_date, venue, credibility) of papers that list a name; of one name, or of all names at once."""
    hit = papers.where(F.array_contains(listed, name)).withColumn("name", F.lit(name)) if name else papers.withColumn("name", F.explode(F.array_distinct(listed)))
    return hit.select("name", "slug", "publication_date", "venue", F.col("quality.credibility").alias("credibility")).orderBy("name", F.desc("publication_date"), "slug")


def findings_of_field(findings: DataFrame, name: str | None = None) -> DataFrame:
    hit = findings.where(F.array_contains("fields", name)).withColumn("name", F.lit(name)) if name else findings.withColumn("name", F.explode(F.array_distinct("fields")))
    return hit.select("name", "slug", "source_paper", "hedging", "finding_type", "extracted_date").orderBy("name", F.desc("extracted_date"), "slug")


def findings_of_author(findings: DataFrame, papers: DataFrame, name: str | None = None) -> DataFrame:
    """(name, slug, source_paper, hedging, finding_type, extracted_date) of the findings of papers that list an author; of one, or of all at once."""
    by = papers_of(papers, "authors", name).select("name", F.col("slug").alias("source_paper"))
    return findings.join(by, "source_paper").select("name", "slug", "source_paper", "hedging", "finding_type", "extracted_date").orderBy("name", F.desc("extracted_date"), "slug")


def graph_nodes(files: DataFrame) -> DataFrame:
    """(path, group) of files that the graph shows: not views, not the index; grouped by folder."""
    group = F.lit("other")
    for folder in ("papers", "findings", "authors", "fields"):
        group = F.when(F.contains("path", F.lit(f"{folder}/")), folder).otherwise(group)
    return files.where(~F.contains("path", F.lit("views")) & ~F.contains("path", F.lit("index"))).select("path", group.alias("group"))


def keyword_search(rows: DataFrame, terms: list[str], k: int) -> DataFrame:
    """The k rows (key, text) that hold the most of the terms, letter case aside; ties by key."""
    low = F.lower("text")
    hits: Column = F.lit(0)
    for t in terms:
        hits = hits + F.contains(low, F.lit(t.lower())).cast("int")
    return rows.withColumn("n_terms", hits).where("n_terms > 0").orderBy(F.desc("n_terms"), "key").limit(k).select("key", "n_terms")
