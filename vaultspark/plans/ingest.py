"""The write path as plans over whole tables: from requests to slices, and from a linker's answers to updated entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.operators import cite, links
from vaultspark.sources import pages
from vaultspark.sources.classify import classify, to_fetch


def admit(requests: DataFrame, papers: DataFrame, cache: DataFrame) -> dict[str, DataFrame]:
    """Requests (req_id, input, force) by what becomes of them: errors, papers that exist already, and those to fetch, which are not in the cache."""
    c = requests.withColumn("c", classify(F.col("input"))).select("req_id", "input", "force", "c.*")
    errors = c.where("source_type = 'error'").select("req_id", "input")
    good = c.where("source_type <> 'error'")
    existing = cite.existing_papers(good, papers)
    fresh = good.join(existing.select("req_id"), "req_id", "left_anti")
    return {"errors": errors, "existing": existing, "fetch": to_fetch(fresh, cache)}


def slice_files(paged: DataFrame, html: DataFrame) -> DataFrame:
    """(sha, full_text, brief_text, findings_text, meta_text, page_count) of paged documents (sha, pages, toc) and HTML files (sha, path, content)."""
    names = ["sha", "full_text", "brief_text", "findings_text", "meta_text", "page_count"]
    web = pages.html_source(html.withColumn("path", F.col("sha"))).withColumnRenamed("path", "sha")
    return pages.with_slices(paged).select(names).unionByName(web.select(names))


def cache_slices(slices: DataFrame, table: str) -> None:
    """Append slices to the cache table, which is keyed by sha."""
    slices.write.mode("append").parquet(table)


@dataclass
class Applied:
    """What a linker's answers change: edges by level, their counts, and the entities that are written."""

    finding_edges: DataFrame
    paper_edges: DataFrame
    counts: DataFrame
    touched: DataFrame


def apply_edges(new: DataFrame, cites: DataFrame, new_paper: str, findings: DataFrame, papers: DataFrame, finding_edges: DataFrame, paper_edges: DataFrame) -> Applied:
    """Apply one payload to edge tables (src, etype, dst): forward edges, mirrors, the roll-up, its mirrors and the citations. A second time changes nothing.

    new: (src, etype, dst); cites: (slug). Counts are those of forward edges that were not there. The new paper's own edges need it to exist.
    """
    proposed = links.forward(new, findings)
    forward = links.forward(new, findings, finding_edges)
    mirrors = links.mirrored(proposed, findings)
    every = finding_edges.select("src", "etype", "dst").union(forward).union(mirrors).distinct()
    up = links.rollup(proposed, findings, new_paper)
    own = up.select("src", "etype", "dst").union(cites.select(F.lit(new_paper), F.lit("cites"), "slug"))
    there = papers.where(F.col("slug") == new_paper)
    own = own.join(there.select(F.col("slug").alias("src")), "src", "left_semi")
    back = links.paper_mirrored(up, papers)
    return Applied(
        every,
        paper_edges.select("src", "etype", "dst").union(own).union(back).distinct(),
        links.edge_counts(forward),
        links.touched(proposed, mirrors.join(finding_edges.select("src", "etype", "dst"), ["src", "etype", "dst"], "left_anti"), back.join(paper_edges.select("src", "etype", "dst"), ["src", "etype", "dst"], "left_anti"), there),
    )


def paper_findings(findings: DataFrame) -> DataFrame:
    """(slug, findings): each paper's findings, derived from where they come from instead of kept with the paper."""
    return findings.where("source_paper <> ''").groupBy(F.col("source_paper").alias("slug")).agg(F.array_sort(F.collect_set("slug")).alias("findings"))
