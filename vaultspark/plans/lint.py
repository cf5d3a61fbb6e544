"""The integrity path: all checks over one snapshot, then, if asked, links between the duplicates found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions.text import normalize
from vaultspark.operators import checks, links, neardup
from vaultspark.schema import EDGE_TYPES, FOLDERS
from vaultspark.sources import vault

SECTIONS = ["schema drift", "orphan", "duplicate finding", "asymmetric edge", "stale link", "date sanity"]


@dataclass
class Lint:
    """issues: (check, entity, key, detail); report: (check, n, n_lines); added: the similar-to edges that link duplicates."""

    issues: DataFrame
    report: DataFrame
    added: DataFrame

    def failed(self) -> bool:
        """Whether there is any issue."""
        return not self.issues.isEmpty()


def lint(entities: dict[str, DataFrame], edges: DataFrame, mentions: DataFrame, new_slugs: list[str] | None = None, since: str | None = None, link_similar: bool = True, linked: DataFrame | None = None) -> Lint:
    """entities: paper, finding, author, field tables (the latter two by name); edges (src, etype, dst) of findings; mentions (source, target), one for each place.
    linked: (source, target), what files link to by their parsed front matter and body, for the orphans; the mentions unless given.

    Every check reads the tables as they are given, so none sees links that this run adds. A duplicate group is one issue; its line of sources is counted in n_lines only.
    """
    papers, findings = entities["paper"], entities["finding"]
    drift = None
    for kind, df in entities.items():
        one = checks.schema_drift(df, kind, key="slug" if "slug" in df.columns else "name")
        drift = one if drift is None else drift.unionByName(one)
    nodes = None
    for kind, df in entities.items():
        one = df.select(F.col("slug" if "slug" in df.columns else "name").alias("slug"), F.lit(kind).alias("entity"))
        nodes = one if nodes is None else nodes.unionByName(one)
    known = (mentions if linked is None else linked).select("source", "target").distinct()
    rows = neardup.scope(findings, new_slugs, since).select("slug", normalize(F.col("statement")).alias("stmt"), "is_new", "sort_key")
    clusters = neardup.star_clusters(rows, neardup.similar_pairs(rows))
    groups = neardup.cluster_report(clusters, findings)
    duplicates = groups.select(F.lit("duplicate finding").alias("check"), F.lit("finding").alias("entity"), F.col("cluster").alias("key"), F.col("members").alias("detail"))
    every = drift.unionByName(checks.orphans(nodes, known)).unionByName(duplicates).unionByName(checks.asymmetric_edges(findings, edges)).unionByName(checks.stale_links(nodes, mentions)).unionByName(checks.date_sanity(papers, findings))
    sources = groups.where("sources <> ''").agg(F.count("*").alias("extra"))
    counted = checks.report(every, SECTIONS)
    extra = sources.select(F.lit("duplicate finding").alias("check"), "extra")
    report = counted.join(extra, "check", "left").select("check", "n", (F.col("n") + F.coalesce("extra", F.lit(0))).alias("n_lines"))
    added = links.add_similar(neardup.cluster_links(clusters), findings, edges)
    return Lint(every, report, added if link_similar else added.limit(0))


def finding_edges(findings: DataFrame) -> DataFrame:
    """(src, etype, dst): the relations of findings as edges."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("etype"), F.col(f"relations.{t.replace('-', '_')}").alias("to")) for t in EDGE_TYPES]))
    return findings.select(F.col("slug").alias("src"), each.alias("x")).select("src", "x.etype", F.explode("x.to").alias("dst"))


def lint_vault(spark: SparkSession, path: str, new_slugs: list[str] | None = None, since: str | None = None, link_similar: bool = True) -> Lint:
    """Lint the files of a vault."""
    entities = {"paper": vault.papers(spark, path), "finding": vault.findings(spark, path), "author": vault.authors(spark, path), "field": vault.fields(spark, path)}
    files = None
    for folder in FOLDERS:
        one = vault.scan(spark, path, folder)
        files = one if files is None else files.unionByName(one)
    return lint(entities, finding_edges(entities["finding"]), vault.mentions(spark, path), new_slugs, since, link_similar, vault.file_links(files))
