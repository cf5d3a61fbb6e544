"""Integrity checks over one snapshot. Each gives issues (check, entity, key, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions.text import is_iso
from vaultspark.schema import ENUMS, REQUIRED, SYMMETRIC


def _issue(df: DataFrame, check: str, entity: str, key: str, detail) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(entity).alias("entity"), F.col(key).alias("key"), detail.alias("detail"))


def schema_drift(df: DataFrame, entity: str, columns: dict[str, str] | None = None, key: str = "slug") -> DataFrame:
    """Wrong or missing type tags, required keys that are missing or null, values outside closed sets; one pass over the table.

    columns: the column or field of each dotted key, its hyphens as underscores unless given; a key without one is missing. An empty list is no issue.
    A missing type is two issues.
    """
    columns = {k: (columns or {}).get(k, k.replace("-", "_")) for k in REQUIRED[entity]}
    there = {f"{f.name}.{g.name}" for f in df.schema if hasattr(f.dataType, "names") for g in f.dataType} | set(df.columns)
    value = lambda k: F.col(columns[k]) if columns[k] in there else F.lit(None)
    found = [F.when(~value("type").cast("string").eqNullSafe(F.lit(entity)), F.lit("wrong type"))]
    found += [F.when(value(k).isNull(), F.lit(f"missing: {k}")) for k in REQUIRED[entity]]
    for k, allowed in ENUMS.items():
        if k in columns:
            found.append(F.when(~value(k).cast("string").isin(allowed), F.lit(f"wrong value: {k}")))
    each = df.select(F.col(key), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("detail"))
    return _issue(each, "schema drift", entity, key, F.col("detail"))


def orphans(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Entities (slug, entity) without a link (source, target) from or to any entity. A link to itself counts."""
    known = links.join(nodes.select(F.col("slug").alias("target")), "target", "left_semi")
    alone = nodes.join(known.select(F.col("target").alias("slug")), "slug", "left_anti").join(known.select(F.col("source").alias("slug")), "slug", "left_anti")
    return alone.select(F.lit("orphan").alias("check"), "entity", F.col("slug").alias("key"), F.lit("no links").alias("detail"))


def stale_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links (source, target), each place on its own, to nothing: not blank, not the source, not under views/ or assets/, no entity."""
    open_ = links.where((F.col("target") != "") & (F.col("target") != F.col("source")) & ~F.col("target").rlike("^(views|assets)/"))
    return open_.join(nodes.select(F.col("slug").alias("target")), "target", "left_anti").select(
        F.lit("stale link").alias("check"), F.lit("link").alias("entity"), F.col("source").alias("key"), F.col("target").alias("detail")
    )


def asymmetric_edges(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """Symmetric edges to findings that exist and don't return them."""
    e = edges.where(F.col("etype").isin(SYMMETRIC)).select("src", "etype", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), "etype", F.col("src").alias("dst"))
    one = e.join(findings.select(F.col("slug").alias("dst")), "dst", "left_semi").join(back, ["src", "etype", "dst"], "left_anti")
    return one.select(F.lit("asymmetric edge").alias("check"), F.lit("finding").alias("entity"), F.col("src").alias("key"), F.concat_ws(" ", "etype", "dst").alias("detail"))


def date_sanity(papers: DataFrame, findings: DataFrame) -> DataFrame:
    """Dates that aren't written as dates, and papers ingested before they were published. Dates compare as text."""
    p, i = F.col("publication_date"), F.col("ingested_date")
    found = F.array(
        F.when(~is_iso(p), F.lit("publication-date not ISO")),
        F.when(~is_iso(i), F.lit("ingested-date not ISO")),
        F.when(is_iso(p) & is_iso(i) & (i < p), F.lit("ingested before published")),
    )
    a = papers.select("slug", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("detail"))
    b = findings.where(~is_iso(F.col("extracted_date"))).select("slug", F.lit("extracted-date not ISO").alias("detail"))
    return _issue(a, "date sanity", "paper", "slug", F.col("detail")).unionByName(_issue(b, "date sanity", "finding", "slug", F.col("detail")))


def report(issues: DataFrame, sections: list[str]) -> DataFrame:
    """(check, n) for each section, those without issues too."""
    every = issues.sparkSession.createDataFrame([(s,) for s in sections], "check string")
    return every.join(issues.groupBy("check").agg(F.count("*").alias("n")), "check", "left").select("check", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def failed(issues: DataFrame) -> DataFrame:
    """(failed): whether there is any issue, a row in any case."""
    return issues.limit(1).agg((F.count("*") > 0).alias("failed"))


def text_report(issues: DataFrame, counted: DataFrame, sections: list[str]) -> DataFrame:
    """(section, pos, line), to be read in that order: for each section a heading with its number, a line for each issue, a blank one."""
    order = issues.sparkSession.createDataFrame(list(enumerate(sections)), "section int, check string")
    head = order.join(counted, "check").select("section", F.lit(0).cast("long").alias("pos"), F.format_string("%s (%d):", "check", "n").alias("line"))
    place = F.row_number().over(Window.partitionBy("section").orderBy("entity", "key", "detail"))
    body = order.join(issues, "check").select("section", place.cast("long").alias("pos"), F.concat(F.lit("  - "), "entity", F.lit(" "), "key", F.lit("  "), "detail").alias("line"))
    last = order.select("section", F.lit((1 << 63) - 1).alias("pos"), F.lit("").alias("line"))
    return head.unionByName(body).unionByName(last)
