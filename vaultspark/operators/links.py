"""Edges between findings and between papers, and the shortlist of candidates for new ones. Edge tables have (level, src, etype, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions.text import unwrap_link
from vaultspark.schema import EDGE_TYPES, PAPER_EDGE, SYMMETRIC

CAP = 30


def overlap(a: Column, b: Column) -> Column:
    """How many distinct elements two lists share; null lists share none."""
    empty = F.expr("cast(array() as array<string>)")
    return F.size(F.array_intersect(F.coalesce(a, empty), F.coalesce(b, empty)))


def candidates(findings: DataFrame, papers: DataFrame, fields: list[str], authors: list[str], cap: int = CAP, exclude_paper: str = "") -> DataFrame:
    """Findings that share a field or, through their paper, an author: 2 * shared fields + shared authors, best first, ties in file order.

    Papers are cut down to those with a shared author before the join, so its build side holds only these. A negative cap drops so
    many of the worst; that one needs the count of all that qualify.
    """
    wanted = lambda xs: F.array(*[F.lit(x.strip()) for x in xs if x.strip()]).cast("array<string>")
    of = papers.select(F.col("slug").alias("source_paper"), overlap(F.col("authors"), wanted(authors)).alias("author_overlap")).where("author_overlap > 0")
    f = findings.withColumn("field_overlap", overlap(F.col("fields"), wanted(fields)))
    if exclude_paper:
        f = f.where(~F.col("source_paper").eqNullSafe(F.lit(exclude_paper)))
    scored = (
        f.join(of, "source_paper", "left")
        .withColumn("author_overlap", F.coalesce("author_overlap", F.lit(0)))
        .where("field_overlap > 0 or author_overlap > 0")
        .withColumn("score", 2 * F.col("field_overlap") + F.col("author_overlap"))
    )
    if cap < 0:
        cap = max(0, scored.count() + cap)
    top = scored.orderBy(F.desc("score"), "sort_key").limit(cap)
    return top.select("slug", "statement", F.array_sort(F.array_distinct("fields")).alias("fields"), "field_overlap", "author_overlap", "score")


def flip(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def payload_edges(linker: DataFrame) -> DataFrame:
    """(src, etype, dst) of rows (new_finding, edges map<etype, array<struct<target, why>>>); links unwrapped, blanks and unknown types dropped."""
    return (
        linker.select(F.col("new_finding").alias("src"), F.explode("edges").alias("etype", "to"))
        .where(F.col("etype").isin(EDGE_TYPES))
        .select("src", "etype", F.explode("to.target").alias("dst"))
        .where(F.coalesce(F.col("dst"), F.lit("")) != "")
        .withColumn("dst", unwrap_link(F.col("dst")))
    )


def forward(new: DataFrame, findings: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The new edges: sources that exist, no self-loops, each once, not among the existing ones. Targets need not exist."""
    e = new.where("src <> dst").select("src", "etype", "dst").distinct().join(findings.select(F.col("slug").alias("src")), "src", "left_semi")
    return e if existing is None else e.join(existing.select("src", "etype", "dst"), ["src", "etype", "dst"], "left_anti")


def mirrored(edges: DataFrame, findings: DataFrame) -> DataFrame:
    """The other direction of symmetric edges whose target exists."""
    known = findings.select(F.col("slug").alias("dst"))
    return flip(edges.where(F.col("etype").isin(SYMMETRIC)).join(known, "dst", "left_semi")).select("src", "etype", "dst").distinct()


def rollup(edges: DataFrame, findings: DataFrame, new_paper: str | None = None) -> DataFrame:
    """Paper edges behind finding edges, where both papers are known and differ. With new_paper all start there, as one payload's do."""
    of = findings.select("slug", F.nullif("source_paper", F.lit("")).alias("paper"))
    etype = F.lit(None).cast("string")
    for a, b in PAPER_EDGE.items():
        etype = F.when(F.col("etype") == a, b).otherwise(etype)
    own = F.coalesce("src_paper", F.lit(new_paper)) if new_paper else F.col("src_paper")
    return (
        edges.join(of.select(F.col("slug").alias("src"), F.col("paper").alias("src_paper")), "src")
        .join(of.select(F.col("slug").alias("dst"), F.col("paper").alias("dst_paper")), "dst")
        .where(F.col("dst_paper").isNotNull() & (F.col("dst_paper") != own))
        .select((F.lit(new_paper) if new_paper else own).alias("src"), etype.alias("etype"), F.col("dst_paper").alias("dst"), own.alias("finding_paper"))
        .distinct()
    )


def paper_mirrored(paper_edges: DataFrame, papers: DataFrame) -> DataFrame:
    """The other direction of symmetric paper edges, towards each finding's own paper, where the target paper exists."""
    known = papers.select(F.col("slug").alias("dst"))
    e = paper_edges.where(F.col("etype").isin(SYMMETRIC)).join(known, "dst", "left_semi")
    return e.select(F.col("dst").alias("src"), "etype", F.col("finding_paper").alias("dst")).distinct()


def edge_counts(added: DataFrame) -> DataFrame:
    """Added edges by type; types without any count 0."""
    spark = added.sparkSession
    types = spark.createDataFrame([(t,) for t in EDGE_TYPES], "etype string")
    return types.join(added.groupBy("etype").agg(F.count("*").alias("n")), "etype", "left").select("etype", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def touched(forward_edges: DataFrame, mirrors: DataFrame, paper_mirrors: DataFrame, new_paper: DataFrame) -> DataFrame:
    """(level, slug) of every entity that applying the edges writes."""
    finding = forward_edges.select("src").union(mirrors.select("src")).distinct().select(F.lit("finding").alias("level"), F.col("src").alias("slug"))
    paper = paper_mirrors.select("src").union(new_paper.select("slug")).distinct().select(F.lit("paper").alias("level"), F.col("src").alias("slug"))
    return finding.unionByName(paper)


def relations(edges: DataFrame) -> DataFrame:
    """(src, etype, targets): each entity's targets by type, distinct and sorted."""
    return edges.groupBy("src", "etype").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def merge_relations(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Set union of two relation tables (src, etype, targets), sorted."""
    both = existing.unionByName(new).groupBy("src", "etype").agg(F.flatten(F.collect_list("targets")).alias("targets"))
    return both.select("src", "etype", F.array_sort(F.array_distinct("targets")).alias("targets"))


def add_similar(pairs: DataFrame, findings: DataFrame, existing: DataFrame) -> DataFrame:
    """Both directions of pairs (a, b) as similar-to edges, where the source exists and the edge doesn't yet."""
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a")).distinct()
    known = findings.select(F.col("slug").alias("src"))
    had = existing.where("etype = 'similar-to'").select("src", "dst")
    return both.join(known, "src", "left_semi").join(had, ["src", "dst"], "left_anti").select("src", F.lit("similar-to").alias("etype"), "dst")


def one_hop(edges: DataFrame, findings: DataFrame) -> DataFrame:
    """(slug, neighbour) for each finding: those it links to and those that link to it."""
    both = edges.select(F.col("src").alias("slug"), F.col("dst").alias("neighbour")).union(edges.select("dst", "src")).distinct()
    known = findings.select(F.col("slug").alias("neighbour"))
    return both.where("slug <> neighbour").join(known, "neighbour", "left_semi").select("slug", "neighbour")


def incoming(edges: DataFrame) -> DataFrame:
    """(slug, finding, edge_type): findings that link to it, their edge types' labels in order, one after the other."""
    #: Labels by edge type, in order.
    labels = {"supports": "supports →", "contradicts": "contradicts ⚡", "extends": "extends ↗", "uses": "uses 🔧", "similar-to": "similar to ≈"}
    has = [F.max(F.when(F.col("etype") == t, F.lit(label)).otherwise("")) for t, label in labels.items()]
    return edges.where("src <> dst").groupBy(F.col("dst").alias("slug"), F.col("src").alias("finding")).agg(F.concat(*has).alias("edge_type"))


def cited_by(paper_edges: DataFrame) -> DataFrame:
    """(slug, cited_by) of cites edges but those of a paper to itself."""
    return paper_edges.where("etype = 'cites' and src <> dst").select(F.col("dst").alias("slug"), F.col("src").alias("cited_by")).distinct()


def inlinks(links: DataFrame) -> DataFrame:
    """(target, n_inlinks) of links (source, target), each source once."""
    return links.distinct().groupBy("target").agg(F.count("*").alias("n_inlinks"))


#: Limits of a linker's answer.
MAX_EDGES, MAX_WHY_WORDS = 5, 25


def validate_edges(proposed: DataFrame, candidate_slugs: DataFrame, source_of: DataFrame) -> DataFrame:
    """Problems (src, problem, detail) of proposed edges (src, etype, dst, why): too many, not a candidate, same paper, long or unknown.

    source_of: (slug, source_paper). An answer without problems gives no rows.
    """
    many = proposed.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > MAX_EDGES).select("src", F.lit("too many edges").alias("problem"), F.col("n").cast("string").alias("detail"))
    stray = proposed.join(candidate_slugs.select(F.col("slug").alias("dst")), "dst", "left_anti").select("src", F.lit("not a candidate").alias("problem"), F.col("dst").alias("detail"))
    of = source_of.select("slug", "source_paper")
    same = (
        proposed.join(of.select(F.col("slug").alias("src"), F.col("source_paper").alias("a")), "src")
        .join(of.select(F.col("slug").alias("dst"), F.col("source_paper").alias("b")), "dst").where("a = b")
        .select("src", F.lit("same paper").alias("problem"), F.col("dst").alias("detail"))
    )
    long = proposed.where(F.size(F.split(F.trim("why"), "\\s+")) > MAX_WHY_WORDS).select("src", F.lit("long reason").alias("problem"), F.col("dst").alias("detail"))
    odd = proposed.where(~F.col("etype").isin(EDGE_TYPES)).select("src", F.lit("unknown type").alias("problem"), F.col("etype").alias("detail"))
    return many.unionByName(stray).unionByName(same).unionByName(long).unionByName(odd)
