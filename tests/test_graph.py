"""Edges, candidates, checks and views on small vaults."""

import pytest

from vaultspark.operators import checks, links, neardup, views

FINDINGS = [("f1", "p1"), ("f2", "p2"), ("f3", "p1"), ("f4", None)]


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, etype string, dst string")


def findings(spark):
    return spark.createDataFrame(FINDINGS, "slug string, source_paper string")


def triples(df):
    return sorted((r.src, r.etype, r.dst) for r in df.collect())


def test_forward_edges(spark):
    new = edges(spark, [("f1", "uses", "f1"), ("f1", "uses", "gone"), ("f1", "uses", "gone"), ("no", "uses", "f1"), ("f2", "extends", "f1")])
    had = edges(spark, [("f2", "extends", "f1")])
    assert triples(links.forward(new, findings(spark))) == [("f1", "uses", "gone"), ("f2", "extends", "f1")]
    assert triples(links.forward(new, findings(spark), had)) == [("f1", "uses", "gone")]


def test_mirror_rollup_and_counts(spark):
    e = edges(spark, [("f1", "similar-to", "f2"), ("f1", "contradicts", "gone"), ("f1", "uses", "f2"), ("f1", "supports", "f3"), ("f1", "supports", "f4")])
    assert triples(links.mirrored(e, findings(spark))) == [("f2", "similar-to", "f1")]
    up = links.rollup(e, findings(spark))
    assert triples(up) == [("p1", "builds-on", "p2"), ("p1", "similar-to", "p2")]
    papers = spark.createDataFrame([("p2",)], "slug string")
    assert triples(links.paper_mirrored(up, papers)) == [("p2", "similar-to", "p1")]
    assert triples(links.rollup(e, findings(spark), "new")) == [("new", "builds-on", "p2"), ("new", "similar-to", "p2")]
    assert {r.etype: r.n for r in links.edge_counts(e).collect()} == {"supports": 2, "contradicts": 1, "extends": 0, "uses": 1, "similar-to": 1}


def test_payload(spark):
    rows = [("f1", {"uses": [("[[f2|x]]", "why"), ("", "")], "odd": [("f3", "")]})]
    got = links.payload_edges(spark.createDataFrame(rows, "new_finding string, edges map<string,array<struct<target:string,why:string>>>"))
    assert triples(got) == [("f1", "uses", "f2")]


def test_candidates(spark):
    f = spark.createDataFrame(
        [("b", "s", "p1", ["x", "y"], "b.md"), ("a", "s", "p1", ["x", "y"], "a.md"), ("a-b", "s", "p2", ["z"], "a-b.md"), ("c", "s", "p3", ["x"], "c.md"), ("d", "s", None, ["z"], "d.md")],
        "slug string, statement string, source_paper string, fields array<string>, sort_key string",
    )
    p = spark.createDataFrame([("p1", ["A"]), ("p2", ["B"]), ("p3", ["B"])], "slug string, authors array<string>")
    got = links.candidates(f, p, ["x", "y", " "], ["B"]).collect()
    assert [(r.slug, r.score) for r in got] == [("a", 4), ("b", 4), ("c", 3), ("a-b", 1)]
    assert [r.slug for r in links.candidates(f, p, ["x"], [], cap=1, exclude_paper="p1").collect()] == ["c"]
    assert [r.slug for r in links.candidates(f, p, ["x", "y"], ["B"], cap=-3).collect()] == ["a"]


def test_incoming_and_one_hop(spark):
    e = edges(spark, [("f1", "uses", "f2"), ("f1", "supports", "f2"), ("f2", "uses", "gone"), ("f2", "uses", "f2")])
    assert [(r.slug, r.finding, r.edge_type) for r in links.incoming(e).orderBy("slug").collect()] == [("f2", "f1", "supports →uses 🔧"), ("gone", "f2", "uses 🔧")]
    assert sorted((r.slug, r.neighbour) for r in links.one_hop(e, findings(spark)).collect()) == [("f1", "f2"), ("f2", "f1"), ("gone", "f2")]


def test_similar_links_are_idempotent(spark):
    pairs = spark.createDataFrame([("f1", "f2"), ("f2", "gone")], "a string, b string")
    had = edges(spark, [("f1", "similar-to", "f2")])
    new = links.add_similar(pairs, findings(spark), had)
    assert triples(new) == [("f2", "similar-to", "f1"), ("f2", "similar-to", "gone")]
    assert links.add_similar(pairs, findings(spark), had.unionByName(new)).count() == 0


def test_relations(spark):
    a = links.relations(edges(spark, [("p", "cites", "b"), ("p", "cites", "a"), ("p", "cites", "a")]))
    b = links.relations(edges(spark, [("p", "cites", "c"), ("q", "cites", "a")]))
    assert {r.src: r.targets for r in links.merge_relations(a, b).collect()} == {"p": ["a", "b", "c"], "q": ["a"]}


def test_validate_edges(spark):
    p = spark.createDataFrame([("f1", "uses", f"c{k}", "ok") for k in range(6)] + [("f2", "odd", "f3", " ".join(["w"] * 26)), ("f1", "uses", "f3", "x")], "src string, etype string, dst string, why string")
    known = spark.createDataFrame([(f"c{k}",) for k in range(6)] + [("f3",)], "slug string")
    got = {(r.src, r.problem) for r in links.validate_edges(p, known, findings(spark)).collect()}
    assert got == {("f1", "too many edges"), ("f2", "long reason"), ("f2", "unknown type"), ("f1", "same paper")}


def test_schema_drift(spark):
    ddl = "slug string, type string, statement string, source_paper string, source_ref string, fields array<string>, extracted_date string, finding_type string, hedging string, relations struct<supports:array<string>,contradicts:array<string>,extends:array<string>,uses:array<string>,similar_to:array<string>>"
    full = ("f1", "finding", "s", "p", "r", [], "2024-01-01", "empirical", "asserted", ([], [], [], [], []))
    bad = ("f2", None, "s", "p", "r", None, "2024-01-01", "odd", None, ([], [], [], [], None))
    got = sorted((r.key, r.detail) for r in checks.schema_drift(spark.createDataFrame([full, bad], ddl).withColumnRenamed("x", "y"), "finding", {"relations.similar-to": "relations.similar_to"}).collect())
    assert got == [("f2", "missing: fields"), ("f2", "missing: hedging"), ("f2", "missing: relations.similar-to"), ("f2", "missing: type"), ("f2", "wrong type"), ("f2", "wrong value: finding-type")]


def test_orphans_and_stale_links(spark):
    nodes = spark.createDataFrame([("a", "paper"), ("b", "paper"), ("c", "field"), ("d", "field"), ("e", "paper")], "slug string, entity string")
    l = spark.createDataFrame([("a", "b"), ("c", "c"), ("e", "gone"), ("e", "gone"), ("e", "views/x"), ("e", "")], "source string, target string")  # noqa: E741
    assert sorted(r.key for r in checks.orphans(nodes, l).collect()) == ["d", "e"]
    assert [(r.key, r.detail) for r in checks.stale_links(nodes, l).collect()] == [("e", "gone"), ("e", "gone")]


def test_asymmetric_edges(spark):
    e = edges(spark, [("f1", "similar-to", "f2"), ("f2", "contradicts", "f1"), ("f1", "similar-to", "gone"), ("f3", "similar-to", "f1"), ("f1", "similar-to", "f3"), ("f1", "uses", "f2")])
    assert sorted((r.key, r.detail) for r in checks.asymmetric_edges(findings(spark), e).collect()) == [("f1", "similar-to f2"), ("f2", "contradicts f1")]


def test_dates_and_report(spark):
    p = spark.createDataFrame([("a", "2024-02-01", "2024-01-01"), ("b", "2024-99-99", None), ("c", "x", "2024-01-01")], "slug string, publication_date string, ingested_date string")
    f = spark.createDataFrame([("f", "1.1.2024"), ("g", None)], "slug string, extracted_date string")
    issues = checks.date_sanity(p, f)
    assert sorted((r.key, r.detail) for r in issues.collect()) == [("a", "ingested before published"), ("c", "publication-date not ISO"), ("f", "extracted-date not ISO")]
    assert {r.check: r.n for r in checks.report(issues, ["date sanity", "orphan"]).collect()} == {"date sanity": 3, "orphan": 0}


def test_views(spark):
    ddl = "slug string, authors array<string>, fields array<string>, publication_date string, ingested_date string, venue string, quality struct<credibility:int,experimental_rigor:int,reproducibility:string,overall:double>"
    p = spark.createDataFrame([("a", ["x", "y"], ["f"], "2020", "2024-01-02", "v", (4, 4, "none", 4.0)), ("b", ["x"], ["f"], "2021", "2024-01-03", "v", (1, 1, "none", None)), ("c", ["x", "y"], ["g"], "2019", "2024-01-01", "v", (5, 5, "none", 3.9))], ddl)
    assert [r.slug for r in views.recent_papers(p, 2).collect()] == ["b", "a"]
    assert [(r.key, r.papers) for r in views.grouped(p, "authors").collect()] == [(["x"], ["b"]), (["x", "y"], ["a", "c"])]
    assert [(r.key, r.n) for r in views.grouped(p, "authors", True).collect()] == [("x", 3), ("y", 2)]
    assert [r.slug for r in views.high_credibility(p).collect()] == ["a"]
    assert [r.slug for r in views.papers_of(p, "authors", "y").collect()] == ["a", "c"]
    files = spark.createDataFrame([("papers/a.md",), ("views/x.md",), ("index.md",), ("log.md",)], "path string")
    assert sorted((r.path, r.group) for r in views.graph_nodes(files).collect()) == [("log.md", "other"), ("papers/a.md", "papers")]


def test_unsettled_components_raise(spark):
    chain = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(40)], "a string, b string")
    assert {r.block for r in neardup.components(chain).collect()} == {"000"}
    with pytest.raises(RuntimeError, match="settled"):
        neardup.components(chain, rounds=2)
