"""Ingest and lint as a whole, on a small vault."""

import json

from pyspark.sql import functions as F

from vaultspark.operators import checks
from vaultspark.plans import ingest, lint
from vaultspark.sources import fetch, pages, payloads

EDGE = "src string, etype string, dst string"


def triples(df):
    return sorted(map(tuple, df.select("src", "etype", "dst").collect()))


def test_admit(spark):
    requests = spark.createDataFrame([(1, "1706.03762v2", False), (2, "junk", False), (3, "https://e.org/a", False), (4, "10.1/x", False)], "req_id long, input string, force boolean")
    papers = spark.createDataFrame([("p", "1706.03762", None, None, "p.md")], "slug string, arxiv_id string, doi string, source_url string, sort_key string")
    cache = spark.createDataFrame([("https://e.org/a",)], "u string").select(F.sha2("u", 256).alias("sha"))
    got = ingest.admit(requests, papers, cache)
    assert [r.req_id for r in got["errors"].collect()] == [2] and [(r.req_id, r.slug) for r in got["existing"].collect()] == [(1, "p")]
    assert [r.source_url for r in got["fetch"].collect()] == ["https://doi.org/10.1/x"]


def test_apply_edges_twice(spark):
    findings = spark.createDataFrame([("f1", "new"), ("f2", "old"), ("f3", "old")], "slug string, source_paper string")
    papers = spark.createDataFrame([("new",), ("old",)], "slug string")
    new = spark.createDataFrame([("f1", "similar-to", "f2"), ("f1", "uses", "f3"), ("f1", "uses", "gone")], EDGE)
    cites = spark.createDataFrame([("x",)], "slug string")
    none = spark.createDataFrame([], EDGE)
    a = ingest.apply_edges(new, cites, "new", findings, papers, none, none)
    assert triples(a.finding_edges) == [("f1", "similar-to", "f2"), ("f1", "uses", "f3"), ("f1", "uses", "gone"), ("f2", "similar-to", "f1")]
    assert triples(a.paper_edges) == [("new", "builds-on", "old"), ("new", "cites", "x"), ("new", "similar-to", "old"), ("old", "similar-to", "new")]
    assert {r.etype: r.n for r in a.counts.collect() if r.n} == {"similar-to": 1, "uses": 2}
    assert sorted((r.level, r.slug) for r in a.touched.collect()) == [("finding", "f1"), ("finding", "f2"), ("paper", "new"), ("paper", "old")]
    b = ingest.apply_edges(new, cites, "new", findings, papers, a.finding_edges, a.paper_edges)
    assert triples(b.finding_edges) == triples(a.finding_edges) and triples(b.paper_edges) == triples(a.paper_edges) and not any(r.n for r in b.counts.collect())
    assert sorted((r.level, r.slug) for r in b.touched.collect()) == [("finding", "f1"), ("paper", "new")]
    assert {r.slug: r.findings for r in ingest.paper_findings(findings).collect()} == {"new": ["f1"], "old": ["f2", "f3"]}


def test_slices_of_both_kinds(spark, tmp_path):
    paged = spark.createDataFrame([("s1", [(0, "a", [])], [])], f"sha string, pages {pages.PAGES}, toc {pages.TOC}")
    html = spark.createDataFrame([("s2", b"<p>b</p>")], "sha string, content binary")
    s = ingest.slice_files(paged, html)
    assert sorted((r.sha, r.meta_text, r.page_count) for r in s.collect()) == [("s1", "\n===== PAGE 1 =====\na", 1), ("s2", "b", 0)]
    ingest.cache_slices(s, str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_download(spark, tmp_path):
    (tmp_path / "x.html").write_bytes(b"<p>hi</p>")
    rows = spark.createDataFrame([("a", f"file://{tmp_path}/x.html"), ("b", f"file://{tmp_path}/none")], "sha string, url string")
    got = {r.sha: r for r in fetch.download(rows).collect()}
    assert bytes(got["a"].content) == b"<p>hi</p>" and got["a"].error is None and got["b"].content is None and got["b"].error
    c = spark.createDataFrame([(("arxiv", "https://arxiv.org/abs/1.2v3", "1.2v3"),)], "c struct<source_type:string,source_url:string,arxiv_id:string>")
    assert c.select(fetch.fetch_url(F.col("c"))).first()[0] == "https://arxiv.org/pdf/1.2.pdf"


def test_payloads(spark, tmp_path):
    edges = {"new_paper": "p", "cites": ["x"], "linker_output": [{"new_finding": "f", "edges": {"uses": [{"target": "[[g]]", "why": "w"}, "h"]}}]}
    (tmp_path / "e.json").write_text(json.dumps(edges, indent=2))
    e = payloads.edge_payload(payloads.read_json(spark, str(tmp_path / "e.json"), "edges"))
    assert sorted((r.new_paper, r.src, r.etype, r.dst) for r in e.collect()) == [("p", "f", "uses", "[[g]]"), ("p", "f", "uses", "h")]
    text = spark.createDataFrame([(json.dumps({"source_paper": "p", "findings": [{"statement": "s", "source-ref": "1"}]}),)], "value string")
    f = payloads.finding_payload(payloads.from_text(text, "findings")).first()
    assert (f.statement, f.source_ref, f.hedging, f.pos) == ("s", "1", None, 0)
    assert json.loads(payloads.to_json(spark.createDataFrame([(1, None)], "a int, b string")).first().value) == {"a": 1, "b": None}


def test_lint(spark):
    ddl = "slug string, type string, statement string, source_paper string, source_ref string, fields array<string>, extracted_date string, finding_type string, hedging string, relations struct<supports:array<string>,contradicts:array<string>,extends:array<string>,uses:array<string>,similar_to:array<string>>, sort_key string"
    one = lambda s, t: (s, "finding", t, "p", "r", [], "2024-01-01", "empirical", "asserted", ([], [], [], [], []), s + ".md")
    text = "models of this kind learn to read long documents well"
    findings = spark.createDataFrame([one("a", text), one("b", text + "s"), one("c", "another matter")], ddl)
    papers = spark.createDataFrame([("p", "2024-01-02", "2024-01-01")], "slug string, publication_date string, ingested_date string")
    edges = spark.createDataFrame([("a", "contradicts", "c")], EDGE)
    mentions = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "gone"), ("c", "gone")], "source string, target string")
    out = lint.lint({"paper": papers, "finding": findings}, edges, mentions, since="2024-01-01")
    n = {r.check: (r.n, r.n_lines) for r in out.report.collect()}
    assert n["duplicate finding"] == (1, 2) and n["orphan"] == (1, 1) and n["stale link"] == (2, 2) and n["asymmetric edge"] == (1, 1) and n["date sanity"] == (1, 1) and out.failed()
    assert triples(out.added) == [("a", "similar-to", "b"), ("b", "similar-to", "a")]


def test_lint_of_files(spark, tmp_path):
    """Links come from the front matter's values, however deep, and the body; a list in a list is none, though its brackets are stale links in the text."""
    finding = "---\ntype: finding\nstatement: {0}\nslug: {1}\nsource-paper: \"[[p]]\"\nrelations:\n  similar-to: [{2}]\n---\n{3}\n"
    for folder, stem, text in (
        ("papers", "p", '---\ntype: paper\nslug: p\nnotes:\n  - deep: ["see [[Doe, J.|J]]"]\n---\nbody [[gone]] [[gone]]\n'),
        ("papers", "q", "---\ntype: paper\nslug: q\ncites: [[p]]\n---\nalone\n"),
        ("findings", "f", finding.format("one thing", "f", '"[[g]]"', "[[views/x]] [[f]]")),
        ("findings", "g", finding.format("another", "g", "", "")),
        ("authors", "Doe, J.", "---\ntype: author\nname: Doe, J.\n---\n"),
        ("authors", "Roe, R.", "---\ntype: author\nname: Roe, R.\n---\n"),
    ):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{stem}.md").write_text(text)
    (tmp_path / "index.md").write_text("[[p]] [[nowhere]]")
    out = lint.lint_vault(spark, str(tmp_path))
    found = sorted((r.check, r.key, r.detail) for r in out.issues.collect() if r.check != "schema drift")
    assert [x for x in found if x[0] == "orphan"] == [("orphan", "Roe, R.", "no links"), ("orphan", "q", "no links")]
    assert [x for x in found if x[0] == "stale link"] == [("stale link", "index", "nowhere"), ("stale link", "p", "gone"), ("stale link", "p", "gone")]
    assert [x for x in found if x[0] == "asymmetric edge"] == [("asymmetric edge", "f", "similar-to g")]
    assert lint.lint_vault(spark, str(tmp_path / "none")).issues.count() == 0
    lines = [r.line for r in checks.text_report(out.issues, out.report, lint.SECTIONS).orderBy("section", "pos").collect()]
    assert "orphan (2):" in lines and "  - author Roe, R.  no links" in lines and lines[-1] == ""
