"""Vault files and paged documents."""

import pytest

from vaultspark.sources import pages as P
from vaultspark.sources import vault as V

PAPER = """---
type: paper
title: "A Title"
slug: 2020-01-a
authors:
- "[[Doe, J.]]"
arxiv-id: 2301.10140
publication-date: 2017-06-12
doi: null
quality:
  credibility: 4
  experimental-rigor: 3
  reproducibility: partial
  overall: 3.5
  rationale: ok
relations:
  cites: ["[[x|alias]]"]
  similar-to: []
---
body [[y]]
"""


def test_scan(spark, tmp_path):
    (tmp_path / "papers/sub").mkdir(parents=True)
    (tmp_path / "papers/a.md").write_text(PAPER)
    (tmp_path / "papers/b.md").write_text("---\n---\nno front matter")
    (tmp_path / "papers/sub/c.md").write_text(PAPER)
    (tmp_path / "papers/d.txt").write_text(PAPER)
    rows = V.papers(spark, str(tmp_path)).orderBy("sort_key").collect()
    assert [r.slug for r in rows] == ["2020-01-a", "b"]
    a = rows[0]
    assert a.arxiv_id == "2301.10140" and a.publication_date == "2017-06-12" and a.doi is None and a.authors == ["Doe, J."]
    assert a.quality.experimental_rigor == 3 and a.quality.overall == 3.5 and a.relations.cites == ["x"] and a.relations.similar_to == [] and a.body == "body [[y]]\n"
    assert rows[1].body == "---\n---\nno front matter" and V.findings(spark, str(tmp_path)).count() == 0


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("n", '{"type": "author", "name": "É", "links": ["[[a]]"]}', "\nbody\n")], "stem string, front string, body string")
    assert V.write_files(df, str(tmp_path), "authors") == 1
    text = (tmp_path / "authors/n.md").read_text()
    assert text == '---\ntype: author\nname: É\nlinks:\n- "[[a]]"\n---\n\nbody\n'
    assert V.authors(spark, str(tmp_path)).first().name == "É"


def test_slug_index_and_scaffold(spark, tmp_path):
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "stem string")
    got = {r.slug: r.entity for r in V.slug_index({"papers": one("a", "b"), "fields": one("a")}).collect()}
    assert got == {"a": "field", "b": "paper"}
    assert all(V.scaffold(spark, f"file://{tmp_path}/w").values()) and not any(V.scaffold(spark, f"file://{tmp_path}/w").values())


def doc(spark, texts, toc=(), lines=None):
    pages = [(k, t, [(1.0, [(10.0, t)])] + [(float(y), [(size, s)]) for y, size, s in (lines or {}).get(k, [])]) for k, t in enumerate(texts)]
    return spark.createDataFrame([(1, pages, list(toc))], f"doc_id long, pages {P.PAGES}, toc {P.TOC}")


def test_slices(spark):
    texts = [f"page {k} text" for k in range(8)] + ["x\n  References \ny", "after"]
    r = P.with_slices(doc(spark, texts)).first()
    assert r.cutoff == 8 and r.brief_pages == [0, 1, 2, 6, 7] and r.page_count == 10
    assert r.meta_text == "\n===== PAGE 1 =====\npage 0 text\n===== PAGE 2 =====\npage 1 text"
    by_toc = P.with_slices(doc(spark, texts, [(1, "Method", 4), (2, "detail", 5), (1, "Results", 6)])).first()
    assert by_toc.findings_pages == [0, 1, 2, 3, 4, 5, 6, 7] and by_toc.brief_pages == [0, 1, 2, 6, 7]
    by_font = P.with_slices(doc(spark, texts, lines={4: [(2, 14.0, "A Summary")], 5: [(2, 14.0, "Next")]})).first()
    assert by_font.brief_pages == [0, 1, 2, 4, 5, 6, 7]
    header = P.with_slices(doc(spark, texts[:4] + ["our conclusion is"] + texts[5:])).first()
    assert header.brief_pages == [0, 1, 2, 4, 6, 7]


def test_short_and_empty_documents(spark):
    assert P.with_slices(doc(spark, ["only"])).first().brief_pages == [0]
    assert P.with_slices(doc(spark, [])).first().brief_pages == []


def test_html_source(spark):
    files = spark.createDataFrame([("a", b"%PDF-1.4"), ("b", b"<p>x [1]  y\xff</p>")], "path string, content binary")
    assert [(r.path, r.full_text) for r in P.html_source(files).collect()] == [("b", "x y�")]


def test_front_matter_is_that_of_plain_yaml_and_spread_over_tasks(spark):
    class Plain(V.yaml.SafeLoader):
        yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t == "tag:yaml.org,2002:null"] for k, v in V.yaml.SafeLoader.yaml_implicit_resolvers.items()}

    odd = ["plain", "null", "", "1-URGENT: it's #1", "a" * 90, "word " * 30, "😀 é\x85", "tab\tand\rmore", "[x", "'q' \"d\"", "- a", None, True, 1.5]
    for x in odd:
        front = {"title": x, "fields": [x, "b"], "quality": {"overall": x}}
        text = V.dump_front(front)
        assert text == V.yaml.safe_dump(front, sort_keys=False, allow_unicode=True, default_flow_style=False)
        assert V.parse_front(f"---\n{text}---\nbody") == (V.yaml.load(text, Plain), "body")
    for text in ("k: ! x", "k: |#", "k: a\t b", "k: é\n"):
        try:
            want = V.yaml.load(text, Plain) or {}
        except V.yaml.YAMLError:
            with pytest.raises(V.yaml.YAMLError):
                V.parse_front(f"---\n{text}\n---\n")
        else:
            assert V.parse_front(f"---\n{text}\n---\n")[0] == want
    if V.yaml.__with_libyaml__:
        assert issubclass(V._Plain, V.yaml.CSafeLoader)
    files = V.as_files(spark.range(300).coalesce(1).selectExpr("cast(id as string) stem", "'{}' front", "'b' body"))
    assert files.rdd.getNumPartitions() >= 64
