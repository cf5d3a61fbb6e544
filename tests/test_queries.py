"""Every registered query against its SQL, and the contract of the entry module."""

import difflib
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from vaultspark.plans import catalogue
from vaultspark.plans.model import Model
from vaultspark.sources import pages as paged

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(v):
    return float(f"{v:.10g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = catalogue.queries()[name](spark, sf_dir)
    want = con.execute(SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def rows_of(spark, sf_dir, name):
    return catalogue.queries()[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def statements(spark, sf_dir):
    """(slug, text, is_new) of all documents, in file order."""
    return [(r.slug, r.stmt, r.is_new) for r in catalogue._statements(Model(spark, sf_dir)).orderBy("sort_key").collect()]


@pytest.fixture(scope="module")
def similar(statements):
    """(a, b) -> ratio of whole statements, a new, by the definition; bounds of the ratio pass over what can't reach it."""
    found, matcher = {}, difflib.SequenceMatcher(None)
    for b, y, _ in statements:
        matcher.set_seq2(y)
        for a, x, new in statements:
            if new and a != b and x and y and 2 * min(len(x), len(y)) >= 0.92 * (len(x) + len(y)):
                matcher.set_seq1(x)
                if matcher.quick_ratio() >= 0.92 and matcher.ratio() >= 0.92:
                    found[a, b] = round(matcher.ratio(), 6)
    return found


def expanded(rows, new):
    """All pairs of rows, the first new, that the links between classes of equal texts and their members stand for."""
    of, whole = {}, {}
    for r in rows:
        if r.kind == "member":
            of.setdefault(r.a, {r.a}).add(r.b)
    for r in rows:
        if r.kind == "link":
            whole |= {(a, b): r.ratio for a in of.get(r.a, {r.a}) for b in of.get(r.b, {r.b}) if a in new}
    return whole | {(a, b): 1.0 for g in of.values() for a in g for b in g if a != b and a in new}


def test_neardup_queries_equal_replay(spark, sf_dir, statements, similar):
    assert expanded(rows_of(spark, sf_dir, "neardup_pairs"), {s for s, _, new in statements if new}) == similar and similar
    of = {}
    for s, _, new in statements:
        near = [b for b, _, _ in statements if (s, b) in similar and b not in of]
        if new and s not in of and near:
            of.update(dict.fromkeys([s, *near], s))
    assert {r.slug: r.cluster for r in rows_of(spark, sf_dir, "neardup_clusters")} == of and of
    size = {c: sum(x == c for x in of.values()) for c in of.values()}
    assert {(r.slug, r.cluster, r.n_links) for r in rows_of(spark, sf_dir, "neardup_links")} == {(s, c, size[c] - 1) for s, c in of.items()}


def test_fuzzy_cascade_adds_what_only_fuzzy_titles_find(spark, sf_dir):
    plain = {(r.doc_id, r.slug): r.rule for r in rows_of(spark, sf_dir, "cite_cascade")}
    whole = {(r.doc_id, r.slug): r.rule for r in rows_of(spark, sf_dir, "cite_cascade_fuzzy")}
    fuzzy = {(r.doc_id, r.slug) for r in rows_of(spark, sf_dir, "cite_fuzzy_title")}
    assert set(whole) == set(plain) | fuzzy and fuzzy
    first = ("arxiv", "doi", "title")
    assert all(whole[k] == r for k, r in plain.items() if r in first) and all(k in fuzzy or plain.get(k) == r for k, r in whole.items())


def test_cascade_looks_for_fuzzy_titles(spark, sf_dir):
    rows = {(r.doc_id, r.slug): r.rule for r in rows_of(spark, sf_dir, "cite_cascade")}
    fuzzy = {(r.doc_id, r.slug) for r in rows_of(spark, sf_dir, "cite_fuzzy_title")}
    assert fuzzy <= set(rows) and "fuzzy title" in rows.values() and "'fuzzy title'" in SQL["cite_cascade"]


def test_page_slices_equal_replay(spark, sf_dir):
    docs = {r.doc_id: (r.pages, r.toc) for r in catalogue._paged(Model(spark, sf_dir)).collect()}
    rows = rows_of(spark, sf_dir, "page_slices")
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        pages, toc = docs[r.doc_id]
        cutoff = next((p.page_no for p in pages if re.search(r"(?im)^\s*(references|bibliography)\s*$", p.text)), len(pages))
        weights = {}
        for p in pages[: cutoff + 2]:
            for x in p.lines:
                for span in x.spans:
                    weights[span.size] = weights.get(span.size, 0) + len(span.text)
        body = max(weights, key=lambda k: weights[k], default=0)
        heads = [(p.page_no, x.y, "".join(s.text for s in x.spans).strip()) for p in pages[:cutoff] for x in p.lines if max(s.size for s in x.spans) >= 1.1 * body]
        heads = sorted(h for h in heads if 0 < len(h[2]) <= 120)
        for cues, got in ((paged.BRIEF_CUES, r.brief_pages), (paged.FINDINGS_CUES, r.findings_pages)):
            keep = set()
            for k, e in enumerate(toc):
                end = next((x.page for x in toc[k + 1 :] if x.level <= e.level), cutoff)
                if re.search(cues, e.title):
                    keep |= set(range(max(0, e.page - 1), min(cutoff, end)))
            for k, (page, _, text) in enumerate(heads):
                end = min(cutoff, heads[k + 1][0] + 1) if k + 1 < len(heads) else cutoff
                if re.search(cues, text):
                    keep |= set(range(page, end))
            keep = keep or {p.page_no for p in pages[:cutoff] if re.search(cues, p.text[:500])}
            keep |= set(range(min(3, cutoff))) | set(range(max(0, cutoff - 2), cutoff))
            assert (r.cutoff, got) == (cutoff, "|".join(map(str, sorted(keep))))


def test_every_query_is_checked():
    assert {n for n in catalogue.queries() if n not in SQL} == {"neardup_pairs", "neardup_clusters", "neardup_links", "cite_cascade_fuzzy", "cite_fuzzy_title", "page_slices"}


def test_entry(spark):
    assert entry_module.entry(spark).count() == 30
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries()) and len(entry_module.queries()) >= 80


def test_pushdown(spark, sf_dir):
    """The scan of a projection reads only its columns; a filter reaches it."""
    plan = catalogue.queries()["sha_key"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<page_id:bigint,url:string>", plan)
