"""Citations, existing papers, inserts, near-duplicates and the log."""

import datetime
import difflib
import json
import random
import re

import numpy as np
from pyspark.sql import functions as F

from vaultspark import agents
from vaultspark.functions.similarity import bag, bag_bound, seq_ratio
from vaultspark.operators import cite, neardup, upserts
from vaultspark.plans import catalogue
from tests.test_queries import expanded
from vaultspark.streaming import log

PAPERS = "slug string, title string, authors array<string>, arxiv_id string, doi string, publication_date string, source_url string, sort_key string"


def papers(spark, *rows):
    return spark.createDataFrame([(*r, r[0] + ".md") for r in rows], PAPERS)


def found(df):
    return sorted((r.doc_id, r.slug) for r in df.collect())


def docs(spark, *texts):
    return spark.createDataFrame([(k, "\nReferences\n" + t) for k, t in enumerate(texts)], "doc_id long, text string")


def test_exact_rules(spark):
    p = papers(spark, ("a", "t", [], "1706.03762v5", "10.1234/ABC", None, None), ("b", "t", [], "1706.03762", "10.1234/abc", None, None))
    probe = cite.probes(docs(spark, "arXiv: 1706.03762v1 and 10.1234/abc.)"))
    assert found(cite.by_arxiv(probe, p)) == [(0, "b")] and found(cite.by_doi(probe, p)) == [(0, "b")]


def test_title_rule(spark):
    p = papers(spark, *[(s, t, [], None, None, None, None) for s, t in (("short", "x" * 19), ("just", "y" * 20), ("long", "a study of many longer words"), ("other", "a study of few longer words"))])
    probe = cite.probes(docs(spark, "x" * 19 + " " + "zy" + "y" * 20 + "; A study of: many LONGER wordsmiths"))
    assert found(cite.by_title(probe, p)) == [(0, "just"), (0, "long")]


def test_titles_of_few_words_equal_containment(spark):
    """Titles of any number of words, also inside longer words, are found by equi-joins alone."""
    random.seed(13)
    word = lambda: "".join(random.choice("abc") for _ in range(random.randint(1, 12)))
    names = [" ".join(word() for _ in range(random.randint(1, 7))) + random.choice(["", "aaaaaaaaaaaaaaaaaaaaaaaa", " bcbcbcbcbcbcbcbcbcbcbcb"]) for _ in range(120)]
    texts = ["References\n" + " ".join(word() for _ in range(5)) + random.choice([" ", "x"]) + " ".join(random.sample(names, 4)) + random.choice(["y z", "", " end"]) for _ in range(60)]
    papers = spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(names)], "slug string, title string")
    probe = cite.probes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    held = {r.doc_id: r.bib_norm for r in probe.collect()}
    found = cite.by_title(probe, papers)
    want = {(d, f"p{k}") for d, t in held.items() for k, n in enumerate(names) if len(n) >= 20 and n in t}
    assert {(r.doc_id, r.slug) for r in found.collect()} == want and len(want) > 100
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_surname_rule(spark):
    p = papers(spark, ("a", "t", ["Smith, J."], None, None, "2017-01-01", None), ("h", "t", ["O'Neil-Ray, J."], None, None, "2017-01-01", None), ("far", "t", ["Jones, K."], None, None, "2018", None))
    text = "smithson et al 2017. O'Neil-Ray 2017. jones " + "x " * 40 + "2018"
    assert found(cite.by_surname_year(cite.probes(docs(spark, text)), p)) == [(0, "a")]
    li = papers(spark, ("li", "t", ["Li, K."], None, None, "2019-01-01", None))
    assert found(cite.by_surname_year(cite.probes(docs(spark, "li 2019", "believe 120195", "li 2018")), li)) == [(0, "li"), (1, "li")]


def test_surnames_of_one_beginning(spark):
    """Surnames that begin alike don't all meet each text: what is joined grows with the texts, not with texts times surnames."""
    names = [f"cust{k}" for k in range(400)] + ["li", "é😀x", "x" * 90, "y" * 76]
    p = papers(spark, *[(f"p{k}{y}", "t", [f"{n.title()}, A."], None, None, f"{y}-01-01", None) for k, n in enumerate(names) for y in (1995, 1996)])
    texts = [f"a{n} et al {'z' * gap} {y}" for n in (*names[::7], *names[-4:]) for gap in (0, 60, 70, 75) for y in (1995, 11996)] + [f"{n}{y}" for n in names[-5:] for y in (1995, 2001)] + ["1995", "", "199"]
    probe = cite.probes(docs(spark, *texts))
    df = cite.by_surname_year(probe, p)
    want = set()
    for r in probe.collect():
        for k, n in enumerate(names):
            want |= {(r.doc_id, f"p{k}{y}") for y in (1995, 1996) if re.search(f"{re.escape(n)}.{{0,{max(76 - len(n), 0)}}}{y}", r.bib_norm)}
    assert set(found(df)) == want and len(want) > 400
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, \(+surname#\d+ = surname", plan)  # not on a beginning that all share


def test_cascade(spark):
    p = papers(spark, ("a", "a study of many longer words", ["Smith, J."], "1706.03762", None, "2017-01-01", None), ("own", "t", [], None, "10.1234/own", None, None))
    d = docs(spark, "arXiv: 1706.03762 a study of many longer words 10.1234/own").withColumn("own_slug", F.lit("own"))
    assert [(r.slug, r.rule) for r in cite.cascade(d, p).collect()] == [("a", "arxiv")]
    long = papers(spark, ("l", "a study of many longer words and of what they mean to us", [], None, None, None, None))
    near = "a studdy of many longer wordz and of what they mean to us"
    rows = spark.createDataFrame([(0, near), (1, near + " z" * 80)], "doc_id long, text string")
    assert [(r.doc_id, r.rule) for r in cite.cascade(rows, long).collect()] == [(0, "fuzzy title")]  # the gate shuts out the long bibliography
    assert sorted(r.doc_id for r in cite.cascade(rows, long, gate=False).collect()) == [0, 1]


def test_cascade_finds_each_bibliography_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    p = papers(spark, ("a", "a study of many longer words", ["Smith, J."], "1706.03762", "10.1234/a", "2017-01-01", None))
    d = docs(spark, *["References\n arXiv: 1706.03762 by Smith, printed in 2017"] * 5, "a study of many longer words 10.1234/a").select("doc_id", counted("text").alias("text"))
    assert sorted((r.doc_id, r.slug, r.rule) for r in cite.cascade(d, p).collect()) == [(k, "a", "arxiv" if k < 5 else "doi") for k in range(6)]
    assert seen.value == 6


def test_fuzzy_titles_of_bibliographies(spark, tmp_path):
    random.seed(9)
    d = [(k, random.choice(["", "a text"])) for k in [*range(12), *range(100, 1300, 100)]]
    o = [(k, k * 37 % 90 + 1, random.choice(["1-URGENT", "5-LOW", "4-NOT SPECIFIED"]), "O", datetime.date(1995, 1, 1 + k % 28)) for k in [*range(1, 41), *range(101, 1301, 100)]]
    spark.createDataFrame(d, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(o, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    m = catalogue.Model(spark, str(tmp_path))
    known = [(r.slug, r.title) for r in cite.titles(m.papers).collect()]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = set()
    for r in cite.probes(m.cited).collect():
        for slug, t in known:
            n, b = len(t), r.bib_norm
            if n >= 20 and difflib.SequenceMatcher(None, t, b).quick_ratio() >= 0.5 and any(ratio(t, b[i : i + n + 10]) >= 0.85 for i in range(0, max(1, len(b) - n + 1), max(1, n // 2))):
                want.add((r.doc_id, slug))
    assert set(found(cite.by_fuzzy_title(cite.probes(m.cited), m.papers))) == want and want
    want = {(d, slug) for d, slug in want if d % 100 == 0}  # the query's searches
    assert set(found(catalogue.queries()["cite_fuzzy_title"](spark, str(tmp_path)))) == want and want
    rules = {(r.doc_id, r.slug): r.rule for r in catalogue.queries()["cite_cascade_fuzzy"](spark, str(tmp_path)).collect()}
    assert want <= set(rules) and "fuzzy title" in rules.values()


def test_fuzzy_titles_meet_in_blocks(spark, monkeypatch):
    """Titles and texts of any length and characters, with and without the gate, in several blocks and without a theta join."""
    random.seed(15)
    word = lambda: "".join(random.choice("abcdeé1中") for _ in range(random.randint(1, 9)))
    names = [" ".join(word() for _ in range(random.choice((5, 8, 15, 25, 60)))) for _ in range(30)]
    names += ["x" * 64, "y" * 65, "ab" * 32, names[0]]
    texts = [""]
    for t in names * 2:
        b = list(t)
        for _ in range(random.randint(0, len(b) // 8)):
            at = random.randrange(len(b))
            b[at : at + random.choice((0, 1))] = random.choice(([], ["z"], [random.choice("abc")]))
        texts.append(" ".join([word() for _ in range(random.choice((0, 2, 30)))] + ["".join(b)] + [word() for _ in range(random.choice((0, 3)))]).strip())
    p = spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(names)], "slug string, title string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, bib_norm string")
    known = [(r.slug, r.title) for r in cite.titles(p).collect()]
    monkeypatch.setattr(cite, "BLOCK", 20)
    for gate in (True, False):
        want = set()
        for k, b in enumerate(texts):
            for slug, t in known:
                n = len(t)
                if b and (not gate or difflib.SequenceMatcher(None, t, b).quick_ratio() >= 0.5) and any(difflib.SequenceMatcher(None, t, b[i : i + n + 10]).ratio() >= 0.85 for i in range(0, max(1, len(b) - n + 1), max(1, n // 2))):
                    want.add((k, slug))
        got = cite.by_fuzzy_title(d, p, gate)
        assert set(found(got)) == want and len(want) > 25
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_titles_of_one_letters_meet_few_ratios(monkeypatch):
    """Of titles that differ in digits only, halves of their counts leave few to common subsequences, and those they leave are all that match."""
    random.seed(17)
    title = lambda k: f"order {k} the 5 low case of customer {random.randrange(10**6)}"
    names = [title(k) for k in random.sample(range(10**7), 3000)]
    bibs = [f"references 1 arxiv {k * 7 % 10000:04d} 00700v1 doi 10 1234 order {k * 5} {names[k][:-1]}{k % 10} by someone in 1995" for k in range(0, 3000, 60)]
    seen = []
    common = cite._common
    monkeypatch.setattr(cite, "_common", lambda masks, at, sizes, codes: seen.append(len(at)) or common(masks, at, sizes, codes))
    got = cite._fuzzy_block(names, bibs, 0.5)
    assert sum(seen) < 0.02 * len(names) * len(bibs)
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = []
    for d, b in enumerate(bibs[:1]):
        for k, t in enumerate(names):
            n = len(t)
            if any(ratio(t, b[i : i + n + 10]) >= 0.85 for i in range(0, max(1, len(b) - n + 1), n // 2)) and difflib.SequenceMatcher(None, t, b).quick_ratio() >= 0.5:
                want.append((d, k))
    assert [x for x in got if x[0] < 1] == want and want


def test_existing(spark):
    p = papers(spark, ("z", "t", [], "1706.03762", None, None, None), ("a", "t", [], None, "10.1/X", None, "https://E.org"))
    r = spark.createDataFrame([(1, "https://q", "1706.03762v5", None), (2, " https://e.org ", None, None), (3, "https://e.org", "1706.03762", None), (4, "https://n", None, "")], "req_id long, source_url string, arxiv_id string, doi string")
    assert sorted((x.req_id, x.slug) for x in cite.existing_papers(r, p).collect()) == [(1, "z"), (2, "a"), (3, "a")]


def test_finding_slugs_equal_replay(spark):
    random.seed(3)
    statements = [random.choice(["The same", "Same", "other one", "a" * 70 + random.choice("xyz"), "same 2"]) for _ in range(130)]
    had = ["finding-same", "finding-other-one-2"]
    df = spark.createDataFrame(list(enumerate(statements)), "pos long, statement string")
    rows = upserts.finding_slugs(df, spark.createDataFrame([(x,) for x in had], "slug string")).orderBy("pos").collect()
    bases = [r[0] for r in df.orderBy("pos").select(upserts.finding_slug(F.col("statement"))).collect()]
    assert [r.slug for r in rows] == upserts.disambiguate(bases, set(had)) and len(rows) == 130


def test_inserts(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "slug string, v int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "slug string, v int")
    assert sorted(map(tuple, upserts.insert_missing(a, b, "slug").collect())) == [("x", 1), ("y", 2), ("z", 4)]
    assert sorted(map(tuple, upserts.insert_missing(a, b, "slug", True).collect())) == [("x", 1), ("y", 3), ("z", 4)]
    names = spark.createDataFrame([("A/B",), ("A/B",), ("C",)], "name string")
    assert sorted(map(tuple, upserts.stubs(names, spark.createDataFrame([("C",)], "file string")).collect())) == [("A/B", "A-B", True), ("C", "C", False)]
    made = upserts.papers_from(spark.createDataFrame([("T", "2020-01-02", 4, 3, "partial", None)], "title string, publication_date string, credibility int, experimental_rigor int, reproducibility string, overall double"), "2024-05-06").first()
    assert (made.slug, made.overall, made.ingested_date) == ("2020-01-t", 3.5, "2024-05-06")


def test_ratio_and_bounds(spark):
    random.seed(5)
    words = ["tide", "diet", "", "a" * 250]
    rows = [("".join(random.choice("abcd é") for _ in range(random.randint(0, 30))), "".join(random.choice("abcd é") for _ in range(random.randint(0, 30)))) for _ in range(150)] + [(x, y) for x in words for y in words]
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.select("a", "b", seq_ratio("a", "b").alias("r"), bag_bound(F.col("a"), F.col("b"), bag(F.col("a")), bag(F.col("b"))).alias("u")).collect()
    for x in out:
        assert x.r == difflib.SequenceMatcher(None, x.a, x.b).ratio() and x.u >= x.r - 1e-12 and abs(x.u - difflib.SequenceMatcher(None, x.a, x.b).quick_ratio()) < 1e-12


def replayed(rows, threshold=0.92):
    """Star clusters one row after the other."""
    rows = sorted(rows, key=lambda r: r[3])
    of = {}
    for s, t, new, _ in rows:
        if not new or s in of or not t:
            continue
        near = [b for b, u, _, _ in rows if b != s and b not in of and u and difflib.SequenceMatcher(None, t, u).ratio() >= threshold]
        if near:
            of.update(dict.fromkeys([s, *near], s))
    return of


def test_clusters_equal_replay(spark):
    random.seed(6)
    base = ["".join(random.choice("abcdefgh ") for _ in range(60)) for _ in range(6)]
    rows = []
    for k in range(70):
        t = list(random.choice(base))
        for _ in range(random.randint(0, 7)):
            t[random.randrange(60)] = random.choice("xyz12")
        rows.append((f"s{k:03d}", "".join(t).strip(), random.random() < 0.5, f"s{k:03d}.md"))
    df = spark.createDataFrame(rows, "slug string, stmt string, is_new boolean, sort_key string")
    pairs = neardup.similar_pairs(df)
    want = {(a, b) for a, t, new, _ in rows if new for b, u, _, _ in rows if a != b and difflib.SequenceMatcher(None, t, u).ratio() >= 0.92}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    clusters = neardup.star_clusters(df, pairs)
    assert {r.slug: r.cluster for r in clusters.collect()} == replayed(rows)
    groups = {}
    for s, c in replayed(rows).items():
        groups.setdefault(c, []).append(s)
    assert {(r.a, r.b) for r in neardup.cluster_links(clusters).collect()} == {(a, b) for g in groups.values() for a in g for b in g if a < b}


def test_large_classes_and_bounds_of_similar_texts(spark):
    """Equal texts are one row each, not pairs; texts of many different characters, short ones and ones of one letter lose no link."""
    random.seed(12)
    wide = [chr(0x4E00 + k) for k in range(300)]
    texts = []
    for alphabet, n in ((wide, 60), (wide, 260), ("abc ", 199), ("abc ", 200), ("etaoin shrdluxqz", 500), ("a", 300), ("ab", 3), ("e t", 900)):
        for _ in range(3):
            base = [random.choice(alphabet) for _ in range(n)]
            texts.append("".join(base))
            for changes in (1, n // 30, n // 13, n // 12):
                t = list(base)
                for _ in range(changes):
                    at = random.randrange(len(t))
                    t[at : at + random.choice((0, 1))] = random.choice(([], ["x"], [random.choice(alphabet)]))
                texts.append("".join(t))
    texts += ["one text that many rows share"] * 400
    rows = [(f"s{k:04d}", t, k % 2 == 0, f"s{k:04d}.md") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "slug string, stmt string, is_new boolean, sort_key string")
    found = neardup.class_pairs(df).collect()
    assert len(found) < 2000 and sum(r.kind == "member" for r in found) >= 399
    few = {t: s for s, t, _, _ in reversed(rows) if t}
    new = {t for _, t, n, _ in rows if n}
    want = {(few[t], few[u]): r for t in few if t in new for u in few if t != u and (r := difflib.SequenceMatcher(None, t, u).ratio()) >= 0.92}
    assert {(r.a, r.b): r.ratio for r in found if r.kind == "link"} == want and len(want) > 40
    some = df.where("slug < 's0140'")
    assert {r.slug: r.cluster for r in neardup.similar_clusters(some).collect()} == replayed(rows[:140])


def test_stars_take_few_ratios():
    """Of 60 texts that are all near each other each meets the first, not all others; what is not near it is left for its own star."""
    texts = {f"s{k:02d}": f"text {k:02d} " + "of many words that all others share, too" for k in range(60)} | {"s98": "x" * 48, "s99": "x" * 47 + "y"}
    taken = []

    def near(a, b):
        taken.append((a, b))
        return neardup.is_similar(texts[a], texts[b])

    of = neardup.stars_of([(a, b) for a in texts for b in texts if a != b], {k: k for k in texts}, near)
    assert of == {k: "s00" if k < "s98" else "s98" for k in texts} and len(taken) == 62
    for a, b in (("abcd" * 20, "abcd" * 20 + "xy"), ("abcd" * 20, "abcd" * 15 + "x" * 20), ("e t" * 90, "e t" * 89 + "q")):
        assert neardup.is_similar(a, b) == (difflib.SequenceMatcher(None, a, b).ratio() >= 0.92)


def test_bag_pairs_meet_without_a_join_of_rows(spark):
    random.seed(14)
    rows = [(f"s{k:03d}", "".join(random.choice("aabc1é ") for _ in range(random.choice((0, 1, 3, 24, 25, 27, 100)))), k % 3 == 0) for k in range(260)]
    df = neardup.bag_pairs(spark.createDataFrame(rows, "slug string, stmt string, is_new boolean"))
    want = {}
    for a, t, new in rows:
        for b, u, _ in rows:
            if new and a != b and t and u and min(len(t), len(u)) >= 0.92 / 1.08 * max(len(t), len(u)):
                bound = 2.0 * sum(min(t.count(c), u.count(c)) for c in "abc1") + 2.0 * min(sum(c in "é " for c in t), sum(c in "é " for c in u))
                if bound / (len(t) + len(u)) >= 0.92:
                    want[a, b] = bound / (len(t) + len(u))
    assert {(r.a, r.b): r.bound for r in df.collect()} == want and len(want) > 100
    assert "Join Inner" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_bag_pairs_of_long_texts_and_numbers_as_keys(spark):
    """Counts over a byte, several parts of a band, keys of any type."""
    random.seed(19)
    rows = []
    for k in range(120):
        n = random.choice((40, 250, 256, 280, 600, 640))
        rows.append((k, "".join(random.choice("aaaab é9" if k % 2 else "aaab é1") for _ in range(n)), k % 3 == 0))
    rows += [(900, "a" * 700, True), (901, "a" * 690, False), (902, "a" * 700, True)]
    bags = [(k, len(t), {c: sum((x if x in "ab19" else "") == c for x in t) for c in ("a", "b", "1", "9", "")}, new) for k, t, new in rows]
    want = {}
    for a, n, x, new in bags:
        for b, m, y, _ in bags:
            bound = 2.0 * sum(min(x[c], y[c]) for c in x) / (n + m)
            if new and a != b and min(n, m) >= 0.92 / 1.08 * max(n, m) and bound >= 0.92:
                want[a, b] = bound
    got = neardup.bag_pairs(spark.createDataFrame(rows, "id long, stmt string, is_new boolean"), key="id")
    assert {(r.a, r.b): r.bound for r in got.collect()} == want and len(want) > 300 and (900, 901) in want


def test_exact_ratio_is_the_library_s():
    random.seed(13)
    for k in range(600):
        alphabet = random.choice(["ab", "abcdefgh ", "eeeeeeeettttttttaaaaaaa      oinxqz", "".join(chr(0x4E00 + x) for x in range(200))])
        b = [random.choice(alphabet) for _ in range(random.choice((0, 3, 60, 199, 200, 450, 1200)))]
        a = list(b) if k % 4 else [random.choice(alphabet) for _ in range(random.randint(0, 400))]
        for _ in range(random.randint(0, 1 + len(a) // 12)):
            at = random.randrange(len(a) + 1)
            a[at : at + random.choice((0, 1, 9))] = [random.choice(alphabet) for _ in range(random.choice((0, 1, 6)))]
        a, b = "".join(a), "".join(b)
        m = difflib.SequenceMatcher(None, a, b)
        want = m.ratio()
        if a and b:
            assert neardup.exact_ratio(a, b, m.b2j, 0) == want
            got = neardup.exact_ratio(a, b, m.b2j, int(-(-0.92 * (len(a) + len(b)) / 2 // 1)))
            assert got == want if want >= 0.92 else got is None or got == want


def test_long_texts_meet_as_bits_and_take_no_common_subsequence(monkeypatch):
    random.seed(21)
    for _ in range(50):
        x, y = (np.array([random.choice((0, 0, 1, 1, 2, 3, 5, 9, 300)) for _ in range(256)]) for _ in range(2))
        (bits, over), (theirs, rest) = neardup._planes(x), neardup._planes(y)
        both = int(np.minimum(x, y).sum())
        for k in range(neardup.PLANES + 1):
            seen = sum(int(np.bitwise_count(a & b).sum()) for a, b in zip(bits[:k], theirs[:k]))
            assert seen + min(over[k], rest[k]) >= both
    taken = []
    monkeypatch.setattr(neardup, "may_match", lambda *a: taken.append(a) or True)
    text = " ".join(random.choice(("tide", "river", "quiet", "jazz", "exact", "vowel")) for _ in range(90))
    for b in (text, text[:150], text[40:], "".join(random.sample(text, len(text)))):
        assert neardup.is_similar(text, b) == (difflib.SequenceMatcher(None, text, b).ratio() >= 0.92)
    assert [len(a[1]) for a in taken] == [150]


def test_pairs_of_whole_texts(spark, tmp_path):
    random.seed(8)
    words = "tide river quiet jazz exact vowel kind fox maze by of the and in zinc quick".split()
    prose = lambda n: " ".join(random.choice(words) for _ in range(n))
    opening, texts = prose(40), []
    for _ in range(6):
        body = prose(120)
        texts += [opening + " " + body, prose(2) + " " + body, opening[:-9] + " " + body.replace("fox", "foxes", 1), body]
    texts += ["a" * 400] * 3 + ["".join(random.choice("abc") for _ in range(n)) for n in (0, 1, 199, 200)] * 2
    texts += [texts[0], texts[5]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    first = datetime.date(1992, 1, 1)
    new = {k for k in range(len(texts)) if first + datetime.timedelta(k * 997 % 2406) >= datetime.date(1997, 1, 1)}
    want = {}
    for a in new:
        for b, t in enumerate(texts):
            ratio = difflib.SequenceMatcher(None, texts[a], t).ratio()
            if a != b and t and texts[a] and ratio >= 0.92:
                want[f"d{a:012d}", f"d{b:012d}"] = round(ratio, 6)
    rows = neardup.similar_pairs(catalogue._statements(catalogue.Model(spark, str(tmp_path)))).collect()
    assert {(r.a, r.b): round(r.ratio, 6) for r in rows} == want and len(rows) == len(want) > 8
    links = catalogue.queries()["neardup_pairs"](spark, str(tmp_path)).collect()
    assert expanded(links, {f"d{k:012d}" for k in new}) == want
    assert any(0.92 <= r < 1 for r in want.values()) and want["d000000000026", "d000000000024"] == 1
    cut = {(a, b) for a in new for b, t in enumerate(texts) if a != b and t[:160] == texts[a][:160]}
    assert any((f"d{a:012d}", f"d{b:012d}") not in want for a, b in cut)


def test_scope(spark):
    f = spark.createDataFrame([("a", "2024-01-01"), ("b", None)], "slug string, extracted_date string")
    assert [r.is_new for r in neardup.scope(f, since="2024-01-01").collect()] == [True, False]
    assert [r.is_new for r in neardup.scope(f, new_slugs=["b"]).collect()] == [False, True]


def test_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/log.txt").write_text("# head\n2024-01-01 10:05 | lint | v | 3 | more\n2024-01-01 10:40 | lint | v | 0\n2024-01-01 11:00 | init | v | x\n")
    stream = log.read_log(spark, str(tmp_path / "in"))
    log.append_log(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.ts, r.note) for r in rows.collect()) == [("2024-01-01 10:05", "3 | more"), ("2024-01-01 10:40", "0"), ("2024-01-01 11:00", "x")]
    assert sorted((r.action, r.n) for r in log.action_counts(rows).collect()) == [("init", 1), ("lint", 2)]


def test_slots(spark):
    d = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    got = agents.run_slot(d, ["text"], lambda rows: [[{"statement": r["text"], "finding_type": "odd", "quote": "q" * 201}] for r in rows], agents.FINDINGS, "findings")
    assert sorted((r.doc_id, r.problem) for r in agents.validate_findings(got).collect()) == [(1, "long quote"), (1, "unknown finding type"), (2, "long quote"), (2, "unknown finding type")]
    new = spark.createDataFrame([("p", "f1")], "paper string, slug string")
    cands = spark.createDataFrame([("p", "c1")], "paper string, slug string")
    answer = lambda n, c: [{"new_finding": n[0]["slug"], "edges": {"uses": [{"target": c[0]["slug"], "why": "w"}]}}]
    row = agents.link_slot(new, cands, answer).first()
    assert row.new_finding == "f1" and json.loads(json.dumps(row.edges["uses"][0].asDict())) == {"target": "c1", "why": "w"}
