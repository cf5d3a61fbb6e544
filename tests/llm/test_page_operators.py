"""Operators on pages, and the pipeline, against plain Python."""

import hashlib
import html
import io
import random
import re
import time
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from vaultspark.llm import html_text
from vaultspark.llm.html_text import extract_text, main_text
from vaultspark.llm.queries import oracle_sql, queries
from vaultspark.llm.url_rules import BASE_RULES, judge_urls, rule_table
from vaultspark.llm.warc_zstd import MAGIC, archive_round_trip, read_archive, record, write_archive

from .test_text_operators import brute_classes


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, "a"), (2, "no scheme", "", "b"), (3, "http://Ex.COM/a b", "<p>" + "word, " * 50000, "c"), (4, "https://x.net/es/1", "<p>" + "y" * 2000, "d"), (4, "https://x.net/es/1", "<p>" + "y" * 2000, "d"), (7, "http://", "<p>" + "y" * 2000, "e"), (None, "http://é.net/fr/", "<p>z", "f")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")


def test_archive_of_records():
    rng = random.Random(1)
    some = [record(k, f"http://h/{k}", (" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(300))).encode(), 1, "d", None if k % 3 else k + 1) for k in range(200)]
    out = io.BytesIO()
    assert write_archive(out, iter(some)) == 200
    raw = out.getvalue()
    assert int.from_bytes(raw[:4], "little") == MAGIC and len(raw) < sum(map(len, some)) / 3
    back = list(read_archive(io.BytesIO(raw)))
    assert [h["X-Page-ID"] for h, _ in back] == [str(k) for k in range(200)] and all(r.endswith(b + b"\r\n\r\n") for r, (_, b) in zip(some, back, strict=True))
    with pytest.raises(Exception):
        list(read_archive(io.BytesIO(raw[:-5])))
    few = io.BytesIO()
    write_archive(few, iter(some[:2]))
    assert len(list(read_archive(io.BytesIO(few.getvalue())))) == 2 and list(read_archive(io.BytesIO(b""))) == []


def test_archives_of_odd_rows(odd):
    rows = {}
    for r in archive_round_trip(odd).collect():
        rows.setdefault(r.page_id, []).append(r)
    assert [r.record_type for r in rows[4]] == ["revisit"] * 2 and rows[4][0].refers_to == 7 and rows[7][0].record_type == "response"
    assert rows[4][0].payload_bytes == 2003 and rows[4][0].payload_digest == hashlib.sha1(b"<p>" + b"y" * 2000).hexdigest()
    assert rows[1][0].payload_bytes == 0 and rows[None][0].record_type == "response"
    assert archive_round_trip(odd.limit(0)).count() == 0


def test_urls_of_odd_rows(odd):
    rows = {r.page_id: r for r in judge_urls(odd).collect()}
    assert (rows[1].host, rows[1].path, rows[1].rule, rows[1].verdict) == ("", "", None, "allow")
    assert (rows[3].host, rows[3].path, rows[3].rule) == ("ex.com", "/a b", "com/") and rows[4].verdict == "block" and rows[7].host == ""
    assert judge_urls(odd).count() == 7 and judge_urls(odd.limit(0)).count() == 0


def judge(host, path, rules, default="allow"):
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: (f[0], f[1], f[3] == "block"), default=None)
    return (best[2], best[3]) if best else (None, default)


@pytest.mark.parametrize("ranges", [1, 37])
def test_nested_rules_equal_brute_force(spark, ranges):
    rng = random.Random(ranges)
    label = lambda: rng.choice(["a", "b", "ab", "c-d", "e"])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(label() for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(60))}.values()) + [("", "/a", "block")]
    urls = [(k, f"http://{host()}{path()}") for k in range(600)] + [(1000 + k, "http://a.b/hot") for k in range(600)]
    rows = judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rule_table(spark, rules), ranges=ranges).collect()
    assert len(rows) == 1200
    for r in rows:
        assert (r.rule, r.verdict) == judge(r.host, r.path, rules)


def test_base_rules():
    assert judge("www.example.com", "/en/x", BASE_RULES) == ("www.example.com/en/", "allow")


ARTICLES = {
    "": "",
    "plain & simple": "plain & simple",
    "<body><nav><a href=1>m</a></nav><article><h1>T&eacute;st</h1><p><b>One, two.<br><p>Three<script>var a='</p>'</script></p></article><footer>x</footer>": "Tést One, two. Three",
    '<div id="content"><p>One, two, three words in a longer paragraph.<p>Two <b>bold</b>ed</div><div class="sidebar"><p>Nope, nope, nope, nope, nope nope.</div><section id=comments><p>I, say, this, much, all, day.</section>': "One, two, three words in a longer paragraph. Two bolded",
    "<main><section><p>First, part of text.</p></section><section><h2>H</h2><ul><li>i<li>j</ul><table><tr><td>c<td>d</table></section></main>": "First, part of text. H i j c d",
    "<body><p>" + "a, " * 40 + "</p><p>short</p><ul><li><a href=1>x y z</a><li><a>b</a><li><a>c</a></ul>": ("a, " * 40).strip() + " short",
    "<article><p>text, here<aside>no</aside><div class='cookie-notice'>no</div><form>f<input></form></article>": "text, here",
    "<p>1 < 2 and <b>3 > 2</p>": "1 < 2 and 3 > 2",
    "<article><p>a&nbsp;&nbsp;b\n c</p></article>": "a b c",
    "<div class='site-header'><p>Site, name, here, and, much, more, of, it.</p></div><div id='main'><h1>T</h1><div class='part'><p>" + "word, " * 60 + "</p></div><div><p>end.</p></div><ins class='adsbygoogle'>buy</ins></div><div class='reader-responses'><p>I, too.</p></div>": "T " + ("word, " * 60).strip() + " end.",
    "<article><!-- x --><p hidden>no</p><p style='display: none'>no</p><p>yes</article>": "yes",
}


@pytest.mark.parametrize("page", ARTICLES)
def test_main_text(page):
    assert main_text(page) == ARTICLES[page]


LONG = "One, two, three words in a longer paragraph of the main text. " * 5


@pytest.mark.parametrize("names", ["content has-sidebar", "with-sidebar", "layout-no-sidebar", "entry no-comments", "post hentry category-legal", "post type-post tag-social", "side-by-side", "search-results", "page-widget"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_do_not_drop_the_main_text(tag, names):
    page = f"<body><div class='site-menu'><a href=1>m</a></div><{tag} class='{names}'><h1>T</h1><p>{LONG}</p><div class='related-box'>no</div></{tag}><div class='sidebar'><p>No, no, no.</p></div></body>"
    assert main_text(page) == "T " + LONG.strip()


def test_forms_and_links_of_the_main_text():
    links = "".join(f"<li><a href={k}>link {k}</a>" for k in range(4))
    assert main_text(f"<body><form id=aspnetForm><input><div><p>{LONG}</p></div></form><form><p>Mail, name.</p></form>") == LONG.strip()
    assert main_text(f"<article><p>{LONG}</p><ul>{links}</ul></article><ul>{links}</ul>") == LONG + "link 0 link 1 link 2 link 3"
    assert main_text(f"<div><p>{LONG}</p><div class='comments-area'><p>{LONG * 3}</p></div></div>") == LONG.strip()


@pytest.mark.parametrize("names", ["content no-sidebar", "has-sidebar", "post comments-open", "entry comment-enabled", "related-to-law", "alert story", "legal", "post side"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_only_weigh_where_they_hold_the_text(tag, names):
    assert main_text(f"<body><nav><a href=1>m</a></nav><{tag} class='{names}'><p>{LONG * 2}</p></{tag}><footer>f</footer></body>") == (LONG * 2).strip()


TEASERS = "".join(f"<article><h2>Teaser {k}</h2><p>Short words.</p><a href={k}>more</a></article>" for k in range(3))
SCORED = {
    f"<body><div>{TEASERS}</div><article><h1>T</h1><p>{LONG}</p></article></body>": "T " + LONG.strip(),
    f"<body><div><a href=1>{LONG}</a></div><div><h1>T</h1><p>{LONG}</p></div></body>": "T " + LONG.strip(),
    f"<table><tr><td><a href=1>a</a><td>{LONG}<td>x</table>": LONG.strip(),
}


@pytest.mark.parametrize("page", SCORED)
def test_scores_decide(page, monkeypatch):
    assert SCORED[page] in main_text(page) and len(main_text(page)) <= len(SCORED[page]) + 5
    monkeypatch.setattr(html_text, "_value", lambda x: 1.0)
    assert main_text(page) != SCORED[page]


def test_scores_equal_brute_force():
    """Random trees of div, section and article with paragraphs and links: each container's value by the definition, and the text of the best one."""
    rng = random.Random(9)
    for _ in range(60):
        names, paragraphs = [], []  # containers: (tag, names), each paragraph: (ancestors' numbers, text, linked)

        def build(depth, path, names=names, paragraphs=paragraphs):
            out = ""
            for _ in range(rng.randint(1, 3)):
                if depth and rng.random() < 0.6:
                    tag, name = rng.choice(["div", "section", "article", "main"]), rng.choice(["", "content", "wide"])
                    names.append((tag, name))
                    out += f"<{tag} class='{name}'>{build(depth - 1, [*path, len(names) - 1])}</{tag}>"
                else:
                    text = "".join(rng.choice(["word ", "and, ", "more "]) for _ in range(rng.randint(1, 60))).strip()
                    linked = rng.random() < 0.2
                    paragraphs.append((path, text, linked))
                    out += f"<p>{f'<a href=x>{text}</a>' if linked else text}</p>"
            return out

        page = build(5, [])
        points, size, links = Counter(), Counter(), Counter()
        for path, text, linked in paragraphs:
            worth = 0 if linked else min(len(text) / 100, 3) + text.count(",") + (1 if len(text) >= 25 else 0.1)
            for level, x in enumerate([*path[::-1][:5]], 1):
                points[x] += worth / level
            for x in path:
                size[x] += len(text)
                links[x] += len(text) * linked
        weight = lambda x: {"article": 1.5, "main": 1.25}.get(names[x][0], 1) * (1.25 if names[x][1] == "content" else 1)
        want = [points[x] * weight(x) * (1 - links[x] / size[x] if size[x] else 1) for x in range(len(names))]
        nodes = html_text.parse(page)
        html_text._score(nodes)
        assert [html_text._value(x) for x in nodes if x.tag in ("div", "section", "article", "main")] == pytest.approx(want)


def test_long_and_deep_pages_take_linear_time():
    for page in ("<div>" * 100_000 + "deep, text" + "</div>" * 100_000, '<a href="x>' * 20_000, "<p>" + "<b>" * 50_000 + "x, y" + "</i>" * 50_000, "<table><tr><td>" * 30_000):
        began = time.process_time()
        assert isinstance(main_text(page), str) and time.process_time() - began < 5


def test_main_text_of_articles(pages):
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert main_text(r.html) == " ".join(b for b in blocks if b)


def test_broken_markup_ends():
    rng = random.Random(3)
    for _ in range(300):
        page = "".join(rng.choice(["<p>", "</div>", "<div class='", '"', "a, b", "&amp", "<", ">", "<li>", "</ul>", "<script>", "<td>", "<!--", "é "]) for _ in range(60))
        assert isinstance(main_text(page), str)
    assert main_text("<div>" * 5000 + "deep, text" + "</div>" * 5000) == "deep, text"


def test_extract_of_odd_rows(odd):
    rows = extract_text(odd).collect()
    assert len(rows) == 7 and all(r.n_chars == len(r.text) for r in rows) and extract_text(odd.limit(0)).count() == 0


def test_queries_with_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        got = queries()[name](spark, sf_dir)
        want = con.execute(sql)
        cols = [d[0] for d in want.description]
        assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inside = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, inside, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        kept.append({r.doc_id for r in rows})
        if name == "ngram_jaccard":
            classes = brute_classes({r.doc_id: r.text for r in inside.collect()})
            assert kept[-1] == {c for c, _, _ in classes.values()}
        inside = spark.createDataFrame(rows, docs.schema)
    assert kept[0] > kept[1] > kept[2]
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    usual = {k for k in clean if words.get(k, 0) >= 20}
    assert len(usual & kept[1]) >= 0.95 * len(usual)
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept[2]
    assert corpus_pipeline.ORACLE_SQL is None and public_tokenizers.path("word_bpe_49k.json")


def test_stages_pass_on_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "'x' as kept", "'y' as accepted", "7 as n_words", "'z' as _kept", "0 as class_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert [tuple(r) for r in out.select("kept", "accepted", "n_words", "_kept", "class_id").distinct().collect()] == [("x", "y", 7, "z", 0)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicate_stage_of_repeated_rows(spark):
    """Null ids stay, equal rows become one, of an id with several texts all stay if it heads a class."""
    rows = [(1, "same words in here today"), (1, "same words in here today"), (2, "same words in here today"), (None, "quite another text is this"), (None, "same words in here today"), (3, None), (3, "a b c d e f"), (4, "A, b c d e f!")]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS)
    for _ in range(2):
        got = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
        assert got == [("1", "same words in here today"), ("3", "None"), ("3", "a b c d e f"), ("None", "quite another text is this"), ("None", "same words in here today")]


def test_stages_of_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and very long texts, ties and repeated rows; and no rows at all."""
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(10**6)) for _ in range(n)) + "."
    long = prose(150_000)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, prose(60), None, None, None), (None, prose(50), "en", None, 5), (5, long, "en", "s", 7), (6, prose(80), "en", "s", 1), (6, prose(80), "en", "s", 1), (7, "\n \t", "", "", 0)]
    rows += [rows[5]] * 2
    df = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.rules(spark, df, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "5", "6", "6", "6", "6", "None"] and {len(r.text) for r in kept} >= {len(long)}
    accepted = corpus_pipeline.quality_classifier(spark, df, sf_dir).collect()
    assert {tuple(r) for r in accepted} <= set(rows) and sum(r == rows[5] for r in map(tuple, accepted)) in (0, 3)
    heads = corpus_pipeline.near_duplicates(spark, df, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in heads) == ["1", "2", "3", "5", "6", "6", "7", "None"]
    packed = corpus_pipeline.packing(spark, df, sf_dir).collect()
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert total[1] == total[2] == total[7] == 1 and total[5] > 150_000
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), sf_dir).count() == 0


def test_run_on_no_documents(spark, sf_dir, tmp_path):
    import shutil

    shutil.copy(f"{sf_dir}/labels.parquet", tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
