"""Scalar functions on literal cases."""

from pyspark.sql import functions as F

from vaultspark.functions import text as X
from vaultspark.sources.classify import classify, to_fetch


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select(F.monotonically_increasing_id().alias("k"), f(F.col("v")).alias("o")).orderBy("k").collect()
    return [r.o for r in rows]


def test_kebab(spark):
    assert one(spark, X.kebab, "Attention Is All You Need", "α→β!", "--a--b--", "x" * 59 + " y", "") == ["attention-is-all-you-need", "alphatobeta", "a-b", "x" * 59, ""]


def test_paper_slug(spark):
    df = spark.createDataFrame([("A title", "2017-06-12"), ("A title", "June"), ("A title", None)], "t string, d string")
    assert [r[0] for r in df.select(X.paper_slug(F.col("t"), F.col("d"), "2024-03-01")).collect()] == ["2017-06-a-title", "2024-03-a-title", "2024-03-a-title"]


def test_finding_slug(spark):
    assert one(spark, X.finding_slug, "The a b", "A the b", "Is it") == ["finding-b", "finding-the-b", "finding-it"]


def test_normalize(spark):
    assert one(spark, X.normalize, "O(n²) — É_x y\x1cz", None, "  ") == ["o n² é_x y z", "", ""]


def test_links(spark):
    assert one(spark, X.links, "[[a|b]] [[a#h]] [[]] [[c]] [[c]]") == [["a", "a", "c", "c"]]
    assert one(spark, X.unwrap_link, " [[a|b]] ", "[[a#h]]", "bare", "[[x ]]") == ["a", "a", "bare", "x"]
    assert one(spark, X.wrap_link, "a", "[[a]]", " b ") == ["[[a]]", "[[a]]", "[[b]]"]
    assert one(spark, lambda c: X.wrap_link(X.unwrap_link(X.wrap_link(c))), "a b") == ["[[a b]]"]


def test_compact(spark):
    assert one(spark, X.compact, "x [1] y [2, 3] z [4-6] [5–7]\n\n\n\n[a]") == ["x y z \n\n[a]"]


def test_html(spark):
    assert one(spark, X.html_strip, '<p>a<script>var t="</p>";</script>&amp; <STYLE>x\ny</STYLE>b</p>') == ["a&amp; b"]


def test_bibliography(spark):
    assert one(spark, X.bibliography, "x\n 7. References \n[1]", "no heading", "x references y") == ["\n 7. References \n[1]", "no heading", "x references y"]


def test_reference_ids(spark):
    assert one(spark, X.arxiv_refs, "arXiv: 1706.03762v5, abs/2101.00001") == [["1706.03762", "2101.00001"]]
    assert one(spark, X.doi_refs, "doi 10.1234/ABC.), (10.99/x)") == [["10.1234/abc"]]


def test_overall(spark):
    df = spark.createDataFrame([(5, 5, "code-released"), (4, 3, "partial"), (1, 1, None), (None, 1, "none")], "c int, r int, p string")
    assert [r[0] for r in df.select(X.overall_quality(F.col("c"), F.col("r"), F.col("p"))).collect()] == [5.0, 3.5, 1.0, None]


def test_dates(spark):
    assert one(spark, X.is_iso, "2024-99-99", "2024-1-1", "x2024-01-01") == [True, False, False]


def test_small_functions(spark):
    assert one(spark, X.file_name, "a/b") == ["a-b"] and one(spark, X.pdf_url, "1706.03762v5") == ["https://arxiv.org/pdf/1706.03762.pdf"]
    assert one(spark, lambda c: X.identity(c, True), " 1706.1V2 ", "1706.1v2", "") == ["1706.1v2", "1706.1", None]
    assert one(spark, lambda c: X.split_list(c, ";"), "a; b,c;;") == [["a", "b,c"]]
    assert one(spark, lambda c: X.render(c, {"NAME": F.lit("z")}), "{{NAME}}-{{OTHER}}") == ["z-{{OTHER}}"]
    assert one(spark, lambda c: X.falsy_to(c, F.lit("stem")), "", None, "s") == ["stem", "stem", "s"]


def test_classify(spark):
    cases = ["2101.00001", "2101.00001v2", "https://arxiv.org/abs/2101.00001v3", "10.1/x", "https://doi.org/10.1/x", "https://e.org", "junk"]
    got = one(spark, classify, *cases)
    assert [g.source_type for g in got] == ["arxiv", "arxiv", "arxiv", "doi", "doi", "url", "error"]
    assert got[1].source_url == "https://arxiv.org/abs/2101.00001v2" and got[2].arxiv_id == "2101.00001v3" and got[4].doi == "10.1/x"


def test_cache(spark):
    r = spark.createDataFrame([("u", False), ("v", False), ("u", True)], "source_url string, force boolean")
    cache = spark.createDataFrame([("u",)], "u string").select(X.sha_key(F.col("u")).alias("sha"))
    assert sorted((x.source_url, x.force) for x in to_fetch(r, cache).collect()) == [("u", True), ("v", False)]


def test_functions_in_sql(spark):
    from vaultspark.functions.registry import register

    register(spark)
    row = spark.sql("SELECT kebab('Attention Is: All', 60) AS k, normalize_text('O(n²) — É') AS n, unwrap_link(' [[a|b]] ') AS u, seq_ratio('tide', 'diet') AS r").first()
    assert (row.k, row.n, row.u, row.r) == ("attention-is-all", "o n² é", "a", 0.25)
