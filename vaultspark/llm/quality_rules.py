"""Quality rules with adaptive thresholds.

1. Counts of each text, in one row's SQL expressions. A measure is a count among so many trials: symbols among characters, say.
2. Rates are integers, so the numbers of documents by value are a quantile sketch that merges by addition, is bounded
   (1,001 values a group and measure) and does not depend on how the rows are dealt out.
3. The sketches are merged per language and source, per language, and over all. Quantiles of each give a fence, the rate that a
   usual text keeps below: the upper quantile and SPREAD times its distance from the middle. A group's fence is drawn towards its
   language's, and that towards all, by how few documents there are: n / (n + PRIOR) of it is its own. No constant bounds a fence.
4. The fences join back to the documents. A text fails a rule if its count exceeds what the fence's rate leads one to expect among its
   trials by more than Z standard deviations of such a count (Poisson's, plus one), so one repeated line of three says little.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CAPITALS, MARKS, SPACE, SYMBOLS, cut, held, whole_row

MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
#: Measure: its count, among so many trials, a rate for so many of them.
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 1000),
    "dup_lines": ("n_dup_lines", "_n_lines", 1000),
    "stutter": ("_n_stutter", "n_words", 1000),
    "capitals": ("_n_capitals", "word_chars", 1000),
    "marks": ("_n_marks", "word_chars", 1000),
    "word_len": ("word_chars", "n_words", 10),
}
QUANTILES, SPREAD, PRIOR, Z = (0.5, 0.75), 3, 100, 4
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def measure(docs: DataFrame, text: F.Column, keep: dict[str, F.Column]) -> DataFrame:
    """The columns `keep` with the counts and the rates `m_*`. Words are runs of other than space and U+0009-U+000D."""
    d = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(text.cast("string"), F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.expr(r"transform(filter(split(_t, '[\\x20\\x09-\\x0D]+'), w -> w <> ''), w -> xxhash64(w))"))
    d = d.withColumn("_lines", F.expr(r"filter(split(_t, '\n'), x -> rlike(x, '[^\\x20\\x09-\\x0D]'))"))
    # Few texts have a window twice; only these sort hashes and places, where equal hashes meet.
    eight = ", ".join(f"_w[i + {k}]" for k in range(WINDOW))
    d = d.withColumn("_h", F.expr(f"if(size(_w) > {WINDOW}, transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({eight})), cast(array() as array<bigint>))"))
    d = d.withColumn("_g", F.expr("if(size(array_distinct(_h)) < size(_h), sort_array(transform(_h, (h, i) -> named_struct('h', h, 'i', i))), null)"))
    d = d.withColumn("_n", F.expr("size(_g)"))
    d = d.withColumn("_at", F.expr("sort_array(transform(filter(_g, (x, k) -> (k > 0 and _g[greatest(k - 1, 0)].h = x.h) or (k < _n - 1 and _g[least(k + 1, _n - 1)].h = x.h)), x -> x.i))"))
    repeat = F.expr(f"coalesce(aggregate(_at, named_struct('to', 0, 'n', 0L), (acc, i) -> named_struct('to', i + {WINDOW}, 'n', acc.n + (i + {WINDOW} - greatest(i, acc.to))), acc -> acc.n), 0L)")
    d = d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        held("_t", SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("_n_lines"),
        held("_t", CAPITALS).cast("long").alias("_n_capitals"),
        held("_t", MARKS).cast("long").alias("_n_marks"),
        F.expr("size(filter(_w, (x, k) -> k > 0 and x = _w[greatest(k - 1, 0)]))").cast("long").alias("_n_stutter"),
        repeat.alias("n_repeat_words"),
    )
    return d.withColumns({f"m_{m}": F.expr(f"least(1000, {scale} * {count} div greatest({trials}, 1))") for m, (count, trials, scale) in MEASURES.items()})


def sketch(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """(_lang, _source, m, v, n): how many documents have value v of measure m. Counted before anything is shuffled."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"m_{m}").alias("v")) for m in MEASURES]))
    return measured.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), each.alias("x")).groupBy("_lang", "_source", "x.m", "x.v").agg(F.count("*").alias("n"))


def quantile_fences(sketches: DataFrame) -> DataFrame:
    """(level, _lang, _source, m, n_docs, raw) for each group (0), each language (1) and all (2), from quantiles of merged sketches."""
    part = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("l"), source.alias("s"))
    groups = F.array(part(0, F.col("_lang"), F.col("_source")), part(1, F.col("_lang"), F.lit("")), part(2, F.lit(""), F.lit("")))
    merged = sketches.select(F.explode(groups).alias("g"), "m", "v", "n").groupBy("g", "m", "v").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("g", "m")
    cum = merged.withColumns({"upto": F.sum("n").over(w.orderBy("v")), "total": F.sum("n").over(w)})
    q = [F.min(F.when(F.col("upto") >= F.col("total") * p, F.col("v"))) for p in QUANTILES]
    return (
        cum.groupBy("g", "m").agg(F.max("total").alias("n_docs"), q[0].alias("mid"), q[1].alias("top"))
        .select("g.level", F.col("g.l").alias("_lang"), F.col("g.s").alias("_source"), "m", "n_docs", F.expr(f"top + {SPREAD} * (top - mid)").alias("raw"))
    )


def fences(raw: DataFrame) -> DataFrame:
    """(_lang, _source, m, fence): a group's own fence, drawn towards its language's, drawn towards that of all."""
    level = lambda k, *keys: raw.where(F.col("level") == k).select(*keys, "m", F.col("n_docs").alias(f"n{k}"), F.col("raw").alias(f"r{k}"))
    lang = level(1, "_lang").join(level(2), "m").withColumn("towards", F.expr(f"(n1 * r1 + {PRIOR} * r2) div (n1 + {PRIOR})"))
    return (
        level(0, "_lang", "_source").join(lang.select("_lang", "m", "towards"), ["_lang", "m"])
        .select("_lang", "_source", "m", F.expr(f"(n0 * r0 + {PRIOR} * towards) div (n0 + {PRIOR})").alias("fence"))
    )


def _outside(m: str) -> F.Column:
    count, trials, scale = MEASURES[m]
    # Both sides by the scale, so that all but the square is whole numbers.
    over = f"cast({scale} * {count} - {trials} * _f_{m} as double)"
    return F.expr(f"{over} > 0 and {over} * {over} > {Z * Z} * cast({scale} * ({trials} * _f_{m} + {scale}) as double)")


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all unless given) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    base_failed: under 20 words, or over 30 % of the words lie in 8-word windows that occur more than once in the text.
    kept: not base_failed, and no measure outside its group's fence. A null text has no words and fails. Null languages and
    sources are a group of their own. Repeated rows count, and come back, as often as they occur; ties stay inside the fence.
    Columns of docs named like a result are replaced. An empty table gives an empty result.
    """
    row = whole_row(docs, keep, RESULT)
    lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in (lang_col, source_col))
    marked = cut(measure(docs, F.col(f"`{text_col}`"), {"_row": row, "_lang": lang, "_source": source}), "quality")
    every = fences(cut(quantile_fences(sketch(marked, "_lang", "_source")), "fences"))
    wide = every.groupBy("_lang", "_source").agg(*[F.max(F.when(F.col("m") == m, F.col("fence"))).alias(f"_f_{m}") for m in MEASURES])
    # Written, so its size is known: Spark broadcasts it below its threshold, and else splits a hot group's rows over tasks.
    chosen = cut(wide, "group-fences")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    outside = F.lit(False)
    for m in MEASURES:
        outside = outside | _outside(m)
    return (
        marked.join(chosen, ["_lang", "_source"], "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~outside)
        .select("_row.*", *RESULT)
    )
