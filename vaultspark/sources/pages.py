"""Slices of paged documents: the reference cut-off, sections by outline and by font size, cue slices; and of HTML sources.

A document is a row (doc_id, pages array<struct<page_no int, text string, lines array<struct<y double, spans array<struct<size double,
text string>>>>>>, toc array<struct<level int, title string, page int>>). Pages are numbered from 0 in page_no, from 1 in toc. All of a
document's pages are in its row, so every slice is a row's expression and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions.text import compact, html_strip

PAGES = "array<struct<page_no:int, text:string, lines:array<struct<y:double, spans:array<struct<size:double, text:string>>>>>>"
TOC = "array<struct<level:int, title:string, page:int>>"
#: What a section's title must hold as a whole word.
BRIEF_CUES = r"(?i)\b(conclusion|discussion|summary|takeaways?)\b"
FINDINGS_CUES = r"(?i)\b(method|methodology|approach|experiment|experimental|evaluation|result|ablation|analysis|conclusion|discussion|summary|takeaways?)\b"
REFERENCES = r"(?im)^\s*(references|bibliography)\s*$"
HEADING_SCALE, HEADING_CHARS, HEADER_CHARS, META_PAGES, META_CHARS = 1.1, 120, 500, 2, 6000


def page_text(page: Column) -> Column:
    return F.concat(F.lit("\n===== PAGE "), (page["page_no"] + 1).cast("string"), F.lit(" =====\n"), page["text"])


def full_text(pages: Column) -> Column:
    return F.array_join(F.transform(pages, page_text), "")


def reference_cutoff(pages: Column) -> Column:
    """The first page with a line that says only references or bibliography; the number of pages without one."""
    return F.coalesce(F.array_min(F.transform(F.filter(pages, lambda p: p["text"].rlike(REFERENCES)), lambda p: p["page_no"])), F.size(pages))


def _range(start: Column, end: Column) -> Column:
    """start .. end - 1, empty if there are none."""
    return F.when(end > start, F.sequence(start, F.greatest(end - 1, start))).otherwise(F.expr("cast(array() as array<int>)"))


def toc_pages(toc: Column, cues: str, cutoff: Column) -> Column:
    """Pages of the outline's sections with a cue, each up to the next entry of its level or above, that entry's page included."""
    def section(entry: Column, at: Column) -> Column:
        later = F.filter(toc, lambda x, k: (k > at) & (x["level"] <= entry["level"]))
        end = F.least(cutoff, F.coalesce(F.get(later, F.lit(0))["page"], cutoff))
        return F.when(entry["title"].rlike(cues), _range(F.greatest(entry["page"] - 1, F.lit(0)), end)).otherwise(F.expr("cast(array() as array<int>)"))

    return F.array_distinct(F.flatten(F.transform(toc, section)))


def body_size(pages: Column, cutoff: Column) -> Column:
    """The span size with the most characters, to one decimal, over the pages up to two past the cut-off; of equals the first met."""
    spans = F.flatten(F.transform(F.filter(pages, lambda p: p["page_no"] < cutoff + 2), lambda p: F.flatten(F.transform(p["lines"], lambda x: x["spans"]))))
    sized = F.transform(spans, lambda s: F.struct(F.round(s["size"], 1).alias("s"), F.length(s["text"]).alias("n")))
    sizes = F.array_distinct(F.transform(sized, lambda s: s["s"]))
    weighed = F.transform(
        sizes,
        lambda s, k: F.struct(
            F.aggregate(F.filter(sized, lambda x: x["s"] == s), F.lit(0), lambda acc, x: acc + x["n"]).alias("n"), (-k).alias("first"), s.alias("s")
        ),
    )
    return F.array_max(weighed)["s"]


def headings(pages: Column, cutoff: Column) -> Column:
    """(page, y, text) of the lines before the cut-off whose largest span is a tenth larger than the body, by place."""
    least = body_size(pages, cutoff) * HEADING_SCALE
    lines = F.flatten(
        F.transform(
            F.filter(pages, lambda p: p["page_no"] < cutoff),
            lambda p: F.transform(
                F.filter(p["lines"], lambda x: F.array_max(F.transform(x["spans"], lambda s: s["size"])) >= least),
                lambda x: F.struct(p["page_no"].alias("page"), x["y"].alias("y"), F.trim(F.array_join(F.transform(x["spans"], lambda s: s["text"]), "")).alias("text")),
            ),
        )
    )
    return F.array_sort(F.filter(lines, lambda h: (h["text"] != "") & (F.length(h["text"]) <= HEADING_CHARS)))


def font_pages(found: Column, cues: str, cutoff: Column) -> Column:
    """Pages of the sections whose headings have a cue, each up to the next heading's page, that page included."""
    def section(h: Column, at: Column) -> Column:
        end = F.least(cutoff, F.coalesce(F.get(found, at + 1)["page"] + 1, cutoff))
        return F.when(h["text"].rlike(cues), _range(h["page"], end)).otherwise(F.expr("cast(array() as array<int>)"))

    return F.array_distinct(F.flatten(F.transform(found, section)))


def header_pages(pages: Column, cues: str, cutoff: Column) -> Column:
    hit = F.filter(pages, lambda p: (p["page_no"] < cutoff) & F.substring(p["text"], 1, HEADER_CHARS).rlike(cues))
    return F.transform(hit, lambda p: p["page_no"])


def with_slices(docs: DataFrame) -> DataFrame:
    """docs with cutoff, brief_pages, findings_pages, full_text, brief_text, findings_text, meta_text and page_count."""
    d = docs.withColumn("cutoff", reference_cutoff(F.col("pages"))).withColumn("_headings", headings(F.col("pages"), F.col("cutoff")))
    for name, cues in (("brief", BRIEF_CUES), ("findings", FINDINGS_CUES)):
        cutoff, pages = F.col("cutoff"), F.col("pages")
        must = F.concat(_range(F.lit(0), F.least(F.lit(3), cutoff)), _range(F.greatest(cutoff - 2, F.lit(0)), cutoff))
        d = d.withColumn("_by", F.array_union(toc_pages(F.col("toc"), cues, cutoff), font_pages(F.col("_headings"), cues, cutoff)))
        d = d.withColumn("_by", F.when(F.size("_by") == 0, header_pages(pages, cues, cutoff)).otherwise(F.col("_by")))
        d = d.withColumn(f"{name}_pages", F.array_sort(F.array_union(must, F.col("_by"))))
        wanted = F.col(f"{name}_pages")
        d = d.withColumn(f"{name}_text", compact(full_text(F.filter(pages, lambda p: F.array_contains(wanted, p["page_no"])))))
    return d.withColumns({
        "full_text": compact(full_text(F.col("pages"))),
        "meta_text": compact(full_text(F.filter(F.col("pages"), lambda p: p["page_no"] < META_PAGES))),
        "page_count": F.size("pages"),
    }).drop("_by", "_headings")


def html_slices(html: Column) -> dict[str, Column]:
    """The slices of an HTML source: all of its compacted text, and its first 6000 characters as the metadata slice."""
    text = compact(html_strip(html))
    return {"full_text": text, "brief_text": text, "findings_text": text, "meta_text": F.substring(text, 1, META_CHARS), "page_count": F.lit(0)}


def is_pdf(content: Column) -> Column:
    return F.startswith(content, F.lit(b"%PDF"))


def html_source(files: DataFrame) -> DataFrame:
    """Binary files (path, content) that are not PDF, decoded with replacement, as (path, slices)."""
    html = F.make_valid_utf8(F.col("content").cast("string"))
    return files.where(~is_pdf(F.col("content"))).select("path", *[c.alias(n) for n, c in html_slices(html).items()])
