"""Fetching sources: the one step that leaves Spark SQL. Rows are fetched in batches on executors; what fails is a row with its error."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions.text import pdf_url
from vaultspark.sources import pages

try:
    import fitz
except ImportError:
    fitz = None

TIMEOUT = 60


def fetch_url(source: Column) -> Column:
    """What to fetch for a classified source: an arXiv id's file without its version, else the URL itself."""
    return F.when(source["source_type"] == "arxiv", pdf_url(source["arxiv_id"])).otherwise(source["source_url"])


def download(requests: DataFrame, timeout: int = TIMEOUT) -> DataFrame:
    """(sha, path, content, error) of requests (sha, url)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            content, error = [], []
            for url in f["url"]:
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "vaultspark/0.1"}), timeout=timeout) as r:
                        content.append(r.read())
                        error.append(None)
                except (urllib.error.URLError, ValueError, OSError) as e:
                    content.append(None)
                    error.append(str(e))
            yield pd.DataFrame({"sha": f["sha"], "path": f["url"], "content": pd.Series(content, dtype="object"), "error": pd.Series(error, dtype="object")})

    return requests.select("sha", "url").mapInPandas(run, "sha string, path string, content binary, error string")


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, pages, toc) of PDF files (path, content). Needs a PDF library on the executors; the page model is what everything else works on."""
    if fitz is None:
        raise ImportError("no PDF library is installed; give documents in the page model instead")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for raw in f["content"]:
                doc = fitz.open(stream=raw, filetype="pdf")
                found = []
                for k in range(doc.page_count):
                    lines = [x for b in doc[k].get_text("dict")["blocks"] if b.get("type") == 0 for x in b["lines"]]
                    found.append({"page_no": k, "text": doc[k].get_text("text"), "lines": [{"y": x["bbox"][1], "spans": [{"size": s["size"], "text": s["text"]} for s in x["spans"]]} for x in lines]})
                out.append((found, [{"level": a, "title": b, "page": c} for a, b, c, *_ in doc.get_toc()]))
            yield pd.DataFrame({"path": f["path"], "pages": [a for a, _ in out], "toc": [b for _, b in out]})

    return files.where(pages.is_pdf(F.col("content"))).select("path", "content").mapInPandas(run, f"path string, pages {pages.PAGES}, toc {pages.TOC}")
