"""Source references: arXiv ids and URLs, DOIs and DOI URLs, other URLs, local files; and the cache of fetched ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions.text import sha_key, strip

#: The forms a reference may take.
ARXIV_ID = r"^\d{4}\.\d{4,5}(v\d+)?$"
ARXIV_URL = r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?)"
DOI = r"^10\.[^\s/]+/[^\s]+$"
DOI_URL = r"(?i)doi\.org/(10\.[^\s/]+/[^\s]+)"


def classify(c: Column, is_local_pdf: Column | None = None) -> Column:
    """struct(source_type, source_url, arxiv_id, doi); the type of what fits none is 'error'. The first form that fits wins."""
    s = strip(c)
    arxiv = F.when(s.rlike(ARXIV_ID), s).otherwise(F.nullif(F.regexp_extract(s, ARXIV_URL, 1), F.lit("")))
    doi = F.when(s.rlike(DOI), s).otherwise(F.nullif(F.regexp_extract(s, DOI_URL, 1), F.lit("")))
    none = F.lit(None).cast("string")

    def made(kind: str, url: Column, a: Column = none, d: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("source_type"), url.alias("source_url"), a.alias("arxiv_id"), d.alias("doi"))

    found = (
        F.when(arxiv.isNotNull(), made("arxiv", F.concat(F.lit("https://arxiv.org/abs/"), arxiv), arxiv))
        .when(doi.isNotNull(), made("doi", F.concat(F.lit("https://doi.org/"), doi), none, doi))
        .when(s.rlike("^https?://"), made("url", s))
        .otherwise(made("error", none))
    )
    return found if is_local_pdf is None else F.when(is_local_pdf, made("pdf", s)).otherwise(found)


def to_fetch(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (source_url, force) whose key is not in cache (sha), unless forced, with their sha."""
    keyed = requests.withColumn("sha", sha_key(F.col("source_url")))
    return keyed.where("force").unionByName(keyed.where("not force").join(cache.select("sha"), "sha", "left_anti").select(keyed.columns))
