"""Inserts into entity tables: papers, findings with their slugs made unique, stubs, and the log."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultspark.functions.text import file_name, finding_slug, overall_quality, paper_slug, wrap_link

#: How far a disambiguated slug keeps its base, and the last number tried.
BASE_CHARS, LAST = 56, 99


def papers_from(payload: DataFrame, as_of: str) -> DataFrame:
    """Rows (title, publication_date, credibility, experimental_rigor, reproducibility, overall, slug, ...) with what is derived filled in: slug, overall, dates."""
    have = set(payload.columns)
    slug = paper_slug(F.col("title"), F.col("publication_date"), as_of)
    score = overall_quality(F.col("credibility"), F.col("experimental_rigor"), F.col("reproducibility"))
    return payload.withColumns({
        "slug": F.coalesce(F.nullif(F.col("slug"), F.lit("")), slug) if "slug" in have else slug,
        "overall": F.coalesce(F.col("overall"), score) if "overall" in have else score,
        "ingested_date": F.lit(as_of),
        "ingest_mode": F.lit("lite"),
    })


def insert_missing(existing: DataFrame, new: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """existing with the rows of new whose key it lacks; with overwrite, with all of new in place of equal keys."""
    if overwrite:
        return existing.join(new.select(key), key, "left_anti").select(existing.columns).unionByName(new.select(existing.columns))
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(existing.columns))


def refused(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key exists already."""
    return new.join(existing.select(key), key, "left_semi")


def disambiguate(bases: list[str], taken: set[str]) -> list[str]:
    """Slugs in order: the base, or its first 56 characters with -2, -3 and so on until none has it; at 99 the last one tried stays."""
    seen, out = set(taken), []
    for base in bases:
        slug, i = base, 2
        while slug in seen:
            slug = f"{base[:BASE_CHARS]}-{i}"
            i += 1
            if i > LAST:
                break
        seen.add(slug)
        out.append(slug)
    return out


def _family(slug: str) -> Column:
    """What all slugs that can meet have in common: the first 56 characters without the numbers at their end."""
    return F.regexp_replace(F.substring(slug, 1, BASE_CHARS), "(-[0-9]{0,2})+$", "")


def finding_slugs(batch: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """batch (pos, statement, ...) with unique slugs in order of pos. Slugs only meet inside a family, so each family with more than one is a replay of its own."""
    df = batch.withColumn("base", finding_slug(F.col("statement"))).withColumn("_stem", _family("base"))
    had = existing.select(F.col("slug").alias("base")) if existing is not None else batch.sparkSession.createDataFrame([], "base string")
    stems = had.withColumn("_stem", _family("base"))
    schema = T.StructType([*df.schema.fields, T.StructField("slug", T.StringType())])

    def replay(key, rows: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        rows["slug"] = disambiguate(rows["base"].tolist(), set(old["base"]))
        text = [f.name for f in schema if f.dataType == T.StringType()]
        return rows.astype(dict.fromkeys(text, object))

    # A base that is alone and new is its own slug.
    clash = df.groupBy("_stem").count().where("count > 1").select("_stem").union(stems.select("_stem")).distinct()
    alone = df.join(clash, "_stem", "left_anti").withColumn("slug", F.col("base"))
    many = df.join(clash, "_stem", "left_semi").select(df.columns).groupBy("_stem").cogroup(stems.groupBy("_stem")).applyInPandas(replay, schema)
    return alone.select(schema.names).unionByName(many).drop("base", "_stem")


def finding_rows(batch: DataFrame, source_paper: Column, as_of: str) -> DataFrame:
    """Findings with defaults: empirical, asserted, the statement as the quote, no relations."""
    return batch.withColumns({
        "type": F.lit("finding"),
        "source_paper": source_paper,
        "source_ref": F.coalesce("source_ref", F.lit("")),
        "finding_type": F.coalesce("finding_type", F.lit("empirical")),
        "hedging": F.coalesce("hedging", F.lit("asserted")),
        "quote": F.coalesce(F.nullif(F.col("quote"), F.lit("")), F.col("statement")),
        "extracted_date": F.lit(as_of),
    })


def stubs(names: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, file, created) for each different name: whether its file is new."""
    asked = names.select("name").distinct().withColumn("file", file_name(F.col("name")))
    had = existing.select("file").distinct().withColumn("_had", F.lit(True))
    return asked.join(had, "file", "left").select("name", "file", F.col("_had").isNull().alias("created"))


def log_line(ts: Column, action: Column, target: Column, note: Column) -> Column:
    return F.concat_ws(" | ", ts, action, target, note)


def parse_log(lines: DataFrame) -> DataFrame:
    """(ts, action, target, note) of lines (value); lines that aren't of four parts are left out, later bars belong to the note."""
    p = F.split("value", r" \| ", 4)
    names = ["ts", "action", "target", "note"]
    return lines.select(p.alias("p")).where(F.size("p") == 4).select(*[F.col("p")[k].alias(n) for k, n in enumerate(names)])


def paper_body(title: Column, sections: dict[str, Column]) -> Column:
    """Markdown body: the title, then each section under its heading, with its end trimmed."""
    parts = [F.concat(F.lit("\n# "), title, F.lit("\n"))]
    for name, text in sections.items():
        parts.append(F.concat(F.lit(f"\n## {name}\n\n"), F.regexp_replace(text, r"\s+$", ""), F.lit("\n")))
    return F.concat(*parts)


def link_list(c: Column) -> Column:
    return F.transform(c, wrap_link)


def files_of(rows: DataFrame, front: Column, stem: str = "slug", body: str = "body") -> DataFrame:
    """(stem, front as JSON, body) for the vault's file writer."""
    return rows.select(F.col(stem).alias("stem"), F.to_json(front).alias("front"), F.col(body).alias("body"))
