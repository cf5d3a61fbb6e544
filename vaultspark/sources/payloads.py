"""JSON payloads between stages, each read with the schema of its stage, and results written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FINDING = "struct<statement:string, `source-ref`:string, `finding-type`:string, hedging:string, quote:string>"
_METADATA = (
    "struct<title:string, slug:string, authors:array<string>, fields:array<string>, `publication-date`:string, `arxiv-id`:string, doi:string, venue:string, "
    "quality:struct<credibility:int, `experimental-rigor`:int, reproducibility:string, overall:double, rationale:string>>"
)
_RELATIONS = "struct<cites:array<string>, `builds-on`:array<string>, supports:array<string>, contradicts:array<string>, extends:array<string>, `similar-to`:array<string>>"
SCHEMAS = {
    "paper": f"vault_path string, source_url string, metadata {_METADATA}, sections struct<key_takeaways:string, background:string, main_idea_and_summary:string, critique:string>, findings array<string>, relations {_RELATIONS}, overwrite boolean",
    "findings": f"vault_path string, source_paper string, fields array<string>, findings array<{_FINDING}>, overwrite boolean",
    "stubs": "vault_path string, authors array<string>, fields array<string>",
    "edges": "vault_path string, new_paper string, cites array<string>, linker_output array<struct<new_finding:string, edges:map<string,array<string>>>>",
    "papers": "slug string, title string, authors array<string>, `arxiv-id` string, doi string, `publication-date` string",
}


def read_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Payloads of a kind, one document or list a file. A file that is not JSON ends the read."""
    return spark.read.schema(SCHEMAS[kind]).option("multiLine", True).option("mode", "FAILFAST").json(path)


def from_text(rows: DataFrame, kind: str, text: str = "value") -> DataFrame:
    """Payloads of a kind in a text column."""
    return rows.select(F.from_json(text, f"struct<{', '.join(_colon(SCHEMAS[kind]))}>").alias("p")).select("p.*")


def _colon(ddl: str) -> list[str]:
    """Top-level fields of a DDL as struct fields."""
    out, depth, part = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += c
    return out


def edge_payload(payload: DataFrame) -> DataFrame:
    """(new_paper, src, etype, dst) of edge payloads; an edge's target stands alone or in an object with its reason."""
    each = payload.select("new_paper", F.explode("linker_output").alias("o")).select("new_paper", F.col("o.new_finding").alias("src"), F.explode("o.edges").alias("etype", "to"))
    target = F.explode("to").alias("raw")
    return each.select("new_paper", "src", "etype", target).withColumn("dst", F.when(F.startswith("raw", F.lit("{")), F.get_json_object("raw", "$.target")).otherwise(F.col("raw"))).drop("raw")


def finding_payload(payload: DataFrame) -> DataFrame:
    """(source_paper, fields, pos, statement, source_ref, finding_type, hedging, quote), a row for each finding in order."""
    f = payload.select("source_paper", "fields", F.posexplode("findings").alias("pos", "f"))
    names = {"statement": "statement", "source-ref": "source_ref", "finding-type": "finding_type", "hedging": "hedging", "quote": "quote"}
    return f.select("source_paper", "fields", "pos", *[F.col("f").getField(a).alias(b) for a, b in names.items()])


def to_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
