"""Slots for model steps. No model is bundled: a slot takes any callable, runs it in batches, and checks the shape of its answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultspark.schema import ENUMS

DRAFT = "struct<key_takeaways:string, background:string, main_idea_and_summary:string, critique:string>"
FINDINGS = "array<struct<statement:string, source_ref:string, finding_type:string, hedging:string, quote:string>>"
METADATA = "struct<title:string, authors:array<string>, fields:array<string>, publication_date:string, arxiv_id:string, doi:string, venue:string, credibility:int, experimental_rigor:int, reproducibility:string, rationale:string>"
EDGES = "map<string,array<struct<target:string, why:string>>>"
#: The longest quote of a finding.
QUOTE_CHARS = 200


def run_slot(docs: DataFrame, inputs: list[str], answer: Callable[[list[dict]], list[dict]], kind: str, to: str = "answer") -> DataFrame:
    """docs with the column `to` of type `kind`: what answer gives for each batch of rows' inputs. An answer that doesn't fit the type is null."""
    names = docs.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = answer(f[inputs].to_dict("records"))
            yield f.assign(_json=[None if x is None else json.dumps(x, ensure_ascii=False) for x in made])

    raw = docs.mapInPandas(run, T.StructType([*docs.schema.fields, T.StructField("_json", T.StringType())]))
    return raw.withColumn(to, F.from_json("_json", kind)).select(*names, to)


def link_slot(new: DataFrame, candidates: DataFrame, answer: Callable[[list[dict], list[dict]], list[dict]], key: str = "paper") -> DataFrame:
    """(new_finding, edges): each paper's new findings with its candidates, given to one call."""

    def run(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        made = answer(a.to_dict("records"), b.to_dict("records")) if len(a) else []
        return pd.DataFrame({"new_finding": [x["new_finding"] for x in made], "_json": [json.dumps(x.get("edges", {}), ensure_ascii=False) for x in made]}, dtype="object")

    return new.groupBy(key).cogroup(candidates.groupBy(key)).applyInPandas(run, "new_finding string, _json string").select("new_finding", F.from_json("_json", EDGES).alias("edges"))


def validate_findings(found: DataFrame) -> DataFrame:
    """Problems (doc_id, pos, problem) of extracted findings (doc_id, findings): no statement, unknown values, quotes that are too long."""
    f = found.select("doc_id", F.posexplode("findings").alias("pos", "f"))
    checks = [
        F.when(F.coalesce(F.trim("f.statement"), F.lit("")) == "", F.lit("no statement")),
        F.when(~F.col("f.finding_type").isin(ENUMS["finding-type"]), F.lit("unknown finding type")),
        F.when(~F.col("f.hedging").isin(ENUMS["hedging"]), F.lit("unknown hedging")),
        F.when(F.length("f.quote") > QUOTE_CHARS, F.lit("long quote")),
    ]
    return f.select("doc_id", "pos", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("problem"))
