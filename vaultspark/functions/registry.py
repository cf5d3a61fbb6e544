"""The engine's functions by name in SQL: native ones as SQL functions, the ratio as a vectorised one."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vaultspark.functions.similarity import seq_ratio
from vaultspark.functions.text import NOT_WORD_OR_SPACE, SPACE

_QUOTED = {k: v.replace("\\", "\\\\") for k, v in (("space", SPACE), ("odd", NOT_WORD_OR_SPACE))}
SQL_FUNCTIONS = {
    "kebab(t STRING, n INT)": "rtrim('-', substring(trim(BOTH '-' FROM regexp_replace(replace(replace(replace(lower(t), 'α', 'alpha'), 'β', 'beta'), '→', 'to'), '[^a-z0-9]+', '-')), 1, n))",
    "normalize_text(t STRING)": f"trim(regexp_replace(regexp_replace(lower(coalesce(t, '')), '{_QUOTED['odd']}', ' '), '{_QUOTED['space']}+', ' '))",
    "unwrap_link(t STRING)": "trim(substring_index(substring_index(regexp_replace(trim(t), '^\\\\[\\\\[(.*)\\\\]\\\\]$', '$1'), '|', 1), '#', 1))",
}


def register(spark: SparkSession) -> None:
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}")
    spark.udf.register("seq_ratio", seq_ratio)
