"""License scans: ordered signature rules, gated by a keyword, resolved by priority and interval containment.

A text becomes its words. Those that are some rule's keyword are found in one pass; only there, the keyword's rules are tried, each a
regex for the words before it and one for those after it, so the cost of the rules follows the keywords and not the texts. Of the
intervals found, one inside another of the same or a higher priority is suppressed; rules with phrases that must stay have the highest
priority. Everything is a Spark SQL expression over one row; the regexes are literals, compiled once, and nothing is shuffled or joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_row
from .license_rules import BASE_PHRASES, LEFT, RIGHT, rule, rules

__all__ = ["BASE_PHRASES", "rule", "rules", "scan_licenses"]

RESULT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "kept_matches"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MATCH = "struct<start:int,back:int,rank:int,no:int,label:string,confidence:double,base:boolean>"


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tried(no: int, r: dict) -> str:
    """SQL for the match of a rule at keyword x in its context c, or null. Each word of a context ends in a space."""
    tests, lo, hi = [], "x.i", "x.i + 1"
    for side, pattern in (("l", f"(?<= |^){r['before']}$"), ("r", f"^{r['after']}")):
        if r["before" if side == "l" else "after"]:
            tests.append(f"rlike(c.{side}, {_quoted(pattern)})")
            taken = f"regexp_count(regexp_extract(c.{side}, {_quoted(pattern)}, 0), ' ')"
            lo, hi = (f"{lo} - {taken}", hi) if side == "l" else (lo, f"{hi} + {taken}")
    fields = f"'start', {lo}, 'back', -({hi}), 'rank', {-r['priority']}, 'no', {no}, 'label', {_quoted(r['label'])}, 'confidence', {r['confidence']}D, 'base', {str(r['base']).lower()}"
    return f"if({' and '.join(tests) or 'true'}, named_struct({fields}), null)"


def _found(chosen: list[dict]) -> str:
    """SQL for the array of all matches of a text, given its words and `_hit`, the keywords among them."""
    by: dict[str, list[str]] = {}
    for no, r in enumerate(chosen):
        by.setdefault(r["anchor"], []).append(_tried(no, r))
    cases = " ".join(f"when {_quoted(k)} then array({', '.join(v)})" for k, v in by.items())
    left = f"concat_ws('', transform(slice(_words, greatest(x.i - {LEFT}, 0) + 1, least(x.i, {LEFT})), w -> concat(w, ' ')))"
    right = f"concat_ws('', transform(slice(_words, x.i + 2, {RIGHT}), w -> concat(w, ' ')))"
    at = "filter(transform(_words, (w, i) -> if(array_contains(_hit, w), named_struct('i', i, 'k', w), null)), x -> x is not null)"
    return f"""case when size(_hit) = 0 then cast(array() as array<{_MATCH}>) else array_sort(filter(flatten(flatten(transform({at}, x ->
        transform(array(named_struct('l', {left}, 'r', {right})), c -> case x.k {cases} end)))), m -> m is not null)) end"""


def scan_licenses(docs: DataFrame, text_col: str = "text", rule_list: list[dict] | None = None) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and kept_matches added.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. A null text is empty: no words, no labels
    (''), null places, score 0. A word or phrase that recurs counts at every place; rules that tie on an interval go by priority,
    then by their order. Other columns pass through; columns of the same names as the results are replaced.
    """
    chosen = rules() if rule_list is None else rule_list
    low = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), _UPPER, _LOWER)
    words = docs.select(whole_row(docs, None, RESULT).alias("_row"), F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "").alias("_words"))
    keywords = F.array(*[F.lit(k) for k in sorted({r["anchor"] for r in chosen})]) if chosen else F.expr("cast(array() as array<string>)")
    found = words.withColumn("_hit", F.array_intersect("_words", keywords)).withColumn("_found", F.expr(_found(chosen) if chosen else f"cast(array() as array<{_MATCH}>)"))
    # In order of start, then of length: a match is inside an earlier one if some end so far, of its priority or a higher one, is not before its own.
    kept = found.withColumn(
        "_kept",
        F.expr(
            """aggregate(_found,
                 named_struct('ends', array(-1, -1, -1, -1), 'labels', cast(array() as array<string>), 'score', 0D, 'n', 0),
                 (acc, d) -> if(exists(slice(acc.ends, 1 - d.rank, 4 + d.rank), e -> e >= -d.back), acc, named_struct(
                   'ends', transform(acc.ends, (e, k) -> if(k = -d.rank, greatest(e, -d.back), e)),
                   'labels', array_union(acc.labels, array(d.label)),
                   'score', greatest(acc.score, d.confidence),
                   'n', acc.n + 1)))"""
        ),
    ).withColumn("_base", F.expr("filter(_found, d -> d.base)"))
    return kept.select(
        "_row.*",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.expr("cast(array_min(transform(_base, d -> d.start)) as long)").alias("first_word"),
        F.expr("cast(array_max(transform(_base, d -> d.start)) as long)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(_base, d -> d.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_union(_kept.labels, transform(_base, d -> d.label))), ',')").alias("labels"),
        F.expr("_kept.score").alias("score"),
        F.expr("cast(_kept.n as long)").alias("kept_matches"),
    )
