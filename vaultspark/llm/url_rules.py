"""URL filters by a sort-merge range join.

A host is written with its labels reversed and a closing dot ('com.example.'), so a rule's host and its subdomains are an interval of
keys. URLs and rules together are dealt out by ranges of keys, which Spark's range partitioning finds; URLs of a key that a range cannot
hold are spread over several. A range also gets the rules whose intervals are open where it starts: those whose key is a prefix, label
by label, of its first key. Each range is sorted, and one sweep keeps the stack of the rules whose intervals are open: nested ones lie
upon each other, and each entry looks up the paths of its host's rules. Of the rules that fit, the longest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship

#: Host, path, verdict.
BASE_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: from there up to '?', '#' or the end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def reversed_host(host: F.Column) -> F.Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, dict, list]] = []  # prefix, path -> (length, rule, verdict), lengths of paths
        at = None
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for part, key, is_url, page_id, host, path, verdict in zip(*cols, strict=True):
                if part != at:
                    at = part
                    stack.clear()
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    rules, sizes = stack[-1][1:]
                    old = rules.get(path)
                    if old is None or verdict == "block":
                        rules[path] = (len(host) + len(path), host + path, verdict)
                    if len(path) not in sizes:
                        sizes.append(len(path))
                        sizes.sort(reverse=True)
                    continue
                best = None
                for _, rules, sizes in stack:
                    for n in sizes:
                        found = rules.get(path[:n]) if n <= len(path) else None
                        if found:
                            if best is None or found[0] >= best[0]:
                                best = found
                            break
                out.append((page_id, host, path, best[1] if best else None, best[2] if best else default))
            names = ["page_id", "host", "path", "rule", "verdict"]
            kinds = [pa.int64(), *[pa.string()] * 4]
            cols = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(rules or BASE_RULES, "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, ranges: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    rules: (host, path, verdict), any number of rows; the base rules unless given. A rule fits its host and all subdomains if the
    URL's path starts with the rule's; an empty rule host fits every host. The longest host and path together wins, of equals the
    one with the longer host; of two verdicts for one rule, block. Without a rule the verdict is `default` and the rule null.
    A null URL, or one without '://', has an empty host and path. Null ids stay null; repeated rows come back as often as they occur.
    Rules with a null are ignored. Other columns are not read. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    ship(spark)
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    urls = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", reversed_host(F.col("host")))
    r = (rules if rules is not None else rule_table(spark)).select("host", "path", "verdict").dropna()
    r = r.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").withColumn("key", reversed_host(F.col("host")))
    cols = ["key", "is_url", "page_id", "host", "path", "verdict"]
    rules_first = r.withColumns({"is_url": F.lit(False), "page_id": F.lit(None).cast("long"), "salt": F.lit(0).cast("long")})
    rows = urls.withColumns({"is_url": F.lit(True), "verdict": F.lit(None).cast("string"), "salt": F.xxhash64("page_id", "path")})
    tasks = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = rows.select(*cols, "salt").unionByName(rules_first.select(*cols, "salt")).repartitionByRange(tasks, "key", "is_url", "salt")
    # Written, as bounds that are sampled again would be others.
    ranged = cut(both.select(F.spark_partition_id().alias("part"), *cols), "url-ranges")
    starts = ranged.groupBy("part").agg(F.min("key").alias("first")).select("part", F.split(F.expr("substring(first, 1, length(first) - 1)"), r"\.").alias("labels"))
    prefixes = F.expr("concat(array(''), transform(sequence(1, size(labels)), k -> concat(array_join(slice(labels, 1, k), '.'), '.')))")
    open_ = starts.select("part", F.explode(prefixes).alias("key")).join(rules_first, "key").select("part", *cols)
    every = ranged.unionByName(open_)
    return every.repartition(tasks, "part").sortWithinPartitions("part", "key", "is_url").mapInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")
