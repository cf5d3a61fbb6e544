"""The star-schema tables seen as a vault: orders are papers, line items findings, parts their fields, customers authors.

Each table is one projection, so filters and column choices reach the Parquet scan. DUCK has the same tables as SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.schema import EDGE_TYPES

AS_OF = "2025-06-30"
NEAR_DAYS = 30


class Model:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def papers(self) -> DataFrame:
        o = self.table("orders")
        day = "cast(o_orderdate as date)"
        return o.select(
            F.expr("concat('p', o_orderkey)").alias("slug"),
            F.expr("concat('Order ', o_orderkey, ': the ', o_orderpriority, ' case of customer ', o_custkey)").alias("title"),
            F.expr("array(concat('Cust', o_custkey, ', A.'), concat('Cust', o_custkey % 50, ', A.'))").alias("authors"),
            F.expr("array(lower(o_orderpriority), concat('status-', o_orderstatus))").alias("fields"),
            F.expr(f"date_format({day}, 'yyyy-MM-dd')").alias("publication_date"),
            F.expr(f"date_format(date_add({day}, cast(o_orderkey % 40 - 5 as int)), 'yyyy-MM-dd')").alias("ingested_date"),
            F.expr("concat('https://example.org/o/', o_orderkey)").alias("source_url"),
            F.expr("if(o_orderkey % 7 = 0, concat(lpad(o_orderkey % 10000, 4, '0'), '.', lpad(o_orderkey % 100000, 5, '0'), if(o_orderkey % 14 = 0, 'v2', '')), null)").alias("arxiv_id"),
            F.expr("if(o_orderkey % 5 = 0, concat('10.1234/Order.', o_orderkey), null)").alias("doi"),
            F.col("o_orderpriority").alias("venue"),
            F.lit("lite").alias("ingest_mode"),
            F.lit("paper").alias("type"),
            F.expr("cast(1 + o_orderkey % 5 as int)").alias("credibility"),
            F.expr("cast(1 + o_custkey % 5 as int)").alias("rigor"),
            F.expr("element_at(array('code-released', 'partial', 'none'), cast(o_orderkey % 3 as int) + 1)").alias("reproducibility"),
            F.expr("concat('p', o_orderkey, '.md')").alias("sort_key"),
        ).withColumn("overall", F.expr("round(0.5D * credibility + 0.3D * rigor + 0.2D * case reproducibility when 'code-released' then 5 when 'partial' then 3 else 1 end, 1)")).withColumn(
            "quality", F.expr("named_struct('credibility', credibility, 'experimental_rigor', rigor, 'reproducibility', reproducibility, 'overall', overall)")
        )

    @cached_property
    def _lines(self) -> DataFrame:
        return self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.expr("cast(l_shipdate as date)").alias("day")).withColumn(
            "slug", F.expr("concat('f-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', date_format(day, 'yyyyMMdd'))")
        )

    @cached_property
    def findings(self) -> DataFrame:
        p = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
        return self._lines.join(p, "l_partkey").select(
            "slug",
            F.expr("concat('The part ', p_name, ' was shipped as ', l_returnflag, ' in line ', l_linenumber)").alias("statement"),
            F.expr("concat('p', l_orderkey)").alias("source_paper"),
            F.expr("array(p_type, p_brand)").alias("fields"),
            F.expr("date_format(day, 'yyyy-MM-dd')").alias("extracted_date"),
            F.expr("element_at(array('empirical', 'theoretical', 'definitional', 'anecdotal'), l_linenumber % 4 + 1)").alias("finding_type"),
            F.expr("element_at(array('asserted', 'hedged', 'speculative'), cast(l_suppkey % 3 as int) + 1)").alias("hedging"),
            F.lit("finding").alias("type"),
            F.expr("concat(slug, '.md')").alias("sort_key"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        """From the later to the earlier of two findings on one part, of different papers, that ship within 30 days.

        Days fall into bins as long as the reach; the earlier finding is in its own and the next, so a range join is an equi-join on part
        and bin, and each pair meets once. Only numbers are shuffled; slugs are written for the pairs that are left.
        """
        l = self._lines.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "day", F.floor(F.unix_date("day") / (NEAR_DAYS + 1)).alias("bin"))  # noqa: E741
        side = lambda df, x: df.select("l_partkey", "bin", *[F.col(c).alias(f"{x}_{c}") for c in ("l_orderkey", "l_linenumber", "l_suppkey", "day")])
        a = side(l.withColumn("bin", F.explode(F.array("bin", F.col("bin") + 1))), "a")
        b = side(l, "b")
        met = a.join(b, ["l_partkey", "bin"]).where(f"a_l_orderkey <> b_l_orderkey and b_day >= a_day and b_day <= date_add(a_day, {NEAR_DAYS})")
        slug = lambda x: F.expr(f"concat('f-', {x}_l_orderkey, '-', {x}_l_linenumber, '-', l_partkey, '-', {x}_l_suppkey, '-', date_format({x}_day, 'yyyyMMdd'))")
        kinds = ", ".join(f"'{t}'" for t in EDGE_TYPES)
        return met.select(slug("b").alias("src"), F.expr(f"element_at(array({kinds}), (a_l_linenumber + b_l_linenumber) % 5 + 1)").alias("etype"), slug("a").alias("dst"))

    @cached_property
    def slugs(self) -> DataFrame:
        """Findings' and papers' slugs without the rest of their columns."""
        return self._lines.select("slug", F.expr("concat('p', l_orderkey)").alias("source_paper"))

    @cached_property
    def cited(self) -> DataFrame:
        """Documents with a bibliography that refers to papers in each of the ways a citation can."""
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.expr("date_format(o_orderdate, 'yyyy')").alias("y"))
        d = self.table("documents").select("doc_id", "text", (F.col("doc_id") + 1).alias("o_orderkey"))
        return d.join(o, "o_orderkey", "left").select(
            "doc_id",
            F.expr(
                r"""concat(text, '\nReferences\n[1] arXiv: ', lpad(doc_id * 7 % 10000, 4, '0'), '.', lpad(doc_id * 7 % 100000, 5, '0'), 'v1; doi 10.1234/order.', doc_id * 5, ').',
                coalesce(concat(' "order ', o_orderkey, ' the ', o_orderpriority, ' case of customer ', o_custkey, '" by Cust', o_custkey, ' et al, printed in ', y, '.'), ''))"""
            ).alias("text"),
        )


_KINDS = ", ".join(f"'{t}'" for t in EDGE_TYPES)
#: The same tables as common table expressions of DuckDB.
DUCK = {
    "papers": """papers AS (SELECT *, round(0.5::DOUBLE * credibility + 0.3::DOUBLE * rigor + 0.2::DOUBLE * CASE reproducibility WHEN 'code-released' THEN 5 WHEN 'partial' THEN 3 ELSE 1 END, 1) AS overall FROM (
      SELECT 'p' || o_orderkey AS slug, 'Order ' || o_orderkey || ': the ' || o_orderpriority || ' case of customer ' || o_custkey AS title,
        ['Cust' || o_custkey || ', A.', 'Cust' || (o_custkey % 50) || ', A.'] AS authors, [lower(o_orderpriority), 'status-' || o_orderstatus] AS fields,
        strftime(o_orderdate, '%Y-%m-%d') AS publication_date, strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 5 AS INTEGER), '%Y-%m-%d') AS ingested_date,
        'https://example.org/o/' || o_orderkey AS source_url,
        CASE WHEN o_orderkey % 7 = 0 THEN lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') || CASE WHEN o_orderkey % 14 = 0 THEN 'v2' ELSE '' END END AS arxiv_id,
        CASE WHEN o_orderkey % 5 = 0 THEN '10.1234/Order.' || o_orderkey END AS doi, o_orderpriority AS venue, 'lite' AS ingest_mode, 'paper' AS type,
        CAST(1 + o_orderkey % 5 AS INTEGER) AS credibility, CAST(1 + o_custkey % 5 AS INTEGER) AS rigor,
        ['code-released', 'partial', 'none'][o_orderkey % 3 + 1] AS reproducibility, 'p' || o_orderkey || '.md' AS sort_key
      FROM orders))""",
    "lines": """lines AS (SELECT *, 'f-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(day, '%Y%m%d') AS slug, 'p' || l_orderkey AS source_paper
      FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CAST(l_shipdate AS DATE) AS day FROM lineitem))""",
    "findings": """findings AS (SELECT slug, 'The part ' || p_name || ' was shipped as ' || l_returnflag || ' in line ' || l_linenumber AS statement, source_paper, [p_type, p_brand] AS fields,
        strftime(day, '%Y-%m-%d') AS extracted_date, ['empirical', 'theoretical', 'definitional', 'anecdotal'][l_linenumber % 4 + 1] AS finding_type,
        ['asserted', 'hedged', 'speculative'][l_suppkey % 3 + 1] AS hedging, 'finding' AS type, slug || '.md' AS sort_key
      FROM lines JOIN part ON p_partkey = l_partkey)""",
    "edges": f"""edges AS MATERIALIZED (SELECT b.slug AS src, [{_KINDS}][(a.l_linenumber + b.l_linenumber) % 5 + 1] AS etype, a.slug AS dst
      FROM lines a JOIN lines b ON a.l_partkey = b.l_partkey AND a.l_orderkey <> b.l_orderkey AND b.day >= a.day AND b.day <= a.day + {NEAR_DAYS})""",
    "cited": """cited AS (SELECT doc_id, text || chr(10) || 'References' || chr(10) || '[1] arXiv: ' || lpad(CAST(doc_id * 7 % 10000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(doc_id * 7 % 100000 AS VARCHAR), 5, '0')
        || 'v1; doi 10.1234/order.' || (doc_id * 5) || ').' ||
        coalesce(' "order ' || o_orderkey || ' the ' || o_orderpriority || ' case of customer ' || o_custkey || '" by Cust' || o_custkey || ' et al, printed in ' || strftime(o_orderdate, '%Y') || '.', '') AS text
      FROM documents LEFT JOIN orders ON o_orderkey = doc_id + 1)""",
}


def duck(*names: str) -> str:
    """A WITH clause of the named tables, in the order they need each other, open for more."""
    want = set(names) | ({"lines"} if {"findings", "edges"} & set(names) else set())
    return "WITH " + ", ".join(sql for name, sql in DUCK.items() if name in want)
