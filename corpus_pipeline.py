"""Documents to packed training sequences: drop poor texts, then texts that break the rules, then near copies, and pack the rest."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm.common import new_path, remove, table, written
from vaultspark.llm.ngram_join import ngram_jaccard_classes
from vaultspark.llm.packing import pack_documents
from vaultspark.llm.quality_model import quality_classes
from vaultspark.llm.quality_rules import quality_rules
from vaultspark.llm.queries import WORD_BPE


def _held(docs: DataFrame) -> DataFrame:
    """The columns that the filters read, and the whole document as one, which they pass on as it is."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text", "lang", "source")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, all columns as they are, whatever their names.

    A null text is an empty one; a null id has no label; null sources and languages are sites of their own. Repeated rows are judged
    alike and stay or go together; an even verdict is kept. An empty table stays empty.
    """
    return quality_classes(_held(docs), table(spark, sf_dir, "labels"), keep=["doc"]).where("accepted").select("doc.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that keep within the rules, all columns as they are, whatever their names.

    A null, empty or short text fails; null sources and languages are groups of their own. Repeated rows count, and stay or go, together;
    what lies on a fence is inside. An empty table stays empty.
    """
    return quality_rules(_held(docs), keep=["doc"]).where("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of the smallest id, all columns as they are.

    Rows without an id stay. Rows that repeat an id and text become one; of an id with several texts, all stay if the id heads a
    class. Null and word-less texts are each a class of their own. An empty table stays empty.
    """
    heads = ngram_jaccard_classes(docs).where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("_kept"))
    heads = heads.unionByName(spark.createDataFrame([(None,)], "_kept long"))
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    kept = docs.join(heads, docs["doc_id"].eqNullSafe(heads["_kept"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens.

    A null or empty text is its end id; a null id stays null; repeated rows are packed as often as they occur; a long text is cut into
    pieces. An empty table gives no rows.
    """
    return pack_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("ngram_jaccard", near_duplicates), ("packing", packing)]
#: The stages fit a model, compare sets of n-grams and pack by a heuristic, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are written and read again; then what the stage wrote on its way, and its input, if a stage made it, go."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        before = set(written())
        to = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(to)
        remove(spark, [*(p for p in written() if p not in before), *last])
        docs, last = spark.read.parquet(to), [to]
    return docs
