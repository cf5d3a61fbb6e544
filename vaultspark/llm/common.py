"""What the operators share: tables, the shared folder, cutting lineage, and shipping this package to executors."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What goes to a Python worker at once: texts may be long, so neither many rows nor many bytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
DEFAULTS = {"10000", "67108864b"}
_shipped: set[str] = set()
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run in one process, and it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "vaultspark-shared")
        spark.sparkContext.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    # With its scheme: without one, Hadoop and pyarrow may take a path for one on different file systems.
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return re.sub(r"^file:/(?!/)", "file:///", whole)


def arrow_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and path for a URI, on an executor, where Hadoop's are out of reach; its names for S3 are understood."""
    scheme, found, rest = uri.partition("://")
    try:
        return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}" if found else uri)
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"archives can't be written to {scheme}://: pyarrow has no file system for it; set spark.checkpoint.dir to another") from e


#: Characters that the quality operators count, as classes of a pattern.
SYMBOLS, MARKS, CAPITALS, DIGITS, SPACE = r"[#*$%&|<>]", r"[!?;:_=+/\\~^@{}\[\]]", "[A-Z]", "[0-9]", r"[ \t\n\x0B\f\r]+"


def held(text: str, chars: str) -> Column:
    """How many characters of the text are of a class."""
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))


def whole_row(docs: DataFrame, keep: list[str] | None, results: list[str]) -> Column:
    """The columns `keep` of docs (all unless given) but those named like a result, as one struct: inside it no name clashes with an operator's own."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    return F.struct(*[F.col(f"`{c}`") for c in names])


def ship(spark: SparkSession) -> None:
    """Give executors this package through the shared folder, whatever their module path; once per application.

    Batches for Python get a bound on rows and bytes: BATCH is set for the session where it still has Spark's defaults, as plans read it when they run.
    """
    for key, most in BATCH.items():
        if spark.conf.get(key) in DEFAULTS:
            spark.conf.set(key, most)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    to = f"{new_path(spark, 'package')}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/vaultspark/{tag}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later steps survive lost executors and don't recompute it."""
    spark = df.sparkSession
    to = new_path(spark, tag)
    df.write.parquet(to)
    _written.append(to)
    out = spark.read.schema(df.schema).parquet(to)
    out._cut_path = to
    return out


def written() -> list[str]:
    """Paths that cut() has written and nobody has removed, in order."""
    return list(_written)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for to in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if to in _written:
            _written.remove(to)


def clean_up(spark: SparkSession) -> None:
    """Remove all tables that operators have written on their way in this application. For when no result that reads them is still to run."""
    remove(spark, written())


def drop_cut(df: DataFrame) -> None:
    """Remove what cut() wrote for df. Only for tables that no result still reads."""
    to = getattr(df, "_cut_path", None)
    if to:
        remove(df.sparkSession, [to])
