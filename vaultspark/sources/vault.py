"""Vaults on disk: one Markdown file a row, YAML front matter and a body. Read once into typed tables; written back as files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultspark import schema
from vaultspark.functions.text import file_sort_key, links, unwrap_link

try:
    import yaml
except ImportError:
    yaml = None

_FRONT = re.compile(r"\A---\n(.*?)\n---\n?(.*)\Z", re.S)
RAW = "stem string, front string, body string, sort_key string"

#: Fewest tasks that write or parse files: a table of many rows may be one small Parquet file.
TASKS = 64


class _Link(str):
    """A link; written in double quotes."""


if yaml is not None:
    # libyaml's parser and emitter, where PyYAML was built with them, take a tenth of the time; they get only what both treat alike.
    _SAME = re.compile(r"(?:(?![|>][-+0-9]*#)[\n\x20\x22-\x7e\xa1-\u1fff\u2070-\ud7ff])*+")
    _SHORT = re.compile(r"[\x20-\x7e]{0,60}")

    class _SlowPlain(yaml.SafeLoader):
        yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t == "tag:yaml.org,2002:null"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    class _Plain(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        yaml_implicit_resolvers = _SlowPlain.yaml_implicit_resolvers

    class _Dumper(getattr(yaml, "CSafeDumper", yaml.SafeDumper)):
        pass

    class _SlowDumper(yaml.SafeDumper):
        """For what libyaml would escape or fold in another way."""

    for _kind in (_Dumper, _SlowDumper):
        _kind.add_representer(_Link, lambda d, x: d.represent_scalar("tag:yaml.org,2002:str", str(x), style='"'))


def parse_front(text: str) -> tuple[dict, str]:
    """Front matter and body. Scalars stay strings, so ids and dates keep their written form; null, true and numbers are text too, but null is null."""
    m = _FRONT.match(text)
    if not m:
        return {}, text
    try:
        found = yaml.load(m[1], _Plain if _SAME.fullmatch(m[1]) else _SlowPlain) or {}
    except yaml.YAMLError:
        found = yaml.load(m[1], _SlowPlain) or {}
    if not isinstance(found, dict):
        raise ValueError("front matter is not a mapping")
    return found, m[2]


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        parsed = [parse_front(bytes(c).decode("utf-8")) for c in f["content"]]
        stems = [p.rstrip("/").rsplit("/", 1)[-1].removesuffix(".md") for p in f["path"]]
        yield pd.DataFrame({
            "stem": stems,
            "front": [json.dumps(a, ensure_ascii=False) for a, _ in parsed],
            "body": [b for _, b in parsed],
            "sort_key": [s + ".md" for s in stems],
        })


def scan(spark: SparkSession, vault: str, folder: str) -> DataFrame:
    """(stem, front as JSON, body, sort_key) of a folder's Markdown files, not its sub-folders'. A missing folder is empty. Bad front matter ends the read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{vault}/{folder}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], RAW)
    return parse_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(f"{vault}/{folder}"))


def parse_files(files: DataFrame) -> DataFrame:
    """(stem, front as JSON, body, sort_key) of Markdown files (path, content)."""
    return files.select("path", "content").mapInPandas(_read, RAW)


def _as_text(kind: T.DataType) -> T.DataType:
    """The type with text for numbers, as the front matter's scalars are kept."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind])
    return kind if isinstance(kind, T.ArrayType) else T.StringType()


def typed(raw: DataFrame, ddl: str) -> DataFrame:
    """Front matter as typed columns; hyphens in keys become underscores; links in lists are unwrapped."""
    want = T._parse_datatype_string(ddl)
    made = {"body", "sort_key", "raw_keys"}
    hyphen = F.regexp_replace("front", r'"([a-z]+(?:-[a-z]+)*)"\s*:', '"$1":')
    for name in ("publication-date", "ingested-date", "source-url", "arxiv-id", "ingest-mode", "experimental-rigor", "builds-on", "similar-to", "source-paper", "source-ref", "extracted-date", "finding-type", "parent-field"):
        hyphen = F.replace(hyphen, F.lit(f'"{name}":'), F.lit(f'"{name.replace("-", "_")}":'))
    inner = _as_text(T.StructType([f for f in want if f.name not in made]))
    df = raw.withColumn("_fm", F.from_json(hyphen, inner)).withColumn("raw_keys", F.from_json("front", "map<string,string>"))
    cols = []
    for f in want:
        if f.name in ("body", "sort_key", "raw_keys"):
            cols.append(F.col(f.name))
        elif f.name in ("slug", "name"):
            cols.append(F.coalesce(F.nullif(F.col(f"_fm.{f.name}"), F.lit("")), F.col("stem")).alias(f.name))
        elif f.name == "source_paper":
            cols.append(unwrap_link(F.col("_fm.source_paper")).alias(f.name))
        elif f.name in ("authors", "fields", "findings"):
            cols.append(F.transform(F.coalesce(F.filter(F.col(f"_fm.{f.name}"), lambda x: x.isNotNull()), F.array()), unwrap_link).alias(f.name))
        elif f.name == "relations":
            clean = lambda c: F.transform(F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.expr("cast(array() as array<string>)")), unwrap_link)
            cols.append(F.struct(*[clean(F.col(f"_fm.relations.{x.name}")).alias(x.name) for x in f.dataType]).alias("relations"))
        else:
            cols.append(F.col(f"_fm.{f.name}").cast(f.dataType).alias(f.name))
    return df.select(*cols)


def papers(spark: SparkSession, vault: str) -> DataFrame:
    return typed(scan(spark, vault, "papers"), schema.PAPER)


def findings(spark: SparkSession, vault: str) -> DataFrame:
    return typed(scan(spark, vault, "findings"), schema.FINDING)


def authors(spark: SparkSession, vault: str) -> DataFrame:
    return typed(scan(spark, vault, "authors"), schema.AUTHOR)


def fields(spark: SparkSession, vault: str) -> DataFrame:
    return typed(scan(spark, vault, "fields"), schema.FIELD)


def file_links(raw: DataFrame) -> DataFrame:
    """(source, target): each target once that a file (stem, front as JSON, body) links to, from any text among its front matter's values, however deep, or its body.

    Keys are no values, and text is text: a list in a list is not a link. Null front matter or bodies hold none.
    """
    # A JSON string is a value unless a colon follows it; keys match the first alternative, which keeps nothing.
    values = F.transform(
        F.regexp_extract_all(F.coalesce("front", F.lit("")), F.lit(r'"(?:[^"\\]|\\.)*+"\s*:|"((?:[^"\\]|\\.)*+)"'), F.lit(1)),
        lambda v: F.get(F.from_json(F.concat(F.lit('["'), v, F.lit('"]')), "array<string>"), F.lit(0)),
    )
    found = F.concat(F.flatten(F.transform(values, lambda v: links(F.coalesce(v, F.lit(""))))), links(F.coalesce("body", F.lit(""))))
    return raw.select(F.col("stem").alias("source"), F.explode(F.array_distinct(F.transform(found, unwrap_link))).alias("target"))


def mentions(spark: SparkSession, vault: str) -> DataFrame:
    """(source, target): each place in a file's text, front matter as it is written included, that links; of all entities' files and the index."""
    every = None
    for folder in [*schema.FOLDERS, None]:
        at = f"{vault}/{folder}" if folder else f"{vault}/index.md"
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            one = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(at).select("path", "content")
            every = one if every is None else every.unionByName(one)
    if every is None:
        return spark.createDataFrame([], "source string, target string")
    stem = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    return every.select(stem.alias("source"), F.explode(F.transform(links(F.make_valid_utf8(F.col("content").cast("string"))), unwrap_link)).alias("target"))


def dump_front(front: dict) -> str:
    """YAML in the given key order, Unicode kept, links in double quotes."""
    same = True

    def mark(x):
        nonlocal same
        if isinstance(x, str):
            same = same and _SHORT.fullmatch(x) is not None
            return _Link(x) if x.startswith("[[") and x.endswith("]]") else x
        if isinstance(x, list):
            return [mark(y) for y in x]
        if isinstance(x, dict):
            same = same and all(isinstance(k, str) and k and _SHORT.fullmatch(k) for k in x)
            return {k: mark(v) for k, v in x.items()}
        return x

    marked = mark(front)
    return yaml.dump(marked, Dumper=_Dumper if same else _SlowDumper, sort_keys=False, allow_unicode=True, default_flow_style=False)


def _text(front: str, body: str) -> str:
    return f"---\n{dump_front(json.loads(front))}---\n{body}"


def as_files(rows: DataFrame) -> DataFrame:
    """Rows (stem, front as JSON, body) as Markdown files (path, content), which parse_files reads back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["stem"] + ".md", "content": [_text(a, b).encode() for a, b in zip(f["front"], f["body"], strict=True)]})

    return rows.select("stem", "front", "body").repartition(TASKS, "stem").mapInPandas(run, "path string, content binary")


def write_files(rows: DataFrame, vault: str, folder: str) -> int:
    """Write rows (stem, front as JSON, body) as files of a vault on a file system that Spark's executors share. Returns how many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(vault if "://" in vault else "file://" + vault)
        for f in frames:
            for stem, front, body in zip(f["stem"], f["front"], f["body"], strict=True):
                with fs.open_output_stream(f"{at}/{folder}/{stem}.md") as out:
                    out.write(_text(front, body).encode())
            yield pd.DataFrame({"n": [len(f)]})

    import pyarrow.fs as pafs

    fs, at = pafs.FileSystem.from_uri(vault if "://" in vault else "file://" + vault)
    fs.create_dir(f"{at}/{folder}", recursive=True)
    return rows.select("stem", "front", "body").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def scaffold(spark: SparkSession, warehouse: str) -> dict[str, bool]:
    """Create an empty table for each entity, the edges and the log, where there is none. Returns which were created."""
    made = {}
    for name, ddl in {"papers": schema.PAPER, "findings": schema.FINDING, "authors": schema.AUTHOR, "fields": schema.FIELD, "edges": schema.EDGE, "log": schema.LOG}.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{warehouse}/{name}")
        made[name] = not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        if made[name]:
            spark.createDataFrame([], ddl).write.parquet(f"{warehouse}/{name}")
    return made


def slug_index(stems: dict[str, DataFrame]) -> DataFrame:
    """(slug, entity) of all folders' stems; where folders share one the later folder wins. stems: folder to a table (stem)."""
    every = None
    for rank, folder in enumerate(schema.FOLDERS):
        if folder in stems:
            one = stems[folder].select(F.col("stem").alias("slug"), F.struct(F.lit(rank).alias("rank"), F.lit(schema.FOLDERS[folder]).alias("entity")).alias("at"))
            every = one if every is None else every.unionByName(one)
    return every.groupBy("slug").agg(F.max("at").alias("at")).select("slug", F.col("at.entity").alias("entity"), file_sort_key(F.col("slug")).alias("sort_key"))
