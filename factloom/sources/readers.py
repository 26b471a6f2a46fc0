"""Scans: fact tables, JSON assets, source folders, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def facts(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """Parquet fact tables of one or more paths."""
    r = spark.read
    return (r.schema(schema) if schema else r).parquet(*paths)


def json_table(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON under a schema; bad rows fail; comments are allowed in whole documents."""
    r = spark.read.schema(schema).option("mode", "FAILFAST").option("allowComments", True)
    return r.option("multiLine", not lines).json(path)


def documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Whole files as (path, text)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"))


def source_dirs(files: DataFrame, marker: str = "src/main/ets", extensions: tuple[str, ...] = ("ets", "ts")) -> DataFrame:
    """(dir, depth) of folders under ``marker`` that hold source files, shallow first; files: (path)."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = files.where(ext.isin(*extensions)).select(F.regexp_extract("path", f"^(.*?{marker})/", 1).alias("dir")).where("dir <> ''").distinct()
    return found.withColumn("depth", F.size(F.split("dir", "/"))).orderBy("depth", "dir")


def statements(stmts: DataFrame, kind: str, **equal: str) -> DataFrame:
    """Statements of a kind with equal columns; the filters reach the files."""
    out = stmts.where(F.col("kind") == kind)
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    return out


def unparsed(files: DataFrame, parsed: DataFrame) -> DataFrame:
    return files.join(parsed, "path", "left_anti").orderBy("path")


def load_cache(spark: SparkSession, path: str, schema: str, scope: dict[str, str]) -> DataFrame:
    """Cached rows of a scope; empty if another scope was written, or nothing."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    for name, value in scope.items():
        rows = rows.where(F.col(name) == value)
    return rows


def trace_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a graph written by ``writers.trace_graph``."""
    from .writers import TRACE

    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TRACE.items()}


#: A method with its blocks, their statements and successors, its variables' types and its traps.
PROGRAM = """file string, class string, method string, parameters array<struct<name:string,type:string>>,
blocks array<struct<id:int,successors:array<int>,statements:array<struct<idx:int,op:string,dst:string,args:array<string>>>>>,
types map<string,string>, traps array<struct<blocks:array<int>,handler:int>>, module string"""


def program(spark: SparkSession, path: str, modules: list[str] | None = None, files: list[str] | None = None) -> DataFrame:
    """The methods of a project, of some ``modules`` or ``files`` only if these are given.

    Modules are folders, of which the others are not opened; the condition on files goes to
    the scan as a pushed filter.  A line that does not fit the schema is an error."""
    rows = spark.read.schema(PROGRAM).option("mode", "FAILFAST").json(path)
    if modules is not None:
        rows = rows.where(F.col("module").isin(modules))
    return rows if files is None else rows.where(F.col("file").isin(files))


def program_statements(methods: DataFrame) -> DataFrame:
    """(module, file, class, method, block, idx, op, dst, args) of nested methods."""
    each = methods.select("module", "file", "class", "method", F.explode("blocks").alias("b"))
    return each.select("module", "file", "class", "method", F.col("b.id").alias("block"), F.inline("b.statements"))


def program_edges(methods: DataFrame) -> DataFrame:
    """(method, src, dst, kind): successors of blocks, and the ways into handlers."""
    flow = methods.select("method", F.explode("blocks").alias("b")).select("method", F.col("b.id").alias("src"), F.explode("b.successors").alias("dst"), F.lit("next").alias("kind"))
    trap = methods.select("method", F.explode("traps").alias("t")).select("method", F.explode("t.blocks").alias("src"), F.col("t.handler").alias("dst"), F.lit("exception").alias("kind"))
    return flow.union(trap)
