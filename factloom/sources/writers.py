"""Sinks: exports, caches, graph artefacts, text dumps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scratch_path(spark) -> str:
    from ..plans.fixpoint import shared_dir

    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"


def export(df: DataFrame, path: str, form: str = "json") -> str:
    """json, csv (with header), parquet or orc."""
    w = df.write.mode("overwrite")
    (w.option("header", True) if form == "csv" else w).format(form).save(path)
    return path


def scratch(df: DataFrame, form: str) -> str:
    return export(df, scratch_path(df.sparkSession), form)


def save_cache(df: DataFrame, path: str, *scope: str) -> None:
    """Replaces only the scopes that the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


#: The tables of a trace graph and their columns; evidence is free.
TRACE = {
    "facts": "id string, label string, node long, context long, field_path array<string>, method string, stmt string, value string",
    "edges": "id string, from_fact string, to_fact string, stage string, reason string, status string, producer string, evidence map<string,string>",
    "gates": "id string, label string, from_fact string, to_fact string, stage string, producer string, gate_kind string, scope string, attempted boolean, matched boolean, emitted boolean, skipped_reason string, blocked_reason string, evidence map<string,string>",
    "coverage": "id string, kind string, stage string, producer string, subject string, status string, gate_id string, label string, role string, endpoint string, surface_id string, asset_id string, reason string, evidence map<string,string>",
}


def trace_graph(tables: dict[str, DataFrame], path: str) -> None:
    """A trace graph's tables, a folder each, under the schemas of TRACE: columns that a table
    lacks are null, columns that it should not have are an error, a table that is not given
    is empty."""
    if lost := sorted(set(tables) - set(TRACE)):
        raise ValueError(f"unknown tables {lost}")
    some = next(iter(tables.values()))
    for name, schema in TRACE.items():
        want = [c.split(" ", 1) for c in schema.split(", ")]
        df = tables.get(name)
        if df is None:
            df = some.sparkSession.createDataFrame([], schema)
        if lost := sorted(set(df.columns) - {c for c, _ in want}):
            raise ValueError(f"{name} has unknown columns {lost}")
        df = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in want])
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def program(methods: DataFrame, path: str) -> None:
    """Nested methods (readers.PROGRAM), an object a line, in a folder for each module, so that a
    reader of some modules opens no others."""
    methods.write.mode("overwrite").partitionBy("module").json(path)


def ledgers(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each ledger."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def dot(edges: DataFrame) -> DataFrame:
    """(graph, dot) of edges (graph, ord, src, dst), in order of ord."""
    line = F.concat("src", F.lit(" -> "), "dst", F.lit(";"))
    g = edges.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    return g.select("graph", F.concat(F.lit("digraph g { "), F.array_join(F.transform("l", lambda x: x["line"]), " "), F.lit(" }")).alias("dot"))


def markdown(rows: DataFrame, title: str, limit: int = 200) -> str:
    """A table of at most ``limit`` rows as text."""
    names = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in rows.limit(limit).collect()])


def text_files(rows: DataFrame, path: str) -> str:
    """One text file for each partition of rows (line)."""
    rows.select(F.col("line").cast("string")).write.mode("overwrite").text(path)
    return path


def report(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(section, text): a markdown table for each value of ``by``, rows in ``order``; made on
    the executors, whole."""
    names = [c for c in rows.columns if c != by]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]), F.lit(" |"))
    one = rows.select(F.col(by).cast("string").alias("section"), F.struct(*order, line.alias("line")).alias("r")).groupBy("section").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    head = f"| {' | '.join(names)} |\n|{'---|' * len(names)}\n"
    return one.select("section", F.concat(F.lit("## "), "section", F.lit("\n"), F.lit(head), F.array_join(F.transform("rs", lambda r: r["line"]), "\n")).alias("text"))
