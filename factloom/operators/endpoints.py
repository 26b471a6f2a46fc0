"""Endpoints of effects at nodes: values along access paths, resolution of existing nodes,
new nodes on exact evidence, and the evidence, slices and decisions around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ledgers import placed


def runtime_values(endpoints: DataFrame, fields: DataFrame, most: int = 8) -> DataFrame:
    """(endpoint, value): values of access paths (endpoint, base, path array) walked over
    fields (base, field, value), at most ``most`` steps; longer paths have none."""
    level = endpoints.where(F.size("path") <= most).select("endpoint", F.col("base").alias("value"), "path")
    done = level.where(F.size("path") == 0).select("endpoint", "value")
    f = fields.select(F.col("base").alias("value"), "field", F.col("value").alias("next"))
    for n in range(1, most + 1):
        step = level.where(F.size("path") >= n).withColumn("field", F.element_at("path", n)).join(f, ["value", "field"])
        level = step.select("endpoint", F.col("next").alias("value"), "path")
        done = done.union(level.where(F.size("path") == n).select("endpoint", "value"))
    return done.distinct()


def projected(endpoints: DataFrame, explicit: DataFrame, walked: DataFrame, values: DataFrame, carriers: DataFrame) -> DataFrame:
    """(endpoint, node, field, status, reason): one ledger row for each endpoint (endpoint,
    base, path, spread, exact).

    The first that knows a node decides: explicit ids, access paths, values (each
    (endpoint, node)); else the base's carrier (base, node) with the path as field; a new
    node is asked for only on exact evidence.  A spread argument is the slot arr:*."""
    pick = lambda t, name: t.groupBy("endpoint").agg(F.min("node").alias(name))
    j = endpoints.join(pick(explicit, "n1"), "endpoint", "left").join(pick(walked, "n2"), "endpoint", "left").join(pick(values, "n3"), "endpoint", "left")
    j = j.join(carriers.groupBy("base").agg(F.min("node").alias("n4")), "base", "left")
    deep = F.size("path") > 0
    reason = F.when(F.col("n1").isNotNull(), "explicit").when(F.col("n2").isNotNull(), "access-path").when(F.col("n3").isNotNull(), "value").when(F.col("n4").isNotNull() & deep, "carrier").when(F.col("exact"), "new").otherwise("unresolved")
    status = F.when(reason == "unresolved", "unresolved").when(reason == "new", "to-create").otherwise("resolved")
    field = F.when(F.col("spread"), "arr:*").when(reason == "carrier", F.array_join("path", "."))
    node = F.when(reason == "carrier", F.col("n4")).otherwise(F.coalesce("n1", "n2", "n3"))
    return j.select("endpoint", node.alias("node"), field.alias("field"), status.alias("status"), reason.alias("reason"))


def existing(values: DataFrame, direct: DataFrame, locals_: DataFrame, resolved: DataFrame) -> DataFrame:
    """(value, node, how) of values (value, method, name): its own node (value, node), else
    the method's local of that name (method, name, node), else what it resolves to (value, node)."""
    j = values.join(direct.groupBy("value").agg(F.min("node").alias("a")), "value", "left").join(locals_.groupBy("method", "name").agg(F.min("node").alias("b")), ["method", "name"], "left").join(resolved.groupBy("value").agg(F.min("node").alias("c")), "value", "left")
    how = F.when(F.col("a").isNotNull(), "direct").when(F.col("b").isNotNull(), "local").when(F.col("c").isNotNull(), "resolved").otherwise("missing")
    return j.select("value", F.coalesce("a", "b", "c").alias("node"), how.alias("how"))


def materialized(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """(value, node, made): existing nodes (value, node), and new ones for buildable values
    (value, buildable), numbered on from the largest; others have none."""
    known = values.join(nodes.groupBy("value").agg(F.min("node").alias("node")), "value")
    fresh = placed(values.join(nodes, "value", "left_anti").where("buildable").select("value").distinct(), ["value"])
    top = nodes.agg(F.coalesce(F.max("node"), F.lit(0)).alias("top"))
    made = fresh.crossJoin(F.broadcast(top))  # one row
    return known.select("value", "node", F.lit(False).alias("made")).union(made.select("value", F.col("top") + F.col("place"), F.lit(True)))


def occurrence_evidence(occurrences: DataFrame, imports: DataFrame, receivers: DataFrame, declarations: DataFrame) -> DataFrame:
    """(occurrence, kind, detail): one row for each piece of evidence of an occurrence
    (occurrence, file, name, receiver): its file's import (file, name, module), its
    receiver's type (receiver, type), the declarations of its name (name, owner)."""
    row = lambda df, kind, detail: df.select("occurrence", F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
    out = row(occurrences, "name", F.col("name")).union(row(occurrences.join(imports, ["file", "name"]), "import", F.col("module")))
    out = out.union(row(occurrences.join(receivers, "receiver"), "receiver-type", F.col("type"))).union(row(occurrences.join(declarations, "name"), "declaration", F.col("owner")))
    return out.distinct()


def bootstrapped(assets: DataFrame, trusted: tuple[str, ...], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Trusted, valid assets (asset, status, valid, key), one for each key, and the problems
    (asset, problem) of the rest; ``strict``: any problem of a trusted one raises when read."""
    mine = assets.withColumn("first", F.min(F.when(F.col("status").isin(*trusted) & F.col("valid"), F.col("asset"))).over(Window.partitionBy("key")))
    problem = F.when(~F.col("status").isin(*trusted), "not trusted").when(~F.col("valid"), "invalid").when(F.col("asset") != F.col("first"), "duplicate key")
    told = mine.select("asset", "key", problem.alias("problem"))
    if strict:
        told = told.withColumn("problem", F.when(F.col("problem").isin("invalid", "duplicate key"), F.raise_error(F.concat(F.lit("asset "), F.col("asset").cast("string")))).otherwise(F.col("problem")))
    return told.where("problem is null").select("asset", "key"), told.where("problem is not null").select("asset", "problem")


def evidence_pack(surfaces: DataFrame, ledger: DataFrame, slices: DataFrame) -> DataFrame:
    """(surface, decision, slices, problem): every surface (surface) with its ledger row
    (surface, decision) and number of slices (surface, slice); a missing or repeated
    ledger row, and one that sends nothing, are problems."""
    rows = ledger.groupBy("surface").agg(F.count("*").alias("rows"), F.min("decision").alias("decision"))
    parts = slices.groupBy("surface").agg(F.count("*").alias("slices"))
    j = surfaces.join(rows, "surface", "left").join(parts, "surface", "left")
    problem = F.when(F.col("rows").isNull(), "no ledger row").when(F.col("rows") > 1, "several ledger rows").when((F.col("decision") == "send") & F.col("slices").isNull(), "nothing to send")
    return j.select("surface", "decision", F.coalesce("slices", F.lit(0)).alias("slices"), problem.alias("problem"))


def selected(slices: DataFrame, ledger: DataFrame, strict: bool = True) -> DataFrame:
    """(slice, surface, rejected): one work item for each slice (slice, surface) whose ledger
    row says send; any other raises when read, or is marked where not ``strict``."""
    j = slices.join(ledger, "surface", "left")
    bad = F.when(F.col("decision").isNull(), "no ledger row").when(F.col("decision") != "send", "not to be sent")
    told = F.when(bad.isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("slice"), F.col("slice").cast("string"), bad))) if strict else bad
    return j.select("slice", "surface", told.cast("string").alias("rejected"))


def normalized(candidates: DataFrame) -> DataFrame:
    """All candidates (site, key, role, returns), and for those that return something a
    sibling of role ``returned`` unless its key is there already."""
    more = candidates.where("returns and role <> 'returned'").select("site", F.concat_ws("|", "site", F.lit("returned")).alias("key"), F.lit("returned").alias("role")).distinct()
    return candidates.select("site", "key", "role").unionByName(more.join(candidates.select("key"), "key", "left_anti").select("site", "key", "role"))


DECISION = "decision string, kind string, confidence double, items array<string>"


def parsed(answers: DataFrame) -> DataFrame:
    """(id, decision, kind, items, problem) of answers (id, raw): the JSON object in the text,
    also inside a code fence; what is no object, or no known decision, is a problem."""
    body = F.regexp_extract("raw", r"(?s)(\{.*\})", 1)
    got = F.from_json(body, DECISION)
    known = F.lower(F.trim(got["decision"]))
    problem = F.when(body == "", "no object").when(got.isNull() | got["decision"].isNull(), "unreadable").when(~known.isin("accept", "reject", "more"), "unknown decision")
    return answers.select("id", F.when(problem.isNull(), known).alias("decision"), got["kind"].alias("kind"), F.size(F.coalesce(got["items"], F.array().cast("array<string>"))).alias("items"), problem.alias("problem"))


MUTATIONS = ("rename", "comment", "blank", "wrap")


def mutated(sources: DataFrame, name: str, new: str) -> DataFrame:
    """(id, mutation, text): variants of source texts (id, text) that must not change what
    is found: a name renamed, a comment in front, blank lines, a block around."""
    text = F.col("text")
    made = {"rename": F.regexp_replace(text, rf"\b{name}\b", new), "comment": F.concat(F.lit("// same\n"), text), "blank": F.replace(text, F.lit("\n"), F.lit("\n\n")), "wrap": F.concat(F.lit("{\n"), text, F.lit("\n}"))}
    return sources.select("id", F.inline(F.array(*[F.struct(F.lit(m).alias("mutation"), made[m].alias("text")) for m in MUTATIONS])))
