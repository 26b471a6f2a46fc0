"""Field facts: accesses, indexes over what bases point to, and the rules of literals,
unresolved receivers, arguments, entries, query results, mirrors and captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..plans.fixpoint import cut, fixpoint
from .pairs import distinct_pairs

WAYS = ("instance", "static", "array")


def projection(path: Column, precision: Column) -> Column:
    """struct(status, path, precision) of an endpoint's field: not-field without a path,
    invalid-field where nothing is left of it, else a location."""
    clean = paths.normalize(path)
    status = F.when(F.coalesce(F.size(path), F.lit(0)) <= 0, "not-field").when(F.coalesce(F.size(clean), F.lit(0)) <= 0, "invalid-field").otherwise("location")
    worse = F.when(paths.is_truncated(path) & (precision == "exact"), "partial").otherwise(precision)
    return F.struct(status.alias("status"), F.when(status == "location", paths.key(clean)).alias("path"), F.when(status == "location", worse).alias("precision"))


def accesses(assignments: DataFrame) -> DataFrame:
    """(stmt, access, way, base, field): stores on the left and loads on the right of
    assignments (stmt, left, right: struct<way, base, field>)."""
    sides = F.explode(F.array(F.struct(F.lit("store").alias("access"), F.col("left").alias("ref")), F.struct(F.lit("load").alias("access"), F.col("right").alias("ref"))))
    rows = assignments.select("stmt", sides.alias("s")).select("stmt", "s.access", "s.ref.way", "s.ref.base", "s.ref.field")
    return rows.where(F.col("way").isin(*WAYS)).withColumn("field", F.when(F.col("way") == "array", F.concat(F.lit("arr:"), F.coalesce("field", F.lit("*")))).otherwise(F.col("field")))


def field_index(loads: DataFrame, points_to: DataFrame) -> DataFrame:
    """(owner, field, targets): targets of loads (base, field, dst) under each object that
    the base points to (var, obj), or the base itself where it points to none."""
    j = loads.join(points_to, F.col("base") == F.col("var"), "left")
    return j.groupBy(F.coalesce("obj", "base").alias("owner"), "field").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def literal_captures(literals: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts (node, path array, source) of locals that an object literal (obj, key, node)
    holds: at the literal, under the key."""
    j = facts.join(literals, "node")
    return j.select(F.col("obj").alias("node"), paths.prepend(F.array("key"), F.col("path")).alias("path"), "source").distinct()


def this_loads(facts: DataFrame, loads: DataFrame, below: DataFrame) -> DataFrame:
    """(dst, source): loads of an unresolved receiver's field (file, class or null, field,
    dst) that a fact (file, class, field, source) meets: same file and field, and the class
    is the fact's or below it, or not known."""
    known = loads.where("class is not null")
    # a load asks for the classes above its own, or for any: facts spread over the classes below are many more
    up = below.select(F.col("descendant").alias("class"), "ancestor").distinct()
    shape = lambda df, any_, of: df.select("file", "field", F.lit(any_).alias("any"), of.cast("string").alias("class"), *[c for c in ("dst", "source") if c in df.columns])
    none = F.lit("")
    asked = shape(known.join(up, "class"), False, F.col("ancestor")).union(shape(loads.where("class is null"), True, none))
    given = shape(facts.where("class is not null"), False, F.col("class")).union(shape(facts, True, none))
    return distinct_pairs(asked, given, ["file", "field", "any", "class"], "dst", "source")


def reachable_loads(loads: DataFrame, methods: DataFrame) -> DataFrame:
    """Loads (method, ..) of reachable methods (method); without a method they stay."""
    return loads.where("method is null").unionByName(loads.join(methods.select("method").distinct(), "method", "left_semi").select(*loads.columns))


def argument_uses(facts: DataFrame, uses: DataFrame, aliases: DataFrame, done: DataFrame) -> DataFrame:
    """(arg, source): facts (obj, field, source) at field references in arguments (base,
    field, arg), through the base's aliases (base, obj), but for pairs already done (arg, source)."""
    held = uses.join(aliases, "base").join(facts, ["obj", "field"]).select("arg", "source").distinct()
    return held.join(done.select("arg", "source"), ["arg", "source"], "left_anti")


def from_entries(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts (node, source) of a row's second slot, at the object made from the rows under
    the constant of its first: rows (row, result, slot, node, text)."""
    keys = rows.where("slot = 0 and text is not null").select("row", F.col("text").alias("field"))
    values = rows.where("slot = 1").select("row", "result", "node")
    return values.join(keys, "row").join(facts, "node").select(F.col("result").alias("node"), "field", "source").distinct()


def query_results(queries: DataFrame, reads: DataFrame, facts: DataFrame) -> DataFrame:
    """(node, source): reads of one column (result, column, node) of a query's result, where
    the query (result, columns array) names it and a fact (result, field, source) is at it."""
    named = queries.select("result", F.explode("columns").alias("column"))
    at = facts.select("result", F.col("field").alias("column"), "source")
    return reads.join(named, ["result", "column"], "left_semi").join(at, ["result", "column"]).select("node", "source").distinct()


def mirrors(loads: DataFrame, stores: DataFrame) -> DataFrame:
    """(src, dst): bases whose field under one unresolved selector is loaded into a local
    (base, selector, local) and stored from it (base, selector, local) under the same."""
    l, s = loads.select(F.col("base").alias("src"), "selector", "local"), stores.select(F.col("base").alias("dst"), "selector", "local")
    return l.join(s, ["selector", "local"]).where("src <> dst").select("src", "dst").distinct()


def captured_writes(writes: DataFrame, captures: DataFrame) -> DataFrame:
    """(node, field, source): writes of a closure to a captured object (inner, field,
    source) at the object outside (inner, outer)."""
    return writes.join(captures, "inner").select(F.col("outer").alias("node"), "field", "source").distinct()


def put_effects(facts: DataFrame, puts: DataFrame) -> DataFrame:
    """(node, path, put): put effects (put, node, field) that a fact (node, path array)
    meets: of its node without a field, or under the head of its path."""
    whole = facts.join(puts.where("field is null").select("put", "node"), "node")
    head = facts.withColumn("field", F.try_element_at("path", F.lit(1))).join(puts.select("put", "node", "field"), ["node", "field"])
    return whole.select("node", "path", "put").unionByName(head.select("node", "path", "put")).distinct()


def alias_locals(points_to: DataFrame, carriers: DataFrame) -> DataFrame:
    """(carrier, local): locals whose objects (var, obj) hold a carrier's (carrier, obj)."""
    return carriers.join(points_to, "obj").select("carrier", F.col("var").alias("local")).distinct()


def carriers_at(values: DataFrame, assigns: DataFrame, objects: DataFrame, depth: int = 8) -> DataFrame:
    """(value, obj, truncated): objects (node, obj) that carry a value (value, node) over at
    most ``depth`` assignments (dst, src) behind it; ``truncated`` where more lie behind a
    node at that depth, whether or not they lead to something new."""
    ways = cut(assigns.select("dst", "src").distinct())
    step = lambda d, _: d.join(ways, F.col("node") == F.col("dst")).select("value", F.col("src").alias("node"))
    seen, _ = fixpoint(values.select("value", "node"), step, ["value", "node"], depth)
    short = seen.where(F.col("round") == depth).join(ways.select(F.col("dst").alias("node")), "node", "left_semi").select("value").distinct().withColumn("truncated", F.lit(True))
    found = seen.join(objects, "node").select("value", "obj").distinct()
    return found.join(short, "value", "left").select("value", "obj", F.coalesce("truncated", F.lit(False)).alias("truncated"))
