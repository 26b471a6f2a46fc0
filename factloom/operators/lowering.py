"""Module specifications: canonical form, lowering of assets, dispatch by kind, and
effects made of templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import semantics

#: Which lowering consumes a kind: exactly one.
CONSUMERS = {
    "bridge": lambda spec, t: semantics.bridge(spec, t["sites"]),
    "container": lambda spec, t: semantics.container(spec, t["calls"]),
    "route_bridge": lambda spec, t: semantics.handoff_by_target(spec, t["calls"], "route_bridge"),
    "ability_handoff": lambda spec, t: semantics.handoff_by_target(spec, t["calls"], "ability_handoff"),
    "declarative_binding": lambda spec, t: semantics.declarative(spec, t["surfaces"], t["handlers"]),
    "state_binding": lambda spec, t: semantics.bindings(spec, t["fields"]),
}


def canonical(spec: DataFrame) -> DataFrame:
    """One row for each different (kind, api, options sorted by name, without empty values);
    ids (id) of equal rows are one, the smallest."""
    kept = F.filter("options", lambda o: o["value"].isNotNull() & (F.trim(o["value"]) != ""))
    clean = F.array_sort(F.array_distinct(F.transform(kept, lambda o: F.struct(F.lower(F.trim(o["name"])).alias("name"), F.trim(o["value"]).alias("value")))))
    return spec.select(F.lower(F.trim("kind")).alias("kind"), F.trim("api").alias("api"), clean.alias("options"), "id").groupBy("kind", "api", "options").agg(F.min("id").alias("id"))


def lower_assets(assets: DataFrame, templates: DataFrame, kinds: tuple[str, ...] = semantics.KINDS) -> DataFrame:
    """(asset, template, kind, api, problem) of assets (asset, surfaces array<struct<id, api>>,
    bindings array<struct<surface, template>>) and templates (template, kind): one row for
    each binding; ``problem`` names what it refers to in vain."""
    surfaces = assets.select("asset", F.inline("surfaces")).select("asset", F.col("id").alias("surface"), "api")
    bound = assets.select("asset", F.inline("bindings"))
    j = bound.join(surfaces, ["asset", "surface"], "left").join(templates, "template", "left")
    problem = F.when(F.col("api").isNull(), "unknown surface").when(F.col("kind").isNull(), "unknown template").when(~F.col("kind").isin(*kinds), "unknown kind")
    return j.select("asset", "template", "kind", "api", problem.alias("problem"))


def compiled(spec: DataFrame, tables: dict[str, DataFrame], consumers: dict | None = None) -> DataFrame:
    """Edges of all kinds that ``spec`` (kind, ..) holds; a kind without a consumer is an error."""
    consumers = consumers or CONSUMERS
    asked = sorted(r[0] for r in spec.select("kind").distinct().collect())  # kinds: a few names
    lost = [k for k in asked if k not in consumers]
    if lost:
        raise ValueError(f"no consumer of {lost}")
    out = None
    for kind in asked:
        edges = consumers[kind](spec.where(F.col("kind") == kind), tables)
        out = edges if out is None else out.unionByName(edges)
    return out


def dispatched(effects: DataFrame, consumers: DataFrame) -> DataFrame:
    """(effect, consumer, problem): effects (effect, kind) go to the one consumer of their
    kind (kind, consumer); none and several are problems."""
    one = consumers.groupBy("kind").agg(F.count("*").alias("n"), F.min("consumer").alias("consumer"))
    j = effects.join(one, "kind", "left")
    problem = F.when(F.col("n").isNull(), "no consumer").when(F.col("n") > 1, "several consumers")
    return j.select("effect", F.when(problem.isNull(), F.col("consumer")).alias("consumer"), problem.alias("problem"))


def instances(assets: DataFrame, surfaces: DataFrame, bindings: DataFrame, templates: DataFrame, sites: DataFrame) -> DataFrame:
    """Effect instances of asset x surface x binding x template x site: assets (asset,
    plane), surfaces (asset, surface, api), bindings (asset, surface, template, role),
    templates (template, kind, endpoint), sites (api, site)."""
    j = bindings.distinct().join(surfaces, ["asset", "surface"]).join(assets, "asset").join(templates, "template").join(sites, "api")
    ident = F.concat_ws(":", "asset", "surface", "template", "site")
    return j.select(ident.alias("effect"), "plane", "kind", "role", "endpoint", "site").distinct()


def built(rows: DataFrame) -> DataFrame:
    """Effects (id, kind, seq, strength) of steps (stmt, pos, op, cell, label): orders
    number the steps of a cell, strength is weak where the operation may not happen."""
    kind = F.when(F.col("op") == "write", "store").when(F.col("op") == "clear", "store-clean").when(F.col("op") == "delete", "kill").when(F.col("op") == "read", "load").otherwise("noop")
    seq = F.row_number().over(Window.partitionBy("cell").orderBy("stmt", "pos"))
    strength = F.when(F.col("label") == "maybe", "weak").otherwise("strong")
    return rows.select(F.concat_ws("#", "cell", seq).alias("id"), "cell", kind.alias("kind"), seq.cast("long").alias("seq"), strength.alias("strength"))


def merged(augments: DataFrame) -> DataFrame:
    """Assets of the same plane and id (plane, id, items array<struct<sub, text>>) are one:
    of equal sub-ids the first text stays."""
    one = augments.select("plane", "id", F.inline("items")).groupBy("plane", "id", "sub").agg(F.min("text").alias("text"))
    return one.groupBy("plane", "id").agg(F.array_sort(F.collect_list(F.struct("sub", "text"))).alias("items"))


def descriptor(owner: Column, name: Column, parameters: Column, static: Column) -> Column:
    """struct(id, arity, form, problem) of a declaration; without owner or name there is none."""
    problem = F.when(F.coalesce(owner, F.lit("")) == "", "missing owner").when(F.coalesce(name, F.lit("")) == "", "missing name")
    form = F.when(name == "constructor", "constructor").when(static, "static").otherwise("instance")
    ident = F.concat(owner, F.when(static, "::").otherwise("."), name, F.lit("("), F.array_join(parameters, ","), F.lit(")"))
    return F.struct(F.when(problem.isNull(), ident).alias("id"), F.size(parameters).alias("arity"), F.when(problem.isNull(), form).alias("form"), problem.alias("problem"))
