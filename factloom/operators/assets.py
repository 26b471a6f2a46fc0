"""Rules, assets and API identity: lowering, coverage, occurrences, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def endpoint_relation(base: Column, path: Column, other_base: Column, other_path: Column) -> Column:
    """exact, subsumes, subsumed-by or disjoint; unknown if one side is missing."""
    prefix = lambda p, q: (F.size(p) < F.size(q)) & (F.slice(q, F.lit(1), F.size(p)) == p)
    return (
        F.when(base.isNull() & other_base.isNull(), "exact").when(base.isNull() | other_base.isNull(), "unknown").when(base != other_base, "disjoint")
        .when(path == other_path, "exact").when(prefix(path, other_path), "subsumes").when(prefix(other_path, path), "subsumed-by").otherwise("disjoint")
    )


def guard_relation(a: Column, b: Column) -> Column:
    """equivalent, overlap or disjoint of two lists of conditions (struct subject, value):
    disjoint if some subject must have different values."""
    clash = F.exists(a, lambda x: F.exists(b, lambda y: (x["subject"] == y["subject"]) & (x["value"] != y["value"])))
    return F.when(a.isNull() & b.isNull(), "equivalent").when(a.isNull() | b.isNull(), "overlap").when(a == b, "equivalent").when(clash, "disjoint").otherwise("overlap")


def coverage(queries: DataFrame, bindings: DataFrame) -> DataFrame:
    """(query, status) of coverage queries (query, api, role, base, path) against bindings
    (binding, api, role, base, path, completeness, confidence), by the first status
    that holds: identity-unresolved, not-covered, role missing, exact, partial."""
    b = bindings.select(F.col("api").alias("b_api"), F.col("role").alias("b_role"), F.col("base").alias("b_base"), F.col("path").alias("b_path"), "completeness", "confidence")
    j = queries.join(b, F.col("api") == F.col("b_api"), "left")
    relation = endpoint_relation(F.col("b_base"), F.col("b_path"), F.col("base"), F.col("path"))
    j = j.withColumns({"hit": F.col("b_api").isNotNull(), "role_hit": F.coalesce(F.col("role") == F.col("b_role"), F.lit(False)), "relation": relation})
    near = F.col("role_hit") & (F.col("relation") != "disjoint")
    full = near & ((F.col("relation") == "exact") | ((F.col("relation") == "subsumes") & (F.col("completeness") == "complete"))) & (F.col("confidence") != "unknown")
    g = j.groupBy("query").agg(F.first("api").alias("api"), F.bool_or("hit").alias("hit"), F.bool_or("role_hit").alias("role_hit"), F.bool_or(near).alias("near"), F.bool_or(full).alias("full"))
    status = (
        F.when(F.col("api").isNull(), "identity-unresolved").when(~F.col("hit"), "not-covered").when(~F.col("role_hit"), "covered-surface-but-role-missing")
        .when(F.col("full"), "covered-exact-role").when(F.col("near"), "covered-partial").otherwise("not-covered")
    )
    return g.select("query", status.alias("status"))


def lowered(surfaces: DataFrame, bindings: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (binding, api, kind) of surfaces (surface, api) x bindings (binding, surface,
    refs) x templates (template, kind), and dangling references."""
    refs = bindings.select("binding", "surface", F.explode("refs").alias("template"))
    known = refs.join(templates, "template")
    rules = known.join(surfaces, "surface").select("binding", "api", "kind", "template")
    return rules, refs.join(templates, "template", "left_anti").select("binding", "template")


def effect_sites(rules: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One site for each rule and accepted occurrence (site, api, status) with an exact endpoint."""
    ok = occurrences.where("status = 'accepted' and endpoint_status = 'exact'")
    return rules.join(ok, "api").select(F.concat_ws(":", "binding", "template", "site").alias("effect"), "api", "site", "kind")


def resolved(evidence: DataFrame) -> DataFrame:
    """(occurrence, status, api, kind): one accepted id wins, several conflict; else
    ambiguous before rejected before unresolved; evidence: (occurrence, status, api, kind, priority)."""
    ok = F.col("status") == "accepted"
    g = evidence.groupBy("occurrence").agg(F.array_sort(F.collect_set(F.when(ok, F.col("api")))).alias("ids"), F.min_by("kind", F.struct("priority", "kind")).alias("kind"), F.bool_or(F.col("status") == "ambiguous").alias("amb"), F.bool_or(F.col("status") == "rejected").alias("rej"))
    n = F.size("ids")
    status = F.when(n == 1, "accepted").when((n > 1) | F.col("amb"), "ambiguous").when(F.col("rej"), "rejected").otherwise("unresolved")
    return g.select("occurrence", status.alias("status"), F.when(n == 1, F.col("ids")[0]).alias("api"), "kind")


def registry_lookup(requests: DataFrame, index: DataFrame) -> DataFrame:
    """(request, status, api): the best kind of key that hits decides; equivalent ids
    (same ``equiv``) are one; index: (rank, key, api, equiv), requests: (request, keys array<struct<rank, key>>)."""
    asked = requests.select("request", F.explode("keys").alias("k")).select("request", "k.rank", "k.key")
    # of each key only what decides: whether its ids are equivalent, and the first of them
    known = index.groupBy("rank", "key").agg(F.min("equiv").alias("lo"), F.max("equiv").alias("hi"), F.min("api").alias("api"))
    hits = asked.join(known, ["rank", "key"])
    w = Window.partitionBy("request")
    best = hits.withColumn("best", F.min("rank").over(w)).where("rank = best")
    g = best.groupBy("request").agg(F.when(F.min("lo") == F.max("hi"), 1).otherwise(2).alias("n"), F.min("api").alias("first"))
    out = requests.select("request").join(g, "request", "left")
    return out.select("request", F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("first")).alias("api"))


def mirror_groups(descriptors: DataFrame) -> DataFrame:
    """(key, members, representative) of descriptors (api, key)."""
    return descriptors.groupBy("key").agg(F.count("*").alias("members"), F.min("api").alias("representative"))


def promoted(assets: DataFrame, surfaces: DataFrame, backed: DataFrame) -> DataFrame:
    """Assets (asset, status, reviewer, valid) that pass: reviewed or replayed, a
    reviewer, valid, and every surface (asset, surface) among the backed ones."""
    loose = surfaces.join(backed, "surface", "left_anti").select("asset")
    return assets.where("status in ('reviewed', 'replayed') and reviewer is not null and valid").join(loose, "asset", "left_anti").select("asset")


def loadable(assets: DataFrame, evaluation: bool = False) -> DataFrame:
    good = ["reviewed", "replayed", "official"] + (["schema-valid"] if evaluation else [])
    return assets.where(F.col("status").isin(*good))


def document_errors(surfaces: DataFrame, bindings: DataFrame) -> DataFrame:
    """(id, error): duplicate ids, dangling surfaces and bindings without effect."""
    double = bindings.groupBy("binding").count().where("count > 1").select(F.col("binding").alias("id"), F.lit("duplicate id").alias("error"))
    dangling = bindings.join(surfaces, "surface", "left_anti").select(F.col("binding").alias("id"), F.lit("unknown surface").alias("error"))
    bare = bindings.where(F.coalesce(F.size("refs"), F.lit(0)) <= 0).select(F.col("binding").alias("id"), F.lit("no effect").alias("error"))
    return double.union(dangling).union(bare)


def callsite_slices(calls: DataFrame, around: int = 2) -> DataFrame:
    """The names of the statements before and after each call of a method."""
    w = Window.partitionBy("method").orderBy("idx")
    names = [F.lag("name", i).over(w) for i in range(around, 0, -1)], [F.lead("name", i).over(w) for i in range(1, around + 1)]
    return calls.select("method", "idx", F.concat_ws(",", *names[0]).alias("before"), F.concat_ws(",", *names[1]).alias("after"))


def completion_semantics(method: Column, args: Column, ports: Column, resumes: Column) -> Column:
    """struct(activation, completion, preserve, role) of a promise continuation; null if none."""
    where = F.when(resumes, "await_site").otherwise("promise_chain")
    row = lambda a, p, r: F.struct(F.lit(a).alias("activation"), where.alias("completion"), p.alias("preserve"), F.lit(r).alias("role"))
    some = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    has = lambda i: F.array_contains(args, i)
    return (
        F.when((method == "finally") & has(0) & (ports == 0), row("settle(any)", some("settle(any)"), "observe"))
        .when((method == "catch") & has(0), row("settle(rejected)", some("settle(fulfilled)"), "error"))
        .when((method == "then") & has(0), row("settle(fulfilled)", F.when(has(1), some()).otherwise(some("settle(rejected)")), "value"))
        .when((method == "then") & has(1), row("settle(rejected)", some(), "error"))
    )


def unit_summary(ports: DataFrame) -> DataFrame:
    """Deferred units (unit, port, role): payload and captured ports, reads and writes of the environment."""
    r = F.col("role")
    return ports.groupBy("unit").agg(F.count_if(r == "payload").alias("payload"), F.count_if(r == "capture").alias("captures"), F.countDistinct(F.when(r == "read", F.col("port"))).alias("reads"), F.countDistinct(F.when(r == "write", F.col("port"))).alias("writes"))


def deferred_edges(contracts: DataFrame) -> DataFrame:
    """Edges of contracts (contract, activation, sources, targets, kind): direct calls
    are left out, each source meets each target once."""
    open_ = contracts.where("activation <> 'call(c)'").dropDuplicates(["contract"])
    return open_.select(F.explode("sources").alias("src"), "targets", "kind").select("src", F.explode("targets").alias("dst"), "kind").distinct()


def argument_edges(calls: DataFrame, params: DataFrame) -> DataFrame:
    """Copy edges from arguments to parameters by position, up to the first one missing;
    constants and expressions are skipped; calls: (site, callee, args array<struct<node, kind>>), params: (callee, pos, param)."""
    flat = calls.select("site", "callee", F.posexplode("args").alias("pos", "arg"))
    gap = F.min(F.when(F.col("param").isNull(), F.col("pos"))).over(Window.partitionBy("site"))
    j = flat.join(params, ["callee", "pos"], "left").withColumn("gap", gap)
    kept = j.where("param is not null and (gap is null or pos < gap) and arg.kind not in ('constant', 'expression')")
    return kept.select("site", F.col("arg.node").alias("src"), F.col("param").alias("dst"))


def return_edges(returns: DataFrame, calls: DataFrame) -> DataFrame:
    """Copy edges from returned locals (callee, node, is_local) to assigned results (site, callee, result)."""
    return returns.where("is_local").join(calls.where("result is not null"), "callee").select("site", F.col("node").alias("src"), F.col("result").alias("dst"))


def channel_pairs(registrations: DataFrame, emissions: DataFrame, limit: int = 8) -> DataFrame:
    """Handlers (owner, channel, handler) of emissions (owner, channel, payload), at most
    ``limit`` an emission; channels that are not literal (null) match nothing."""
    w, own = Window.partitionBy("payload").orderBy("handler"), Window.partitionBy("owner", "channel").orderBy("handler")
    # of a channel's handlers no emission keeps more than its first ones
    registrations = registrations.where("channel is not null").withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= limit).drop("__n")
    return emissions.join(registrations, ["owner", "channel"]).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).select("payload", "handler", "channel")


def route_mismatch(flows: DataFrame) -> DataFrame:
    """Flows (flow, dispatched, registered, pushed) whose keys cannot meet."""
    meet = F.array_intersect("dispatched", "registered")
    return flows.where((F.size(meet) > 0) & (F.size("pushed") > 0) & ~F.arrays_overlap(meet, F.col("pushed"))).select("flow")


def storage_effects(calls: DataFrame) -> DataFrame:
    """Put, get and kill rows of keyed storage calls (stmt, op, key, weak): a write that is
    not weak kills first; dynamic keys (null) give nothing."""
    c = calls.where("key is not null")
    rows = (
        F.when((F.col("op") == "write") & ~F.col("weak"), F.array(F.lit("kill"), F.lit("put")))
        .when(F.col("op") == "write", F.array(F.lit("put"))).when(F.col("op") == "delete", F.array(F.lit("kill"))).otherwise(F.array(F.lit("get")))
    )
    return c.select("stmt", "key", F.posexplode(rows).alias("pos", "effect")).select("stmt", "key", "effect", (F.col("stmt") * 10 + F.col("pos")).alias("seq"))
