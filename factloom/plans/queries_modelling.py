"""Queries over specifications and their lowering, endpoints, evidence and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import endpoints as ops
from ..operators import lowering
from ..sources.fixtures import read
from .registry import query


def _c(name):
    return F.col(name)


@query("SELECT lower(trim(p_type)) AS kind, 'api' || (p_partkey % 30) AS api, 'a=' || (p_size % 3) || CASE WHEN p_size % 2 = 0 THEN ';b=x' ELSE '' END AS options, min(p_partkey) AS id FROM part GROUP BY 1, 2, 3")
def canonical_specs(spark, sf_dir):
    z = _c("p_size")
    option = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    spec = read(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.upper("p_type")).alias("kind"), F.concat(F.lit("api"), _c("p_partkey") % 30).alias("api"), F.array(option("B ", F.when(z % 2 == 0, "x ")), option("a", z % 3), option("A", z % 3), option("c", F.lit(" "))).alias("options"), _c("p_partkey").alias("id"))
    return lowering.canonical(spec).select("kind", "api", F.array_join(F.transform("options", lambda o: F.concat_ws("=", o["name"], o["value"])), ";").alias("options"), "id")


@query(
    """WITH b AS (SELECT p_partkey AS asset, 's' || i AS surface, 't' || ((p_size + i) % 9) AS template, i FROM part, range(3) r(i)), t AS (SELECT 't' || i AS template, CASE WHEN i < 4 THEN 'bridge' WHEN i < 6 THEN 'container' ELSE 'other' END AS kind FROM range(8) r(i))
SELECT asset, template, kind, CASE WHEN i < 2 THEN 'api' || (asset % 10) END AS api, CASE WHEN i = 2 THEN 'unknown surface' WHEN kind IS NULL THEN 'unknown template' WHEN kind = 'other' THEN 'unknown kind' END AS problem FROM b LEFT JOIN t USING (template)"""
)
def asset_lowering(spark, sf_dir):
    k, z = _c("p_partkey"), _c("p_size")
    surface = lambda i: F.struct(F.lit(f"s{i}").alias("id"), F.concat(F.lit("api"), k % 10).alias("api"))
    binding = lambda i: F.struct(F.lit(f"s{i}").alias("surface"), F.concat(F.lit("t"), (z + i) % 9).alias("template"))
    assets = read(spark, sf_dir, "part").select(k.alias("asset"), F.array(surface(0), surface(1)).alias("surfaces"), F.array(binding(0), binding(1), binding(2)).alias("bindings"))
    i = _c("id")
    templates = spark.range(8).select(F.concat(F.lit("t"), i).alias("template"), F.when(i < 4, "bridge").when(i < 6, "container").otherwise("other").alias("kind"))
    return lowering.lower_assets(assets, templates)


@query(
    """WITH sites AS (SELECT 'api' || (l_partkey % 4) AS api, l_orderkey AS site, l_orderkey AS receiver, 'arg' || (l_linenumber % 2) AS endpoint, l_orderkey * 10 + l_linenumber AS node FROM lineitem),
calls AS (SELECT 'api' || (l_partkey % 4) AS api, 'k' || l_orderkey AS key, l_orderkey * 10 + l_linenumber AS node, l_suppkey AS receiver FROM lineitem)
SELECT DISTINCT 'copy' AS kind, a.node AS src, b.node AS dst, CAST(NULL AS VARCHAR) AS field, a.site FROM sites a JOIN sites b ON a.receiver = b.receiver AND a.api = 'api0' AND b.api = 'api1' AND a.endpoint = 'arg0' AND b.endpoint = 'arg1'
UNION ALL SELECT 'store', node, receiver, '$c$:list:' || key, NULL FROM calls WHERE api = 'api2'
UNION ALL SELECT DISTINCT 'copy', a.node, b.node, NULL, CAST(NULL AS BIGINT) FROM calls a JOIN calls b USING (key) WHERE a.api = 'api2' AND b.api = 'api3'"""
)
def compiled_modules(spark, sf_dir):
    """One specification of three kinds, each by the lowering that consumes it."""
    rows = [("bridge", "api0", "api1", "arg0", "arg1", True, None, None), ("container", "api2", None, None, None, None, "list", "push"), ("route_bridge", "api2", None, None, None, None, None, "start"), ("route_bridge", "api3", None, None, None, None, None, "receive")]
    spec = spark.createDataFrame(rows, "kind string, api string, to_api string, from_ep string, to_ep string, same_receiver boolean, family string, capability string")
    k, n = _c("l_orderkey"), _c("l_linenumber")
    li = read(spark, sf_dir, "lineitem").withColumn("api", F.concat(F.lit("api"), _c("l_partkey") % 4))
    sites = li.select("api", k.alias("site"), k.alias("receiver"), F.concat(F.lit("arg"), n % 2).alias("endpoint"), (k * 10 + n).alias("node"))
    calls = li.select("api", F.concat(F.lit("k"), k).alias("key"), (k * 10 + n).alias("node"), _c("l_suppkey").alias("receiver"))
    return lowering.compiled(spec, {"sites": sites, "calls": calls})


@query("SELECT event_id AS effect, CASE WHEN event_type IN ('click', 'view') THEN 'c1' WHEN event_type = 'signup' THEN 'c2' END AS consumer, CASE event_type WHEN 'error' THEN 'no consumer' WHEN 'purchase' THEN 'several consumers' END AS problem FROM events")
def effect_dispatch(spark, sf_dir):
    consumers = spark.createDataFrame([("click", "c1"), ("view", "c1"), ("signup", "c2"), ("purchase", "c1"), ("purchase", "c3")], "kind string, consumer string")
    return lowering.dispatched(read(spark, sf_dir, "events").select(_c("event_id").alias("effect"), _c("event_type").alias("kind")), consumers)


@query("SELECT DISTINCT p_partkey % 100 || ':' || s_suppkey || ':t' || (p_size % 4) || ':' || o_orderkey AS effect, 'plane' || (p_partkey % 100 % 3) AS plane, 'kind' || (p_size % 4 % 2) AS kind, p_brand AS role, 'arg' || (p_size % 4) AS endpoint, o_orderkey AS site FROM part JOIN supplier ON s_suppkey % 100 = p_partkey % 100 JOIN orders ON o_custkey = s_suppkey")
def effect_instances(spark, sf_dir):
    k, s, i = _c("p_partkey"), _c("s_suppkey"), _c("id")
    assets = spark.range(100).select(i.alias("asset"), F.concat(F.lit("plane"), i % 3).alias("plane"))
    surfaces = read(spark, sf_dir, "supplier").select((s % 100).alias("asset"), s.alias("surface"), F.concat(F.lit("api"), s).alias("api"))
    bindings = read(spark, sf_dir, "part").select((k % 100).alias("asset"), F.concat(F.lit("t"), _c("p_size") % 4).alias("template"), _c("p_brand").alias("role")).distinct().join(surfaces.select("asset", "surface"), "asset")
    templates = spark.range(4).select(F.concat(F.lit("t"), i).alias("template"), F.concat(F.lit("kind"), i % 2).alias("kind"), F.concat(F.lit("arg"), i).alias("endpoint"))
    sites = read(spark, sf_dir, "orders").select(F.concat(F.lit("api"), "o_custkey").alias("api"), _c("o_orderkey").alias("site"))
    return lowering.instances(assets, surfaces, bindings, templates, sites)


@query("WITH s AS (SELECT l_suppkey AS cell, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS seq, l_linenumber AS n, l_returnflag AS f FROM lineitem) SELECT cell || '#' || seq AS id, cell, ['noop', 'store', 'store-clean', 'kill', 'load'][n % 5 + 1] AS kind, seq, CASE WHEN f = 'R' THEN 'weak' ELSE 'strong' END AS strength FROM s")
def built_effects(spark, sf_dir):
    n = _c("l_linenumber")
    op = F.when(n % 5 == 1, "write").when(n % 5 == 2, "clear").when(n % 5 == 3, "delete").when(n % 5 == 4, "read").otherwise("other")
    return lowering.built(read(spark, sf_dir, "lineitem").select(_c("l_orderkey").alias("stmt"), F.struct("l_linenumber", "l_partkey").alias("pos"), op.alias("op"), _c("l_suppkey").alias("cell"), F.when(_c("l_returnflag") == "R", "maybe").alias("label")))


@query("WITH i AS (SELECT p_brand AS plane, p_size % 7 AS id, p_partkey % 5 AS sub, min(p_name) AS text FROM part GROUP BY 1, 2, 3) SELECT plane, id, string_agg(sub || ':' || text, ',' ORDER BY sub) AS items FROM i GROUP BY plane, id")
def merged_augments(spark, sf_dir):
    item = F.array(F.struct((_c("p_partkey") % 5).alias("sub"), _c("p_name").alias("text")))
    found = lowering.merged(read(spark, sf_dir, "part").select(_c("p_brand").alias("plane"), (_c("p_size") % 7).alias("id"), item.alias("items")))
    return found.select("plane", "id", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["sub"], x["text"])), ",").alias("items"))


@query("SELECT p_partkey AS part, CASE WHEN p_size % 6 > 0 AND p_size % 5 > 0 THEN p_brand || CASE WHEN p_size % 2 = 0 THEN '::' ELSE '.' END || CASE WHEN p_size % 3 = 0 THEN 'constructor' ELSE p_name END || '(' || array_to_string(list_transform(range(p_size % 4), lambda i: 't' || i), ',') || ')' END AS id, CAST(p_size % 4 AS INTEGER) AS arity, CASE WHEN p_size % 6 > 0 AND p_size % 5 > 0 THEN CASE WHEN p_size % 3 = 0 THEN 'constructor' WHEN p_size % 2 = 0 THEN 'static' ELSE 'instance' END END AS form, CASE WHEN p_size % 6 = 0 THEN 'missing owner' WHEN p_size % 5 = 0 THEN 'missing name' END AS problem FROM part")
def descriptors(spark, sf_dir):
    z = _c("p_size")
    owner, name = F.when(z % 6 > 0, _c("p_brand")), F.when(z % 5 > 0, F.when(z % 3 == 0, "constructor").otherwise(_c("p_name"))).otherwise("")
    types = F.transform(F.when(z % 4 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), z % 4 - 1)), lambda i: F.concat(F.lit("t"), i))
    d = lowering.descriptor(owner, name, types, z % 2 == 0)
    return read(spark, sf_dir, "part").select(_c("p_partkey").alias("part"), d["id"].alias("id"), d["arity"].alias("arity"), d["form"].alias("form"), d["problem"].alias("problem"))


# ---------------------------------------------------------------- endpoints


@query("WITH f AS (SELECT o_orderkey AS base, 'next' AS field, o_orderkey // 2 AS value FROM orders), e AS (SELECT o_orderkey AS endpoint, o_orderkey AS base, o_orderkey % 10 AS steps FROM orders), x AS (SELECT endpoint, base, steps FROM e WHERE steps <= 8), y AS (SELECT endpoint, CAST(floor(base / pow(2, steps)) AS BIGINT) AS value, base, steps FROM x) SELECT endpoint, value FROM y WHERE steps = 0 OR CAST(floor(base / pow(2, steps - 1)) AS BIGINT) IN (SELECT base FROM f)")
def endpoint_values(spark, sf_dir):
    k = _c("o_orderkey")
    o = read(spark, sf_dir, "orders")
    path = F.array_repeat(F.lit("next"), (k % 10).cast("int"))
    return ops.runtime_values(o.select(k.alias("endpoint"), k.alias("base"), path.alias("path")), o.select(k.alias("base"), F.lit("next").alias("field"), F.floor(k / 2).alias("value")))


@query(
    """WITH e AS (SELECT o_orderkey AS endpoint, o_custkey AS base, o_orderkey % 3 AS deep, o_orderkey % 11 = 0 AS spread, o_orderkey % 2 = 0 AS exact FROM orders), n1 AS (SELECT l_orderkey AS endpoint, min(l_partkey) AS node FROM lineitem WHERE l_quantity > 48 GROUP BY 1), n2 AS (SELECT l_orderkey AS endpoint, min(l_suppkey) AS node FROM lineitem WHERE l_quantity < 4 GROUP BY 1),
n3 AS (SELECT l_orderkey AS endpoint, min(l_suppkey) AS node FROM lineitem WHERE l_discount > 0.08 AND l_tax > 0.05 GROUP BY 1), c AS (SELECT c_custkey AS base, c_nationkey AS node FROM customer WHERE c_acctbal > 0),
j AS (SELECT e.*, n1.node AS a, n2.node AS b, n3.node AS d, c.node AS k FROM e LEFT JOIN n1 USING (endpoint) LEFT JOIN n2 USING (endpoint) LEFT JOIN n3 USING (endpoint) LEFT JOIN c USING (base)),
r AS (SELECT *, CASE WHEN a IS NOT NULL THEN 'explicit' WHEN b IS NOT NULL THEN 'access-path' WHEN d IS NOT NULL THEN 'value' WHEN k IS NOT NULL AND deep > 0 THEN 'carrier' WHEN exact THEN 'new' ELSE 'unresolved' END AS reason FROM j)
SELECT endpoint, CASE WHEN reason = 'carrier' THEN k ELSE coalesce(a, b, d) END AS node, CASE WHEN spread THEN 'arr:*' WHEN reason = 'carrier' THEN array_to_string(list_transform(range(deep), lambda i: 'f'), '.') END AS field, CASE reason WHEN 'unresolved' THEN 'unresolved' WHEN 'new' THEN 'to-create' ELSE 'resolved' END AS status, reason FROM r"""
)
def endpoint_nodes(spark, sf_dir):
    k = _c("o_orderkey")
    endpoints = read(spark, sf_dir, "orders").select(k.alias("endpoint"), _c("o_custkey").alias("base"), F.array_repeat(F.lit("f"), (k % 3).cast("int")).alias("path"), (k % 11 == 0).alias("spread"), (k % 2 == 0).alias("exact"))
    li = read(spark, sf_dir, "lineitem")
    at = lambda cond, col: li.where(cond).select(_c("l_orderkey").alias("endpoint"), _c(col).alias("node"))
    carriers = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(_c("c_custkey").alias("base"), _c("c_nationkey").cast("long").alias("node"))
    return ops.projected(endpoints, at("l_quantity > 48", "l_partkey"), at("l_quantity < 4", "l_suppkey"), at("l_discount > 0.08 and l_tax > 0.05", "l_suppkey"), carriers)


@query("WITH v AS (SELECT o_orderkey AS value, o_custkey AS method, o_orderstatus AS name FROM orders), a AS (SELECT l_orderkey AS value, min(l_partkey) AS node FROM lineitem WHERE l_quantity > 45 GROUP BY 1), b AS (SELECT c_custkey AS method, 'F' AS name, c_custkey * 2 AS node FROM customer), c AS (SELECT l_orderkey AS value, min(l_suppkey) AS node FROM lineitem WHERE l_quantity < 10 GROUP BY 1) SELECT value, coalesce(a.node, b.node, c.node) AS node, CASE WHEN a.node IS NOT NULL THEN 'direct' WHEN b.node IS NOT NULL THEN 'local' WHEN c.node IS NOT NULL THEN 'resolved' ELSE 'missing' END AS how FROM v LEFT JOIN a USING (value) LEFT JOIN b USING (method, name) LEFT JOIN c USING (value)")
def existing_nodes(spark, sf_dir):
    values = read(spark, sf_dir, "orders").select(_c("o_orderkey").alias("value"), _c("o_custkey").alias("method"), _c("o_orderstatus").alias("name"))
    li = read(spark, sf_dir, "lineitem")
    at = lambda cond, col: li.where(cond).select(_c("l_orderkey").alias("value"), _c(col).alias("node"))
    locals_ = read(spark, sf_dir, "customer").select(_c("c_custkey").alias("method"), F.lit("F").alias("name"), (_c("c_custkey") * 2).alias("node"))
    return ops.existing(values, at("l_quantity > 45", "l_partkey"), locals_, at("l_quantity < 10", "l_suppkey"))


@query("WITH n AS (SELECT p_partkey AS value, p_partkey * 2 AS node FROM part WHERE p_size > 10), f AS (SELECT p_partkey AS value, row_number() OVER (ORDER BY p_partkey) AS place FROM part WHERE p_size <= 10 AND p_size % 2 = 0) SELECT value, node, false AS made FROM n UNION ALL SELECT value, (SELECT max(node) FROM n) + place, true FROM f")
def materialized_nodes(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), _c("p_partkey")
    return ops.materialized(p.select(k.alias("value"), (_c("p_size") % 2 == 0).alias("buildable")), p.where("p_size > 10").select(k.alias("value"), (k * 2).alias("node")))


@query("WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS occurrence, l_suppkey AS file, l_returnflag AS name, l_partkey AS receiver FROM lineitem) SELECT DISTINCT occurrence, 'name' AS kind, name AS detail FROM o UNION SELECT occurrence, 'import', s_name FROM o JOIN supplier ON s_suppkey = file AND name = 'A' UNION SELECT occurrence, 'receiver-type', p_type FROM o JOIN part ON p_partkey = receiver UNION SELECT occurrence, 'declaration', r_name FROM o JOIN region ON name = CASE WHEN r_regionkey < 2 THEN 'R' ELSE 'N' END")
def occurrence_evidence(spark, sf_dir):
    occurrences = read(spark, sf_dir, "lineitem").select((_c("l_orderkey") * 10 + _c("l_linenumber")).alias("occurrence"), _c("l_suppkey").alias("file"), _c("l_returnflag").alias("name"), _c("l_partkey").alias("receiver"))
    imports = read(spark, sf_dir, "supplier").select(_c("s_suppkey").alias("file"), F.lit("A").alias("name"), _c("s_name").alias("module"))
    receivers = read(spark, sf_dir, "part").select(_c("p_partkey").alias("receiver"), _c("p_type").alias("type"))
    declarations = read(spark, sf_dir, "region").select(F.when(_c("r_regionkey") < 2, "R").otherwise("N").alias("name"), _c("r_name").alias("owner"))
    return ops.occurrence_evidence(occurrences, imports, receivers, declarations)


BOOT_SQL = "a AS (SELECT p_partkey AS asset, CASE p_size % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'reviewed' ELSE 'draft' END AS status, p_partkey % 7 <> 0 AS valid, p_name AS key FROM part), b AS (SELECT *, min(CASE WHEN status <> 'draft' AND valid THEN asset END) OVER (PARTITION BY key) AS first FROM a)"


@query(f"WITH {BOOT_SQL} SELECT asset, key, CASE WHEN status = 'draft' THEN 'not trusted' WHEN NOT valid THEN 'invalid' WHEN asset <> first THEN 'duplicate key' END AS problem FROM b")
def registry_bootstrap(spark, sf_dir):
    k, z = _c("p_partkey"), _c("p_size")
    assets = read(spark, sf_dir, "part").select(k.alias("asset"), F.when(z % 3 == 0, "official").when(z % 3 == 1, "reviewed").otherwise("draft").alias("status"), (k % 7 != 0).alias("valid"), _c("p_name").alias("key"))
    good, bad = ops.bootstrapped(assets, ("official", "reviewed"))
    return good.select("asset", "key", F.lit(None).cast("string").alias("problem")).union(bad.join(assets.select("asset", "key"), "asset").select("asset", "key", "problem"))


PACK_SQL = "s AS (SELECT o_orderkey AS surface FROM orders), l AS (SELECT l_orderkey AS surface, count(*) AS rows, min(CASE WHEN l_returnflag = 'R' THEN 'skip' ELSE 'send' END) AS decision FROM lineitem WHERE l_linenumber < 3 GROUP BY 1), x AS (SELECT l_orderkey AS surface, count(*) AS slices FROM lineitem WHERE l_quantity > 25 GROUP BY 1)"


@query(f"WITH {PACK_SQL} SELECT surface, decision, coalesce(slices, 0) AS slices, CASE WHEN rows IS NULL THEN 'no ledger row' WHEN rows > 1 THEN 'several ledger rows' WHEN decision = 'send' AND slices IS NULL THEN 'nothing to send' END AS problem FROM s LEFT JOIN l USING (surface) LEFT JOIN x USING (surface)")
def evidence_pack(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    ledger = li.where("l_linenumber < 3").select(_c("l_orderkey").alias("surface"), F.when(_c("l_returnflag") == "R", "skip").otherwise("send").alias("decision"))
    slices = li.where("l_quantity > 25").select(_c("l_orderkey").alias("surface"), _c("l_linenumber").alias("slice"))
    return ops.evidence_pack(read(spark, sf_dir, "orders").select(_c("o_orderkey").alias("surface")), ledger, slices)


@query("SELECT l_orderkey * 10 + l_linenumber AS slice, l_orderkey AS surface, CASE WHEN o_custkey % 6 = 0 THEN 'no ledger row' WHEN o_orderstatus = 'P' THEN 'not to be sent' END AS rejected FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def slice_selection(spark, sf_dir):
    slices = read(spark, sf_dir, "lineitem").select((_c("l_orderkey") * 10 + _c("l_linenumber")).alias("slice"), _c("l_orderkey").alias("surface"))
    ledger = read(spark, sf_dir, "orders").where("o_custkey % 6 <> 0").select(_c("o_orderkey").alias("surface"), F.when(_c("o_orderstatus") == "P", "skip").otherwise("send").alias("decision"))
    return ops.selected(slices, ledger, strict=False)


@query("WITH c AS (SELECT o_custkey AS site, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey || '|returned' ELSE 'k' || o_orderkey END AS key, CASE WHEN o_orderkey % 9 = 0 THEN 'returned' ELSE 'arg' END AS role, o_orderkey % 2 = 0 AS returns FROM orders) SELECT site, key, role FROM c UNION ALL (SELECT DISTINCT site, site || '|returned', 'returned' FROM c WHERE returns AND role <> 'returned' AND site || '|returned' NOT IN (SELECT key FROM c))")
def candidate_normalization(spark, sf_dir):
    k, c = _c("o_orderkey"), _c("o_custkey")
    rows = read(spark, sf_dir, "orders").select(c.alias("site"), F.when(k % 9 == 0, F.concat_ws("|", c, F.lit("returned"))).otherwise(F.concat(F.lit("k"), k)).alias("key"), F.when(k % 9 == 0, "returned").otherwise("arg").alias("role"), (k % 2 == 0).alias("returns"))
    return ops.normalized(rows)


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 < 3 THEN ['accept', 'reject', 'more'][s_suppkey % 5 + 1] END AS decision, CASE WHEN s_suppkey % 5 < 4 THEN s_name END AS kind, CAST(CASE WHEN s_suppkey % 5 < 4 THEN 2 ELSE 0 END AS INTEGER) AS items, CASE s_suppkey % 5 WHEN 3 THEN 'unknown decision' WHEN 4 THEN 'no object' END AS problem FROM supplier")
def asset_decisions(spark, sf_dir):
    s = _c("s_suppkey")
    word = F.element_at(F.lit([" Accept", "reject", "MORE ", "perhaps"]), (s % 5 + 1).cast("int"))
    body = F.concat(F.lit('```json\n{"decision": "'), word, F.lit('", "kind": "'), "s_name", F.lit('", "items": ["a", "b"]}\n```'))
    return ops.parsed(read(spark, sf_dir, "supplier").select(s.alias("id"), F.when(s % 5 < 4, body).otherwise("I cannot say").alias("raw")))


@query("WITH s AS (SELECT p_partkey AS id, 'let x = ' || p_name || chr(10) || 'sink(x)' AS text FROM part) SELECT id, 'rename' AS mutation, replace(replace(text, 'let x', 'let y'), '(x)', '(y)') AS text FROM s UNION ALL SELECT id, 'comment', '// same' || chr(10) || text FROM s UNION ALL SELECT id, 'blank', replace(text, chr(10), chr(10) || chr(10)) FROM s UNION ALL SELECT id, 'wrap', '{' || chr(10) || text || chr(10) || '}' FROM s")
def metamorphic_mutations(spark, sf_dir):
    sources = read(spark, sf_dir, "part").select(_c("p_partkey").alias("id"), F.concat(F.lit("let x = "), "p_name", F.lit("\nsink(x)")).alias("text"))
    return ops.mutated(sources, "x", "y")
