"""Queries over evidence, judgements and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effects as effect_ops
from ..operators import evidence as ops
from ..sources.fixtures import effects, read
from . import provenance
from .queries_effects import PAIRS_SQL
from .registry import query

EVIDENCE_SQL = """evidence AS (SELECT l_orderkey AS flow, l_orderkey * 10 + l_linenumber % 3 AS path, l_linenumber AS ord, CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'positive' ELSE 'neutral' END AS polarity,
  CASE WHEN l_quantity > 25 THEN 'strong' ELSE 'weak' END AS strength, CASE l_suppkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'sink' ELSE 'path' END AS scope, l_partkey % 5 <> 0 AS holds, 'r' || (l_partkey % 6) AS reason FROM lineitem),
ranked AS (SELECT *, CASE WHEN polarity = 'negative' AND strength = 'strong' AND scope = 'path' AND holds THEN 1 WHEN polarity = 'negative' AND scope IN ('path', 'sink', 'source') THEN 2 WHEN polarity = 'positive' THEN 3 ELSE 4 END AS rank FROM evidence),
judged AS (SELECT flow, path, ['Refuted-Strong', 'Refuted-Weak', 'Confirmed', 'Unresolved'][min(rank)] AS kind, CASE WHEN min(rank) < 4 THEN min_by(reason, (rank, ord, reason)) END AS reason, path % 7 = 0 AS incomplete FROM ranked GROUP BY flow, path),
settled AS (SELECT flow, path, CASE WHEN incomplete AND kind LIKE 'Refuted%' THEN 'Unresolved' ELSE kind END AS kind, CASE WHEN incomplete AND kind LIKE 'Refuted%' THEN 'path_incomplete' ELSE reason END AS reason, incomplete FROM judged),
flows AS (SELECT flow, CASE WHEN bool_and(kind LIKE 'Refuted%') AND bool_or(incomplete) THEN 'Unresolved' WHEN bool_and(kind = 'Refuted-Strong') THEN 'Refuted-Strong' WHEN bool_and(kind LIKE 'Refuted%') THEN 'Refuted-Weak'
    WHEN bool_or(kind = 'Confirmed') AND NOT bool_or(kind LIKE 'Refuted%') THEN 'Confirmed' ELSE 'Unresolved' END AS kind,
  CASE WHEN bool_and(kind LIKE 'Refuted%') AND bool_or(incomplete) THEN 'materialization_incomplete' WHEN bool_and(kind = 'Refuted-Strong') THEN 'all_paths_refuted_strong' WHEN bool_and(kind LIKE 'Refuted%') THEN 'all_paths_refuted'
    WHEN bool_or(kind = 'Confirmed') AND NOT bool_or(kind LIKE 'Refuted%') THEN 'path_confirmed' WHEN bool_or(kind LIKE 'Refuted%') THEN 'not_all_paths_refuted' ELSE 'no_decisive_evidence' END AS reason FROM settled GROUP BY flow),
counted AS (SELECT flow, path, CASE WHEN path % 7 = 0 AND path % 2 = 0 THEN 'truncated' WHEN path % 7 = 0 THEN 'cycle_blocked' WHEN kind = 'Confirmed' THEN 'confirmed' WHEN kind LIKE 'Refuted%' THEN 'refuted' ELSE 'near_hit_unresolved' END AS status FROM settled)"""


def _evidence(spark, sf_dir):
    k = F.col
    polarity = F.when(k("l_returnflag") == "R", "negative").when(k("l_returnflag") == "A", "positive").otherwise("neutral")
    scope = F.when(k("l_suppkey") % 4 == 0, "none").when(k("l_suppkey") % 4 == 1, "sink").otherwise("path")
    return read(spark, sf_dir, "lineitem").select(
        k("l_orderkey").alias("flow"), (k("l_orderkey") * 10 + k("l_linenumber") % 3).alias("path"), k("l_linenumber").alias("ord"), polarity.alias("polarity"),
        F.when(k("l_quantity") > 25, "strong").otherwise("weak").alias("strength"), scope.alias("scope"), (k("l_partkey") % 5 != 0).alias("holds"), F.concat(F.lit("r"), k("l_partkey") % 6).alias("reason"),
    )


def _settled(spark, sf_dir):
    judged = ops.path_judgements(_evidence(spark, sf_dir)).withColumn("incomplete", F.col("path") % 7 == 0)
    return ops.downgrade(judged)


@query(f"WITH {EVIDENCE_SQL} SELECT flow, path, kind, reason FROM settled")
def path_judgement(spark, sf_dir):
    return _settled(spark, sf_dir).select("flow", "path", "kind", "reason")


@query(f"WITH {EVIDENCE_SQL} SELECT flow, kind, reason FROM flows")
def flow_judgement(spark, sf_dir):
    return ops.flow_judgements(_settled(spark, sf_dir))


def _counted(spark, sf_dir):
    p = F.col("path")
    status = ops.path_countability(F.col("kind"), (p % 7 == 0) & (p % 2 == 0), p % 7 == 0)
    return _settled(spark, sf_dir).select("flow", "path", status.alias("status"))


@query(f"WITH {EVIDENCE_SQL} SELECT flow, path, status FROM counted")
def path_countability(spark, sf_dir):
    return _counted(spark, sf_dir)


@query(
    f"""WITH {EVIDENCE_SQL}, names AS (SELECT flow, kind FROM flows UNION ALL SELECT -n_nationkey - 1, 'Unresolved' FROM nation), g AS (SELECT flow, count(*) AS n, bool_or(status = 'confirmed') AS c, bool_or(status = 'truncated') AS t, bool_or(status = 'cycle_blocked') AS y FROM counted GROUP BY flow)
SELECT f.flow, CASE WHEN f.kind = 'Confirmed' AND c THEN 'confirmed' WHEN t THEN 'truncated' WHEN y THEN 'cycle_blocked' WHEN n IS NULL THEN 'out_of_scope' WHEN f.kind LIKE 'Refuted%' THEN 'refuted' ELSE 'near_hit_unresolved' END AS status FROM names f LEFT JOIN g ON g.flow = f.flow"""
)
def flow_countability(spark, sf_dir):
    flows = ops.flow_judgements(_settled(spark, sf_dir)).select("flow", "kind")
    empty = read(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("flow"), F.lit("Unresolved").alias("kind"))
    return ops.flow_countability(flows.union(empty), _counted(spark, sf_dir))


@query(f"WITH {EVIDENCE_SQL} SELECT kind, count(*) AS flows FROM flows GROUP BY kind")
def judgement_histogram(spark, sf_dir):
    return flow_judgement(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("flows"))


@query(f"WITH {EVIDENCE_SQL} SELECT flow, polarity, strength, scope, min_by(reason, (ord, reason)) AS reason FROM evidence GROUP BY flow, polarity, strength, scope")
def evidence_flatten(spark, sf_dir):
    return ops.flattened(_evidence(spark, sf_dir), ["flow", "polarity", "strength", "scope"], ["ord", "reason"]).select("flow", "polarity", "strength", "scope", "reason")


@query(
    PAIRS_SQL
    + """SELECT consumer AS flow, count(*) AS rows_, count_if(verdict IN ('dead', 'blocked-mismatch')) AS negative, count_if(verdict = 'live') AS positive FROM verdicts GROUP BY consumer"""
)
def currentness_evidence(spark, sf_dir):
    e = ops.currentness_evidence(effect_ops.currentness(effects(spark, sf_dir)))
    return e.groupBy("flow").agg(F.count("*").alias("rows_"), F.count_if(F.col("polarity") == "negative").alias("negative"), F.count_if(F.col("polarity") == "positive").alias("positive"))


STEPS_SQL = "steps AS (SELECT o_custkey AS path, o_orderkey AS idx, 'v' || (o_orderkey % 2) AS var, CASE WHEN o_orderkey % 9 = 0 THEN 'assign' WHEN o_orderkey % 3 = 1 THEN 'neq' ELSE 'eq' END AS op, o_orderstatus AS literal FROM orders)"


@query(
    f"""WITH {STEPS_SQL}, ep AS (SELECT *, sum(CASE WHEN op = 'assign' THEN 1 ELSE 0 END) OVER (PARTITION BY path, var ORDER BY idx) AS epoch FROM steps),
bad AS (SELECT a.path, a.idx, a.var, a.literal FROM ep a WHERE EXISTS (SELECT 1 FROM ep b WHERE b.path = a.path AND b.var = a.var AND b.epoch = a.epoch AND b.idx < a.idx AND ((a.op = 'eq' AND ((b.op = 'eq' AND b.literal <> a.literal) OR (b.op = 'neq' AND b.literal = a.literal))) OR (a.op = 'neq' AND b.op = 'eq' AND b.literal = a.literal))))
SELECT path, min(idx) AS idx, min_by(var, idx) AS var, min_by(literal, idx) AS literal FROM bad GROUP BY path"""
)
def path_guard_conflict(spark, sf_dir):
    k = F.col("o_orderkey")
    steps = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), k.alias("idx"), F.concat(F.lit("v"), k % 2).alias("var"), F.when(k % 9 == 0, "assign").when(k % 3 == 1, "neq").otherwise("eq").alias("op"), F.col("o_orderstatus").alias("literal"))
    return ops.guard_conflicts(steps)


@query(
    """WITH steps AS (SELECT o_custkey AS path, 'v' || (o_orderkey % 3) AS var, o_orderkey AS idx, CASE o_orderstatus WHEN 'F' THEN ['string', 'number'] WHEN 'O' THEN ['number', 'object'] ELSE ['string', 'object', 'number'] END AS tags, o_orderkey % 41 = 0 AS narrow FROM orders),
t AS (SELECT path, var, idx, unnest(CASE WHEN narrow THEN ['boolean'] ELSE tags END) AS tag FROM steps), n AS (SELECT path, var, count(*) AS n FROM steps GROUP BY path, var)
SELECT path, var FROM n WHERE NOT EXISTS (SELECT 1 FROM (SELECT path, var, tag, count(*) AS c FROM t GROUP BY path, var, tag) x WHERE x.path = n.path AND x.var = n.var AND x.c = n.n)"""
)
def type_narrowing_dead_branch(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    tags = F.when(k % 41 == 0, F.lit(["boolean"])).when(s == "F", F.lit(["string", "number"])).when(s == "O", F.lit(["number", "object"])).otherwise(F.lit(["string", "object", "number"]))
    return ops.dead_type_branches(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.concat(F.lit("v"), k % 3).alias("var"), k.alias("idx"), tags.alias("tags")))


@query(
    """WITH a AS (SELECT o_custkey % 50 AS method, o_orderstatus AS name, o_orderkey AS idx FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT o_orderkey AS id, o_custkey % 50 AS method, o_orderstatus AS name, o_orderkey AS lo, o_orderkey + 400 AS hi FROM orders WHERE o_orderkey % 2 = 1)
SELECT s.id, EXISTS (SELECT 1 FROM a WHERE a.method = s.method AND a.name = s.name AND a.idx > s.lo AND a.idx < s.hi) AS reassigned FROM s"""
)
def local_reassignment_between(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("method"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("k"))
    spans = o.where("k % 2 = 1").select(F.col("k").alias("id"), "method", "name", F.col("k").alias("lo"), (F.col("k") + 400).alias("hi"))
    return ops.reassigned_between(spans, o.where("k % 2 = 0").select("method", "name", F.col("k").alias("idx")))


@query(
    """WITH calls AS (SELECT l_partkey % 100 AS method, l_returnflag AS name, l_orderkey AS idx, 'api' || (l_suppkey % 10) AS api, l_linenumber FROM lineitem), one AS (SELECT method, name, idx, min(api) AS api FROM calls GROUP BY method, name, idx),
steps AS (SELECT o_orderkey AS path, o_custkey % 100 AS method, CASE o_orderstatus WHEN 'F' THEN 'A' ELSE 'R' END AS name, o_orderkey AS sink_idx FROM orders),
last AS (SELECT path, max_by(api, idx) AS api, max(idx) AS idx FROM steps JOIN one USING (method, name) WHERE idx < sink_idx GROUP BY path)
SELECT path, api, idx FROM last WHERE api IN ('api1', 'api4')"""
)
def sanitizer_evidence(spark, sf_dir):
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    calls = li.groupBy((F.col("l_partkey") % 100).alias("method"), F.col("l_returnflag").alias("name"), F.col("l_orderkey").alias("idx")).agg(F.min(F.concat(F.lit("api"), F.col("l_suppkey") % 10)).alias("api"))
    steps = o.select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 100).alias("method"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("R").alias("name"), F.col("o_orderkey").alias("sink_idx"))
    return ops.sanitizer_evidence(steps, calls, spark.createDataFrame([("api1",), ("api4",)], "api string"))


@query("SELECT p_partkey AS id FROM part WHERE p_size % 3 >= 1 AND p_size % 2 = 0 AND p_partkey % 4 < 2")
def parameterized_query_evidence(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size")
    arg0 = F.when(k % 4 == 0, " SELECT x FROM t WHERE a = ?").when(k % 4 == 1, "update t set a = ?").when(k % 4 == 2, "drop table t").otherwise("selection")
    return ops.parameterized(read(spark, sf_dir, "part").select(k.alias("id"), (z % 3).alias("arg"), F.when(z % 2 == 0, "constant").otherwise("local").alias("arg0_kind"), arg0.alias("arg0")))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 IN (0, 1)")
def storage_flag_evidence(spark, sf_dir):
    k = F.col("p_partkey")
    key = F.when(k % 4 == 0, "isDark").when(k % 4 == 1, "sound_enabled").when(k % 4 == 2, "hasToken").otherwise("name")
    return ops.storage_flags(read(spark, sf_dir, "part").select(k.alias("id"), key.alias("key"), F.when(k % 3 == 0, " True").otherwise("x").alias("default")))


# derivations: a layered graph with diamonds over parts
DERIVE_SQL = "derive AS (SELECT DISTINCT 'd' || src AS from_fact, 'd' || dst AS to_fact FROM (SELECT p_partkey % 60 AS src, unnest([p_partkey % 60 + 1, p_partkey % 60 + 7, CASE WHEN p_partkey % 60 % 10 = 9 THEN p_partkey % 60 - 4 ELSE p_partkey % 60 + 7 END]) AS dst FROM part))"


def _derive(spark, sf_dir):
    s = F.col("src")
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") % 60).alias("src")).distinct()
    d = p.select("src", F.explode(F.array(s + 1, s + 7, F.when(s % 10 == 9, s - 4).otherwise(s + 7))).alias("dst")).distinct()
    return d.select(F.concat(F.lit("d"), "src").alias("from_fact"), F.concat(F.lit("d"), "dst").alias("to_fact"))


def _sinks(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "fact string")


@query(
    f"""WITH RECURSIVE {DERIVE_SQL}, dag AS (SELECT 'd30' AS sink, 'd30' AS fact UNION SELECT 'd12', 'd12' UNION SELECT g.sink, d.from_fact FROM dag g JOIN derive d ON d.to_fact = g.fact) SELECT sink, fact FROM dag"""
)
def provenance_dag(spark, sf_dir):
    return provenance.backward_dag(_derive(spark, sf_dir), _sinks(spark, "d30", "d12")).select("sink", "fact")


@query(
    f"""WITH RECURSIVE {DERIVE_SQL}, walk AS (SELECT 'd12' AS sink, ['d12'] AS path UNION ALL SELECT w.sink, list_append(w.path, d.from_fact) FROM walk w JOIN derive d ON d.to_fact = w.path[-1] WHERE NOT list_contains(w.path, d.from_fact) AND len(w.path) < 30),
ended AS (SELECT sink, path FROM walk WHERE path[-1] NOT IN (SELECT to_fact FROM derive)), r AS (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY len(path), path) AS place, count(*) OVER (PARTITION BY sink) AS found FROM ended)
SELECT sink, array_to_string(path, '<') AS path, place, found FROM r WHERE place <= 16"""
)
def provenance_paths(spark, sf_dir):
    found = provenance.paths(_derive(spark, sf_dir), _sinks(spark, "d12"), max_paths=16)
    return found.select("sink", F.array_join("path", "<").alias("path"), "place", "found")


@query(None)
def provenance_status(spark, sf_dir):
    """Status of sinks under small budgets; held against golden cases in the tests."""
    found = provenance.paths(_derive(spark, sf_dir), _sinks(spark, "d12", "d3", "d5", "d61"), max_paths=4, max_depth=8)
    return found.groupBy("sink", "status", "reasons", "found").agg(F.count("path").alias("kept"))
