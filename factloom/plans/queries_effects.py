"""Queries over ordered state effects and handoffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effects as ops
from ..sources.fixtures import EFFECTS_SQL, effects, read
from .registry import query

PAIRS_SQL = f"""WITH {EFFECTS_SQL}, strong AS (
  SELECT * FROM effects WHERE kind IN ('store-clean', 'kill') AND precision = 'exact' AND strength <> 'weak' AND confidence <> 'unknown'
), verdicts AS (
  SELECT s.cell, s.id AS producer, l.id AS consumer, l.seq - s.seq - 1 AS between,
    CASE WHEN l.seq - s.seq - 1 > 128 THEN 'unknown'
      WHEN s.confidence = 'unknown' OR l.confidence = 'unknown' THEN 'unknown'
      WHEN l.precision = 'exact' AND EXISTS (SELECT 1 FROM strong k WHERE k.cell = s.cell AND k.seq > s.seq AND k.seq < l.seq) THEN 'dead'
      WHEN l.precision <> 'exact' OR s.precision <> 'exact' OR EXISTS (SELECT 1 FROM effects k WHERE k.kind IN ('store-clean', 'kill') AND k.cell = s.cell AND k.seq > s.seq AND k.seq < l.seq) THEN 'may-live'
      ELSE 'live' END AS verdict,
    CASE WHEN l.seq - s.seq - 1 > 128 THEN 'slice_incomplete'
      WHEN s.confidence = 'unknown' OR l.confidence = 'unknown' THEN 'unknown_model_confidence'
      WHEN l.precision = 'exact' AND EXISTS (SELECT 1 FROM strong k WHERE k.kind = 'kill' AND k.cell = s.cell AND k.seq > s.seq AND k.seq < l.seq) THEN 'strong_kill'
      WHEN l.precision = 'exact' AND EXISTS (SELECT 1 FROM strong k WHERE k.cell = s.cell AND k.seq > s.seq AND k.seq < l.seq) THEN 'strong_clean_overwrite'
      WHEN l.precision <> 'exact' OR s.precision <> 'exact' OR EXISTS (SELECT 1 FROM effects k WHERE k.kind IN ('store-clean', 'kill') AND k.cell = s.cell AND k.seq > s.seq AND k.seq < l.seq) THEN 'possible_update'
      ELSE 'no_intervening_update' END AS reason
  FROM effects s JOIN effects l ON s.cell = l.cell AND s.seq < l.seq WHERE s.kind = 'store' AND l.kind = 'load')
"""


@query(PAIRS_SQL + "SELECT * FROM verdicts")
def currentness_verdicts(spark, sf_dir):
    return ops.currentness(effects(spark, sf_dir))


@query(PAIRS_SQL + "SELECT cell, consumer, count(*) AS producers, min(producer) AS first_producer FROM verdicts WHERE verdict IN ('live', 'may-live', 'unknown') GROUP BY cell, consumer")
def currentness_sink_hits(spark, sf_dir):
    return ops.sink_hits(effects(spark, sf_dir))


@query(PAIRS_SQL + "SELECT cell, consumer, count(*) AS producers, min(producer) AS first_producer FROM verdicts WHERE verdict = 'live' GROUP BY cell, consumer")
def currentness_sink_hits_strict(spark, sf_dir):
    return ops.sink_hits(effects(spark, sf_dir), conservative=False)


@query(
    f"""WITH {EFFECTS_SQL}, touch AS (SELECT * FROM effects WHERE kind IN ('store', 'store-clean', 'kill'))
SELECT l.cell, l.id AS load_id, t.id AS store_id, t.kind AS store_kind,
  CASE WHEN t.id IS NULL OR t.kind = 'store' THEN 'live' ELSE 'dead' END AS state
FROM (SELECT * FROM effects WHERE kind = 'load') l LEFT JOIN touch t ON t.cell = l.cell AND t.seq = (SELECT max(seq) FROM touch x WHERE x.cell = l.cell AND x.seq < l.seq)"""
)
def latest_store_asof(spark, sf_dir):
    return ops.latest_store(effects(spark, sf_dir))


@query(
    f"""WITH {EFFECTS_SQL}, inside AS (
  SELECT s.id AS producer, l.id AS consumer, m.id AS mid, row_number() OVER (PARTITION BY s.id, l.id ORDER BY m.seq) AS place
  FROM effects s JOIN effects l ON s.cell = l.cell AND s.seq < l.seq JOIN effects m ON m.cell = s.cell AND m.seq > s.seq AND m.seq < l.seq
  WHERE s.kind = 'store' AND l.kind = 'load' AND m.kind IN ('kill', 'store-clean'))
SELECT producer, consumer, count_if(place <= 8) AS held, max(place) > 8 AS truncated, min_by(mid, place) AS first_mid FROM inside GROUP BY producer, consumer"""
)
def effect_slices(spark, sf_dir):
    return ops.effect_slices(effects(spark, sf_dir), limit=8)


CELLS = "SELECT c.cell_kind, p.precision, p.k FROM (VALUES ('map-entry'), ('object-field'), ('collection-element')) c(cell_kind) CROSS JOIN (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'unknown' END AS precision, 'k' || (o_orderkey % 4) AS k FROM orders WHERE o_orderkey < 40 GROUP BY 1, 2) p"


@query(
    f"""WITH cells AS ({CELLS})
SELECT l.cell_kind AS l_kind, r.cell_kind AS r_kind, l.k AS l_key, r.k AS r_key, l.precision AS l_precision, r.precision AS r_precision,
  CASE WHEN l.cell_kind = r.cell_kind AND l.k = r.k AND l.precision = r.precision THEN 'exact' WHEN l.cell_kind <> r.cell_kind THEN 'no'
    WHEN l.precision IN ('unknown', 'partial') OR r.precision IN ('unknown', 'partial') THEN 'may' WHEN l.k = r.k THEN 'exact' ELSE 'no' END AS compat
FROM cells l JOIN cells r ON l.cell_kind <= r.cell_kind AND l.k <= r.k"""
)
def cell_compatibility(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    c = spark.sql(CELLS).select(F.struct(F.col("cell_kind").alias("kind"), F.lit("u").alias("owner"), F.col("k").alias("key"), "precision").alias("c"))
    both = c.alias("l").join(c.alias("r"), (F.col("l.c.kind") <= F.col("r.c.kind")) & (F.col("l.c.key") <= F.col("r.c.key")))
    return both.select(*[F.col(f"{s}.c.{a}").alias(f"{s}_{a}") for a in ("kind", "key", "precision") for s in "lr"], ops.compatibility(F.col("l.c"), F.col("r.c")).alias("compat"))


PUTS = "SELECT 'h' || l_partkey AS key, l_orderkey * 10 + l_linenumber AS id, l_orderkey AS seq, 'w' || (l_suppkey % 4) AS scope, l_linenumber AS n FROM lineitem WHERE l_returnflag = '{}'"
LINKS = "SELECT 'h' || p_partkey AS a, 'h' || (p_partkey + 3) AS b FROM part WHERE p_size = 8"
HANDOFF_SQL = f"""WITH puts AS ({PUTS.format("A")}), gets AS ({PUTS.format("R")}), kills AS ({PUTS.format("N")}), links AS ({LINKS}), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
pairs AS (
  SELECT DISTINCT * FROM (
    SELECT p.id AS put_id, g.id AS get_id, p.seq AS put_seq, g.seq AS get_seq, p.scope AS put_scope, g.scope AS get_scope, p.key AS put_key, g.key AS get_key FROM puts p JOIN gets g ON p.key = g.key
    UNION ALL SELECT p.id, g.id, p.seq, g.seq, p.scope, g.scope, p.key, g.key FROM puts p JOIN ways w ON p.key = w.a JOIN gets g ON g.key = w.b)
  WHERE NOT (put_scope = get_scope AND get_seq < put_seq))
"""


def _handoff(spark, sf_dir):
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    read(spark, sf_dir, "part").createOrReplaceTempView("part")
    puts, gets, kills, links = (spark.sql(q) for q in (PUTS.format("A"), PUTS.format("R"), PUTS.format("N"), LINKS))
    return ops.handoff_pairs(puts, gets, links), kills


@query(HANDOFF_SQL + "SELECT put_key, get_key, count(*) AS pairs, sum(get_seq - put_seq) AS gap FROM pairs GROUP BY put_key, get_key")
def handoff_pairs(spark, sf_dir):
    pairs, _ = _handoff(spark, sf_dir)
    return pairs.groupBy("put_key", "get_key").agg(F.count("*").alias("pairs"), F.sum(F.col("get_seq") - F.col("put_seq")).alias("gap"))


@query(
    HANDOFF_SQL
    + """, counted AS (SELECT p.put_id, p.get_id, p.put_key, (SELECT count(*) FROM kills k WHERE k.key = p.put_key AND k.scope = p.put_scope AND k.seq > p.put_seq AND k.seq < p.get_seq) AS kills
  FROM pairs p WHERE p.put_scope = p.get_scope AND p.put_seq <> p.get_seq)
SELECT put_key, count(*) AS pairs, count_if(kills > 0) AS killed, CAST(sum(kills) AS BIGINT) AS kills FROM counted GROUP BY put_key"""
)
def handoff_kills_between(spark, sf_dir):
    pairs, kills = _handoff(spark, sf_dir)
    pairs = pairs.where("put_scope = get_scope and put_seq <> get_seq")
    return ops.kills_between(pairs, kills).groupBy("put_key").agg(F.count("*").alias("pairs"), F.count_if(F.col("kills") > 0).alias("killed"), F.sum("kills").alias("kills"))


@query(
    """SELECT o_orderkey AS id, 'k' || (o_custkey % 9) AS key, e.effect, o_orderkey * 2 + e.pos AS seq, 'strong' AS strength
FROM orders CROSS JOIN (VALUES ('kill', 0), ('put', 1)) e(effect, pos)"""
)
def kill_then_put(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return ops.kill_then_put(o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("k"), F.col("o_custkey") % 9).alias("key"), F.col("o_orderkey").alias("stmt")))


@query(f"WITH {EFFECTS_SQL} SELECT id, 'strong update of an imprecise cell' AS problem FROM effects WHERE strength = 'strong' AND precision <> 'exact' AND kind IN ('kill', 'store-clean')")
def effect_validation(spark, sf_dir):
    return ops.validate(effects(spark, sf_dir))


@query("SELECT user_id AS cell, event_id AS id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_store, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events")
def cell_epochs(spark, sf_dir):
    """Epochs of a cell between kills, and the largest store id so far."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("cell"), F.col("event_id").alias("id"), F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(w).alias("last_store"), F.sum((F.col("event_type") == "error").cast("long")).over(w).alias("epoch"))
