"""Program facts bound to the driver's tables, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State effects: one cell for each user, in order of (ts, event_id)."""
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "store").when(F.col("event_type") == "view", "store-clean").when(F.col("event_type") == "error", "kill").when(F.col("event_type") == "purchase", "load").otherwise("noop")
    return read(spark, sf_dir, "events").select(
        e.alias("id"),
        F.col("user_id").alias("cell"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"),
        kind.alias("kind"),
        F.when(e % 7 == 0, "partial").otherwise("exact").alias("precision"),
        F.when(e % 11 == 0, "unknown").otherwise("certain").alias("confidence"),
        F.when((F.col("event_type") == "view") | (e % 3 == 0), "weak").otherwise("strong").alias("strength"),
    )


EFFECTS_SQL = """effects AS (
  SELECT event_id AS id, user_id AS cell, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    CASE event_type WHEN 'signup' THEN 'store' WHEN 'view' THEN 'store-clean' WHEN 'error' THEN 'kill' WHEN 'purchase' THEN 'load' ELSE 'noop' END AS kind,
    CASE WHEN event_id % 7 = 0 THEN 'partial' ELSE 'exact' END AS precision,
    CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE 'certain' END AS confidence,
    CASE WHEN event_type = 'view' OR event_id % 3 = 0 THEN 'weak' ELSE 'strong' END AS strength
  FROM events)"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> order -> part -> supplier -> nation, with typed ids."""
    tag = lambda t, c: F.concat(F.lit(f"{t}:"), F.col(c).cast("string"))
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    s = read(spark, sf_dir, "supplier")
    parts = [
        o.select(tag("c", "o_custkey").alias("src"), tag("o", "o_orderkey").alias("dst")),
        li.select(tag("o", "l_orderkey").alias("src"), tag("p", "l_partkey").alias("dst")),
        li.select(tag("p", "l_partkey").alias("src"), tag("s", "l_suppkey").alias("dst")),
        s.select(tag("s", "s_suppkey").alias("src"), tag("n", "s_nationkey").alias("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


TRADE_SQL = """edges AS (
  SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst FROM orders
  UNION SELECT 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem
  UNION SELECT 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem
  UNION SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier)"""


def ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic call graph over all parts, in rings of 97: double and third, modulo 97."""
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") % 97).alias("n"), (F.floor(F.col("p_partkey") / 97) * 97).alias("base")).distinct()
    n, base = F.col("n"), F.col("base")
    ways = F.explode(F.array(base + (n * 2) % 97, base + F.floor(n / 3).cast("long"), F.when(n % 5 == 0, base + (n + 1) % 97).otherwise(base + n)))
    return p.select((base + n).alias("src"), ways.alias("dst")).where("src <> dst").distinct()


RING_SQL = """ring AS (
  SELECT DISTINCT src, dst FROM (
    SELECT base + n AS src, unnest([base + (n * 2) % 97, base + n // 3, CASE WHEN n % 5 = 0 THEN base + (n + 1) % 97 ELSE base + n END]) AS dst
    FROM (SELECT DISTINCT p_partkey % 97 AS n, p_partkey // 97 * 97 AS base FROM part)) WHERE src <> dst)"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): nations under regions, customers and suppliers under nations."""
    n, c, s = (read(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    tag = lambda t, col: F.concat(F.lit(f"{t}:"), F.col(col).cast("string"))
    return (
        n.select(tag("n", "n_nationkey").alias("child"), tag("r", "n_regionkey").alias("parent"))
        .union(c.select(tag("c", "c_custkey"), tag("n", "c_nationkey")))
        .union(s.select(tag("s", "s_suppkey"), tag("n", "s_nationkey")))
    )


HIERARCHY_SQL = """hierarchy AS (
  SELECT 'n:' || n_nationkey AS child, 'r:' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier)"""


def trace(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Trace facts (events) and edges (from an event to the user's next one; errors block)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = read(spark, sf_dir, "events").withColumns({"nxt": F.lead("event_id").over(w), "nxt_type": F.lead("event_type").over(w)})
    facts = ev.select(F.concat(F.lit("f:"), F.col("event_id")).alias("id"), F.col("event_type").alias("label"), F.concat(F.lit("user"), F.col("user_id")).alias("method"), F.col("props").alias("value"))
    status = F.when(F.col("nxt_type") == "error", "blocked").when(F.col("nxt_type") == "click", "skipped").otherwise("emitted")
    edges = ev.where("nxt is not null").select(
        F.concat(F.lit("e:"), F.col("event_id")).alias("id"), F.concat(F.lit("f:"), F.col("event_id")).alias("from_fact"), F.concat(F.lit("f:"), F.col("nxt")).alias("to_fact"), F.col("nxt_type").alias("stage"), status.alias("status")
    )
    return facts, edges


TRACE_SQL = """ev AS (
  SELECT *, lead(event_id) OVER w AS nxt, lead(event_type) OVER w AS nxt_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), facts AS (
  SELECT 'f:' || event_id AS id, event_type AS label, 'user' || user_id AS method, props AS value FROM ev
), trace_edges AS (
  SELECT 'e:' || event_id AS id, 'f:' || event_id AS from_fact, 'f:' || nxt AS to_fact, nxt_type AS stage,
    CASE nxt_type WHEN 'error' THEN 'blocked' WHEN 'click' THEN 'skipped' ELSE 'emitted' END AS status
  FROM ev WHERE nxt IS NOT NULL)"""
