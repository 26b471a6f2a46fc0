"""Queries over trace graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trace as ops
from ..sources.fixtures import TRACE_SQL, effects, read, trace
from .queries_effects import PAIRS_SQL
from .registry import query


@query(
    f"""WITH {TRACE_SQL}, f AS (SELECT count(*) AS facts, count(DISTINCT label) AS labels FROM facts), e AS (SELECT count(*) AS edges, count_if(status = 'emitted') AS emitted, count_if(status = 'blocked') AS blocked, count_if(status = 'skipped') AS skipped, array_to_string(list_sort(list(DISTINCT stage)), ',') AS stages FROM trace_edges)
SELECT * FROM f CROSS JOIN e"""
)
def trace_summary(spark, sf_dir):
    return ops.summary(*trace(spark, sf_dir))


@query(f"WITH {TRACE_SQL} SELECT id FROM facts WHERE contains(label, 'ur') AND contains(method, 'user1') AND contains(value, '7')")
def waypoint_match(spark, sf_dir):
    return trace(spark, sf_dir)[0].where(ops.waypoint(label="ur", method="user1", value="7")).select("id")


QUERIES_SQL = "asked AS (SELECT c_custkey AS query, CASE c_custkey % 6 WHEN 0 THEN 'view' WHEN 1 THEN 'signup' WHEN 2 THEN 'click' ELSE 'none' END AS source_label, 'user' || (c_custkey % 200) AS source_method, CASE WHEN c_custkey % 5 = 0 THEN 'nothing' ELSE 'purchase' END AS sink_label FROM customer)"


def _asked(spark, sf_dir):
    k = F.col("c_custkey")
    label = F.when(k % 6 == 0, "view").when(k % 6 == 1, "signup").when(k % 6 == 2, "click").otherwise("none")
    return read(spark, sf_dir, "customer").select(k.alias("query"), label.alias("source_label"), F.concat(F.lit("user"), k % 200).alias("source_method"), F.when(k % 5 == 0, "nothing").otherwise("purchase").alias("sink_label"))


VERDICT_SQL = f"""{TRACE_SQL}, {QUERIES_SQL}, hits AS (SELECT a.query, f.id, f.id IN (SELECT to_fact FROM trace_edges WHERE status = 'emitted') AS entered FROM asked a LEFT JOIN facts f ON f.label = a.source_label AND f.method = a.source_method),
per AS (SELECT query, count(id) AS n, count_if(id IS NOT NULL AND NOT entered) AS fresh, min(CASE WHEN NOT entered THEN id END) AS a, min(id) AS b FROM hits GROUP BY query),
one AS (SELECT query, CASE WHEN fresh > 0 THEN fresh ELSE n END AS n, coalesce(a, b) AS source FROM per),
sinks AS (SELECT a.query, min(f.id) AS sink FROM asked a JOIN facts f ON f.label = a.sink_label AND f.method = a.source_method GROUP BY a.query),
verdicts AS (SELECT o.query, CASE WHEN n = 0 THEN 'missing-source' WHEN n > 1 THEN 'source-ambiguous' WHEN sink IS NULL THEN 'missing-sink' ELSE 'reached' END AS verdict, CASE WHEN n = 1 THEN source END AS source, CASE WHEN n = 1 THEN sink END AS sink FROM one o LEFT JOIN sinks s ON s.query = o.query)"""


@query(f"WITH {VERDICT_SQL} SELECT * FROM verdicts")
def trace_query_verdicts(spark, sf_dir):
    return ops.queried(*trace(spark, sf_dir), _asked(spark, sf_dir))


@query(
    f"""WITH {TRACE_SQL}, {QUERIES_SQL}, hit AS (SELECT a.query, min(f.id) AS fact FROM asked a LEFT JOIN facts f ON f.label = a.source_label AND f.method = a.source_method GROUP BY a.query),
into_ AS (SELECT to_fact, min(id) AS edge, min_by(stage, id) AS stage FROM trace_edges WHERE status = 'emitted' GROUP BY to_fact)
SELECT query, CASE WHEN fact IS NULL THEN 'reached' ELSE 'illegal-propagation' END AS verdict, fact, edge, CASE WHEN fact IS NOT NULL THEN coalesce(stage, 'unknown') || '.gap' END AS cause FROM hit LEFT JOIN into_ ON to_fact = fact"""
)
def trace_forbidden(spark, sf_dir):
    return ops.forbidden(*trace(spark, sf_dir), _asked(spark, sf_dir).select("query", F.col("source_label").alias("label"), F.col("source_method").alias("method")))


@query(
    f"""WITH {TRACE_SQL}, {QUERIES_SQL}, n AS (SELECT a.query, count(f.id) AS n FROM asked a LEFT JOIN facts f ON f.label = a.source_label AND f.method = a.source_method GROUP BY a.query) SELECT query, CASE WHEN n > 1 THEN 'duplicate' WHEN n = 1 THEN 'reached' ELSE 'missing-sink' END AS verdict, n FROM n"""
)
def trace_duplicates(spark, sf_dir):
    return ops.duplicates(trace(spark, sf_dir)[0], _asked(spark, sf_dir).select("query", F.col("source_label").alias("label"), F.col("source_method").alias("method")))


@query(
    f"""WITH {VERDICT_SQL}, c AS (SELECT c_custkey AS query, 'rule' AS stage FROM customer WHERE c_custkey % 7 = 0), g AS (SELECT c_custkey AS query, CASE WHEN c_custkey % 2 = 0 THEN 'sink' ELSE 'other' END AS stage FROM customer WHERE c_custkey % 3 = 0)
SELECT v.query, CASE WHEN c.stage IS NOT NULL THEN 'coverage' WHEN g.stage IS NOT NULL THEN 'gate' ELSE 'unknown' END AS origin, coalesce(c.stage, g.stage) AS stage,
  CASE coalesce(c.stage, g.stage) WHEN 'rule' THEN '{ops.REPAIR_HINTS["rule"]}' WHEN 'sink' THEN '{ops.REPAIR_HINTS["sink"]}' ELSE '{ops.DEFAULT_HINT}' END AS hint
FROM verdicts v LEFT JOIN c ON c.query = v.query LEFT JOIN g ON g.query = v.query WHERE v.verdict LIKE 'missing%'"""
)
def trace_explain(spark, sf_dir):
    k = F.col("c_custkey")
    cu = read(spark, sf_dir, "customer")
    coverage = cu.where(k % 7 == 0).select(k.alias("query"), F.lit("rule").alias("stage"))
    gates = cu.where(k % 3 == 0).select(k.alias("query"), F.when(k % 2 == 0, "sink").otherwise("other").alias("stage"))
    return ops.explained(trace_query_verdicts(spark, sf_dir), coverage, gates)


@query(
    f"""WITH {TRACE_SQL}, ends AS (SELECT id, from_fact AS fact FROM trace_edges UNION SELECT id, to_fact FROM trace_edges), r AS (SELECT fact, id AS edge, row_number() OVER (PARTITION BY fact ORDER BY id) AS place FROM ends WHERE fact IN (SELECT id FROM facts WHERE label = 'signup'))
SELECT * FROM r WHERE place <= 40"""
)
def trace_nearby(spark, sf_dir):
    facts, edges = trace(spark, sf_dir)
    return ops.nearby(facts, edges, facts.where("label = 'signup'"))


@query(f"WITH {TRACE_SQL} SELECT to_fact AS fact, string_agg(stage || ':' || status || ':' || id, ' > ' ORDER BY stage || ':' || status || ':' || id) AS chain FROM trace_edges GROUP BY to_fact")
def trace_evidence_chain(spark, sf_dir):
    return ops.evidence_chain(trace(spark, sf_dir)[1])


DIFF_SQL = f"{TRACE_SQL}, b AS (SELECT id, status FROM trace_edges WHERE stage <> 'view'), a AS (SELECT id, CASE WHEN stage = 'error' THEN 'failed' ELSE status END AS status FROM trace_edges WHERE stage <> 'signup')"


@query(f"WITH {DIFF_SQL} SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.id = b.id WHERE b.id IS NULL OR a.id IS NULL OR a.status <> b.status")
def trace_diff(spark, sf_dir):
    e = trace(spark, sf_dir)[1]
    after = e.where("stage <> 'signup'").withColumn("status", F.when(F.col("stage") == "error", "failed").otherwise(F.col("status")))
    return ops.difference(e.where("stage <> 'view'"), after, "id", "status")


@query(f"WITH {DIFF_SQL} SELECT (SELECT count(*) FROM (SELECT id FROM b EXCEPT ALL SELECT id FROM a)) AS closed, (SELECT count(*) FROM (SELECT id FROM a EXCEPT ALL SELECT id FROM b)) AS opened")
def trace_gap_counts(spark, sf_dir):
    e = trace(spark, sf_dir)[1]
    return ops.gap_counts(e.where("stage <> 'view'"), e.where("stage <> 'signup'"), "id")


@query(
    f"""WITH {VERDICT_SQL}, later AS (SELECT query, CASE WHEN query % 4 = 0 THEN 'reached' WHEN query % 9 = 0 THEN 'missing-sink' ELSE verdict END AS verdict FROM verdicts)
SELECT b.query, CASE WHEN a.verdict = 'reached' AND b.verdict <> 'reached' THEN 'closed' WHEN b.verdict = 'reached' AND a.verdict <> 'reached' THEN 'regressed' WHEN a.verdict = b.verdict THEN 'unchanged' ELSE 'moved' END AS change FROM verdicts b JOIN later a ON a.query = b.query"""
)
def trace_verdict_changes(spark, sf_dir):
    v = trace_query_verdicts(spark, sf_dir).select("query", "verdict")
    q = F.col("query")
    return ops.verdict_changes(v, v.withColumn("verdict", F.when(q % 4 == 0, "reached").when(q % 9 == 0, "missing-sink").otherwise(F.col("verdict"))))


@query(PAIRS_SQL + "SELECT cell, producer, consumer, verdict FROM verdicts")
def streaming_currentness(spark, sf_dir):
    """The verdicts of the streaming form, fed with all effects at once; equal to the batch's."""
    from ..streaming.currentness import as_batches

    return as_batches(effects(spark, sf_dir), batches=3)


@query(PAIRS_SQL + "SELECT cell, producer, consumer, verdict FROM verdicts")
def streaming_producers(spark, sf_dir):
    """The verdicts of a stream whose state is a list of producers for each cell."""
    from ..streaming import producers

    return producers.in_lots(effects(spark, sf_dir), "seq", 3, producers.verdicts, producers.OUT)


@query("SELECT s.user_id AS cell, s.event_id AS producer, l.event_id AS consumer FROM events s JOIN events l ON s.user_id = l.user_id AND l.ts > s.ts AND l.ts <= s.ts + INTERVAL 6 HOURS WHERE s.event_type = 'signup' AND l.event_type = 'purchase'")
def streaming_slices(spark, sf_dir):
    """Stores and loads of a cell within six hours, as a join of two streams."""
    from ..sources.fixtures import read
    from ..streaming import producers

    kind = F.when(F.col("event_type") == "signup", "store").when(F.col("event_type") == "purchase", "load").otherwise("noop")
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("cell"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return producers.in_lots(rows, "ts", 3, lambda stream: producers.slices(stream, "6 hours"), "cell long, producer long, consumer long")


@query("SELECT user_id AS cell, max(event_id) AS id, max_by(event_type, event_id) AS kind FROM events GROUP BY user_id")
def streaming_cache(spark, sf_dir):
    """The last event of each cell, from a cache whose touched partitions each batch overwrites."""
    from ..sources.fixtures import read
    from ..streaming import producers

    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    put = lambda batch, n, path: producers.newest(batch, path, "cell", ["id"])
    return producers.in_lots(rows, "id", 3, lambda stream: stream, "cell long, id long, kind string", put)
