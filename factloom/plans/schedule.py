"""Entry schedule: rounds of activation over phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import cut

# fixed values
PHASES = ("bootstrap", "composition", "interaction", "reactive_handoff", "teardown")
RULES = (
    # family, phase of the target, phases of the source that may activate it (none: any), without a source
    ("composition_lifecycle", "composition", ("bootstrap",), False),
    ("interaction_lifecycle", "interaction", ("bootstrap", "composition"), False),
    ("teardown_lifecycle", "teardown", ("bootstrap", "composition", "interaction"), False),
    ("ui_callback", "interaction", ("composition",), False),
    ("channel_callback", "interaction", (), False),
    ("scheduler_callback", "interaction", ("bootstrap", "composition", "reactive_handoff"), False),
    ("state_watch", "reactive_handoff", ("bootstrap", "composition", "reactive_handoff"), False),
    ("navigation_channel", "reactive_handoff", ("composition",), True),
    ("ability_handoff", "reactive_handoff", ("bootstrap",), False),
)


def activation_schedule(roots: DataFrame, edges: DataFrame, max_rounds: int = 4) -> tuple[DataFrame, bool]:
    """(method, round, phase) of roots (method) and edges (family, src, dst).

    Roots start at round 0 in the first phase.  In each round every edge whose source
    was active before, in an allowed phase, activates its target; the first
    activation stays.  Two edges of one round: the earlier phase, then the name."""
    spark = roots.sparkSession
    rules = spark.createDataFrame([(f, p, list(a), n, PHASES.index(p)) for f, p, a, n in RULES], "family string, phase string, allowed array<string>, rootless boolean, rank int")
    ways = cut(edges.join(F.broadcast(rules), "family").distinct())  # nine rows
    active = cut(roots.select("method", F.lit(0).alias("round"), F.lit(PHASES[0]).alias("phase")).distinct())
    for n in range(1, max_rounds + 2):
        by = active.select(F.col("method").alias("src"), F.col("phase").alias("from_phase"))
        j = ways.join(by, "src", "left")
        fires = F.when(F.col("from_phase").isNull(), F.col("rootless")).otherwise((F.size("allowed") == 0) | F.array_contains("allowed", F.col("from_phase")))
        w = Window.partitionBy("dst").orderBy("rank", "family")
        new = j.where(fires).withColumn("__n", F.row_number().over(w)).where("__n = 1").select(F.col("dst").alias("method"), F.lit(n).alias("round"), "phase")
        new = cut(new.join(active, "method", "left_anti"))
        if new.isEmpty():
            return active, False
        if n > max_rounds:
            return active, True
        active = cut(active.union(new))
    return active, False


def ordered(schedule: DataFrame) -> DataFrame:
    """The schedule's place within each round: by phase, then name."""
    w = Window.partitionBy("round").orderBy("rank", "method")
    ranks = F.array_position(F.lit(list(PHASES)), F.col("phase"))
    return schedule.withColumn("rank", ranks).withColumn("place", F.row_number().over(w)).drop("rank")


def lifecycle_edges(methods: DataFrame) -> DataFrame:
    """Edges between neighbouring phases present in an owner (owner, method, phase)."""
    rank = F.array_position(F.lit(list(PHASES)), F.col("phase"))
    present = methods.select("owner", "phase", rank.alias("rank")).distinct()
    w = Window.partitionBy("owner").orderBy("rank")
    steps = present.withColumn("before", F.lag("phase").over(w)).where("before is not null").select("owner", "phase", "before")
    # one phase comes before each: pairs of distinct rows are distinct
    own = methods.select("owner", "method", "phase").distinct()
    a, b = own.select("owner", F.col("method").alias("dst"), "phase"), own.select("owner", F.col("method").alias("src"), F.col("phase").alias("before"))
    return a.join(steps, ["owner", "phase"]).join(b, ["owner", "before"]).select("owner", "src", "dst", "phase")
