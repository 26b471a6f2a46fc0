"""Semi-naive fixpoints: a driver loop over DataFrames.

Each round joins only the rows that the last round found; lineage is cut in the
folder that ``spark.checkpoint.dir`` names (set here only where it is unset), so
a lost executor costs one round at most."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """The folder of ``spark.checkpoint.dir``; one of its own only where none is named and all runs on this machine."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="factloom-checkpoint-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: like ``cut``, but what reads it knows its true
    size, and carries none of the constraints of the plan that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, int], DataFrame], key: list[str], max_rounds: int | None = None) -> tuple[DataFrame, bool]:
    """All rows reachable from ``seed`` by ``step(delta, round)``, distinct by ``key``.

    Returns the rows, with the ``round`` that first found them (0: seed), and
    whether the round budget ran out before the end (None: no budget)."""
    names = seed.columns
    delta = cut(seed.dropDuplicates(key).withColumn("round", F.lit(0)))
    total, n = delta, 0
    while True:
        if delta.isEmpty():
            return total, False
        if max_rounds is not None and n >= max_rounds:
            return total, True
        n += 1
        found = step(delta.select(*names), n).select(*names).dropDuplicates(key)
        # merged: rows of a checkpoint are taken for far fewer than they are, and each round would send them to the driver
        delta = cut(found.join(total.select(*key).hint("merge"), key, "left_anti").select(*names).withColumn("round", F.lit(n)))
        total = total.union(delta)
        if n % 8 == 0:  # else the union's parts, and with them tasks, grow with the rounds
            total = cut(total.repartition(*key))


class Grown:
    """Distinct rows that the rounds of a loop add to.

    ``add`` keeps what is new by ``key``: ``new`` holds it, ``fresh`` tells whether there is
    any, ``all`` holds everything.  What was there is not written again, but for every eighth
    time, when the parts are gathered so that they do not grow in number."""

    def __init__(self, rows: DataFrame | None, key: list[str]):
        self.key, self.all, self.new, self.fresh, self._parts = key, None, None, False, 0
        if rows is not None:
            self.add(rows)

    def add(self, rows: DataFrame) -> DataFrame:
        if self.all is None:
            found = rows.dropDuplicates(self.key)
        elif set(rows.columns) == set(self.key):  # one aggregation tells both what is double and what was there
            both = rows.select(*self.key, F.lit(False).alias("__held")).unionByName(self.all.select(*self.key, F.lit(True).alias("__held")))
            found = both.groupBy(*self.key).agg(F.max("__held").alias("__held")).where("not __held").select(*rows.columns)
        else:
            found = rows.dropDuplicates(self.key).join(self.all.select(*self.key), self.key, "left_anti").select(*rows.columns)
        self.new = written(found)
        self.fresh = not self.new.isEmpty()
        if self.all is None:
            self.all = self.new
        elif self.fresh:
            self.all, self._parts = self.all.unionByName(self.new), self._parts + 1
            if self._parts % 8 == 0:
                self.all = written(self.all)
        return self.new


def rounds(most: int | None):
    """Numbers of rounds for a loop that ends itself; raises where ``most`` are not enough."""
    n = 0
    while most is None or n < most:
        yield n
        n += 1
    raise RuntimeError(f"not settled in {most} rounds")


def whole(found: tuple[DataFrame, bool]) -> DataFrame:
    """The rows of a fixpoint that must not be cut short."""
    if found[1]:
        raise RuntimeError("the round budget ran out before the fixpoint")
    return found[0]


def closure(edges: DataFrame, seed: DataFrame, node: str = "node", src: str = "src", dst: str = "dst", max_rounds: int | None = None) -> tuple[DataFrame, bool]:
    """Nodes reachable from ``seed`` (column ``node``) over ``edges``, with their hop distance
    as ``round``, and whether a budget of rounds ran out before the end.

    The edges are written once, dealt out by their source, so that a round reads them
    as they lie and works none of them out again."""
    ways = cut(edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d")).repartition("__s")).hint("merge")
    return fixpoint(seed.select(node), lambda d, _: d.join(ways, F.col(node) == F.col("__s")).select(F.col("__d").alias(node)), [node], max_rounds)
