"""The engine: stages over fact tables, with plugins that see and change each one.

A plugin is any object with some of the hooks ``on_start(engine)``,
``on_entry(methods)``, ``on_propagation(facts, edges)`` (returns more edges, or
None), ``on_detection(flows)``, ``on_result(flows)`` and ``on_finish(engine)``; each
takes and returns DataFrames.  A hook that fails marks its plugin as failed, the
run goes on without it, and ``audit`` tells."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import taint
from .fixpoint import closure, whole, written


@dataclass
class Engine:
    spark: SparkSession
    calls: DataFrame  # (caller, callee)
    edges: DataFrame  # (kind, src, dst, field, site)
    k: int = 1
    max_rounds: int | None = None
    plugins: list[Any] = field(default_factory=list)
    dry_run: bool = False
    audit: list[tuple[str, str, str]] = field(default_factory=list)
    propagate: Any = taint.propagate  # may be replaced
    detect: Any = taint.sinks

    def __post_init__(self) -> None:
        self.failed: set[int] = set()
        self._hook("on_start", self)

    def _hook(self, name: str, *args):
        """What plugins return, in their order; in a dry run their results are only noted."""
        out = []
        for i, p in enumerate(self.plugins):
            f = getattr(p, name, None)
            if f is None or i in self.failed:
                continue
            try:
                got = f(*args)
                self.audit.append((type(p).__name__, name, "ok"))
                if got is not None and not self.dry_run:
                    out.append(got)
            except Exception as e:  # a plugin's fault must not end the run
                self.failed.add(i)
                self.audit.append((type(p).__name__, name, f"failed: {e}"))
        return out

    def reachable(self, roots: DataFrame) -> DataFrame:
        """Methods (node) reached from ``roots`` (node) by calls."""
        found = whole(closure(self.calls, roots, src="caller", dst="callee", max_rounds=self.max_rounds)).select("node")
        for more in self._hook("on_entry", found):
            found = more
        return found

    def run(self, rules: DataFrame, sites: DataFrame, sink_rules: DataFrame, sink_sites: DataFrame, sanitized: DataFrame | None = None) -> dict[str, Any]:
        """seeds, facts, flows, and whether the round budget ran out."""
        seeds = taint.seeds(rules, sites)
        edges = self.edges
        for more in self._hook("on_propagation", seeds, edges):
            edges = edges.unionByName(more)
        facts, short = self.propagate(seeds, edges, self.k, self.max_rounds)
        flows = self.detect(facts, sink_rules, sink_sites, sanitized)
        for name in ("on_detection", "on_result"):
            for changed in self._hook(name, flows):
                flows = changed
        self._hook("on_finish", self)
        return {"seeds": seeds, "facts": facts, "flows": flows, "truncated": short}


@dataclass
class ModellingSession:
    """Rounds of a decider over open slices, on the executors.

    ``decide`` takes a pandas Series of texts and returns one of decisions; it runs in Arrow
    batches over the different texts of a round that have no answer yet, so a text is asked
    about once whatever the number of slices that share it.  Where a batch fails, its texts
    are asked one by one, and those that fail are asked again in the next round.  ``more``
    lets ``expand`` (Column to Column) lengthen the text for the next round.  After
    ``most_failures`` rounds in a row that brought nothing but failures the session stops.
    Answers are kept by the digest of their text, in a table that cuts the lineage: a lost
    executor asks only its part of one round again."""

    decide: Any
    expand: Any = None
    max_rounds: int = 3
    most_failures: int = 3

    def run(self, slices: DataFrame) -> DataFrame:
        """(slice, decision, rounds) of slices (slice, text): the last answer, ``failed`` or
        ``more`` where the rounds ended with that, and in how many rounds it was asked about."""
        decide = self.decide

        def ask(frames):
            for f in frames:
                try:
                    told = list(decide(f["text"]))
                except Exception:
                    told = []
                    for i in range(len(f)):
                        try:
                            told.append(decide(f["text"].iloc[i : i + 1]).iloc[0])
                        except Exception:
                            told.append("failed")
                yield f[["digest"]].assign(answer=told)

        digest = F.sha2(F.coalesce("text", F.lit("")), 256)
        open_ = written(slices.select("slice", "text", F.lit(0).alias("rounds")))
        known, done, lost = None, [], 0
        for n in range(1, self.max_rounds + 1):
            open_ = open_.withColumn("digest", digest)
            new = open_.select("digest", "text").dropDuplicates(["digest"])
            if known is not None:
                new = new.join(known.select("digest"), "digest", "left_anti")
            told = written(new.mapInPandas(ask, "digest string, answer string"))
            good = told.where("answer <> 'failed'")
            counted = told.agg(F.count("*").alias("all"), F.count_if(F.col("answer") == "failed").alias("failed")).first()
            lost = lost + 1 if counted["all"] and counted["all"] == counted["failed"] else 0
            known = good if known is None else written(known.unionByName(good))
            met = written(open_.join(known, "digest", "left").select("slice", "text", F.lit(n).alias("rounds"), F.coalesce("answer", F.lit("failed")).alias("decision")))
            ends = F.col("decision").isin("failed", "more") if n < self.max_rounds and lost < self.most_failures else F.lit(False)
            if self.expand is None:
                ends = ends & (F.col("decision") == "failed")
            done.append(met.where(~ends).select("slice", "decision", "rounds"))
            open_ = met.where(ends)
            if open_.isEmpty():
                break
            longer = self.expand(F.col("text")) if self.expand else F.col("text")
            open_ = open_.select("slice", F.when(F.col("decision") == "more", longer).otherwise(F.col("text")).alias("text"), "rounds")
        out = done[0]
        for d in done[1:]:
            out = out.union(d)
        return out
