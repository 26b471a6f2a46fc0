"""Registry of the queries over the driver's tables and their SQL."""

from __future__ import annotations

from . import queries_build, queries_calls, queries_effects, queries_evidence, queries_flow, queries_graph, queries_identity, queries_ledgers, queries_links, queries_modelling, queries_modules, queries_pointers, queries_program, queries_scalars, queries_trace
from .registry import QUERIES, SQL

#: Sums and conditional counts that DuckDB gives as HUGEINT; their SQL casts them to BIGINT.
COUNTS = {
    "effect_slices": ["held"],
    "handoff_pairs": ["gap"],
    "handoff_kills_between": ["killed"],
    "cell_epochs": ["epoch"],
    "currentness_evidence": ["negative", "positive"],
    "execution_unit_summary": ["payload", "captures"],
    "coverage_summary": ["exact_covered", "partial_covered", "role_missing", "not_covered", "conflicts", "identity_unresolved", "ignored_by_policy", "need_more_evidence", "sent"],
    "layered_rule_status": ["used"],
    "trace_summary": ["emitted", "blocked", "skipped"],
}
for _name, _columns in COUNTS.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _columns)}) FROM ({SQL[_name]})"

__all__ = ["QUERIES", "SQL", "queries_build", "queries_calls", "queries_effects", "queries_evidence", "queries_flow", "queries_graph", "queries_identity", "queries_ledgers", "queries_links", "queries_modelling", "queries_modules", "queries_pointers", "queries_program", "queries_scalars", "queries_trace"]
