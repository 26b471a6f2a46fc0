"""Classifiers over reasons and texts: the first rule that fits decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: (any of these words, stage, producer), in order; "a & b" asks for both
STAGE_RULES = (
    (("postsolve",), "postsolve", "postsolve"),
    (("report",), "reporting", "reporting"),
    (("sink candidate", "sink_candidate"), "sink_candidate", "sink"),
    (("sink",), "sink", "sink"),
    (("materialization", "pathmaterial", "path-gap"), "provenance", "provenance"),
    (("currentness", "oclfs"), "OCLFS", "OCLFS"),
    (("asset lowering", "asset_lowering"), "asset_lowering", "asset"),
    (("entry recovery", "entry_recovery", "arkmain"), "entry_recovery", "entry"),
    (("coverage ledger", "coverage_ledger"), "coverage_ledger", "coverage_ledger"),
    (("llm output", "llm_output", "llm batch", "llm_batch"), "semanticflow_llm", "semanticflow"),
    (("lowering",), "module_lowering", "module"),
    (("module",), "module", "module"),
    (("ude", "handoff", "synthetic", "capture"), "UDE", "UDE"),
    (("semanticflow", "llm"), "semanticflow", "semanticflow"),
    (("promotion",), "asset_promotion", "asset"),
    (("asset validation", "schema"), "asset_validation", "asset"),
    (("source & seed",), "source_seed", "rule"),
    (("rule", "transfer"), "rule", "rule"),
)

# fixed values: (pattern, family, kind), in order
GAP_RULES = (
    (r"\bjson\b|stringify|serialized|serialize|deserialize", "JSON", "json_value_carrier_gap"),
    (r"callback|call-back|hof|mapper|closure|lambda|then|catch|promise|continuation", "callback", "callback_propagation_gap"),
    (r"resultset|data[-_ ]?share|query|rows|rowset|cursor|recordset|scalar|getstring|getlong|result[-_ ]?container", "result", "result_container_gap"),
    (r"await|return[-_ ]?field|return|factory|wrapper|copy[-_ ]?like|result", "result", "ordinary_result_gap"),
    (r"receiver|thisfield|this[-_ ]?field|write[-_ ]?back|property[-_ ]?write|instance[-_ ]?field", "receiver", "receiver_provenance_gap"),
    (r"arraybuffer|uint8|int8|byte|bytes|buffer|typedarray|blob|binary", "buffer", "buffer_value_carrier_gap"),
    (r"parser|parse|split|regex|regexp|match|exec|m3u8|html|text[-_ ]?parser", "parser", "parser_value_carrier_gap"),
    (r"array|collection|map|set|weakmap|weakset|slot|index|element|fromentries|from[-_ ]?entries|container", "container", "container_item_gap"),
    (r"field|accesspath|access[-_ ]?path|objectliteral|object[-_ ]?literal|property|dto|constructor|store|load|nested", "field", "field_access_path_gap"),
)


def stage_of(text: Column) -> Column:
    """struct(stage, producer)."""
    low, out = F.lower(text), None
    row = lambda s, p: F.struct(F.lit(s).alias("stage"), F.lit(p).alias("producer"))
    for words, stage, producer in STAGE_RULES:
        fits = F.lit(False)
        for w in words:
            both = F.lit(True)
            for part in w.split(" & "):
                both = both & low.contains(part)
            fits = fits | both
        out = F.when(fits, row(stage, producer)) if out is None else out.when(fits, row(stage, producer))
    return out.otherwise(row("ordinary", "ordinary"))


def gap_of(text: Column) -> Column:
    """struct(family, kind)."""
    low, out = F.lower(text), None
    row = lambda f, k: F.struct(F.lit(f).alias("family"), F.lit(k).alias("kind"))
    for pattern, family, kind in GAP_RULES:
        out = F.when(low.rlike(pattern), row(family, kind)) if out is None else out.when(low.rlike(pattern), row(family, kind))
    return out.otherwise(row("ordinary", "ordinary_propagation_gap"))


def gate_status(blocked: Column, skipped: Column, emitted: Column, matched: Column, attempted: Column) -> Column:
    return F.when(F.coalesce(blocked, F.lit("")) != "", "blocked").when(F.coalesce(skipped, F.lit("")) != "", "skipped").when(emitted, "emitted").when(matched, "covered").when(attempted, "gap").otherwise("observed")


def fragment_variants(text: Column) -> Column:
    """A fragment and the spellings its [static] marks may have; no empty ones."""
    swap = lambda a, b: F.replace(text, F.lit(a), F.lit(b))
    return F.array_distinct(F.filter(F.array(text, swap(".[static]", "."), swap("[static]", ""), swap(".[static]", "._static_"), swap("[static]", "_static_")), lambda s: s != ""))


# fixed values: these keep their name with dashes
MISSING_REASONS = ("missing_derivation", "missing_source_provenance", "missing_currentness", "missing_ude_edge", "missing_model_hit", "ambiguous_predecessor", "unresolved_value_version")


def gap_kind(reason: Column) -> Column:
    return F.when(reason.isin(*MISSING_REASONS), F.replace(reason, F.lit("_"), F.lit("-"))).otherwise("truncated-materialization")
