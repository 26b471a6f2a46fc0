"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, paths, text
from ..sources.fixtures import read
from .registry import query

# a path of parts from each order: segments repeat so that windows fold
PATH_SQL = """paths AS (
  SELECT o_orderkey AS id, list_transform(range(0, CAST(o_orderkey % 17 AS BIGINT)), lambda i: CASE (o_orderkey + i * (o_orderkey % 3)) % 5 WHEN 0 THEN 'arr:0' WHEN 1 THEN ' name ' WHEN 2 THEN '' WHEN 3 THEN 'map:k' ELSE 'f' || (i % 2) END) AS path,
    CASE o_orderkey % 4 WHEN 0 THEN 'partial' WHEN 1 THEN 'unknown' ELSE 'exact' END AS precision
  FROM orders), kept AS (SELECT *, list_filter(list_transform(path, lambda s: trim(s)), lambda s: s <> '') AS raw FROM paths)"""


def _paths(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")

    def segment(i):
        c = (k + i * (k % 3)) % 5
        return F.when(c == 0, "arr:0").when(c == 1, " name ").when(c == 2, "").when(c == 3, "map:k").otherwise(F.concat(F.lit("f"), i % 2))

    seq = F.when(k % 17 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("bigint"), k % 17 - 1))
    return o.select(k.alias("id"), F.transform(seq, segment).alias("path"), F.when(k % 4 == 0, "partial").when(k % 4 == 1, "unknown").otherwise("exact").alias("precision"))


@query(f"WITH {PATH_SQL} SELECT id, CASE WHEN len(raw) > 0 THEN array_to_string(raw, '.') END AS path_key, len(raw) AS n FROM kept")
def field_path_segments(spark, sf_dir):
    raw = paths.raw_segments(F.col("path"))
    return _paths(spark, sf_dir).select("id", F.array_join(raw, ".").alias("path_key"), F.coalesce(F.size(raw), F.lit(0)).cast("long").alias("n")).withColumn("n", F.greatest("n", F.lit(0)))


# only a repeated single container segment folds in these paths of one segment kind
FOLD_SQL = """SELECT o_orderkey AS id, least(CAST(o_orderkey % 9 AS BIGINT), CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 12 END) AS n,
  array_to_string(list_transform(range(0, least(CAST(o_orderkey % 9 AS BIGINT), CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 12 END)), lambda i: CASE WHEN o_orderkey % 2 = 0 THEN 'arr:*' ELSE 'name' END), '.') AS path_key FROM orders"""


@query(FOLD_SQL)
def field_path_normalize(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    path = F.array_repeat(F.when(k % 2 == 0, "arr:*").otherwise("name"), (k % 9).cast("int"))
    out = paths.normalize(path)
    return o.select(k.alias("id"), F.coalesce(F.greatest(F.size(out), F.lit(0)), F.lit(0)).cast("long").alias("n"), paths.key(out).alias("path_key"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 15 = 0 THEN 'missing-path' WHEN o_orderkey % 15 > 12 THEN 'truncated-path' WHEN o_orderkey % 4 = 0 THEN 'partial-path' WHEN o_orderkey % 4 = 1 THEN 'unknown-path' ELSE 'exact-path' END AS reason,
  CASE WHEN o_orderkey % 15 = 0 THEN 'none' WHEN o_orderkey % 15 > 12 OR o_orderkey % 4 < 2 THEN 'weak' ELSE 'strong' END AS update_strength,
  o_orderkey % 15 BETWEEN 1 AND 12 AND o_orderkey % 4 >= 2 AS isolated FROM orders"""
)
def field_precision_policy(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    path = F.transform(F.when(k % 15 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), k % 15)), lambda i: F.concat(F.lit("f"), i))
    precision = F.when(k % 4 == 0, "partial").when(k % 4 == 1, "unknown").otherwise("exact")
    d = paths.decide(path, precision)
    return o.select(k.alias("id"), d["reason"].alias("reason"), d["update_strength"].alias("update_strength"), paths.sibling_isolation(path, precision).alias("isolated"))


@query(
    """SELECT a.p || '+' || b.p AS pair, CASE WHEN 'unknown' IN (a.p, b.p) THEN 'unknown' WHEN 'partial' IN (a.p, b.p) THEN 'partial' ELSE 'exact' END AS worse
FROM (VALUES ('exact'), ('partial'), ('unknown')) a(p) CROSS JOIN (VALUES ('exact'), ('partial'), ('unknown')) b(p)"""
)
def precision_degrade(spark, sf_dir):
    p = spark.createDataFrame([(x, y) for x in paths.PRECISIONS for y in paths.PRECISIONS], "a string, b string")
    return p.select(F.concat("a", F.lit("+"), "b").alias("pair"), paths.degrade(F.col("a"), F.col("b")).alias("worse"))


@query(
    """SELECT p_partkey AS id, 'f.' || split_part(p_type, ' ', 1) || '.x' AS path_key, len(string_split(p_type, ' ')) > 1 AND split_part(p_type, ' ', 1) = 'STANDARD' AS is_prefix,
  '$c$:' || p_brand AS slot_key, p_brand AS slot FROM part"""
)
def field_path_codec(spark, sf_dir):
    words = F.split("p_type", " ")
    k = paths.container_key(F.col("p_brand"))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        paths.key(paths.prepend(F.array(F.lit("f")), paths.append(F.slice(words, 1, 1), F.array(F.lit(" x "))))).alias("path_key"),
        paths.starts_with(words, F.array(F.lit("STANDARD"))).alias("is_prefix"),
        k.alias("slot_key"),
        paths.container_slot(k).alias("slot"),
    )


@query(
    """SELECT p_partkey AS id, p_partkey || '@' || p_size || '.' || p_brand AS location_id, p_partkey || '@' || p_size || '.' || p_brand || '#src=' || replace(p_name, ' ', '%20') AS fact_id,
  'object-field:' || p_partkey || '@' || p_size || '.' || p_brand AS field_key, 'src -> ' || p_brand || ' -> ' || p_size AS flow_key FROM part"""
)
def fact_keys(spark, sf_dir):
    n, s, b = F.col("p_partkey"), F.col("p_size"), F.col("p_brand")
    return read(spark, sf_dir, "part").select(n.alias("id"), keys.location_id(n, s, b).alias("location_id"), keys.fact_id(n, s, b, F.col("p_name")).alias("fact_id"), keys.field_location_key(F.lit("object-field"), n, s, b).alias("field_key"), keys.flow_key(F.lit("src"), b, s).alias("flow_key"))


@query(
    """SELECT s_suppkey AS id, 'map-entry||o' || s_nationkey || '|k' || (s_suppkey % 7) || '|a.b|' || CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE '' END || '|||exact' AS cell_key,
  'map-entry|fam||k' || (s_suppkey % 7) || '|o' || s_nationkey || '|||exact' AS handle_key, CASE WHEN s_suppkey % 2 = 0 THEN 'a/b' ELSE 'x/y/z' END AS path FROM supplier"""
)
def cell_keys(spark, sf_dir):
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    owner, key = F.concat(F.lit("o"), F.col("s_nationkey")), F.concat(F.lit("k"), k % 7)
    index = F.when(k % 2 == 0, k)
    cell = F.struct(F.lit("map-entry").alias("kind"), none.alias("scope"), owner.alias("owner"), key.alias("key"), F.lit(["a", "b"]).alias("field_path"), index.alias("index"), none.alias("alloc_site"), none.alias("value_version"), F.lit("exact").alias("precision"))
    handle = F.struct(F.lit("map-entry").alias("cell_kind"), F.lit("fam").alias("family"), none.alias("scope"), key.alias("key"), owner.alias("owner"), none.alias("index"), none.alias("alloc_site"), F.lit("exact").alias("precision"))
    path = keys.path_from_handle_key(F.when(k % 2 == 0, '["a","b"]').otherwise("x.y.z"))
    return read(spark, sf_dir, "supplier").select(k.alias("id"), keys.state_cell_key(cell).alias("cell_key"), keys.handle_key(handle).alias("handle_key"), F.array_join(path, "/").alias("path"))


# a reason text from each event, with words of many rules
REASON_SQL = """reasons AS (SELECT event_id AS id, CASE event_id % 13 WHEN 0 THEN 'Postsolve pass' WHEN 1 THEN 'sink_candidate found' WHEN 2 THEN 'a SINK hit' WHEN 3 THEN 'path-gap here' WHEN 4 THEN 'OCLFS kill' WHEN 5 THEN 'asset lowering' WHEN 6 THEN 'lowering of module'
  WHEN 7 THEN 'Handoff put' WHEN 8 THEN 'LLM batch' WHEN 9 THEN 'promotion gate' WHEN 10 THEN 'source seeded' WHEN 11 THEN 'transfer rule' ELSE 'plain step' END || ' ' || event_type AS reason FROM events)"""


def _reasons(spark, sf_dir):
    words = ["Postsolve pass", "sink_candidate found", "a SINK hit", "path-gap here", "OCLFS kill", "asset lowering", "lowering of module", "Handoff put", "LLM batch", "promotion gate", "source seeded", "transfer rule", "plain step"]
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.element_at(F.lit(words), (F.col("event_id") % 13 + 1).cast("int")), F.lit(" "), F.col("event_type")).alias("reason"))


# what each text must give, written out
@query(
    f"""WITH {REASON_SQL} SELECT id, ['postsolve', 'sink_candidate', 'sink', 'provenance', 'OCLFS', 'asset_lowering', 'module_lowering', 'UDE', 'semanticflow_llm', 'asset_promotion', 'source_seed', 'rule', 'ordinary'][id % 13 + 1] AS stage,
  ['postsolve', 'sink', 'sink', 'provenance', 'OCLFS', 'asset', 'module', 'UDE', 'semanticflow', 'asset', 'rule', 'rule', 'ordinary'][id % 13 + 1] AS producer FROM reasons"""
)
def classify_stage(spark, sf_dir):
    s = text.stage_of(F.col("reason"))
    return _reasons(spark, sf_dir).select("id", s["stage"].alias("stage"), s["producer"].alias("producer"))


@query(
    """SELECT p_partkey AS id, ['JSON', 'callback', 'result', 'result', 'receiver', 'buffer', 'parser', 'container', 'field', 'ordinary', 'ordinary'][p_partkey % 11 + 1] AS family,
  ['json_value_carrier_gap', 'callback_propagation_gap', 'result_container_gap', 'ordinary_result_gap', 'receiver_provenance_gap', 'buffer_value_carrier_gap', 'parser_value_carrier_gap', 'container_item_gap', 'field_access_path_gap', 'ordinary_propagation_gap', 'ordinary_propagation_gap'][p_partkey % 11 + 1] AS kind FROM part"""
)
def classify_gap(spark, sf_dir):
    words = ["JSON value", "a callback", "query rows", "await it", "receiver x", "Uint8Array", "regex use", "Array item", "nested dto"]
    k = F.col("p_partkey") % 11
    b = F.when(k < 9, F.element_at(F.lit(words), F.least(k + 1, F.lit(9)).cast("int"))).otherwise(F.col("p_name"))
    g = text.gap_of(b)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), g["family"].alias("family"), g["kind"].alias("kind"))


@query(
    """SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'blocked' WHEN event_id % 7 = 0 THEN 'skipped' WHEN event_type = 'view' THEN 'emitted' WHEN event_type = 'click' THEN 'covered' WHEN event_type = 'error' THEN 'gap' ELSE 'observed' END AS status FROM events"""
)
def gate_coverage_status(spark, sf_dir):
    e, t = F.col("event_id"), F.col("event_type")
    s = text.gate_status(F.when(e % 5 == 0, "b"), F.when(e % 7 == 0, "s").otherwise(""), t == "view", t == "click", t == "error")
    return read(spark, sf_dir, "events").select(e.alias("id"), s.alias("status"))


@query(
    """SELECT c_custkey AS id, 'src/' || c_mktsegment || '.ets' AS file, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS literal, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 10 AS INTEGER) END AS arg, c_custkey % 4 = 0 AS is_boolean,
  CASE WHEN c_custkey % 5 = 0 THEN 'A.[static]x|A.x|A.x|A._static_x' ELSE 'A.x' END AS variants, CASE WHEN c_custkey % 2 = 0 THEN 'missing-currentness' ELSE 'truncated-materialization' END AS gap FROM customer"""
)
def text_codecs(spark, sf_dir):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    fragment = text.fragment_variants(F.when(k % 5 == 0, "A.[static]x").otherwise("A.x"))
    shown = F.when(k % 5 == 0, F.concat_ws("|", fragment[0], fragment[1], fragment[1], fragment[2])).otherwise(F.concat_ws("|", fragment))
    return read(spark, sf_dir, "customer").select(
        k.alias("id"),
        keys.file_of_method(F.concat(F.lit("@src\\"), seg, F.lit(".ets: C.m()"))).alias("file"),
        keys.quoted_literal(F.when(k % 3 == 0, F.concat(F.lit(" '"), seg, F.lit("' "))).otherwise(F.concat(F.lit("'"), seg, F.lit('"')))).alias("literal"),
        keys.argument_index(F.when(k % 2 == 0, F.concat(F.lit("arg"), k % 10, F.lit(".f"))).otherwise("base")).alias("arg"),
        keys.is_boolean_literal(F.when(k % 4 == 0, " TRUE ").otherwise("maybe")).alias("is_boolean"),
        shown.alias("variants"),
        text.gap_kind(F.when(k % 2 == 0, "missing_currentness").otherwise("max_depth")).alias("gap"),
    )


@query(
    """SELECT p_partkey AS id, 'api:official:' || p_brand || ':module=m%20' || p_size || ':file=:export=:decl=:member=' || p_partkey || ':invoke=call:params=0%3Aa%2C1%3Ab:ret=' AS api_id,
  'm ' || p_size AS module, 2 AS n_params, CAST(NULL AS VARCHAR) AS broken FROM part"""
)
def api_identity_codec(spark, sf_dir):
    made = keys.api_id(F.lit("official"), F.col("p_brand"), module=F.concat(F.lit("m "), F.col("p_size")), member=F.col("p_partkey").cast("string"), invoke=F.lit("call"), params=F.lit("0:a,1:b"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), made.alias("api_id"))
    parsed = keys.parse_api_id(F.col("api_id"))
    return rows.select("id", "api_id", parsed["module"].alias("module"), F.size(keys.split_parameters(parsed["params"])).alias("n_params"), keys.parse_api_id(F.concat("api_id", F.lit(":x")))["module"].alias("broken"))


@query(
    """SELECT s_suppkey AS id, 'ns.List<T>|ns.List|List' AS receivers, 'a/b/c' AS logical_path, 'mod#' || s_nationkey || '#m#0:a,1:b' AS descriptor,
  CASE WHEN s_suppkey % 2 = 0 THEN 'fam' ELSE 'api.source.asset_' || s_nationkey || '.bind' END AS family, 'a|b|z' AS merged FROM supplier"""
)
def identity_codecs(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    return read(spark, sf_dir, "supplier").select(
        k.alias("id"),
        F.array_join(keys.receiver_candidates(F.lit("ns.List<T>")), "|").alias("receivers"),
        keys.logical_path(F.lit("./a\\b//c/")).alias("logical_path"),
        keys.descriptor_key(F.lit(" Mod"), n, F.lit("m"), F.lit("0:a,1:b")).alias("descriptor"),
        keys.rule_family(F.when(k % 2 == 0, " fam ").otherwise(" "), F.lit("Source"), F.concat(F.lit("Asset-"), n), F.lit("bind")).alias("family"),
        F.array_join(keys.merged(F.array(F.lit("z"), F.lit(""), F.lit("a"), F.lit("b"), F.lit("a"))), "|").alias("merged"),
    )


@query("""SELECT n_nationkey AS id, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '"}') AS fingerprint FROM nation""")
def stable_hash(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), keys.stable_hash(("name", F.col("n_name")), ("key", F.col("n_nationkey"))).alias("fingerprint"))
