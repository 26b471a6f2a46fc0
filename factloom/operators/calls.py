"""Call edges that a declared call graph lacks: captures, dispatch on what a value points
to, synthetic and deferred calls, callbacks, and the edge generators of library calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import cut, fixpoint
from .pairs import distinct_pairs

EDGE = ["kind", "src", "dst", "field", "site"]


def _edge(df: DataFrame, kind: str, src, dst, field=None, site=None) -> DataFrame:
    none = F.lit(None)
    return df.select(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), (none if field is None else field).cast("string").alias("field"), (none if site is None else site).cast("long").alias("site"))


def capture_edges(uses: DataFrame, environment: DataFrame) -> DataFrame:
    """Copies of an outer variable to the inner uses of its name: uses (method, name, node),
    environment (method, name, outer)."""
    return _edge(distinct_pairs(uses, environment, ["method", "name"], "node", "outer"), "copy", F.col("outer"), F.col("node"))


def dispatch(calls: DataFrame, points_to: DataFrame, types: DataFrame, lookup: DataFrame, above: DataFrame) -> DataFrame:
    """(site, caller, callee) of calls (site, caller, base, name) by the objects that the
    base points to (var, obj), their class (obj, class) and its method (class, name, method).
    A callee from which the caller is already called (above: caller, callee) is left out."""
    known = points_to.join(types, "obj").select(F.col("var").alias("base"), "class").distinct()
    found = calls.join(known, "base").join(lookup, ["class", "name"]).select("site", "caller", F.col("method").alias("callee")).distinct()
    back = above.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    return found.join(back, ["caller", "callee"], "left_anti").where("caller <> callee").select("site", "caller", "callee")


def unowned(calls: DataFrame, taken: DataFrame) -> DataFrame:
    """Calls (site, ..) but for the sites (site) that deferred execution owns."""
    return calls.join(taken.select("site"), "site", "left_anti")


def synthetic_invokes(calls: DataFrame, callables: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """call and return edges of unresolved calls (site, caller, value) whose value is a known
    callable (value, method), but for ``unowned``'s sites ``taken`` (none: they are left out already)."""
    j = (calls if taken is None else unowned(calls, taken)).join(callables, "value")
    return _edge(j, "call", F.col("caller"), F.col("method"), site=F.col("site")).union(_edge(j, "return", F.col("method"), F.col("caller"), site=F.col("site"))).distinct()


def on_frontier(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """The edges that leave a node of the frontier (node): the others need not exist yet."""
    return edges.join(frontier.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(*edges.columns)


def callback_parameters(calls: DataFrame, bindings: DataFrame, parameters: DataFrame) -> DataFrame:
    """Payloads to the parameters of callbacks: calls (site, args array), bindings (site,
    callback, skip: arguments before the payload), parameters (callback, pos, node)."""
    args = calls.select("site", F.posexplode("args").alias("at", "arg"))
    j = args.join(bindings, "site").withColumn("pos", F.col("at") - F.col("skip")).where("pos >= 0").join(parameters, ["callback", "pos"])
    return _edge(j, "copy", F.col("arg"), F.col("node"), site=F.col("site")).distinct()


def stored_callbacks(stores: DataFrame, invokes: DataFrame, below: DataFrame) -> DataFrame:
    """(site, callback): callbacks kept in a receiver's field (class, field, callback) and
    called through it (site, class, field), where the caller's class is the store's or below."""
    # what is above the receiver's class: the stores spread over all classes below are many more
    up = below.select(F.col("descendant").alias("class"), "ancestor").distinct()
    asked = invokes.join(up, "class").select("site", F.col("ancestor").alias("class"), "field")
    return distinct_pairs(asked, stores, ["class", "field"], "site", "callback")


def field_bridges(loads: DataFrame, stores: DataFrame) -> DataFrame:
    """(method, source, target): a method that loads a field of its parameter (method,
    field, value) and stores the value into another (method, value, field)."""
    l = loads.select("method", "value", F.col("field").alias("source"))
    s = stores.select("method", "value", F.col("field").alias("target"))
    return l.join(s, ["method", "value"]).where("source <> target").select("method", "source", "target").distinct()


def static_init_stores(inits: DataFrame, reads: DataFrame) -> DataFrame:
    """Copies of what a class initialiser stores (class, field, order, value), the last
    store of a field, to the reads of it (class, field, node)."""
    last = inits.groupBy("class", "field").agg(F.max_by("value", "order").alias("value"))
    j = reads.join(last, ["class", "field"])
    return _edge(j, "copy", F.col("value"), F.col("node"), field=F.col("field"))


def activation_paths(steps: DataFrame, units: DataFrame, most: int = 8) -> DataFrame:
    """(unit, node, hops, truncated): what leads to deferred units (unit, node) over at most
    ``most`` register, declare and settle steps (src, dst), each node with its least distance;
    ``truncated`` for units with steps behind a node at that distance."""
    back = cut(steps.select(F.col("dst").alias("at"), F.col("src").alias("from")).distinct())
    step = lambda d, _: d.join(back, F.col("node") == F.col("at")).select("unit", F.col("from").alias("node"))
    found = fixpoint(units.select("unit", "node"), step, ["unit", "node"], most)[0].withColumnRenamed("round", "hops")
    short = found.where(F.col("hops") == most).join(back.select(F.col("at").alias("node")), "node", "left_semi").select("unit").distinct().withColumn("truncated", F.lit(True))
    return found.join(short, "unit", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def fulfilment_sources(ways: DataFrame, promises: DataFrame, leaves: DataFrame, depth: int = 8, most: int = 256) -> DataFrame:
    """(promise, source, truncated): leaves (node) that a promise (promise, node) may be
    settled by, over at most ``depth`` ways (src, dst) and ``most`` nodes, nearest first;
    ``truncated`` where either bound left something out."""
    found, _ = fixpoint(promises.select("promise", "node"), lambda d, _: d.join(ways, F.col("node") == F.col("src")).select("promise", F.col("dst").alias("node")), ["promise", "node"], depth)
    sizes = found.groupBy("promise").agg(F.count("*").alias("n"), F.max("round").alias("far"))
    near = found.withColumn("place", F.row_number().over(Window.partitionBy("promise").orderBy("round", "node"))).where(F.col("place") <= most)
    got = near.join(leaves.select("node"), "node").select("promise", F.col("node").alias("source"))
    cut_off = (F.col("n") > most) | (F.col("far") >= depth)
    return got.join(sizes, "promise").select("promise", "source", cut_off.alias("truncated"))


# ---------------------------------------------------------------- library calls as edge generators


def storage_edges(calls: DataFrame) -> DataFrame:
    """set, get and link of named storages (site, op, key, node): one cell for each key."""
    k = calls.where("key is not null").withColumn("cell", F.concat(F.lit("cell:"), "key"))
    node = F.col("node").cast("string")
    put = _edge(k.where("op = 'set'"), "copy", node, F.col("cell"))
    get = _edge(k.where("op = 'get'"), "copy", F.col("cell"), node)
    both = k.where("op = 'link'")
    return put.union(get).union(_edge(both, "copy", node, F.col("cell"))).union(_edge(both, "copy", F.col("cell"), node))


def container_edges(calls: DataFrame) -> DataFrame:
    """add, set, push store into an element of a container, get and pop load from it:
    calls (site, op, base, node)."""
    put = _edge(calls.where("op in ('add', 'set', 'push')"), "store", F.col("node").cast("string"), F.col("base").cast("string"), F.lit("element"))
    return put.union(_edge(calls.where("op in ('get', 'pop')"), "load", F.col("base").cast("string"), F.col("node").cast("string"), F.lit("element")))


def task_edges(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """Arguments of a task or worker (site, function, args array) behind the function
    itself to that function's parameters (function, pos, node)."""
    args = calls.select("site", "function", F.posexplode("args").alias("pos", "arg"))
    j = args.join(parameters, ["function", "pos"])
    return _edge(j, "copy", F.col("arg").cast("string"), F.col("node").cast("string"), site=F.col("site"))


def function_edges(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """call, apply and bind (site, op, function, args array): the first argument is the
    receiver (pos -1); call and bind shift the rest by one, apply spreads its second,
    of which only the slot is known."""
    args = calls.select("site", "op", "function", F.posexplode("args").alias("at", "arg"))
    pos = F.when(F.col("op") == "apply", F.when(F.col("at") == 0, -1).when(F.col("at") == 1, 0)).otherwise(F.col("at") - 1)
    j = args.withColumn("pos", pos).where("pos is not null").join(parameters, ["function", "pos"])
    field = F.when((F.col("op") == "apply") & (F.col("at") == 1), "arr:*")
    return _edge(j, "copy", F.col("arg").cast("string"), F.col("node").cast("string"), field=field, site=F.col("site"))


GENERATORS = {"storage": storage_edges, "container": container_edges, "task": task_edges, "function": function_edges}


def generated(tables: dict[str, tuple[DataFrame, ...]]) -> DataFrame:
    """Edges of all generators by their name; an unknown name is an error."""
    out = None
    for name, given in tables.items():
        if name not in GENERATORS:
            raise ValueError(f"no generator {name}")
        rows = GENERATORS[name](*given)
        out = rows if out is None else out.unionByName(rows)
    return out
