"""Identity keys and small codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uri_component(text: Column) -> Column:
    """Percent-encoding that leaves letters, digits and - _ . ! ~ * ' ( ) as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def joined(sep: str, *parts: Column) -> Column:
    """All parts, nulls as empty text."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def location_id(node: Column, context: Column, path_key: Column) -> Column:
    base = F.concat(node.cast("string"), F.lit("@"), context.cast("string"))
    return F.when(path_key != "", F.concat(base, F.lit("."), path_key)).otherwise(base)


def fact_id(node: Column, context: Column, path_key: Column, source: Column) -> Column:
    return F.concat(location_id(node, context, path_key), F.lit("#src="), uri_component(source))


def field_location_key(kind: Column, node: Column, context: Column, path_key: Column) -> Column:
    return F.concat(kind, F.lit(":"), location_id(node, context, path_key))


def state_cell_key(cell: Column) -> Column:
    """kind, scope, owner, key, field path, index, allocation site, value version, precision."""
    return joined("|", cell["kind"], cell["scope"], cell["owner"], cell["key"], F.array_join(cell["field_path"], "."), cell["index"], cell["alloc_site"], cell["value_version"], cell["precision"])


def handle_key(h: Column) -> Column:
    return joined("|", h["cell_kind"], h["family"], h["scope"], h["key"], h["owner"], h["index"], h["alloc_site"], h["precision"])


def path_from_handle_key(key: Column) -> Column:
    """A JSON array of text, else the key split at dots."""
    return F.when(key.startswith("["), F.coalesce(F.from_json(key, "array<string>"), F.split(key, r"\."))).otherwise(F.split(key, r"\."))


def flow_key(*parts: Column) -> Column:
    return joined(" -> ", *parts)


def file_of_method(signature: Column) -> Column:
    return F.replace(F.regexp_extract(signature, r"@([^:>]+):", 1), F.lit("\\"), F.lit("/"))


def quoted_literal(text: Column) -> Column:
    """What stands between one pair of quotes; null for other texts."""
    found = F.regexp_extract(F.trim(text), r"^(['\"`])(.*)\1$", 2)
    return F.when(F.trim(text).rlike(r"^(['\"`])(.*)\1$"), found)


def argument_index(endpoint: Column) -> Column:
    return F.nullif(F.regexp_extract(endpoint, r"^arg([0-9]+)", 1), F.lit("")).cast("int")


def is_boolean_literal(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "false", "0", "1")


API_PARTS = ("module", "file", "export", "decl", "member", "invoke", "params", "ret")


def api_id(authority: Column, domain: Column, **parts: Column) -> Column:
    """Eleven segments: api, authority, domain, then name=value of API_PARTS."""
    return F.concat_ws(":", F.lit("api"), authority, domain, *[F.concat(F.lit(f"{p}="), uri_component(F.coalesce(parts.get(p, F.lit("")), F.lit("")))) for p in API_PARTS])


def parse_api_id(text: Column) -> Column:
    """map of parts; null for a wrong count, prefix, or missing or repeated names."""
    cuts = F.split(text, ":", -1)
    named = F.transform(F.slice(cuts, 4, 8), lambda s: F.split_part(s, F.lit("="), F.lit(1)))
    values = F.transform(F.slice(cuts, 4, 8), lambda s: F.url_decode(F.replace(F.substring_index(s, "=", -1), F.lit("+"), F.lit("%2B"))))
    good = (F.size(cuts) == 11) & (F.element_at(cuts, 1) == "api") & (F.array_sort(named) == F.array_sort(F.lit(list(API_PARTS))))
    both = F.map_from_arrays(F.concat(F.lit(["authority", "domain"]), named), F.concat(F.slice(cuts, 2, 2), values))
    return F.when(good, both)


def split_parameters(text: Column) -> Column:
    """Entries of a parameter list; each next one starts with its index and a colon."""
    return F.filter(F.transform(F.split(text, r",(?=\d+:)"), lambda s: F.trim(s)), lambda s: s != "")


def receiver_candidates(type_text: Column) -> Column:
    """Names a receiver's type may go by: the text without type arguments, and its last part."""
    bare = F.trim(F.regexp_replace(type_text, r"<.*>|\[\]", ""))
    return F.array_distinct(F.filter(F.array(F.trim(type_text), bare, F.substring_index(bare, ".", -1)), lambda s: s != ""))


def logical_path(text: Column) -> Column:
    """Forward slashes, no doubled ones, no leading ./ or trailing slash."""
    out = F.regexp_replace(F.replace(F.trim(text), F.lit("\\"), F.lit("/")), "/+", "/")
    return F.regexp_replace(F.regexp_replace(out, r"^(\./)+", ""), r"(.)/$", "$1")


def descriptor_key(module: Column, export: Column, member: Column, params: Column) -> Column:
    return joined("#", F.lower(F.trim(module)), export, member, F.array_join(split_parameters(params), ","))


def rule_family(family: Column, role: Column, asset: Column, binding: Column) -> Column:
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.trim(family), F.lit("")), F.concat_ws(".", F.lit("api"), clean(role), clean(asset), clean(binding)))


def merged(items: Column) -> Column:
    """Distinct, not empty, ascending."""
    return F.array_sort(F.array_distinct(F.filter(items, lambda s: s.isNotNull() & (s != ""))))


def stable_hash(*named: tuple[str, Column]) -> Column:
    """SHA-256 of the JSON of the named values, names ascending."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(named, key=lambda x: x[0])])), 256)
