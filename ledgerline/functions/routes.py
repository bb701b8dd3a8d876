"""Identity of routes and other text rules, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normalize_path(path: Column) -> Column:
    """Trimmed, one leading slash, every placeholder ({x}, :x, <t:x>) as {param}, one trailing slash less."""
    p = F.regexp_replace(path, r"^\s+|\s+$", "")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    p = F.regexp_replace(p, r"<(?:[^<>:]+:)?([^<>]+)>", "{$1}")
    p = F.regexp_replace(p, r":([A-Za-z_][A-Za-z0-9_]*)", "{$1}")
    p = F.regexp_replace(p, r"\{[^}]+\}", "{param}")
    return F.when((F.length(p) > 1) & p.endswith("/"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)


def route_key(method: Column, path: Column) -> Column:
    return F.concat_ws(":", F.upper(method), normalize_path(path))


def url_path(url: Column) -> Column:
    """The path of a URL: without scheme, host, query and fragment; / if none; {{base_url}} is left out."""
    u = F.replace(url, F.lit("{{base_url}}"), F.lit(""))
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    u = F.regexp_replace(u, r"[?#].*$", "")
    return F.when(u == "", F.lit("/")).otherwise(u)


def with_params(path: Column) -> Column:
    """Segments of digits only (a .html ending aside) as placeholders."""
    return F.regexp_replace(path, r"/[0-9]+(\.html)?(?=/|$)", "/{id}")


def placeholder_names(path: Column) -> Column:
    """Names in {x}, :x and <t:x>, in this order, repeats kept."""
    return F.concat(F.regexp_extract_all(path, F.lit(r"\{([^{}:]+)"), 1), F.regexp_extract_all(path, F.lit(r"(?<![A-Za-z0-9_]):([A-Za-z_][A-Za-z0-9_]*)"), 1), F.regexp_extract_all(path, F.lit(r"<(?:[^<>:]+:)?([^<>]+)>"), 1))


def wildcard(path: Column) -> Column:
    """Every placeholder as *."""
    return F.regexp_replace(path, r"\{[^{}]*\}|<[^<>]*>|:[A-Za-z_][A-Za-z0-9_]*", "*")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def is_secret_name(name: Column) -> Column:
    return name.rlike("(?i)key|token|secret|password")


def header_name(argument: Column) -> Column:
    """snake_case to Title-Dash."""
    return F.array_join(F.transform(F.split(argument, "_"), lambda x: F.initcap(F.lower(x))), "-")


def looks_like_date(value: Column) -> Column:
    return value.rlike("^[0-9].*[-/]")


def is_confined(path: Column) -> Column:
    """Relative, without .. parts and drive letters."""
    return (F.length(path) > 0) & ~path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")


def snippet(lines: Column) -> Column:
    """Lines without white space at their ends, joined."""
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")


def snippet_hash(lines: Column) -> Column:
    return F.sha2(snippet(lines), 256)


#: Coarse types of declared ones, by language; all others are unknown.
PYTHON_TYPES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "list": "array", "dict": "object", "datetime": "string", "date": "string", "uuid": "string", "decimal": "number"}
SCRIPT_TYPES = {"string": "string", "number": "number", "boolean": "boolean", "any": "unknown", "date": "string"}


def _looked_up(name: Column, known: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), name), F.lit("unknown"))


def python_type(name: Column) -> Column:
    return _looked_up(F.lower(F.trim(name)), PYTHON_TYPES)


def script_type(name: Column) -> Column:
    n = F.lower(F.trim(name))
    return F.when(n.endswith("[]"), "array").otherwise(_looked_up(F.regexp_replace(n, r"[\[\]]+$", ""), SCRIPT_TYPES))
