"""Path algebra and names, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .routes import normalize_path, url_path


def item_key(method: Column, url: Column) -> Column:
    """METHOD:/path of a stored request; null without method or url."""
    known = (F.coalesce(method, F.lit("")) != "") & (F.coalesce(url, F.lit("")) != "")
    return F.when(known, F.concat_ws(":", F.upper(method), normalize_path(url_path(url))))


def metadata_key(key: Column) -> Column:
    """A key as written by hand: split at the first colon, method in upper case, path in normal form, / if none."""
    at = F.instr(key, ":")
    method = F.when(at > 0, F.substring(key, F.lit(1), at - 1)).otherwise(key)
    path = F.when(at > 0, F.substring(key, at + 1, F.length(key))).otherwise("")
    return F.concat_ws(":", F.upper(F.trim(method)), normalize_path(F.when(path == "", "/").otherwise(path)))


def norm_prefix(prefix: Column) -> Column:
    """Trimmed, one slash in front, one at the end less; empty stays empty."""
    p = F.trim(F.coalesce(prefix, F.lit("")))
    p = F.when((p == "") | p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    return F.when((F.length(p) > 1) & p.endswith("/"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)


def compose(prefix: Column, leaf: Column) -> Column:
    """A prefix and a leaf path; a leaf of / is the prefix itself."""
    p, x = norm_prefix(prefix), F.trim(F.coalesce(leaf, F.lit("")))
    rooted = F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))
    return F.when(p == "", rooted).when(x.isin("", "/"), p).otherwise(F.concat(p, rooted))


def _joined(prefix: Column, tail: Column) -> Column:
    both = F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), F.regexp_replace(tail, "^/+", ""))
    return F.when(prefix == "", tail).when(both.startswith("/"), both).otherwise(F.concat(F.lit("/"), both))


def composed_variants(literal: Column, own: Column, outer: Column) -> Column:
    """All of outer hint, own hint and literal together, each hint also left out; distinct, in order."""
    with_none = lambda a: F.array_union(F.array(F.lit("")), a)
    inner = F.transform(with_none(own), lambda i: _joined(i, literal))
    pairs = F.flatten(F.transform(with_none(outer), lambda o: F.transform(inner, lambda t: _joined(o, t))))
    clean = F.transform(pairs, lambda v: F.when(F.regexp_replace(v, "/+$", "") == "", "/").otherwise(F.regexp_replace(v, "/+$", "")))
    return F.array_sort(F.array_distinct(clean))


def relative(base: Column, path: Column) -> Column:
    """path as seen from the folder base, . and .. taken out; null where it climbs out of the tree."""
    parts = F.filter(F.concat(F.split(base, "/"), F.split(path, "/")), lambda s: ~s.isin("", "."))
    start = F.array().cast("array<string>")
    ok = F.aggregate(parts, F.struct(start.alias("at"), F.lit(True).alias("inside")), lambda acc, s: F.struct(
        F.when(s != "..", F.concat(acc["at"], F.array(s))).when(F.size(acc["at"]) > 0, F.slice(acc["at"], 1, F.size(acc["at"]) - 1)).otherwise(acc["at"]).alias("at"),
        (acc["inside"] & ((s != "..") | (F.size(acc["at"]) > 0))).alias("inside")))
    return F.when(ok["inside"], F.array_join(ok["at"], "/"))


def joined_url(parts: Column) -> Column:
    """Non-empty parts without slashes around them, under one slash; converters <type:name> as {name}."""
    clean = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^/+|/+$", "")), lambda p: p != "")
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(clean, "/")), r"<(?:[^<>:]+:)?([^<>]+)>", "{$1}")


def display_name(module: Column) -> Column:
    """users_admin-x as Users Admin X."""
    return F.initcap(F.lower(F.trim(F.regexp_replace(module, "[_-]+", " "))))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def folder_target(explicit: Column, configured: Column) -> Column:
    """The explicit folder, else the configured one unless that is the root, else the root."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.nullif(F.nullif(configured, F.lit("/")), F.lit("")), F.lit("/"))


def major(version: Column) -> Column:
    return F.try_to_number(F.split_part(version, F.lit("."), F.lit(1)), F.lit("999999")).cast("int")
