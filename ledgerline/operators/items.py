"""Stored items built from routes, and what a merge would change of them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.canonical import canonical_json

#: Examples by what a name contains, the first rule that fits.
NAME_RULES = [
    (("email",), "user@example.com"), (("first_name", "firstname"), "Jane"), (("last_name", "lastname"), "Doe"), (("username", "user_name"), "jane_doe"), (("name",), "Example Name"), (("phone", "mobile"), "+15555550123"),
    (("password",), "S3cret!Pass"), (("token", "secret", "apikey", "api_key"), "{{token}}"), (("url", "uri", "link"), "https://example.com"), (("amount", "price", "total", "cost"), 4200), (("currency",), "USD"),
    (("count", "quantity", "qty"), 3), (("age",), 30), (("id",), 1), (("created_at", "updated_at", "timestamp", "date", "_at"), "2026-06-27T10:00:00Z"), (("status",), "active"),
    (("description", "desc", "message", "note"), "Example text"), (("country",), "US"), (("city",), "San Francisco"), (("zip", "postal"), "94107"), (("is_", "has_", "enabled", "active"), True),
]
#: Examples by type.
TYPE_DEFAULTS = {"string": '"string"', "integer": "1", "number": "1.0", "boolean": "true", "array": "[]", "object": "{}", "unknown": '"value"'}


def example(name: Column, kind: Column) -> Column:
    """An example, as JSON text: of the first rule whose words the name contains; integers and numbers pass over rules without a number."""
    low, numeric = F.lower(name), kind.isin("integer", "number")
    out = None
    for words, value in NAME_RULES:
        hit = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(low, F.lit(w))
        if not isinstance(value, (int, float)):
            hit = hit & ~numeric
        out = F.when(hit, json.dumps(value)) if out is None else out.when(hit, json.dumps(value))
    default = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in TYPE_DEFAULTS.items() for x in p]), kind), F.lit(TYPE_DEFAULTS["unknown"]))
    return out.otherwise(default)


def url_struct(path: Column, query: Column, variables: Column) -> Column:
    """raw, host, path, query and variable of a request; a segment that is braced as a whole becomes :name."""
    bare = F.regexp_replace(path, "^/+", "")
    parts = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "/"))
    named = F.transform(parts, lambda s: F.when(s.startswith("{") & s.endswith("}"), F.concat(F.lit(":"), F.regexp_replace(s, r"^[{}]+|[{}]+$", ""))).otherwise(s))
    pick = lambda p: F.struct(p["name"].alias("key"), example(p["name"], p["type"]).alias("value"), (~p["required"]).alias("disabled"))
    fixed = lambda p: F.struct(p["name"].alias("key"), example(p["name"], p["type"]).alias("value"))
    return F.struct(F.concat(F.lit("{{base_url}}/"), bare).alias("raw"), F.array(F.lit("{{base_url}}")).alias("host"), named.alias("path"), F.when(F.size(query) > 0, F.transform(query, pick)).alias("query"), F.when(F.size(variables) > 0, F.transform(variables, fixed)).alias("variable"))


def request_items(routes: DataFrame) -> DataFrame:
    """id, name, request as JSON text of routes (id, method, path, query_params, path_params, headers, fields: arrays of struct name, type, required).

    Fields make a body and a Content-Type header before the others; absent parts are left out."""
    pick = lambda p: F.struct(p["name"].alias("key"), example(p["name"], p["type"]).alias("value"), (~p["required"]).alias("disabled"))
    content = F.struct(F.lit("Content-Type").alias("key"), F.lit('"application/json"').alias("value"), F.lit(None).cast("boolean").alias("disabled"))
    with_body = F.size("fields") > 0
    header = F.concat(F.when(with_body, F.array(content)).otherwise(F.array().cast("array<struct<key:string,value:string,disabled:boolean>>")), F.transform("headers", pick))
    raw = F.concat(F.lit("{"), F.array_join(F.transform("fields", lambda f: F.concat(F.lit('"'), f["name"], F.lit('": '), example(f["name"], f["type"]))), ", "), F.lit("}"))
    body = F.when(with_body, F.struct(F.lit("raw").alias("mode"), raw.alias("raw")))
    request = F.struct(F.upper("method").alias("method"), url_struct(F.col("path"), F.col("query_params"), F.col("path_params")).alias("url"), header.alias("header"), body.alias("body"))
    return routes.select("id", F.concat_ws(" ", F.upper("method"), "path").alias("name"), F.to_json(request).alias("request"))


def success_status(method: Column, statuses: Column) -> Column:
    """The first declared 2xx, else 201 for POST and 200 for others."""
    good = F.filter(statuses, lambda s: (s >= 200) & (s < 300))
    return F.when(F.size(good) > 0, F.get(good, F.lit(0))).otherwise(F.when(F.upper(method) == "POST", 201).otherwise(200))


def test_script(method: Column, statuses: Column, fields: Column) -> Column:
    """Test text: the status, and a property line for each required field, for all if none is required."""
    required = F.filter(fields, lambda f: f["required"])
    names = F.transform(F.when(F.size(required) > 0, required).otherwise(fields), lambda f: f["name"])
    status = success_status(method, statuses).cast("string")
    head = F.concat(F.lit('test("status is '), status, F.lit('");expect(status).eq('), status, F.lit(")"))
    return F.array_join(F.concat(F.array(head), F.transform(names, lambda n: F.concat(F.lit('expect(data).has("'), n, F.lit('")')))), "\n")


#: Parts of an item; lists and objects among them are JSON text.
PARTS = ["method", "url", "variable", "header", "body", "auth", "description", "event", "response", "name"]


def _as_meant(part: str) -> Column:
    """A part's JSON in the spelling that it has within an item, where headers have no order; text that is no JSON as it is."""
    return F.coalesce(canonical_json(F.concat(F.lit(f'{{"{part}":'), F.col(part), F.lit("}"))), F.col(part))


def applied(live: DataFrame, routes: DataFrame, width: int = 10_000) -> DataFrame:
    """Routes (key, ord, PARTS) merged into live items (key, PARTS; each key once), one after another by ord: each sees what earlier ones of its key left.

    key, ord, change (new, modified, unchanged) and the item's PARTS after each route.  The route owns method and url, and its header where it has one; it owns body and auth, which go if it lacks
    them.  The item keeps its url's variables where the route's url has none, and its description, event, response and name unless they are empty.

    Each part after a route is the first or last one that is there up to it, so the fold is running firsts and lasts.  They are taken within stretches of ``width`` moments of a key and carried
    over by one row a stretch: a key with a third of all routes is spread over as many tasks as it has stretches."""
    filled = lambda c: F.when(~F.col(c).isin("", "[]"), F.col(c)).alias(c)
    tidy = [filled(c) if c in ("variable", "description", "event", "response", "name") else F.col(c) for c in PARTS]
    rows = routes.select("key", F.col("ord").cast("long").alias("ord"), *tidy, F.lit(True).alias("_route")).unionByName(live.select("key", F.lit(None).cast("long").alias("ord"), *tidy, F.lit(False).alias("_route")))
    rows = rows.withColumn("_stretch", F.coalesce(F.floor(F.col("ord") / width), F.lit(-(2**62))))
    inside = Window.partitionBy("key", "_stretch").orderBy(F.asc_nulls_first("ord")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    lasts, firsts, owned = ["method", "url", "variable", "header"], ["description", "event", "response", "name"], ["body", "auth"]
    ends = rows.groupBy("key", "_stretch").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.coalesce("ord", F.lit(-(2**62))))).alias(c) for c in lasts], *[F.min_by(c, F.when(F.col(c).isNotNull(), F.coalesce("ord", F.lit(-(2**62))))).alias(c) for c in firsts], F.max_by(F.struct(*owned), F.coalesce("ord", F.lit(-(2**62)))).alias("_own"))
    carried = ends.select("key", "_stretch", *[F.last(c, ignorenulls=True).over(before).alias(f"_{c}") for c in lasts], *[F.first(c, ignorenulls=True).over(before).alias(f"_{c}") for c in firsts], F.last("_own").over(before).alias("_before"))
    run = rows.select("key", "ord", "_route", "_stretch", *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in lasts], *[F.first(c, ignorenulls=True).over(inside).alias(c) for c in firsts], *owned)
    now = run.join(carried, ["key", "_stretch"]).select("key", "ord", "_route", "_stretch", "_before", *[F.coalesce(c, f"_{c}").alias(c) for c in lasts], *[F.coalesce(f"_{c}", c).alias(c) for c in firsts], *owned)
    state = now.withColumn("_now", F.struct(*[_as_meant(c).alias(c) if c in ("header", "body") else F.col(c) for c in PARTS]))
    order = Window.partitionBy("key", "_stretch").orderBy(F.asc_nulls_first("ord"))
    # the first of a stretch is held against the end of the one before
    last = state.groupBy("key", "_stretch").agg(F.max_by("_now", F.coalesce("ord", F.lit(-(2**62)))).alias("_end")).withColumn("_past", F.lag("_end").over(Window.partitionBy("key").orderBy("_stretch"))).drop("_end")
    held = state.withColumn("_prior", F.lag("_now").over(order)).join(last, ["key", "_stretch"]).withColumn("_prior", F.coalesce("_prior", "_past"))
    change = F.when(F.col("_prior").isNull(), "new").when(F.col("_prior").eqNullSafe(F.col("_now")), "unchanged").otherwise("modified")
    return held.where("_route").select("key", "ord", change.alias("change"), *PARTS)


def merged_items(live: DataFrame, built: DataFrame) -> DataFrame:
    """key and PARTS of each key of either side; see applied(), of which this is the case of one route a key.  Keys of one side only stay as they are.

    No shuffle but the join: the sides hold each key once."""
    b, v = built.select("key", F.struct(*PARTS).alias("b")), live.select("key", F.struct(*PARTS).alias("v"))
    filled = lambda a, c: F.coalesce(F.nullif(F.col(f"v.{a}"), F.lit(c)), F.col(f"b.{a}")).alias(a)
    own = lambda a: F.when(F.col("b").isNotNull(), F.col(f"b.{a}")).otherwise(F.col(f"v.{a}")).alias(a)
    kept = lambda a: F.coalesce(F.col(f"b.{a}"), F.col(f"v.{a}")).alias(a)
    return b.join(v, "key", "full").select("key", kept("method"), kept("url"), kept("variable"), kept("header"), own("body"), own("auth"), filled("description", ""), filled("event", "[]"), filled("response", "[]"), filled("name", ""))


#: The errors that a full set of saved responses holds, with their names.
ERRORS = {400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 422: "Unprocessable Entity", 500: "Internal Server Error"}


def saved_responses(routes: DataFrame, style: str = "single") -> DataFrame:
    """id, n, name, status, code, body: the saved responses of routes (id, method, auth, responses: array of struct status, description, fields).

    single: the first declared 2xx, else 201 for POST and 200 for others.  minimal: that and one error.  full: all declared ones and the standard errors that aren't among them, 401 and 403 only with auth.  The
    body is an object of examples where fields are declared, else empty for 2xx and the error's name for others."""
    one = lambda code, text: F.struct(F.lit(code).cast("int").alias("status") if isinstance(code, int) else code.alias("status"), (F.lit(text) if isinstance(text, str) else text).alias("description"), F.array().cast("array<struct<name:string,type:string>>").alias("fields"))
    declared = F.transform("responses", lambda r: F.struct(r["status"].cast("int").alias("status"), r["description"].alias("description"), r["fields"].cast("array<struct<name:string,type:string>>").alias("fields")))
    good = F.filter(declared, lambda r: (r["status"] >= 200) & (r["status"] < 300))
    best = F.when(F.size(good) > 0, F.slice(good, 1, 1)).otherwise(F.array(one(F.when(F.upper("method") == "POST", 201).otherwise(200), "Success")))
    if style == "single":
        chosen = best
    elif style == "minimal":
        chosen = F.concat(best, F.array(one(400, ERRORS[400])))
    else:
        codes = F.transform("responses", lambda r: r["status"].cast("int"))
        more = F.array(*[one(code, name) for code, name in ERRORS.items()])
        chosen = F.concat(declared, F.filter(more, lambda r: ~F.array_contains(codes, r["status"]) & (~r["status"].isin(401, 403) | F.col("auth"))))
    known = F.create_map(*[F.lit(x) for pair in ERRORS.items() for x in pair])
    rows = routes.select("id", F.posexplode(chosen).alias("n", "r")).select("id", "n", F.col("r.status").alias("code"), "r.fields", F.coalesce(F.nullif("r.description", F.lit("")), F.try_element_at(known, F.col("r.status")), F.col("r.status").cast("string")).alias("status"))
    body = F.concat(F.lit("{"), F.array_join(F.transform("fields", lambda f: F.concat(F.lit('"'), f["name"], F.lit('": '), example(f["name"], f["type"]))), ", "), F.lit("}"))
    error = F.concat(F.lit('{"detail": '), F.to_json(F.struct("status")).substr(F.lit(11), F.length(F.to_json(F.struct("status"))) - 11), F.lit("}"))
    return rows.select("id", "n", F.concat_ws(" ", "code", "status").alias("name"), "status", "code", F.when(F.size("fields") > 0, body).when(F.col("code").between(200, 299), "{}").otherwise(error).alias("body"))


def change_lines(live: DataFrame, built: DataFrame) -> DataFrame:
    """key, lines, preserved: what an update would change of each key that both sides have, and what of the live side it leaves."""
    both = built.select("key", F.struct(*PARTS).alias("b")).join(live.select("key", F.struct(*PARTS).alias("v")), "key")
    differs = lambda a: ~F.col(f"b.{a}").eqNullSafe(F.col(f"v.{a}"))
    lines = F.array_compact(F.array(*[F.when(differs(a), F.lit(a)) for a in ("method", "url", "body", "auth")], F.when(F.col("b.header").isNotNull() & differs("header"), F.lit("header"))))
    some = lambda a: F.when(~F.coalesce(f"v.{a}", F.lit("")).isin("", "[]"), a)
    kept = F.array_compact(F.array(some("description"), some("event"), some("response")))
    return both.select("key", lines.alias("lines"), kept.alias("preserved"))


def folders(paths: DataFrame, path: str) -> DataFrame:
    """folder, depth of all folders that the paths need: each path and all its beginnings."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    steps = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.struct(F.array_join(F.slice("_p", 1, i), "/").alias("folder"), i.alias("depth")))
    return paths.select(parts.alias("_p")).where("size(_p) > 0").select(F.explode(steps).alias("s")).select("s.*").distinct()


def patched(base, patch):
    """patch on base: objects key by key, lists by their entries' key or else name, all else replaced."""
    if isinstance(base, dict) and isinstance(patch, dict):
        return base | {k: patched(base[k], v) if k in base else v for k, v in patch.items()}
    if not (isinstance(base, list) and isinstance(patch, list)):
        return patch
    out = list(base)
    for entry in patch:
        by = next((k for k in ("key", "name") if isinstance(entry, dict) and k in entry), None)
        at = next((i for i, x in enumerate(out) if by and isinstance(x, dict) and x.get(by) == entry[by]), None)
        if at is None:
            out.append(entry)
        else:
            out[at] = patched(out[at], entry)
    return out


def deep_patch(base: Column, patch: Column) -> Column:
    """patched() on two JSON columns, keys in order; a null patch changes nothing, null stays null."""

    @F.pandas_udf("string")
    def run(bases: pd.Series, patches: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else json.dumps(json.loads(b) if p is None else patched(json.loads(b), json.loads(p)), sort_keys=True, separators=(",", ":")) for b, p in zip(bases, patches)], dtype=object)

    return run(base, patch)
