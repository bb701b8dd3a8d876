"""Schemas of specifications as field rows: references followed, allOf merged, nested down to a fixed depth.

References are followed in rounds of joins with a table of components, so one round serves all schemas of all specifications at once.  Rounds are as many
as the longest chain of references has links; each is written below the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.stores import written, written_with

#: Coarse types of a schema, and how deep fields are nested.
TYPES = ["string", "integer", "number", "boolean", "array", "object"]
MOST_DEPTH = 4
_KEY = ["file", "root", "path"]


def _get(node: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(node, path, kind)


def _plain(name: Column) -> Column:
    """A name in a path: its own dots, brackets and backslashes behind a backslash, so that different fields have different paths."""
    return F.regexp_replace(name, r"([\\.\[\]])", r"\\$1")


def components(specs: DataFrame, file: str, text: str) -> DataFrame:
    """file, ref, node: all named parts of JSON specifications, by the reference that leads to them."""
    doc = specs.select(F.col(file).alias("file"), F.expr(f"try_parse_json({text})").alias("d")).where("d is not null")
    sections = doc.select("file", F.explode(_get(F.col("d"), "$.components", "map<string,variant>")).alias("section", "s"))
    new = sections.select("file", F.concat(F.lit("#/components/"), "section").alias("at"), F.explode(_get(F.col("s"), "$", "map<string,variant>")).alias("name", "node"))
    old = doc.select("file", F.lit("#/definitions").alias("at"), F.explode(_get(F.col("d"), "$.definitions", "map<string,variant>")).alias("name", "node"))
    return new.unionByName(old).select("file", F.concat_ws("/", "at", "name").alias("ref"), "node")


def _ref(node: Column) -> Column:
    """What a node refers to; null if it is a schema itself."""
    return F.nullif(_get(node, "$['$ref']", "string"), F.lit(""))


def _split(front: DataFrame) -> DataFrame:
    """Elements of allOf in place of their schema, with what they refer to (ref) and whether they have elements of their own (parted); an empty allOf leaves one empty element."""
    parted = F.when(_ref(F.col("node")).isNull(), _get(F.col("node"), "$.allOf", "array<variant>"))
    whole = F.array(F.struct("node", "place", "merged"))
    parts = F.transform(parted, lambda x, i: F.struct(x.alias("node"), F.array_append("place", i).alias("place"), F.lit(True).alias("merged")))
    none = F.array(F.struct(F.lit(None).cast("variant").alias("node"), F.col("place"), F.lit(True).alias("merged")))
    rows = front.withColumn("parts", F.when(parted.isNull(), whole).when(F.size(parted) == 0, none).otherwise(parts)).drop("node", "place", "merged")
    rows = rows.select("*", F.inline("parts")).drop("parts")
    ref = _ref(F.col("node"))
    return rows.withColumns({"ref": ref, "parted": F.when(ref.isNull() & _get(F.col("node"), "$.allOf", "array<variant>").isNotNull(), F.lit(True))})


def _facts(node: Column) -> list[Column]:
    return [_get(node, "$.type", "string").alias("type"), _get(node, "$.description", "string").alias("description"), _get(node, "$.items", "variant").alias("items"), _get(node, "$.properties", "map<string,variant>").alias("properties"), _get(node, "$.required", "array<string>").alias("required")]


def dereferenced(tasks: DataFrame, parts: DataFrame) -> DataFrame:
    """tasks (file, root, path, node, seen: references that lead nowhere) with what each node comes to: type, description, items, properties, required, followed.

    A reference leads to its component, once a task in the order in which a reader meets them: from the first to the last element of allOf, depth first.  Met again, or missing, or outside of the
    file, it is an empty schema.  allOf is an object with the properties of its elements, of one name the last, and all their required names.

    Visits carry their place (the positions in allOf on the way) and the references on the way with theirs.  Of a reference met at several places only the first
    counts, and visits behind another one fall away; those that come late in a round are cut at once, so a task has no more visits in a round than its file has components."""
    front = tasks.select(*_KEY, "node", "seen", F.array().cast("array<int>").alias("place"), F.array().cast("array<struct<ref:string,place:array<int>>>").alias("way"), F.lit(False).alias("merged"))
    met, ends = None, None
    while True:
        state, some = written_with(_split(front), "schemas", F.col("ref").isNotNull() | F.col("parted").isNotNull())
        done = state.where("ref is null and parted is null").select(*_KEY, "node", "place", "way", "merged")
        ends = done if ends is None else ends.unionByName(done)
        if not some:
            break
        here = state.where("ref is not null")
        blocked = F.array_contains("seen", F.col("ref")) | F.exists("way", lambda w: w["ref"] == F.col("ref"))
        known = here.where(~blocked).select(*_KEY, "ref", "place")
        met = known if met is None else met.unionByName(known)
        first = met.groupBy(*_KEY, "ref").agg(F.min("place").alias("first"))
        fresh = here.join(first, [*_KEY, "ref"], "left").withColumn("leads", ~blocked & (F.col("first") == F.col("place")))
        led = fresh.join(parts.withColumnRenamed("node", "to"), ["file", "ref"], "left")
        way = F.when(F.col("leads"), F.array_append("way", F.struct("ref", "place"))).otherwise(F.col("way"))
        led = led.select(*_KEY, F.when(F.col("leads"), F.col("to")).alias("node"), "seen", "place", way.alias("way"), "merged")
        front = led.unionByName(state.where("parted is not null").select(*led.columns))
    if met is None:
        counted = ends.withColumn("followed", F.array().cast("array<string>"))
    else:
        least = met.groupBy(*_KEY, "ref").agg(F.min("place").alias("place"))
        firsts = least.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("ref", "place"))).alias("firsts"))  # as many as the file has components
        counted = ends.join(firsts, _KEY, "left").where(F.forall("way", lambda w: F.try_element_at("firsts", w["ref"]) == w["place"])).withColumn("followed", F.coalesce(F.map_keys("firsts"), F.array().cast("array<string>"))).drop("firsts")
    leaf = counted.select(*_KEY, "place", "merged", "followed", *_facts(F.col("node")))
    one = leaf.where("not merged").drop("merged", "place")
    # the lists hold what one author wrote down in one specification
    lists = leaf.where("merged").groupBy(*_KEY).agg(F.first("followed").alias("followed"), F.flatten(F.collect_list(F.coalesce("required", F.array().cast("array<string>")))).alias("required"))
    named = leaf.where("merged and properties is not null").select(*_KEY, "place", F.explode("properties").alias("name", "node"))
    last = named.groupBy(*_KEY, "name").agg(F.max_by("node", "place").alias("node"))
    held = last.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("name", "node"))).alias("properties"))
    many = lists.join(held, _KEY, "left").select(*_KEY, "followed", F.lit("object").alias("type"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("variant").alias("items"), "properties", "required")
    return one.unionByName(many)


def resolved_schemas(schemas: DataFrame, parts: DataFrame) -> DataFrame:
    """file, root, path, depth, name, type, required, description: the fields of each schema (file, root, node), nested.

    path joins names by dots, ``[]`` stands for the elements of an array, whose field is named item.  Objects and arrays at depth MOST_DEPTH aren't looked into.  References that
    the schema itself stands for lead nowhere inside of it, which ends rings through it; other rings end at the depth."""
    nothing = F.array().cast("array<string>")
    tops = written(dereferenced(schemas.select("file", "root", F.lit("").alias("path"), "node", nothing.alias("seen")), parts), "schemas")
    kind = F.when(F.col("type").isin(TYPES), F.col("type")).otherwise("unknown")
    wanted = lambda rows, path: rows.where("properties is not null").select("file", "root", "seen", "required", F.col("path").alias("above"), F.explode("properties").alias("name", "node")).select("file", "root", F.concat("above", path, _plain(F.col("name"))).alias("path"), "node", "seen", "name", F.coalesce(F.array_contains("required", F.col("name")), F.lit(False)).alias("needed"))
    tasks, found, memo = wanted(tops.withColumn("seen", F.col("followed")), F.lit("")), [], None
    columns = ["type", "description", "items", "properties", "required"]
    for depth in range(MOST_DEPTH + 1):
        tasks = written(tasks.withColumns({"ref": _ref(F.col("node")), "parted": _get(F.col("node"), "$.allOf", "array<variant>").isNotNull()}), "schemas")
        kept = [*_KEY, "seen", "name", "needed"]
        resolved = tasks.where("ref is null and not parted").select(*kept, *_facts(F.col("node")))
        # a reference comes to the same wherever a schema has it: each is followed once
        asked = tasks.where("ref is not null").select("file", "root", F.col("ref").alias("path"), "seen").distinct()
        fresh = asked if memo is None else asked.join(memo.select(*_KEY), _KEY, "left_anti")
        fresh, some = written_with(fresh, "schemas")
        if some:
            as_node = F.parse_json(F.to_json(F.create_map(F.lit("$ref"), F.col("path"))))
            more = written(dereferenced(fresh.withColumn("node", as_node), parts), "schemas")
            memo = more if memo is None else memo.unionByName(more)
        if memo is not None:
            resolved = resolved.unionByName(tasks.where("ref is not null").join(memo.select("file", "root", F.col("path").alias("ref"), *columns), ["file", "root", "ref"]).select(*kept, *columns))
        inline = tasks.where("ref is null and parted")
        if not inline.isEmpty():
            resolved = resolved.unionByName(dereferenced(inline.select(*_KEY, "node", "seen"), parts).join(inline.select(*kept), _KEY).select(*kept, *columns))
        state = written(resolved.withColumns({"depth": F.lit(depth), "type": kind}), "schemas")
        found.append(state.select(*_KEY, "depth", "name", "type", F.col("needed").alias("required"), "description"))
        if depth == MOST_DEPTH:
            break
        elements = state.where("type = 'array'").select("file", "root", F.concat("path", F.lit("[]")).alias("path"), F.col("items").alias("node"), "seen", F.lit("item").alias("name"), F.lit(True).alias("needed"))
        tasks = wanted(state.where("type = 'object'"), F.lit(".")).unionByName(elements)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
