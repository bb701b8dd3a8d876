"""Requests of nested folders, and collections in several files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import item_key
from ..operators.stores import written_with

_ITEM = "struct<name: string, item: array<string>, request: string>"
_REQUEST = "struct<method: string, url: string>"


def _levels(collections: DataFrame, id_col: str, text: str) -> list[DataFrame]:
    """Entries (id, trail: names of the folders around, ord: place on each level, name, item, request) of JSON collections, level by level.

    Each round opens one level for all collections, so rounds are as many as the deepest nesting; levels are written, so neither plan nor lineage grow."""
    none = F.array().cast("array<string>")
    start = collections.select(F.col(id_col).alias("id"), none.alias("trail"), F.array().cast("array<int>").alias("ord"), F.from_json(text, _ITEM).alias("i"))
    front, found, some = start.select("id", "trail", "ord", F.col("i.item").alias("items")), [], True
    while some:
        opened = front.select("id", "trail", "ord", F.posexplode("items").alias("at", "json")).select("id", "trail", F.array_append("ord", F.col("at")).alias("ord"), F.from_json("json", _ITEM).alias("i"))
        level, some = written_with(opened.select("id", "trail", "ord", "i.name", "i.item", "i.request"), "level", F.col("item").isNotNull())
        found.append(level)
        front = level.where("item is not null").select("id", F.array_append("trail", F.coalesce("name", F.lit(""))).alias("trail"), "ord", F.col("item").alias("items"))
    return found


def requests(collections: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, folder_path (names from the outermost, without empty ones), ord (place on each level), name, request, key of every request in JSON collections.

    An entry with a list of items is a folder, whatever else it holds.  Texts that don't parse have no requests."""
    rows = None
    for level in _levels(collections, id_col, text):
        here = level.where("item is null and request is not null")
        rows = here if rows is None else rows.unionByName(here)
    return _keyed(rows).withColumnRenamed("id", id_col)


def _keyed(rows: DataFrame) -> DataFrame:
    parsed = F.from_json("request", _REQUEST)
    url = F.coalesce(F.get_json_object(parsed["url"], "$.raw"), parsed["url"])
    return rows.select("id", F.array_join(F.filter("trail", lambda t: t != ""), "/").alias("folder_path"), "ord", "name", "request", item_key(parsed["method"], url).alias("key"))


def collection_errors(collections: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, error, place of what makes a collection unfit to be written; no rows: all is well.

    no object; no name; no items; no requests; no key (a request without method or URL); folder without a name; folder twice (siblings of one name, which a merge by names would take for one).  place: the folder's trail."""
    d = F.col("d")
    whole = collections.select(F.col(id_col).alias("id"), F.expr(f"try_parse_json({text})").alias("d"))
    named = F.coalesce(F.try_variant_get(d, "$.info.name", "string"), F.lit("")) != ""
    listed = F.try_variant_get(d, "$.item", "array<variant>").isNotNull()
    first = F.when(F.try_variant_get(d, "$", "map<string,variant>").isNull() | d.isNull(), F.array(F.lit("no object"))).otherwise(F.array_compact(F.array(F.when(~named, "no name"), F.when(~listed, "no items"))))
    tops = whole.select("id", F.explode(first).alias("error"), F.lit("").alias("place"))
    entries = None
    for level in _levels(collections, id_col, text):
        entries = level if entries is None else entries.unionByName(level)
    sent = _keyed(entries.where("item is null and request is not null"))
    none = whole.where(listed).select("id").join(sent.select("id").distinct(), "id", "left_anti").select("id", F.lit("no requests").alias("error"), F.lit("").alias("place"))
    keyless = sent.where("key is null").select("id", F.lit("no key").alias("error"), F.col("folder_path").alias("place"))
    trail = F.array_join("trail", "/")
    folders = entries.where("item is not null").select("id", trail.alias("place"), F.slice("ord", F.lit(1), F.size("ord") - 1).alias("_level"), F.coalesce("name", F.lit("")).alias("name"))
    nameless = folders.where("name = ''").select("id", F.lit("folder without a name").alias("error"), "place")
    twice = folders.where("name <> ''").groupBy("id", "_level", "place", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("folder twice").alias("error"), F.concat_ws("/", F.nullif("place", F.lit("")), "name").alias("place"))
    return tops.unionByName(none).unionByName(keyless).unionByName(nameless).unionByName(twice).withColumnRenamed("id", id_col)


def fragments(files: DataFrame, root: str = "root", module: str = "module", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(requests, errors) of collections whose root file (module empty) and modules are files of their own; a module's requests lie in a folder of its name.

    errors: root, module of texts that are no JSON object.  One error makes the whole collection unusable: none of its requests is returned."""
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(text))), F.lit("")).startswith("OBJECT")
    errors = files.where(~whole).select(root, module)
    usable = files.join(errors.select(root).distinct(), root, "left_anti")
    found = requests(usable.select(F.struct(root, module).alias("file"), text), "file", text)
    path = F.concat_ws("/", F.nullif(F.col(f"file.{module}"), F.lit("")), F.nullif(F.col("folder_path"), F.lit("")))
    return found.select(F.col(f"file.{root}").alias(root), F.col(f"file.{module}").alias(module), path.alias("folder_path"), "ord", "name", "key"), errors
