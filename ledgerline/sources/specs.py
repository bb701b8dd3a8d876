"""Specifications, test files and manifests as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: The order of methods, and manifests with their language, the first one that a folder has.
METHOD_ORDER = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
MANIFESTS = {"pyproject.toml": "python", "setup.py": "python", "requirements.txt": "python", "package.json": "js", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java", "go.mod": "go", "composer.json": "php", "Gemfile": "ruby", "Cargo.toml": "rust"}
MOST_ENTRIES = 40
_URL = r"""["'`](/[A-Za-z0-9_\-{}/.:?=&]*)["'`]"""
_VERB = r"(?i)\b(get|post|put|patch|delete)\b"


def spec_operations(specs: DataFrame, file: str, text: str) -> DataFrame:
    """file, method, path, operation_id, params, body_fields, statuses, auth: paths times methods of JSON specifications.

    Parameters are those of the path and of the operation; statuses are the whole numbers among the response keys; auth holds if the operation
    has a security entry and the document has schemes; body_fields are the property names of the JSON body, over one reference to a component."""
    from .schemas import components

    doc = specs.select(F.col(file), F.expr(f"try_parse_json({text})").alias("d")).where("d is not null")
    guarded = F.coalesce(F.size(F.expr("try_variant_get(d, '$.components.securitySchemes', 'map<string,variant>')")), F.lit(0)) > 0
    doc = doc.select(file, F.expr("try_variant_get(d, '$.paths', 'map<string,variant>')").alias("paths"), guarded.alias("guarded"))
    per_path = doc.select(file, "guarded", F.explode("paths").alias("path", "p"))
    ops = per_path.select(file, "guarded", "path", F.expr("try_variant_get(p, '$.parameters', 'array<variant>')").alias("shared"), F.explode(F.expr("try_variant_get(p, '$', 'map<string,variant>')")).alias("m", "op")).where(F.upper("m").isin(METHOD_ORDER))
    nothing = F.array().cast("array<variant>")
    params = F.concat(F.coalesce("shared", nothing), F.coalesce(F.expr("try_variant_get(op, '$.parameters', 'array<variant>')"), nothing))
    names = F.filter(F.transform(params, lambda p: F.try_variant_get(p, "$.name", "string")), lambda n: n.isNotNull())
    schema = F.expr("try_variant_get(op, '$.requestBody.content[\"application/json\"].schema', 'variant')")
    rows = ops.withColumns({"schema": schema, "names": names})
    # a body's component is joined by its reference: no operation carries the components of its document
    far = components(specs, file, text).select(F.col("file").alias("_file"), "ref", F.map_keys(F.try_variant_get("node", "$.properties", "map<string,variant>")).alias("_far"))
    rows = rows.withColumn("ref", F.try_variant_get(F.col("schema"), "$['$ref']", "string"))
    rows = rows.join(far.withColumnRenamed("ref", "_ref"), (F.col(file) == F.col("_file")) & (F.col("ref") == F.col("_ref")), "left")
    own = F.map_keys(F.try_variant_get(F.col("schema"), "$.properties", "map<string,variant>"))
    fields = F.coalesce(F.array_sort(F.coalesce(own, F.col("_far"))), F.array().cast("array<string>"))
    responses = F.map_keys(F.expr("try_variant_get(op, '$.responses', 'map<string,variant>')"))
    statuses = F.array_sort(F.filter(F.transform(F.coalesce(responses, F.array().cast("array<string>")), lambda s: s.try_cast("int")), lambda s: s.isNotNull()))
    auth = (F.coalesce(F.size(F.expr("try_variant_get(op, '$.security', 'array<variant>')")), F.lit(0)) > 0) & F.col("guarded")
    return rows.select(file, F.upper("m").alias("method"), "path", F.expr("try_variant_get(op, '$.operationId', 'string')").alias("operation_id"), F.col("names").alias("params"), fields.alias("body_fields"), statuses.alias("statuses"), auth.alias("auth"))


def schema_refs(specs: DataFrame, file: str, text: str) -> DataFrame:
    """file, name: all references to components anywhere in a text."""
    return specs.select(F.col(file), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r'"\$ref"\s*:\s*"[^"]*/([^"/]+)"'), 1))).alias("name"))


def yaml_paths(specs: DataFrame, file: str, text: str) -> DataFrame:
    """file, path of YAML specifications, by their lines: keys that begin with / at no more than four blanks."""
    sniffed = specs.where(F.substring(text, 1, 2048).rlike(r"(?m)^\s*(openapi|swagger)\s*:"))
    return sniffed.select(F.col(file), F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]{0,4}(/[^\s:]*)\s*:"), 1)).alias("path"))


def test_urls(files: DataFrame, file: str, text: str, most: int = MOST_ENTRIES) -> DataFrame:
    """file, line, method, path of quoted URLs in test files; the method is the first verb in the line before and the line itself, empty if there is none.

    Line and line before come out of the file's own array, so nothing is shuffled but for the format's cap of entries a file."""
    lines = F.split(text, "\n")
    rows = files.select(F.col(file), lines.alias("_l"), F.posexplode(lines).alias("_i", "_t")).where(F.col("_t").rlike(_URL))
    window = F.concat_ws(" ", F.get("_l", F.col("_i") - 1), "_t")
    found = rows.select(file, (F.col("_i") + 1).alias("line"), F.upper(F.regexp_extract(window, _VERB, 1)).alias("method"), F.posexplode(F.regexp_extract_all("_t", F.lit(_URL), 1)).alias("_k", "url")).where("length(url) > 1")
    n = F.row_number().over(Window.partitionBy(file).orderBy("line", "_k"))
    return found.select(file, "line", "method", F.regexp_replace("url", r"\?.*$", "").alias("path"), n.alias("_n")).where(F.col("_n") <= most).drop("_n")


def services(files: DataFrame, path: str) -> DataFrame:
    """root, manifest, language, n_files: folders of depth 0 to 2 with a manifest, by the order of MANIFESTS, and the root; n_files by the longest root of each file."""
    from ..operators.matching import longest_prefix

    names = F.element_at(F.split(path, "/"), -1)
    order = F.array_position(F.array(*[F.lit(m) for m in MANIFESTS]), names)
    root = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    units = files.where((order > 0) & (F.size(F.split(path, "/")) <= 3)).groupBy(root.alias("root")).agg(F.min_by(names, order).alias("manifest"))
    base = files.sparkSession.range(1).select(F.lit("").alias("root"))  # one row
    units = base.join(units, "root", "full")
    language = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in MANIFESTS.items() for x in p]), F.col("manifest")), F.lit(""))
    rooted = files.select(F.concat(F.lit("/"), path).alias("p")).distinct()
    owned = longest_prefix(rooted, "p", units.select(F.when(F.col("root") == "", "").otherwise(F.concat(F.lit("/"), "root")).alias("r")), "r").groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    at = F.when(F.col("root") == "", "").otherwise(F.concat(F.lit("/"), "root"))
    return units.withColumn("r", at).join(owned, "r", "left").select("root", F.coalesce("manifest", F.lit("")).alias("manifest"), language.alias("language"), F.coalesce("n", F.lit(0)).alias("n_files"))


def workspaces(files: DataFrame, path: str, text: str) -> DataFrame:
    """path, workspace of package files: a list, or the list packages of an object."""
    listed = F.expr(f"coalesce(try_variant_get(try_parse_json({text}), '$.workspaces', 'array<string>'), try_variant_get(try_parse_json({text}), '$.workspaces.packages', 'array<string>'))")
    return files.select(F.col(path), F.explode(listed).alias("workspace"))


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: imports (src, module as dotted name) to files (path): of the places a module can stand, the first one that is there."""
    tail = F.replace("module", F.lit("."), F.lit("/"))
    places = F.array(*[F.concat(F.lit(root), tail, F.lit(end)) for root in ("", "src/", "app/", "lib/") for end in (".py", "/__init__.py")])
    tried = imports.select("src", "module", F.posexplode(places).alias("n", "path"))
    hit = tried.join(files.select("path").distinct(), "path")
    return hit.groupBy("src", "module").agg(F.min_by("path", "n").alias("dst"))


#: The endings that a script module is tried with.
SCRIPT_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def resolved_script_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """src, spec, dst: relative imports (src, spec) of scripts to files (path): the path with an ending, else its index with an ending, else as it is; the first that is there.

    Steps above the root stay at the root; specs that don't begin with a dot are packages and left out."""
    parts = F.filter(F.concat(F.slice(F.split("src", "/"), F.lit(1), F.size(F.split("src", "/")) - 1), F.split("spec", "/")), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    walked = F.aggregate(parts, empty, lambda at, p: F.when(p != "..", F.array_append(at, p)).when(F.size(at) > 0, F.slice(at, F.lit(1), F.size(at) - 1)).otherwise(at))
    target = F.array_join(walked, "/")
    tried = F.array(*[F.concat(target, F.lit(e)) for e in SCRIPT_ENDINGS], *[F.concat(target, F.lit("/index" + e)) for e in SCRIPT_ENDINGS], target)
    rows = imports.where(F.col("spec").startswith(".")).select("src", "spec").distinct().select("src", "spec", F.posexplode(tried).alias("n", "path"))
    return rows.join(files.select("path").distinct(), "path").groupBy("src", "spec").agg(F.min_by("path", "n").alias("dst"))


#: What the path of a test file looks like, the kinds of what a corpus holds, and where a text shows what it is.
TEST_FILE = r"(^|/)(tests?|__tests__|spec)(/|_)|(_test|\.test|\.spec|_spec)\.\w+$|(^|/)test_[^/]+$"
KINDS = {"request": "http_file", "spec": "openapi", "url": "test_url"}
_HEAD, _YAML = 2048, r"(?m)^\s*(openapi|swagger)\s*:"


def harvest(files: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """kind, method, path, file, line of what files (path, language, text) say of routes: request files, specifications in JSON and YAML, each with a row of its own, and URLs in test files.

    The suffix of a file decides what it is read as; at most ``most`` rows a file, in the order of its text."""
    from .mining import request_lines, spec_routes

    f = files.select(F.col("path").alias("file"), "language", "text", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"))
    head = F.substring("text", 1, _HEAD)
    js = f.where(F.col("suffix") == "json").where(F.contains(head, F.lit('"openapi"')) | F.contains(head, F.lit('"swagger"'))).where(F.expr("try_parse_json(text) is not null"))
    ya = f.where(F.col("suffix").isin("yaml", "yml") & head.rlike(_YAML))
    tests = f.where(~F.col("suffix").isin("http", "rest", "json", "yaml", "yml") & (F.col("language") != "") & F.col("file").rlike(TEST_FILE))
    row = lambda df, kind, method, path, line, place: df.select(F.lit(KINDS[kind]).alias("kind"), method.alias("method"), path.alias("path"), "file", line.cast("int").alias("line"), place.cast("long").alias("_place"))
    none, one = F.lit(""), F.lit(1)
    mark = row(js, "spec", none, none, one, F.lit(0)).unionByName(row(ya, "spec", none, none, one, F.lit(0)))
    routes = row(spec_routes(js, "file", "text"), "spec", F.col("method"), F.col("path"), one, F.lit(1))
    lines = ya.select("file", F.posexplode(F.split("text", "\n")).alias("i", "t")).withColumn("p", F.regexp_extract("t", r"^\s{0,4}(/[^\s:]*)\s*:", 1)).where("p <> ''")
    yaml = row(lines, "spec", none, F.col("p"), F.col("i") + 1, F.col("i") + 1)
    sent = row(request_lines(f.where(F.col("suffix").isin("http", "rest")), "file", "text", most), "request", F.col("method"), F.col("path"), F.col("line"), F.col("line"))
    urls = row(test_urls(tests, "file", "text", most), "url", F.col("method"), F.col("path"), F.col("line"), F.col("line"))
    every = mark.unionByName(routes).unionByName(yaml).unionByName(sent).unionByName(urls)
    n = F.row_number().over(Window.partitionBy("file").orderBy("_place", "line", "path", "method"))
    return every.withColumn("_n", n).where(F.col("_n") <= most).drop("_n", "_place")


#: Where a parameter can be, and the content that bodies are read from first.
LOCATIONS, JSON = ("path", "query", "header"), "application/json"


def _operations(specs: DataFrame, file: str, text: str) -> DataFrame:
    """file, method, path, shared, op: paths times methods."""
    doc = specs.select(F.col(file).alias("file"), F.expr(f"try_variant_get(try_parse_json({text}), '$.paths', 'map<string,variant>')").alias("paths"))
    per_path = doc.select("file", F.explode("paths").alias("path", "p"))
    ops = per_path.select("file", "path", F.expr("try_variant_get(p, '$.parameters', 'array<variant>')").alias("shared"), F.explode(F.expr("try_variant_get(p, '$', 'map<string,variant>')")).alias("m", "op"))
    return ops.where(F.upper("m").isin(METHOD_ORDER)).select("file", F.upper("m").alias("method"), "path", "shared", "op")


def parameters(specs: DataFrame, file: str, text: str) -> DataFrame:
    """file, method, path, n, name, location, type, required, description: parameters of the path, then of the operation; references to components are followed once.

    A location other than path and header counts as query; parameters of the path are required unless they say otherwise."""
    from .schemas import TYPES, components

    none = F.array().cast("array<variant>")
    listed = F.concat(F.coalesce("shared", none), F.coalesce(F.expr("try_variant_get(op, '$.parameters', 'array<variant>')"), none))
    rows = _operations(specs, file, text).select("file", "method", "path", F.posexplode(listed).alias("n", "p"))
    get = lambda c, k: F.try_variant_get(F.col("p"), c, k)
    rows = rows.withColumn("ref", get("$['$ref']", "string"))
    far = rows.where("ref is not null").drop("p").join(components(specs, file, text).withColumnRenamed("node", "p"), ["file", "ref"], "left")
    both = rows.where("ref is null").unionByName(far.select(*rows.columns))
    where, kind = get("$.in", "string"), get("$.schema.type", "string")
    location = F.when(where.isin(*LOCATIONS), where).otherwise("query")
    return both.select("file", "method", "path", "n", F.coalesce(get("$.name", "string"), F.lit("")).alias("name"), location.alias("location"), F.when(kind.isin(TYPES), kind).otherwise("unknown").alias("type"), F.coalesce(get("$.required", "boolean"), F.coalesce(where, F.lit("")) == "path").alias("required"), get("$.description", "string").alias("description"))


def bodies(specs: DataFrame, file: str, text: str) -> DataFrame:
    """file, method, path, part (body, or the status of a response that is a whole number), name, description, node: the JSON schemas of operations.

    JSON content first, else the first content with a schema.  The name is that of the component, with [] for each array around it, else RequestBody or Response and the status; responses without a
    schema have a null node."""
    ops = _operations(specs, file, text)
    get = lambda c, path, kind: F.try_variant_get(c, path, kind)
    asked = ops.select("file", "method", "path", F.lit("body").alias("part"), F.lit(None).cast("string").alias("description"), get(F.col("op"), "$.requestBody.content", "map<string,variant>").alias("content"))
    answers = ops.select("file", "method", "path", F.explode(get(F.col("op"), "$.responses", "map<string,variant>")).alias("part", "r")).where(F.col("part").try_cast("int").isNotNull())
    answers = answers.select("file", "method", "path", "part", get(F.col("r"), "$.description", "string").alias("description"), get(F.col("r"), "$.content", "map<string,variant>").alias("content"))
    others = F.filter(F.transform(F.map_values("content"), lambda m: get(m, "$.schema", "variant")), lambda m: m.isNotNull())
    node = F.when(F.map_contains_key("content", JSON), get(F.try_element_at("content", F.lit(JSON)), "$.schema", "variant")).otherwise(F.get(others, F.lit(0)))
    rows = asked.unionByName(answers).withColumn("node", node).where("part <> 'body' or node is not null").drop("content")
    # arrays around a reference, one level an entry; deeper ones than these have no name of their own
    named = F.lit(None).cast("string")
    for depth in range(3, -1, -1):
        inside = "$" + ".items" * depth
        ref = get(F.col("node"), f"{inside}['$ref']", "string")
        around = F.lit(True)
        for k in range(depth):
            around = around & (get(F.col("node"), "$" + ".items" * k + ".type", "string") == "array")
        named = F.when(F.coalesce(around & ref.startswith("#/"), F.lit(False)), F.concat(F.element_at(F.split(ref, "/"), -1), F.lit("[]" * depth))).otherwise(named)
    default = F.when(F.col("part") == "body", "RequestBody").otherwise(F.concat(F.lit("Response"), "part"))
    return rows.withColumn("name", F.when(F.col("node").isNotNull(), F.coalesce(named, default)))
