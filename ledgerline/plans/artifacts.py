"""Queries of files, harvests, whole specifications, artifacts and plans, each with its DuckDB counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import evidence, index, plan, versions
from ..operators.stores import shared_folder
from ..sources import files, schemas, specs
from .catalogue import query, table
from .report import _AUDIT, audited
from .verification import derived, duck, norm_sql


@query("SELECT source, lang AS language, count(*) AS n_lines, 'json' AS suffix FROM (SELECT source, lang FROM documents) GROUP BY ALL")
def scanned_files(spark, sf):
    """The documents' ids, written as files by source and language, beside the same ones in folders that hold no source: the scan finds each once."""
    folder = f"{shared_folder(spark)}/ledgerline/tree-{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang")
    for inside in ("src", "node_modules", ".hidden"):
        rows.write.option("maxRecordsPerFile", 1000).partitionBy("source", "lang").json(f"{folder}/{inside}")
    found = files.scan(spark, folder)
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]*)/", 1)
    lines = found.select(part("source").alias("source"), part("lang").alias("language"), F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("n"), F.regexp_extract("path", r"\.([^./]+)$", 1).alias("suffix"))
    return lines.groupBy("source", "language", "suffix").agg(F.sum("n").alias("n_lines"))


#: A file a part: requests, a specification in JSON or YAML, a test, or code.
SOURCES = """SELECT concat(CASE p_size % 6 WHEN 4 THEN 'tests/' ELSE 'src/' END, 'f', p_partkey, CASE p_size % 6 WHEN 0 THEN '.http' WHEN 1 THEN '.JSON' WHEN 2 THEN '.yml' WHEN 3 THEN '.json' ELSE '.py' END) AS path, CASE WHEN p_size % 6 > 3 THEN 'python' ELSE '' END AS language,
 CASE p_size % 6 WHEN 0 THEN concat('GET https://h.example/u/', p_size, '?q=1', chr(10), '# no', chr(10), ' POST {{{{{{{{base}}}}}}}}/v', chr(10), 'PUT other') WHEN 1 THEN concat('{{{{"openapi": "3", "paths": {{{{"/a', p_size, '": {{{{"get": {{{{}}}}, "post": {{{{}}}}, "x-no": {{{{}}}}}}}}}}}}}}}}') WHEN 2 THEN concat('openapi: 3', chr(10), 'paths:', chr(10), '  /y', p_size, ':', chr(10), '      /deep:', chr(10), '/z :')
 WHEN 3 THEN '{{{{"plain": 1}}}}' ELSE concat('client.post(', chr(10), '"/t/', p_size, '?x=1")', chr(10), 'x = 1', chr(10), 'y = "/"') END AS text FROM {{part}}""".replace("{{", "{").replace("}}", "}")


@query(
    f"""WITH s AS (SELECT path AS file, p_size FROM ({duck(SOURCES)}) JOIN part ON CAST(regexp_extract(path, 'f([0-9]+)', 1) AS BIGINT) = p_partkey), r AS (SELECT * FROM (VALUES (0, 'http_file', 'GET', '/u/', true, 1), (0, 'http_file', 'POST', '/v', false, 3), (1, 'openapi', '', '', false, 1), (1, 'openapi', 'GET', '/a', true, 1), (1, 'openapi', 'POST', '/a', true, 1),
    (2, 'openapi', '', '', false, 1), (2, 'openapi', '', '/y', true, 3), (2, 'openapi', '', '/z', false, 5), (4, 'test_url', 'POST', '/t/', true, 2)) t(k, kind, method, path, sized, line)) SELECT kind, method, CASE WHEN sized THEN path || p_size ELSE path END AS path, file, CAST(line AS INTEGER) AS line FROM s JOIN r ON k = p_size % 6"""
)
def harvested_corpus(spark, sf):
    return specs.harvest(derived(spark, sf, SOURCES))


#: Specifications with parameters of all kinds, shared ones and references, and bodies and responses by content.
FULL = """SELECT s_suppkey AS file, concat('{"openapi": "3", "components": {"schemas": {"Pet": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "tags": {"type": "array", "items": {"type": "integer"}}}}}, "parameters": {"Page": {"name": "page", "in": "query", "schema": {"type": "integer"}, "description": "which"}}},
 "paths": {"/p', s_nationkey, '/{id}": {"parameters": [{"name": "id", "in": "path", "schema": {"type": "string"}}, {"$ref": "#/components/parameters/Page"}], "get": {"parameters": [{"name": "X-Id", "in": "header", "required": true}, {"name": "c", "in": "cookie"}, {"$ref": "#/components/parameters/None"}],
  "responses": {"200": {"description": "all", "content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/Pet"}}}}}, "404": {"description": "none"}, "default": {}}},
  "post": {"requestBody": {"content": {"', CASE WHEN s_suppkey % 2 = 0 THEN 'application/json' ELSE 'text/x' END, '": {"schema": {"$ref": "#/components/schemas/Pet"}}}}, "responses": {"201": {"content": {"application/json": {"schema": {"type": "object", "properties": {"ok": {"type": "boolean"}}}}}}}}}}}') AS text FROM <supplier>""".replace("{", "{{").replace("}", "}}").replace("<", "{").replace(">", "}")


@query(
    """SELECT s_suppkey AS file, method, '/p' || s_nationkey || '/{id}' AS path, CAST(n AS INTEGER) AS n, name, location, type, required, description FROM supplier, (VALUES ('GET', 0, 'id', 'path', 'string', true, NULL), ('GET', 1, 'page', 'query', 'integer', false, 'which'), ('GET', 2, 'X-Id', 'header', 'unknown', true, NULL), ('GET', 3, 'c', 'query', 'unknown', false, NULL), ('GET', 4, '', 'query', 'unknown', false, NULL),
    ('POST', 0, 'id', 'path', 'string', true, NULL), ('POST', 1, 'page', 'query', 'integer', false, 'which')) t(method, n, name, location, type, required, description)"""
)
def spec_parameters(spark, sf):
    return specs.parameters(derived(spark, sf, FULL), "file", "text")


@query(
    """SELECT s_suppkey AS file, method, '/p' || s_nationkey || '/{id}' AS path, part, name, description, field, type, required FROM supplier, (VALUES ('GET', '200', 'Pet[]', 'all', NULL, NULL, NULL), ('GET', '404', NULL, 'none', NULL, NULL, NULL), ('POST', 'body', 'Pet', NULL, 'name', 'string', true), ('POST', 'body', 'Pet', NULL, 'tags', 'array', false), ('POST', 'body', 'Pet', NULL, 'tags[]', 'integer', true), ('POST', '201', 'Response201', NULL, 'ok', 'boolean', false)) t(method, part, name, description, field, type, required)"""
)
def spec_bodies(spark, sf):
    """Bodies and responses of operations with the fields of their schemas; those without fields once."""
    given = derived(spark, sf, FULL)
    found = specs.bodies(given, "file", "text").withColumn("root", F.concat_ws(" ", "method", "path", "part"))
    fields = schemas.resolved_schemas(found.where("node is not null").select("file", "root", "node"), schemas.components(given, "file", "text"))
    named = fields.select("file", "root", F.col("path").alias("field"), "type", "required")
    return found.drop("node").join(named, ["file", "root"], "left").drop("root")


@query(
    f"""WITH {_AUDIT}, rq AS (SELECT DISTINCT 'GET:' || {norm_sql("'/x' || p_partkey || '/:id/'")} AS key, p_partkey AS k FROM part), md AS (SELECT 'GET:' || {norm_sql("'/x' || p_partkey || '/{a}'")} AS key, p_partkey AS entry FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'GET:' || {norm_sql("'/x' || (p_partkey - 1) || '/<int:b>'")}, p_partkey FROM part WHERE p_partkey % 5 = 0),
    lm AS (SELECT key, max(entry) AS entry FROM md GROUP BY key), hd AS (SELECT id, count(*) AS n, max(CASE verdict WHEN 'verified' THEN 0 WHEN 'stale' THEN 1 ELSE 2 END) AS worst, arg_min(file || ':' || CASE kind WHEN 'summary' THEN 3 WHEN 'auth' THEN 2 ELSE 1 END, ord) FILTER (verdict = 'verified') AS cite FROM au GROUP BY id)
    SELECT rq.key, CASE WHEN hd.n IS NULL THEN 'unverified' WHEN worst = 0 THEN 'verified' WHEN worst = 1 THEN 'stale' ELSE 'fabricated' END AS status, cite, coalesce(hd.n, 0) AS n FROM rq LEFT JOIN lm ON lm.key = rq.key LEFT JOIN hd ON hd.id = lm.entry"""
)
def artifact_status(spark, sf):
    """Requests against metadata whose keys are written by hand, some of them twice."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    requests = p.select(P.item_key(F.lit("get"), F.concat(F.lit("{{base_url}}/x"), k, F.lit("/:id/"))).alias("key"))
    one = p.where("p_partkey % 3 <> 0").select(F.concat(F.lit("get:/x"), k, F.lit("/{a}")).alias("key"), k.alias("entry"), k.alias("ord"))
    two = p.where("p_partkey % 5 = 0").select(F.concat(F.lit("GET:x"), k - 1, F.lit("/<int:b>")).alias("key"), k.alias("entry"), k.alias("ord"))
    return evidence.artifact_status(requests, one.unionByName(two), audited(spark, sf).withColumnRenamed("id", "entry"))


#: Plans: what is live of each part, and what would be written.
_PLAN = """SELECT p_partkey AS uid, CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'reject' WHEN p_size % 5 = 1 THEN 'stale' ELSE 'pass' END AS verdict, 100 - p_size AS existence, 95 AS path, concat('{{"name": "', p_brand, '", "header": [{{"key": "b"}}, {{"key": "a"}}]}}') AS item,
 CASE p_partkey % 3 WHEN 0 THEN concat('{{"id": "7", "header": [{{"key": "a"}}, {{"key": "b"}}], "name": "', p_brand, '"}}') WHEN 1 THEN '{{"name": "other"}}' END AS live FROM {part}"""


@query(
    f"""WITH p AS ({duck(_PLAN)}), o AS (SELECT *, CASE WHEN verdict IS NULL THEN 'unknown' WHEN verdict IN ('reject', 'stale') THEN 'rejected' ELSE 'planned' END AS outcome, least(existence, path) AS score FROM p), a AS (SELECT *, CASE WHEN outcome = 'planned' THEN CASE WHEN score >= 90 THEN 'auto' WHEN score >= 75 THEN 'flag' WHEN score >= 50 THEN 'needs_approval' ELSE 'blocked' END END AS action FROM o),
    i AS (SELECT 'sha256:' || sha256('model|state|' || string_agg(CAST(uid AS VARCHAR), ',' ORDER BY CAST(uid AS VARCHAR)) || '|/|1') AS plan_id FROM p)
    SELECT plan_id, uid, outcome, action, CASE WHEN action <> 'blocked' THEN CASE WHEN live IS NULL THEN 'new' WHEN uid % 3 = 0 THEN 'unchanged' ELSE 'modified' END END AS change, CASE WHEN action <> 'blocked' THEN item END AS item FROM a, i"""
)
def plan_document(spark, sf):
    """A plan, saved as a version and read back."""
    rows = derived(spark, sf, _PLAN)
    live = rows.where("live is not null").select("uid", F.col("live").alias("item"))
    entries = plan.compile_entries(rows.select("uid"), rows.select("uid"), rows.where("verdict is not null").select("uid", "verdict", "existence", "path"), live)
    folder = f"{shared_folder(spark)}/ledgerline/plans-{uuid.uuid4().hex}"
    plan.save_plan(plan.document(entries, rows.select("uid", "item"), live, "model", "state", "/", "1"), folder)
    return versions.newest(spark, folder, 1).rows


@query("SELECT phase, CASE phase WHEN 'looked' THEN 1 ELSE 2 END AS version, c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS content FROM customer, (VALUES ('looked'), ('stored')) t(phase)")
def confirmed_change(spark, sf):
    """What a change would do, looked at without a write; then confirmed."""
    folder = f"{shared_folder(spark)}/ledgerline/phases-{uuid.uuid4().hex}"
    versions.publish(table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("content")), folder, 0, 1)
    change = lambda rows: rows.select("key", F.when((F.col("key") % 3 == 0) & ~F.col("content").endswith("!"), F.concat(F.upper("content"), F.lit("!"))).otherwise(F.col("content")).alias("content"))
    looked, before = plan.confirmed(spark, folder, 1, change, confirm=False)
    out = looked.select(F.lit("looked").alias("phase"), F.lit(before).alias("version"), "key", "content")
    _, after = plan.confirmed(spark, folder, 1, change, confirm=True)
    return out.unionByName(versions.newest(spark, folder, 1).rows.select(F.lit("stored").alias("phase"), F.lit(after).alias("version"), "key", "content"))


@query("SELECT concat('f', CAST(floor(p_partkey / 20) AS BIGINT)) AS file, p_partkey AS line_start, p_brand AS name, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS parent FROM part")
def stored_symbols(spark, sf):
    """Symbols in their order, as documents and back: what a document lacks gets its default, what is no document falls away."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    rows = p.select(F.concat(F.lit("f"), F.floor(k / 20)).alias("file"), k.alias("line_start"), F.col("p_brand").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("parent"), F.lit("x").alias("unknown"))
    docs = index.to_documents(rows).unionByName(p.select(F.lit("[1]").alias("doc"))).unionByName(p.select(F.lit("{cut").alias("doc")))
    return index.in_order(index.from_documents(docs, "file string, line_start long, name string, parent string", {"parent": ""}), "symbols")
