"""Queries of whole specifications and models: schemas over references, rings and allOf, models that may come in and their facts, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import apim, schemas
from .catalogue import query
from .verification import derived, duck, norm_sql

#: One specification a supplier: chains of references, rings, one within one, allOf of allOf with a part met twice, nested arrays, references to nothing and to another file.
SPECS = """SELECT s_suppkey AS file, concat('{{"openapi": "3.0.0", "components": {{"schemas": {{
 "Base": {{"type": "object", "required": ["id"], "properties": {{"id": {{"type": "', CASE WHEN s_suppkey % 2 = 0 THEN 'integer' ELSE 'string' END, '", "description": "key of ', s_nationkey, '"}}, "tag": {{"type": "string"}}}}}},
 "Left": {{"allOf": [{{"$ref": "#/components/schemas/Base"}}, {{"type": "object", "properties": {{"tag": {{"type": "number"}}, "left": {{"$ref": "#/components/schemas/Ring"}}}}}}]}},
 "Right": {{"description": "lost in the merge", "allOf": [{{"$ref": "#/components/schemas/Left"}}, {{"$ref": "#/components/schemas/Base"}}, {{"required": ["right", "tag"], "properties": {{"right": {{"type": "array", "items": {{"$ref": "#/components/schemas/Alias"}}}}}}}}]}},
 "Early": {{"allOf": [{{"$ref": "#/components/schemas/', CASE WHEN s_suppkey % 3 = 0 THEN 'Base' WHEN s_suppkey % 3 = 1 THEN 'Early' ELSE 'None' END, '"}}, {{"$ref": "#/components/schemas/Left"}}]}},
 "Alias": {{"$ref": "#/components/schemas/Alias2"}}, "Alias2": {{"$ref": "#/components/schemas/', CASE WHEN s_suppkey % 5 = 0 THEN 'Alias' ELSE 'Deep' END, '"}},
 "Ring": {{"type": "object", "properties": {{"next": {{"$ref": "#/components/schemas/Ring2"}}, "name": {{"type": "string"}}}}}},
 "Ring2": {{"type": "object", "required": ["back"], "properties": {{"back": {{"$ref": "#/components/schemas/Ring"}}, "self": {{"$ref": "#/components/schemas/Ring2"}}, "up": {{"$ref": "#/components/schemas/Right"}}}}}},
 "Deep": {{"type": "object", "properties": {{"a": {{"type": "object", "properties": {{"b": {{"type": "array", "items": {{"type": "array", "items": {{"type": "object", "properties": {{"c": {{"type": "boolean"}}}}}}}}}}, "n": {{"type": "', CASE WHEN s_suppkey % 7 = 0 THEN 'null' ELSE 'integer' END, '"}}}}}}, "o": {{"$ref": "other.yaml#/X"}}, "l": {{"$ref": "#/components/schemas/Lost"}}}}}},
 "Lost": {{"$ref": "#/components/schemas/None"}}, "Nothing": {{"allOf": []}}, "Plain": {{"type": "array", "items": {{"type": "string"}}}}}}}}}}') AS text FROM {supplier}"""

# v: for each schema, and for each reference inside of it, what is visited in the order of a reader; those met again fall away with what lies behind them
_CLOSURE = """SELECT file, root, start, place, way, merged, node FROM {first}
 UNION ALL SELECT v.file, v.root, v.start, s.place, s.way, s.merged, s.node FROM {v} v LEFT JOIN parts p ON p.file = v.file AND p.ref = v.node->>'$."$ref"',
  LATERAL (SELECT unnest(CASE WHEN v.node->>'$."$ref"' IS NOT NULL THEN [{{'place': v.place, 'way': list_append(v.way, {{'ref': v.node->>'$."$ref"', 'place': v.place}}), 'merged': v.merged, 'node': CASE WHEN list_contains(list_transform(v.way, lambda w: w.ref), v.node->>'$."$ref"') OR list_contains({seen}, v.node->>'$."$ref"') THEN NULL ELSE p.node END}}]
    WHEN json_exists(v.node, '$.allOf') THEN list_transform(range(CAST(json_array_length(v.node, '$.allOf') AS BIGINT)), lambda i: {{'place': list_append(v.place, CAST(i AS INTEGER)), 'way': v.way, 'merged': true, 'node': json_extract(v.node, '$.allOf[' || i || ']')}}) ELSE [] END) AS s)"""
_ENDS = """{n}_first AS (SELECT file, root, start, w.ref AS ref, min(w.place) AS place FROM (SELECT file, root, start, unnest(way) AS w FROM {n}_v) GROUP BY ALL), {n}_firsts AS (SELECT file, root, start, map(list(ref), list(place)) AS firsts FROM {n}_first GROUP BY ALL),
 {n}_own AS (SELECT {n}_v.*, firsts FROM {n}_v LEFT JOIN {n}_firsts f USING (file, root, start)), {n}_good AS (SELECT file, root, start, place, way, CASE WHEN len(list_filter(way, lambda w: firsts[w.ref] <> w.place)) > 0 THEN NULL ELSE node END AS node, merged FROM {n}_own),
 {n}_leaf AS (SELECT * FROM {n}_good WHERE node IS NULL OR (node->>'$."$ref"' IS NULL AND NOT json_exists(node, '$.allOf'))),
 {n}_head AS (SELECT file, root, start, bool_or(merged OR coalesce(json_exists(node, '$.allOf'), false)) AS merged FROM {n}_good GROUP BY ALL),
 {n}_prop AS (SELECT file, root, start, name, arg_max(json_extract(node, '$.properties."' || name || '"'), place) AS node, max(place) AS place FROM (SELECT *, unnest(json_keys(node, '$.properties')) AS name FROM {n}_leaf WHERE json_exists(node, '$.properties')) GROUP BY ALL),
 {n}_need AS (SELECT DISTINCT file, root, start, unnest(CAST(json_extract(node, '$.required') AS VARCHAR[])) AS name FROM {n}_leaf),
 {n}_props AS (SELECT file, root, start, list({{'name': name, 'node': p.node, 'required': q.name IS NOT NULL}}) AS props FROM {n}_prop p LEFT JOIN {n}_need q USING (file, root, start, name) GROUP BY ALL),
 {n} AS (SELECT h.file, h.root, h.start, CASE WHEN h.merged THEN 'object' ELSE l.node->>'$.type' END AS type, CASE WHEN NOT h.merged THEN l.node->>'$.description' END AS description, CASE WHEN NOT h.merged THEN json_extract(l.node, '$.items') END AS items, coalesce(props, []) AS props FROM {n}_head h LEFT JOIN {n}_leaf l ON l.file = h.file AND l.root = h.root AND l.start = h.start AND NOT h.merged LEFT JOIN {n}_props p ON p.file = h.file AND p.root = h.root AND p.start = h.start)"""
_KINDS = "('string', 'integer', 'number', 'boolean', 'array', 'object')"
_NO_WAY = "CAST([] AS INTEGER[]) AS place, CAST([] AS STRUCT(ref VARCHAR, place INTEGER[])[]) AS way, false AS merged"
_SCHEMAS_SQL = f"""WITH RECURSIVE docs AS (SELECT file, CAST(text AS JSON) AS d FROM ({duck(SPECS)})), parts AS (SELECT file, '#/components/schemas/' || name AS ref, name, json_extract(d, '$.components.schemas."' || name || '"') AS node FROM (SELECT *, unnest(json_keys(d, '$.components.schemas')) AS name FROM docs)),
 t0 AS (SELECT file, name AS root, '' AS start, {_NO_WAY}, node FROM parts UNION ALL SELECT file, '&' || name, '', {_NO_WAY}, CAST(json_object('$ref', ref) AS JSON) FROM parts), t_v AS ({_CLOSURE.format(first="t0", v="t_v", seen="[]::VARCHAR[]")}), {_ENDS.format(n="t")},
 seen AS (SELECT file, root, coalesce(map_keys(firsts), []) AS seen FROM t0 LEFT JOIN t_firsts USING (file, root)),
 s0 AS (SELECT seen.file, seen.root, r.ref AS start, {_NO_WAY}, CAST(json_object('$ref', r.ref) AS JSON) AS node FROM seen JOIN (SELECT file, ref FROM parts UNION ALL SELECT file, 'other.yaml#/X' FROM docs) r ON r.file = seen.file),
 s_v AS ({_CLOSURE.format(first="s0", v="s_v", seen="(SELECT seen FROM seen z WHERE z.file = v.file AND z.root = v.root)")}), {_ENDS.format(n="s")},
 f AS (SELECT t.file, t.root, p.name AS path, 0 AS depth, p.name AS name, p.required AS required, p.node AS node FROM (SELECT file, root, unnest(props) AS p FROM t) t
  UNION ALL SELECT x.file, x.root, x.path || CASE WHEN x.n.name = '[]' THEN '[]' ELSE '.' || x.n.name END, x.depth + 1, CASE WHEN x.n.name = '[]' THEN 'item' ELSE x.n.name END, x.n.required, x.n.node FROM (
   SELECT f.file, f.root, f.path, f.depth, unnest(CASE coalesce(s.type, f.node->>'$.type') WHEN 'object' THEN coalesce(s.props, list_transform(json_keys(f.node, '$.properties'), lambda k: {{'name': k, 'node': json_extract(f.node, '$.properties."' || k || '"'), 'required': coalesce(list_contains(CAST(json_extract(f.node, '$.required') AS VARCHAR[]), k), false)}}))
    WHEN 'array' THEN [{{'name': '[]', 'node': CASE WHEN s.file IS NULL THEN json_extract(f.node, '$.items') ELSE s.items END, 'required': true}}] ELSE [] END) AS n
   FROM f LEFT JOIN s ON s.file = f.file AND s.root = f.root AND s.start = f.node->>'$."$ref"' WHERE f.depth < 4) x)
 SELECT f.file, f.root, f.path, f.depth, f.name, CASE WHEN coalesce(s.type, CASE WHEN s.file IS NULL THEN f.node->>'$.type' END) IN {_KINDS} THEN coalesce(s.type, f.node->>'$.type') ELSE 'unknown' END AS type, f.required, CASE WHEN s.file IS NULL THEN f.node->>'$.description' ELSE s.description END AS description
 FROM f LEFT JOIN s ON s.file = f.file AND s.root = f.root AND s.start = f.node->>'$."$ref"'"""


@query(_SCHEMAS_SQL)
def resolved_schemas(spark, sf):
    """Fields of each component, as it stands there and as a reference to it has them."""
    parts = schemas.components(derived(spark, sf, SPECS), "file", "text")
    name = F.element_at(F.split("ref", "/"), -1)
    there = parts.select("file", name.alias("root"), "node")
    meant = parts.select("file", F.concat(F.lit("&"), name).alias("root"), F.parse_json(F.concat(F.lit('{"$ref": "'), "ref", F.lit('"}'))).alias("node"))
    return schemas.resolved_schemas(there.unionByName(meant), parts)


#: One model a supplier: such as can't come in, for each reason but size, and sound ones.
MODELS = """SELECT s_suppkey AS id, CASE s_suppkey % 11 WHEN 0 THEN '{"endpoints": [' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{"apim_version": "2.0", "endpoints": []}' WHEN 3 THEN '{"apim_version": "x.1", "endpoints": [{"uid": "u", "method": "GET"}]}'
 WHEN 4 THEN CASE WHEN s_suppkey < 20 THEN concat('{"endpoints": [', repeat('{"uid":"u","method":"GET","path":"/p"},', 10000), '{"uid":"u","method":"GET","path":"/p"}]}') ELSE '{"apim_version": "1", "endpoints": 7}' END
 WHEN 5 THEN concat('{"endpoints": [{"uid": "u", "method": "GET", "path": "/p", "summary": {"value": 1, "evidence": [', repeat('{},', 32), '{}]}}]}') WHEN 6 THEN concat('{"endpoints": [{"uid": "u", "method": "GET", "path": "/p", "responses": [{}, {"evidence": [', repeat('{},', 32), '{}]}]}]}') WHEN 7 THEN '{"apim_version": "1.9"}'
 ELSE concat('{"apim_version": "1.2", "endpoints": [{"uid": "default:GET:/a/{param}", "method": "get", "path": "/a', s_nationkey, '/{id}", "identity_evidence": [{"file": "f"}], "summary": {"value": "s", "evidence": [{"extraction_method": "ast_verified"}, {}]}, "tags": {"value": []}, "description": null, "auth": {"value": {}, "evidence": [', CASE WHEN s_suppkey % 2 = 0 THEN '{"extraction_method": "weak_inference"}' ELSE '' END,
  ']}, "path_params": [{"value": {}, "evidence": [{}]}, {"value": {}}], "responses": [{"value": {"status": 200}, "evidence": [{}, {}]}], "deprecated": {"value": true}}, {"uid": "x", "service": "s1", "method": "POST", "path": "b"}]}') END AS text FROM <supplier>""".replace("{", "{{").replace("}", "}}").replace("<", "{").replace(">", "}").replace("s_suppkey { 20", "s_suppkey < 20")
_MODELS = f"""mo AS ({duck(MODELS)}), ok AS (SELECT id, text, json_valid(text) AS valid, CASE WHEN json_valid(text) AND json_type(CAST(CASE WHEN json_valid(text) THEN text ELSE 'null' END AS JSON)) = 'OBJECT' THEN text ELSE '{{}}' END AS doc FROM mo),
 en AS (SELECT id, unnest(CAST(json_extract(doc, '$.endpoints') AS JSON[])) AS e FROM ok WHERE json_type(doc, '$.endpoints') = 'ARRAY'), fc AS (SELECT id, e->>'$.uid' AS uid, coalesce(e->>'$.service', 'default') AS service, e->>'$.method' AS method, e->>'$.path' AS path, 'identity' AS fact, json_extract(e, '$.identity_evidence') AS ev FROM en
  UNION ALL SELECT id, e->>'$.uid', coalesce(e->>'$.service', 'default'), e->>'$.method', e->>'$.path', f, json_extract(e, '$.' || f || '.evidence') FROM en, (SELECT unnest({apim.FACTS}) AS f) WHERE coalesce(json_type(e, '$.' || f), 'NULL') <> 'NULL'
  UNION ALL SELECT id, uid, service, method, path, f, json_extract(x, '$.evidence') FROM (SELECT id, e->>'$.uid' AS uid, coalesce(e->>'$.service', 'default') AS service, e->>'$.method' AS method, e->>'$.path' AS path, f, unnest(CAST(json_extract(e, '$.' || f) AS JSON[])) AS x FROM en, (SELECT unnest({apim.LISTS}) AS f) WHERE json_type(e, '$.' || f) = 'ARRAY')),
 fn AS (SELECT id, uid, service, method, path, fact, CASE WHEN json_type(ev) = 'ARRAY' THEN CAST(json_array_length(ev) AS INTEGER) ELSE 0 END AS n_evidence, list_transform(CASE WHEN json_type(ev) = 'ARRAY' THEN CAST(ev AS JSON[]) ELSE [] END, lambda x: coalesce(x->>'$.extraction_method', 'ai_inferred')) AS methods FROM fc),
 rj AS (SELECT * FROM (SELECT ok.id, 'V-01' AS rule, 'block' AS severity, CASE WHEN NOT valid THEN 'no JSON' WHEN try_cast(split_part(coalesce(doc->>'$.apim_version', '1'), '.', 1) AS INTEGER) <> 1 THEN 'version' WHEN json_type(CAST(text AS JSON)) <> 'OBJECT' OR coalesce(json_type(doc, '$.endpoints'), 'ARRAY') <> 'ARRAY' OR ok.id IN (SELECT id FROM en WHERE e->>'$.uid' IS NULL OR e->>'$.method' IS NULL OR e->>'$.path' IS NULL) THEN 'schema'
   WHEN (SELECT count(*) FROM en WHERE en.id = ok.id) > 10000 THEN 'endpoints' WHEN (SELECT max(n_evidence) FROM fn WHERE fn.id = ok.id) > 32 THEN 'evidence' END AS detail FROM ok) WHERE detail IS NOT NULL)"""


@query(f"WITH {_MODELS} SELECT * FROM rj")
def v01_ingest(spark, sf):
    return apim.rejected(derived(spark, sf, MODELS))


@query(f"WITH {_MODELS} SELECT id, uid, service, method, path, fact, n_evidence, array_to_string(methods, ',') AS methods FROM fn")
def model_facts(spark, sf):
    return apim.facts(derived(spark, sf, MODELS)).select("id", "uid", "service", "method", "path", "fact", "n_evidence", F.array_join("methods", ",").alias("methods"))


@query(
    f"""WITH {_MODELS}, kn AS (SELECT id, service || ':' || upper(method) || ':' || {norm_sql('path')} AS uid, fact, n_evidence, methods FROM fn WHERE id NOT IN (SELECT id FROM rj) AND fact NOT IN ('deprecated', 'path_params', 'query_params', 'headers', 'responses'))
    SELECT id, uid, 'V-03' AS rule, CASE fact WHEN 'identity' THEN 'reject' ELSE 'warn' END AS severity, fact AS detail FROM kn WHERE n_evidence = 0 UNION ALL SELECT id, uid, 'V-11', 'info', fact || ':' || m FROM (SELECT id, uid, fact, unnest(methods) AS m FROM kn WHERE fact <> 'identity') WHERE m NOT IN ('ai_inferred', 'weak_inference')"""
)
def parsed_fact_findings(spark, sf):
    return apim.fact_findings(derived(spark, sf, MODELS))
