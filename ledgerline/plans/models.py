"""Queries of citations, evidence, widened and narrowed models, accuracy and folders, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations as C, diff
from ..sources import folders
from .catalogue import query, table
from .verification import derived, norm_sql

_LINES = r"CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') END"
_SNIP = r"sha256(array_to_string(list_transform({x}, lambda x: regexp_replace(x, '\s+$', '')), chr(10)))"
_QUOTE = r"left(regexp_replace({x}, '^\s+|\s+$', '', 'g'), 200)"


def _files(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 11 <> 0").select(F.concat(F.lit("d/"), "doc_id").alias("file"), "text")


_SPANS = """SELECT doc_id, kind, CASE kind WHEN 1 THEN '../x' WHEN 5 THEN 'none/0' ELSE concat('d/', doc_id) END AS file, CASE kind WHEN 2 THEN 'x' WHEN 3 THEN '0' WHEN 7 THEN '2' ELSE '1' END AS line_start,
 CASE kind WHEN 4 THEN '500' WHEN 6 THEN '200' WHEN 7 THEN NULL ELSE '2' END AS line_end FROM (SELECT doc_id, {kinds} AS kind FROM {documents})"""


@query(
    f"""WITH s AS ({_SPANS.replace("{kinds}", "unnest([0, 1, 2, 3, 4, 5, 6, 7])").replace("{documents}", "documents")}), l AS (SELECT doc_id, {_LINES} AS lines FROM documents WHERE doc_id % 11 <> 0 AND text IS NOT NULL),
 j AS (SELECT s.doc_id, kind, lines, CASE kind WHEN 7 THEN 2 ELSE 1 END AS a, CASE kind WHEN 6 THEN 200 ELSE 2 END AS b FROM s LEFT JOIN l ON l.doc_id = s.doc_id AND kind <> 5),
 e AS (SELECT *, CASE WHEN kind = 2 THEN 'not integers' WHEN kind = 1 THEN 'outside of the root' WHEN kind = 3 THEN 'bad range' WHEN kind = 4 THEN 'too large' WHEN lines IS NULL THEN 'no file' WHEN b > len(lines) THEN 'past the end' END AS error FROM j)
 SELECT doc_id, kind, error, CASE WHEN error IS NULL THEN {_SNIP.format(x="list_slice(lines, a, b)")} END AS snippet_sha256, CASE WHEN error IS NULL THEN {_QUOTE.format(x="lines[a]")} END AS quote FROM e"""
)
def make_citations(spark, sf):
    spans = derived(spark, sf, _SPANS.replace("{kinds}", "explode(array(0, 1, 2, 3, 4, 5, 6, 7))"))
    return C.citations(spans, _files(spark, sf)).select("doc_id", "kind", "error", "snippet_sha256", "quote")


_ROUTES = """SELECT doc_id, concat('d/', doc_id) AS file, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'no such symbol' ELSE right(text, 9) END AS symbol, 'get' AS method, concat('/', source, '/', lang, '/:id/') AS path, doc_id % 5 = 0 AS from_spec,
 CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 4 = 1 END AS low_confidence, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN lang END AS description FROM {documents}"""


@query(
    f"""WITH r AS ({_ROUTES.replace("{documents}", "documents")}), l AS (SELECT doc_id, {_LINES} AS lines FROM documents WHERE doc_id % 11 <> 0 AND text IS NOT NULL), n AS (SELECT r.*, CASE WHEN len(coalesce(lines, [])) = 0 THEN [''] ELSE lines END AS lines FROM r LEFT JOIN l ON l.doc_id = r.doc_id),
 p AS (SELECT *, CASE WHEN coalesce(symbol, '') = '' THEN 1 ELSE greatest(coalesce(list_position(list_transform(lines, lambda x: contains(x, symbol)), true), 0), 1) END AS line FROM n) SELECT doc_id, CAST(line AS INTEGER) AS line, {_QUOTE.format(x="lines[line]")} AS quote, {_SNIP.format(x="[lines[line]]")} AS snippet_sha256 FROM p"""
)
def located_evidence(spark, sf):
    return C.located(derived(spark, sf, _ROUTES), _files(spark, sf)).select("doc_id", "line", "quote", "snippet_sha256")


@query(
    f"""WITH r AS (SELECT *, 'api:GET:' || {norm_sql('path')} AS uid FROM ({_ROUTES.replace("{documents}", "documents")})), f AS (SELECT *, unnest([{{'kind': 'path', 'name': 'id', 'confidence': 0.95::DOUBLE, 'there': true}}, {{'kind': 'query', 'name': 'q', 'confidence': 0.9, 'there': true}}, {{'kind': 'query', 'name': 'page', 'confidence': 0.9, 'there': true}},
 {{'kind': 'header', 'name': 'X-Id', 'confidence': 0.9, 'there': doc_id % 2 = 0}}, {{'kind': 'response', 'name': '200', 'confidence': 0.85, 'there': true}}, {{'kind': 'body', 'name': NULL, 'confidence': CASE WHEN low_confidence THEN 0.5 ELSE 0.9 END, 'there': low_confidence IS NOT NULL}}, {{'kind': 'auth', 'name': NULL, 'confidence': 0.9, 'there': true}},
 {{'kind': 'description', 'name': NULL, 'confidence': 0.6, 'there': coalesce(description, '') <> ''}}]) AS f FROM r) SELECT uid, f.kind AS kind, f.name AS name, CAST(f.confidence AS DOUBLE) AS confidence, CASE WHEN f.kind <> 'description' THEN CASE WHEN from_spec THEN 'openapi_verified' ELSE 'ast_verified' END END AS extraction_method, CASE WHEN f.kind <> 'description' THEN file END AS file FROM f WHERE f.there"""
)
def widened_model(spark, sf):
    header = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("X-Id"))).otherwise(F.array().cast("array<string>"))
    lists = {"path_params": F.array(F.lit("id")), "query_params": F.array(F.lit("q"), F.lit("page")), "headers": header, "statuses": F.array(F.lit("200"))}
    found = C.widened(derived(spark, sf, _ROUTES).withColumns(lists), _files(spark, sf), "api")
    return found.select("uid", "kind", "name", "confidence", "extraction_method", "file")


@query(
    """SELECT doc_id, 'POST' AS method, CASE WHEN doc_id % 3 = 0 THEN lang ELSE CASE WHEN doc_id % 3 = 1 THEN source END END AS docstring, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'f.py' ELSE 'f.py::' || source END AS code_ref,
 CASE WHEN doc_id % 4 <> 0 AND doc_id % 5 = 0 THEN 'openapi' ELSE 'code' END AS source, CASE WHEN doc_id % 6 <> 0 THEN doc_id % 100 < 75 END AS low_confidence FROM documents"""
)
def narrowed_model(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    found = lambda symbol, method: F.struct(F.lit("f.py").alias("file"), symbol.alias("symbol"), method.alias("extraction_method"))
    both = F.array(found(F.when(i % 4 == 1, F.lit("")).otherwise(F.col("source")), F.lit("ast_verified")), found(F.lit("g"), F.when(i % 5 == 0, "openapi_verified").otherwise("ast_verified")))
    ends = d.select("doc_id", F.lit("post").alias("method"), F.when(i % 3 == 0, F.col("lang")).alias("description"), F.when(i % 3 == 1, F.col("source")).alias("summary"), F.when(i % 6 != 0, (i % 100) / 100).alias("body_confidence"), F.filter(both, lambda e: i % 4 != 0).alias("evidence"))
    return C.narrowed(ends)


@query(
    """WITH e AS (SELECT doc_id, lang, list_distinct(string_split(text, ' ')) AS words, [source] AS origin FROM documents), j AS (SELECT e.*, a.doc_id AS there, a.lang AS a_lang, a.words AS a_words, a.origin AS a_origin FROM e LEFT JOIN e a ON a.doc_id - 1 = e.doc_id),
 s AS (SELECT count(*) AS n, count(*) FILTER (lang = a_lang) AS k, sum(len(list_intersect(words, a_words))) AS m1, sum(len(words)) AS e1, sum(len(a_words)) AS x1, sum(len(list_intersect(origin, a_origin))) AS m2, sum(len(origin)) AS e2, sum(len(a_origin)) AS x2 FROM j)
 SELECT 'lang' AS dim, k / n AS rate FROM s UNION ALL SELECT 'words', least(m1 / e1, m1 / x1) FROM s UNION ALL SELECT 'origin', least(m2 / e2, m2 / x2) FROM s"""
)
def field_accuracy(spark, sf):
    e = table(spark, sf, "documents").select("doc_id", "lang", F.split("text", " ").alias("words"), F.array("source").alias("origin"))
    return diff.field_accuracy(e, e.withColumn("doc_id", F.col("doc_id") - 1), "doc_id", "lang", ["words", "origin"])


_TREES = """SELECT p_partkey AS id, concat('{{"item": [{{"name": "A", "item": [{{"name": "one", "request": {{"method": "get", "url": "/a/', p_size, '/:x"}}}}, {{"name": "", "item": [{{"name": "B", "request": {{}}, "item": [{{"name": "two", "request": {{"method": "post", "url": {{"raw": "{{{{base_url}}}}/b?q=1"}}}}}}]}}]}}]}},
 {{"name": "three", "request": {{"method": "put", "url": "/c"}}}}, {{"name": "none"}}]', CASE WHEN p_partkey % 10 = 0 THEN '' ELSE '}}' END) AS text FROM {part}"""


@query(
    f"""SELECT p_partkey AS id, t.folder_path AS folder_path, t.place AS place, t.name AS name, CASE t.name WHEN 'one' THEN 'GET:/a/' || p_size || '/{{param}}' ELSE t.key END AS key
 FROM part, (VALUES ('A', '0,0', 'one', ''), ('A/B', '0,1,0,0', 'two', 'POST:/b'), ('', '1', 'three', 'PUT:/c')) t(folder_path, place, name, key) WHERE p_partkey % 10 <> 0"""
)
def folder_requests(spark, sf):
    return folders.requests(derived(spark, sf, _TREES, apart=True), "id", "text").select("id", "folder_path", F.array_join("ord", ",").alias("place"), "name", "key")


@query(
    """SELECT p_partkey AS root, t.module AS module, t.folder_path AS folder_path, t.name AS name FROM part, (VALUES ('', 'A', 'one'), ('', 'A/B', 'two'), ('', '', 'three'), ('m', 'm/A', 'one'), ('m', 'm/A/B', 'two'), ('m', 'm', 'three')) t(module, folder_path, name) WHERE p_partkey % 10 <> 0"""
)
def collection_fragments(spark, sf):
    t = derived(spark, sf, _TREES)
    whole = F.when(F.col("id") % 10 == 0, F.concat("text", F.lit("}"))).otherwise(F.col("text"))
    files = t.select(F.col("id").alias("root"), F.lit("").alias("module"), whole.alias("text")).unionByName(t.select(F.col("id").alias("root"), F.lit("m").alias("module"), "text"))
    return folders.fragments(files)[0].select("root", "module", "folder_path", "name")
