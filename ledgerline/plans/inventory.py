"""Queries of path algebra, filters, items, specifications, retrieval and plans, each with its DuckDB counterpart."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import canonical, routes as R
from ..operators import filters, graph, items, plan, retrieval, stores
from ..sources import mining, specs
from .catalogue import query, table
from .verification import derived, duck, endpoints, norm_sql

def part(spark, sf):
    return table(spark, sf, "part")


# ---- paths

_URLS = "SELECT page_id AS id, CASE WHEN page_id % 9 = 0 THEN '' ELSE 'get' END AS method, CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 7 = 1 THEN concat('{{{{base_url}}}}/p/:id/', page_id % 20, '?q=1') ELSE url END AS url FROM pages"
_BARE = r"regexp_replace(regexp_replace(replace(url, '{{base_url}}', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')"


@query(f"SELECT id, CASE WHEN method <> '' AND url <> '' THEN upper(method) || ':' || {norm_sql('bare')} END AS key FROM (SELECT id, method, url, CASE WHEN {_BARE} = '' THEN '/' ELSE {_BARE} END AS bare FROM ({_URLS.replace('{{{{', '{{').replace('}}}}', '}}')}))")
def item_key(spark, sf):
    p = table(spark, sf, "pages")
    i = F.col("page_id")
    url = F.when(i % 7 == 0, "").when(i % 7 == 1, F.concat(F.lit("{{base_url}}/p/:id/"), i % 20, F.lit("?q=1"))).otherwise(F.col("url"))
    return p.select(i.alias("id"), P.item_key(F.when(i % 9 == 0, "").otherwise("get"), url).alias("key"))


_META = "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN concat('get:', p_brand, '/:x/') WHEN p_partkey % 4 = 1 THEN 'post' WHEN p_partkey % 4 = 2 THEN concat('put:/a/<int:id>:', p_size) ELSE 'delete:' END AS raw FROM {part}"


@query(f"SELECT id, upper(trim(m)) || ':' || {norm_sql('p')} AS key FROM (SELECT id, CASE WHEN contains(raw, ':') THEN left(raw, instr(raw, ':') - 1) ELSE raw END AS m, CASE WHEN contains(raw, ':') AND substr(raw, instr(raw, ':') + 1) <> '' THEN substr(raw, instr(raw, ':') + 1) ELSE '/' END AS p FROM ({duck(_META)}))")
def metadata_key(spark, sf):
    return derived(spark, sf, _META).select("id", P.metadata_key(F.col("raw")).alias("key"))


_PREFIXED = "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN concat('v', p_size, '/') WHEN p_partkey % 4 = 2 THEN '/' ELSE concat(' /api/', lower(p_brand), ' ') END AS prefix, CASE WHEN p_size % 3 = 0 THEN '/' WHEN p_size % 3 = 1 THEN 'users/' ELSE '/items' END AS leaf FROM {part}"


@query(f"""SELECT id, CASE WHEN p = '' THEN CASE WHEN starts_with(leaf, '/') THEN leaf ELSE '/' || leaf END WHEN leaf IN ('', '/') THEN p ELSE p || CASE WHEN starts_with(leaf, '/') THEN leaf ELSE '/' || leaf END END AS path
 FROM (SELECT id, leaf, CASE WHEN length(q) > 1 AND right(q, 1) = '/' THEN left(q, length(q) - 1) ELSE q END AS p FROM (SELECT id, leaf, CASE WHEN trim(prefix) = '' OR starts_with(trim(prefix), '/') THEN trim(prefix) ELSE '/' || trim(prefix) END AS q FROM ({duck(_PREFIXED)})))""")
def compose_prefix(spark, sf):
    return derived(spark, sf, _PREFIXED).select("id", P.compose(F.col("prefix"), F.col("leaf")).alias("path"))


_VARIANTS = """SELECT p_partkey AS id, concat('/', lower(p_brand), '/') AS lit, ['/v1', concat('s', p_size % 3)] AS own, CASE WHEN p_partkey % 2 = 0 THEN ['api/'] ELSE []::VARCHAR[] END AS outr FROM part"""


def _join_sql(a: str, b: str) -> str:
    both = f"regexp_replace({a}, '/+$', '') || '/' || regexp_replace({b}, '^/+', '')"
    return f"CASE WHEN {a} = '' THEN {b} WHEN starts_with({both}, '/') THEN {both} ELSE '/' || {both} END"


@query(f"""SELECT id, array_to_string(list_sort(list(DISTINCT v)), ',') AS variants FROM (SELECT id, CASE WHEN regexp_replace(t, '/+$', '') = '' THEN '/' ELSE regexp_replace(t, '/+$', '') END AS v FROM (SELECT id, {_join_sql('o', 'm')} AS t FROM
 (SELECT id, o, {_join_sql('i', 'lit')} AS m FROM (SELECT id, lit, unnest(list_concat([''], own)) AS i, outr FROM ({_VARIANTS})), LATERAL (SELECT unnest(list_concat([''], outr)) AS o)))) GROUP BY id""")
def composed_variants(spark, sf):
    k = F.col("p_partkey")
    outer = F.when(k % 2 == 0, F.array(F.lit("api/"))).otherwise(F.array().cast("array<string>"))
    own = F.array(F.lit("/v1"), F.concat(F.lit("s"), F.col("p_size") % 3))
    return part(spark, sf).select(k.alias("id"), F.array_join(P.composed_variants(F.concat(F.lit("/"), F.lower("p_brand"), F.lit("/")), own, outer), ",").alias("variants"))


_REL = "SELECT p_partkey AS id, concat('src/m', p_size % 4) AS base, CASE WHEN p_partkey % 4 = 0 THEN './x.py' WHEN p_partkey % 4 = 1 THEN concat('../u', p_size, '.py') WHEN p_partkey % 4 = 2 THEN '../../../up.py' ELSE 'a//./b/../c.py' END AS path FROM {part}"


@query(f"SELECT id, CASE id % 4 WHEN 0 THEN base || '/x.py' WHEN 1 THEN 'src/u' || regexp_extract(path, '[0-9]+', 0) || '.py' WHEN 3 THEN base || '/a/c.py' END AS path FROM ({duck(_REL)})")
def relative_path(spark, sf):
    return derived(spark, sf, _REL).select("id", P.relative(F.col("base"), F.col("path")).alias("path"))


@query("SELECT c_custkey AS id, '/' || array_to_string(list_filter(['api', lower(c_mktsegment), '{id}', CASE WHEN c_custkey % 2 = 0 THEN 'end' ELSE '' END], lambda x: x <> ''), '/') AS path FROM customer")
def joined_url(spark, sf):
    parts = F.array(F.lit("/api/"), F.lower("c_mktsegment"), F.lit("<int:id>/"), F.when(F.col("c_custkey") % 2 == 0, "end").otherwise("/"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), P.joined_url(parts).alias("path"))


@query(
    """SELECT p_partkey AS id, 'Brand_' || p_size AS shown, trim(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN p_size % 3 = 0 THEN 'own' WHEN p_size % 3 = 1 THEN 'conf' ELSE '/' END AS folder,
    CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS major FROM part"""
)
def display_names(spark, sf):
    k = F.col("p_partkey")
    s = F.col("p_size")
    shown = F.regexp_replace(P.display_name(F.concat(F.lit("BRAND_"), s)), " ", "_")
    folder = P.folder_target(F.when(s % 3 == 0, "own").otherwise(""), F.when(s % 3 == 1, "conf").otherwise("/"))
    major = P.major(F.when(s % 4 == 0, "x.1").otherwise(F.concat(s, F.lit(".2.3"))))
    return part(spark, sf).select(k.alias("id"), shown.alias("shown"), P.slug(F.concat_ws(" ", "p_brand", "p_type")).alias("slug"), folder.alias("folder"), major.alias("major"))


@query(
    """SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN 'unknown' WHEN 3 THEN 'number' ELSE 'string' END AS python_type, CASE p_size % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'array' WHEN 2 THEN 'unknown' WHEN 3 THEN 'number' ELSE 'unknown' END AS script_type FROM part"""
)
def coarse_types(spark, sf):
    k = F.col("p_partkey")
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), F.col("p_size") % 5 + 1)
    return part(spark, sf).select(k.alias("id"), R.python_type(pick(" STR", "int", "long", "Decimal", "uuid")).alias("python_type"), R.script_type(pick("Date", "Foo[]", "int", "number", "any")).alias("script_type"))


@query("SELECT p_partkey AS id, '/*/' || lower(p_brand) || '/*/*' AS pattern, concat_ws('-', 'X', 'Brand', 'A' || p_size) AS header, p_size % 2 = 0 AS dated FROM part")
def wildcards_and_headers(spark, sf):
    k = F.col("p_partkey")
    s = F.col("p_size")
    path = F.concat(F.lit("/{a}/"), F.lower("p_brand"), F.lit("/:b/<int:c>"))
    dated = R.looks_like_date(F.when(s % 2 == 0, "2024-01-02").otherwise("HEAD~3"))
    return part(spark, sf).select(k.alias("id"), R.wildcard(path).alias("pattern"), R.header_name(F.concat(F.lit("x_BRAND_a"), s)).alias("header"), dated.alias("dated"))


# ---- filters


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'blog')")
def mentions_target(spark, sf):
    return filters.mentions(table(spark, sf, "pages").select("page_id", "url"), ["url"], " --Blog ")


_REFS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('src/m', p_size, '/v', p_partkey % 7, '.py::f', p_partkey) END AS ref FROM {part}"


#: Whole files, bare pieces of paths, and one that lies around references.
_CHANGED = "SELECT CASE WHEN n_nationkey % 3 = 0 THEN concat('SRC/m', n_nationkey, '/v3.py') WHEN n_nationkey % 3 = 1 THEN concat('m', n_nationkey, '/v', n_nationkey % 7) ELSE concat('old//src/m', n_nationkey, '/v1.py::f', n_nationkey * 7, '.bak') END AS file FROM {nation}"


@query(f"SELECT id FROM ({duck(_REFS)}) r WHERE EXISTS (SELECT 1 FROM (SELECT lower(replace(file, '//', '/')) AS f FROM ({duck(_CHANGED)})) WHERE contains(ref, f) OR (ref <> '' AND contains(f, ref)))")
def changed_file_routes(spark, sf):
    return filters.of_changed_files(derived(spark, sf, _REFS), "ref", derived(spark, sf, _CHANGED), "file").select("id")


@query(
    """WITH s AS (SELECT p_partkey AS id, p_brand AS file, p_partkey % 400 AS lo, p_partkey % 400 + p_size AS hi FROM part), y AS (SELECT p_type AS t, p_brand AS file, p_partkey * 7 % 3000 AS a, p_partkey * 7 % 3000 + 5 AS b FROM part), c AS (SELECT p_brand AS file, p_partkey * 13 % 2500 AS line FROM part)
    SELECT id, EXISTS (SELECT 1 FROM y WHERE y.file = s.file AND y.b >= s.lo AND y.a <= s.hi) OR EXISTS (SELECT 1 FROM c WHERE c.file = s.file AND c.line BETWEEN s.lo - 2 AND s.hi + 2) AS grounded FROM s"""
)
def grounded_spans(spark, sf):
    k = F.col("p_partkey")
    p = part(spark, sf)
    spans = p.select(k.alias("id"), F.col("p_brand").alias("file"), (k % 400).alias("lo"), (k % 400 + F.col("p_size")).alias("hi"))
    return filters.grounded_spans(spans, p.select(F.col("p_brand").alias("file"), (k * 7 % 3000).alias("s_lo"), (k * 7 % 3000 + 5).alias("s_hi")), p.select(F.col("p_brand").alias("file"), (k * 13 % 2500).alias("line"))).select("id", "grounded")


_CORPUS = "SELECT p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'get' ELSE 'POST' END AS method, concat('/', lower(p_brand), '/', CASE WHEN p_partkey % 2 = 0 THEN '{{x}}' ELSE concat('i', p_size) END) AS path FROM {part}"


@query(f"WITH r AS (SELECT p_partkey AS id, 'GET' AS m, '/' || lower(p_brand) || CASE WHEN p_size % 2 = 0 THEN '/:id' ELSE '/i' || (p_size + 3) END AS path FROM part) SELECT id FROM r WHERE EXISTS (SELECT 1 FROM ({duck(_CORPUS)}) c WHERE {norm_sql('c.path')} = {norm_sql('r.path')} AND upper(c.method) IN ('', 'GET'))")
def corroborated_routes(spark, sf):
    k = F.col("p_partkey")
    path = F.concat(F.lit("/"), F.lower("p_brand"), F.when(F.col("p_size") % 2 == 0, "/:id").otherwise(F.concat(F.lit("/i"), F.col("p_size") + 3)))
    return filters.corroborated(part(spark, sf).select(k.alias("id"), F.lit("get").alias("method"), path.alias("path")), derived(spark, sf, _CORPUS)).select("id")


@query(
    """SELECT key, reasons FROM (SELECT p_partkey AS key, array_to_string(list_concat(list_concat(CASE WHEN p_size % 5 = 0 THEN ['identity citation does not match code'] ELSE [] END, CASE WHEN p_size % 4 = 0 THEN ['auth citation failed'] ELSE [] END), CASE WHEN p_partkey % 7 = 0 THEN ['duplicate endpoint definition'] ELSE [] END), '; ') AS reasons FROM part)
    WHERE reasons <> '' AND key % 11 <> 0"""
)
def write_exclusions(spark, sf):
    k = F.col("p_partkey")
    p, s = part(spark, sf), F.col("p_size")
    verified = p.select(k.alias("key"), F.when(s % 5 == 0, "fabricated").otherwise("verified").alias("status"), F.when(s % 4 == 0, F.array(F.lit("auth citation failed"))).alias("failures"))
    return filters.exclusions(verified, p.where("p_partkey % 7 = 0").select(k.alias("key")), p.where("p_partkey % 11 = 0").select(k.alias("key")))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN 'no name' WHEN p_size % 4 = 0 AND p_size % 6 = 0 THEN 'folder with a request' WHEN p_size % 4 <> 0 AND p_size % 6 <> 0 THEN 'neither folder nor request' WHEN p_size % 6 = 0 AND p_size % 5 = 0 THEN 'no method' END AS error FROM part WHERE error IS NOT NULL")
def broken_items(spark, sf):
    k = F.col("p_partkey")
    s = F.col("p_size")
    return filters.broken_items(part(spark, sf).select(k.alias("id"), F.when(s % 9 == 0, "").otherwise(F.col("p_name")).alias("name"), (s % 4 == 0).alias("is_folder"), (s % 6 == 0).alias("has_request"), F.when(s % 5 == 0, "").otherwise("GET").alias("method")))


@query("SELECT DISTINCT s_nationkey + 5 AS k FROM supplier WHERE s_nationkey + 5 NOT IN (SELECT n_nationkey FROM nation)")
def unknown_approvals(spark, sf):
    return filters.unknown(table(spark, sf, "supplier").select((F.col("s_nationkey") + 5).alias("k")), table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), "k")


# ---- items


def _example_sql() -> str:
    out = []
    for words, value in items.NAME_RULES:
        hit = " OR ".join(f"contains(lower(name), '{w}')" for w in words)
        out.append(f"WHEN ({hit})" + ("" if isinstance(value, (int, float)) else " AND kind NOT IN ('integer', 'number')") + f" THEN '{json.dumps(value)}'")
    return "CASE " + " ".join(out) + " WHEN kind = 'string' THEN '\"string\"' WHEN kind = 'integer' THEN '1' WHEN kind = 'number' THEN '1.0' WHEN kind = 'boolean' THEN 'true' WHEN kind = 'array' THEN '[]' WHEN kind = 'object' THEN '{}' ELSE '\"value\"' END"


_FIELDS = """SELECT p_partkey AS id, CASE WHEN p_size % 8 = 0 THEN 'page_total' WHEN p_size % 8 = 1 THEN 'Email' WHEN p_size % 8 = 2 THEN 'is_paid' WHEN p_size % 8 = 3 THEN 'image' WHEN p_size % 8 = 4 THEN 'first_name' WHEN p_size % 8 = 5 THEN 'created_at' WHEN p_size % 8 = 6 THEN lower(p_brand) ELSE 'zip' END AS name,
 CASE WHEN p_partkey % 6 = 0 THEN 'integer' WHEN p_partkey % 6 = 1 THEN 'number' WHEN p_partkey % 6 = 2 THEN 'string' WHEN p_partkey % 6 = 3 THEN 'boolean' WHEN p_partkey % 6 = 4 THEN 'array' ELSE 'odd' END AS kind, p_partkey % 2 = 0 AS required FROM {part}"""


@query(f"SELECT id, {_example_sql()} AS example FROM ({duck(_FIELDS)})")
def example_lookup(spark, sf):
    return derived(spark, sf, _FIELDS).select("id", items.example(F.col("name"), F.col("kind")).alias("example"))


_ITEMS_SQL = f"""f AS (SELECT id, name, kind, required, {_example_sql()} AS ex FROM ({duck(_FIELDS)})), i AS (SELECT f.*, p.p_brand AS brand, p.p_size AS size FROM f JOIN part p ON p.p_partkey = f.id)
 SELECT id, CASE WHEN size % 2 = 0 THEN 'POST' ELSE 'GET' END || ' /x/{{' || name || '}}/' || brand AS name, '{{{{base_url}}}}/x/{{' || name || '}}/' || brand AS raw, 'x/:' || name || '/' || brand AS path, CASE WHEN size % 3 = 0 THEN name || '=' || ex || ':' || CASE WHEN required THEN 'false' ELSE 'true' END ELSE '' END AS query,
  name || '=' || ex AS variable, CASE WHEN size % 2 = 0 THEN 'Content-Type' ELSE '' END AS header, CASE WHEN size % 2 = 0 THEN '{{"' || name || '": ' || ex || '}}' END AS body FROM i"""


@query("WITH " + _ITEMS_SQL)
def request_items(spark, sf):
    k = F.col("p_partkey")
    param = F.array(F.struct("name", F.col("kind").alias("type"), "required"))
    none = F.filter(param, lambda x: F.lit(False))
    s = F.col("p_size")
    rows = derived(spark, sf, _FIELDS).join(part(spark, sf).select(k.alias("id"), "p_brand", "p_size"), "id")
    built = items.request_items(rows.select("id", F.when(s % 2 == 0, "post").otherwise("get").alias("method"), F.concat(F.lit("/x/{"), "name", F.lit("}/"), "p_brand").alias("path"), F.when(s % 3 == 0, param).otherwise(none).alias("query_params"), param.alias("path_params"), none.alias("headers"), F.when(s % 2 == 0, param).otherwise(none).alias("fields")))
    r = F.from_json("request", "struct<method:string,url:struct<raw:string,host:array<string>,path:array<string>,query:array<struct<key:string,value:string,disabled:boolean>>,variable:array<struct<key:string,value:string>>>,header:array<struct<key:string>>,body:struct<raw:string>>")
    flat = lambda c, f: F.array_join(F.transform(F.coalesce(c, F.array()), f), ",")
    b = built.withColumn("r", r)
    return b.select("id", "name", F.col("r.url.raw").alias("raw"), F.array_join("r.url.path", "/").alias("path"), flat(F.col("r.url.query"), lambda q: F.concat(q["key"], F.lit("="), q["value"], F.lit(":"), q["disabled"].cast("string"))).alias("query"),
                    flat(F.col("r.url.variable"), lambda q: F.concat(q["key"], F.lit("="), q["value"])).alias("variable"), flat(F.col("r.header"), lambda q: q["key"]).alias("header"), F.col("r.body.raw").alias("body"))


@query(
    """SELECT l_orderkey, CASE WHEN min(CASE WHEN l_linenumber IN (2, 3) THEN 200 + l_linenumber END) IS NOT NULL THEN min(CASE WHEN l_linenumber IN (2, 3) THEN 200 + l_linenumber END) ELSE 201 END AS status,
    CASE WHEN count_if(l_quantity > 25) > 0 THEN count_if(l_quantity > 25) ELSE count(*) END AS n_checks FROM lineitem GROUP BY l_orderkey"""
)
def test_scripts(spark, sf):
    status = F.when(F.col("l_linenumber").isin(2, 3), 200 + F.col("l_linenumber")).otherwise(400 + F.col("l_linenumber"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(status)).alias("st"), F.collect_list(F.struct(F.concat(F.lit("f"), "l_linenumber").alias("name"), (F.col("l_quantity") > 25).alias("required"))).alias("fields"))
    script = items.test_script(F.lit("POST"), F.col("st"), F.col("fields"))
    return rows.select("l_orderkey", F.regexp_extract(script, r"eq\((\d+)\)", 1).cast("int").alias("status"), F.size(F.regexp_extract_all(script, F.lit(r"data\)\.has"), 0)).cast("long").alias("n_checks"))


#: Items as built from routes, and as they are live, some under other keys.
BUILT = """SELECT p_partkey AS key, 'POST' AS method, p_brand AS url, CAST(NULL AS STRING) AS variable, CASE WHEN p_size % 4 <> 1 THEN concat('[{{"key":"h', p_size % 3, '"}}]') END AS header, CASE WHEN p_size % 3 = 0 THEN concat('{{"t":"', p_type, '"}}') END AS body, CASE WHEN p_size % 9 = 0 THEN '{{"type":"bearer"}}' END AS auth,
 'made' AS description, '["t"]' AS event, '[200]' AS response, p_name AS name FROM {part}"""
LIVE = """SELECT CASE WHEN p_partkey % 10 = 0 THEN -p_partkey ELSE p_partkey END AS key, CASE WHEN p_size % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN p_size % 4 = 0 THEN 'old' ELSE p_brand END AS url, '[v]' AS variable, CASE WHEN p_size % 7 < 5 THEN '[{{"key":"h1"}}]' END AS header, CASE WHEN p_size % 5 <> 0 THEN concat('{{"t":"', p_type, '"}}') END AS body, CASE WHEN p_size % 2 = 0 THEN '{{"type":"bearer"}}' END AS auth,
 CASE WHEN p_size % 7 = 0 THEN '' ELSE 'kept' END AS description, CASE WHEN p_size % 6 = 0 THEN '[]' ELSE '["own"]' END AS event, CASE WHEN p_size % 11 = 0 THEN '[]' ELSE '[201]' END AS response, CASE WHEN p_size % 8 = 0 THEN '' ELSE 'live' END AS name FROM {part}"""
_LIVE_SQL = f"b AS ({duck(BUILT)}), v AS ({duck(LIVE)})"


def item_sides(spark, sf):
    return derived(spark, sf, LIVE), derived(spark, sf, BUILT)


@query(
    f"""WITH {_LIVE_SQL} SELECT coalesce(b.key, v.key) AS key, coalesce(b.method, v.method) AS method, coalesce(b.url, v.url) AS url, v.variable, coalesce(b.header, v.header) AS header, CASE WHEN b.key IS NOT NULL THEN b.body ELSE v.body END AS body, CASE WHEN b.key IS NOT NULL THEN b.auth ELSE v.auth END AS auth,
    coalesce(nullif(v.description, ''), b.description) AS description, coalesce(nullif(v.event, '[]'), b.event) AS event, coalesce(nullif(v.response, '[]'), b.response) AS response, coalesce(nullif(v.name, ''), b.name) AS name FROM b FULL JOIN v ON b.key = v.key"""
)
def merged_items(spark, sf):
    return items.merged_items(*item_sides(spark, sf))


@query(
    f"""WITH {_LIVE_SQL} SELECT b.key, array_to_string(list_filter([CASE WHEN b.method <> v.method THEN 'method' END, CASE WHEN b.url <> v.url THEN 'url' END, CASE WHEN b.body IS DISTINCT FROM v.body THEN 'body' END, CASE WHEN b.auth IS DISTINCT FROM v.auth THEN 'auth' END, CASE WHEN b.header IS NOT NULL AND b.header IS DISTINCT FROM v.header THEN 'header' END], lambda x: x IS NOT NULL), ',') AS lines,
    array_to_string(list_filter([CASE WHEN v.description <> '' THEN 'description' END, CASE WHEN v.event <> '[]' THEN 'event' END, CASE WHEN v.response <> '[]' THEN 'response' END], lambda x: x IS NOT NULL), ',') AS preserved FROM b JOIN v ON b.key = v.key"""
)
def change_lines(spark, sf):
    return items.change_lines(*item_sides(spark, sf)).select("key", F.array_join("lines", ",").alias("lines"), F.array_join("preserved", ",").alias("preserved"))


#: Several routes of a key, each line item one of its order's.
ROUTES = """SELECT l_orderkey AS key, l_linenumber AS ord, CASE WHEN l_linenumber % 2 = 0 THEN 'PUT' ELSE 'POST' END AS method, concat('u', l_suppkey % 3) AS url, CASE WHEN l_linenumber % 3 = 0 THEN concat('[v', l_linenumber, ']') END AS variable, CASE WHEN l_suppkey % 4 = 0 THEN '[{{"key":"a"}},{{"key":"b"}}]' WHEN l_suppkey % 4 = 1 THEN '[{{"key":"b"}},{{"key":"a"}}]' END AS header,
 CASE WHEN l_suppkey % 5 < 2 THEN '{{"x":1,"y":2}}' WHEN l_suppkey % 5 = 2 THEN '{{"y":2,"x":1}}' END AS body, CASE WHEN l_suppkey % 7 = 0 THEN 'bearer' END AS auth, CASE WHEN l_linenumber > 1 THEN concat('d', l_linenumber) ELSE '' END AS description, CASE WHEN l_linenumber = 2 THEN '["t"]' ELSE '[]' END AS event, CAST(NULL AS STRING) AS response, concat('n', l_linenumber) AS name FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS l_linenumber FROM {lineitem})"""
#: Every third order is a live item.
HELD = """SELECT o_orderkey AS key, 'POST' AS method, concat('u', o_custkey % 3) AS url, '[own]' AS variable, '[{{"key":"a"}},{{"key":"b"}}]' AS header, '{{"x":1,"y":2}}' AS body, CAST(NULL AS STRING) AS auth, CASE WHEN o_custkey % 2 = 0 THEN 'mine' ELSE '' END AS description, '["own"]' AS event, '[200]' AS response, CASE WHEN o_custkey % 3 = 0 THEN 'live' ELSE '' END AS name FROM {orders} WHERE o_orderkey % 3 = 0"""
_FOLD = f"""r AS ({duck(ROUTES)}), h AS ({duck(HELD)}), x AS (SELECT r.*, true AS route FROM r UNION ALL SELECT key, -1, method, url, variable, header, body, auth, description, event, response, name, false FROM h),
 st AS (SELECT key, ord, route, method, url, last_value(variable IGNORE NULLS) OVER w AS variable, last_value(header IGNORE NULLS) OVER w AS header, body, auth, first_value(nullif(description, '') IGNORE NULLS) OVER w AS description, first_value(nullif(event, '[]') IGNORE NULLS) OVER w AS event, first_value(response IGNORE NULLS) OVER w AS response, first_value(nullif(name, '') IGNORE NULLS) OVER w AS name FROM x WINDOW w AS (PARTITION BY key ORDER BY ord)),
 cn AS (SELECT *, concat_ws('~', method, url, coalesce(variable, '-'), coalesce(replace(header, '[{{"key":"b"}},{{"key":"a"}}]', '[{{"key":"a"}},{{"key":"b"}}]'), '-'), coalesce(replace(body, '{{"y":2,"x":1}}', '{{"x":1,"y":2}}'), '-'), coalesce(auth, '-'), coalesce(description, '-'), coalesce(event, '-'), coalesce(response, '-'), coalesce(name, '-')) AS c FROM st),
 ch AS (SELECT *, CASE WHEN lag(c) OVER (PARTITION BY key ORDER BY ord) IS NULL THEN 'new' WHEN lag(c) OVER (PARTITION BY key ORDER BY ord) = c THEN 'unchanged' ELSE 'modified' END AS change FROM cn)"""


@query(f"WITH {_FOLD} SELECT key, ord, change, method, url, variable, header, body, auth, description, event, response, name FROM ch WHERE route")
def applied_routes(spark, sf):
    return items.applied(derived(spark, sf, HELD), derived(spark, sf, ROUTES)).withColumn("ord", F.col("ord").cast("int"))


@query(f"WITH {_FOLD}, fin AS (SELECT key FROM ch WHERE route GROUP BY key) SELECT key, 'unchanged' AS change FROM fin")
def reapplied_changes(spark, sf):
    """The last route of each key, applied once more to what all of them left, changes nothing."""
    routes = derived(spark, sf, ROUTES)
    done = items.applied(derived(spark, sf, HELD), routes)
    last = done.groupBy("key").agg(F.max_by(F.struct(*items.PARTS), "ord").alias("i")).select("key", "i.*")
    again = routes.groupBy("key").agg(F.max_by(F.struct(*items.PARTS), "ord").alias("i")).select("key", F.lit(1).alias("ord"), "i.*")
    return items.applied(last, again).select("key", "change")


@query(
    """WITH r AS (SELECT l_orderkey AS id, list({'status': 198 + l_linenumber * 2, 'description': CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, 'n': CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END} ORDER BY l_linenumber) AS rs, bool_or(l_linenumber = 5) AS auth FROM lineitem GROUP BY 1),
    e AS (SELECT unnest([400, 401, 403, 404, 422, 500]) AS code, unnest(['Bad Request', 'Unauthorized', 'Forbidden', 'Not Found', 'Unprocessable Entity', 'Internal Server Error']) AS name),
    d AS (SELECT id, u.status AS code, u.description AS description, u.n AS n FROM (SELECT id, unnest(rs) AS u FROM r)),
    a AS (SELECT id, CAST(code AS INTEGER) AS code, coalesce(description, CAST(code AS VARCHAR)) AS status, n FROM d UNION ALL SELECT id, CAST(e.code AS INTEGER), e.name, 0 FROM r, e WHERE e.code NOT IN (401, 403) OR auth)
    SELECT id, code, code || ' ' || status AS name, status, CASE WHEN n = 1 THEN '{"id": 1}' WHEN code BETWEEN 200 AND 299 THEN '{}' ELSE '{"detail": "' || status || '"}' END AS body FROM a"""
)
def saved_responses(spark, sf):
    n = F.col("l_linenumber")
    fields = F.when(n == 3, F.array(F.struct(F.lit("id").alias("name"), F.lit("integer").alias("type")))).otherwise(F.array().cast("array<struct<name:string,type:string>>"))
    found = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(n, F.struct((198 + n * 2).alias("status"), F.when(n % 2 == 0, F.col("l_returnflag")).alias("description"), fields.alias("fields")).alias("r")))), lambda x: x["r"]).alias("responses"), F.bool_or(n == 5).alias("auth"))
    return items.saved_responses(found.withColumn("method", F.lit("get")), "full").drop("n")


@query("SELECT DISTINCT array_to_string(list_slice(p, 1, i), '/') AS folder, CAST(i AS INTEGER) AS depth FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT DISTINCT [lower(p_brand), 's' || (p_size % 5), p_type] AS p FROM part))")
def folder_paths(spark, sf):
    path = F.concat(F.lit("/"), F.lower("p_brand"), F.lit("//s"), F.col("p_size") % 5, F.lit("/"), "p_type")
    return items.folders(part(spark, sf).select(path.alias("path")), "path")


@query(
    """SELECT p_partkey AS id, '{"h":[{"key":"a","v":' || p_size || '},{"key":"b","n":1,"v":' || CASE WHEN p_size % 2 = 0 THEN '9' ELSE '2' END || '}' || CASE WHEN p_size % 2 = 0 THEN ',{"name":"c"},4' ELSE '' END || '],"o":{"x":' || CASE WHEN p_size % 2 = 0 THEN '[]' ELSE '1' END || ',"y":2}}' AS doc FROM part"""
)
def deep_overrides(spark, sf):
    k = F.col("p_partkey")
    base = F.concat(F.lit('{"o":{"x":1,"y":2},"h":[{"key":"a","v":'), "p_size", F.lit('},{"key":"b","v":2,"n":1}]}'))
    return part(spark, sf).select(k.alias("id"), items.deep_patch(base, F.when(F.col("p_size") % 2 == 0, '{"o":{"x":[]},"h":[{"key":"b","v":9},{"name":"c"},4]}')).alias("doc"))


@query("SELECT p_partkey AS id, p_size % 3 <> 2 AS same FROM part")
def canonical_equality(spark, sf):
    """Stored items that differ in ids, header order, blanks in a JSON body and empty lists only are the same; another header or description is not."""
    k = F.col("p_partkey")
    a = F.concat(F.lit('{"id":"1","header":[{"key":"a"},{"key":"b"}],"body":{"raw":"{\\"k\\": '), "p_partkey", F.lit('}"},"event":[],"description":""}'))
    b = F.concat(F.lit('{"_postman_id":"9","body":{"raw":" {\\"k\\":'), "p_partkey", F.lit('} "},"header":[{"key":"b"},"x",{"key":"a"}'), F.when(F.col("p_size") % 3 == 2, ',{"key":"c"}').otherwise(""), F.lit("]}"))
    return table(spark, sf, "part", apart=True).select(k.alias("id"), (canonical.canonical_json(a) == canonical.canonical_json(b)).alias("same"))


# ---- sources

_CODE = """SELECT p_partkey AS file, concat('import x', chr(10), CASE WHEN p_size % 6 = 0 THEN '@app.get("/a/{{id}}")' WHEN p_size % 6 = 1 THEN '  @PostMapping(value = "/b")' WHEN p_size % 6 = 2 THEN 'path("users/", view)' WHEN p_size % 6 = 3 THEN 'x = get_user("/no")' WHEN p_size % 6 = 4 THEN '@RequestMapping("/r")' ELSE 'put ("c")' END, chr(10), 'post("/', lower(p_type), '")') AS text FROM {part}"""


@query(f"""WITH c AS ({duck(_CODE)}), l AS (SELECT file, p_size, p_type FROM c JOIN part ON p_partkey = file)
 SELECT file, 2 AS line, CASE p_size % 6 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 5 THEN 'PUT' ELSE '' END AS method, CASE p_size % 6 WHEN 0 THEN '/a/{{id}}' WHEN 1 THEN '/b' WHEN 2 THEN '/users/' WHEN 4 THEN '/r' ELSE '/c' END AS path FROM l WHERE p_size % 6 <> 3
 UNION ALL SELECT file, 3, 'POST', '/' || lower(p_type) FROM l WHERE regexp_full_match(lower(p_type), '[a-z0-9_{{}}<>:./-]*')""".replace("{{", "{").replace("}}", "}"))
def candidate_mining(spark, sf):
    return mining.candidate_lines(derived(spark, sf, _CODE), "file", "text").select("file", "line", "method", "path")


_TESTS = """SELECT p_partkey AS file, concat('client.get(', chr(10), '  "/u/', p_size, '?q=1")', chr(10), 'x', chr(10), 'y = "/"', chr(10), 'check("/plain/', lower(p_brand), '")', chr(10), CASE WHEN p_size % 2 = 0 THEN 'await Post("/a") + "/b"' ELSE 'none' END) AS text FROM {part}"""


@query("""SELECT p_partkey AS file, 2 AS line, 'GET' AS method, '/u/' || p_size AS path FROM part UNION ALL SELECT p_partkey, 6, 'POST', unnest(['/a', '/b']) FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 5, '', '/plain/' || lower(p_brand) FROM part WHERE NOT contains(p_brand, '#')""")
def test_urls(spark, sf):
    return specs.test_urls(derived(spark, sf, _TESTS), "file", "text")


_SPEC = """SELECT p_partkey AS file, CASE WHEN p_partkey % 9 = 0 THEN 'not json' ELSE concat('{{"openapi":"3.0","components":{{"schemas":{{"Pet":{{"properties":{{"name":{{}},"age":{{}}}}}}}}', CASE WHEN p_size % 2 = 0 THEN ',"securitySchemes":{{"k":{{}}}}' ELSE '' END,
 '}},"paths":{{"/p', p_size, '/{{id}}":{{"parameters":[{{"name":"id","in":"path"}}],"get":{{"operationId":"g', p_partkey, '","parameters":[{{"name":"q"}}],"responses":{{"200":{{}},"default":{{}}}}}},"post":{{"security":[{{"k":[]}}],"requestBody":{{"content":{{"application/json":{{"schema":{{"$ref":"#/components/schemas/', CASE WHEN p_size % 3 = 0 THEN 'Gone' ELSE 'Pet' END, '"}}}}}}}},"responses":{{"404":{{}},"201":{{}}}}}},"x-note":{{}}}}}}}}') END AS text FROM {part}"""


@query("""SELECT p_partkey AS file, 'GET' AS method, '/p' || p_size || '/{id}' AS path, 'g' || p_partkey AS operation_id, 'id,q' AS params, '' AS body_fields, '200' AS statuses, false AS auth FROM part WHERE p_partkey % 9 <> 0
 UNION ALL SELECT p_partkey, 'POST', '/p' || p_size || '/{id}', NULL, 'id', CASE WHEN p_size % 3 = 0 THEN '' ELSE 'age,name' END, '201,404', p_size % 2 = 0 FROM part WHERE p_partkey % 9 <> 0""")
def spec_operations(spark, sf):
    found = specs.spec_operations(derived(spark, sf, _SPEC), "file", "text")
    return found.select("file", "method", "path", "operation_id", F.array_join("params", ",").alias("params"), F.array_join("body_fields", ",").alias("body_fields"), F.array_join(F.col("statuses").cast("array<string>"), ",").alias("statuses"), "auth")


@query("SELECT p_partkey AS file, CASE WHEN p_size % 3 = 0 THEN 'Gone' ELSE 'Pet' END AS name FROM part WHERE p_partkey % 9 <> 0")
def schema_refs(spark, sf):
    return specs.schema_refs(derived(spark, sf, _SPEC), "file", "text")


@query("SELECT p_partkey AS file, unnest(['/a' || p_size, '/b/{id}']) AS path FROM part WHERE p_size % 4 <> 0")
def yaml_paths(spark, sf):
    k = F.col("p_partkey")
    text = F.concat(F.when(F.col("p_size") % 4 == 0, "title: x\n").otherwise("openapi: 3.0\n"), F.lit("paths:\n  /a"), "p_size", F.lit(":\n    get:\n  /b/{id}:\n      /deep: x\n"))
    return specs.yaml_paths(part(spark, sf).select(k.alias("file"), text.alias("text")), "file", "text")


_TREE = """SELECT concat('svc', p_size % 5, '/', CASE WHEN p_partkey % 50 = 0 THEN 'package.json' WHEN p_partkey % 50 = 1 THEN 'pyproject.toml' WHEN p_partkey % 50 = 2 THEN 'sub/go.mod' WHEN p_partkey % 50 = 3 THEN 'sub/deep/pom.xml' WHEN p_partkey % 50 < 20 THEN concat('sub/f', p_partkey, '.py') ELSE concat('g', p_partkey, '.js') END) AS path FROM {part} UNION SELECT concat('top', n_nationkey, '.py') FROM {nation}"""


@query(
    f"""WITH f AS (SELECT DISTINCT path FROM ({duck(_TREE)})), m AS (SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS root, regexp_extract(path, '[^/]*$', 0) AS name FROM f WHERE len(string_split(path, '/')) <= 3),
    o(name, pri, language) AS (VALUES {', '.join(f"('{n}', {i}, '{v}')" for i, (n, v) in enumerate(specs.MANIFESTS.items()))}), u AS (SELECT root, arg_min(m.name, pri) AS manifest, arg_min(language, pri) AS language FROM m JOIN o ON o.name = m.name GROUP BY root UNION ALL SELECT '', '', ''),
    a AS (SELECT path, max_by(root, length(root)) AS root FROM f JOIN u ON root = '' OR starts_with(path, root || '/') GROUP BY path) SELECT u.root, u.manifest, u.language, count(a.path) AS n_files FROM u LEFT JOIN a ON a.root = u.root GROUP BY ALL"""
)
def service_units(spark, sf):
    return specs.services(derived(spark, sf, _TREE).distinct(), "path")


@query("SELECT c_custkey AS path, unnest(['a' || c_custkey, 'b']) AS workspace FROM customer WHERE c_custkey % 3 < 2")
def package_workspaces(spark, sf):
    k = F.col("c_custkey")
    listed = F.concat(F.lit('["a'), k, F.lit('","b"]'))
    text = F.when(k % 3 == 0, F.concat(F.lit('{"workspaces":'), listed, F.lit("}"))).when(k % 3 == 1, F.concat(F.lit('{"workspaces":{"packages":'), listed, F.lit("}}"))).otherwise("{broken")
    return specs.workspaces(table(spark, sf, "customer").select(k.alias("path"), text.alias("text")), "path", "text")


@query(
    """WITH f AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'lib/' ELSE 'other/' END || 'm' || (p_size % 9) || CASE WHEN p_size % 2 = 0 THEN '/n.py' ELSE '/n/__init__.py' END AS path FROM part),
    i AS (SELECT p_partkey AS src, 'm' || (p_partkey % 12) || '.n' AS module FROM part), c AS (SELECT src, module, pri, root || replace(module, '.', '/') || tail AS path FROM i, (SELECT r.i * 2 + t.i AS pri, root, tail FROM (VALUES (0, ''), (1, 'src/'), (2, 'app/'), (3, 'lib/')) r(i, root), (VALUES (0, '.py'), (1, '/__init__.py')) t(i, tail)))
    SELECT src, module, arg_min(path, pri) AS dst FROM c JOIN f USING (path) GROUP BY src, module"""
)
def resolved_imports(spark, sf):
    k = F.col("p_partkey")
    s = F.col("p_size")
    files = part(spark, sf).select(F.concat(F.element_at(F.array(F.lit(""), F.lit("src/"), F.lit("lib/"), F.lit("other/")), s % 4 + 1), F.lit("m"), s % 9, F.when(s % 2 == 0, "/n.py").otherwise("/n/__init__.py")).alias("path"))
    return specs.resolved_imports(part(spark, sf).select(k.alias("src"), F.concat(F.lit("m"), k % 12, F.lit(".n")).alias("module")), files)


# ---- retrieval and plans


@query("SELECT ord, path FROM (SELECT ord, path FROM (" + duck(_CORPUS) + ") WHERE ends_with(path, '/i7') ORDER BY ord LIMIT 12)")
def witness_lines(spark, sf):
    return retrieval.witness_lines(derived(spark, sf, _CORPUS).select("ord", "path"), "/i7/")


@query("SELECT p_brand AS file, count(*) AS n FROM part WHERE p_size % 3 = 0 GROUP BY p_brand ORDER BY n DESC, min(p_partkey) LIMIT 40")
def busiest_files(spark, sf):
    k = F.col("p_partkey")
    return retrieval.busiest(part(spark, sf).select(k.alias("id"), F.col("p_brand").alias("file"), (F.col("p_size") % 3 == 0).alias("decorated")))


@query("SELECT c_custkey AS dst, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def importer_counts(spark, sf):
    return retrieval.importers(table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")), table(spark, sf, "customer").select(F.col("c_custkey").alias("file")))


@query(
    """WITH s AS (SELECT p_partkey AS id, p_brand AS file, 'fn' || (p_partkey % 1500) AS name, 'fn' || (p_partkey * 7 % 1500) AS c1, 'fn' || (p_size % 40) AS c2 FROM part), o AS (SELECT name, min(id) AS callee, min(file) AS f FROM s GROUP BY name HAVING count(*) = 1)
    SELECT DISTINCT s.id, o.callee FROM s JOIN o ON o.name IN (s.c1, s.c2) WHERE o.name <> s.name AND o.f <> s.file"""
)
def called_functions(spark, sf):
    k = F.col("p_partkey")
    text = F.concat(F.lit("x = fn"), k * 7 % 1500, F.lit("(1) + fn"), F.col("p_size") % 40, F.lit(" (2)"))
    return retrieval.called(part(spark, sf).select(k.alias("id"), F.col("p_brand").alias("file"), F.concat(F.lit("fn"), k % 1500).alias("name"), F.lit("function").alias("kind"), text.alias("text")))


@query(
    """WITH h AS (SELECT s_nationkey AS file, array_to_string(list_sort(list(DISTINCT '/own' || (s_suppkey % 3))), ',') AS own FROM supplier GROUP BY 1), o AS (SELECT (s_nationkey + 1) % 25 AS file, array_to_string(list_sort(list(DISTINCT '/own' || (s_suppkey % 3))), ',') AS outr FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1)
    SELECT coalesce(h.file, o.file) AS file, coalesce(own, '') AS own, coalesce(outr, '') AS outer_hints FROM h FULL JOIN o ON h.file = o.file"""
)
def prefix_hints(spark, sf):
    s = F.col("s_suppkey")
    lines = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("file"), F.concat(F.when(s % 2 == 0, "mount(users"), F.lit(', prefix = "/own'), s % 3, F.lit('")')).alias("t"), F.concat(F.lit('Router(prefix="/own'), s % 3, F.lit('")')).alias("u"))
    lines = lines.select("file", F.coalesce("t", "u").alias("text"))
    imports = table(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 1) % 25).alias("dst"), F.lit("users").alias("token"))
    return retrieval.prefix_hints(lines, imports).select("file", F.array_join("own", ",").alias("own"), F.array_join("outer", ",").alias("outer_hints"))


@query("SELECT round(avg(t), 6) AS tokens, count(*) AS targets FROM (SELECT conv_id, sum(greatest(1, length(text) // 4)) AS t FROM conversations GROUP BY conv_id)")
def average_tokens(spark, sf):
    return retrieval.average_tokens(table(spark, sf, "conversations"), "conv_id", R.estimate_tokens(F.coalesce("text", F.lit(""))))


@query(
    """SELECT p_partkey AS uid, CASE WHEN p_size % 9 = 0 THEN 'unknown' WHEN p_size % 5 IN (0, 1) THEN 'rejected' ELSE 'planned' END AS outcome, CASE WHEN p_size % 9 <> 0 AND p_size % 5 > 1 THEN CASE WHEN least(100 - p_size, 95) >= 90 THEN 'auto' WHEN least(100 - p_size, 95) >= 75 THEN 'flag' WHEN least(100 - p_size, 95) >= 50 THEN 'needs_approval' ELSE 'blocked' END END AS action,
    CASE WHEN p_size % 9 <> 0 AND p_size % 5 > 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'update' ELSE 'new' END END AS change FROM part"""
)
def plan_entries(spark, sf):
    k = F.col("p_partkey")
    p, s = part(spark, sf), F.col("p_size")
    verdicts = p.where("p_size % 9 <> 0").select(k.alias("uid"), F.when(s % 5 == 0, "reject").when(s % 5 == 1, "stale").otherwise("verified").alias("verdict"), (100 - s).alias("existence"), F.lit(95).alias("path"))
    scope = p.select(F.explode(F.array(k, -k)).alias("uid"))
    return plan.compile_entries(scope, p.select(k.alias("uid")), verdicts, p.where("p_partkey % 2 = 0").select(k.alias("uid")))


_HASH_TREE = """SELECT kind, CASE WHEN d = 0 THEN sha256(string_agg(v, '|' ORDER BY v)) ELSE (SELECT sha256(string_agg(w, '|' ORDER BY w)) FROM (SELECT left(i.h, t.d) || ':' || sha256(string_agg(i.v, '|' ORDER BY i.v)) AS w FROM t i WHERE i.kind = t.kind GROUP BY left(i.h, t.d))) END AS hash FROM t GROUP BY kind, d"""


@query(
    f"""WITH s AS (SELECT unnest(['planned', 'reversed', 'changed']) AS kind, o_orderkey, o_orderstatus FROM orders), r AS (SELECT kind, sha256(CASE WHEN kind = 'changed' AND o_orderkey = 7 THEN 'x' ELSE o_orderkey || '|' || o_orderstatus END) AS h FROM s),
    g AS (SELECT kind, h, h || ':' || count(*) AS v FROM r GROUP BY kind, h), t AS (SELECT *, greatest(0, CAST(ceil(ln((count(*) OVER (PARTITION BY kind)) / 1024.0) / ln(16)) AS INTEGER)) AS d FROM g), one AS ({_HASH_TREE}) SELECT kind, hash FROM one"""
)
def state_hashes(spark, sf):
    """The state's hash is the same in another order of rows, and another one after one change."""
    o = table(spark, sf, "orders").select(F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("c"))
    changed = o.withColumn("c", F.when(F.col("c").startswith("7|"), "x").otherwise(F.col("c")))
    out = [plan.state_hash(rows, "c").select(F.lit(kind).alias("kind"), "hash") for kind, rows in (("planned", o), ("reversed", o.orderBy(F.desc("c"))), ("changed", changed))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT 'base_url' AS name, false AS secret UNION ALL SELECT 'token', true UNION ALL SELECT DISTINCT p_type || '_key', true FROM part WHERE p_size % 2 = 0")
def inferred_variables(spark, sf):
    k = F.col("p_partkey")
    name = F.concat("p_type", F.when(F.col("p_size") % 2 == 0, "_key").otherwise("_x"))
    return plan.environment(part(spark, sf).select(name.alias("name"), k.alias("ord")), "name").select("name", "secret")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamped, strftime(ts, '%Y%m%dT%H%M%S%fZ') AS compact, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS full_stamp FROM events")
def time_stamps(spark, sf):
    return table(spark, sf, "events").select("event_id", plan.stamp(F.col("ts")).alias("stamped"), plan.compact_stamp(F.col("ts")).alias("compact"), plan.offset_stamp(F.col("ts")).alias("full_stamp"))


@query("SELECT event_id AS ord, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM (SELECT event_id, props FROM events ORDER BY event_id DESC LIMIT 30) WHERE event_id % 4 <> 0")
def trail_tail(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("ord"), F.when(F.col("event_id") % 4 == 0, "{broken").otherwise(F.col("props")).alias("line"))
    return stores.last_lines(e, "ord", "line", 30, "k long")


@query("SELECT user_id AS collection_id, event_id AS snapshot_id FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 15")
def newest_snapshots(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'view'").select(F.col("user_id").alias("collection_id"), F.col("event_id").alias("snapshot_id"), "props")
    return stores.newest_first(e, None, 15, "props")


@query(
    """WITH RECURSIVE n AS (SELECT p_partkey AS node, '/' || (p_partkey % 10) AS own, p_partkey <= 5 AS root, CASE WHEN p_partkey % 40 = 7 THEN NULL WHEN p_partkey > 5 THEN p_partkey // 2 END AS up FROM part),
    w AS (SELECT node, up, own AS path, root FROM n UNION ALL SELECT w.node, n.up, n.own || w.path, n.root FROM w JOIN n ON n.node = w.up WHERE NOT w.root)
    SELECT n.node, CASE WHEN bool_or(w.root) THEN max_by(w.path, length(w.path)) ELSE n.own END AS path, bool_or(w.root) AS resolved FROM n JOIN w ON w.node = n.node GROUP BY n.node, n.own"""
)
def first_mounts(spark, sf):
    k = F.col("p_partkey")
    own = F.concat(F.lit("/"), k % 10)
    nodes = part(spark, sf).select(k.alias("node"), own.alias("prefix"), (k <= 5).alias("is_root"))
    edges = part(spark, sf).where("p_partkey > 5 and p_partkey % 40 <> 7").select(F.expr("p_partkey div 2").alias("parent"), k.alias("child"), F.lit("").alias("prefix"), F.lit(1).alias("ord"))
    return graph.first_mounts(edges, nodes)
