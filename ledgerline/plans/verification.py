"""Queries of the verification pipeline over an inventory derived from part and nation, each with its DuckDB counterpart.

The inputs are derived by one SQL text that both engines run; the operators and the counterparts are written apart from each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import evidence, graph, verify
from .catalogue import query, table

#: Endpoints: uid as claimed, path with placeholders of all styles, every tenth of them wrong in one way or another.
ENDPOINTS = """SELECT p_partkey AS id, concat('s', p_size % 3) AS service, CASE WHEN p_partkey % 37 = 0 THEN 'FETCH' WHEN p_size % 4 = 0 THEN 'get' WHEN p_size % 4 = 1 THEN 'POST' WHEN p_size % 4 = 2 THEN 'PUT' ELSE 'DELETE' END AS method,
 concat(' /v', p_size % 2, '/', lower(p_brand), CASE WHEN p_partkey % 5 = 0 THEN '/{{id}}' WHEN p_partkey % 5 = 1 THEN '/:key/' WHEN p_partkey % 5 = 2 THEN concat('/item', p_partkey % 7) WHEN p_partkey % 5 = 3 THEN '/<int:id>/x/{{id}}' ELSE '/list' END) AS path,
 CASE WHEN p_partkey % 5 = 0 THEN 'id' WHEN p_partkey % 5 = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 'key,more' ELSE 'key' END WHEN p_partkey % 5 = 3 THEN CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE 'id' END ELSE '' END AS params,
 concat('src/', p_size % 9, '.py') AS file, CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE 1 + p_partkey % 3 END AS n_evidence, CASE WHEN p_partkey % 6 = 0 THEN 'summary,auth' WHEN p_partkey % 6 = 1 THEN 'tags' ELSE '' END AS facts, p_partkey % 8 = 0 AS has_body, p_partkey % 4 = 0 AS auth,
 p_partkey % 7 <> 0 AS clean, CASE WHEN p_partkey % 3 = 0 THEN 'x = @app.get( here' WHEN p_partkey % 3 = 1 THEN 'plain words' ELSE 'setGlobalPrefix(v)' END AS quote FROM {part}"""
#: What an independent reading of the code saw: every endpoint's route, some with another path, file or guard.
WITNESS = """SELECT p_partkey AS ord, concat('s', p_size % 3) AS service, CASE WHEN p_size % 4 = 0 THEN 'GET' WHEN p_size % 4 = 1 THEN 'POST' WHEN p_size % 4 = 2 THEN 'PUT' ELSE 'DELETE' END AS method,
 concat('/v', p_size % 2, '/', lower(p_brand), CASE WHEN p_partkey % 5 = 0 THEN '/{{id}}' WHEN p_partkey % 5 = 1 THEN concat('/k', p_partkey % 50) ELSE concat('/item', p_partkey % 11) END) AS path, concat('src/', p_size % 7, '.py') AS file, p_partkey % 8 = 0 AS auth FROM {part}"""


def derived(spark, sf: str, sql: str, apart: bool = False) -> DataFrame:
    names = [t for t in ("part", "nation", "supplier", "customer", "documents", "orders", "events", "lineitem") if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: table(spark, sf, t, apart) for t in names})


def duck(sql: str) -> str:
    return sql.format(part="part", nation="nation", supplier="supplier", customer="customer", documents="documents", orders="orders", events="events", lineitem="lineitem")


def norm_sql(x: str) -> str:
    """The normal form of a path, in DuckDB."""
    p = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    p = f"CASE WHEN starts_with({p}, '/') THEN {p} ELSE '/' || {p} END"
    p = rf"regexp_replace(regexp_replace(regexp_replace({p}, '<(?:[^<>:]+:)?([^<>]+)>', '{{\1}}', 'g'), ':([A-Za-z_][A-Za-z0-9_]*)', '{{\1}}', 'g'), '\{{[^}}]+\}}', '{{param}}', 'g')"
    return f"(CASE WHEN length({p}) > 1 AND right({p}, 1) = '/' THEN left({p}, length({p}) - 1) ELSE {p} END)"


_E = f"e0 AS ({duck(ENDPOINTS)}), e AS (SELECT *, service || ':' || upper(method) || ':' || {norm_sql('path')} AS own, service || ':' || method || ':' || {norm_sql('path')} AS uid FROM e0), o AS (SELECT * REPLACE (own AS uid) FROM e)"
_NAMED = r"list_concat(list_concat(regexp_extract_all(path, '\{([^{}:]+)', 1), regexp_extract_all(path, '[^A-Za-z0-9_]:([A-Za-z_][A-Za-z0-9_]*)', 1)), regexp_extract_all(path, '<(?:[^<>:]+:)?([^<>]+)>', 1))"
_EF = f"ef AS (SELECT *, {_NAMED} AS named, CASE WHEN params = '' THEN []::VARCHAR[] ELSE string_split(params, ',') END AS declared, CASE WHEN facts = '' THEN []::VARCHAR[] ELSE string_split(facts, ',') END AS unproven FROM e)"
_EF = f"{_EF}, eg AS (SELECT *, list_sort(list_distinct(list_filter(named, lambda x: NOT list_contains(declared, x)))) AS missing, list_sort(list_distinct(list_filter(declared, lambda x: NOT list_contains(named, x)))) AS extra, list_sort(list_distinct(list_filter(named, lambda x: len(list_filter(named, lambda y: y = x)) > 1))) AS twice FROM ef)"


def endpoints(spark, sf: str) -> DataFrame:
    e = derived(spark, sf, ENDPOINTS)
    listed = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    return e.withColumns({"uid": F.concat_ws(":", "service", "method", verify.R.normalize_path(F.col("path"))), "declared": listed("params"), "unproven": listed("facts"), "signal": verify.has_signal(F.col("quote"))})


def witnesses(spark, sf: str) -> DataFrame:
    w = derived(spark, sf, WITNESS)
    return w.withColumn("uid", verify.uid(F.col("service"), F.col("method"), F.col("path"))).drop("service")


@query(f"WITH {_E} SELECT id, own AS uid FROM e")
def recomputed_uid(spark, sf):
    return endpoints(spark, sf).select("id", verify.uid(F.col("service"), F.col("method"), F.col("path")).alias("uid"))


def _of(spark, sf, *checks):
    return verify.endpoint_findings(endpoints(spark, sf), ["s0", "s1"]).where(F.col("rule").isin(*checks))


_V02 = f"""SELECT id, uid, 'V-02' AS rule, 'info' AS severity, own AS detail FROM eg WHERE own <> uid UNION ALL SELECT id, own, 'V-02', 'reject', method FROM eg WHERE upper(method) NOT IN ('GET','POST','PUT','PATCH','DELETE','HEAD','OPTIONS')
 UNION ALL SELECT id, own, 'V-02', 'reject', service FROM eg WHERE service NOT IN ('s0', 's1') UNION ALL SELECT id, own, 'V-02', 'reject', array_to_string(missing, ',') || '/' || array_to_string(extra, ',') FROM eg WHERE len(missing) + len(extra) > 0"""
_V03 = """SELECT id, own AS uid, 'V-03' AS rule, 'reject' AS severity, 'identity' AS detail FROM eg WHERE n_evidence = 0 UNION ALL SELECT id, own, 'V-03', 'warn', unnest(unproven) FROM eg"""
_V09 = """SELECT id, own AS uid, 'V-09' AS rule, 'warn' AS severity, upper(method) AS detail FROM eg WHERE has_body AND upper(method) IN ('GET', 'HEAD') UNION ALL SELECT id, own, 'V-09', 'reject', array_to_string(twice, ',') FROM eg WHERE len(twice) > 0"""


@query(f"WITH {_E}, {_EF} {_V02}")
def v02_identity(spark, sf):
    return _of(spark, sf, "V-02")


@query(f"WITH {_E}, {_EF} {_V03}")
def v03_unevidenced(spark, sf):
    return _of(spark, sf, "V-03")


@query(f"WITH {_E}, {_EF} {_V09}")
def v09_plausibility(spark, sf):
    return _of(spark, sf, "V-09")


@query(f"""WITH {_E} SELECT id, uid, 'V-05' AS rule, 'reject' AS severity, CAST(n - 1 AS VARCHAR) AS detail FROM (SELECT id, uid, count(*) OVER (PARTITION BY uid) AS n FROM o) WHERE n > 1""")
def v05_duplicates(spark, sf):
    return verify.duplicates(verify.recomputed(endpoints(spark, sf)).select("id", "uid"))


_V06 = """s AS (SELECT id, uid, file, upper(method) AS m, list_filter(string_split(trim(trim(path), '/'), '/'), lambda x: x <> '') AS s FROM o WHERE n_evidence > 0),
 pairs AS (SELECT a.id, a.uid, list_filter(range(1, len(a.s) + 1), lambda i: a.s[i] <> b.s[i]) AS d, a.s AS sa, b.s AS sb FROM s a JOIN s b ON a.file = b.file AND a.m = b.m AND a.id <> b.id AND len(a.s) = len(b.s)),
 v06 AS (SELECT id, uid, 'V-06' AS rule, 'warn' AS severity, CAST(count(*) AS VARCHAR) AS detail FROM pairs WHERE len(d) = 1 AND regexp_matches(sa[d[1]], '^[{:<]') <> regexp_matches(sb[d[1]], '^[{:<]') GROUP BY id, uid)"""


@query(f"WITH {_E}, {_V06} SELECT * FROM v06")
def v06_shadowing(spark, sf):
    return verify.shadowing(verify.recomputed(endpoints(spark, sf)).withColumn("path", F.trim("path")))


_SIGNAL_SQL = "(contains(quote, '@app.get(') OR contains(quote, 'setGlobalPrefix('))"
_W = f"""w AS (SELECT ord, service || ':' || method || ':' || {norm_sql('path')} AS uid, method, path, file, auth FROM ({duck(WITNESS)})), lw AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ord DESC) = 1),
 h AS (SELECT * FROM lw QUALIFY row_number() OVER (PARTITION BY method, file ORDER BY ord DESC) = 1),
 c AS (SELECT e.id, e.uid, e.path, e.auth, CASE WHEN lw.uid IS NOT NULL THEN 'agreed' WHEN h.uid IS NOT NULL THEN 'handler' WHEN clean AND {_SIGNAL_SQL} THEN 'unseen' ELSE 'invented' END AS state, coalesce(lw.uid, h.uid) AS used, coalesce(lw.path, h.path) AS seen_path, coalesce(lw.auth, h.auth) AS seen_auth
  FROM o e LEFT JOIN lw ON lw.uid = e.uid LEFT JOIN h ON lw.uid IS NULL AND h.method = upper(e.method) AND h.file = e.file),
 vw AS (SELECT id, uid, 'V-07' AS rule, CASE state WHEN 'invented' THEN 'reject' ELSE 'info' END AS severity, 'no witness' AS detail FROM c WHERE state IN ('invented', 'unseen')
  UNION ALL SELECT id, uid, 'V-12', 'warn', seen_path FROM c WHERE state = 'handler' AND {norm_sql('seen_path')} <> {norm_sql('path')} UNION ALL SELECT id, uid, 'V-13', 'warn', CAST(seen_auth AS VARCHAR) FROM c WHERE state = 'agreed' AND seen_auth <> auth
  UNION ALL SELECT NULL, '__omitted__:' || uid, 'V-08', 'warn', 'omitted' FROM lw WHERE uid NOT IN (SELECT used FROM c WHERE used IS NOT NULL))"""


@query(f"WITH {_E}, {_W} SELECT state, count(*) AS n, count(DISTINCT used) AS n_used FROM c GROUP BY state")
def witness_states(spark, sf):
    found = verify.crosscheck(verify.recomputed(endpoints(spark, sf)), witnesses(spark, sf))
    return found.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("used").alias("n_used"))


@query(f"WITH {_E}, {_W} SELECT * FROM vw")
def v07_v13_witness(spark, sf):
    w = witnesses(spark, sf)
    return verify.witness_findings(verify.crosscheck(verify.recomputed(endpoints(spark, sf)), w), w)


@query("""SELECT id, uid, 'V-10' AS rule, 'reject' AS severity, name AS detail FROM (SELECT p_partkey AS id, p_brand AS uid, unnest(list_distinct(['N' || p_size, 'N' || (p_partkey % 30)])) AS name FROM part) WHERE name NOT IN (SELECT 'N' || n_nationkey FROM nation)""")
def v10_references(spark, sf):
    refs = F.array(F.concat(F.lit("N"), "p_size"), F.concat(F.lit("N"), F.col("p_partkey") % 30))
    return verify.unresolved_refs(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("uid"), refs.alias("refs")), table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("name")))


@query("""SELECT p_partkey AS id, p_brand AS uid, 'V-11' AS rule, 'info' AS severity, 'summary:' || p_type AS detail FROM part WHERE p_type NOT IN ('ai_inferred', 'weak_inference') UNION ALL SELECT p_partkey, p_brand, 'V-11', 'info', 'auth:ast' FROM part WHERE p_size % 2 = 0""")
def v11_promoted(spark, sf):
    facts = F.explode(F.create_map(F.lit("summary"), F.col("p_type"), F.lit("auth"), F.when(F.col("p_size") % 2 == 0, "ast").otherwise("ai_inferred"))).alias("fact", "extraction_method")
    return verify.promoted_claims(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("uid"), facts))


_CITED = """SELECT doc_id AS id, concat('u', doc_id) AS uid, CASE WHEN doc_id % 3 = 0 THEN 'identity' ELSE 'body' END AS kind,
 CASE WHEN doc_id % 13 = 0 THEN concat('../', doc_id) WHEN doc_id % 13 = 1 THEN concat('/', doc_id) WHEN doc_id % 13 = 2 THEN 'gone' ELSE concat('', doc_id) END AS file,
 CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 17 = 1 THEN 3 ELSE 1 END AS line_start, CASE WHEN doc_id % 17 = 1 THEN 2 WHEN doc_id % 17 = 2 THEN 100000 ELSE 2 END AS line_end,
 CASE WHEN doc_id % 19 = 0 THEN 'nosuchsymbol' ELSE '' END AS symbol, doc_id % 4 AS tamper, doc_id % 5 <> 0 AS has_history, doc_id % 6 = 0 AS was_true FROM {documents}"""


def audited_citations(spark, sf: str) -> DataFrame:
    """Citations of the first lines of each document: true ones, such as were true before, such as never were, and such as can't be read."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    own = docs.select(F.col("file").alias("own"), F.col("text").alias("own_text"))
    c = derived(spark, sf, _CITED).join(own, F.col("id").cast("string") == F.col("own"), "left")
    lines = F.split(F.regexp_replace("own_text", r"\n$", ""), "\n")
    there = F.slice(lines, F.greatest(F.col("line_start"), F.lit(1)), F.greatest(F.least(F.col("line_end"), F.size(lines)) - F.greatest(F.col("line_start"), F.lit(1)) + 1, F.lit(0)))
    now = verify.R.snippet_hash(there)
    sha = F.when(F.col("tamper") == 1, F.sha2(F.concat(F.lit("old"), now), 256)).when(F.col("tamper") == 2, "never").otherwise(now)
    claims = c.select("id", "uid", "kind", "file", "line_start", "line_end", "symbol", sha.alias("snippet_sha256"))
    past = c.where("has_history").select("file", "line_start", "line_end", F.when(F.col("was_true") | (F.col("tamper") != 1), F.sha2(F.concat(F.lit("old"), now), 256)).otherwise("other").alias("past_sha256"))
    return evidence.audit(claims, docs, past=past.dropDuplicates(["file", "line_start", "line_end"]))


_NOW = r"sha256(array_to_string(list_transform(list_slice(lines, greatest(line_start, 1), least(line_end, len(lines))), lambda x: regexp_replace(x, '\s+$', '')), chr(10)))"
_AUDIT_SQL = rf"""cc AS ({duck(_CITED)}), ct AS (SELECT cc.*, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS lines FROM cc JOIN documents ON id = doc_id),
 ch AS (SELECT *, {_NOW} AS now, greatest(line_start, 1) > len(lines) AS beyond FROM ct), cs AS (SELECT *, CASE tamper WHEN 1 THEN sha256('old' || now) WHEN 2 THEN 'never' ELSE now END AS sha,
  CASE WHEN was_true OR tamper <> 1 THEN sha256('old' || now) ELSE 'other' END AS past FROM ch), hist AS (SELECT file, line_start, line_end, any_value(past) AS past FROM cs WHERE has_history AND file NOT IN ('gone') GROUP BY ALL),
 audited AS (SELECT cs.id, cs.uid, cs.kind, CASE WHEN starts_with(cs.file, '../') OR starts_with(cs.file, '/') THEN 'confinement_violation' WHEN cs.file = 'gone' OR cs.line_start < 1 OR cs.line_end < cs.line_start THEN 'unreadable'
   WHEN NOT beyond AND now = sha THEN CASE WHEN symbol <> '' AND NOT contains(array_to_string(list_slice(lines, cs.line_start, cs.line_end), chr(10)), symbol) THEN 'unreadable' ELSE 'verified' END
   WHEN hist.past IS NULL OR hist.past = sha THEN 'stale' ELSE 'fabricated' END AS verdict FROM cs LEFT JOIN hist ON cs.file = hist.file AND cs.line_start = hist.line_start AND cs.line_end = hist.line_end)"""


@query(f"WITH {_AUDIT_SQL} SELECT id, kind, verdict FROM audited")
def citation_audit(spark, sf):
    return audited_citations(spark, sf).select("id", "kind", "verdict")


_V04 = """v04 AS (SELECT id, uid, CASE verdict WHEN 'confinement_violation' THEN 'V-10' ELSE 'V-04' END AS rule, CASE WHEN kind = 'identity' AND verdict <> 'stale' THEN 'reject' ELSE 'warn' END AS severity, kind || ':' || verdict AS detail FROM audited WHERE verdict <> 'verified')"""


@query(f"WITH {_AUDIT_SQL}, {_V04} SELECT * FROM v04")
def v04_citations(spark, sf):
    return verify.audit_findings(audited_citations(spark, sf))


@query(f"""WITH {_AUDIT_SQL}, x AS (SELECT id // 3 AS id, verdict FROM audited) SELECT d.id, count(x.id) > 0 AS evidenced, coalesce(bool_and(verdict = 'verified'), true) AS all_verified, count(x.id) AS n FROM (SELECT DISTINCT doc_id AS id FROM documents) d LEFT JOIN x ON x.id = d.id GROUP BY d.id""")
def fact_rollup(spark, sf):
    """Three documents' citations make a fact; the other two thirds of the ids are facts without any."""
    found = audited_citations(spark, sf).withColumn("id", F.floor(F.col("id") / 3))
    return evidence.fact_rollup(found, table(spark, sf, "documents").select(F.col("doc_id").alias("id")))


_CLASSES = "SELECT p_partkey AS cls, CASE WHEN p_partkey > 10 THEN CAST(floor(p_partkey / 3) AS BIGINT) WHEN p_partkey % 2 = 0 THEN -1 WHEN p_partkey % 3 = 0 THEN -2 END AS base FROM {part}"
_GROUND_SQL = f"""RECURSIVE k AS ({duck(_CLASSES)}), fl AS (SELECT p_partkey AS owner, p_brand AS field FROM part UNION SELECT p_partkey, p_type FROM part),
 up AS (SELECT cls, cls AS owner FROM k UNION SELECT up.cls, k.base FROM up JOIN k ON k.cls = up.owner WHERE k.base > 0),
 res AS (SELECT up.cls, bool_and(k.base IS DISTINCT FROM -2) AS fully_resolved FROM up JOIN k ON k.cls = up.owner GROUP BY up.cls), cf AS (SELECT DISTINCT cls, field FROM up JOIN fl ON fl.owner = up.owner),
 claims AS (SELECT p_partkey AS id, p_name AS uid, p_partkey AS cls, unnest(list_distinct([p_brand, concat('brand', p_size), 'Brand#11'])) AS field FROM part),
 g AS (SELECT id, uid, claims.cls, claims.field, CASE WHEN cf.cls IS NOT NULL THEN 'grounded' WHEN fully_resolved THEN 'ungrounded' ELSE 'unknown' END AS state FROM claims JOIN res ON res.cls = claims.cls LEFT JOIN cf ON cf.cls = claims.cls AND cf.field = claims.field)"""


def grounded(spark, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    classes = derived(spark, sf, _CLASSES)
    fields = p.select(F.col("p_partkey").alias("owner"), F.explode(F.array_distinct(F.array("p_brand", "p_type"))).alias("field"))
    claims = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("uid"), F.col("p_partkey").alias("cls"), F.explode(F.array_distinct(F.array("p_brand", F.concat(F.lit("brand"), "p_size"), F.lit("Brand#11")))).alias("field"))
    return verify.grounding(claims, graph.inherited_fields(classes, fields), graph.resolved_classes(classes, inert=[-1]))


@query(f"WITH {_GROUND_SQL} SELECT id, cls, field, state FROM g")
def field_grounding(spark, sf):
    return grounded(spark, sf).select("id", "cls", "field", "state")


@query(f"""WITH {_GROUND_SQL} SELECT id, uid, 'V-15' AS rule, CASE state WHEN 'ungrounded' THEN 'warn' ELSE 'info' END AS severity, cls || '.' || field AS detail FROM g WHERE state <> 'grounded'""")
def v15_grounding(spark, sf):
    return verify.grounding_findings(grounded(spark, sf))


@query(f"WITH {_GROUND_SQL} SELECT id, round(avg(CASE state WHEN 'ungrounded' THEN 0.0 ELSE 1.0 END), 9) AS ratio FROM g GROUP BY id")
def grounded_ratio(spark, sf):
    return verify.grounded_ratio(grounded(spark, sf)).withColumn("ratio", F.round("ratio", 9))
