"""Queries of whole verification runs: history at a commit, cited classes, all rules, verdicts and scores, each with its DuckDB counterpart.

The model is derived from part, with files, their versions and citations into them, by one SQL text that both engines run; operators and counterparts are written apart from each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import evidence, graph, report, verify
from ..operators.stores import written
from .catalogue import query, table
from .verification import _CLASSES, _E, _SIGNAL_SQL, derived, duck, endpoints, norm_sql

_FILE = "concat('src/', p_size % 9, '_', CAST(floor(p_partkey / 100) AS BIGINT), '.py')"
FILES = f"SELECT file, concat('@app.get(', file, ')', chr(10), 'class ', file, chr(10), 'plain words', chr(10)) AS text FROM (SELECT DISTINCT {_FILE} AS file FROM {{part}})"
#: Three lines, then one, then deleted.
VERSIONS = f"""SELECT file, CAST(1 AS BIGINT) AS at, concat('old ', file, chr(10), 'two', chr(10), 'three') AS text FROM (SELECT DISTINCT {_FILE} AS file FROM {{part}})
 UNION ALL SELECT file, 5, 'short' FROM (SELECT DISTINCT {_FILE} AS file FROM {{part}}) UNION ALL SELECT file, 9, NULL FROM (SELECT DISTINCT {_FILE} AS file FROM {{part}})"""
COMMITS = "SELECT concat('c', n_nationkey) AS commit, n_nationkey AS at FROM {nation}"
#: Up to two citations of an endpoint's identity and one of each of two facts: true ones, such as were true before, such as never were, and such as can't be read.
CITES = f"""SELECT id, ord, kind, file, commit, line_start, line_end, symbol, quote, extraction_method, CASE tamper WHEN 1 THEN old WHEN 2 THEN 'never' ELSE now END AS said FROM (SELECT p_partkey AS id, k AS ord, p_partkey % 7 AS tamper,
 CASE WHEN k < 2 THEN 'identity' WHEN k = 2 THEN 'summary' ELSE 'auth' END AS kind, CASE WHEN p_partkey % 41 = 0 AND k = 0 THEN concat('../', {_FILE}) WHEN p_partkey % 43 = 0 THEN 'gone.py' ELSE {_FILE} END AS file,
 CASE p_partkey % 5 WHEN 0 THEN 'c3' WHEN 1 THEN 'c6' WHEN 2 THEN 'c12' WHEN 3 THEN 'nope' END AS commit, CASE k WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END AS line_start, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS line_end,
 CASE WHEN p_partkey % 19 = 0 AND k = 0 THEN 'nosuchsymbol' ELSE '' END AS symbol, CASE WHEN p_partkey % 2 = 0 THEN '@app.get( here' ELSE 'plain words' END AS quote, CASE WHEN p_partkey % 8 = 0 THEN 'ast_verified' ELSE 'ai_inferred' END AS extraction_method,
 CASE k WHEN 0 THEN concat('@app.get(', {_FILE}, ')') WHEN 1 THEN concat('@app.get(', {_FILE}, ')', chr(10), 'class ', {_FILE}) WHEN 2 THEN 'plain words' ELSE concat('class ', {_FILE}, chr(10), 'plain words') END AS now,
 CASE k WHEN 0 THEN concat('old ', {_FILE}) WHEN 1 THEN concat('old ', {_FILE}, chr(10), 'two') WHEN 2 THEN 'three' ELSE concat('two', chr(10), 'three') END AS old FROM (SELECT *, {{kinds}} AS k FROM {{part}})
 WHERE (k = 0 AND p_partkey % 23 <> 0) OR (k = 1 AND p_partkey % 3 = 0) OR (k = 2 AND p_partkey % 6 < 2 AND p_partkey % 4 <> 0) OR (k = 3 AND p_partkey % 6 = 0))"""
WITNESS = f"""SELECT p_partkey AS ord, concat('s', p_size % 3) AS service, CASE WHEN p_size % 4 = 0 THEN 'GET' WHEN p_size % 4 = 1 THEN 'POST' WHEN p_size % 4 = 2 THEN 'PUT' ELSE 'DELETE' END AS method,
 concat('/v', p_size % 2, '/', lower(p_brand), CASE WHEN p_partkey % 5 = 0 THEN '/{{{{id}}}}' WHEN p_partkey % 5 = 1 THEN concat('/k', p_partkey % 50) ELSE concat('/item', p_partkey % 11) END) AS path, CASE WHEN p_partkey % 4 = 0 THEN 'other.py' ELSE {_FILE} END AS file, p_partkey % 8 = 0 AS auth FROM {{part}}"""
#: Classes in those files, some within others, and citations of bodies, some beside any class.
CLASSES = f"""SELECT p_partkey AS cls, p_partkey AS ord, {_FILE} AS file, CASE WHEN p_partkey % 10 = 0 THEN 'function' ELSE 'class' END AS kind, p_brand AS name, 1 + (p_partkey % 100) * 5 AS line_start, 4 + (p_partkey % 100) * 5 + (p_size % 3) * 10 AS line_end FROM {{part}}"""
BODIES = f"""SELECT p_partkey AS id, k AS ord, CASE WHEN k = 0 AND p_partkey % 2 = 0 THEN 'none.py' ELSE {_FILE} END AS file, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN 'Brand#13' END AS symbol,
 1 + (p_partkey * 7 % 100) * 5 AS line_start, 1 + (p_partkey * 7 % 100) * 5 + (p_size % 4) * 20 AS line_end FROM (SELECT *, {{two}} AS k FROM {{part}}) WHERE p_partkey % 4 <> 3"""
_KINDS, _TWO = "0, 1, 2, 3", "0, 1"


def cites(spark, sf: str) -> DataFrame:
    rows = derived(spark, sf, CITES.replace("{kinds}", f"explode(array({_KINDS}))"))
    return rows.withColumn("snippet_sha256", F.sha2("said", 256)).drop("said")


def audited(spark, sf: str) -> DataFrame:
    return evidence.audit_at_commit(cites(spark, sf), derived(spark, sf, FILES), derived(spark, sf, VERSIONS), derived(spark, sf, COMMITS))


def bodies(spark, sf: str) -> DataFrame:
    return derived(spark, sf, BODIES.replace("{two}", f"explode(array({_TWO}))"))


_AUDIT = rf"""cc AS ({duck(CITES.replace("{kinds}", f"unnest([{_KINDS}])"))}), ff AS ({duck(FILES)}), vv AS ({duck(VERSIONS)}), cm AS ({duck(COMMITS)}),
 lined AS (SELECT cc.*, sha256(said) AS sha, string_split(regexp_replace(ff.text, '\n$', ''), chr(10)) AS lines, cm.at AS moment FROM cc LEFT JOIN ff ON ff.file = cc.file LEFT JOIN cm ON cm.commit = cc.commit),
 dated AS (SELECT l.*, (SELECT arg_max(coalesce(v.text, chr(0)), v.at) FROM vv v WHERE v.file = l.file AND v.at <= l.moment) AS hist FROM lined l),
 spans AS (SELECT *, list_slice(lines, line_start, line_end) AS cited, CASE WHEN hist IS NOT NULL AND hist <> chr(0) THEN string_split(hist, chr(10)) END AS past FROM dated),
 au AS (SELECT id, ord, kind, file, quote, extraction_method, CASE WHEN starts_with(file, '../') THEN 'confinement_violation' WHEN lines IS NULL THEN 'unreadable'
   WHEN sha256(array_to_string(cited, chr(10))) = sha THEN CASE WHEN symbol <> '' AND len(list_filter(cited, lambda x: contains(x, symbol))) = 0 THEN 'unreadable' ELSE 'verified' END
   WHEN past IS NULL THEN 'stale' WHEN line_end <= len(past) AND sha256(array_to_string(list_slice(past, line_start, line_end), chr(10))) = sha THEN 'stale' ELSE 'fabricated' END AS verdict FROM spans)"""


@query(f"WITH {_AUDIT} SELECT id, ord, kind, verdict FROM au")
def evidence_at_commit(spark, sf):
    return audited(spark, sf).select("id", "ord", "kind", "verdict")


@query(f"WITH {_AUDIT} SELECT id, kind, count(*) > 0 AS evidenced, bool_and(verdict = 'verified') AS all_verified, count(*) AS n FROM au GROUP BY id, kind")
def facts_at_commit(spark, sf):
    rows = audited(spark, sf).withColumn("fact", F.struct("id", "kind"))
    return evidence.fact_rollup(rows.drop("id").withColumnRenamed("fact", "id")).select("id.id", "id.kind", "evidenced", "all_verified", "n")


_CITED = f"""bc AS ({duck(BODIES.replace("{two}", f"unnest([{_TWO}])"))}), kl AS ({duck(CLASSES)}),
 met AS (SELECT bc.id, bc.ord AS turn, kl.cls, kl.ord, coalesce(bc.symbol, '') <> '' AND bc.symbol = kl.name AS named, kl.line_end - kl.line_start AS span FROM bc JOIN kl ON kl.file = bc.file AND kl.kind = 'class' AND kl.line_start <= bc.line_end AND bc.line_start <= kl.line_end),
 cited AS (SELECT id, cls FROM met QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn, NOT named, CASE WHEN named THEN 0 ELSE span END, ord) = 1)"""


@query(f"WITH {_CITED} SELECT id, cls FROM cited")
def cited_class(spark, sf):
    return evidence.cited_classes(bodies(spark, sf), derived(spark, sf, CLASSES))


_FIELDS = """RECURSIVE k AS ({classes}), up AS (SELECT cls, cls AS owner FROM k UNION SELECT up.cls, k.base FROM up JOIN k ON k.cls = up.owner WHERE k.base > 0), res AS (SELECT up.cls, bool_and(k.base IS DISTINCT FROM -2) AS fully_resolved FROM up JOIN k ON k.cls = up.owner GROUP BY up.cls),
 cf AS (SELECT DISTINCT cls, 'f' || p_size AS field FROM up JOIN part ON p_partkey = owner), wanted AS (SELECT p_partkey AS id, unnest(list_distinct(['f' || p_size, 'f' || (p_partkey % 50), 'f' || (p_partkey % 7)])) AS field FROM part),
 gr AS (SELECT cited.id, cited.cls, wanted.field, CASE WHEN cf.cls IS NOT NULL THEN 'grounded' WHEN fully_resolved THEN 'ungrounded' ELSE 'unknown' END AS state FROM cited JOIN wanted ON wanted.id = cited.id JOIN res ON res.cls = cited.cls LEFT JOIN cf ON cf.cls = cited.cls AND cf.field = wanted.field)"""
_FIELDS = _FIELDS.replace("{classes}", duck(_CLASSES))


def grounded(spark, sf: str) -> DataFrame:
    """Claimed fields against the class that the body's own citations mean."""
    p = table(spark, sf, "part")
    classes = derived(spark, sf, _CLASSES)
    field = lambda n: F.concat(F.lit("f"), n)
    wanted = p.select(F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("uid"), F.explode(F.array_distinct(F.array(field(F.col("p_size")), field(F.col("p_partkey") % 50), field(F.col("p_partkey") % 7)))).alias("field"))
    claims = wanted.join(evidence.cited_classes(bodies(spark, sf), derived(spark, sf, CLASSES)), "id")
    fields = p.select(F.col("p_partkey").alias("owner"), field(F.col("p_size")).alias("field"))
    return verify.grounding(claims, graph.inherited_fields(classes, fields), graph.resolved_classes(classes, inert=[-1]))


@query(f"WITH {_FIELDS.replace('RECURSIVE ', 'RECURSIVE ' + _CITED + ', ')} SELECT id, cls, field, state FROM gr")
def cited_field_grounding(spark, sf):
    return grounded(spark, sf).select("id", "cls", "field", "state")


def model(spark, sf: str, witnessed: bool = True) -> dict[str, DataFrame]:
    """The parts of a verification run: e, found and witness, the first two written once."""
    i = F.col("id")
    facts = F.when(i % 6 == 0, F.array(F.lit("summary"), F.lit("auth"))).when(i % 6 == 1, F.array(F.lit("tags"), F.lit("summary"))).otherwise(F.array().cast("array<string>"))
    ends = endpoints(spark, sf).drop("unproven", "n_evidence", "signal", "clean", "file", "quote").withColumns({"facts": facts, "auth": F.when(i % 6 == 0, F.col("auth"))})
    seen = written(audited(spark, sf), "audited")
    e = written(report.with_identity(ends, seen), "endpoints")
    w = derived(spark, sf, WITNESS).withColumn("uid", verify.uid(F.col("service"), F.col("method"), F.col("path"))).drop("service")
    refs = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.concat(F.lit("N"), F.col("p_partkey") % 26)).alias("refs"))
    names = table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("name"))
    found = written(report.findings(e, seen, refs, names, grounded(spark, sf), w if witnessed else None, ["s0", "s1"]), "findings")
    return {"e": e, "found": found, "witness": w}


_NAMED = r"list_concat(list_concat(regexp_extract_all(path, '\{([^{}:]+)', 1), regexp_extract_all(path, '[^A-Za-z0-9_]:([A-Za-z_][A-Za-z0-9_]*)', 1)), regexp_extract_all(path, '<(?:[^<>:]+:)?([^<>]+)>', 1))"
_RANK = "CASE verdict WHEN 'verified' THEN 0 WHEN 'stale' THEN 1 WHEN 'unreadable' THEN 2 WHEN 'confinement_violation' THEN 3 ELSE 4 END"
_REPORT = f"""WITH {_FIELDS.replace('RECURSIVE ', 'RECURSIVE ' + _CITED + ', ')}, {_E}, {_AUDIT},
 idn AS (SELECT id, count(*) AS n, arg_min(file, ord) AS file, bool_or({_SIGNAL_SQL}) AS signal, arg_max(verdict, {_RANK}) AS worst FROM au WHERE kind = 'identity' GROUP BY id),
 m AS (SELECT o.id, service, method, o.path, params, has_body, CASE WHEN o.id % 6 = 0 THEN auth END AS auth, o.own AS uid, claimed, coalesce(idn.n, 0) AS n_evidence, idn.file, coalesce(signal, false) AS signal, coalesce(worst, 'verified') AS worst, CASE WHEN o.id % 6 = 0 THEN ['summary', 'auth'] WHEN o.id % 6 = 1 THEN ['tags', 'summary'] ELSE [] END AS facts,
   {_NAMED} AS named, CASE WHEN params = '' THEN []::VARCHAR[] ELSE string_split(params, ',') END AS declared FROM (SELECT o.*, e.uid AS claimed FROM o JOIN e ON e.id = o.id) o LEFT JOIN idn ON idn.id = o.id),
 mg AS (SELECT *, list_sort(list_distinct(list_filter(named, lambda x: NOT list_contains(declared, x)))) AS missing, list_sort(list_distinct(list_filter(declared, lambda x: NOT list_contains(named, x)))) AS extra, list_sort(list_distinct(list_filter(named, lambda x: len(list_filter(named, lambda y: y = x)) > 1))) AS twice FROM m),
 f1 AS (SELECT id, uid, 'V-02' AS rule, 'reject' AS severity, method AS detail FROM mg WHERE upper(method) NOT IN ('GET','POST','PUT','PATCH','DELETE','HEAD','OPTIONS') UNION ALL SELECT id, uid, 'V-02', 'reject', service FROM mg WHERE service NOT IN ('s0', 's1')
  UNION ALL SELECT id, uid, 'V-02', 'reject', array_to_string(missing, ',') || '/' || array_to_string(extra, ',') FROM mg WHERE len(missing) + len(extra) > 0 UNION ALL SELECT id, uid, 'V-03', 'reject', 'identity' FROM mg WHERE n_evidence = 0
  UNION ALL SELECT id, uid, 'V-03', 'warn', fact FROM (SELECT id, uid, unnest(facts) AS fact FROM mg) x WHERE NOT EXISTS (SELECT 1 FROM au WHERE au.id = x.id AND au.kind = x.fact)
  UNION ALL SELECT id, uid, 'V-05', 'reject', CAST(n - 1 AS VARCHAR) FROM (SELECT id, uid, count(*) OVER (PARTITION BY uid) AS n FROM mg) WHERE n > 1
  UNION ALL SELECT id, uid, CASE verdict WHEN 'confinement_violation' THEN 'V-10' ELSE 'V-04' END, CASE WHEN kind = 'identity' AND verdict <> 'stale' THEN 'reject' ELSE 'warn' END, kind || ':' || verdict FROM au JOIN (SELECT id, uid FROM mg) USING (id) WHERE verdict <> 'verified'
  UNION ALL SELECT id, uid, 'V-10', 'reject', 'N' || (id % 26) FROM mg WHERE 'N' || (id % 26) NOT IN (SELECT 'N' || n_nationkey FROM nation)),
 w AS (SELECT ord, service || ':' || method || ':' || {norm_sql('path')} AS uid, method, path, file, auth FROM ({duck(WITNESS)})), lw AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ord DESC) = 1), h AS (SELECT * FROM lw QUALIFY row_number() OVER (PARTITION BY method, file ORDER BY ord DESC) = 1),
 c AS (SELECT mg.id, mg.uid, mg.path, mg.auth, mg.worst, mg.n_evidence, CASE WHEN lw.uid IS NOT NULL THEN 'agreed' WHEN h.uid IS NOT NULL THEN 'handler' WHEN worst = 'verified' AND signal THEN 'unseen' ELSE 'invented' END AS state, coalesce(lw.uid, h.uid) AS used, coalesce(lw.path, h.path) AS seen_path, coalesce(lw.auth, h.auth) AS seen_auth
  FROM mg LEFT JOIN lw ON lw.uid = mg.uid LEFT JOIN h ON lw.uid IS NULL AND h.method = upper(mg.method) AND h.file = mg.file WHERE mg.uid NOT IN (SELECT uid FROM f1 WHERE severity = 'reject')),
 seg AS (SELECT id, uid, file, upper(method) AS m, list_filter(string_split(trim(trim(path), '/'), '/'), lambda x: x <> '') AS s FROM mg WHERE n_evidence > 0),
 pairs AS (SELECT a.id, a.uid, list_filter(range(1, len(a.s) + 1), lambda i: a.s[i] <> b.s[i]) AS d, a.s AS sa, b.s AS sb FROM seg a JOIN seg b ON a.file = b.file AND a.m = b.m AND a.id <> b.id AND len(a.s) = len(b.s)),
 fs AS (SELECT * FROM f1 UNION ALL SELECT id, claimed, 'V-02', 'info', uid FROM mg WHERE claimed <> uid UNION ALL SELECT id, uid, 'V-07', CASE state WHEN 'invented' THEN 'reject' ELSE 'info' END, 'no witness' FROM c WHERE state IN ('invented', 'unseen')
  UNION ALL SELECT id, uid, 'V-12', 'warn', seen_path FROM c WHERE state = 'handler' AND {norm_sql('seen_path')} <> {norm_sql('path')} UNION ALL SELECT id, uid, 'V-13', 'warn', CAST(seen_auth AS VARCHAR) FROM c WHERE state = 'agreed' AND seen_auth <> auth
  UNION ALL SELECT NULL, '__omitted__:' || uid, 'V-08', 'warn', 'omitted' FROM lw WHERE uid NOT IN (SELECT used FROM c WHERE used IS NOT NULL)
  UNION ALL SELECT id, uid, 'V-06', 'warn', CAST(count(*) AS VARCHAR) FROM pairs WHERE len(d) = 1 AND regexp_matches(sa[d[1]], '^[{{:<]') <> regexp_matches(sb[d[1]], '^[{{:<]') GROUP BY id, uid
  UNION ALL SELECT id, uid, 'V-09', 'warn', upper(method) FROM mg WHERE has_body AND upper(method) IN ('GET', 'HEAD') UNION ALL SELECT id, uid, 'V-09', 'reject', array_to_string(twice, ',') FROM mg WHERE len(twice) > 0
  UNION ALL SELECT id, uid, 'V-11', 'info', kind || ':' || extraction_method FROM au JOIN (SELECT id, uid FROM mg) USING (id) WHERE kind <> 'identity' AND extraction_method NOT IN ('ai_inferred', 'weak_inference')
  UNION ALL SELECT id, uid, 'V-15', CASE state WHEN 'ungrounded' THEN 'warn' ELSE 'info' END, cls || '.' || field FROM gr JOIN (SELECT id, uid FROM mg) USING (id) WHERE state <> 'grounded'),
 j AS (SELECT uid, CASE WHEN rejects > 0 THEN 'reject' WHEN stale > 0 THEN 'stale' WHEN warns > 0 THEN 'warn' ELSE 'pass' END AS verdict, rejects, warns, infos FROM (SELECT u.uid, count(*) FILTER (severity = 'reject') AS rejects, count(*) FILTER (severity = 'warn') AS warns, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (rule = 'V-04' AND detail = 'identity:stale') AS stale
   FROM (SELECT uid FROM mg UNION SELECT uid FROM fs WHERE id IS NULL) u LEFT JOIN fs ON fs.uid = u.uid GROUP BY u.uid))"""


@query(f"{_REPORT} SELECT * FROM fs")
def verification_findings(spark, sf):
    return model(spark, sf)["found"]


@query(f"{_REPORT} SELECT * FROM j")
def verification_report(spark, sf):
    m = model(spark, sf)
    return report.verdicts(m["e"], m["found"])


@query(f"{_REPORT} SELECT CASE WHEN rejected > 0 THEN 'endpoints_rejected' WHEN warned + stale > 0 THEN 'ok_with_warnings' ELSE 'ok' END AS verdict, passed, warned, rejected, stale FROM (SELECT count(*) FILTER (verdict = 'pass') AS passed, count(*) FILTER (verdict = 'warn') AS warned, count(*) FILTER (verdict = 'reject') AS rejected, count(*) FILTER (verdict = 'stale') AS stale FROM j)")
def model_verdict(spark, sf):
    m = model(spark, sf)
    return report.model_verdict(report.verdicts(m["e"], m["found"]))


@query(
    f"""{_REPORT}, sc AS (SELECT c.uid, CASE WHEN worst <> 'verified' THEN 25 WHEN state IN ('agreed', 'handler') THEN 95 WHEN n_evidence = 0 THEN 50 ELSE 90 END AS existence, CASE WHEN worst <> 'verified' THEN 25 WHEN state = 'handler' AND {norm_sql('seen_path')} <> {norm_sql('path')} THEN 50 WHEN state IN ('agreed', 'handler') THEN 95 WHEN n_evidence = 0 THEN 50 ELSE 90 END AS path
    FROM c WHERE uid NOT IN (SELECT uid FROM fs WHERE severity = 'reject')) SELECT uid, existence, path, CASE WHEN least(existence, path) >= 90 THEN 'auto' WHEN least(existence, path) >= 75 THEN 'flag' WHEN least(existence, path) >= 50 THEN 'needs_approval' ELSE 'blocked' END AS action FROM sc"""
)
def model_scores(spark, sf):
    m = model(spark, sf)
    return report.scores(m["e"], m["found"], m["witness"])


@query(f"{_REPORT} SELECT * FROM fs WHERE rule NOT IN ('V-07', 'V-08', 'V-12', 'V-13') UNION ALL SELECT id, uid, 'V-07', 'info', 'witness unavailable' FROM mg")
def unwitnessed_findings(spark, sf):
    """The same model where there is no witness."""
    return model(spark, sf, witnessed=False)["found"]


@query(f"{_REPORT} SELECT uid, file, count(*) AS n FROM mg WHERE file IS NOT NULL AND uid IN (SELECT uid FROM mg GROUP BY uid HAVING count(*) > 1) GROUP BY uid, file")
def duplicate_files(spark, sf):
    return verify.duplicate_files(report.with_identity(endpoints(spark, sf).drop("file", "n_evidence", "signal", "unproven", "quote").withColumn("facts", F.array().cast("array<string>")), audited(spark, sf)))
