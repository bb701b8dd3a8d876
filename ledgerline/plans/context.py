"""Queries of what a target needs: names as files see them, types and calls around a symbol, seeds of targets of all forms, routes that an index witnesses; each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import names, retrieval
from .catalogue import query
from .verification import derived, duck, norm_sql

_FILE = "concat('app/f', CAST(floor({k} / 20) AS BIGINT), '.py')"
#: Symbols of 20 a file: names that several files have and such as one has only, some within others, decorated or not; texts that name types and call functions.
SYMBOLS = f"""SELECT p_partkey AS sid, p_partkey AS ord, {_FILE.format(k="p_partkey")} AS file, CASE WHEN p_partkey % 60 = 7 THEN concat('Uni', p_partkey) WHEN p_partkey % 10 = 3 THEN concat('fun_', p_partkey % 90) ELSE concat('Cls', p_partkey % 60) END AS name,
 CASE WHEN p_partkey % 10 = 3 THEN 'function' ELSE 'class' END AS kind, CASE WHEN p_partkey % 9 = 0 THEN 'Outer' ELSE '' END AS parent, 1 + (p_partkey % 20) * 10 AS s_lo, 8 + (p_partkey % 20) * 10 + (p_size % 3) * 20 AS s_hi,
 CASE WHEN p_partkey % 4 = 1 THEN concat('@app.get("/', lower(p_brand), '/{{{{id}}}}", tags=["x"])') WHEN p_partkey % 4 = 2 THEN '@cached' ELSE '' END AS decorator,
 concat('see Cls', p_partkey * 7 % 60, ' or Optional[Cls', (p_partkey + 1) % 60, '], Ab, Uni', 7 + 60 * (p_partkey % 3), ' fun_', p_partkey * 3 % 90, '(x) and fun_', (p_partkey + 30) % 90, ' (y)') AS text FROM {{part}}"""
IMPORTS = f"""SELECT p_partkey AS ord, {_FILE.format(k="p_partkey")} AS src, {_FILE.format(k="p_partkey * 13 % 100")} AS dst, CASE WHEN p_partkey % 8 = 0 THEN concat('Cls', p_partkey * 7 % 60) WHEN p_partkey % 8 = 4 THEN concat('fun_', p_partkey * 3 % 90) ELSE '' END AS one FROM {{part}} WHERE p_partkey % 2 = 0"""
#: Candidates of routes, some without a method, with the line that they were found on.
CANDIDATES = f"""SELECT p_partkey AS ord, {_FILE.format(k="p_partkey")} AS file, 1 + p_partkey * 11 % 230 AS line, 240 AS total, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN 'POST' ELSE 'GET' END AS method, concat('/', 'm' || (p_size % 5), '/', CASE WHEN p_partkey % 2 = 0 THEN ':id' ELSE concat('x', p_size) END, CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '' END) AS path,
 concat('router.get("/x", ', CASE WHEN p_partkey % 3 = 0 THEN concat('fun_', p_partkey % 90) ELSE 'lambda' END, ');') AS quote FROM {{part}}"""
HINTS = f"SELECT file, CASE WHEN n % 3 = 0 THEN '/v1' ELSE '' END AS own, CASE WHEN n % 2 = 0 THEN 'api/' ELSE '' END AS outr FROM (SELECT {_FILE.format(k='p_partkey')} AS file, max(CAST(floor(p_partkey / 20) AS BIGINT)) AS n FROM {{part}} GROUP BY 1)"
#: One target a supplier, of all forms.
TARGETS = """SELECT s_suppkey AS k, CASE s_suppkey % 12 WHEN 0 THEN concat('GET /api/v1/brand#', 11 + s_suppkey % 45, '/{{id}}') WHEN 1 THEN concat('get /brand#', 11 + s_suppkey % 45, '/:key/') WHEN 2 THEN concat('GET /else/brand#', 11 + s_suppkey % 45, '/{{n}}') WHEN 3 THEN concat('GET /brand#', 11 + s_suppkey % 45, '/{{id}}/more')
 WHEN 4 THEN concat('POST /m', s_suppkey % 5, '/x', s_suppkey % 50) WHEN 5 THEN concat('GET /p/m', s_suppkey % 5, '/:id') WHEN 6 THEN concat('app/f', s_suppkey % 9, '.py::Cls', s_suppkey % 60) WHEN 7 THEN concat('app/f', s_suppkey % 12, '.py') WHEN 8 THEN concat('Cls', s_suppkey % 60) WHEN 9 THEN ' fun_33 '
 WHEN 10 THEN concat('app', chr(92), 'f', s_suppkey % 9, '.py') ELSE 'nothing' END AS target FROM {supplier}"""


def symbols(spark, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return derived(spark, sf, SYMBOLS).withColumn("decorators", F.when(F.col("decorator") == "", none).otherwise(F.array("decorator")))


def imports(spark, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return derived(spark, sf, IMPORTS).withColumn("names", F.when(F.col("one") == "", none).otherwise(F.array("one"))).drop("one")


_RESOLVE = """{n} AS (SELECT name, file, sid, tier FROM (SELECT a.name, a.file, s.sid, 1 AS tier, 0 AS edge, s.ord FROM {a} a JOIN top s ON s.name = a.name AND s.file = a.file
 UNION ALL SELECT a.name, a.file, s.sid, 2, i.ord, s.ord FROM {a} a JOIN imp i ON i.src = a.file AND i.one = a.name AND i.one <> '' JOIN top s ON s.file = i.dst AND s.name = a.name UNION ALL SELECT a.name, a.file, s.sid, 3, i.ord, s.ord FROM {a} a JOIN imp i ON i.src = a.file AND i.one = '' JOIN top s ON s.file = i.dst AND s.name = a.name
 UNION ALL SELECT a.name, a.file, s.sid, 4, 0, 0 FROM {a} a JOIN (SELECT name, min(sid) AS sid FROM top GROUP BY name HAVING count(*) = 1) s ON s.name = a.name) QUALIFY row_number() OVER (PARTITION BY name, file ORDER BY tier, edge, ord) = 1)"""
_STOP = "('" + "', '".join(names.STOP_WORDS) + "')"
_NAMES = f"""sy AS ({duck(SYMBOLS)}), top AS (SELECT * FROM sy WHERE parent = ''), imp AS ({duck(IMPORTS)}),
 tw AS (SELECT DISTINCT sid, file, name FROM (SELECT sid, file, unnest(regexp_extract_all(text, '\\b([A-Z][A-Za-z0-9_]{{2,}})\\b', 1)) AS name FROM sy) WHERE name NOT IN {_STOP}), cw AS (SELECT DISTINCT w.sid, w.file, w.name FROM (SELECT sid, file, unnest(regexp_extract_all(text, '\\b([a-z_][a-z0-9_]{{2,}})\\s*\\(', 1)) AS name FROM sy) w JOIN sy ON sy.sid = w.sid AND sy.name <> w.name),
 ta AS (SELECT DISTINCT name, file FROM tw), ca AS (SELECT DISTINCT name, file FROM cw), {_RESOLVE.format(n="tr", a="ta")}, {_RESOLVE.format(n="cr", a="ca")},
 te AS (SELECT DISTINCT tw.sid, tr.sid AS to_sid FROM tw JOIN tr USING (name, file) JOIN sy ON sy.sid = tr.sid AND sy.kind = 'class')"""


@query(f"WITH {_NAMES} SELECT name, file, sid, tier FROM tr UNION ALL SELECT name, file, sid, tier FROM cr")
def scoped_names(spark, sf):
    s, i = symbols(spark, sf), imports(spark, sf)
    asked = lambda pattern: s.select("file", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("name"))
    types = asked(names._TYPE).where(~F.col("name").isin(names.STOP_WORDS))
    calls = s.select("file", F.col("name").alias("own"), F.explode(F.regexp_extract_all("text", F.lit(names._CALL), 1)).alias("name")).where("name <> own")
    return names.resolved(types.select("name", "file").unionByName(calls.select("name", "file")), s, i)


@query(f"WITH RECURSIVE {_NAMES}, r AS (SELECT sid AS seed, sid, 0 AS depth FROM sy UNION SELECT r.seed, te.to_sid, r.depth + 1 FROM r JOIN te ON te.sid = r.sid WHERE r.depth < 3) SELECT seed, sid, min(depth) AS depth FROM r WHERE seed <> sid GROUP BY seed, sid")
def scoped_types(spark, sf):
    s = symbols(spark, sf)
    return names.expanded_types(s.select(F.col("sid").alias("seed"), "sid"), s, imports(spark, sf))


@query(f"WITH {_NAMES} SELECT DISTINCT cw.sid, cr.sid AS callee FROM cw JOIN cr USING (name, file) JOIN sy ON sy.sid = cr.sid AND sy.kind = 'function' AND sy.file <> cw.file")
def scoped_calls(spark, sf):
    return names.called(symbols(spark, sf), imports(spark, sf))


def hints(spark, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    h = derived(spark, sf, HINTS)
    return h.select("file", F.when(F.col("own") == "", none).otherwise(F.array("own")).alias("own"), F.when(F.col("outr") == "", none).otherwise(F.array("outr")).alias("outer"))


def _joined(a: str, b: str) -> str:
    both = f"regexp_replace({a}, '/+$', '') || '/' || regexp_replace({b}, '^/+', '')"
    return f"CASE WHEN {a} = '' THEN {b} WHEN starts_with({both}, '/') THEN {both} ELSE '/' || {both} END"


def _variants(rows: str, literal: str) -> str:
    """Rows of a relation with file and a literal, once for each way to put hints before it, as v."""
    inner = f"SELECT x.*, o.o, {_joined('i.i', 'x.' + literal)} AS m FROM (SELECT r.*, h.own, h.outr FROM {rows} r LEFT JOIN hh h ON h.file = r.file) x, LATERAL (SELECT unnest(list_distinct(['', coalesce(x.own, '')])) AS i) i, LATERAL (SELECT unnest(list_distinct(['', coalesce(x.outr, '')])) AS o) o"
    return f"SELECT * EXCLUDE (o, m, t, own, outr), CASE WHEN regexp_replace(t, '/+$', '') = '' THEN '/' ELSE regexp_replace(t, '/+$', '') END AS v FROM (SELECT *, {_joined('o', 'm')} AS t FROM ({inner}))"


_WILD = r"regexp_replace({x}, '\{{[^{{}}]*\}}|<[^<>]*>|:[A-Za-z_][A-Za-z0-9_]*', '*', 'g')"
_TRIM = "CASE WHEN regexp_replace({x}, '/+$', '') = '' THEN '/' ELSE regexp_replace({x}, '/+$', '') END"
_WITNESS = f"""hh AS ({duck(HINTS)}), cand AS ({duck(CANDIDATES)}), sp AS ({duck(SYMBOLS)}), cv AS ({_variants("(SELECT * FROM cand WHERE method <> '')", "path")}),
 ck AS (SELECT ord, upper(method) AS method, v AS path, file, line, {norm_sql('v')} AS key FROM cv), cf AS (SELECT * FROM ck QUALIFY row_number() OVER (PARTITION BY method, key ORDER BY ord, path) = 1),
 ct AS (SELECT cf.ord, cf.method, cf.path, cf.key, cf.file, sp.sid, sp.name FROM cf LEFT JOIN sp ON sp.file = cf.file AND cf.line BETWEEN sp.s_lo AND sp.s_hi QUALIFY row_number() OVER (PARTITION BY cf.method, cf.key ORDER BY sp.s_hi - sp.s_lo NULLS LAST, sp.sid) = 1),
 gw AS (SELECT ord, method, path, key, CASE WHEN name IS NULL THEN file ELSE file || '::' || name END AS code_ref FROM ct)"""


def witness(spark, sf: str) -> DataFrame:
    spans = derived(spark, sf, SYMBOLS).select(F.col("sid").alias("s_id"), F.col("name").alias("qualname"), "file", "s_lo", "s_hi")
    return retrieval.graph_witness(derived(spark, sf, CANDIDATES), hints(spark, sf), spans)


@query(f"WITH {_WITNESS} SELECT ord, method, path, key, code_ref FROM gw")
def graph_witness(spark, sf):
    return witness(spark, sf)


@query(
    f"""WITH {_WITNESS}, two AS (SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN 'POST' ELSE 'GET' END || ':' || '/api/' || 'm' || (p_size % 5) || '/' || CASE WHEN p_partkey % 2 = 0 THEN '{{param}}' ELSE 'x' || p_size END AS key FROM part), one AS (SELECT DISTINCT method || ':' || key AS key FROM gw)
    SELECT coalesce(one.key, two.key) AS key, CASE WHEN one.key IS NULL THEN 'second_only' WHEN two.key IS NULL THEN 'first_only' ELSE 'agreed' END AS side FROM one FULL JOIN two ON one.key = two.key"""
)
def compared_engines(spark, sf):
    one = witness(spark, sf).select(F.concat_ws(":", "method", "key").alias("key"))
    k = F.col("p_partkey")
    two = derived(spark, sf, "SELECT * FROM {part}").select(F.concat(F.when(k % 4 == 0, "POST").otherwise("GET"), F.lit(":/api/"), F.concat(F.lit("m"), F.col("p_size") % 5), F.lit("/"), F.when(k % 2 == 0, "{param}").otherwise(F.concat(F.lit("x"), "p_size"))).alias("key"))
    return retrieval.compared(one, two, "key")


_SEEDS = rf"""hh AS ({duck(HINTS)}), cand AS ({duck(CANDIDATES)}), sy AS ({duck(SYMBOLS)}), tg AS (SELECT DISTINCT target, trim(target) AS t FROM ({duck(TARGETS)})),
 rt AS (SELECT target, upper(regexp_extract(t, '^(\S+)\s+(/\S*)$', 1)) AS method, {_TRIM.format(x="regexp_extract(t, '^(\\S+)\\s+(/\\S*)$', 2)")} AS path FROM tg WHERE regexp_matches(t, '(?i)^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/\S*)$')), rw AS (SELECT *, {_WILD.format(x="path")} AS wild FROM rt), ot AS (SELECT * FROM tg WHERE target NOT IN (SELECT target FROM rt)),
 dl AS (SELECT sid, file, unnest(regexp_extract_all(decorator, '"([^"]*)"', 1)) AS lit FROM sy), dp AS (SELECT DISTINCT sid, v AS p, {_WILD.format(x="v")} AS w FROM ({_variants("dl", "lit")})),
 dm AS (SELECT target, sid, CASE WHEN p = path OR w = wild THEN 1 WHEN ends_with(path, p) OR ends_with(wild, w) THEN 2 WHEN len(p) > 1 AND contains(path, p) THEN 3 END AS tier FROM rw, dp), d1 AS (SELECT DISTINCT target, sid, tier FROM dm WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY target)),
 cc AS (SELECT *, {_TRIM.format(x="path")} AS p FROM cand), hit AS (SELECT target, file, line, total, regexp_extract(quote, ',\s*([A-Za-z_]\w*)\s*\)\s*;?\s*$', 1) AS handler FROM (SELECT rw.target, rw.path AS rp, rw.wild, rw.method AS rm, cc.* FROM rw JOIN cc ON (cc.method = '' OR cc.method = rw.method) AND (cc.p = rw.path OR {_WILD.format(x="cc.p")} = rw.wild OR ends_with(rw.path, cc.p) OR ends_with(cc.p, rw.path)) WHERE rw.target NOT IN (SELECT target FROM d1))),
 fl AS (SELECT target, t, replace(t, chr(92), '/') AS file FROM ot WHERE NOT contains(t, '::') AND regexp_matches(t, '[/\\]|[^.]\.[^.]+$')), nm AS (SELECT target, t FROM ot WHERE NOT contains(t, '::') AND target NOT IN (SELECT target FROM fl)),
 allt AS (SELECT target, CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'suffix' ELSE 'fuzzy' END AS tier, sid FROM d1 UNION SELECT target, 'handler', sid FROM hit JOIN sy ON sy.name = hit.handler AND hit.handler <> '' UNION SELECT target, 'named', sid FROM ot JOIN sy ON sy.file = split_part(t, '::', 1) AND sy.name = split_part(t, '::', 2) WHERE contains(t, '::')
  UNION SELECT target, tier, sid FROM (SELECT target, sid, CASE WHEN decorator <> '' THEN 'decorated' WHEN parent = '' THEN 'top' END AS tier FROM fl JOIN sy ON sy.file = fl.file) WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY target) UNION SELECT target, tier, sid FROM (SELECT target, sid, CASE WHEN parent = '' THEN 'name' ELSE 'nested' END AS tier FROM nm JOIN sy ON sy.name = nm.t) QUALIFY tier = min(tier) OVER (PARTITION BY target))"""


@query(f"WITH {_SEEDS} SELECT target, tier, allt.sid, sy.file, CAST(NULL AS INTEGER) AS lo, CAST(NULL AS INTEGER) AS hi FROM allt JOIN sy ON sy.sid = allt.sid UNION ALL SELECT DISTINCT target, 'candidate', NULL, file, CAST(greatest(1, line - 3) AS INTEGER), CAST(least(total, line + 3) AS INTEGER) FROM hit")
def target_seeds(spark, sf):
    c = derived(spark, sf, CANDIDATES).withColumn("method", F.upper("method")).withColumn("line", F.col("line").cast("int"))
    return retrieval.seeds(derived(spark, sf, TARGETS), symbols(spark, sf), hints(spark, sf), c)


#: A line of each file a part, that names files and functions, and routes that tests and requests speak of.
LINES = f"""SELECT {_FILE.format(k="p_partkey")} AS file, 1 + (p_partkey % 20) * 12 AS line, 245 AS total, concat('mount(f', p_partkey * 13 % 11, '.router, fun_', p_partkey * 3 % 90, ')') AS text FROM {{part}}"""
CORPUS = """SELECT p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN concat('/', lower(p_brand), '/{{{{id}}}}') WHEN 1 THEN concat('/do/fun_', p_partkey % 90) WHEN 2 THEN CASE WHEN p_partkey % 50 = 2 THEN '/' ELSE concat('/m', p_size % 5, '/x', p_size, '/') END ELSE '' END AS path, concat('tests/t', p_size, '.py') AS file, 1 + p_partkey % 77 AS line FROM {part}""".replace("{{{{", "{{").replace("}}}}", "}}")

_CONTEXT = rf"""{_NAMES}, {_SEEDS.replace(f"sy AS ({duck(SYMBOLS)}), ", "")}, ln AS ({duck(LINES)}), co AS ({duck(CORPUS)}), bg AS (SELECT DISTINCT allt.target, sy.* EXCLUDE (ord) FROM allt JOIN sy ON sy.sid = allt.sid),
 rc AS (SELECT DISTINCT target, sid, 0 AS depth FROM bg UNION SELECT rc.target, te.to_sid, rc.depth + 1 FROM rc JOIN te ON te.sid = rc.sid WHERE rc.depth < 3), ty AS (SELECT DISTINCT target, sid FROM rc EXCEPT SELECT target, sid FROM bg),
 cl AS (SELECT DISTINCT bg.target, cr.sid FROM bg JOIN cw ON cw.sid = bg.sid JOIN cr ON cr.name = cw.name AND cr.file = cw.file JOIN sy ON sy.sid = cr.sid AND sy.kind = 'function' AND sy.file <> cw.file),
 tk AS (SELECT src, dst, ord, unnest(list_distinct([one, regexp_replace(regexp_extract(dst, '[^/]*$', 0), '\.[^.]*$', '')])) AS token FROM imp), ht AS (SELECT DISTINCT dst, src, tk.ord, line, total FROM ln JOIN tk ON tk.src = ln.file AND token <> '' AND contains(text, token)),
 hi AS (SELECT *, sum(new) OVER (PARTITION BY dst, src, ord ORDER BY line ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN line - 3 > lag(line) OVER (PARTITION BY dst, src, ord ORDER BY line) + 4 THEN 1 ELSE 0 END AS new FROM ht)),
 wn AS (SELECT dst, src, lo, arg_min(hi, ord) AS hi FROM (SELECT dst, src, ord, greatest(1, min(line) - 3) AS lo, least(max(total), max(line) + 3) AS hi FROM hi GROUP BY dst, src, ord, island) GROUP BY dst, src, lo),
 mn AS (SELECT target, src AS file, lo, arg_min(hi, dst) AS hi FROM (SELECT DISTINCT target, file AS dst FROM bg) b JOIN wn USING (dst) GROUP BY target, src, lo),
 ev AS (SELECT target, file, s_lo AS lo, s_hi AS hi, 'seed' AS role, 0 AS rank FROM bg UNION ALL SELECT DISTINCT target, file, greatest(1, line - 3), least(total, line + 3), 'seed', 0 FROM hit UNION ALL SELECT target, file, s_lo, s_hi, 'type', 1 FROM ty JOIN sy USING (sid) UNION ALL SELECT target, file, s_lo, s_hi, 'call', 2 FROM cl JOIN sy USING (sid) UNION ALL SELECT target, file, lo, hi, 'mount', 3 FROM mn),
 oc AS (SELECT target, file, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, role, rank FROM ev QUALIFY row_number() OVER (PARTITION BY target, file, lo ORDER BY rank, role, hi) = 1),
 wp AS (SELECT target, regexp_replace(regexp_extract(t, '^(\S+)\s+(/\S*)$', 2), '/+$', '') AS p FROM tg WHERE target IN (SELECT target FROM rt) AND (target IN (SELECT target FROM allt) OR target IN (SELECT target FROM hit))), cx AS (SELECT *, regexp_replace(path, '/+$', '') AS c FROM co WHERE path <> ''),
 wt AS (SELECT target, ord, file, line FROM wp JOIN cx ON p <> '' AND (ends_with(p, c) OR ends_with(c, p)) UNION SELECT target, ord, file, line FROM (SELECT DISTINCT target, name FROM bg WHERE len(name) > 4) n JOIN (SELECT co.* FROM co WHERE path <> '') c ON contains(c.path, n.name)),
 w12 AS (SELECT * FROM wt QUALIFY row_number() OVER (PARTITION BY target ORDER BY ord) <= 12)"""


def context_parts(spark, sf: str) -> DataFrame:
    c = derived(spark, sf, CANDIDATES).withColumn("line", F.col("line").cast("int"))
    return retrieval.context(derived(spark, sf, TARGETS), symbols(spark, sf), imports(spark, sf), hints(spark, sf), c, derived(spark, sf, LINES), derived(spark, sf, CORPUS))


@query(f"WITH RECURSIVE {_CONTEXT} SELECT * FROM oc UNION ALL SELECT target, file, CAST(line AS INTEGER), CAST(line AS INTEGER), 'witness', 4 FROM w12")
def target_context(spark, sf):
    return context_parts(spark, sf)
