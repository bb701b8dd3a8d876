"""The queries over the synthetic tables, each with the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import routes as R
from ..operators import budget, context, dedupe, diff, evidence, graph, incremental, intervals, matching, merge, scoring
from ..operators.stores import TASK_ROWS, dealt, spread
from ..sources import mining

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str, apart: bool = False) -> DataFrame:
    """apart: many rows are dealt out to tasks of their own, for queries that do much to a row or make large ones of it; a small file, which is one task, may hold millions."""
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    if apart and (n := rows.count()) > TASK_ROWS // 10:
        rows = spread(rows, 10 * n)
    return rows if name in ("nation", "region") else dealt(rows)


# routes of pages: GET:/normalized/path
_PATH_SQL = r"regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')"
_KEYS_SQL = rf"""keys AS (
  SELECT page_id, url, 'GET:' || CASE WHEN length(p) > 1 AND right(p, 1) = '/' THEN left(p, length(p) - 1) ELSE p END AS key FROM (
    SELECT page_id, url, regexp_replace(CASE WHEN q = '' THEN '/' ELSE q END, '/[0-9]+(\.html)?(/|$)', '/{{param}}\2', 'g') AS p FROM (
      SELECT page_id, url, {_PATH_SQL} AS q FROM pages)))"""


def page_keys(spark: SparkSession, sf: str) -> DataFrame:
    path = R.with_params(R.url_path(F.col("url")))
    return table(spark, sf, "pages").select("page_id", "url", R.route_key(F.lit("GET"), path).alias("key"))


@query(f"WITH {_KEYS_SQL} SELECT page_id, key FROM keys")
def normalize_route_key(spark, sf):
    return page_keys(spark, sf).select("page_id", "key")


@query(f"WITH {_KEYS_SQL} SELECT key, count(*) AS n FROM keys GROUP BY key")
def route_inventory(spark, sf):
    return page_keys(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_KEYS_SQL} SELECT key, c AS n, page_id FROM (SELECT key, page_id, count(*) OVER (PARTITION BY key) AS c FROM keys) WHERE c > 1")
def duplicate_identity(spark, sf):
    return dedupe.duplicate_keys(page_keys(spark, sf), "key", "page_id")


@query(f"WITH {_KEYS_SQL} SELECT key, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM keys GROUP BY key")
def dedupe_first_wins(spark, sf):
    return dedupe.first_per_key(page_keys(spark, sf), ["key"], "page_id")


@query(f"WITH {_KEYS_SQL} SELECT key, max(page_id) AS page_id, arg_max(url, page_id) AS url FROM keys GROUP BY key")
def dedupe_last_wins(spark, sf):
    return dedupe.first_per_key(page_keys(spark, sf), ["key"], "page_id", last=True)


@query(
    f"""WITH {_KEYS_SQL}, one AS (SELECT key, min(page_id) AS page_id FROM keys WHERE page_id % 2 = 0 GROUP BY key),
    two AS (SELECT key, max(page_id) AS page_id FROM keys WHERE page_id % 2 = 1 GROUP BY key)
    SELECT key, coalesce(two.page_id, one.page_id) AS page_id, one.page_id IS NOT NULL AND two.page_id IS NOT NULL AS overridden FROM one FULL JOIN two USING (key)"""
)
def precedence_union(spark, sf):
    keys = page_keys(spark, sf).select("key", "page_id")
    return dedupe.precedence_union(keys.where("page_id % 2 = 0"), keys.where("page_id % 2 = 1"), "key", "page_id")


_SIDES = """built AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders),
 live AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderpriority END AS p FROM orders),
 changes AS (SELECT coalesce(b.k, l.k) AS k, CASE WHEN l.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'deprecated'
   WHEN b.s IS NOT DISTINCT FROM l.s AND b.p IS NOT DISTINCT FROM l.p THEN 'unchanged' ELSE 'modified' END AS change FROM built b FULL JOIN live l ON b.k = l.k)"""


def order_sides(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    changed = o.withColumn("p", F.when(F.col("k") % 7 == 0, "changed").otherwise(F.col("p")))
    return o, changed.withColumn("k", F.when(F.col("k") % 3 == 0, -F.col("k")).otherwise(F.col("k")))


@query(f"WITH {_SIDES} SELECT k, change FROM changes")
def diff_classify(spark, sf):
    return diff.classify(*order_sides(spark, sf), "k", "k", ["s", "p"])


@query(f"WITH {_SIDES} SELECT change, count(*) AS n FROM changes GROUP BY change")
def diff_summary(spark, sf):
    return diff.summary(diff.classify(*order_sides(spark, sf), "k", "k", ["s", "p"]))


@query(
    f"""WITH {_KEYS_SQL}, b AS (SELECT key, arg_min(url, page_id) AS url FROM keys WHERE page_id % 2 = 0 GROUP BY key), l AS (SELECT key, arg_min(url, page_id) AS url FROM keys WHERE page_id % 2 = 1 GROUP BY key)
    SELECT change, count(*) AS n FROM (SELECT CASE WHEN l.key IS NULL THEN 'new' WHEN b.key IS NULL THEN 'deprecated' WHEN b.url IS NOT DISTINCT FROM l.url THEN 'unchanged' ELSE 'modified' END AS change
    FROM b FULL JOIN l ON b.key = l.key) GROUP BY change"""
)
def route_drift(spark, sf):
    keys = page_keys(spark, sf)
    return diff.summary(diff.classify(keys.where("page_id % 2 = 0"), keys.where("page_id % 2 = 1"), "key", "page_id", ["url"]))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND NOT starts_with(c_name, '[DEPRECATED]')")
def deprecated_antijoin(spark, sf):
    c = table(spark, sf, "customer").where(~F.col("c_name").startswith("[DEPRECATED]"))
    return c.join(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(
    """WITH live AS (SELECT doc_id AS k, lang AS method, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'note ' || source END AS note FROM documents),
    built AS (SELECT doc_id AS k, 'q' || quality AS method, 'auto' AS note FROM labels)
    SELECT coalesce(l.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.method ELSE l.method END AS method, coalesce(nullif(l.note, ''), b.note) AS note FROM live l FULL JOIN built b ON l.k = b.k"""
)
def merge_ownership(spark, sf):
    live = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.col("lang").alias("method"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("note "), "source")).alias("note"))
    built = table(spark, sf, "labels").select(F.col("doc_id").alias("k"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("method"), F.lit("auto").alias("note"))
    return merge.owned_merge(live, built, "k", ["method"], ["note"])


@query(
    """SELECT event_id, CASE WHEN k IS NULL THEN '' ELSE 'k=' || CASE WHEN event_id % 3 = 0 THEN 'patched' ELSE k END END || CASE WHEN event_id % 3 = 0 THEN ';z=new' ELSE '' END AS props
    FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)"""
)
def overrides_patch(spark, sf):
    e = table(spark, sf, "events").withColumn("base", F.from_json("props", "map<string,string>"))
    base = F.map_filter("base", lambda k, v: k == "k")
    patch = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("k"), F.lit("patched"), F.lit("z"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    out = F.array_sort(F.map_entries(merge.overlay(base, patch)))
    return e.where(F.get_json_object("props", "$.k").isNotNull()).select("event_id", F.array_join(F.transform(out, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("props"))


@query("SELECT doc_id, CASE WHEN starts_with(name, '[DEPRECATED]') THEN name ELSE '[DEPRECATED] ' || name END AS name FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '[DEPRECATED] ' || source END AS name FROM documents)")
def soft_deprecate(spark, sf):
    named = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.concat(F.lit("[DEPRECATED] "), "source")).alias("name"))
    return named.select("doc_id", merge.deprecate(merge.deprecate(F.col("name"))).alias("name"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


_RSTRIP = r"regexp_replace(x, '\s+$', '')"
_SNIP = "sha256(array_to_string(list_transform(list_slice(string_split({t}, chr(10)), {a}, {b}), lambda x: " + _RSTRIP + "), chr(10)))"


@query(f"SELECT doc_id, {_SNIP.format(t='text', a=2, b=4)} AS sha FROM documents")
def snippet_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.snippet_hash(F.slice(F.split("text", "\n"), 2, 3)).alias("sha"))


@query("SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS body FROM documents")
def line_explode(spark, sf):
    return mining.lines(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("text", "body")


_CLAIMS_SQL = f"""claims AS (SELECT doc_id, kind, CASE kind WHEN 2 THEN 1000000 ELSE 1 END AS a, CASE kind WHEN 2 THEN 1000002 ELSE 2 END AS b,
   CASE kind WHEN 1 THEN 'tampered' ELSE {_SNIP.format(t='text', a=1, b=2)} END AS sha, text FROM documents, (VALUES (0), (1), (2)) k(kind)),
 audited AS (SELECT doc_id, kind, CASE WHEN a <= len(string_split(text, chr(10))) AND {_SNIP.format(t='text', a='a', b='b')} = sha THEN 'verified' ELSE 'stale' END AS verdict FROM claims)"""


def audited(spark, sf):
    docs = table(spark, sf, "documents")
    sha = R.snippet_hash(F.slice(F.split("text", "\n"), 1, 2))
    kinds = docs.select("doc_id", sha.alias("sha"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("kind"))
    far = F.col("kind") == 2
    claims = kinds.select(F.col("doc_id").alias("file"), "kind", F.when(far, 1000000).otherwise(1).alias("line_start"), F.when(far, 1000002).otherwise(2).alias("line_end"), F.when(F.col("kind") == 1, "tampered").otherwise(F.col("sha")).alias("snippet_sha256"))
    return evidence.audit(claims, docs.select(F.col("doc_id").alias("file"), "text"))


@query(f"WITH {_CLAIMS_SQL} SELECT doc_id, kind, verdict FROM audited")
def evidence_audit(spark, sf):
    return audited(spark, sf).select(F.col("file").alias("doc_id"), "kind", "verdict")


@query(f"WITH {_CLAIMS_SQL} SELECT doc_id, arg_max(verdict, CASE verdict WHEN 'verified' THEN 0 ELSE 1 END) AS verdict, count(*) AS n FROM audited GROUP BY doc_id")
def worst_verdict(spark, sf):
    return evidence.worst(audited(spark, sf), "file").withColumnRenamed("file", "doc_id")


@query(
    """SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS all_ok, count(*) AS n, round(avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.5 END), 6) AS ratio,
    CASE WHEN count_if(l_returnflag = 'R') > 0 THEN 'reject' WHEN count_if(l_returnflag = 'A') > 0 THEN 'warn' ELSE 'ok' END AS verdict FROM lineitem GROUP BY l_orderkey"""
)
def verdict_rollup(spark, sf):
    flag = F.col("l_returnflag")
    verdict = F.when(F.count_if(flag == "R") > 0, "reject").when(F.count_if(flag == "A") > 0, "warn").otherwise("ok")
    ratio = F.round(F.avg(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.5)), 6)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_and(flag != "R").alias("all_ok"), F.count(F.lit(1)).alias("n"), ratio.alias("ratio"), verdict.alias("verdict"))


_FACT_SQL = """facts AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'R' AS verified, CASE l_linestatus WHEN 'F' THEN 'agree' ELSE CASE WHEN l_linenumber = 3 THEN 'disagree' ELSE 'unavailable' END END AS agreement,
  l_linenumber = 5 AS witness, l_linenumber = 1 AS is_identity, l_quantity > 2 AS evidenced, CAST(l_quantity AS BIGINT) % 4 AS cnt, CASE WHEN CAST(l_partkey AS BIGINT) % 3 = 0 THEN 0.25 ELSE 1.0 END AS ratio FROM lineitem),
 based AS (SELECT *, CASE WHEN NOT verified THEN 25 WHEN agreement = 'disagree' THEN 50 WHEN witness THEN CASE WHEN is_identity THEN 95 ELSE 90 END WHEN agreement = 'agree' THEN CASE WHEN is_identity THEN 95 ELSE 90 END
  WHEN NOT evidenced THEN 50 WHEN is_identity THEN 90 WHEN cnt >= 2 THEN 75 ELSE 50 END AS base FROM facts),
 scored AS (SELECT *, CAST(CASE WHEN ratio < 1 THEN round_even(CAST(base * (0.5 + 0.5 * ratio) AS DOUBLE), 0) ELSE base END AS INTEGER) AS score FROM based)"""


def scored(spark, sf):
    n, agreement = F.col("l_linenumber"), F.when(F.col("l_linestatus") == "F", "agree").when(F.col("l_linenumber") == 3, "disagree").otherwise("unavailable")
    ratio = F.when(F.col("l_partkey") % 3 == 0, 0.25).otherwise(1.0)
    score = scoring.fact_score(F.col("l_returnflag") != "R", agreement, n == 5, n == 1, F.col("l_quantity") > 2, F.col("l_quantity").cast("long") % 4, ratio)
    return table(spark, sf, "lineitem").withColumns({"agreement": agreement, "score": score})


@query(f"WITH {_FACT_SQL} SELECT l_orderkey, l_linenumber, score FROM scored")
def confidence_score(spark, sf):
    return scored(spark, sf).select("l_orderkey", "l_linenumber", "score")


@query(
    f"""WITH {_FACT_SQL}, g AS (SELECT l_orderkey, least(coalesce(max(score) FILTER (l_linenumber = 1), 0), coalesce(max(score) FILTER (l_linenumber = 2), 0)) AS gate FROM scored GROUP BY l_orderkey)
    SELECT l_orderkey, gate, CASE WHEN gate >= 90 THEN 'auto' WHEN gate >= 75 THEN 'flag' WHEN gate >= 50 THEN 'needs_approval' ELSE 'blocked' END AS action FROM g"""
)
def gate_action(spark, sf):
    of = lambda k: F.max(F.when(F.col("l_linenumber") == k, F.col("score")))
    gate = scored(spark, sf).groupBy("l_orderkey").agg(scoring.gate_score(of(1), of(2)).alias("gate"))
    return gate.withColumn("action", scoring.gate_action(F.col("gate")))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 2 OR l_returnflag = 'R' THEN 'E4' WHEN l_linestatus = 'F' OR l_linenumber = 2 THEN 'E2'
    WHEN l_suppkey % 2 = 0 AND coalesce(CASE l_linenumber WHEN 1 THEN NULL WHEN 3 THEN false ELSE true END, true) THEN 'E3' ELSE 'E4' END AS grade FROM lineitem"""
)
def evidence_grade(spark, sf):
    n = F.col("l_linenumber")
    fields = F.when(n == 1, F.lit(None).cast("boolean")).when(n == 3, False).otherwise(True)
    grade = scoring.grade(F.col("l_quantity") > 2, F.col("l_returnflag") != "R", F.col("l_linestatus") == "F", n == 2, F.col("l_suppkey") % 2 == 0, fields)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", grade.alias("grade"))


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'auto' WHEN 'O' THEN 'needs_approval' ELSE 'blocked' END AS action FROM orders
    WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 10 = 0)"""
)
def policy_selection(spark, sf):
    action = F.when(F.col("o_orderstatus") == "F", "auto").when(F.col("o_orderstatus") == "O", "needs_approval").otherwise("blocked")
    return table(spark, sf, "orders").select("o_orderkey", action.alias("action")).where(scoring.selected(F.col("action"), F.col("o_orderkey") % 10 == 0))


@query(
    """WITH t AS (SELECT p_partkey, p_type, CASE WHEN lower(p_type) = 'um' THEN 1 WHEN lower(p_type) LIKE '%um' THEN 2 WHEN lower(p_type) LIKE '%um%' THEN 3 END AS tier FROM part)
    SELECT p_partkey, p_type, tier FROM t WHERE tier = (SELECT min(tier) FROM t)"""
)
def tiered_match(spark, sf):
    return matching.match_target(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", "um")


@query(
    f"""WITH p AS (SELECT DISTINCT {_PATH_SQL} AS path FROM pages), u AS (SELECT DISTINCT regexp_extract(path, '^/[^/]*', 0) AS root FROM p UNION SELECT '' UNION SELECT '/en/1')
    SELECT path, max_by(root, length(root)) AS root FROM p JOIN u ON path = root OR starts_with(path, root || '/') GROUP BY path"""
)
def prefix_owner(spark, sf):
    p = table(spark, sf, "pages").select(F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "").alias("path")).distinct()
    units = p.select(F.regexp_extract("path", "^/[^/]*", 0).alias("root")).unionByName(spark.sql("SELECT '' AS root UNION ALL SELECT '/en/1'")).distinct()
    return matching.longest_prefix(p, "path", units, "root")


_SPAN = "CAST(epoch(ts) AS BIGINT)"


def event_times(spark, sf):
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("at")
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", at)


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t FROM events)
    SELECT a.event_id AS a_id, b.event_id AS b_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND a.t <= b.t + 3600 AND b.t <= a.t + 7200"""
)
def interval_overlap(spark, sf):
    e = event_times(spark, sf)
    a = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("a_id"), F.col("at").alias("a_lo"), (F.col("at") + 7200).alias("a_hi"))
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("b_id"), F.col("at").alias("b_lo"), (F.col("at") + 3600).alias("b_hi"))
    return intervals.overlapping(a, b, "user_id", 7200).select("a_id", "b_id")


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t FROM events),
    p AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'error'), s AS (SELECT event_id, user_id, t AS lo, t + 86400 * (1 + event_id % 5) AS hi FROM e WHERE event_type = 'purchase'),
    r AS (SELECT p.event_id AS p_id, s.event_id AS s_id, row_number() OVER (PARTITION BY p.event_id ORDER BY s.hi - s.lo, s.event_id) AS n FROM p JOIN s ON p.user_id = s.user_id AND p.t BETWEEN s.lo AND s.hi)
    SELECT p.user_id, p.event_id AS p_id, r.s_id FROM p LEFT JOIN r ON r.p_id = p.event_id AND r.n = 1"""
)
def tightest_enclosing(spark, sf):
    e = event_times(spark, sf)
    points = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("p_id"), F.col("at").alias("p_at"))
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("s_id"), F.col("at").alias("s_lo"), (F.col("at") + 86400 * (1 + F.col("event_id") % 5)).alias("s_hi"))
    return intervals.tightest(points, spans, "user_id", 86400)


@query(
    """WITH e AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t FROM events),
    f AS (SELECT *, CASE WHEN t - 43200 > lag(t + 43200) OVER (PARTITION BY user_id ORDER BY t) + 1 THEN 1 ELSE 0 END AS new FROM e),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM f)
    SELECT user_id, min(t) - 43200 AS lo, max(t) + 43200 AS hi, count(*) AS n FROM g GROUP BY user_id, i"""
)
def merge_windows(spark, sf):
    return intervals.merged(event_times(spark, sf), "user_id", "at", 43200)


@query("SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS method FROM events")
def lookback_method(spark, sf):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("event_id", F.coalesce(before, F.lit("")).alias("method"))


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS until_turn FROM conversations WHERE role = 'user'")
def next_region(spark, sf):
    nxt = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce(nxt, F.lit(-1)).alias("until_turn"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) <= 40")
def cap_per_group(spark, sf):
    return dedupe.cap_per_key(table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], ["l_orderkey", "l_linenumber"], 40)


@query(
    """WITH RECURSIVE c AS (SELECT conv_id, turn AS ord, CASE WHEN turn = 0 THEN 0 ELSE 1 + turn % 4 END AS rank, length(text) AS length, greatest(1, length(text) // 4) AS cost FROM conversations),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank, length, ord) AS i FROM c),
    w AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS used, []::BIGINT[] AS kept FROM (SELECT DISTINCT conv_id FROM c)
      UNION ALL SELECT w.conv_id, o.i, CASE WHEN o.rank = 0 OR w.used + o.cost + 8 <= 500 THEN w.used + o.cost + 8 ELSE w.used END, CASE WHEN o.rank = 0 OR w.used + o.cost + 8 <= 500 THEN list_append(w.kept, o.ord) ELSE w.kept END
      FROM w JOIN o ON o.conv_id = w.conv_id AND o.i = w.i + 1)
    SELECT conv_id, used, len(kept)::BIGINT AS n_kept, array_to_string(list_sort(kept), ',') AS kept FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1"""
)
def budget_fit(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("ord"), F.when(F.col("turn") == 0, 0).otherwise(1 + F.col("turn") % 4).alias("rank"), F.length("text").alias("length"), R.estimate_tokens(F.coalesce("text", F.lit(""))).alias("cost"))
    return budget.fit(c, "conv_id", 200)


@query("SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.estimate_tokens(F.col("text")).alias("tokens"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def href_mining(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_PART_KEYS_SQL = "keys AS (SELECT DISTINCT 'GET:/' || lower(p_brand) || '/' || CASE WHEN p_partkey % 5 = 0 THEN '{param}' ELSE 'i' || p_size END || CASE WHEN p_partkey % 3 = 0 THEN '/x' ELSE '' END AS key FROM part)"


@query(
    f"""WITH {_PART_KEYS_SQL}, seg AS (SELECT key, string_split(key, '/') AS s FROM keys)
    SELECT a.key AS literal, b.key AS pattern FROM seg a JOIN seg b ON len(a.s) = len(b.s) AND a.key <> b.key
    WHERE len(list_filter(range(1, len(a.s) + 1), lambda i: a.s[i] <> b.s[i])) = 1 AND len(list_filter(range(1, len(a.s) + 1), lambda i: a.s[i] <> b.s[i] AND a.s[i] <> '{{param}}' AND b.s[i] = '{{param}}')) = 1"""
)
def shadow_pairs(spark, sf):
    """Keys that differ in one segment, a literal in one and a placeholder in the other: each literal segment in turn is replaced by a
    placeholder, and what comes out is looked up among the keys, so that no pairs are compared."""
    k = F.col("p_partkey")
    last = F.when(k % 5 == 0, "{param}").otherwise(F.concat(F.lit("i"), "p_size"))
    keys = table(spark, sf, "part").select(F.concat(F.lit("GET:/"), F.lower("p_brand"), F.lit("/"), last, F.when(k % 3 == 0, "/x").otherwise("")).alias("key")).distinct()
    parts = keys.select("key", F.split("key", "/").alias("s"))
    masked = parts.select("key", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("i")).where(F.element_at("s", F.col("i")) != "{param}")
    pattern = F.array_join(F.transform("s", lambda x, j: F.when(j + 1 == F.col("i"), "{param}").otherwise(x)), "/")
    return masked.select(F.col("key").alias("literal"), pattern.alias("pattern")).join(keys.withColumnRenamed("key", "pattern"), "pattern", "left_semi").select("literal", "pattern")


_PARAM_SQL = "SELECT page_id, 'GET:/x/{' || lower(host) || '}/{id}' AS path, CASE WHEN page_id % 2 = 0 THEN [lower(host), 'id'] ELSE ['id', 'page'] END AS declared FROM (SELECT page_id, regexp_extract(url, '://([A-Za-z0-9]+)', 1) AS host FROM pages)"


@query(
    f"""WITH p AS ({_PARAM_SQL}), q AS (SELECT page_id, declared, regexp_extract_all(path, '\\{{([^{{}}:]+)', 1) AS named FROM p)
    SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(named, lambda x: NOT list_contains(declared, x)))), ',') AS missing, array_to_string(list_sort(list_distinct(list_filter(declared, lambda x: NOT list_contains(named, x)))), ',') AS extra FROM q"""
)
def placeholder_mismatch(spark, sf):
    host = F.lower(F.regexp_extract("url", "://([A-Za-z0-9]+)", 1))
    named = R.placeholder_names(F.concat(F.lit("/x/{"), host, F.lit("}/{id}")))
    declared = F.when(F.col("page_id") % 2 == 0, F.array(host, F.lit("id"))).otherwise(F.array(F.lit("id"), F.lit("page")))
    out = table(spark, sf, "pages").select("page_id", named.alias("n"), declared.alias("d"))
    return out.select("page_id", F.array_join(F.array_sort(F.array_except("n", "d")), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("d", "n")), ",").alias("extra"))


_EDGES_SQL = """edges AS (SELECT p_partkey // 3 AS parent, p_partkey AS child, '/b' || p_size AS prefix FROM part WHERE p_partkey > 10 UNION ALL SELECT p_partkey, p_partkey // 9, '/back' FROM part WHERE p_partkey % 7 = 0 AND p_partkey > 90 UNION ALL SELECT p_partkey, p_partkey + 1, '/alt' FROM part WHERE p_partkey % 41 = 0)"""


@query(
    f"""WITH RECURSIVE {_EDGES_SQL}, w AS (SELECT p_partkey AS node, '/r' || p_partkey AS path, [p_partkey] AS seen FROM part WHERE p_partkey <= 10
      UNION ALL SELECT e.child, w.path || e.prefix, list_append(w.seen, e.child) FROM w JOIN edges e ON e.parent = w.node WHERE NOT list_contains(w.seen, e.child))
    SELECT DISTINCT node, path FROM w"""
)
def mount_prefixes(spark, sf):
    """Trees of mounts with second mounts and with rings back to a node two steps above."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    tree = p.where("p_partkey > 10").select(F.floor(k / 3).alias("parent"), k.alias("child"), F.concat(F.lit("/b"), "p_size").alias("prefix"))
    back = p.where("p_partkey % 7 = 0 and p_partkey > 90").select(k.alias("parent"), F.floor(k / 9).alias("child"), F.lit("/back").alias("prefix"))
    again = p.where("p_partkey % 41 = 0").select(k.alias("parent"), (k + 1).alias("child"), F.lit("/alt").alias("prefix"))
    return graph.mount_paths(tree.unionByName(back).unionByName(again), p.where("p_partkey <= 10").select(k.alias("node"), F.concat(F.lit("/r"), k).alias("path")))


@query(
    """WITH RECURSIVE c AS (SELECT p_partkey AS cls, CASE WHEN p_partkey > 10 THEN p_partkey // 3 END AS base FROM part), f AS (SELECT p_partkey AS owner, p_brand AS field FROM part UNION SELECT p_partkey, p_type FROM part),
    up AS (SELECT DISTINCT cls, cls AS owner, 0 AS n FROM c UNION ALL SELECT up.cls, c.base, up.n + 1 FROM up JOIN c ON c.cls = up.owner WHERE c.base IS NOT NULL AND up.n < 16)
    SELECT cls, field, arg_min(owner, n) AS owner, min(n) AS depth FROM up JOIN f USING (owner) GROUP BY cls, field"""
)
def inherit_fields(spark, sf):
    p = table(spark, sf, "part")
    classes = p.select(F.col("p_partkey").alias("cls"), F.expr("CASE WHEN p_partkey > 10 THEN p_partkey div 3 END").alias("base"))
    fields = p.select(F.col("p_partkey").alias("owner"), F.explode(F.array_distinct(F.array("p_brand", "p_type"))).alias("field"))
    return graph.inherited_fields(classes, fields)


@query(
    """WITH d AS (SELECT n_nationkey, n_regionkey, left(n_name, 1) AS name FROM nation), u AS (SELECT s_suppkey, s_nationkey, chr(65 + CAST(s_suppkey % 26 AS INTEGER)) AS name FROM supplier),
    t AS (SELECT s_suppkey, d.n_nationkey AS def, CASE WHEN d.n_nationkey = s_nationkey THEN 1 WHEN d.n_regionkey = n.n_regionkey THEN 2 ELSE 3 END AS tier FROM u JOIN nation n ON n.n_nationkey = s_nationkey JOIN d ON d.name = u.name),
    b AS (SELECT s_suppkey, tier, count(*) AS c, min(def) AS def FROM t GROUP BY s_suppkey, tier QUALIFY tier = min(tier) OVER (PARTITION BY s_suppkey))
    SELECT u.s_suppkey, CASE WHEN c = 1 THEN def END AS def FROM u LEFT JOIN b USING (s_suppkey)"""
)
def name_resolution(spark, sf):
    """A name's definition in the own place, else in the neighbourhood, else anywhere, if it is the only one there."""
    n = table(spark, sf, "nation")
    defs = n.select(F.col("n_nationkey").alias("def"), F.col("n_regionkey").alias("def_region"), F.left("n_name", F.lit(1)).alias("name"))
    uses = table(spark, sf, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "s_nationkey", "n_regionkey", F.char((F.col("s_suppkey") % 26 + 65)).alias("name"))
    tier = F.when(F.col("def") == F.col("s_nationkey"), 1).when(F.col("def_region") == F.col("n_regionkey"), 2).otherwise(3)
    found = matching.best_tier(uses.join(defs, "name").withColumn("tier", tier), by=["s_suppkey"]).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("c"), F.min("def").alias("d"))
    return uses.select("s_suppkey").join(found, "s_suppkey", "left").select("s_suppkey", F.when(F.col("c") == 1, F.col("d")).alias("def"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'key|token|secret|password') THEN '***' ELSE text END AS shown FROM documents")
def secret_mask(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(R.is_secret_name(F.col("text")), "***").otherwise(F.col("text")).alias("shown"))


@query(
    """WITH m AS (SELECT o_orderkey AS k, o_custkey AS h FROM orders), w AS (SELECT DISTINCT CASE WHEN l_linenumber > 1 THEN -l_orderkey ELSE l_orderkey + 3 * (l_orderkey % 2) END AS k, l_suppkey AS h FROM lineitem),
    hit AS (SELECT m.k FROM m WHERE k IN (SELECT k FROM w)), rest AS (SELECT m.k, m.h FROM m WHERE k NOT IN (SELECT k FROM hit)), wr AS (SELECT h, max(k) AS wk FROM w GROUP BY h)
    SELECT k, 'agreed' AS state, k AS witness FROM hit UNION ALL SELECT rest.k, CASE WHEN wk IS NULL THEN 'model_only' ELSE 'handler' END, wk FROM rest LEFT JOIN wr USING (h)
    UNION ALL SELECT DISTINCT w.k, 'witness_only', w.k FROM w WHERE k NOT IN (SELECT k FROM hit) AND k NOT IN (SELECT wk FROM rest JOIN wr USING (h))"""
)
def witness_crosscheck(spark, sf):
    """Model rows by identity, then by handler (the last route of a handler stands for it); witnesses that nothing used are omissions."""
    m = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("h"))
    seen = F.when(F.col("l_linenumber") > 1, -F.col("l_orderkey")).otherwise(F.col("l_orderkey") + 3 * (F.col("l_orderkey") % 2))
    w = table(spark, sf, "lineitem").select(seen.alias("k"), F.col("l_suppkey").alias("h")).distinct()
    hit = m.join(w.select("k"), "k", "left_semi").select("k")
    rest = m.join(w.select("k"), "k", "left_anti")
    placed = rest.join(w.groupBy("h").agg(F.max("k").alias("witness")), "h", "left").select("k", F.when(F.col("witness").isNull(), "model_only").otherwise("handler").alias("state"), "witness")
    used = hit.unionByName(placed.where("witness is not null").select(F.col("witness").alias("k"))).distinct()
    omitted = w.select("k").distinct().join(used, "k", "left_anti").select("k", F.lit("witness_only").alias("state"), F.col("k").alias("witness"))
    return hit.select("k", F.lit("agreed").alias("state"), F.col("k").alias("witness")).unionByName(placed).unionByName(omitted)


@query(
    """WITH e AS (SELECT doc_id FROM labels WHERE quality = 1), f AS (SELECT l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE d.n_chars > 500),
    n AS (SELECT (SELECT count(DISTINCT doc_id) FROM e) AS n_expected, (SELECT count(DISTINCT doc_id) FROM f) AS n_found, (SELECT count(*) FROM (SELECT doc_id FROM e INTERSECT SELECT doc_id FROM f)) AS n_common),
    r AS (SELECT *, n_common / n_expected AS recall, n_common / n_found AS precision FROM n) SELECT n_expected, n_found, n_common, round(recall, 9) AS recall, round(precision, 9) AS precision, round(2 * recall * precision / (recall + precision), 9) AS f1 FROM r"""
)
def set_accuracy(spark, sf):
    labels = table(spark, sf, "labels")
    found = labels.join(table(spark, sf, "documents").where("n_chars > 500").select("doc_id"), "doc_id", "left_semi")
    out = diff.accuracy(labels.where("quality = 1"), found, ["doc_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("recall", "precision", "f1")})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def changed_since(spark, sf):
    o = table(spark, sf, "orders")
    anchor = o.agg((F.max("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("anchor"))
    recent = o.join(F.broadcast(anchor), F.col("o_orderdate") >= F.col("anchor"))  # one row
    return recent.join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query(
    """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'old' ELSE sha256(text) END AS sha FROM documents), n AS (SELECT CASE WHEN doc_id % 11 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, sha256(text) AS sha FROM documents)
    SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN b.sha = n.sha THEN 'unchanged' ELSE 'modified' END AS state FROM b FULL JOIN n ON b.doc_id = n.doc_id"""
)
def incremental_refresh(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    before = d.withColumn("sha", F.when(F.col("doc_id") % 9 == 0, "old").otherwise(F.col("sha")))
    return incremental.refresh(before, d.withColumn("doc_id", F.when(F.col("doc_id") % 11 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id"))), "doc_id", "sha")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def retention_topk(spark, sf):
    return incremental.newest(table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def audit_tail(spark, sf):
    return incremental.tail(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 25)


@query(
    """WITH c AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders), s AS (SELECT CASE WHEN o_orderkey % 6 = 0 THEN -o_orderkey ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders)
    SELECT k, action FROM (SELECT coalesce(c.k, s.k) AS k, CASE WHEN c.k IS NULL THEN 'restore' WHEN s.k IS NULL THEN 'remove' WHEN c.v IS DISTINCT FROM s.v THEN 'change' END AS action FROM c FULL JOIN s ON c.k = s.k) WHERE action IS NOT NULL"""
)
def rollback_diff(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    before = o.withColumn("v", F.when(F.col("k") % 4 == 0, "X").otherwise(F.col("v"))).withColumn("k", F.when(F.col("k") % 6 == 0, -F.col("k")).otherwise(F.col("k")))
    return diff.rollback(o, before, "k", "v")


@query("SELECT o_orderkey, epoch_us(TIMESTAMP '1998-01-01 00:00:00') - epoch_us(o_orderdate) > 24 * 3600000000 AS expired FROM orders")
def plan_ttl(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", incremental.expired(F.col("o_orderdate").cast("timestamp"), F.lit("1998-01-01 00:00:00").cast("timestamp"), 24).alias("expired"))


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang, source")
def corpus_summary(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(
    """SELECT user_id, event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY user_id, event_type"""
)
def witness_counts(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS codes FROM lineitem GROUP BY l_orderkey")
def status_codes(spark, sf):
    codes = F.array_sort(F.collect_set("l_linenumber")).cast("array<string>")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(codes, ",").alias("codes"))


@query("SELECT 'GET:' || p AS key, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"(/[^\"?#]*)', 1)) AS p FROM pages) GROUP BY p")
def mined_routes(spark, sf):
    mined = mining.quoted_paths(table(spark, sf, "pages"), "page_id", "html", 'href="(/[^"?#]*)')
    return mined.groupBy(F.concat(F.lit("GET:"), "path").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH RECURSIVE c AS (SELECT 'T' || p_partkey AS name, unnest(list_distinct(['T' || (p_partkey * 7 % 1009 + 1), 'T' || p_size])) AS dst FROM part), ok AS (SELECT name, dst FROM c WHERE dst IN (SELECT 'T' || p_partkey FROM part)),
    w AS (SELECT name AS owner, dst AS name, 1 AS depth FROM ok UNION ALL SELECT w.owner, ok.dst, w.depth + 1 FROM w JOIN ok ON ok.name = w.name WHERE w.depth < 3)
    SELECT owner, name, min(depth) AS depth FROM w WHERE owner <> name GROUP BY owner, name"""
)
def type_expansion(spark, sf):
    text = F.concat(F.lit("uses T"), F.col("p_partkey") * 7 % 1009 + 1, F.lit(" and T"), "p_size")
    return context.expand_types(table(spark, sf, "part").select(F.concat(F.lit("T"), "p_partkey").alias("name"), text.alias("text")))


@query(
    """WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS total, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p, unnest(string_split(text, chr(10))) AS body FROM documents),
    f AS (SELECT doc_id, total, p, CASE WHEN p - 3 > lag(p + 3) OVER (PARTITION BY doc_id ORDER BY p) + 1 THEN 1 ELSE 0 END AS new FROM l WHERE contains(body, ' the ')),
    g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS i FROM f)
    SELECT doc_id, CAST(greatest(1, min(p) - 3) AS INTEGER) AS lo, CAST(least(max(total), max(p) + 3) AS INTEGER) AS hi FROM g GROUP BY doc_id, i"""
)
def mention_windows(spark, sf):
    return context.line_windows(table(spark, sf, "documents"), "doc_id", "text", " the ")
