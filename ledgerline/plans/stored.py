"""Queries of stores, trails, streams, lists of files and collections as they are checked before a write, each with its DuckDB counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import filters, incremental, plan, stores
from ..sources import files, folders, specs
from ..streaming.refresh import refresh_stream
from .catalogue import query, table
from .verification import derived, duck


def _folder(spark, name: str) -> str:
    return f"{stores.shared_folder(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id AS path, sha256(coalesce(text, '')) AS sha256, CAST(length(coalesce(text, '')) AS BIGINT) AS size, 2 AS ts FROM documents")
def streamed_index(spark, sf):
    """Documents as a stream of files, each in an older and a newer state: a batch keeps the newer one, and a second run finds nothing new."""
    source, out = _folder(spark, "stream"), _folder(spark, "index")
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), text.alias("text"))
    both = docs.withColumn("ts", F.lit(2)).unionByName(docs.select("path", F.concat("text", F.lit(" old")).alias("text"), F.lit(1).alias("ts")))
    both.write.parquet(source)
    derive = lambda rows: rows.select("path", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("size"), "ts")
    for _ in range(2):
        refresh_stream(spark.readStream.schema(both.schema).parquet(source), out, f"{out}-offsets", derive).awaitTermination()
    return spark.read.parquet(out).select("path", "sha256", "size", "ts")


@query(
    """WITH n AS (SELECT 's' || lpad(CAST(t AS VARCHAR), 2, '0') AS stamp, n_nationkey, n_name, t FROM nation, (SELECT unnest(range(25)) AS t)) SELECT stamp || '-' || n_nationkey || CASE WHEN t % 2 = 0 THEN '-be_fore_1-x' ELSE '' END AS snapshot_id, CAST(n_nationkey AS VARCHAR) AS collection_id, CASE WHEN t % 2 = 0 THEN 'be fore/1-x' END AS label, n_name || t AS collection FROM n WHERE t >= 5"""
)
def snapshots(spark, sf):
    """25 snapshots of each collection, of which the newest 20 are kept; ids that begin alike don't count for each other."""
    folder, kept = _folder(spark, "snapshots"), None
    n = table(spark, sf, "nation")
    for t in range(25):
        kept = incremental.snapshot(spark, folder, n.select(F.col("n_nationkey").alias("collection_id"), F.concat("n_name", F.lit(str(t))).alias("collection")), f"s{t:02d}", "be fore/1-x" if t % 2 == 0 else None)
    return kept.select("snapshot_id", "collection_id", "label", "collection")


@query("SELECT DISTINCT 'sha256:' || sha256(p_type) AS id, p_type AS content FROM part UNION SELECT DISTINCT 'sha256:' || sha256(p_brand), p_brand FROM part")
def content_store(spark, sf):
    """Documents under the hash of what they hold: saved twice, they are there once."""
    folder, p = _folder(spark, "contents"), table(spark, sf, "part")
    stores.save_by_content(p.select(F.col("p_type").alias("content")), folder)
    stores.save_by_content(p.select(F.col("p_type").alias("content")).unionByName(p.select(F.col("p_brand").alias("content"))), folder)
    return stores.load_documents(spark, folder)


@query("SELECT event_id AS n, event_type AS event, 'ok' AS outcome FROM events UNION ALL SELECT -1 - n_nationkey, n_name, 'late' FROM nation")
def event_trail(spark, sf):
    """Events appended in two writes and read back."""
    folder = _folder(spark, "trail")
    files.append_events(table(spark, sf, "events").select(F.col("event_id").alias("n"), F.col("event_type").alias("event"), F.lit("ok").alias("outcome")), folder)
    files.append_events(table(spark, sf, "nation").select((-1 - F.col("n_nationkey")).alias("n"), F.col("n_name").alias("event"), F.lit("late").alias("outcome")), folder)
    return files.read_events(spark, folder, "n long, event string, outcome string")


_DAY = "(SELECT max(o_orderdate) FROM orders) - INTERVAL 20 DAY"


@query(
    f"""WITH c AS (SELECT o_orderkey AS commit, o_orderkey AS ord, o_orderdate AS moment FROM orders), x AS (SELECT l_orderkey AS commit, 'f' || (l_partkey % 700) AS file FROM lineitem UNION ALL SELECT NULL, 'w' || n_nationkey FROM nation),
    last AS (SELECT commit FROM c ORDER BY ord DESC LIMIT 40) SELECT DISTINCT 'last' AS mode, file FROM x WHERE commit IN (SELECT commit FROM last) UNION ALL SELECT DISTINCT 'date', file FROM x WHERE commit IN (SELECT commit FROM c WHERE moment >= CAST({_DAY} AS DATE)) UNION ALL SELECT DISTINCT 'commit', file FROM x WHERE commit > (SELECT max(o_orderkey) - 100 FROM orders) UNION ALL SELECT DISTINCT 'open', file FROM x WHERE commit IS NULL"""
)
def changed_files(spark, sf):
    """What the last 40 commits touched, what commits since a day and after a commit did, and what isn't in one; a last of 0 gives nothing."""
    o = table(spark, sf, "orders")
    commits = o.select(F.col("o_orderkey").cast("string").alias("commit"), F.col("o_orderkey").alias("ord"), F.col("o_orderdate").cast("timestamp").alias("at"))
    changes = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit"), F.concat(F.lit("f"), F.col("l_partkey") % 700).alias("file")).unionByName(table(spark, sf, "nation").select(F.lit(None).cast("string").alias("commit"), F.concat(F.lit("w"), "n_nationkey").alias("file")))
    edge = o.agg(F.max("o_orderkey").alias("k"), F.date_format(F.max("o_orderdate") - F.expr("INTERVAL 20 DAYS"), "yyyy-MM-dd").alias("day")).first()  # one row
    modes = {"last": {"last": 40}, "date": {"since": f" {edge.day} "}, "commit": {"since": str(edge.k - 100)}, "open": {}, "none": {"last": 0}}
    out = None
    for mode, how in modes.items():
        rows = incremental.changed_files(commits, changes, **how).select(F.lit(mode).alias("mode"), "file")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT DISTINCT 'src/m' || p_size || '.py' AS path, p_size AS n FROM part WHERE p_size <= 24")
def named_files(spark, sf):
    """Of the files only those that a list names, however it writes their paths, and only once."""
    p = table(spark, sf, "part")
    tree = p.select(F.concat(F.lit("src/m"), "p_size", F.lit(".py")).alias("path"), F.col("p_size").alias("n")).unionByName(p.select(F.concat(F.lit("src/m"), "p_size", F.lit(".txt")).alias("path"), F.col("p_size").alias("n")))
    k = F.col("n_nationkey")
    wanted = table(spark, sf, "nation").select(F.explode(F.array(F.concat(F.lit("./src//x/../m"), k, F.lit(".py")), F.concat(F.lit("src/m"), k, F.lit(".txt")), F.concat(F.lit("../m"), k, F.lit(".py")))).alias("path"))
    return files.only(tree, wanted, ("py",))


@query("SELECT p_partkey AS uid, p_brand AS file, 'named' AS scope FROM part WHERE p_partkey IN (3, 5, 8) UNION ALL SELECT p_partkey, p_brand, 'file' FROM part WHERE contains(p_brand, '1') UNION ALL SELECT p_partkey, p_brand, 'all' FROM part")
def scoped_rows(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("uid"), F.col("p_brand").alias("file"))
    said = lambda df, scope: df.withColumn("scope", F.lit(scope))
    return said(filters.in_scope(rows, [3, 5, 8], "1"), "named").unionByName(said(filters.in_scope(rows, None, "1"), "file")).unionByName(said(filters.in_scope(rows, None, None), "all"))


@query(
    """SELECT * FROM (SELECT 'configured' AS found_by, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'name', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE n_name = (SELECT max(n_name) FROM nation))"""
)
def known_environments(spark, sf):
    """By its configured id, and by its exact name where that id is nowhere."""
    e = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    name = F.lit(e.agg(F.max("name")).first()[0])  # one row
    return plan.found_environment(e, F.lit("7"), name).select(F.lit("configured").alias("found_by"), "id", "name").unionByName(plan.found_environment(e, F.lit("none"), name).select(F.lit("name").alias("found_by"), "id", "name"))


_ENVIRONMENTS = """SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN '[1]' WHEN 1 THEN '{"name": "", "values": []}' WHEN 2 THEN '{"name": "dev"}' WHEN 3 THEN '{"name": "dev", "values": [{"key": "a"}, {"key": ""}, 7]}' WHEN 4 THEN '{"values": 3}' ELSE '{"name": "dev", "values": [{"key": "a"}]}' END AS text FROM <part>""".replace("{", "{{").replace("}", "}}").replace("<", "{").replace(">", "}")


@query("SELECT p_partkey AS id, unnest(CASE p_size % 6 WHEN 0 THEN ['no object'] WHEN 1 THEN ['no name'] WHEN 2 THEN ['no values'] WHEN 3 THEN ['no key', 'no key'] WHEN 4 THEN ['no name', 'no values'] ELSE [] END) AS error FROM part")
def broken_environments(spark, sf):
    return filters.broken_environments(derived(spark, sf, _ENVIRONMENTS))


_COLLECTIONS = """SELECT p_partkey AS id, CASE p_size % 7 WHEN 0 THEN '[' WHEN 1 THEN '{"item": []}' WHEN 2 THEN '{"info": {"name": "c"}, "item": 7}' WHEN 3 THEN '{"info": {"name": "c"}, "item": [{"name": "A", "item": [{"name": "B", "item": []}, {"name": "B", "item": [{"request": {"method": "GET"}}]}]}]}'
 WHEN 4 THEN '{"info": {"name": "c"}, "item": [{"item": [{"name": "r", "request": {"method": "GET", "url": "/a"}}]}, {"name": "A", "item": []}, {"name": "A", "item": []}]}' WHEN 5 THEN '7' ELSE '{"info": {"name": "c"}, "item": [{"name": "r", "request": {"method": "GET", "url": "/a"}}, {"name": "A", "item": [{"name": "A", "item": []}]}]}' END AS text FROM <part>""".replace("{", "{{").replace("}", "}}").replace("<", "{").replace(">", "}")


@query(
    """SELECT p_partkey AS id, error, place FROM part JOIN (VALUES (0, 'no object', ''), (1, 'no name', ''), (1, 'no requests', ''), (2, 'no items', ''), (3, 'no key', 'A/B'), (3, 'folder twice', 'A/B'), (4, 'folder without a name', ''), (4, 'folder twice', 'A'), (5, 'no object', '')) t(k, error, place) ON p_size % 7 = k"""
)
def collection_errors(spark, sf):
    return folders.collection_errors(derived(spark, sf, _COLLECTIONS), "id", "text")


_SCRIPTS = """SELECT p_partkey AS k, concat('web/p', p_size % 7, '/s', p_partkey, '.js') AS src, CASE p_partkey % 6 WHEN 0 THEN './util' WHEN 1 THEN concat('../p', p_size % 7, '/widget') WHEN 2 THEN '../../../../lib/raw.js' WHEN 3 THEN 'react' WHEN 4 THEN './/./folder' ELSE './gone' END AS spec FROM {part}"""


@query(
    f"""WITH s AS ({duck(_SCRIPTS)}) SELECT DISTINCT src, spec, CASE k % 6 WHEN 0 THEN 'web/p' || (p_size % 7) || '/util.tsx' WHEN 1 THEN 'web/p' || (p_size % 7) || '/widget/index.ts' WHEN 2 THEN 'lib/raw.js' ELSE 'web/p' || (p_size % 7) || '/folder.mjs' END AS dst FROM s JOIN part ON p_partkey = k WHERE k % 6 IN (0, 1, 2, 4)"""
)
def script_imports(spark, sf):
    p = table(spark, sf, "part")
    at = lambda tail: p.select(F.concat(F.lit("web/p"), F.col("p_size") % 7, F.lit(tail)).alias("path"))
    there = at("/util.tsx").unionByName(at("/util.jsx")).unionByName(at("/widget/index.ts")).unionByName(at("/folder.mjs")).unionByName(at("/folder/index.ts")).unionByName(p.select(F.lit("lib/raw.js").alias("path")))
    return specs.resolved_script_imports(derived(spark, sf, _SCRIPTS).select("src", "spec"), there)
