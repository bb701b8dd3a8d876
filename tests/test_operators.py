"""Operators on small, hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import canonical, routes as R
from ledgerline.operators import budget, context, dedupe, diff, evidence, filters, graph, incremental, intervals, matching, merge, plan, retrieval, scoring, stores
from ledgerline.sources import files, mining
from ledgerline.streaming.refresh import refresh_stream


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_normalize_path(spark):
    cases = {"users/": "/users", "/a/<int:id>/": "/a/{param}", "/a/:x/b": "/a/{param}/b", "/{y}//": "/{param}/", "/": "/", "": "/"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], ["p", "e"])
    assert df.where(R.normalize_path(F.col("p")) != F.col("e")).count() == 0


def test_text_rules(spark):
    assert one(spark, R.url_path(F.col("u")), u="https://h.example/a/b?x#y") == "/a/b"
    assert one(spark, R.placeholder_names(F.col("u")), u="/{a}/:b/<int:c>")[:2] == ["a", "b"]
    assert one(spark, R.header_name(F.col("u")), u="x_api_key") == "X-Api-Key"
    assert one(spark, R.is_confined(F.col("u")), u="../x") is False and one(spark, R.is_confined(F.col("u")), u="a/b") is True
    assert one(spark, R.python_type(F.col("u")), u="Int") == "integer" and one(spark, R.python_type(F.col("u")), u="long") == "unknown" and one(spark, R.script_type(F.col("u")), u="X[]") == "array"


def test_canonical_json(spark):
    a = json.dumps({"id": 1, "request": {"header": [{"key": "b"}, {"key": "a"}], "description": "", "body": {"raw": '{"z": 1, "a": 2}'}}})
    b = json.dumps({"request": {"body": {"raw": '{"a":2,"z":1}'}, "header": [{"key": "a"}, {"key": "b"}]}, "event": []})
    df = spark.createDataFrame([(a, b), (a, "no json")], ["a", "b"]).select((canonical.canonical_json(F.col("a")) == canonical.canonical_json(F.col("b"))).alias("x"))
    assert [r.x for r in df.collect()] == [True, None]


def test_diff_and_merge(spark):
    built = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, None), ("c", 4, "z")], "k string, o int, v string")
    live = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("d", 3, "q"), ("c", 1, "zz")], "k string, o int, v string")
    assert dict(map(tuple, diff.classify(built, live, "k", "o", ["v"]).collect())) == {"a": "unchanged", "b": "unchanged", "c": "modified", "d": "deprecated"}
    out = merge.owned_merge(live.selectExpr("k", "v as code", "'' as note"), built.where("o <> 2").selectExpr("k", "v as code", "'n' as note"), "k", ["code"], ["note"])
    assert {tuple(r) for r in out.collect()} == {("a", "x", "n"), ("b", None, "n"), ("c", "z", "n"), ("d", "q", None)}
    assert dedupe.precedence_union(built.select("k", "o"), live.select("k", "o"), "k", "o").where("overridden").count() == 3
    assert {r.action for r in diff.rollback(built.where("o <> 2"), live, "k", "v").collect()} == {"restore", "change"}


def test_evidence(spark):
    text = "a  \nb\nc"
    sha = one(spark, R.snippet_hash(F.array(F.lit("a"), F.lit("b"))), x=1)
    rows = [("f", 1, 2, sha, ""), ("f", 1, 2, sha, "b"), ("f", 1, 2, sha, "zz"), ("f", 2, 3, sha, ""), ("f", 2, 9, "old", ""), ("f", 9, 9, sha, ""), ("f", 2, 1, sha, ""), ("f", 0, 1, sha, ""), ("none", 1, 1, sha, ""), ("../f", 1, 2, sha, ""), ("f", 1, 3, "never", "")]
    claims = spark.createDataFrame(rows, "file string, line_start int, line_end int, snippet_sha256 string, symbol string")
    past = spark.createDataFrame([("f", 2, 9, "old"), ("f", 1, 3, "other")], "file string, line_start int, line_end int, past_sha256 string")
    got = evidence.audit(claims, spark.createDataFrame([("f", text)], ["file", "text"]), past=past)
    found = {(r.file, r.line_start, r.line_end, r.symbol): r.verdict for r in got.collect()}
    want = ["verified", "verified", "unreadable", "stale", "stale", "stale", "unreadable", "unreadable", "unreadable", "confinement_violation", "fabricated"]
    assert found == {(f, lo, hi, symbol): v for (f, lo, hi, _, symbol), v in zip(rows, want)}
    assert {r.file: r.verdict for r in evidence.worst(got, "file").collect()} == {"f": "fabricated", "none": "unreadable", "../f": "confinement_violation"}


def test_rings_and_long_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(40, 38), (100, 101), (101, 100)]
    classes = spark.createDataFrame(chain, "cls long, base long")
    up = {(r.cls, r.owner): r.depth for r in graph.ancestors(classes).collect()}
    assert up[(0, 40)] == 40 and up[(100, 101)] == 1 and up[(100, 100)] == 0 and (0, 100) not in up
    ok = {r.cls: r.fully_resolved for r in graph.resolved_classes(classes.union(spark.createDataFrame([(7, 999), (50, -1)], "a long, b long")), [-1]).collect()}
    assert ok[7] is False and ok[0] is False and ok[8] is True and ok[50] is True and ok[100] is True
    nodes = spark.createDataFrame([(1, "/root", True), (2, "/b", False), (3, "/c", False), (4, "/d", False), (8, "/x", False), (9, "/y", False)], "node long, prefix string, is_root boolean")
    edges = spark.createDataFrame([(1, 2, "/m", 1), (9, 2, "/late", 2), (2, 3, "", 1), (8, 9, "", 1), (9, 8, "", 1)], "parent long, child long, prefix string, ord long")
    got = {r.node: (r.path, r.resolved) for r in graph.first_mounts(edges, nodes).collect()}
    assert got == {1: ("/root", True), 2: ("/root/m/b", True), 3: ("/root/m/b/c", True), 4: ("/d", False), 8: ("/x", False), 9: ("/y", False)}
    three = spark.createDataFrame([(1, 2, "/a", 1), (2, 3, "/b", 1), (3, 1, "/c", 1), (1, 4, "/d", 1)], "parent long, child long, prefix string, ord long")
    got = {r.node: r.resolved for r in graph.first_mounts(three, spark.createDataFrame([(i, "", False) for i in range(1, 5)], "node long, prefix string, is_root boolean")).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False}


def test_stores(spark, tmp_path):
    docs = spark.createDataFrame([("a",), ("b",), ("a",)], "content string")
    folder = str(tmp_path / "docs")
    assert stores.load_documents(spark, folder) is None
    stores.save_by_content(docs, folder)
    stores.save_by_content(docs, folder)  # nothing new
    assert sorted(r.content for r in stores.load_documents(spark, folder).collect()) == ["a", "b"]
    derive = lambda f: f.select("path", "sha256", F.lit("new").alias("made"))
    before = spark.createDataFrame([("x", "1", "old"), ("y", "2", "old"), ("gone", "3", "old")], "path string, sha256 string, made string")
    now = spark.createDataFrame([("x", "1"), ("y", "9"), ("z", "4")], "path string, sha256 string")
    assert {r.path: r.made for r in stores.refreshed(now, before, derive).collect()} == {"x": "old", "y": "new", "z": "new"}
    assert stores.refreshed(now, None, derive).count() == 3
    now.withColumn("version", F.lit(2)).write.parquet(str(tmp_path / "index"))
    assert stores.load_version(spark, str(tmp_path / "index"), 2).count() == 3 and stores.load_version(spark, str(tmp_path / "index"), 3) is None and stores.load_version(spark, str(tmp_path / "no"), 2) is None
    assert stores.prune(spark.createDataFrame([(c, i) for c in ("a", "ab") for i in range(30)], "collection_id string, snapshot_id int"), 20).groupBy("collection_id").count().where("count = 20").count() == 2
    h = plan.state_hash(docs, "content").first().hash
    assert plan.checked_apply(docs, h, docs, "content") is docs
    with pytest.raises(RuntimeError):
        plan.checked_apply(docs, h, docs.limit(1), "content")
    found = plan.found_environment(spark.createDataFrame([("1", "dev"), ("2", "live")], "id string, name string"), F.lit("7"), F.lit("live")).collect()
    assert [r.id for r in found] == ["2"]


def test_scan_and_trail(spark, tmp_path):
    for path in ("src/a.tsx", "src/b.go", "env/c.py", ".git/d.py", "coverage/e.js", "x.yaml", "y.txt"):
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text("text of " + path)
    got = files.scan(spark, str(tmp_path / "tree"))
    assert {r.path: r.language for r in got.collect()} == {"src/a.tsx": "typescript", "src/b.go": "go", "x.yaml": ""}
    wanted = spark.createDataFrame([("./src/x/../a.tsx",), ("src//a.tsx",), ("../src/b.go",)], "path string")
    assert [r.path for r in files.only(got, wanted).collect()] == ["src/a.tsx"]
    trail = str(tmp_path / "trail")
    files.append_events(spark.createDataFrame([(1, "x")], "n int, e string"), trail)
    files.append_events(spark.createDataFrame([(2, "y")], "n int, e string"), trail)
    assert files.read_events(spark, trail, "n int, e string").count() == 2
    assert spark.read.parquet(files.save_version(spark.range(3), str(tmp_path / "v"))).count() == 3


def test_refresh_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("p", 1, "old"), ("p", 2, "new"), ("q", 1, "q")], "path string, ts int, v string").write.parquet(source)
    for _ in range(2):  # a second run finds nothing new
        refresh_stream(spark.readStream.schema("path string, ts int, v string").parquet(source), str(tmp_path / "out"), str(tmp_path / "cp"), lambda rows: rows).awaitTermination()
    assert {r.path: r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"p": "new", "q": "q"}


def test_retrieval_and_sources(spark):
    symbols = spark.createDataFrame([(1, "/users/{id}"), (2, "/api/users/:x"), (3, "/users/{id}/posts"), (4, "/other")], "id int, path string")
    targets = spark.createDataFrame([("a", "GET", "/users/<int:n>"), ("b", "GET", "/posts"), ("c", "GET", "/api/users")], "target string, method string, path string")
    assert sorted((r.target, r.id, r.tier) for r in retrieval.path_seeds(symbols, targets).collect()) == [("a", 1, 1), ("b", 3, 2), ("c", 2, 3)]
    lines = spark.createDataFrame([("m.py", i, "use users here" if i in (2, 5, 30) else "-", 32) for i in range(1, 33)], "file string, line int, text string, total int")
    got = retrieval.mount_windows(lines, spark.createDataFrame([("m.py", "u.py", "users")], "src string, dst string, token string"))
    assert sorted((r.lo, r.hi) for r in got.collect()) == [(1, 8), (27, 32)]
    hints = spark.createDataFrame([("f", ["/own"], ["/api"])], "file string, own array<string>, outer array<string>")
    found = retrieval.composed_candidates(spark.createDataFrame([(1, "f", "get", "/x"), (2, "f", "GET", "/x/"), (3, "g", "", "/x")], "id int, file string, method string, path string"), hints)
    assert sorted((r.method, r.path, r.id) for r in found.collect()) == [("", "/x", 3), ("GET", "/api/own/x", 1), ("GET", "/api/x", 1), ("GET", "/own/x", 1), ("GET", "/x", 1)]
    routes = spark.createDataFrame([(1, None), (2, "op")], "id int, ref string")
    assert filters.of_changed_files(routes, "ref", spark.createDataFrame([("z.py",)], "file string"), "file").count() == 2  # no reference names a file
    assert filters.in_scope(spark.createDataFrame([("u", "a/b")], "uid string, file string"), None, "b").count() == 1


def test_intervals(spark):
    a = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 20, 25)], "u int, a_id int, a_lo long, a_hi long")
    b = spark.createDataFrame([(1, 7, 10, 30), (1, 8, 11, 12)], "u int, b_id int, b_lo long, b_hi long")
    assert sorted((r.a_id, r.b_id) for r in intervals.overlapping(a, b, "u", 4).collect()) == [(1, 7), (2, 7)]
    hits = spark.createDataFrame([(1, 5), (1, 8), (1, 30)], "u int, at long")
    assert sorted(tuple(r) for r in intervals.merged(hits, "u", "at", 2).collect()) == [(1, 3, 10, 2), (1, 28, 32, 1)]


def test_scores(spark):
    b = F.lit
    assert one(spark, scoring.fact_score(b(True), b("agree"), b(False), b(False), b(True), b(1), b(0.5)), x=1) == 68  # 67.5, half to even
    assert one(spark, scoring.fact_score(b(True), b("agree"), b(False), b(True), b(True), b(1), b(1.0)), x=1) == 95
    assert one(spark, scoring.gate_action(b(75)), x=1) == "flag" and one(spark, scoring.gate_action(b(10), allow_below=True), x=1) == "needs_approval"
    assert one(spark, scoring.grade(b(True), b(True), b(False), b(False), b(True), b(None).cast("boolean")), x=1) == "E3"


def test_matching_and_graph(spark):
    df = spark.createDataFrame([("get_user",), ("user",), ("user_x",)], ["n"])
    assert [r.n for r in matching.match_target(df, "n", "USER").collect()] == ["user"]
    paths = spark.createDataFrame([("a/b/c.py",), ("x.py",)], ["p"])
    units = spark.createDataFrame([("a",), ("a/b",)], ["root"])
    assert {r.p: r.root for r in matching.longest_prefix(paths, "p", units, "root").collect()} == {"a/b/c.py": "a/b", "x.py": None}
    edges = spark.createDataFrame([(1, 2, "/b"), (2, 1, "/back"), (1, 3, "/c"), (2, 3, "/d")], "parent int, child int, prefix string")
    roots = spark.createDataFrame([(1, "/a")], "node int, path string")
    assert {tuple(r) for r in graph.mount_paths(edges, roots).collect()} == {(1, "/a"), (2, "/a/b"), (3, "/a/c"), (3, "/a/b/d")}


def test_context(spark):
    symbols = spark.createDataFrame([("A", "uses B and C"), ("B", "uses D, A"), ("D", "uses E"), ("E", "F"), ("F", ""), ("C", ""), ("C", "D")], "name string, text string")
    got = {(r.owner, r.name, r.depth) for r in context.expand_types(symbols).collect()}
    assert {g for g in got if g[0] == "A"} == {("A", "B", 1), ("A", "D", 2), ("A", "E", 3)}
    assert ("D", "F", 2) in got and not any(g[0] == "C" for g in got)
    docs = spark.createDataFrame([(1, "x\n" + "o\n" * 9 + "x\no\nx"), (2, ""), (3, None)], "d int, t string")
    assert sorted(tuple(r) for r in context.line_windows(docs, "d", "t", "x").collect()) == [(1, 1, 4), (1, 8, 13)]


def test_budget_and_increments(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 2000, 500), (1, 1, 1, 200, 50), (1, 2, 1, 40, 10), (1, 3, 2, 40, 10)], "k int, ord long, rank int, length int, cost long")
    assert tuple(budget.fit(chunks, "k", 560).first()) == (1, 544, 3, "0,2,3")
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], ["p", "s"])
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], ["p", "s"])
    assert dict(map(tuple, incremental.refresh(before, now, "p", "s").collect())) == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "added"}
    assert sorted(r.p for r in incremental.to_process(before, now, "p", "s").collect()) == ["b", "d"]


def test_files_and_mining(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "app.py").write_text("@app.get('/items/{id}')\ndef f(): pass\n")
    (tmp_path / "node_modules" / "x.js").write_text("x")
    (tmp_path / "r.http").write_text("GET https://h/a?b=1\nnope\nPOST {{base}}/c\n")
    (tmp_path / "spec.json").write_text(json.dumps({"paths": {"/p": {"get": {"summary": "s"}, "x-note": {}}}}))
    found = files.scan(spark, str(tmp_path))
    assert {r.path: r.language for r in found.collect()} == {"src/app.py": "python", "r.http": "", "spec.json": ""}
    code = found.where("language = 'python'").withColumnRenamed("path", "file")
    assert [(r.method, r.path) for r in mining.candidate_lines(code, "file", "text").collect()] == [("GET", "/items/{id}")]
    http = found.where("path = 'r.http'").withColumnRenamed("path", "file")
    assert [(r.line, r.method, r.path) for r in mining.request_lines(http, "file", "text").orderBy("line").collect()] == [(1, "GET", "/a"), (3, "POST", "/c")]
    spec = found.where("path = 'spec.json'").withColumnRenamed("path", "file")
    assert [(r.method, r.path) for r in mining.spec_routes(spec, "file", "text").collect()] == [("GET", "/p")]


def test_chains_have_no_depth_limit(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(20)] + [("c20", "c0")], "cls string, base string")
    fields = spark.createDataFrame([("c20", "f")], "owner string, field string")
    got = {r.cls: (r.owner, r.depth) for r in graph.inherited_fields(chain, fields).collect()}
    assert got == {f"c{i}": ("c20", 20 - i) for i in range(21)}
    edges = chain.selectExpr("cls AS parent", "base AS child", "'/p' AS prefix")
    paths = graph.mount_paths(edges, spark.createDataFrame([("c0", "")], "node string, path string")).collect()
    assert {(r.node, r.path) for r in paths} == {(f"c{i}", "/p" * i) for i in range(21)}
