"""Schemas, history, cited classes, reports and versioned tables on small rows: nulls, empty tables, ties, damage and races."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import evidence, graph, items, names, plan, temporal, versions
from ledgerline.sources import schemas


def fields(spark, parts, **more):
    text = json.dumps({"components": {"schemas": parts}, **more})
    specs = spark.createDataFrame([("f", text, "x"), ("bad", "{", "x"), ("none", None, "x"), ("list", "[1]", "x")], "file string, text string, node string")
    known = schemas.components(specs, "file", "text")
    meant = F.parse_json(F.concat(F.lit('{"$ref": "'), "ref", F.lit('"}')))
    found = schemas.resolved_schemas(known.select("file", F.col("ref").alias("root"), meant.alias("node")), known).collect()
    return {(r.root.split("/")[-1], r.path): (r.depth, r.type, r.required) for r in found}


def test_schema_rings_and_merges(spark):
    ref = lambda n: {"$ref": f"#/components/schemas/{n}"}
    text = {"type": "string"}
    got = fields(
        spark,
        {
            "A": {"type": "object", "required": ["b"], "properties": {"b": ref("B"), "a.b": text, "t": True}},
            "B": {"type": "object", "properties": {"a": ref("A"), "b": ref("B")}},
            "Twice": {"allOf": [ref("Over"), ref("Base"), {"properties": {"z": text}, "required": ["x"]}]},
            "Over": {"allOf": [ref("Base"), {"properties": {"x": {"type": "integer"}}}]},
            "Base": {"type": "object", "properties": {"x": text}},
            "Self": ref("Self"),
            "Rows": {"type": "array", "items": ref("Base")},
        },
        definitions={"Old": {"type": "object", "properties": {"q": {"type": "array", "items": ref("Base")}}}},
    )
    assert got["A", "b"] == (0, "object", True) and got["A", "b.a"] == (1, "unknown", False)  # the ring ends at its start
    assert got["A", "b.b.b.b.b"] == (4, "object", False) and ("A", "b.b.b.b.b.b") not in got  # other rings end at the depth
    assert got["A", "a\\.b"] == (0, "string", False) and got["A", "t"] == (0, "unknown", False)
    assert got["Twice", "x"] == (0, "integer", True) and got["Twice", "z"] == (0, "string", False)  # Base counts where it is met first
    assert not [k for k in got if k[0] in ("Self", "Rows")]  # no properties of their own
    assert got["Old", "q[]"] == (1, "object", True) and got["Old", "q[].x"] == (2, "string", False)


def test_schemas_of_nothing(spark):
    specs = spark.createDataFrame([], "file string, text string")
    known = schemas.components(specs, "file", "text")
    assert schemas.resolved_schemas(known.select("file", F.col("ref").alias("root"), "node"), known).collect() == []


def test_as_of(spark):
    r = random.Random(1)
    versions_ = [(r.choice("ab"), r.randint(-50, 300)) for _ in range(60)] + [(None, 3), ("a", 7), ("a", 7)]
    points = [(i, r.choice(["a", "b", "c", None]), r.choice([None, r.randint(-80, 400)])) for i in range(300)] + [(0, "a", 7)]
    for width in (1, 40, 10_000):
        got = temporal.as_of(spark.createDataFrame(points, "id int, k string, at long"), spark.createDataFrame(versions_, "k string, v long"), "k", "at", "v", width).collect()
        brute = lambda k, t: max((v for w, v in versions_ if k is not None and w == k and t is not None and v <= t), default=None)
        assert len(got) == len(points) and all(x.v == brute(x.k, x["at"]) for x in got)


def test_evidence_at_a_commit(spark):
    digest = lambda x: spark.range(1).select(F.sha2(F.lit(x), 256)).first()[0]
    claims = [("now", "f", "c2", 1, 1, digest("new"), ""), ("was", "f", "c2", 1, 1, digest("old"), ""), ("never", "f", "c2", 1, 1, digest("no"), ""), ("before", "f", "c0", 1, 1, digest("no"), ""), ("unknown", "f", "?", 1, 1, digest("no"), ""), ("none", "f", None, 1, 1, digest("no"), ""), ("long", "f", "c2", 1, 9, digest("old"), ""), ("deleted", "f", "c9", 1, 1, digest("old"), "")]
    schema = "id string, file string, commit string, line_start int, line_end int, snippet_sha256 string, symbol string"
    files = spark.createDataFrame([("f", "new\n")], "file string, text string")
    past = spark.createDataFrame([("f", 1, "old\n"), ("f", 8, None)], "file string, at long, text string")
    commits = spark.createDataFrame([("c0", 0), ("c2", 2), ("c9", 9)], "commit string, at long")
    got = {r.id: r.verdict for r in evidence.audit_at_commit(spark.createDataFrame(claims, schema), files, past, commits).collect()}
    assert got == {"now": "verified", "was": "stale", "never": "fabricated", "before": "stale", "unknown": "stale", "none": "stale", "long": "fabricated", "deleted": "stale"}


def test_cited_classes(spark):
    r = random.Random(4)
    symbols = [(i, i, r.choice("fg"), r.choice(["class", "class", "function"]), r.choice("XYZ"), a := r.randint(1, 300), a + r.choice([0, 3, 150])) for i in range(60)]
    cites = [(i, o, r.choice("fgh"), r.choice(["X", "Y", "", None]), a := r.randint(1, 400), a + r.choice([0, 5, 90])) for i in range(80) for o in range(r.randint(0, 3))]
    got = {x.id: x.cls for x in evidence.cited_classes(spark.createDataFrame(cites, "id int, ord int, file string, symbol string, line_start int, line_end int"), spark.createDataFrame(symbols, "cls int, ord int, file string, kind string, name string, line_start int, line_end int"), 16).collect()}
    want = {}
    for i, _, file, symbol, a, b in sorted(cites, key=lambda c: c[:2]):
        there = [s for s in symbols if s[2] == file and s[3] == "class" and s[5] <= b and a <= s[6]]
        if i not in want and there:
            named = [s for s in there if symbol and s[4] == symbol]
            want[i] = (named or [min(there, key=lambda s: (s[6] - s[5], s[1]))])[0][0]
    assert got == want


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    assert versions.newest(spark, folder, 1).number == 0
    assert versions.publish(rows("a"), folder, 0, 1) == 1
    with pytest.raises(versions.Conflict):
        versions.publish(rows("b"), folder, 0, 1)
    assert [r.v for r in versions.newest(spark, folder, 1).rows.collect()] == ["a"]
    assert len(list((tmp_path / "index" / "data").iterdir())) == 1  # the loser's rows are gone
    (tmp_path / "index" / "log" / f"{2:020d}.json").write_text('{"data": "cut')
    (tmp_path / "index" / "log" / f"{3:020d}.json").write_text("[]")
    (tmp_path / "index" / "log" / f"{4:020d}.json").write_text('{"data": "not written", "form": 1}')
    now = versions.newest(spark, folder, 1)
    assert (now.number, now.last) == (1, 4)
    assert versions.publish(rows("c"), folder, now.last, 1) == 5
    assert versions.newest(spark, folder, 1).number == 5 and versions.newest(spark, folder, 2).rows is None


def test_state_hash(spark):
    rows = lambda values: spark.createDataFrame([(v,) for v in values], "c string")
    of = lambda values: plan.state_hash(rows(values), "c").first().hash
    many = [str(i % 4000) for i in range(6000)]
    assert of(many) == of(list(reversed(many))) != of(many[1:])
    assert len({of(v) for v in ([], [None], [""], ["a"], ["a", "a"], ["a", None], many)}) == 7


def brute_classes(edges, fields, inert):
    bases = {}
    for c, b in edges:
        bases.setdefault(c, set()).add(b)
    got, whole = {}, {}
    for c in bases:
        level, seen, depth, ok = {c}, {c}, 0, True
        while level:
            for f, o in sorted({(f, o) for o, f in fields if o in level}, key=lambda x: x[1]):
                got.setdefault((c, f), (o, depth))
            up = {b for x in level for b in bases.get(x, ()) if b is not None}
            ok = ok and all(b in bases or b in inert for b in up)
            level, depth = up - seen, depth + 1
            seen |= up
        whole[c] = ok
    return got, whole


def test_inheritance(spark):
    r = random.Random(9)
    for n, rings in ((40, False), (40, True), (6, True)):
        edges = [(c, None) for c in range(n)] + [(c, r.randrange(n) if rings else r.randrange(c)) for c in range(1, n) for _ in range(r.choice([0, 1, 1, 2]))] + [(c, r.choice([-1, -2])) for c in r.sample(range(n), 3)]
        fields = [(r.randrange(-2, n), r.choice("abcdef")) for _ in range(n)]
        table, held = spark.createDataFrame(edges, "cls int, base int"), spark.createDataFrame(fields, "owner int, field string")
        want, whole = brute_classes(edges, fields, [-1])
        assert {(x.cls, x.field): (x.owner, x.depth) for x in graph.inherited_fields(table, held).collect()} == want
        assert {x.cls: x.fully_resolved for x in graph.resolved_classes(table, [-1]).collect()} == whole


def test_long_chain_of_classes(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("cls"), F.when(F.col("id") > 0, F.col("id") - 1).otherwise(-2).alias("base"))
    found = graph.resolved_classes(chain, [-1])
    assert found.count() == n and found.where("fully_resolved").count() == 0
    assert graph.resolved_classes(chain, [-2]).where("fully_resolved").count() == n


def test_mounts_in_layers_and_rings(spark):
    layers = [(f"{i}{a}", f"{i + 1}{b}", f"/{i}") for i in range(14) for a in "xyz" for b in "xyz"]  # 3 ** 14 chains, 43 results
    found = graph.mount_paths(spark.createDataFrame(layers, "parent string, child string, prefix string"), spark.createDataFrame([("0x", "")], "node string, path string"))
    assert found.count() == 1 + 3 * 14
    r = random.Random(2)
    edges = [(r.randrange(7), r.randrange(7), r.choice(["/a", "/b", ""])) for _ in range(12)]
    want = set()

    def walk(node, path, seen):
        want.add((node, path))
        for p, c, x in edges:
            if p == node and c not in seen:
                walk(c, path + x, seen | {c})

    walk(0, "", {0})
    walk(3, "/r", {3})
    got = graph.mount_paths(spark.createDataFrame(edges, "parent int, child int, prefix string"), spark.createDataFrame([(0, ""), (3, "/r")], "node int, path string"))
    assert {tuple(x) for x in got.collect()} == want


def test_routes_applied_in_order(spark):
    r = random.Random(6)
    pick = lambda *v: r.choice(v)
    item = lambda: (pick("GET", "PUT"), pick("u", "v"), pick(None, "[]", "[a]", "[b]"), pick(None, '[{"key":"a"},{"key":"b"}]', '[{"key":"b"},{"key":"a"}]'), pick(None, '{"x":1}', '{ "x": 1 }'), pick(None, "k"), pick(None, "", "d", "e"), pick(None, "[]", "[t]"), pick(None, "[r]"), pick("", "n"))
    live, routes = [(k, *item()) for k in range(0, 30, 2)], [(k, o, *item()) for k in range(30) for o in r.sample(range(-50, 50), r.randint(0, 6))]
    kinds = ", ".join(f"{p} string" for p in items.PARTS)
    from ledgerline.functions.canonical import canonical_value

    def same(a, b):
        norm = lambda x: [canonical_value(json.loads(v), p) if p in ("header", "body") and v else v for p, v in zip(items.PARTS, x)]
        return norm(a) == norm(b)

    tidy = lambda x: tuple(None if v in ("", "[]") and p in ("variable", "description", "event", "response", "name") else v for p, v in zip(items.PARTS, x))
    state, want = {k: tidy(i) for k, *i in live}, {}
    for k, o, *new in sorted(routes, key=lambda x: x[:2]):
        new, old = tidy(new), state.get(k)
        if old is None:
            state[k] = new
        else:
            now = dict(zip(items.PARTS, old)) | {p: v for p, v in zip(items.PARTS, new) if p in ("method", "url", "body", "auth") or p in ("header", "variable") and v is not None}
            state[k] = tuple(now[p] if p not in ("description", "event", "response", "name") or now[p] is not None else v for p, v in zip(items.PARTS, new))
        want[k, o] = ("new" if old is None else "unchanged" if same(old, state[k]) else "modified", *state[k])
    for width in (10, 1000):
        got = items.applied(spark.createDataFrame(live, f"key int, {kinds}"), spark.createDataFrame(routes, f"key int, ord int, {kinds}"), width).collect()
        assert {(x.key, x.ord): (x.change, *(x[p] for p in items.PARTS)) for x in got} == want


def test_headers_have_no_order(spark):
    kinds = ", ".join(f"{p} string" for p in items.PARTS)
    item = lambda header, body: ("GET", "u", None, header, body, None, "d", None, None, "n")
    live = spark.createDataFrame([(1, *item('[{"key":"a"},{"key":"b"}]', '{"x":1}'))], f"key int, {kinds}")
    routes = spark.createDataFrame([(1, 1, *item('[{"key":"b"},{"key":"a"}]', '{ "x": 1 }')), (1, 2, *item("not json", '{"x":1}')), (1, 3, *item("other", '{"x":1}')), (1, 4, *item("other", "x"))], f"key int, ord int, {kinds}")
    assert [x.change for x in items.applied(live, routes).orderBy("ord").collect()] == ["unchanged", "modified", "modified", "modified"]


def test_names_of_a_file(spark):
    symbols = spark.createDataFrame([(1, 1, "a", "T", "class", "", "U V"), (2, 2, "b", "T", "class", "", ""), (3, 3, "b", "U", "class", "", "Own"), (4, 4, "c", "U", "class", "", ""), (5, 5, "c", "V", "class", "In", ""), (6, 6, "d", "Own", "class", "", "Own")], "sid int, ord int, file string, name string, kind string, parent string, text string")
    imports = spark.createDataFrame([("a", "c", 2, []), ("a", "b", 1, []), ("d", "c", 1, ["U"])], "src string, dst string, ord int, names array<string>")
    asked = spark.createDataFrame([("T", "a"), ("U", "a"), ("U", "d"), ("V", "a"), ("T", "x"), ("Own", "x"), ("None", "a"), (None, "a")], "name string, file string")
    got = {(x.name, x.file): (x.sid, x.tier) for x in names.resolved(asked, symbols, imports).collect()}
    assert got == {("T", "a"): (1, 1), ("U", "a"): (3, 3), ("U", "d"): (4, 2), ("Own", "x"): (6, 4)}
    assert names.expanded_types(symbols.select(F.col("sid").alias("seed"), "sid"), symbols.limit(0), imports).collect() == []
