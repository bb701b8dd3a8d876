"""URL rules, the filter audit and whitening against brute force, with nulls, empty and long values, ties, repeated rows and clashing columns."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import filter_audit as audit_module, url_filter as url_module, whitening as whitening_module
from ledgerline.llm.filter_audit import failure_masks, filter_audit
from ledgerline.llm.url_filter import RULES, Trie, url_filter
from ledgerline.llm.whitening import Summary, whiten

URLS = [
    "http://example.com/en/1", "https://www.example.com/en/", "https://WWW.Example.COM/en/a?x#y", "http://example.com/en", "http://example.com", "http://a.net/es/3#t", "http://net/fr/", "https://a.b.net/FR/", "ftp://x.org/en/", "no scheme", "", None,
    "http://example.com?/en/", "http://notexample.com/en/1", "http://a.example.com/en/../x", "http://example.com:80/en/1", "http://user@example.com/en/1", "://example.com/en/", "http://://example.com/en/", "http://.com/", "http://com./", "http://é.com/en/\nx", "http://example.com/" + "en/" * 9000, "http://" + "a." * 5000 + "net/es/x",
]
PAGES = "page_id long, url string, html string, host string, path string, rule string, verdict string"


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().translate({c: c + 32 for c in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    fits = [(h.count(".") + 1 if h else 0, len(p), v == "block", h + p, v) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def pages(spark):
    rows = [(i, u, "h", "clash", "clash", "clash", "clash") for i, u in enumerate(URLS)]
    return spark.createDataFrame(rows + rows[:3] + [(None, URLS[0], "h", "c", "c", "c", "c")], PAGES).repartition(3)


def test_url_filter(spark):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = url_filter(pages(spark), rules).collect()
    want = Counter((i, *judged(u, RULES)) for i, u in [*enumerate(URLS), *list(enumerate(URLS))[:3], (None, URLS[0])])
    assert Counter(map(tuple, got)) == want
    assert url_filter(pages(spark).limit(0), rules).collect() == []


def test_url_rules_in_several_tries(spark, monkeypatch):
    r = random.Random(5)
    hosts = ["", "com", "a.com", "b.a.com", "net", "x.net"]
    paths = ["", "/", "/a", "/ab", "/a/", "/a/b", "/a/b/", "//"]
    rules = [(r.choice(["allow", "block"]), r.choice(hosts), r.choice(paths)) for _ in range(30)]
    urls = ["http://" + r.choice(["com", "a.com", "b.a.com", "c.b.a.com", "q.net", "x.net", "org"]) + r.choice(["", "/", "/a", "/abc", "/a/b/c", "/a/bc", "//a", "/b"]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    want = {i: judged(u, rules, "block") for i, u in enumerate(urls)}
    assert {row[0]: tuple(row[1:]) for row in url_filter(df, table, "block").collect()} == want
    monkeypatch.setattr(url_module, "TRIE_RULES", 7)
    assert {row[0]: tuple(row[1:]) for row in url_filter(df, table, "block").collect()} == want


def test_url_rules_must_be_sound(spark):
    for bad in [("allow", None, "/"), ("drop", "a.com", "/"), (None, "a.com", "/"), ("block", "a.com", "/" * 5000)]:
        with pytest.raises(ValueError):
            url_filter(pages(spark), spark.createDataFrame([bad], "verdict string, host string, path string"))
    assert {r.verdict for r in url_filter(pages(spark), spark.createDataFrame([], "verdict string, host string, path string")).collect()} == {"allow"}
    assert Trie([("allow", "a.com", "/"), ("block", "a.com", "/"), ("allow", "a.com", "/")]).find("a.com", "/x") == (2, "/", "block")


DOCS = "doc_id long, text string, lang string, part string, mask int, body string, fp string"


def documents():
    r = random.Random(11)
    words = ["w%d" % i for i in range(500)] + ["Up", "A#", "é", "b"]
    texts = [" ".join(r.choice(words[: r.choice([3, 50, 504])]) for _ in range(r.choice([0, 1, 150, 199, 200, 260]))) for _ in range(40)]
    texts += [None, "", " ", "A" * 3 + "b" * 97, "A" * 3 + "é" * 96, "x y " * 300, ("long " * 3 + "%d ") * 2000, "same\ntext"]
    rows = [(i, t, ["en", None, "", "fr"][i % 4], "c", 9, "c", "c") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[r.choice([1, 2, 3, 47])], r.choice(["en", "fr", None]), "c", 9, "c", "c") for i in range(80)]
    rows += [rows[7], rows[7], rows[-1], (None, texts[1], "en", "c", 9, "c", "c"), (None, "only here", "en", "c", 9, "c", "c"), (None, "only here", "en", "c", 9, "c", "c")]
    return rows


def fails(text, doc, least):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text) if x]
    return [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), doc is not None and doc > least.get(text, doc)]


def masks(rows):
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    return [(d, lang or "", fails(t or "", d, least)) for d, t, lang, *_ in rows]


def test_failure_masks(spark):
    df = spark.createDataFrame(documents(), DOCS).repartition(7)
    want = Counter((d, p, sum(f << i for i, f in enumerate(x))) for d, p, x in masks(documents()))
    assert Counter(map(tuple, failure_masks(df).collect())) == want
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:  # many partitions, so that groups of copies, and rows that repeat an id, lie in several
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert Counter(map(tuple, failure_masks(df).collect())) == want
        for per_batch in ("1", "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
            assert Counter(map(tuple, failure_masks(df).collect())) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_of_one_fingerprint(spark, monkeypatch):
    """All texts get the same fingerprint: only full texts tell them apart, also across partitions."""
    monkeypatch.setattr(audit_module.F, "xxhash64", lambda *c: F.lit(7).cast("long") + F.length(F.lit("")))
    df = spark.createDataFrame(documents(), DOCS).repartition(5)
    want = Counter((d, p, sum(f << i for i, f in enumerate(x))) for d, p, x in masks(documents()))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        assert Counter(map(tuple, failure_masks(df).collect())) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_filter_audit(spark):
    rows = documents()
    labels = [(d, q, t) for d, q, t in zip(range(0, 180, 2), itertools.cycle([1, 0, None]), itertools.cycle([0, 1]))] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    marks = spark.createDataFrame([(*x, "clash", 1) for x in labels], "doc_id long, quality int, toxic int, part string, n int")
    got = filter_audit(spark.createDataFrame(rows, DOCS), marks)
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    want, seen = {}, masks(rows)
    for part in {p for _, p, _ in seen}:
        mine = [(d, x) for d, p, x in seen if p == part]
        for order in itertools.permutations(range(5)):
            left = mine
            for step, f in enumerate(order):
                out = [(d, x) for d, x in left if x[f]]
                left = [(d, x) for d, x in left if not x[f]]
                want[part, "".join("ABCDE"[i] for i in order), step + 1] = [len(left), len(out), sum(x[f] for _, x in mine) - len(out), sum(x[f] and sum(x) == 1 for _, x in mine), sum(d in good for d, _ in out), sum(d in toxic for d, _ in out)]
        for f in range(5):
            keys = [k for k in want if k[0] == part and k[1][k[2] - 1] == "ABCDE"[f]]
            total = sum(want[k][1] for k in keys)
            for k in keys:
                want[k] = want[k][:6] + [total]
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r[:3]): list(r[3:]) for r in got.select(*columns).collect()} == want
    assert got.count() == len(want)
    empty = spark.createDataFrame([], DOCS)
    assert filter_audit(empty, marks).collect() == []
    unlabelled = filter_audit(spark.createDataFrame(rows, DOCS), marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(unlabelled) == (0, 0, len(want))


VECTORS = "vec_id long, embedding array<float>, label int, n string, id string, component string"


def vectors(seed=3, n=300, d=12):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, d)) @ r.normal(size=(d, d)) * 0.3 + r.normal(size=d)).astype(np.float32)
    rows = [(i, v.tolist(), 1, "c", "c", "c") for i, v in enumerate(x)]
    rows += [(1000 + i, rows[4][1], None, "c", "c", "c") for i in range(100)]  # one vector many times
    rows += [(2000, None, 1, "c", "c", "c"), (2001, [], 1, "c", "c", "c"), (2002, [None] * d, 1, "c", "c", "c"), (2003, [0.5] * (d - 1) + [None], 1, "c", "c", "c"), (2004, [float("nan")] * d, 1, "c", "c", "c"), (2005, [1.0] * (d - 1) + [float("inf")], 1, "c", "c", "c"), (None, rows[9][1], 1, "c", "c", "c"), rows[5]]
    return rows + [(3000, [-0.0] * d, 1, "c", "c", "c"), (3001, [0.0] * d, 1, "c", "c", "c")]


def wanted(rows):
    """Exact moments, then numpy's own eigenvectors of the covariance."""
    sound = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in sound})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    deviation = {tuple(x): sum((n * a - b) ** 2 for a, b in zip(x, s)) for _, x in sound}
    centred = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return sound, n, s, deviation, e, v


def compare(rows, got):
    sound, n, s, deviation, e, v = wanted(rows)
    assert len(got) == 4 * len(sound)
    xs = {}
    for i, x in sound:
        xs.setdefault(i, x)
    signs = {}
    for r in got:
        x = xs[r.vec_id]
        want = np.array([(n * a - b) / n for a, b in zip(x, s)]) @ v[:, r.component - 1] / np.sqrt(e[r.component - 1])
        if abs(want) > 1e-6:
            assert signs.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(r.whitened) - abs(want)) < 1e-9 * max(1, abs(want))
        assert (r.n, r.deviation) == (n, deviation[tuple(x)])
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10 and 0 <= r.identity_error < 1e-9


def test_whitening(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = whiten(df).collect()
    compare(rows, got)
    assert Counter((r.vec_id, r.component) for r in got)[5, 1] == 2
    assert whiten(df.limit(0)).collect() == []
    assert whiten(df.where("vec_id = 2000 or vec_id = 3000")).collect() == []  # one distinct vector has no scale


def test_vectors_that_are_too_long(spark):
    long = spark.range(2).select(F.col("id").alias("vec_id"), F.array_repeat(F.col("id").cast("float"), whitening_module.MOST_DIMENSIONS + 1).alias("embedding"))
    with pytest.raises(Exception, match="aren't whitened"):
        whiten(long)


def test_whitening_merges_in_a_tree(spark, monkeypatch):
    rows = vectors(7, 700, 9)
    df = spark.createDataFrame(rows, VECTORS)
    monkeypatch.setattr(whitening_module, "FAN", 2)
    monkeypatch.setattr(whitening_module, "ROWS", 16)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        compare(rows, whiten(df.repartition(11)).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_merges_keep_all_dimensions():
    r = np.random.default_rng(1)
    x = r.integers(-300, 300, size=(500, 20)) * np.array([10**3] + [1] * 19)
    whole = Summary.of(x[:7])
    for lo, hi in ((7, 8), (8, 300), (300, 500)):
        whole = Summary.from_row(*whole.merged(Summary.of(x[lo:hi])).row())
    centred = x - x.mean(0)
    assert whole.n == 500 and whole.sums == x.sum(0).tolist() and whole.scaled.shape == (20, 20)
    assert np.abs(whole.scaled.T @ whole.scaled - centred.T @ centred).max() < 1e-13 * np.trace(centred.T @ centred)


def test_whitening_of_several_lengths_and_great_entries(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=3 if i % 2 else 5).tolist()) for i in range(60)] + [(60, [1e30, 0.0, 1.0]), (61, [-1e30, 1.0, 0.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    short = {x.component for x in got if x.vec_id % 2}
    assert short <= {1, 2, 3} and {x.component for x in got if x.vec_id == 0} == {1, 2, 3, 4}
    assert {x.n for x in got if x.vec_id == 0} == {30} and {x.n for x in got if x.vec_id == 1} == {32}
    assert all(x.deviation is None for x in got if x.vec_id in (60, 61))
