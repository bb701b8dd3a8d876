"""What a target needs of an index: seeds, calls, mounts, prefix hints and witnesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import composed_variants
from ..functions.routes import normalize_path, wildcard
from .intervals import tightest
from .matching import best_tier
from .names import called as called_names, expanded_types
from .stores import dealt, written

MOST_WITNESSES, MOST_FILES = 12, 40


def path_seeds(symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id, tier of symbols (id, path) for targets (target, method, path): same path with placeholders as *, else one that ends so, else one that holds it; only the best tier of a target.

    Symbols and targets meet on whole path ends and whole runs of parts, exploded on the symbols' side, so that this is an equi-join."""
    parts = lambda c: F.filter(F.split(wildcard(c), "/"), lambda s: s != "")
    rows = symbols.select("id", parts(F.col("path")).alias("p"))
    at = F.sequence(F.lit(1), F.size("p"))
    runs = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(i, F.size("p")), lambda j: F.struct(F.array_join(F.slice("p", i, j - i + 1), "/").alias("key"), F.when(j < F.size("p"), 3).when(i > 1, 2).otherwise(1).alias("tier")))))
    keyed = rows.where("size(p) > 0").select("id", F.explode(runs).alias("r")).groupBy("id", "r.key").agg(F.min("r.tier").alias("tier"))
    wanted = targets.select("target", F.array_join(parts(F.col("path")), "/").alias("key"))
    return best_tier(wanted.join(keyed, "key").select("target", "id", "tier"), by=["target"])


def called(symbols: DataFrame) -> DataFrame:
    """id, callee: functions of other files that a symbol's text calls by a name that one symbol only has; one step."""
    one = symbols.where("kind = 'function'").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("callee"), F.min("file").alias("to_file")).where("n = 1")
    names = symbols.select("id", "file", F.col("name").alias("own"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1))).alias("name"))
    return names.where("name <> own").join(one, "name").where("to_file <> file").select("id", "callee").distinct()


def prefix_hints(lines: DataFrame, imports: DataFrame) -> DataFrame:
    """file, own, outer: prefixes that a file names itself, and those on lines of its importers (imports src, dst, token) that hold the token; arrays, distinct and in order.

    On lines of importers the first text in parentheses before a comma counts as a prefix, too."""
    kw = F.regexp_extract_all("text", F.lit(r"""prefix\s*=\s*["']([^"']*)["']"""), 1)
    first = F.regexp_extract_all("text", F.lit(r"""\(\s*["']([^"']*)["']\s*,"""), 1)
    mine = lines.select("file", F.explode(kw).alias("p")).groupBy("file").agg(F.array_sort(F.collect_set("p")).alias("own"))
    from_importers = lines.withColumnRenamed("file", "src").join(imports, "src").where(F.contains("text", F.col("token"))).select(F.col("dst").alias("file"), F.explode(F.concat(kw, first)).alias("p"))
    theirs = from_importers.groupBy("file").agg(F.array_sort(F.collect_set("p")).alias("outer"))
    none = F.array().cast("array<string>")
    return mine.join(theirs, "file", "full").select("file", F.coalesce("own", none).alias("own"), F.coalesce("outer", none).alias("outer"))


def composed_candidates(candidates: DataFrame, hints: DataFrame) -> DataFrame:
    """id, method, path: each candidate (id, file, method, path) under all hints of its file, the first id of equal ones."""
    none = F.array().cast("array<string>")
    rows = candidates.join(hints, "file", "left").select("id", "method", F.explode(composed_variants(F.col("path"), F.coalesce("own", none), F.coalesce("outer", none))).alias("path"))
    return rows.groupBy(F.upper("method").alias("method"), normalize_path(F.col("path")).alias("path")).agg(F.min("id").alias("id"))


def graph_witness(candidates: DataFrame, hints: DataFrame, symbols: DataFrame, width: int = 64) -> DataFrame:
    """ord, method, path, code_ref: each candidate (ord, method, path, file, line) under all hints of its file, with the tightest symbol around its line.

    Candidates without a method say too little and are left out.  Of routes alike in method and normal path the first candidate's is kept, and of its own variants the least.
    symbols: s_id, qualname, file, s_lo, s_hi."""
    none = F.array().cast("array<string>")
    rows = candidates.where("method <> ''").join(hints, "file", "left")
    paths = rows.select("ord", F.upper("method").alias("method"), "file", "line", F.explode(composed_variants(F.col("path"), F.coalesce("own", none), F.coalesce("outer", none))).alias("path"))
    first = paths.groupBy("method", normalize_path(F.col("path")).alias("key")).agg(F.min(F.struct("ord", "path", "file", "line")).alias("r")).select("method", "key", "r.*")
    points = first.select("file", F.col("ord").alias("p_id"), F.col("line").alias("p_at")).distinct()
    around = tightest(points, symbols.select("file", "s_id", "s_lo", "s_hi"), "file", width)
    named = around.join(symbols.select("s_id", "qualname"), "s_id", "left").select(F.col("p_id").alias("ord"), "qualname")
    code = F.when(F.col("qualname").isNull(), F.col("file")).otherwise(F.concat_ws("::", "file", "qualname"))
    return first.join(named, "ord", "left").select("ord", "method", "path", "key", code.alias("code_ref"))


def compared(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """key, side (agreed, first_only, second_only) of two engines' results, each key once."""
    a, b = one.select(key).distinct().withColumn("_a", F.lit(True)), two.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a") & F.col("_b"), "agreed").when(F.col("_a"), "first_only").otherwise("second_only")
    return a.join(b, key, "full").select(key, side.alias("side"))


def _trimmed(path: Column) -> Column:
    p = F.regexp_replace(path, "/+$", "")
    return F.when(p == "", "/").otherwise(p)


def _ends(text: Column) -> Column:
    """All non-empty ends of a text."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.length(text)))


def _pieces(text: Column) -> Column:
    """All pieces of a text of two characters or more."""
    starts = F.when(F.length(text) > 1, F.sequence(F.lit(1), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.length(text) - i + 1), lambda n: F.substring(text, i, n))))


#: A target that is a method and a path, and the last name before a call's end.
_METHOD_PATH = r"(?i)^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/\S*)$"
_HANDLER = r",\s*([A-Za-z_]\w*)\s*\)\s*;?\s*$"


def seeds(targets: DataFrame, symbols: DataFrame, hints: DataFrame, candidates: DataFrame) -> DataFrame:
    """target, tier, sid, file, lo, hi: where a look-up begins, for targets of all forms; each tier sees the targets that earlier ones left.

    ``METHOD /path``: symbols with a decorator whose quoted path, under the file's hints, is the target's (exact), or is how it ends (suffix), or is in it (fuzzy); placeholders
    count as * but for the last.  Where none has, candidates of that method whose path is the target's or one is the end of the other (candidate), with three lines around each, and the symbols of
    the handler that their line ends with (handler).  ``file::name``: symbols of that name (named).  A path with / or an ending: its decorated symbols (decorated), else those at its top (top).
    Other targets: symbols of that name at the top of a file (name), else any (nested).

    symbols: sid, file, name, parent, decorators; hints: file, own, outer; candidates: file, line, method, path, quote, total (the file's lines).  Paths meet in equi-joins on ends and pieces, of the targets' paths for decorators, and
    of both for candidates, so that the work grows with the lengths of paths, not with targets times symbols."""
    t = targets.select(F.col("target"), F.trim("target").alias("t")).distinct()
    t = t.withColumns({"method": F.upper(F.regexp_extract("t", _METHOD_PATH, 1)), "path": _trimmed(F.regexp_extract("t", _METHOD_PATH, 2))})
    routed, other = t.where("method <> ''"), t.where("method = ''")
    none = F.array().cast("array<string>")
    quoted = symbols.select("sid", "file", F.explode("decorators").alias("d")).select("sid", "file", F.explode(F.regexp_extract_all("d", F.lit(r"""["']([^"']*)["']"""), 1)).alias("lit"))
    paths = quoted.join(hints, "file", "left").select("sid", F.explode(composed_variants(F.col("lit"), F.coalesce("own", none), F.coalesce("outer", none))).alias("p")).distinct()
    paths = dealt(paths.withColumn("w", wildcard(F.col("p"))))  # targets' ends and pieces are more than targets, and may not be broadcast either
    wanted = routed.select("target", "path", wildcard(F.col("path")).alias("wild"))

    def met(asked: DataFrame, keys: Column, tier: int, both: bool = True) -> DataFrame:
        plain = asked.select("target", F.explode(keys(F.col("path"))).alias("k")).join(paths, F.col("k") == F.col("p"))
        found = plain.select("target", "sid")
        if both:
            found = found.unionByName(asked.select("target", F.explode(keys(F.col("wild"))).alias("k")).join(paths, F.col("k") == F.col("w")).select("target", "sid"))
        return found.distinct().withColumn("tier", F.lit(tier))

    left = lambda asked, found: asked.join(found.select("target").distinct(), "target", "left_anti")
    exact = written(met(wanted, lambda p: F.array(p), 1), "seeds")
    rest = left(wanted, exact)
    suffix = written(met(rest, _ends, 2), "seeds")
    rest = left(rest, suffix)
    fuzzy = written(met(rest, _pieces, 3, both=False), "seeds")
    rest = left(rest, fuzzy).join(routed.select("target", "method"), "target")
    c = candidates.withColumns({"p": _trimmed(F.col("path")), "k": F.monotonically_increasing_id()}).withColumn("w", wildcard(F.col("p"))).drop("path")
    c = written(c, "candidates")
    keys = [("path", "p"), ("wild", "w")]
    same = [rest.join(c.withColumnRenamed("method", "m"), F.col(a) == F.col(b)) for a, b in keys]
    longer = rest.withColumn("e", F.explode(_ends(F.col("path")))).join(c.withColumnRenamed("method", "m"), F.col("e") == F.col("p"))
    shorter = rest.join(c.withColumn("e", F.explode(_ends(F.col("p")))).withColumnRenamed("method", "m"), F.col("path") == F.col("e"))
    pick = lambda df: df.where("m = '' or m = method").select("target", "k")
    hits = pick(same[0]).unionByName(pick(same[1])).unionByName(pick(longer)).unionByName(pick(shorter)).distinct().join(c, "k")
    hits = written(hits.select("target", "file", "line", "total", F.regexp_extract("quote", _HANDLER, 1).alias("handler")), "seeds")
    blank = lambda kind: F.lit(None).cast(kind)
    lines = hits.select("target", F.lit("candidate").alias("tier"), blank("long").alias("sid"), "file", F.greatest(F.lit(1), F.col("line") - 3).alias("lo"), F.least("total", F.col("line") + 3).alias("hi")).distinct()

    named = other.where(F.contains("t", F.lit("::"))).select("target", F.replace(F.substring_index("t", "::", 1), F.lit("\\"), F.lit("/")).alias("file"), F.regexp_replace("t", r"^.*?::", "").alias("name"))
    plain = other.where(~F.contains("t", F.lit("::")))
    is_file = F.col("t").rlike(r"[/\\]|[^.]\.[^.]+$")
    of_file = plain.where(is_file).select("target", F.replace("t", F.lit("\\"), F.lit("/")).alias("file"))
    of_name = plain.where(~is_file).select("target", F.col("t").alias("name"))
    s = symbols.select(F.col("sid").cast("long").alias("sid"), "file", "name", "parent", (F.size("decorators") > 0).alias("decorated"))
    tiers = {1: "exact", 2: "suffix", 3: "fuzzy", 4: "handler", 5: "named", 6: "decorated", 7: "top", 8: "name", 9: "nested"}
    by_file = best_tier(of_file.join(s, "file").select("target", "sid", F.when(F.col("decorated"), 6).when(F.col("parent") == "", 7).alias("tier")).where("tier is not null"), by=["target"])
    by_name = best_tier(of_name.join(s, "name").select("target", "sid", F.when(F.col("parent") == "", 8).otherwise(9).alias("tier")), by=["target"])
    handlers = hits.where("handler <> ''").select("target", F.col("handler").alias("name")).distinct().join(s, "name").select("target", "sid", F.lit(4).alias("tier"))
    found = exact.unionByName(suffix).unionByName(fuzzy).unionByName(handlers).unionByName(named.join(s, ["file", "name"]).select("target", "sid", F.lit(5).alias("tier"))).unionByName(by_file).unionByName(by_name)
    name = F.element_at(F.create_map(*[F.lit(x) for pair in tiers.items() for x in pair]), F.col("tier"))
    return found.distinct().join(s, "sid").select("target", name.alias("tier"), "sid", "file", blank("int").alias("lo"), blank("int").alias("hi")).unionByName(lines)


def importers(imports: DataFrame, files: DataFrame) -> DataFrame:
    """dst, n: how many files import each file, none included."""
    n = imports.select("src", "dst").distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    return files.select(F.col("file").alias("dst")).distinct().join(n, "dst", "left").fillna(0, ["n"])


def witness_lines(corpus: DataFrame, path: str) -> DataFrame:
    """The first MOST_WITNESSES rows, by ord, of a corpus (ord, path) whose path ends with the target's or the other way round."""
    p, t = F.regexp_replace("path", "/+$", ""), F.lit(path.rstrip("/"))
    return corpus.where((p != "") & (p.endswith(t) | t.endswith(p))).orderBy("ord").limit(MOST_WITNESSES)


def busiest(symbols: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """The files with the most decorated symbols, ties by first appearance."""
    return symbols.where("decorated").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("_first")).orderBy(F.desc("n"), "_first").limit(most).drop("_first")


def mount_windows(lines: DataFrame, imports: DataFrame, pad: int = 3) -> DataFrame:
    """dst, src, lo, hi: lines of a file's importers that hold its token, with pad lines around, windows that overlap or touch as one.

    lines: file, line, text, total; imports: src, dst, token, perhaps ord: each import is looked at on its own then, and of windows that begin alike the first import's counts."""
    each = [c for c in ("ord",) if c in imports.columns]
    hits = lines.withColumnRenamed("file", "src").join(imports, "src").where(F.contains("text", F.col("token"))).select("dst", "src", *each, "line", "total").distinct()
    w = Window.partitionBy("dst", "src", *each).orderBy("line")
    new = (F.col("line") - pad > F.lag("line").over(w) + pad + 1).cast("int")
    island = F.sum(F.coalesce(new, F.lit(1))).over(w)
    found = hits.withColumn("island", island).groupBy("dst", "src", *each, "island").agg(F.greatest(F.lit(1), F.min("line") - pad).alias("lo"), F.least(F.max("total"), F.max("line") + pad).alias("hi")).drop("island")
    return found.groupBy("dst", "src", "lo").agg(F.min_by("hi", "ord").alias("hi")) if each else found


#: The parts of a context in their order; a name that a route is searched by has more characters than this.
ROLES = {"seed": 0, "type": 1, "call": 2, "mount": 3, "witness": 4}
_SHORT_NAME = 4


def witnesses(targets: DataFrame, seeds: DataFrame, corpus: DataFrame, most: int = MOST_WITNESSES) -> DataFrame:
    """target, file, line of the first ``most`` rows of the corpus (ord, path, file, line) that speak of each target: their path and the target's are one the end of the other, or it holds the
    name of a seed (target, name)."""
    t = targets.select("target", F.regexp_replace(F.regexp_extract(F.trim("target"), _METHOD_PATH, 2), "/+$", "").alias("p")).where("p <> ''").distinct()
    c = written(corpus.where("path <> ''").select("ord", "file", "line", "path", F.regexp_replace("path", "/+$", "").alias("c")), "corpus")
    whole = c.where("c = ''").select("ord", "file", "line")  # the root is the end of every path
    longer = t.select("target", F.explode(_ends(F.col("p"))).alias("c")).join(c.where("c <> ''"), "c").select("target", "ord", "file", "line")
    shorter = t.join(c.where("c <> ''").select("ord", "file", "line", F.explode(_ends(F.col("c"))).alias("p")), "p").select("target", "ord", "file", "line")
    names = seeds.where(F.length("name") > _SHORT_NAME).select("target", "name").distinct()
    named = names.join(c.select("ord", "file", "line", F.explode(F.array_distinct(F.filter(_pieces(F.col("path")), lambda x: F.length(x) > _SHORT_NAME))).alias("name")).distinct(), "name").select("target", "ord", "file", "line")
    # of the root's rows a target needs the first ones only
    roots = t.select("target").join(F.broadcast(whole.orderBy("ord").limit(most)))
    rows = longer.unionByName(shorter).unionByName(named).unionByName(roots).distinct()
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy("ord"))).where(F.col("_n") <= most).drop("_n", "ord")


def context(targets: DataFrame, symbols: DataFrame, imports: DataFrame, hints: DataFrame, candidates: DataFrame, lines: DataFrame, corpus: DataFrame) -> DataFrame:
    """target, file, lo, hi, role, rank: all that a target needs: where it begins, the types and functions that this reaches, where its files are mounted, and what speaks of it.

    Of parts that begin at the same line of a file the one of the lowest rank counts; witnesses stand beside them.  symbols: sid, ord, file, name, kind, parent, text, decorators, s_lo, s_hi."""
    found = written(seeds(targets, symbols, hints, candidates), "seeds")
    spans = symbols.select("sid", "name", "s_lo", "s_hi", F.col("file").alias("at"))
    begun = written(found.where("sid is not null").select("target", "sid").distinct().join(spans, "sid"), "seeds")
    part = lambda df, role: df.select("target", F.col("at").alias("file"), F.col("s_lo").cast("int").alias("lo"), F.col("s_hi").cast("int").alias("hi"), F.lit(role).alias("role"))
    lines_of = found.where("sid is null").select("target", "file", "lo", "hi", F.lit("seed").alias("role"))
    types = expanded_types(begun.select(F.col("target").alias("seed"), "sid"), symbols, imports).select(F.col("seed").alias("target"), "sid").join(spans, "sid")
    calls = begun.select("target", "sid").join(called_names(symbols, imports), "sid").select("target", F.col("callee").alias("sid")).distinct().join(spans, "sid")
    tokens = imports.select("src", "dst", "ord", F.explode(F.array_union("names", F.array(F.regexp_replace(F.element_at(F.split("dst", "/"), -1), r"\.[^.]*$", "")))).alias("token"))
    mounts = begun.select("target", F.col("at").alias("dst")).distinct().join(mount_windows(lines, tokens), "dst").groupBy("target", F.col("src").alias("file"), "lo").agg(F.min_by("hi", "dst").alias("hi"))
    every = part(begun, "seed").unionByName(lines_of).unionByName(part(types, "type")).unionByName(part(calls, "call")).unionByName(mounts.select("target", "file", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), F.lit("mount").alias("role")))
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), F.col("role"))
    once = every.withColumn("rank", rank).groupBy("target", "file", "lo").agg(F.min(F.struct("rank", "role", "hi")).alias("c")).select("target", "file", "lo", "c.hi", "c.role", "c.rank")
    told = witnesses(targets.select("target").join(found.select("target").distinct(), "target", "left_semi"), begun, corpus).select("target", "file", F.col("line").cast("int").alias("lo"), F.col("line").cast("int").alias("hi"), F.lit("witness").alias("role"), F.lit(ROLES["witness"]).alias("rank"))
    return once.unionByName(told)


def average_tokens(chunks: DataFrame, target: str, tokens: Column) -> DataFrame:
    """The mean over targets of their tokens together; 0 without targets."""
    return chunks.groupBy(target).agg(F.sum(tokens).alias("t")).agg(F.coalesce(F.round(F.avg("t"), 6), F.lit(0.0)).alias("tokens"), F.count(F.lit(1)).alias("targets"))
