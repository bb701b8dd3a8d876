"""Cited spans against the lines of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import metadata_key
from ..functions.routes import is_confined, snippet_hash
from .intervals import overlapping
from .stores import dealt
from .temporal import as_of

#: Verdicts from best to worst.
VERDICTS = ["verified", "stale", "unreadable", "confinement_violation", "fabricated"]


def rank(verdict: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), verdict) - 1


def audit(claims: DataFrame, files: DataFrame, file: str = "file", text: str = "text", past: DataFrame | None = None) -> DataFrame:
    """claims (file, line_start, line_end, snippet_sha256, perhaps symbol) with a verdict.

    confinement_violation: the file lies outside of the root.  unreadable: no such file, no such range, or the span doesn't hold the symbol.  verified: the
    lines' hash is the cited one.  Otherwise it is fabricated only if past (file, line_start, line_end, past_sha256: the span's hash at the declared
    commit) has the span with another hash; else stale, for nothing shows that it never was true.

    The span's lines come out of the file's own row by slicing, so claims join files on the file alone: no range join is needed.  A span that runs over
    the end uses the lines that are there."""
    lines = files.select(file, F.split(F.regexp_replace(text, r"\n$", ""), "\n").alias("_lines"))
    joined = claims.join(dealt(lines), file, "left")
    if past is not None:
        joined = joined.join(dealt(past.select(file, "line_start", "line_end", F.col("past_sha256").alias("_past"))), [file, "line_start", "line_end"], "left")
    start = F.greatest(F.col("line_start"), F.lit(1))
    there = F.slice("_lines", start, F.greatest(F.least(F.col("line_end"), F.size("_lines")) - start + 1, F.lit(0)))
    holds = (F.coalesce(F.col("symbol"), F.lit("")) == "") | F.exists(there, lambda x: F.contains(x, F.col("symbol"))) if "symbol" in claims.columns else F.lit(True)
    now = (start <= F.size("_lines")) & (snippet_hash(there) == F.col("snippet_sha256"))
    known = F.col("_past").isNotNull() & (F.col("_past") != F.col("snippet_sha256")) if past is not None else F.lit(False)
    verdict = (
        F.when(~is_confined(F.col(file).cast("string")), "confinement_violation").when(F.col("_lines").isNull() | (F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")), "unreadable")
        .when(now, F.when(holds, "verified").otherwise("unreadable")).when(known, "fabricated").otherwise("stale")
    )
    return joined.select(*claims.columns, verdict.alias("verdict"))


def history(claims: DataFrame, versions: DataFrame, commits: DataFrame, width: int = 1_000) -> DataFrame:
    """claims (file, commit) with ``_then``: the lines of the file as it was at the commit; null without a commit, for an unknown one, and for a file that wasn't there then.

    versions: file, at, text (null where the file was deleted); commits: commit, at.  The last version at or before the commit counts."""
    dated = claims.join(commits.select("commit", F.col("at").alias("_moment")), "commit", "left")
    placed = as_of(dated, versions.select("file", F.col("at").alias("_version_at")), "file", "_moment", "_version_at", width)
    texts = versions.select("file", F.col("at").cast("long").alias("_version_at"), F.split(F.regexp_replace("text", r"\n$", ""), "\n").alias("_then"))
    return placed.join(dealt(texts), ["file", "_version_at"], "left").select(*claims.columns, "_then")


def audit_at_commit(claims: DataFrame, files: DataFrame, versions: DataFrame, commits: DataFrame) -> DataFrame:
    """claims (file, commit, line_start, line_end, snippet_sha256, symbol) with a verdict, as audit() gives it, where the past is the file at the claim's commit.

    Lines that differ now are stale if they were so at the commit, or if that can't be seen: no commit, an unknown one, or no such file then.  They are
    fabricated if the file was there with other lines, or without as many."""
    dated = history(claims, versions, commits)
    span = F.slice("_then", F.greatest("line_start", F.lit(1)), F.greatest(F.col("line_end") - F.greatest("line_start", F.lit(1)) + 1, F.lit(0)))
    same = (F.col("line_end") <= F.size("_then")) & (snippet_hash(span) == F.col("snippet_sha256"))
    marked = dated.withColumn("_false", F.when(F.col("_then").isNotNull(), ~same).otherwise(F.lit(False))).drop("_then")
    now = audit(marked, files)
    return now.withColumn("verdict", F.when((F.col("verdict") == "stale") & F.col("_false"), "fabricated").otherwise(F.col("verdict"))).drop("_false")


def cited_classes(citations: DataFrame, symbols: DataFrame, width: int = 64) -> DataFrame:
    """id, cls: the class that each id's citations (id, ord, file, line_start, line_end, symbol) mean; ids of which none lies on a class are left out.

    symbols: cls, ord, file, kind, name, line_start, line_end.  The first citation, by ord, that overlaps a class decides: the first class of the cited name among those it
    overlaps, else the shortest one, of equal ones the first.  Citations and classes meet in bins of ``width`` lines of a file, and one aggregate keeps the best."""
    spans = citations.select("id", F.col("ord").alias("turn"), "file", "symbol", F.col("line_start").alias("a_lo"), F.col("line_end").alias("a_hi")).where("a_lo <= a_hi")
    classes = symbols.where("kind = 'class' and line_start <= line_end").select("cls", "ord", "file", "name", F.col("line_start").alias("b_lo"), F.col("line_end").alias("b_hi"))
    named = (F.coalesce("symbol", F.lit("")) != "") & (F.col("symbol") == F.col("name"))
    order = F.struct("turn", F.when(named, 0).otherwise(1), F.when(named, 0).otherwise(F.col("b_hi") - F.col("b_lo")), "ord")
    return overlapping(spans, classes, "file", width).groupBy("id").agg(F.min_by("cls", order).alias("cls"))


def fact_rollup(audited: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """id, evidenced, all_verified and n of all citations of a fact; with facts (id) also of those that nothing cites, which aren't evidenced and have no wrong citation."""
    found = audited.groupBy("id").agg(F.bool_and(F.col("verdict") == "verified").alias("all_verified"), F.count(F.lit(1)).alias("n"))
    every = found if facts is None else facts.select("id").distinct().join(found, "id", "left")
    n = F.coalesce("n", F.lit(0))
    return every.select("id", (n > 0).alias("evidenced"), F.coalesce("all_verified", F.lit(True)).alias("all_verified"), n.alias("n"))


def artifact_status(requests: DataFrame, metadata: DataFrame, audited: DataFrame) -> DataFrame:
    """key, status, cite, n of each distinct key of requests (key): how the citations of its metadata hold.

    metadata: entry, ord, key as written by hand; of entries whose keys are alike in normal form the last one counts.  audited: entry, ord, file, line_start, verdict.  status: unverified without
    metadata or citations, verified, stale if nothing worse, else fabricated, as unreadable and unconfined citations count, too.  cite: file and line of the first verified citation."""
    last = metadata.groupBy(metadata_key(F.col("key")).alias("key")).agg(F.max_by("entry", "ord").alias("entry"))
    place = F.concat_ws(":", "file", "line_start")
    held = audited.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.max(rank(F.col("verdict"))).alias("worst"), F.min_by(F.when(F.col("verdict") == "verified", place), F.when(F.col("verdict") == "verified", F.col("ord"))).alias("cite"))
    rows = requests.where("key is not null").select("key").distinct().join(last, "key", "left").join(held, "entry", "left")
    status = F.when(F.col("n").isNull(), "unverified").when(F.col("worst") == 0, "verified").when(F.col("worst") == 1, "stale").otherwise("fabricated")
    return rows.select("key", status.alias("status"), "cite", F.coalesce("n", F.lit(0)).alias("n"))


def worst(audited: DataFrame, key: str) -> DataFrame:
    return audited.groupBy(key).agg(F.max_by("verdict", rank(F.col("verdict"))).alias("verdict"), F.count(F.lit(1)).alias("n"))
