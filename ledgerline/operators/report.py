"""The verification of a whole model: every rule, then one verdict for each identity.

The stages follow each other where one needs another's outcome: identities that the structural rules reject aren't held against the witness, and what they would have matched counts as omitted.
What several stages read is written once below the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import scoring, verify
from .evidence import rank
from .stores import dealt, written

COLUMNS = ["id", "uid", "rule", "severity", "detail"]


def with_identity(endpoints: DataFrame, audited: DataFrame) -> DataFrame:
    """endpoints with claimed (the uid as given), uid (as computed), n_evidence, file and quotes of the identity's citations, worst (their worst verdict) and unproven (facts that nothing cites).

    audited: citations (id, ord, kind: identity or a fact, file, quote, verdict)."""
    seen = audited.groupBy("id").agg(
        F.count_if(F.col("kind") == "identity").alias("n_evidence"), F.min_by(F.when(F.col("kind") == "identity", F.col("file")), F.when(F.col("kind") == "identity", F.col("ord"))).alias("file"),
        F.max_by("verdict", F.when(F.col("kind") == "identity", rank(F.col("verdict")))).alias("worst"), F.max(F.when(F.col("kind") == "identity", verify.has_signal(F.col("quote"))).otherwise(False)).alias("signal"),
        F.collect_set(F.when(F.col("kind") != "identity", F.col("kind"))).alias("proven"),
    )  # a citation's caps bound the set: as many as an endpoint has facts
    rows = verify.recomputed(endpoints.withColumn("claimed", F.col("uid"))).join(dealt(seen), "id", "left")
    unproven = F.array_except("facts", F.coalesce("proven", F.array().cast("array<string>")))
    return rows.withColumns({"n_evidence": F.coalesce("n_evidence", F.lit(0)), "worst": F.coalesce("worst", F.lit("verified")), "signal": F.coalesce("signal", F.lit(False)), "unproven": unproven}).drop("proven")


def findings(e: DataFrame, audited: DataFrame, refs: DataFrame, components: DataFrame, grounded: DataFrame, witness: DataFrame | None, services: list[str]) -> DataFrame:
    """id, uid, rule, severity, detail of all rules, over with_identity()'s rows; id is null where the witness has what the model lacks.

    refs: id, refs; grounded: id, cls, field, state.  Without a witness nothing is held against it, and every endpoint is told so (V-07, info)."""
    named = e.select("id", "uid")
    own = lambda df: df.drop("uid").join(dealt(named), "id").select(*COLUMNS)
    one = written(verify.endpoint_findings(e, services, "claimed"), "findings")
    first = one.where("rule <> 'V-09'").unionByName(verify.duplicates(e)).unionByName(own(verify.audit_findings(audited.withColumn("uid", F.lit(None).cast("string"))))).unionByName(own(verify.unresolved_refs(refs.withColumn("uid", F.lit(None).cast("string")), components)))
    first = written(first, "findings")
    passed = e.join(dealt(first.where("severity = 'reject'").select("uid").distinct()), "uid", "left_anti").withColumn("clean", F.col("worst") == "verified")
    if witness is None:
        against = e.select("id", "uid", F.lit("V-07").alias("rule"), F.lit("info").alias("severity"), F.lit("witness unavailable").alias("detail"))
    else:
        against = verify.witness_findings(written(verify.crosscheck(passed, witness), "checked"), witness)
    promoted = audited.where("kind <> 'identity'").select("id", F.lit(None).cast("string").alias("uid"), F.col("kind").alias("fact"), "extraction_method")
    later = [one.where("rule = 'V-09'"), against, verify.shadowing(e.withColumn("path", F.trim("path"))), own(verify.promoted_claims(promoted)), own(verify.grounding_findings(grounded.withColumn("uid", F.lit(None).cast("string"))))]
    for more in later:
        first = first.unionByName(more)
    return first


def verdicts(e: DataFrame, found: DataFrame) -> DataFrame:
    """uid, verdict (reject, stale, warn, pass) and counts by severity: one row for each computed uid, and one for each that the witness alone has."""
    of = lambda s: F.count_if(F.col("severity") == s)
    stale = F.count_if((F.col("rule") == "V-04") & (F.col("detail") == "identity:stale"))
    counts = found.groupBy("uid").agg(of("reject").alias("rejects"), of("warn").alias("warns"), of("info").alias("infos"), stale.alias("stale"))
    every = e.select("uid").distinct().unionByName(found.where("id is null").select("uid").distinct())
    rows = every.join(dealt(counts), "uid", "left").fillna(0, ["rejects", "warns", "infos", "stale"])
    verdict = F.when(F.col("rejects") > 0, "reject").when(F.col("stale") > 0, "stale").when(F.col("warns") > 0, "warn").otherwise("pass")
    return rows.select("uid", verdict.alias("verdict"), "rejects", "warns", "infos")


def model_verdict(judged: DataFrame) -> DataFrame:
    """One row: verdict of the model and how many identities have each verdict."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    row = judged.agg(of("pass").alias("passed"), of("warn").alias("warned"), of("reject").alias("rejected"), of("stale").alias("stale"))
    verdict = F.when(F.col("rejected") > 0, "endpoints_rejected").when(F.col("warned") + F.col("stale") > 0, "ok_with_warnings").otherwise("ok")
    return row.select(verdict.alias("verdict"), "*")


def scores(e: DataFrame, found: DataFrame, witness: DataFrame) -> DataFrame:
    """uid, existence, path, action of identities that aren't rejected: agreement with the witness, by uid or by handler, and the identity's citations."""
    rejected = found.where("severity = 'reject'").select("uid").distinct()
    kept = e.join(dealt(rejected), "uid", "left_anti").withColumn("clean", F.col("worst") == "verified")
    checked = verify.crosscheck(kept, witness)
    other = (F.col("state") == "handler") & (verify.R.normalize_path(F.col("seen_path")) != verify.R.normalize_path(F.col("path")))
    agrees = F.when(F.col("state").isin("agreed", "handler"), "agree").otherwise("unavailable")
    score = lambda agreement: scoring.fact_score(F.col("clean"), agreement, F.lit(False), F.lit(True), F.col("n_evidence") > 0, F.col("n_evidence"), F.lit(1.0))
    rows = checked.select("uid", score(agrees).alias("existence"), score(F.when(other, "disagree").otherwise(agrees)).alias("path"))
    return rows.withColumn("action", scoring.gate_action(scoring.gate_score(F.col("existence"), F.col("path"))))
