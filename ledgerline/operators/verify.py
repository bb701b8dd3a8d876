"""Verification of a claimed inventory: one row a finding (id, uid, rule, severity, detail).

Rules that look at one endpoint only are evaluated in one pass, as an array of structs per row; the others are joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import routes as R
from .stores import dealt

#: The methods that an endpoint may have, and where the claims of a model end.
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
MODEL_METHODS = ["ai_inferred", "weak_inference"]
#: Texts that show where a route is registered.
SIGNALS = [
    "@app.get(", "@app.post(", "@app.put(", "@app.patch(", "@app.delete(", "@router.get(", "@router.post(", "@router.put(", "@router.patch(", "@router.delete(", "router.get(", "router.post(", "router.put(",
    "router.patch(", "router.delete(", "@Get(", "@Post(", "@Put(", "@Patch(", "@Delete(", "@Controller(", "@GetMapping", "@PostMapping", "@PutMapping", "@PatchMapping", "@DeleteMapping", "@RequestMapping", "path(",
    "re_path(", "@api_view(", "DefaultRouter(", "@app.route(", "@bp.get(", "@bp.post(", "register_blueprint(", "include_router(", "app.use(", "setGlobalPrefix(",
]


def _finding(check: str, severity: Column | str, detail: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(check).alias("rule"), as_column(severity).alias("severity"), as_column(detail).alias("detail"))


def _rows(df: DataFrame, rules: list[tuple[Column, Column]]) -> DataFrame:
    """One row for each rule that holds."""
    found = F.explode(F.array_compact(F.array(*[F.when(cond, finding) for cond, finding in rules]))).alias("f")
    return df.select("id", "uid", found).select("id", "uid", "f.rule", "f.severity", "f.detail")


def uid(service: Column, method: Column, path: Column) -> Column:
    return F.concat_ws(":", service, F.upper(method), R.normalize_path(path))


def has_signal(quote: Column) -> Column:
    return F.exists(F.array(*[F.lit(s) for s in SIGNALS]), lambda s: F.contains(quote, s))


def recomputed(endpoints: DataFrame) -> DataFrame:
    """endpoints with the computed uid in place of the claimed one, which all rules but the first use."""
    return endpoints.withColumn("uid", uid(F.col("service"), F.col("method"), F.col("path")))


def endpoint_findings(endpoints: DataFrame, services: list[str], claimed: str = "uid") -> DataFrame:
    """V-02, V-03 and V-09 of endpoints (id, service, method, path, declared array, n_evidence, unproven array of fact names, has_body).

    The V-02 that tells of a wrong uid stands under the claimed one, all others under the computed one."""
    named = R.placeholder_names(F.col("path"))
    missing, extra = F.array_sort(F.array_except(named, "declared")), F.array_sort(F.array_except("declared", named))
    twice = F.array_sort(F.array_distinct(F.filter(named, lambda x: F.size(F.filter(named, lambda y: y == x)) > 1)))
    wrong = recomputed(endpoints.withColumn("_claimed", F.col(claimed))).where("_claimed <> uid").select("id", F.col("_claimed").alias("uid"), F.lit("V-02").alias("rule"), F.lit("info").alias("severity"), F.col("uid").alias("detail"))
    endpoints = recomputed(endpoints)
    listed = lambda c: F.array_join(c, ",")
    rules = [
        (~F.upper("method").isin(HTTP_METHODS), _finding("V-02", "reject", F.col("method"))),
        (~F.col("service").isin(services), _finding("V-02", "reject", F.col("service"))),
        ((F.size(missing) > 0) | (F.size(extra) > 0), _finding("V-02", "reject", F.concat_ws("/", listed(missing), listed(extra)))),
        (F.col("n_evidence") == 0, _finding("V-03", "reject", "identity")),
        (F.col("has_body") & F.upper("method").isin("GET", "HEAD"), _finding("V-09", "warn", F.upper("method"))),
        (F.size(twice) > 0, _finding("V-09", "reject", listed(twice))),
    ]
    unproven = endpoints.select("id", "uid", F.explode("unproven").alias("detail"))
    return wrong.unionByName(_rows(endpoints, rules)).unionByName(unproven.select("id", "uid", F.lit("V-03").alias("rule"), F.lit("warn").alias("severity"), "detail"))


def audit_findings(audited: DataFrame) -> DataFrame:
    """V-04 and, beyond the root, V-10 of citations (id, uid, kind, verdict): reject only where the endpoint's identity hangs on it."""
    check = F.when(F.col("verdict") == "confinement_violation", "V-10").otherwise("V-04")
    severity = F.when((F.col("kind") == "identity") & (F.col("verdict") != "stale"), "reject").otherwise("warn")
    return audited.where("verdict <> 'verified'").select("id", "uid", check.alias("rule"), severity.alias("severity"), F.concat_ws(":", "kind", "verdict").alias("detail"))


def duplicates(endpoints: DataFrame) -> DataFrame:
    """V-05: every endpoint of a uid that several have, with how many others there are; one aggregate joined back, no lists."""
    many = endpoints.groupBy("uid").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    return endpoints.join(dealt(many), "uid").select("id", "uid", F.lit("V-05").alias("rule"), F.lit("reject").alias("severity"), F.col("others").cast("string").alias("detail"))


def duplicate_files(endpoints: DataFrame) -> DataFrame:
    """uid, file, n: the files that the members of a repeated uid stand in, once each with how many of them do; what V-05 names, without pairing members."""
    many = endpoints.groupBy("uid").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("uid")
    return endpoints.where("file is not null").join(dealt(many), "uid", "left_semi").groupBy("uid", "file").agg(F.count(F.lit(1)).alias("n"))


def shadowing(endpoints: DataFrame) -> DataFrame:
    """V-06: endpoints of one file and method whose paths differ in one segment only, a literal in one and a placeholder in the other.

    Each segment in turn is masked, and endpoints meet on what is left and on their kind of segment, so that no pairs of a file are
    compared; of each meeting place the literal and the placeholder side get one finding each, with the number of paths across."""
    parts = F.filter(F.split(F.trim("path", F.lit("/")), "/"), lambda s: s != "")
    rows = endpoints.where("n_evidence > 0").select("id", "uid", "file", F.upper("method").alias("method"), parts.alias("s"))
    at = rows.select("id", "uid", "file", "method", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("i")).where("size(s) > 0")
    rest = F.array_join(F.transform("s", lambda x, j: F.when(j + 1 == F.col("i"), "\u0001").otherwise(x)), "/")
    is_param = F.element_at("s", F.col("i")).rlike(r"^[{:<]")
    masked = at.select("id", "uid", "file", "method", rest.alias("rest"), is_param.alias("param"))
    met = masked.groupBy("file", "method", "rest").agg(F.count_if("param").alias("params"), F.count_if(~F.col("param")).alias("literals")).where("params > 0 and literals > 0")
    across = F.when(F.col("param"), F.col("literals")).otherwise(F.col("params"))
    found = masked.join(dealt(met), ["file", "method", "rest"]).groupBy("id", "uid").agg(F.sum(across).alias("n"))
    return found.select("id", "uid", F.lit("V-06").alias("rule"), F.lit("warn").alias("severity"), F.col("n").cast("string").alias("detail"))


def crosscheck(endpoints: DataFrame, witness: DataFrame) -> DataFrame:
    """Each endpoint (uid, method, path, file, auth, clean, signal) with state and the witness used; witnesses (uid, ord, method, path, file, auth) that nothing used.

    First by uid, where the last witness of a uid counts; what is left by (method, file), where the last witness of a handler stands for it."""
    rest = [c for c in witness.columns if c != "uid"]
    last = witness.groupBy("uid").agg(F.max_by(F.struct(*rest), "ord").alias("w")).select("uid", "w.*")
    by_uid = last.select("uid", F.lit(True).alias("hit"), F.col("path").alias("w_path"), F.col("auth").alias("w_auth"))
    handler = last.groupBy(F.upper("method").alias("h_method"), F.col("file").alias("h_file")).agg(F.max_by(F.struct("uid", "path", "auth"), "ord").alias("h"))
    one = endpoints.join(dealt(by_uid), "uid", "left")
    both = one.join(dealt(handler), F.col("hit").isNull() & (F.upper("method") == F.col("h_method")) & (F.col("file") == F.col("h_file")), "left")
    state = F.when(F.col("hit"), "agreed").when(F.col("h").isNotNull(), "handler").when(F.col("clean") & F.col("signal"), "unseen").otherwise("invented")
    return both.withColumns({
        "state": state, "used": F.when(F.col("hit"), F.col("uid")).otherwise(F.col("h.uid")), "seen_path": F.coalesce("w_path", "h.path"), "seen_auth": F.coalesce("w_auth", "h.auth"),
    }).select(*endpoints.columns, "state", "used", "seen_path", "seen_auth")


def witness_findings(checked: DataFrame, witness: DataFrame) -> DataFrame:
    """V-07, V-08, V-12 and V-13 of crosscheck()'s rows."""
    rules = [
        (F.col("state") == "invented", _finding("V-07", "reject", "no witness")),
        (F.col("state") == "unseen", _finding("V-07", "info", "no witness")),
        ((F.col("state") == "handler") & (R.normalize_path(F.col("seen_path")) != R.normalize_path(F.col("path"))), _finding("V-12", "warn", F.col("seen_path"))),
        ((F.col("state") == "agreed") & (F.col("seen_auth") != F.col("auth")), _finding("V-13", "warn", F.col("seen_auth").cast("string"))),
    ]
    omitted = witness.select("uid").distinct().join(dealt(checked.select(F.col("used").alias("uid"))), "uid", "left_anti")
    omitted = omitted.select(F.lit(None).cast("long").alias("id"), F.concat(F.lit("__omitted__:"), "uid").alias("uid"), F.lit("V-08").alias("rule"), F.lit("warn").alias("severity"), F.lit("omitted").alias("detail"))
    return _rows(checked, rules).unionByName(omitted)


def unresolved_refs(endpoints: DataFrame, components: DataFrame) -> DataFrame:
    """V-10: references (array refs of each endpoint) to components (name) that don't exist."""
    refs = endpoints.select("id", "uid", F.explode(F.array_distinct("refs")).alias("name"))
    return refs.join(components.select("name"), "name", "left_anti").select("id", "uid", F.lit("V-10").alias("rule"), F.lit("reject").alias("severity"), F.col("name").alias("detail"))


def promoted_claims(facts: DataFrame) -> DataFrame:
    """V-11: facts (id, uid, fact, extraction_method) that claim more than a model can know."""
    found = facts.where(~F.col("extraction_method").isin(MODEL_METHODS))
    return found.select("id", "uid", F.lit("V-11").alias("rule"), F.lit("info").alias("severity"), F.concat_ws(":", "fact", "extraction_method").alias("detail"))


def grounding(claims: DataFrame, fields: DataFrame, classes: DataFrame) -> DataFrame:
    """claims (id, uid, cls, field) with state grounded, unknown (the class has a base that is not resolved) or ungrounded; unknown classes are left out.

    fields: cls, field, own and inherited; classes: cls, fully_resolved."""
    known = claims.join(dealt(classes.select("cls", "fully_resolved")), "cls")
    hit = known.join(dealt(fields.select("cls", "field").distinct().withColumn("hit", F.lit(True))), ["cls", "field"], "left")
    return hit.select("id", "uid", "cls", "field", F.when(F.col("hit"), "grounded").when(F.col("fully_resolved"), "ungrounded").otherwise("unknown").alias("state"))


def grounding_findings(grounded: DataFrame) -> DataFrame:
    """V-15: warn for fields that the class doesn't have, info for those that it may have."""
    severity = F.when(F.col("state") == "ungrounded", "warn").otherwise("info")
    return grounded.where("state <> 'grounded'").select("id", "uid", F.lit("V-15").alias("rule"), severity.alias("severity"), F.concat_ws(".", "cls", "field").alias("detail"))


def grounded_ratio(grounded: DataFrame) -> DataFrame:
    return grounded.groupBy("id").agg(F.avg(F.when(F.col("state") == "ungrounded", 0.0).otherwise(1.0)).alias("ratio"))

