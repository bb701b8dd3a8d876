"""Model documents as rows: why one can't come in, its endpoints, and the facts that they state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Most bytes of a document, endpoints of a model and citations of a fact, and the major version.
MOST_BYTES, MOST_ENDPOINTS, MOST_EVIDENCE, MAJOR = 20 * 1024 * 1024, 10_000, 32, 1
#: Facts of an endpoint that stand alone, and those that are lists; audited ones are the first, without deprecated.
FACTS = ["operation_id", "summary", "description", "tags", "folder", "deprecated", "request_body", "auth", "examples", "versioning"]
LISTS = ["path_params", "query_params", "headers", "responses"]


def _get(node: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(node, path, kind)


def _opened(models: DataFrame) -> DataFrame:
    """models (id, text) with d, the document, null where the text is no JSON or too long, and ends, its endpoints."""
    sized = F.when(F.octet_length("text") <= MOST_BYTES, F.expr("try_parse_json(text)"))
    return models.select("id", "text", sized.alias("d")).withColumn("ends", _get(F.col("d"), "$.endpoints", "array<variant>"))


def facts(models: DataFrame) -> DataFrame:
    """id, uid, service, method, path, fact, n_evidence, methods (extraction methods of its citations): every fact that an endpoint states, its identity first.

    A fact of a list stands once for each element."""
    ends = _opened(models).select("id", F.posexplode("ends").alias("ord", "e"))
    e = F.col("e")
    base = ends.select("id", "ord", _get(e, "$.uid", "string").alias("uid"), F.coalesce(_get(e, "$.service", "string"), F.lit("default")).alias("service"), _get(e, "$.method", "string").alias("method"), _get(e, "$.path", "string").alias("path"), "e")
    cited = lambda c: F.struct(c[0].alias("fact"), c[1].alias("evidence"))
    none = F.array().cast("array<variant>")
    identity = F.array(cited((F.lit("identity"), F.coalesce(_get(e, "$.identity_evidence", "array<variant>"), none))))
    alone = [F.when(_get(e, f"$.{f}", "variant").isNotNull() & ~F.is_variant_null(_get(e, f"$.{f}", "variant")), cited((F.lit(f), F.coalesce(_get(e, f"$.{f}.evidence", "array<variant>"), none)))) for f in FACTS]
    each = lambda f: F.transform(F.coalesce(_get(e, f"$.{f}", "array<variant>"), none), lambda x: cited((F.lit(f), F.coalesce(_get(x, "$.evidence", "array<variant>"), none))))
    lists = [each(f) for f in LISTS]
    rows = base.select("id", "ord", "uid", "service", "method", "path", F.inline(F.concat(identity, F.array_compact(F.array(*alone)), *lists)))
    methods = F.transform("evidence", lambda x: F.coalesce(_get(x, "$.extraction_method", "string"), F.lit("ai_inferred")))
    return rows.select("id", "ord", "uid", "service", "method", "path", "fact", F.size("evidence").alias("n_evidence"), methods.alias("methods"))


def rejected(models: DataFrame) -> DataFrame:
    """id, rule, severity, detail of the models that may not come in, with the first reason: size, no JSON, version, schema, endpoints, evidence.

    version: a major that is a number but not the supported one; a document without one counts as of that major.  schema: no object, endpoints that are no list of objects with uid, method and path."""
    d = F.col("d")
    rows = _opened(models)
    version = _get(d, "$.apim_version", "string")
    major = F.when(version.isNull(), MAJOR).otherwise(F.split_part(version, F.lit("."), F.lit(1)).try_cast("int"))
    named = lambda x: _get(x, "$.uid", "string").isNotNull() & _get(x, "$.method", "string").isNotNull() & _get(x, "$.path", "string").isNotNull()
    whole = _get(d, "$", "map<string,variant>").isNotNull() & (_get(d, "$.endpoints", "variant").isNull() | (F.col("ends").isNotNull() & F.forall(F.coalesce("ends", F.array().cast("array<variant>")), named)))
    most = facts(models).groupBy("id").agg(F.max("n_evidence").alias("most"))
    reason = (
        F.when(F.octet_length("text") > MOST_BYTES, "size").when(d.isNull(), "no JSON").when(F.coalesce(major != MAJOR, F.lit(False)), "version").when(~F.coalesce(whole, F.lit(False)), "schema")
        .when(F.size("ends") > MOST_ENDPOINTS, "endpoints").when(F.col("most") > MOST_EVIDENCE, "evidence")
    )
    found = rows.join(most, "id", "left").select("id", F.lit("V-01").alias("rule"), F.lit("block").alias("severity"), reason.alias("detail"))
    return found.where("detail is not null")


def fact_findings(models: DataFrame) -> DataFrame:
    """id, uid, rule, severity, detail of V-03 and V-11, from the documents of models that may come in: identities and facts that nothing cites, and citations that claim more than a model can know."""
    from ..operators.verify import MODEL_METHODS, uid

    known = facts(models).join(rejected(models).select("id"), "id", "left_anti").withColumn("uid", uid(F.col("service"), F.col("method"), F.col("path")))
    single = known.where(~F.col("fact").isin("deprecated", *LISTS))
    bare = single.where("n_evidence = 0").select("id", "uid", F.lit("V-03").alias("rule"), F.when(F.col("fact") == "identity", "reject").otherwise("warn").alias("severity"), F.col("fact").alias("detail"))
    claims = single.where("fact <> 'identity'").select("id", "uid", "fact", F.explode("methods").alias("m")).where(~F.col("m").isin(MODEL_METHODS))
    return bare.unionByName(claims.select("id", "uid", F.lit("V-11").alias("rule"), F.lit("info").alias("severity"), F.concat_ws(":", "fact", "m").alias("detail")))
