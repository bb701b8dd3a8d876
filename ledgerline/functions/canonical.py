"""Canonical JSON: one spelling for documents that mean the same."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F

#: Keys that hold ids of a store and say nothing of the document.
IDENTITY_KEYS = ("id", "_postman_id", "uid", "postmanId")
#: Lists that are the same empty and absent; texts likewise.
OPTIONAL_LISTS = ("event", "response", "header", "query", "variable")
OPTIONAL_TEXTS = ("description",)


def canonical_value(value, key: str = "", drop: tuple = IDENTITY_KEYS):
    """Headers and responses hold objects only, headers in any order, responses by code and name; a body that is JSON text counts as what it says, and is not looked into."""
    if isinstance(value, dict):
        kept = {k: canonical_value(v, k, drop) for k, v in value.items() if k not in drop}
        return {k: v for k, v in kept.items() if not (k in OPTIONAL_LISTS and v == []) and not (k in OPTIONAL_TEXTS and v == "")}
    if isinstance(value, list):
        items = [canonical_value(v, "", drop) for v in value if isinstance(v, dict) or key not in ("header", "response")]
        if key == "header":
            return sorted(items, key=lambda v: json.dumps(v, sort_keys=True))
        return sorted(items, key=lambda v: (v.get("code") or 0, str(v.get("name") or ""))) if key == "response" else items
    if isinstance(value, str) and key in ("body", "raw"):
        try:
            parsed = json.loads(value)
        except ValueError:
            parsed = None
        return value.strip() if parsed is None else parsed
    return value


def _text(source, drop) -> str | None:
    if source is None:
        return None
    try:
        return json.dumps(canonical_value(json.loads(source), "", drop), sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


def texts_as_meant(texts: pd.Series, drop: tuple) -> pd.Series:
    """Canonical texts of a batch; those that it repeats are read once."""
    known = {t: _text(t, drop) for t in texts.unique()}
    return pd.Series([known[t] for t in texts], dtype=object)


def canonical_json(source: Column, drop: tuple = IDENTITY_KEYS) -> Column:
    """Canonical text of a JSON column; null for null and for what is no JSON."""

    @F.pandas_udf("string")
    def canon(texts: pd.Series) -> pd.Series:
        return texts_as_meant(texts, drop)

    return canon(source)


def content_id(canonical: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))


def plan_id(model_id: Column, state_hash: Column, scope: Column, into: Column, version: str) -> Column:
    """Binds a plan to what it was made from."""
    return content_id(F.concat_ws("|", model_id, state_hash, F.array_join(F.array_sort(scope), ","), into, F.lit(version)))
