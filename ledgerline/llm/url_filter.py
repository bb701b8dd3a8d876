"""URL rules in a trie: labels of the host from the last to the first, then segments of the path.

A rule (verdict, host, path) fits its host and all subdomains, if the URL's path starts with the rule's.  The longest rule wins: first by labels of
the host, then by characters of the path.  The trie is walked once per URL, whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._store import written

#: Verdict, host and path of the rules of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: So many rules a trie, and so many characters of each, at most: what is broadcast at once is bounded by their product, whatever the table of rules.
TRIE_RULES, RULE_CHARS = 200_000, 2_048

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` and for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` and for null."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


class Trie:
    """Nodes are (children, rest): below the root by label, from the last one; below a host's ``rest`` by segment, where the last,
    unfinished segment of a rule is kept in the node's own ``rest``, as prefix -> verdict."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = [{}, None]
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, None]
            node = node[1]
            *whole, last = path.split("/")
            for segment in whole:
                node = node[0].setdefault(segment, [{}, None])
            if node[1] is None:
                node[1] = {}
            if node[1].get(last) != "block":  # of two rules alike, the one that blocks
                node[1][last] = verdict

    def find(self, host: str, path: str) -> tuple[int, str, str] | None:
        """(labels of the rule's host, its path, its verdict) of the longest rule that fits."""
        labels = host.split(".") if host else []
        node, hosts = self.root, []
        for n in range(len(labels) + 1):
            if node[1] is not None:
                hosts.append((n, node[1]))
            node = node[0].get(labels[-1 - n]) if n < len(labels) else None
            if node is None:
                break
        segments = path.split("/") if hosts else []
        for n, node in reversed(hosts):
            best = None
            for i, segment in enumerate(segments):
                if node[1]:
                    last = next((segment[:k] for k in range(min(len(segment), RULE_CHARS), -1, -1) if segment[:k] in node[1]), None)
                    if last is not None:
                        best = (n, "/".join([*segments[:i], last]), node[1][last])
                node = node[0].get(segment)
                if node is None:
                    break
            if best:
                return best
        return None


def _walk(trie):
    """Keeps for each row the longer of the rule that earlier tries found and this one's."""

    def run(batches):
        for batch in batches:
            host, path, labels, chars, rule, verdict = (batch.column(c).to_pylist() for c in ("host", "path", "labels", "chars", "rule", "verdict"))
            for i, (h, p) in enumerate(zip(host, path)):
                if (found := trie.value.find(h, p)) and (found[0], len(found[1])) > (labels[i], chars[i]):
                    labels[i], chars[i], verdict[i] = found[0], len(found[1]), found[2]
                    rule[i] = (".".join(h.split(".")[-found[0] :]) if found[0] else "") + found[1]
            kinds = {"labels": (labels, pa.int32()), "chars": (chars, pa.int32()), "rule": (rule, pa.string()), "verdict": (verdict, pa.string())}
            yield pa.RecordBatch.from_arrays([pa.array(*kinds[c]) if c in kinds else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return run


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: the id, host, path, rule (host and path of the one that decided, else null), verdict (the rule's, else ``default``).

    rules: verdict (``allow`` or ``block``), host, path.  Hosts of rules are compared in lower case (A-Z).  An empty host fits every host and an empty path every path.
    Of rules alike in host and path, one that blocks counts.  A rule with a null in it, another verdict or more than RULE_CHARS characters is an error, as to leave it out would let pages through.

    Rules are dealt by hash over as many tries as TRIE_RULES asks for, one in the usual case; rows pass through the tries one after another
    and keep the longest rule.  Only ids and URLs are read, and no row is shuffled.  A null URL, or one without ``://``, has an empty host and path; repeated rows are judged alike, null ids stay
    null, an empty table gives an empty result, other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    known = rules.select(F.col("verdict").cast("string").alias("verdict"), F.translate("host", _UPPER, _LOWER).alias("host"), F.col("path").cast("string").alias("path"))
    sound = F.coalesce(F.col("verdict").isin("allow", "block") & (F.length("host") + F.length("path") <= RULE_CHARS), F.lit(False))
    n = known.agg(F.count(F.lit(1)).alias("n"), F.count_if(~sound).alias("bad")).first()
    if n.bad:
        raise ValueError(f"{n.bad} rules hold a null, an unknown verdict or more than {RULE_CHARS} characters")
    tries = max(1, -(-n.n // TRIE_RULES))
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page"), url_host(url).alias("host"), url_path(url).alias("path"), F.lit(-1).alias("labels"), F.lit(-1).alias("chars"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for k in range(tries):
        part = known.where(F.pmod(F.xxhash64("host", "path"), F.lit(tries)) == k).distinct()
        trie = spark.sparkContext.broadcast(Trie((r.verdict, r.host, r.path) for r in part.collect()))
        rows = rows.mapInArrow(_walk(trie), rows.schema)
        if tries > 1:  # one trie at a time in the executors' memory
            rows = written(rows, "urls")
            trie.unpersist()
    return rows.select(F.col("page").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
