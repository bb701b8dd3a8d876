"""The corpus queries of the entry point."""

from __future__ import annotations

from collections.abc import Callable

from . import embedding_dedup, filter_audit, html_extraction, jaccard_join, line_dedup, packing, piece_codec, quality_rules, substring_dedup, token_files, toxicity, url_filter, whitening


def queries() -> dict[str, Callable]:
    return {
        "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_token_files": token_files.op3_token_files,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_packing": packing.op5_packing,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_html_extraction": html_extraction.op7_html_extraction,
        "op8_piece_codec": piece_codec.op8_piece_codec,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_url_filter": url_filter.op13_url_filter,
    }


_VECTORS = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v),
 link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / a.size / b.size >= 0.93)"""
_REACH = "reach AS (SELECT DISTINCT a AS x, a AS y FROM link UNION SELECT reach.x, link.b FROM reach JOIN link ON link.a = reach.y), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)"
_WORDS = r"list_filter(string_split_regex(coalesce({t}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SHINGLES = f"""w AS (SELECT doc_id, {_WORDS.format(t="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 meet AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2), half AS (SELECT a, b FROM meet JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 80 * (ca.n + cb.n - k)), link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half)"""
_PASSAGES = f"""w AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents), win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
 late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late),
 g AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id), kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w) x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)"""
_URLS = r"""u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS k FROM pages),
 rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(verdict, h, p)),
 fits AS (SELECT k, h || p AS rule, verdict FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY k ORDER BY len(h) DESC, len(p) DESC) = 1)"""
_FAILS = f"""t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS.format(t="text")} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
 f AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * len(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fail FROM t),
 g AS (SELECT part, fail, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY ALL),
 orders AS (SELECT [a.i, b.i, c.i, d.i, 15 - a.i - b.i - c.i - d.i] AS o FROM range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) d(i) WHERE len(list_distinct([a.i, b.i, c.i, d.i])) = 4),
 steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders), s AS (SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, CAST(step AS INTEGER) AS step, o[step] AS f, n, good, toxic, fail[o[step]] AS hit, len(list_filter(list_slice(o, 1, step - 1), lambda i: fail[i])) > 0 AS gone, len(list_filter(fail, lambda x: x)) AS fails FROM g, steps),
 q AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (hit AND fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL over whole tables, for the tables' small sizes."""
    return {
        "op1_embedding_dedup": f"WITH RECURSIVE {_VECTORS}, {_REACH} SELECT e.vec_id, coalesce(k.n, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept FROM embeddings e LEFT JOIN least ON x = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) k ON k.a = e.vec_id",
        "op2_substring_dedup": f"WITH {_PASSAGES} SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id",
        "op6_jaccard_join": f"WITH RECURSIVE {_SHINGLES}, {_REACH} SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN least ON x = d.doc_id",
        "op12_filter_audit": f"WITH {_FAILS} SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM q",
        "op13_url_filter": f"WITH {_URLS} SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN fits ON fits.k = u.k",
    }
