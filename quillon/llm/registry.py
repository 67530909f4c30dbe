"""Queries of the text operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.llm.chat import CLOSE, HEAD_END, OPEN, op12_chat_formatting
from quillon.llm.chunks import op2_document_fingerprints
from quillon.llm.decontaminate import op3_decontamination
from quillon.llm.language import op6_language_id
from quillon.llm.packing import op4_best_fit_packing
from quillon.llm.common import table
from quillon.llm.pii import KINDS, base_spans, op1_pii
from quillon.llm.quality import op8_quality_classifier
from quillon.llm.repair import op13_structure_repair
from quillon.llm.simhash import op10_simhash_near_dedup
from quillon.llm.suffixes import op5_suffix_dedup
from quillon.llm.tokens import op9_token_counts
from quillon.llm.trie import op11_prefix_trie
from quillon.llm.urls import RULES, filter_urls, op7_url_filter


def pii_base_counts(spark, sf_dir):
    """How many base identifiers of each kind every document has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", base_spans(F.coalesce(F.col("text"), F.lit(""))).alias("base"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return docs.select("doc_id", *map(count, KINDS))


def url_host_path_rule(spark, sf_dir):
    """Host, path and rule of every page, and the verdict where a rule decides."""
    found = filter_urls(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_document_fingerprints,
        op3_decontamination,
        op4_best_fit_packing,
        op5_suffix_dedup,
        op6_language_id,
        op7_url_filter,
        op8_quality_classifier,
        op9_token_counts,
        op10_simhash_near_dedup,
        op11_prefix_trie,
        op12_chat_formatting,
        op13_structure_repair,
    )
}
QUERIES |= {f.__name__: f for f in (pii_base_counts, url_host_path_rule)}

#: Tables of CRC-32 steps and of the checksum of any byte list, by the polynomial.
_CRC = (
    "crc(i, k, v) AS (SELECT i, 0, i::UBIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384::UBIGINT, v >> 1) ELSE v >> 1 END FROM crc WHERE k < 8), "
    "steps AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8)"
)
_CRC_OF = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::UBIGINT)), lambda a, x: xor(a >> 8, t[((xor(a, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"
_MATCHES = "SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{}')) AS m FROM documents"
_DIGITS = "SELECT doc_id, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM"
_DOUBLED = "CASE WHEN (length(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT ELSE (2 * substr(d, i, 1)::INT) // 10 + (2 * substr(d, i, 1)::INT) % 10 END"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE_SQL: dict[str, str] = {
    "pii_base_counts": (
        f"WITH e AS ({_MATCHES.format(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')}), i AS ({_MATCHES.format(r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')}), "
        f"c AS ({_MATCHES.format('[0-9]([ -]?[0-9])+')}), p AS ({_MATCHES.format(r'\+[0-9][ ().0-9-]+[0-9]')}), "
        "i4 AS (SELECT doc_id, list_transform(string_split(m, '.'), lambda x: ltrim(x, '0')) AS q FROM i), "
        "iv AS (SELECT doc_id FROM i4 WHERE len(list_filter(q, lambda x: length(x) > 3 OR coalesce(try_cast(x AS BIGINT), 0) > 255)) = 0), "
        f"cd AS (SELECT row_number() OVER () AS k, * FROM ({_DIGITS} c) WHERE length(d) BETWEEN 16 AND 19), cx AS (SELECT k, doc_id, d, unnest(range(1, length(d) + 1)) AS i FROM cd), "
        f"cv AS (SELECT k, doc_id FROM cx GROUP BY k, doc_id HAVING sum({_DOUBLED}) % 10 = 0), pv AS (SELECT doc_id FROM ({_DIGITS} p) WHERE length(d) BETWEEN 8 AND 15), "
        "n AS (SELECT doc_id, 1 AS a, 0 AS b, 0 AS c, 0 AS d FROM e UNION ALL SELECT doc_id, 0, 1, 0, 0 FROM iv UNION ALL SELECT doc_id, 0, 0, 1, 0 FROM cv UNION ALL SELECT doc_id, 0, 0, 0, 1 FROM pv), "
        "s AS (SELECT doc_id, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM n GROUP BY doc_id) "
        "SELECT doc_id, coalesce(a, 0)::BIGINT AS n_email, coalesce(b, 0)::BIGINT AS n_ip, coalesce(c, 0)::BIGINT AS n_card, coalesce(d, 0)::BIGINT AS n_phone FROM documents LEFT JOIN s USING (doc_id)"
    ),
    "op11_prefix_trie": (
        f"WITH RECURSIVE {_CRC}, o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL), "
        f"ids AS (SELECT c, c - c % 100 AS b, {_CRC_OF.format('c::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT c FROM o), steps), "
        "turns AS (SELECT ids.c, p, r, x, 0 AS own FROM ids JOIN o ON o.c = ids.b AND p <= h UNION ALL SELECT ids.c, p, r, x, 1 FROM ids JOIN o ON o.c = ids.c AND p > h), "
        "n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, r, x FROM turns), "
        "k AS (SELECT c, d, x, sha256(string_agg(length(r) || ':' || length(x) || ':' || r || x, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM n UNION ALL SELECT c, 0, '', '' FROM ids), "
        "e AS (SELECT c, max(d) AS e FROM k GROUP BY c), "
        "nodes AS (SELECT k, any_value(d) AS d, min(c) AS m, count(*) AS n, any_value(x) AS x, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = e), '')) AS digest FROM k JOIN e USING (c) GROUP BY k), "
        "up AS (SELECT DISTINCT b.k, a.k AS p FROM k a JOIN k b ON a.c = b.c AND b.d = a.d + 1), kids AS (SELECT p AS k, count(*) AS kids FROM up GROUP BY p), "
        "below AS (SELECT DISTINCT a.k AS top, b.k FROM k a JOIN k b ON a.c = b.c AND b.d >= a.d), "
        "sums AS (SELECT top AS k, sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * length(x)) AS saved FROM below JOIN nodes ON nodes.k = below.k LEFT JOIN kids ON kids.k = below.k GROUP BY top) "
        "SELECT nodes.m AS conv_id, nodes.d::BIGINT AS depth, a.m AS parent_conv_id, nodes.n AS n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, nodes.digest AS ends_sha256 "
        "FROM nodes JOIN sums ON sums.k = nodes.k LEFT JOIN kids ON kids.k = nodes.k LEFT JOIN up ON up.k = nodes.k LEFT JOIN nodes a ON a.k = up.p"
    ),
    "op12_chat_formatting": (
        "WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations UNION ALL SELECT -7, t, r, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)), "
        "g AS (SELECT conv_id, count(*) AS n, string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x) AS lines, coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '') AS loss, "
        f"sum(length(r || x) + 2 * length(r || x) - length(replace(replace(r || x, '<', ''), '>', '')) - length(replace(r || x, chr(92), '')) + {len(OPEN + HEAD_END + CLOSE)}) AS chars FROM o GROUP BY conv_id) "
        "SELECT conv_id, n AS n_turns, sha256(lines) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM g"
    ),
    "op13_structure_repair": (
        f"WITH RECURSIVE {_CRC}, o AS (SELECT conv_id AS c, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations), "
        f"g AS (SELECT *, {_CRC_OF.format('key')} % 20 AS g FROM o, steps), "
        "d AS (SELECT c, turn, CASE WHEN g = 4 THEN 'user' ELSE r END AS r, CASE WHEN g = 1 THEN '' WHEN g = 2 THEN translate(x, '.!?', '') ELSE x END AS x, unnest(range(CASE WHEN g = 3 THEN 2 ELSE 1 END)) AS copy FROM g WHERE g <> 0), "
        "n AS (SELECT c, turn, r, x, rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, x) AS p FROM d), "
        "f AS (SELECT *, substr(r, 1, 1) AS i, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, r, x ORDER BY p) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, "
        "lag(substr(r, 1, 1)) OVER (PARTITION BY c ORDER BY p) || substr(r, 1, 1) AS two FROM n), "
        "given(s, t, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')), kept(s, i, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)), "
        "ins AS (SELECT s, s AS t, 0 AS cost, '' AS e, '' AS said FROM given UNION ALL SELECT s, t, 3, 'I', chr(10) || role || ':' FROM given UNION ALL SELECT a.s, b.t, 6, 'II', chr(10) || a.role || ':' || chr(10) || b.role || ':' FROM given a JOIN given b ON b.s = a.t), "
        "edit AS (SELECT c, p, s, s AS t, 4 AS cost, 'D' AS e, '' AS said FROM f, (SELECT s FROM given) UNION ALL SELECT c, p, s, t, 3 + 3 * (fault = 'truncated')::INT, 'R', chr(10) || role || ':' || x FROM f, given WHERE fault NOT IN ('blank', 'duplicate') "
        "UNION ALL SELECT c, p, s, t, 3 * (fault = 'truncated')::INT, 'K', chr(10) || r || ':' || x FROM f JOIN kept USING (i) WHERE fault NOT IN ('blank', 'duplicate')), "
        "step AS (SELECT c, p, ins.s, edit.t, ins.cost + edit.cost AS cost, ins.e || edit.e AS e, ins.said || edit.said AS said FROM ins JOIN edit ON edit.s = ins.t), "
        "dp AS (SELECT DISTINCT c, 0::BIGINT AS p, 0 AS s, 0 AS cost, '' AS e, '' AS said FROM f UNION ALL SELECT c, p, t, min(cost) AS cost, arg_min(e, (cost, e)) AS e, arg_min(said, (cost, e)) AS said "
        "FROM (SELECT dp.c, step.p, step.t, dp.cost + step.cost AS cost, dp.e || step.e AS e, dp.said || step.said AS said FROM dp JOIN step ON step.c IS NOT DISTINCT FROM dp.c AND step.p = dp.p + 1 AND step.s = dp.s) GROUP BY c, p, t), "
        "most AS (SELECT c, max(p) AS p, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, "
        "coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY c), "
        "tail(s, cost, e, said) AS (VALUES (0, 0, '', ''), (3, 0, '', ''), (2, 3, 'I', chr(10) || 'assistant:'), (1, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')), "
        "best AS (SELECT dp.c, min(dp.cost + tail.cost) AS cost, arg_min(dp.e || tail.e, (dp.cost + tail.cost, dp.e || tail.e)) AS e, arg_min(dp.said || tail.said, (dp.cost + tail.cost, dp.e || tail.e)) AS said FROM dp JOIN most ON most.c IS NOT DISTINCT FROM dp.c AND most.p = dp.p JOIN tail ON tail.s = dp.s GROUP BY dp.c) "
        "SELECT a.c AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(e, '') AS audit, sha256(coalesce(substr(said, 2), '')) AS repaired_sha256 "
        "FROM (SELECT DISTINCT c FROM o) a LEFT JOIN most ON most.c IS NOT DISTINCT FROM a.c LEFT JOIN best ON best.c IS NOT DISTINCT FROM a.c"
    ),
    "url_host_path_rule": (
        "WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages), "
        f"h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r), u AS (SELECT page_id, translate(raw, '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h), "
        f"rules(rh, rp, v) AS (VALUES {_RULE_ROWS}), hit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict FROM u JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id) "
        "SELECT page_id, host, path, rule, verdict FROM u LEFT JOIN hit USING (page_id)"
    ),
}
