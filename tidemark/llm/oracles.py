"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import mixing, pii

RE2 = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": pii.IBAN,
    "ssn": pii.SSN,
}


def _raw(kind: str) -> str:
    return f"SELECT rid, doc_id, t, '{kind}' AS kind, {pii.KINDS.index(kind)} AS rank, string_split(regexp_replace(translate(t, chr(1), chr(2)), '({RE2[kind]})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM d"


_VALID = f"""CASE kind WHEN 'email' THEN true
 WHEN 'ip' THEN regexp_matches(p, '^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{{1,2}})(?:\\.|$)){{4}}$')
 WHEN 'card' THEN length(g) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN (length(g) - i) % 2 = 0 THEN CAST(substr(g, i, 1) AS INT) WHEN CAST(substr(g, i, 1) AS INT) > 4 THEN 2 * CAST(substr(g, i, 1) AS INT) - 9 ELSE 2 * CAST(substr(g, i, 1) AS INT) END)) % 10 = 0
 WHEN 'phone' THEN length(g) BETWEEN 10 AND 15
 WHEN 'iban' THEN length(c) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x ELSE CAST(ascii(x) - 55 AS VARCHAR) END), ''), ''), lambda x: CAST(x AS INT)), lambda a, x: (a * 10 + x) % 97) = 1
 ELSE NOT regexp_matches(p, '^(000|666|9..)|-00-|-0000$') AND regexp_matches(substr(t, greatest(s - {pii.NEAR}, 0) + 1, s - greatest(s - {pii.NEAR}, 0)) || ' ' || substr(t, e + 1, {pii.NEAR}), '{pii.CONTEXT["ssn"][1]}') END"""

PII = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), r AS ({' UNION ALL '.join(_raw(k) for k in pii.KINDS)}),
 u AS (SELECT rid, t, kind, rank, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM r WHERE len(parts) > 1), x AS (SELECT *, CAST(sum(length(p)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS e FROM u),
 m AS (SELECT rid, t, kind, rank, p, e - length(p) AS s, e, regexp_replace(p, '[^0-9]', '', 'g') AS g, replace(p, ' ', '') AS c FROM x WHERE i % 2 = 0), n AS (SELECT *, substr(t, greatest(s - {pii.NEAR}, 0) + 1, s - greatest(s - {pii.NEAR}, 0)) || ' ' || substr(t, e + 1, {pii.NEAR}) AS near FROM m WHERE {_VALID}),
 v AS (SELECT rid, kind, rank, s, kind || ':' || s || ':' || e AS w, CASE kind {' '.join(f"WHEN '{k}' THEN CAST(round(100 * least(1.0, {a} + CASE WHEN regexp_matches(near, '{w}') THEN {pii.GAIN} ELSE 0 END)) AS INT)" for k, (a, w) in pii.CONTEXT.items())} END AS sc FROM n),
 a AS (SELECT rid, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in pii.BASE)}, string_agg(w, ',' ORDER BY s, rank) FILTER (WHERE rank < {len(pii.BASE)}) AS b, string_agg(w, ',' ORDER BY s, rank) AS spans, string_agg(CAST(sc AS VARCHAR), ',' ORDER BY s, rank) AS scores FROM v GROUP BY rid)
 SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in pii.BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN a ON d.rid = a.rid"""

_WEIGHTS = ", ".join(str(float(w)) for w in mixing.WEIGHTS)


def _turn(c: int) -> str:
    """The cut of class c: its need with what longer classes left open, and the bound nearest to it."""
    before = f"(SELECT k, carry FROM t{c + 1})" if c < mixing.CLASSES else "(SELECT k, 0.0::DOUBLE AS carry FROM s6)"
    return f"""w{c} AS (SELECT b.k, coalesce(e.expected, 0.0) + b.carry AS wanted FROM {before} b LEFT JOIN ex e ON e.k = b.k AND e.class = {c}),
 m{c} AS (SELECT w.k, wanted, coalesce(max(upto) FILTER (WHERE upto <= wanted), 0) AS low, min(upto) FILTER (WHERE upto > wanted) AS high FROM w{c} w LEFT JOIN pre p ON p.k = w.k AND p.class = {c} GROUP BY 1, 2),
 t{c} AS (SELECT k, CAST(CASE WHEN high - wanted < wanted - low THEN high ELSE low END AS BIGINT) AS take, wanted - (CASE WHEN high - wanted < wanted - low THEN high ELSE low END) AS carry FROM m{c})"""


def _expected(size: str, x: str) -> str:
    return f"CASE WHEN {size} = 0 THEN 0.0::DOUBLE WHEN theta IS NULL THEN {float(mixing.MOST)}::DOUBLE ELSE least({float(mixing.MOST)}::DOUBLE, theta * {x}) END"


_X, _CLASS = "CAST(floor(sqrt(CAST(size AS DOUBLE)) * 64) AS BIGINT)", f"least(length(bin(size)), {mixing.CLASSES})"
_CUTS = range(mixing.CLASSES, 0, -1)

MIX = f"""WITH z AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(md5(text), '') AS uid, source, coalesce('s' || source, 'n') AS k, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
 s0 AS (SELECT k, source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY 1, 2), s1 AS (SELECT *, list_extract([{_WEIGHTS}], CAST((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % {len(mixing.WEIGHTS)} + 1 AS INT)) AS weight, CAST(source_size * {mixing.MOST} AS DOUBLE) AS stop FROM s0),
 s2 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(stop) OVER (ORDER BY stop / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY stop / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
 s3 AS (SELECT *, (SELECT arg_min(level, stop / weight) FROM s2 WHERE level * weight <= stop) AS final FROM s2), s4 AS (SELECT k, source_size, least(stop, coalesce(final * weight, stop)) AS target FROM s3),
 bx AS (SELECT k, {_X} AS x, {_CLASS} AS class, sum(size) AS words FROM z GROUP BY ALL), b1 AS (SELECT k, x, sum(words) AS words FROM bx WHERE x > 0 GROUP BY ALL),
 th AS (SELECT b1.k, x, (target - {mixing.MOST} * CAST(coalesce(sum(words) OVER (PARTITION BY b1.k ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) / CAST(sum(x * words) OVER (PARTITION BY b1.k ORDER BY x DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS theta FROM b1 JOIN s4 ON b1.k = s4.k WHERE target < source_size * {mixing.MOST}),
 s5 AS (SELECT k, arg_max(theta, x) AS theta FROM th WHERE theta * x <= {mixing.MOST} GROUP BY k), s6 AS (SELECT s4.*, theta FROM s4 LEFT JOIN s5 ON s4.k = s5.k),
 ey AS (SELECT bx.k, class, words, {_expected('x', 'x')} AS lam FROM bx JOIN s6 ON bx.k = s6.k WHERE x > 0), ex AS (SELECT k, class, CAST(sum(CAST(floor((lam - floor(lam)) * {mixing.UNIT}) AS HUGEINT) * CAST(words AS HUGEINT)) AS DOUBLE) / {mixing.UNIT} AS expected FROM ey GROUP BY ALL),
 d0 AS (SELECT z.*, source_size, target, {_CLASS} AS class, {_expected('size', _X)} AS lam, (CAST('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), uid)), 1, 12) AS BIGINT) + 0.5) / pow(2.0, 48) AS u FROM z JOIN s6 ON z.k = s6.k),
 d1 AS (SELECT *, floor((lam - floor(lam)) * {mixing.UNIT}) / {float(mixing.UNIT)}::DOUBLE AS p FROM d0), d2 AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM d1), d3 AS (SELECT *, CAST(least(floor(odds / (1 + odds) * {mixing.CELLS}), {mixing.CELLS - 1}) AS INT) AS cell FROM d2),
 ce AS (SELECT k, class, cell, sum(size) AS words FROM d3 WHERE odds IS NOT NULL GROUP BY ALL), pre AS (SELECT k, class, cell, CAST(sum(words) OVER (PARTITION BY k, class ORDER BY cell ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM ce),
 {', '.join(map(_turn, _CUTS))}, ta AS ({' UNION ALL '.join(f'SELECT k, {c} AS class, take FROM t{c}' for c in _CUTS)}), la AS (SELECT ta.k, ta.class, max(cell) AS last FROM ta JOIN pre ON pre.k = ta.k AND pre.class = ta.class AND upto <= take GROUP BY ALL),
 fi AS (SELECT d3.*, CAST(floor(lam) + CAST(coalesce(odds IS NOT NULL AND cell <= last, false) AS INT) AS INT) AS copies FROM d3 LEFT JOIN la ON la.k = d3.k AND la.class = d3.class)
 SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies FROM fi"""

ORACLE_SQL: dict[str, str] = {"op2_source_mixing": MIX, "op7_pii": PII}
