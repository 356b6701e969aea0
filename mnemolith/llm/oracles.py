"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .licences import DENIED, HAVE_LATER, MENTIONS, ONLY_NAMES, PHRASE, REFERENCES, RULES, SENTENCES, _later

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT rid, unnest(range(1, len(ws) - 33)) AS s, ws FROM w WHERE len(ws) >= 35),
k AS (SELECT rid, s, array_to_string(ws[s:s + 34], ' ') AS k FROM s),
r AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, s + o.o AS p FROM k SEMI JOIN r USING (k) CROSS JOIN (SELECT unnest(range(0, 35)) AS o) o),
g AS (SELECT rid, list(p) AS ps FROM c GROUP BY rid),
j AS (SELECT doc_id, ws, coalesce(ps, []) AS ps FROM w LEFT JOIN g USING (rid))
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ps)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM j
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS h FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, u.y FROM reach r JOIN u ON u.x = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""

MIXING = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key,
    len({WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|mix') AS shuffle FROM documents),
s AS (SELECT no_source, source_key, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
r AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY no_source, source_key) - 1) % 3]::BIGINT AS weight, sum(source_size) OVER ()::HUGEINT AS total FROM s),
v AS (SELECT *, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS rest,
    coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before
  FROM r WINDOW o AS (ORDER BY source_size::DOUBLE / weight, no_source, source_key)),
c AS (SELECT *, 4 * source_size * rest + 2 * before * weight <= 3 * total * weight AS capped FROM v),
h AS (SELECT *, sum(CASE WHEN capped THEN 2 * source_size ELSE 0 END) OVER ()::HUGEINT AS held, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()::HUGEINT AS open FROM c),
t AS (SELECT no_source, source_key, source_size, total::DOUBLE * 3 / 2 AS budget,
    CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE (weight * (3 * total - 2 * held))::DOUBLE / (2 * open)::DOUBLE END AS target FROM h),
q AS (SELECT d.*, sum(size) OVER (PARTITION BY no_source, source_key ORDER BY shuffle, size ROWS UNBOUNDED PRECEDING) AS running FROM d WHERE size > 0),
p AS (SELECT q.rid, q.no_source, q.source_key, q.size, q.shuffle, pass, t.budget, (pass * source_size + running)::DOUBLE / target AS finish
  FROM q JOIN t USING (no_source, source_key) CROSS JOIN (SELECT unnest([0, 1]) AS pass)),
a AS (SELECT rid, size, budget, sum(size) OVER (ORDER BY finish, no_source, source_key, pass, shuffle, size ROWS UNBOUNDED PRECEDING) AS total FROM p),
k AS (SELECT rid, sum(CASE WHEN total <= budget THEN size ELSE 0 END)::BIGINT AS taken FROM a GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM d JOIN t USING (no_source, source_key) LEFT JOIN k USING (rid)
"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT rid, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS kept, sum(n_lang) AS all_lang FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (coalesce(t.n, 0) + 2 * v.kept) AS p,
    1 + (1000000000 * (k.n_lang + 2)::HUGEINT) // (v.all_lang + 2 * v.kept) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p))::BIGINT AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
b AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
e AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM b UNION ALL SELECT * FROM e))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""

_whole = " ".join(f"WHEN '{s}' THEN '{i}'" for s, i in SENTENCES.items() if not s.endswith("*"))
_begun = " ".join(f"WHEN starts_with(s, '{s[:-1]}') THEN '{i}'" for s, i in SENTENCES.items() if s.endswith("*"))


def _reference(name: str, pattern: str) -> str:
    later = f"WHEN regexp_matches(t, '(?:{pattern}){_later}') THEN '{name}_LATER' " if name in HAVE_LATER else ""
    return f"CASE {later}WHEN regexp_matches(t, '{pattern}') THEN '{name}_REF' END"


_references = ", ".join(_reference(name, pattern) for name, pattern in REFERENCES.items())


def _identifiers(sentences: str) -> str:
    plain = rf"list_transform({sentences}, lambda x: trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"
    said = rf"""CASE WHEN regexp_matches(s, '{PHRASE}') AND NOT regexp_matches(s, '{DENIED}') THEN s WHEN regexp_matches(s, '{ONLY_NAMES}') THEN regexp_replace(s, '\bmit\b', 'mit license', 'g') END"""
    known = f"list_transform({plain}, lambda s: {{'i': coalesce(CASE s {_whole} END, CASE {_begun} END), 't': {said}}})"
    several = f"list_transform({known}, lambda k: CASE WHEN k.i IS NOT NULL THEN [k.i] WHEN k.t IS NULL THEN [] ELSE list_filter(list_transform([k.t], lambda t: [{_references}])[1], lambda i: i IS NOT NULL) END)"
    return f"flatten({several})"


_ends = r"regexp_replace({}, '([.!?;:])\s+', '\1' || chr(10), 'g')"
_rules = ", ".join(f"CASE WHEN contains(a, ' {' '.join(r)} ') OR contains(b, ' {' '.join(r)} ') THEN '{name}' END" for name, r in RULES)
LICENCES = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
i AS (SELECT doc_id,
    CASE WHEN regexp_matches(text, '{MENTIONS}') THEN {_identifiers("string_split_regex(" + _ends.format("text") + r", '\s*\n\s*')")} ELSE [] END AS one,
    CASE WHEN regexp_matches(text, '{MENTIONS}') THEN {_identifiers("string_split_regex(" + _ends.format(r"regexp_replace(text, '\s*\n\s*', ' ', 'g')") + r", '\n')")} ELSE [] END AS other FROM t),
l AS (SELECT *, ' ' || array_to_string(one, ' ') || ' ' AS a, ' ' || array_to_string(other, ' ') || ' ' AS b FROM i),
r AS (SELECT *, list_filter([{_rules}], lambda x: x IS NOT NULL) AS found FROM l),
d AS (SELECT *, list_filter(found, lambda x, k: list_position(found, x) = k) AS names FROM r)
SELECT doc_id, CASE WHEN len(one) + len(other) = 0 THEN '' WHEN len(names) = 0 THEN 'UNMATCHED' ELSE array_to_string(names, ', ') END AS licences,
  array_to_string(CASE WHEN len(other) > len(one) THEN other ELSE one END, ', ') AS sentence_ids
FROM d
"""

ORACLE_SQL = {
    "op5_licences": LICENCES,
    "op2_mixing": MIXING,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op9_near_dedup": NEAR_DEDUP,
    "op13_divergence": DIVERGENCE,
}
