"""DuckDB SQL for the queries of this subpackage that SQL can express and run on
whole tables.  The others are tested against brute force in ``tests/llm``.

The statements follow the rules of the results, not the operators' methods: windows are
listed one by one, distinct counts are exact, and a document's place in a source is one
running sum.
"""

from __future__ import annotations

import re

from wattle.llm import line_dedup, merkle, mixture, substring_dedup, suffix_dedup, url_filter

ORACLE: dict[str, str] = {}

# bytes as two hexadecimal digits each; a null id is not told apart from others here
ORACLE["op2_suffix_dedup"] = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2 * {suffix_dedup.WIDTH}) AS win
      FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - {suffix_dedup.WIDTH - 1}, 0))) AS i FROM d)),
least AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM w JOIN least USING (win) WHERE first < doc_id),
isle AS (SELECT doc_id, i, sum(CASE WHEN prev IS NULL OR i > prev + {suffix_dedup.WIDTH} THEN 1 ELSE 0 END)
                           OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS (SELECT doc_id, k, min(i) AS lo, max(i) + {suffix_dedup.WIDTH} AS hi FROM isle GROUP BY doc_id, k),
gap AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS after FROM span),
cut AS (SELECT g.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last,
               string_agg(substr(h, CAST(2 * after + 1 AS BIGINT), CAST(2 * (lo - after) AS BIGINT)), '' ORDER BY lo) AS kept
        FROM gap g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN cut.doc_id IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

_KEY = "trim(line, ' ' || chr(9) || chr(13))"
ORACLE["op3_line_dedup"] = f"""
WITH l AS (SELECT doc_id, source, i, parts[i] AS line FROM (
             SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i
             FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
common AS (SELECT {_KEY} AS k, min(doc_id) AS first FROM l WHERE {_KEY} <> ''
           GROUP BY 1 HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= {line_dedup.MIN_SITES}),
marked AS (SELECT l.doc_id, i, line, common.k IS NOT NULL AND l.doc_id <> first AS gone FROM l LEFT JOIN common ON {_KEY} = common.k),
per AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
               coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per USING (doc_id)"""

ORACLE["op4_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT doc_id, t, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER w AS place
      FROM n WINDOW w AS (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM r"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op5_decontaminate"] = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
         SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
         SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, i, dw.n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""

_RUN = substring_dedup.WIDTH
ORACLE["op7_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {_RUN - 1}], ' ') AS t FROM (
          SELECT doc_id, w, unnest(range(1, len(w) - {_RUN - 2})) AS i FROM d WHERE len(w) >= {_RUN})),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {_RUN})) AS p FROM ranked WHERE k > 1),
word AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
per AS (SELECT word.doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS kept
        FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)"""

_B = mixture.BLOCK
ORACLE["op10_mixture"] = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM sized GROUP BY source),
s1 AS (SELECT *, CASE no % 3 WHEN 0 THEN {float(mixture.WEIGHTS[0])} WHEN 1 THEN {float(mixture.WEIGHTS[1])} ELSE {float(mixture.WEIGHTS[2])} END::DOUBLE AS w,
              source_size * {float(mixture.REPEAT)}::DOUBLE AS bound FROM s0),
s2 AS (SELECT *, ((SELECT sum(source_size) FROM s1) * {mixture.SHARE}::DOUBLE - coalesce(sum(bound) OVER o, 0))
                 / ((SELECT sum(w) FROM s1) - coalesce(sum(w) OVER o, 0)) AS level
       FROM s1 WINDOW o AS (ORDER BY bound / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT no, source, source_size, least(bound, coalesce((SELECT level FROM s2 WHERE level <= bound / w ORDER BY bound / w, no LIMIT 1) * w, bound)) AS target FROM s2),
pass AS (SELECT no, source_size, target, CAST(floor(target) AS BIGINT) // source_size AS p FROM s WHERE target >= 1),
need AS (SELECT no, source_size, target, CAST(p * ceil(source_size / {_B}) + ceil((floor(target) - p * source_size) / {_B}) AS BIGINT) AS need FROM pass),
span AS (SELECT *, (hi - need) / total AS lo, hi / total AS up FROM (
           SELECT *, sum(need) OVER (ORDER BY no) AS hi, (SELECT sum(need) FROM need) AS total FROM need)),
slot AS (SELECT n, CAST(mod(CAST(n AS DECIMAL(19, 0)) * CAST({mixture.GOLDEN} AS DECIMAL(18, 18)), 1) AS DOUBLE) AS x
         FROM (SELECT unnest(range(CAST({mixture.SLOTS_PER_NEED} * (SELECT sum(need) FROM need) AS BIGINT))) AS n)),
ranked AS (SELECT no, source_size, target, need, row_number() OVER (PARTITION BY no ORDER BY n) - 1 AS r FROM slot JOIN span ON x >= lo AND x < up),
placed AS (SELECT no, r % CAST(ceil(source_size / {_B}) AS BIGINT) AS b, r // CAST(ceil(source_size / {_B}) AS BIGINT) AS turn, source_size, target
           FROM ranked WHERE r < need),
taken AS (SELECT no, b, least(least({_B}, source_size - b * {_B}), CAST(floor(target) AS BIGINT) - turn * source_size - b * {_B}) AS take FROM placed),
d AS (SELECT doc_id, size, s.no, s.source_size, s.target,
             sum(size) OVER (PARTITION BY s.no ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - size AS p0
      FROM sized JOIN s ON sized.source IS NOT DISTINCT FROM s.source),
cut AS (SELECT doc_id, sum(greatest(least(p0 + size - b * {_B}, take) - greatest(p0 - b * {_B}, 0), 0)) AS taken
        FROM d JOIN taken ON d.no = taken.no AND b BETWEEN p0 // {_B} AND (p0 + size - 1) // {_B} WHERE size > 0 AND take > 0 GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM d LEFT JOIN cut USING (doc_id)"""


def _coded(value: str) -> str:
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_coded(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


# CRC-32 byte by byte from its table of 256 steps; all levels of both kinds of tree (0: sources, 1: over them) as one table of steps
ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE bit AS (SELECT v AS i, 0 AS k, v FROM (SELECT unnest(range(256)) AS v)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bit WHERE k < 8),
crc AS (SELECT i, v FROM bit WHERE k = 8),
run AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, 4294967295 AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, k + 1, xor(c >> 8, v) FROM run JOIN crc ON i = xor(c & 255, CAST(ord(s[k + 1]) AS BIGINT)) WHERE k < length(s)),
tampered AS (SELECT doc_id FROM run WHERE k = length(s) AND xor(c, 4294967295) % 5 = 0),
leaf AS (SELECT doc_id, source, {_leaf('text')} AS leaf,
                CASE WHEN doc_id IN (SELECT doc_id FROM tampered) THEN {_leaf(f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")} END AS bad FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaf),
low AS (SELECT 0 AS lvl, source, pos, n, leaf AS d FROM placed
  UNION ALL SELECT lvl + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lvl, source, pos // 16, n),
sub AS (SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, pos, n, d FROM sub
  UNION ALL SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 16, n),
node AS (SELECT 0 AS kind, lvl, source, pos, n, d FROM low UNION ALL SELECT 1, lvl, NULL, pos, n, d FROM high),
step AS (SELECT node.*, coalesce(string_agg(node.d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(node.d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r,
                CASE WHEN kind = 0 THEN (SELECT sub.pos FROM sub WHERE sub.source IS NOT DISTINCT FROM node.source) END AS at
         FROM node WINDOW w AS (PARTITION BY kind, lvl, source, pos // 16 ORDER BY pos)),
climb AS (SELECT doc_id, leaf, source AS of, 0 AS kind, 0 AS lvl, source, pos, coalesce(bad, leaf) AS f, '' AS sibs FROM placed
  UNION ALL SELECT doc_id, leaf, of, CASE WHEN s.n > 1 THEN c.kind ELSE c.kind + 1 END, CASE WHEN s.n > 1 THEN c.lvl + 1 ELSE 0 END,
                   CASE WHEN s.n > 1 THEN c.source END, CASE WHEN s.n > 1 THEN c.pos // 16 ELSE s.at END,
                   CASE WHEN s.n > 1 THEN sha256(l || f || r) ELSE f END, CASE WHEN s.n > 1 THEN sibs || l || r ELSE sibs END
            FROM climb c JOIN step s ON c.kind = s.kind AND c.lvl = s.lvl AND c.pos = s.pos AND c.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, leaf, sub.d AS subroot, top.d AS root, sha256(sibs) AS proof_sha256, f AS folded_root, f = top.d AS verified
FROM climb JOIN sub ON of IS NOT DISTINCT FROM sub.source, (SELECT d FROM high WHERE n = 1) top WHERE kind = 2"""


def _glob_regex(glob: str) -> str:
    """A glob of ``url_filter`` as a regular expression for the whole text."""
    wild = {"*": "[^/]*", "**": ".*", "?": "[^/]"}
    return "(?s)" + "".join(wild.get(part, re.escape(part[1:])) for part in url_filter.parse(glob))


_RULE = "".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}' "
                for r in sorted(url_filter.RULES, key=lambda r: -len(r.name)))
_RULE_VERDICT = "".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}' " for r in url_filter.RULES)
_BY_LENGTH = sorted(url_filter.GLOBS, key=lambda g: -url_filter.plain_length(g.glob))
_GLOB = "".join(f"WHEN regexp_full_match(canon, '{_glob_regex(g.glob)}') THEN '{g.glob}' " for g in _BY_LENGTH)
_GLOB_VERDICT = "".join(f"WHEN \"glob\" = '{g.glob}' THEN '{g.verdict}' " for g in _BY_LENGTH)
ORACLE["op13_url_filter"] = rf"""
WITH cut AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h,
                    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
u AS (SELECT page_id, translate(h, '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, path FROM cut),
ruled AS (SELECT *, CASE WHEN host = '' AND path = '' THEN '' ELSE '.' || host || path END AS canon, CASE {_RULE} END AS rule FROM u),
judged AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {_GLOB} END END AS "glob" FROM ruled)
SELECT page_id, host, path, rule, "glob", CASE {_RULE_VERDICT} ELSE CASE {_GLOB_VERDICT} ELSE 'allow' END END AS verdict FROM judged"""
