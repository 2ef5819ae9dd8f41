"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from claimscope.llm import quality

_RULES = " OR ".join(f"contains(low, '{p}')" for p in quality.BOILERPLATE)
_SPACE = r"[ \t\n\x0B\f\r]"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _repair() -> str:
    """Cheapest edits by plain dynamic programming over the rows: for each
    grammar state the least (cost, initials, repaired lines) so far."""
    ws = r"\x20\x09-\x0D"

    def add(state: str, cost: str, initial: str, line: str | None) -> str:
        lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 't': {lines}}}"

    def best(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def keep(initial: str, state: str) -> str:  # a closed way costs 10^9
        return add(state, f"(CASE WHEN must OR ini <> '{initial}' THEN 1000000000 ELSE 3 * late END)", "K", "role || ':' || text")

    def rerole(role: str, state: str) -> str:
        return add(state, "(CASE WHEN must THEN 1000000000 ELSE 3 + 3 * late END)", "R", f"'{role}:' || text")

    gone = lambda s: add(s, "4", "D", None)
    insert = lambda s, role: add(s, "3", "I", f"'{role}:'")
    user = [x for s in ("q0", "q1", "q3") for x in (keep("u", s), rerole("user", s))]
    return f"""WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
d0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
d1 AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS dice FROM d0, tbl),
d2 AS (SELECT conv_id, turn, CASE WHEN dice = 4 THEN 'user' ELSE role END AS role, CASE WHEN dice = 1 THEN '' WHEN dice = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN dice = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d1 WHERE dice <> 0),
d3 AS (SELECT conv_id, turn, role, text, substr(role, 1, 1) AS ini, NOT regexp_matches(text, '[^{ws}]') AS blank,
    NOT regexp_matches(text, '[.!?][{ws}]*\\z') AS open, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 256), copy) AS i FROM d2),
d4 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM d3),
r AS (SELECT *, blank OR again AS must, CAST(open AND NOT blank AND NOT again AS BIGINT) AS late FROM d4),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    CAST(sum(late) AS BIGINT) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
z AS (SELECT {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS q, {{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS no),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, q AS q0, no AS q1, {insert('q', 'user')} AS q2, {insert(insert('q', 'user').join('()'), 'assistant')} AS q3 FROM (SELECT DISTINCT conv_id FROM conversations), z
  UNION ALL
  SELECT conv_id, i, p0, p1, u2, {best('p3', insert('u2', 'assistant'))} FROM (SELECT *, {best('p2', insert('p0', 'user'), insert('p1', 'user'), insert('p3', 'user'))} AS u2 FROM (
    SELECT w.conv_id, r.i, {gone('q0')} AS p0, {best(gone('q1'), keep('s', 'q0'))} AS p1, {best(gone('q2'), *user)} AS p2, {best(gone('q3'), keep('a', 'q2'), rerole('assistant', 'q2'))} AS p3
    FROM w JOIN r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1))),
e AS (SELECT conv_id, {best('q0', 'q3')} AS q FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  q.c AS cost, q.a AS audit, sha256(array_to_string(q.t, chr(10))) AS repaired_sha256 FROM e LEFT JOIN n ON e.conv_id IS NOT DISTINCT FROM n.conv_id"""


ORACLE = {
    "op8_line_first_quality": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
l2 AS (SELECT rid, line, lower(line) AS low, length(line) AS n,
  len(list_filter(string_split_regex(line, '{_SPACE}+'), lambda x: x <> '')) AS nw,
  length(line) - length(translate(line, '|›»•·', '')) AS seps,
  (length(line) - length(replace(line, '!!', ''))) / 2 AS bangs,
  length(line) - length(translate(line, '{quality.SYMBOLS}', '')) AS syms FROM l),
l3 AS (SELECT rid, line, n, nw, nw > 0 AND (
    (nw >= {quality.MIN_LINE_WORDS} AND NOT regexp_matches(line, {_text(quality.CLOSING)}) AND NOT regexp_matches(line, {_text(quality.SENTENCE)}))
    OR bangs >= {quality.MAX_BANGS} OR (seps >= 2 AND nw <= {quality.NAV_WORDS} * (seps + 1) + seps)
    OR syms > {quality.MAX_SYMBOLS}::DOUBLE * nw + 1 OR {_RULES}) AS bad FROM l2),
ls AS (SELECT rid, count(*) FILTER (WHERE nw > 0) - count(DISTINCT line) FILTER (WHERE nw > 0) AS dup,
  CASE WHEN sum(n) > 0 THEN coalesce(sum(n) FILTER (WHERE bad), 0)::DOUBLE / sum(n)::DOUBLE ELSE 0.0::DOUBLE END AS loss FROM l3 GROUP BY rid),
b AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars,
  length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols, ls.dup AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, ls.loss
  FROM w JOIN ls USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND loss <= {quality.MAX_LOSS}::DOUBLE AS kept, loss FROM f""",
    "op9_warc_salvage": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(p.h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (h)""",
    "op11_kronecker_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
    "op12_four_russians_repair": _repair(),
    "op13_difference_cover_dedup": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(ws) - 48)) AS u(i)),
r AS (SELECT rid, i FROM g QUALIFY doc_id > min(doc_id) OVER (PARTITION BY h)),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM r),
w AS (SELECT rid, p, ws[p] AS word FROM d, unnest(range(1, len(ws) + 1)) AS u(p)),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM w ANTI JOIN c USING (rid, p) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)""",
}
