"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from seqloom.llm import quality_rules, secrets, url_filter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = "[^\\x20\\x09-\\x0D]+"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keep, strlen(html)::BIGINT AS n FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND keep <> page_id THEN keep END AS refers_to
FROM g
"""


def quality() -> str:
    classes = ", ".join(f"length(regexp_replace(t, '[^{c}]', '', 'g'))" for c in ("a-z", "A-Z", "0-9", "\\x20\\x09-\\x0D", ".,;:!?''\"()\\-", "#*$%&|<>"))

    def js(p: str, q: str) -> str:
        part = lambda k: f"(CASE WHEN z[{k}] > 0 THEN z[{k}] * log2(z[{k}] / ((z[1] + z[2]) / 2)) ELSE 0 END)"
        return f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {part(1)} + {part(2)})) / 2))"

    def ref(name: str, least: str) -> str:
        """Joins with the mean of each language's histograms, drawn to that of all, and with the latter, drawn to the prior."""
        prior, w = quality_rules.priors(32)[name], 20
        each = f"SELECT lang, unnest({name}) AS v, generate_subscripts({name}, 1) AS i FROM h WHERE {least}"
        of_all = f"SELECT p.i, (coalesce(sum(e.v), 0) + {w} * any_value(p.v)) / (count(e.v) + {w}) AS v FROM p LEFT JOIN e USING (i) GROUP BY p.i"
        own = f"SELECT lang, e.i, (sum(e.v) + {w} * any_value(b.v)) / (count(*) + {w}) AS v FROM e JOIN b USING (i) GROUP BY lang, e.i"
        table = f"WITH e AS ({each}), p AS (SELECT unnest({prior}::DOUBLE[]) AS v, generate_subscripts({prior}, 1) AS i), b AS ({of_all})"
        return f"""LEFT JOIN ({table} SELECT lang, list(v ORDER BY i) AS ref FROM ({own}) GROUP BY lang) {name}_own ON h.lang IS NOT DISTINCT FROM {name}_own.lang
  LEFT JOIN ({table} SELECT list(v ORDER BY i) AS base FROM b) {name}_all ON true"""

    far = " OR ".join(
        f"coalesce({d}_distance > {least} + {slack} / sqrt({n}), false)"
        for d, n, (least, slack) in (("chars", "word_chars", quality_rules.CHARS_LIMIT), ("common", "n_words", quality_rules.COMMON_LIMIT), ("marks", "n_words", quality_rules.MARKS_LIMIT))
    )
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORDS}') AS words, regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '{WORDS}') AS low,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines FROM t),
fw AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(low) AS w FROM w) WHERE regexp_full_match(w, '[^\\x00-\\x60\\x7B-\\x7F]+') GROUP BY lang, w),
fl AS (SELECT lang, list(w ORDER BY k) AS common FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS k FROM fw) WHERE k <= 32 GROUP BY lang),
g AS (SELECT *, len(words) AS n_words, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams FROM w),
m AS (SELECT doc_id, lang, t, low, n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(list_filter(words, lambda x: regexp_full_match(x, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS n_marks FROM g),
p AS (SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM g),
twice AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) k(k) GROUP BY doc_id),
c AS (SELECT m.* EXCLUDE (t, low), [{classes}] AS byclass, length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) AS wide, length(t) AS n,
  list_transform(coalesce(fl.common, []), lambda f: len(list_filter(low, lambda x: x = f))) AS hits FROM m LEFT JOIN fl ON m.lang IS NOT DISTINCT FROM fl.lang),
h AS (SELECT * EXCLUDE (byclass, hits), list_transform(list_concat(byclass, [n - wide - list_sum(byclass), wide]), lambda x: x / n) AS chars,
  list_transform(list_concat(list_resize(hits, 32, 0), [n_words - coalesce(list_sum(hits), 0)]), lambda x: x / n_words) AS common, [n_marks / n_words, (n_words - n_marks) / n_words] AS marks FROM c),
j AS (SELECT h.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
  CASE WHEN word_chars >= 200 THEN {js("chars", "coalesce(chars_own.ref, chars_all.base)")} END AS chars_distance,
  CASE WHEN n_words >= 50 THEN {js("common", "coalesce(common_own.ref, common_all.base)")} END AS common_distance,
  CASE WHEN n_words >= 50 THEN {js("marks", "coalesce(marks_own.ref, marks_all.base)")} END AS marks_distance
  FROM h LEFT JOIN r USING (doc_id) {ref("chars", "word_chars >= 200")} {ref("common", "n_words >= 50")} {ref("marks", "n_words >= 50")}),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR {far}) AS kept
FROM f
"""


def secret_scans() -> str:
    quoted = lambda x: x.replace("'", "''")
    parts = []
    for k, (kind, (test, pattern, group, least)) in enumerate(secrets.KINDS.items()):
        get = lambda g: f"regexp_extract_all(t, '(?s)(.*?)({quoted(pattern)})', {g})"  # noqa: B023, E731
        parts.append(f"SELECT *, {k} AS k, '{kind}' AS kind, {least} AS least FROM (SELECT row, owner, repo, unnest({get(1)}) AS gap, unnest({get(2)}) AS hit, unnest({get(2 + group if group else 2)}) AS value, generate_subscripts({get(1)}, 1) AS i FROM d WHERE regexp_matches(t, '{quoted(test)}'))")
    count = lambda kind: f"count(*) FILTER (kind = '{kind}') AS n_{kind}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source AS owner, lang AS repo, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY row, kind ORDER BY i)::BIGINT AS z FROM m),
b AS (SELECT row, owner, repo, k, kind, z - length(hit) AS a, z, value FROM e WHERE length(value) >= least),
o AS (SELECT value, count(DISTINCT coalesce(owner, chr(0))) AS owners, count(DISTINCT coalesce(owner, chr(0)) || chr(1) || coalesce(repo, chr(0))) AS repos FROM b GROUP BY value),
v AS (SELECT DISTINCT row, {len(secrets.KINDS)} AS k, 'live' AS kind, z - length(value) AS a, z FROM b JOIN o USING (value)
  WHERE owners < 3 AND repos < 4 AND length(value) >= 16 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8 AND NOT regexp_matches(value, '{secrets.PLACEHOLDERS}')),
s AS (SELECT row, k, kind, a, z, kind || ':' || a || ':' || z AS said FROM b UNION ALL SELECT row, k, kind, a, z, kind || ':' || a || ':' || z FROM v),
g AS (SELECT row, {", ".join(map(count, secrets.KINDS))}, string_agg(said, ',' ORDER BY a, k) FILTER (kind <> 'live') AS base, string_agg(said, ',' ORDER BY a, k, z) AS spans FROM s GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in secrets.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""


def url_filters() -> str:
    parts = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)\\??([^#]*)', {})"
    fits = lambda h, p: f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')"
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)
    says = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules)
    return f"""
WITH u AS (SELECT page_id, url, translate({parts.format(1)}, '{UPPER}', '{LOWER}') AS host, {parts.format(2)} AS path, {parts.format(3)} AS query FROM pages),
t AS (SELECT *, CASE {rule} END AS rule, CASE {says} END AS says, list_sort(list_distinct(list_concat(
  list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g')),
  list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: regexp_replace(x, '(?s)=.*', '')), lambda x: x <> ''), lambda x: 'q:' || x)))) AS items FROM u),
l AS (SELECT row_number() OVER () AS row, items, coalesce(says = 'block', false) AS bad FROM t),
tok AS (SELECT token, list(row ORDER BY row) AS rows FROM (SELECT row, unnest(items) AS token FROM l) GROUP BY token HAVING count(*) >= greatest(20, 0.005 * (SELECT count(*) FROM l))),
grp AS (SELECT rows, min(token) AS item, list(token ORDER BY token) AS tokens FROM tok GROUP BY rows),
bas AS (SELECT row, list(item ORDER BY item) AS found FROM (SELECT unnest(rows) AS row, item FROM grp) GROUP BY row),
k AS (SELECT row, bad, found, unnest(range(1, (1 << len(found))::BIGINT)) AS mask FROM l JOIN bas USING (row)),
f AS (SELECT list_filter(found, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS of, count(*) FILTER (bad) AS uses, count(*) AS n FROM k GROUP BY 1),
good AS (SELECT of, uses / n AS confidence FROM f WHERE uses >= greatest(20, 0.005 * (SELECT count(*) FROM l)) AND uses / n >= greatest(0.8, 1.2 * (SELECT count(*) FILTER (bad) / count(*) FROM l))),
r AS (SELECT antecedent, array_to_string(antecedent, ' ') AS name, confidence FROM (SELECT of, confidence, list_sort(flatten(list(tokens))) AS antecedent FROM (SELECT of, confidence, unnest(of) AS item FROM good) JOIN grp USING (item) GROUP BY of, confidence)),
x AS (SELECT items, arg_min(name, (-confidence, name)) AS mined_rule FROM (SELECT DISTINCT items FROM t) JOIN r ON list_has_all(items, antecedent) GROUP BY items)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN mined_rule IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, mined_rule
FROM t LEFT JOIN x USING (items)
"""


JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
x AS (SELECT r, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.r AS a, b.r AS b FROM x a JOIN x b USING (g) WHERE a.r < b.r GROUP BY a.r, b.r HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
top AS (SELECT reach.a AS r, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.b GROUP BY reach.a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id FROM s JOIN top USING (r)
"""


def crc32(text: str) -> str:
    """The CRC-32 of an ASCII string, bit by bit."""
    bit = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    byte = f"list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295)"


def repair() -> str:
    """States 1 to 4: nothing, system, user, assistant. b: what the rest costs from each; w: the edits one by one."""
    far, put = 1 << 40, "[3, 3, 4, 3]"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    keep = lambda s: f"CASE WHEN k = 'u' AND {s} <> 3 THEN 3 WHEN k = 'a' AND {s} = 3 THEN 4 WHEN k = 's' AND {s} = 1 THEN 2 END"
    stays = f"CASE WHEN fault IN (1, 2) THEN {far} ELSE least(b[{put}[s]] + 2, coalesce(b[{keep('s')}], {far})) + (fault = 3)::INT END"
    closed = lambda x: f"list_transform(range(1, 5), lambda s: least({x}[s], {x}[{put}[s]] + 2))"
    return f"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(key)} % 20 AS h FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM d WHERE h <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text), copy) - 1 AS pos, rtrim(text, {white}) AS solid FROM e),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, pos, left(role, 1) AS k, CASE WHEN solid = '' THEN 1
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM p),
n AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank,
  count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || k NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
r AS (SELECT conv_id, n AS pos, [0, 4, 2, 0]::BIGINT[] AS b FROM n UNION ALL
  SELECT conv_id, pos, {closed('c')} FROM (SELECT conv_id, pos, {closed('x')} AS c FROM
    (SELECT r.conv_id, f.pos, list_transform(range(1, 5), lambda s: least(b[s] + 3, {stays})) AS x
     FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos - 1))),
m AS MATERIALIZED (SELECT r.conv_id, r.pos, r.b, after.b AS z, f.k, f.role, f.text, coalesce(f.fault, 0) AS fault, f.pos IS NULL AS over FROM r
  LEFT JOIN r AS after ON after.conv_id IS NOT DISTINCT FROM r.conv_id AND after.pos = r.pos + 1
  LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos),
w AS (SELECT conv_id, 0::BIGINT AS pos, 1 AS s, '' AS audit, []::VARCHAR[] AS lines, false AS done FROM n UNION ALL
  SELECT conv_id, CASE WHEN edit IN ('I', '') THEN pos ELSE pos + 1 END, CASE edit WHEN 'K' THEN kept WHEN 'I' THEN {put}[s] WHEN 'R' THEN {put}[s] ELSE s END,
    audit || edit, CASE edit WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'I' THEN list_append(lines, said)
      WHEN 'R' THEN list_append(lines, said || text) ELSE lines END, edit = ''
  FROM (SELECT w.*, m.role, m.text, {keep('w.s')} AS kept, CASE WHEN w.s = 3 THEN 'assistant:' ELSE 'user:' END AS said,
    CASE WHEN NOT over AND z[w.s] + 3 = b[w.s] THEN 'D' WHEN over AND w.s IN (1, 4) THEN '' WHEN b[{put}[w.s]] + 2 = b[w.s] THEN 'I'
      WHEN z[{keep('w.s')}] + (fault = 3)::INT = b[w.s] THEN 'K' ELSE 'R' END AS edit
    FROM w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos WHERE NOT w.done))
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(m.b[1], 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM i.conv_id AND m.pos = 0 LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM i.conv_id AND w.done
"""


def sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filters(),
        "op3_warc": WARC,
        "op5_exact_dedup": EXACT_DEDUP,
        "op8_quality_rules": quality(),
        "op9_jaccard_join": JACCARD,
        "op10_secret_scans": secret_scans(),
        "op12_conversation_repair": repair(),
    }
