"""DuckDB SQL that gives the rows of the queries by plain, undistributed means."""

from __future__ import annotations

from tidemark.llm import mixing, quality_rules, spelling

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


OP4 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


OP7 = """
WITH r AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations),
t AS (SELECT conv_id, alone, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place, role, text FROM r),
c AS (
  SELECT conv_id, alone, count(*) AS n, list(md5(concat(role IS NULL, '|', role, '|', text IS NULL, '|', text)) ORDER BY place) AS marks,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>', chr(10) ORDER BY place) AS text
  FROM t GROUP BY conv_id, alone),
p AS (SELECT DISTINCT marks[1:k] AS marks FROM (SELECT marks, unnest(range(1, n)) AS k FROM c)),
e AS (SELECT marks, min(conv_id) AS conv_id, count(*) AS n_equal, min(n)::BIGINT AS n_turns, min(text) AS text FROM c GROUP BY marks)
SELECT conv_id, n_turns, n_equal, text FROM e WHERE marks NOT IN (SELECT marks FROM p)
"""


def op9() -> str:
    first, second, third = mixing.WEIGHTS
    return f"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {first}.0 WHEN 1 THEN {second}.0 ELSE {third}.0 END::DOUBLE AS weight,
    {mixing.MOST_EPOCHS} * source_size::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (
  SELECT a.source,
    ((SELECT sum(source_size)::DOUBLE * {mixing.SHARE} FROM s) - (SELECT coalesce(sum(cap), 0) FROM r b WHERE b.ratio < a.ratio))
      / (SELECT sum(weight) FROM r b WHERE b.ratio >= a.ratio) AS level
  FROM r a),
t AS (
  SELECT r.source, source_size, cap, weight,
    least(cap, weight * coalesce((SELECT arg_min(l2.level, r2.ratio) FROM r r2 JOIN l l2 ON l2.source IS NOT DISTINCT FROM r2.source WHERE l2.level < r2.ratio), 1e300)) AS target
  FROM r),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.*, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS rest,
    (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS ahead
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM p
"""


def op10() -> str:
    risk = quality_rules.Risk()
    alpha = risk.false_rejection / len(quality_rules.RULES)
    values = {
        "symbols": "n_symbols / nullif(word_chars, 0)",
        "dup_lines": "n_dup_lines / nullif(n_lines, 0)",
        "repeats": "n_repeat_words / nullif(n_words, 0)",
        "capitals": "n_capitals / nullif(word_chars, 0)",
        "word_length": "word_chars / nullif(n_words, 0)",
    }
    rules = " UNION ALL ".join(
        f"SELECT doc_id, lang, '{r}' AS rule, ceil(({v} * 1000 - {g[0]}) / {g[2]}) AS slot FROM source"
        for (r, (_, g)), v in zip(quality_rules.RULES.items(), values.values(), strict=True)
    )
    grid = " UNION ALL ".join(f"SELECT '{r}' AS rule, unnest(range({(g[1] - g[0]) // g[2] + 1})) AS slot" for r, (_, g) in quality_rules.RULES.items())
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)),
dup AS (SELECT doc_id, a, b, c FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM win JOIN dup USING (doc_id, a, b, c), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    n_lines - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
    (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words) AS base_failed
  FROM t LEFT JOIN rep USING (doc_id)),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
one AS (
  SELECT * FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lang NULLS FIRST, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals) = 1),
v AS ({rules.replace("source", "m")}),
held AS ({rules.replace("source", "one")}),
grid AS ({grid}),
tests AS (
  SELECT lang, h.rule, g.slot, count(*) AS n, count(*) FILTER (h.slot > g.slot) AS k FROM held h JOIN grid g ON h.rule = g.rule GROUP BY ALL),
tails AS (
  SELECT lang, rule, slot, CASE WHEN k >= n * {alpha} THEN 1 ELSE (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}::DOUBLE) + (n - i) * ln(1 - {alpha}::DOUBLE)))
    FROM (SELECT unnest(range(0, k + 1)) AS i)) END AS p FROM tests),
safe AS (
  SELECT lang, rule, min(slot) AS cutoff FROM tails
  WHERE p <= {risk.error} / ({len(quality_rules.RULES)} * (SELECT greatest(1, count(*)) FROM (SELECT DISTINCT lang FROM one))) GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM v JOIN safe ON v.rule = safe.rule AND v.lang IS NOT DISTINCT FROM safe.lang WHERE v.slot > safe.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM m
"""


OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT r, doc_id, i, ws[i:i + 12] AS seq FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
f AS (SELECT seq, min(doc_id) AS first FROM w GROUP BY seq HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT r, i + k AS i FROM w JOIN f USING (seq), (SELECT unnest(range(13)) AS k) WHERE first < doc_id),
l AS (SELECT r, list(i) AS gone FROM g GROUP BY r),
e AS (SELECT r, i, ws[i] AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d SEMI JOIN l USING (r))),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN l USING (r) LEFT JOIN k USING (r)
"""


def op13() -> str:
    """The checksum goes byte by byte, with its table made from the polynomial; words that are near have equal strings with a letter left out."""
    step = "(SELECT CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END)"
    table = "WITH RECURSIVE c0 AS (SELECT i, i::BIGINT AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, " + step.format("c") + ", k + 1 FROM c0 WHERE k < 8)"
    letters = spelling.LETTERS
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
{table},
crc AS (SELECT list(c ORDER BY i) AS t FROM c0 WHERE k = 8),
runs AS (
  SELECT doc_id, translate(run, '{upper}', '{lower}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{letters}]+')) AS run FROM documents) GROUP BY ALL),
hex AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || run)) AS x FROM runs),
h AS (
  SELECT run, n, xor(list_reduce(
    list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
    lambda a, b: xor(a // 256, t[(xor(a, b) % 256 + 1)::BIGINT]), 4294967295::BIGINT), 4294967295) AS h
  FROM hex, crc),
spelt AS (
  SELECT CASE WHEN h % {spelling.SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (
  SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
  UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.short = v.word
  UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.short = v.word),
best AS (
  SELECT pairs.word, count(*) AS n_near, first(near ORDER BY v.n DESC, near) AS near, max(v.n) AS near_n FROM pairs JOIN v ON v.word = near GROUP BY pairs.word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {spelling.RATIO} * v.n THEN near END AS form,
    CASE WHEN near_n >= {spelling.RATIO} * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS here, form AS next FROM forms
  UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.next)
SELECT word, n, n_near, form, form_n, here AS root FROM forms JOIN (SELECT word, here FROM walk WHERE next IS NULL) USING (word)
"""
