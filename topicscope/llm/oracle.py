"""DuckDB SQL for the registered queries that SQL can express (exact, without any sketch)."""

from __future__ import annotations

from itertools import permutations

from topicscope.llm.quality_rules import COMMON_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS
from topicscope.llm.url_templates import CRITICAL, MIN_BRANCH, MIN_SHARE, MOST_IMPURE, PRIOR, RULES, SINGLE

JACCARD = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
texts AS (
  SELECT array_to_string(w, ' ') AS body, any_value(w) AS w, min(doc_id) AS id, count(*) AS copies FROM split WHERE len(w) > 0 GROUP BY 1),
places AS (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts),
shingles AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM places),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
pairs AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.id JOIN sizes y ON b = y.id WHERE 5 * n_both >= 4 * (x.n + y.n - n_both)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT id AS a, id AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY 1),
counts AS (SELECT l.a AS id, count(*) AS n_text_links, sum(t.copies) AS docs FROM links l JOIN texts t ON l.b = t.id GROUP BY 1)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(t.id, d.doc_id) AS copy_id,
  coalesce(t.copies, 1)::BIGINT AS n_copies,
  (coalesce(t.copies, 1) - 1 + coalesce(n.docs, 0))::BIGINT AS n_links, coalesce(n.n_text_links, 0)::BIGINT AS n_text_links
FROM split d LEFT JOIN texts t ON array_to_string(d.w, ' ') = t.body AND len(d.w) > 0
LEFT JOIN classes c ON t.id = c.id LEFT JOIN counts n ON t.id = n.id
"""

QUALITY_BASE = r"""
split AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(later - i, 8))) AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS later FROM again) GROUP BY 1),
line AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM split) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM line GROUP BY 1),
base AS (
  SELECT s.doc_id, s.lang, s.t, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)"""

_PUNCT = ".,;:!?''\"()\\-"


def _class_counts() -> str:
    count = lambda p: f"length(regexp_replace(t, '[^{p}]', '', 'g'))"
    upper, number, space, punct = count(r"\p{Lu}"), count(r"\p{N}"), count(r"\x20\x09-\x0D"), count(_PUNCT)
    letters = count(r"\p{L}") + " - " + upper
    return f"[{letters}, {upper}, {number}, {space}, {punct}, length(t) - ({letters}) - {upper} - {number} - {space} - {punct}]"


def _common_counts() -> str:
    cases = " ".join(f"WHEN '{k}' THEN [" + ", ".join(f"len(list_filter(v, lambda x: x = '{x}'))" for x in words) + "]" for k, words in COMMON_WORDS.items())
    return f"CASE lang {cases} END"


def _js(p: str, q: str) -> str:
    share = f"list_transform(range(1, len({p}) + 1), lambda i: [{p}[i] / list_sum({p})::DOUBLE, {q}[i] / list_sum({q})::DOUBLE])"
    half = lambda k: f"CASE WHEN z[{k}] > 0 THEN z[{k}] * log2(2 * z[{k}] / (z[1] + z[2])) ELSE 0 END"
    return f"CASE WHEN {p} IS NOT NULL AND {q} IS NOT NULL THEN round(sqrt(greatest(list_sum(list_transform({share}, lambda z: ({half(1)} + {half(2)}) / 2)), 0)), 6) END"


QUALITY = f"""
WITH {QUALITY_BASE},
counted AS (
  SELECT *, CASE WHEN length(t) >= {MIN_CHARS} THEN {_class_counts()} END AS classes,
    CASE WHEN n_words >= {MIN_WORDS} AND lang IN ({", ".join(f"'{k}'" for k in COMMON_WORDS)}) THEN string_split(' ' || regexp_replace(lower(t), '[^\\p{{L}}]+', ' ', 'g') || ' ', ' ') END AS v
  FROM judged),
words AS (SELECT * EXCLUDE v, list_filter(v, lambda x: x <> '') AS v, len(v) AS parts FROM counted),
hist AS (SELECT *, {_common_counts()} AS c FROM words),
rows AS (
  SELECT * EXCLUDE c, CASE WHEN lang IN ({", ".join(f"'{k}'" for k in COMMON_WORDS)}) THEN lang ELSE '' END AS ref,
    CASE WHEN len(v) > 0 THEN list_append(c, greatest(len(v) - list_sum(c), 0)) END AS common FROM hist),
refs AS (
  SELECT ref, [{", ".join(f"sum(classes[{k}])" for k in range(1, 7))}] AS rc, [{", ".join(f"sum(common[{k}])" for k in range(1, 14))}] AS rw FROM rows GROUP BY 1),
compared AS (
  SELECT *, {_js("classes", "ref_classes")} AS class_distance, {_js("common", "ref_words")} AS word_distance
  FROM (SELECT r.*, CASE WHEN r.ref <> '' THEN f.rc END AS ref_classes, f.rw AS ref_words FROM rows r LEFT JOIN refs f ON r.ref = f.ref))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
  NOT base_failed AND coalesce(class_distance, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} AS kept
FROM compared
"""

# Items of fewer than five words take shingles of all their words; a shorter document is one window.
DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM b),
ds AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s, length(array_to_string(w[i:i + k - 1], '')) AS c
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes)),
bs AS (
  SELECT item_id, n, k, s, count(*) AS copies, any_value(length(replace(s, ' ', ''))) AS c
  FROM (SELECT item_id, n, k, array_to_string(w[j:j + k - 1], ' ') AS s FROM (SELECT item_id, w, n, k, unnest(range(1, n - k + 2)) AS j FROM b)) GROUP BY 1, 2, 3, 4),
item AS (SELECT item_id, sum(copies * c) AS weight FROM bs GROUP BY 1),
starts AS (
  SELECT DISTINCT doc_id, item_id, n, k, a FROM (
    SELECT ds.doc_id, item_id, n, ds.k, unnest(range(i - (n - ds.k), i + 1)) AS a FROM ds JOIN bs ON ds.s = bs.s AND ds.k = bs.k) t
  JOIN (SELECT doc_id, len(w) AS words FROM d) USING (doc_id) WHERE a >= 1 AND (a + n - 1 <= words OR a = 1 AND words < n)),
win AS (
  SELECT t.doc_id, t.item_id, t.n, t.k, t.a, ds.s, ds.c, count(*) AS copies FROM starts t
  JOIN ds ON ds.doc_id = t.doc_id AND ds.k = t.k AND ds.i BETWEEN t.a AND t.a + t.n - t.k GROUP BY 1, 2, 3, 4, 5, 6, 7),
sims AS (
  SELECT win.doc_id, win.item_id, win.n, win.a, sum(win.copies * win.c) AS weight, sum(CASE WHEN bs.copies IS NULL THEN 0 ELSE least(win.copies, bs.copies) * win.c END) AS shared
  FROM win LEFT JOIN bs ON bs.item_id = win.item_id AND bs.s = win.s GROUP BY 1, 2, 3, 4),
scored AS (SELECT doc_id, item_id, n, a, shared::DOUBLE / (s.weight + i.weight - shared) AS v FROM sims s JOIN item i USING (item_id))
SELECT doc_id, item_id, round(v, 6) AS similarity, (a - 1)::BIGINT AS first_word, n::BIGINT AS n_words FROM scored
WHERE v >= 0.8 - 1e-12 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY v DESC, a) = 1
"""

ARCHIVE = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN other THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN other THEN first END AS refers_to
FROM (
  SELECT *, strlen(coalesce(html, '')) >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS other
  FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
"""


def _rendered(turns: str) -> str:
    turn = "'<|im_start|>' || replace(t.role, '<|im_', '<| im_') || chr(10) || replace(t.text, '<|im_', '<| im_') || '<|im_end|>' || chr(10)"
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: {turn}), ''), '')"


def _masked(turns: str) -> str:
    head = "length('<|im_start|>' || replace(t.role, '<|im_', '<| im_') || chr(10))"
    body = "length(replace(t.text, '<|im_', '<| im_') || '<|im_end|>')"
    runs = f"{head} || ':0,' || {body} || CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END || ',1:0'"
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: {runs}), ','), '')"


PREFERENCE = f"""
WITH convs AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
  UNION ALL SELECT NULL, [{{'role': coalesce(role, ''), 'text': coalesce(text, '')}}] FROM conversations WHERE conv_id IS NULL),
follows AS (SELECT conv_id, lead(conv_id) OVER (ORDER BY conv_id) AS next_id FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
replies AS (
  SELECT conv_id, coalesce(text, '') AS reply FROM conversations WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, coalesce(text, '') DESC) = 1),
lasts AS (
  SELECT conv_id, t, list_max(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i].role = 'assistant' THEN i END)) AS place FROM convs),
pairs AS (
  SELECT l.conv_id AS pair_id, t AS chosen,
    CASE WHEN place IS NULL THEN t ELSE list_append(t[1:place - 1], {{'role': 'assistant', 'text': coalesce(reply, '')}}) END AS rejected
  FROM lasts l LEFT JOIN follows f ON f.conv_id = l.conv_id LEFT JOIN replies r ON r.conv_id = f.next_id),
counted AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(chosen), len(rejected)) + 1), lambda i: chosen[i] IS DISTINCT FROM rejected[i])) - 1, len(chosen)) AS n
  FROM pairs),
parts AS (SELECT pair_id, n, chosen[1:n] AS p, chosen[n + 1:] AS c, rejected[n + 1:] AS r FROM counted)
SELECT pair_id, n::BIGINT AS n_prompt_turns, {_rendered("p")} AS prompt, {_rendered("c")} AS chosen, {_masked("c")} AS chosen_mask,
  {_rendered("r")} AS rejected, {_masked("r")} AS rejected_mask
FROM parts
"""


def _orders(names: str) -> str:
    """(filter_order, step, its filter's bit, the bits of the filters before it) of all orders."""
    rows = []
    for order in permutations(range(len(names))):
        text, before = "".join(names[k] for k in order), 0
        for step, k in enumerate(order, 1):
            rows.append(f"('{text}', {step}, {1 << k}, {before})")
            before |= 1 << k
    return ", ".join(rows)


# Every order is walked: Shapley is the plain sum of what the filter removes in all 120.
FILTER_AUDIT = rf"""
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flags AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
judged AS (
  SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS failed
  FROM split),
counts AS (
  SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM judged LEFT JOIN flags ON judged.doc_id = flags.doc_id GROUP BY 1, 2),
orders(filter_order, step, bit, before) AS (VALUES {_orders("ABCDE")}),
steps AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (failed & (bit | before) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (failed & bit > 0 AND failed & before = 0), 0) AS removed, coalesce(sum(n) FILTER (failed & bit > 0 AND failed & before > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (failed = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (failed & bit > 0 AND failed & before = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (failed & bit > 0 AND failed & before = 0), 0) AS toxic_lost
  FROM counts, orders GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM steps
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# crc32 by its bit-wise rule, a byte a step; near words by their shapes with one code point left out.
SPELLING = rf"""
WITH RECURSIVE bits AS (
  SELECT range AS i, 0 AS k, range AS c FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT i, c FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), {_AZ}) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY 1, 2),
walk AS (
  SELECT named, hex(named) AS bytes, 0 AS k, 4294967295 AS c FROM (SELECT DISTINCT named FROM runs)
  UNION ALL SELECT named, bytes, k + 1, xor(w.c >> 8, t.c) FROM walk w JOIN tab t ON t.i = xor(w.c, ('0x' || substr(bytes, 2 * k + 1, 2))::BIGINT) & 255
  WHERE 2 * k < length(bytes)),
hashed AS (SELECT named, xor(c, 4294967295) AS h FROM walk WHERE 2 * k = length(bytes)),
cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
  FROM runs JOIN hashed USING (named)),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
shapes AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS x FROM shapes a JOIN shapes b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word FROM shapes a JOIN words w ON a.s = w.word
  UNION SELECT w.word, a.word FROM shapes a JOIN words w ON a.s = w.word),
best AS (
  SELECT near.word, count(*)::BIGINT AS n_near, arg_min(x, (-words.n, x)) AS x, max(words.n) AS x_n FROM near JOIN words ON near.x = words.word GROUP BY 1),
named AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN x_n >= 10 * w.n THEN x END AS form, CASE WHEN x_n >= 10 * w.n THEN x_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, word AS root FROM named UNION ALL SELECT c.word, f.form FROM chain c JOIN named f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT n.word, n.form, c.root, n.n, n.n_near, n.form_n FROM named n JOIN chain c ON n.word = c.word
JOIN named last ON c.root = last.word AND last.form IS NULL
"""


def _g(a: str, b: str, c: str, d: str) -> str:
    part = lambda x: f"CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END"
    return f"2 * ({part(a)} + {part(b)} + {part(c)} + {part(d)} - {part(f'{a} + {b}')} - {part(f'{c} + {d}')} - {part(f'{a} + {c}')} - {part(f'{b} + {d}')} + {part(f'{a} + {b} + {c} + {d}')})"


def _rule(what: int) -> str:
    """The longest fitting rule (0: its verdict, 1: its name) of a host and path."""
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(v, h + p)[what]}'" for v, h, p in order)
    return f"CASE {cases} END"


def url_templates_sql(levels: int = SINGLE + 8) -> str:
    """The levels written out one after the other: paths of up to SINGLE * 2**8 segments."""
    labels, shape = _g("good", "bad", "(p_good - good)", "(p_bad - bad)"), _g("ends", "(n - ends)", "(p_ends - ends)", "(p_n - n - p_ends + ends)")
    steps = []
    for k in range(levels):
        steps.append(f"""
b{k} AS (
  SELECT *, CASE WHEN n >= {MIN_BRANCH} AND bad > good THEN 1 ELSE 0 END AS side FROM (
    SELECT host, t, steps[{k + 1}] AS seg, sum(n) AS n, sum(good) AS good, sum(bad) AS bad, sum(CASE WHEN len(steps) = {k + 1} THEN n ELSE 0 END) AS ends FROM s{k} WHERE len(steps) > {k} GROUP BY 1, 2, 3)),
k{k} AS (
  SELECT host, t, seg, CASE WHEN n >= {MIN_SHARE} * o_n AND (n = p_n OR {labels} > {CRITICAL} OR {shape} > {CRITICAL}) THEN seg WHEN side = 1 THEN '*!' ELSE '*' END AS token
  FROM (SELECT *, sum(n) OVER node AS o_n, sum(n) OVER pool AS p_n, sum(good) OVER pool AS p_good, sum(bad) OVER pool AS p_bad, sum(ends) OVER pool AS p_ends
    FROM b{k} WINDOW node AS (PARTITION BY host, t), pool AS (PARTITION BY host, t, side)) WHERE n >= {MIN_BRANCH}),
s{k + 1} AS (
  SELECT s.host, path, n, good, bad, steps, CASE WHEN len(steps) > {k} THEN s.t || '/' || coalesce(b.token, '*') ELSE s.t END AS t
  FROM s{k} s LEFT JOIN k{k} b ON s.host = b.host AND s.t = b.t AND s.steps[{k + 1}] = b.seg),""")
    cuts = list(range(SINGLE)) + [SINGLE << k for k in range(levels - SINGLE)]
    blocks = ", ".join(f"[{c + 1}, {c + 1 if c < SINGLE else 2 * c}]" for c in cuts)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
parts AS (SELECT page_id, translate(h, {_AZ}) AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
rows AS (SELECT page_id, host, path, {_rule(0)} AS ruled, {_rule(1)} AS rule FROM parts),
known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS label FROM labels GROUP BY 1),
marked AS (SELECT rows.*, CASE ruled WHEN 'block' THEN 1 WHEN 'allow' THEN 0 ELSE label END AS label FROM rows LEFT JOIN known ON rows.page_id = known.page_id),
paths AS (SELECT host, path, count(*) AS n, count(*) FILTER (label = 0) AS good, count(*) FILTER (label = 1) AS bad FROM marked GROUP BY 1, 2),
s0 AS (
  SELECT *, '' AS t, CASE WHEN path = '' THEN [] ELSE list_transform(list_filter([{blocks}], lambda c: c[1] <= len(segs)), lambda c: array_to_string(segs[c[1]:c[2]], '/')) END AS steps
  FROM (SELECT *, string_split(substr(path, 2), '/') AS segs FROM paths)),{"".join(steps)}
templates AS (SELECT host, t, sum(good) AS good, sum(bad) AS bad FROM s{levels} GROUP BY 1, 2),
every AS (SELECT (sum(bad) + 1)::DOUBLE / (sum(good) + sum(bad) + 2) AS p FROM templates),
host_share AS (SELECT host, (sum(bad) + {PRIOR} * any_value(p)) / (sum(good) + sum(bad) + {PRIOR}) AS p FROM templates, every GROUP BY 1),
judged AS (SELECT t.host, t.t, round((bad + {PRIOR} * p) / (good + bad + {PRIOR}), 6) AS impurity FROM templates t JOIN host_share USING (host))
SELECT page_id, r.host, r.path, rule, coalesce(ruled, CASE WHEN impurity > {MOST_IMPURE} THEN 'block' ELSE 'allow' END) AS verdict, s.t AS template, impurity
FROM rows r JOIN s{levels} s ON r.host = s.host AND r.path = s.path JOIN judged j ON s.host = j.host AND s.t = j.t
"""


URL_TEMPLATES = url_templates_sql()

ORACLE = {
    "op1_jaccard_forest": JACCARD,
    "op6_preference_format": PREFERENCE,
    "op7_decontamination": DECONTAMINATION,
    "op8_warc": ARCHIVE,
    "op9_quality_rules": QUALITY,
    "op11_filter_audit": FILTER_AUDIT,
    "op12_spelling_variants": SPELLING,
    "op13_url_templates": URL_TEMPLATES,
}
