"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from chronotrace.llm.quality import PRIOR, ROUNDS, RULES, START_BAD, START_GOOD
from chronotrace.llm.source_mix import KEY_BITS, PHI, WEIGHTS

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SOURCE_MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, 'null')), 1, {KEY_BITS // 4}))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS s
  FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][((s - 1) % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
f AS (SELECT arg_min(level, (cap / w, s)) FILTER (cap >= level * w) AS level FROM l),
t AS (SELECT l.*, least(cap, coalesce(f.level * w, cap)) AS target, floor(least(cap, coalesce(f.level * w, cap)) + 0.5)::BIGINT AS quota FROM l, f),
p AS (
  SELECT d.*, t.s, t.source_size, t.target, t.quota,
         coalesce(sum(size) OVER (PARTITION BY t.s ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT s, quota, n, (sum(n) OVER (ORDER BY s) - n)::BIGINT AS lo, (sum(n) OVER ())::BIGINT AS every
  FROM (SELECT s, quota, (quota + 1023) // 1024 AS n FROM t)),
g AS (
  SELECT slot, least(floor(((slot + 1) * {PHI}::DOUBLE - floor((slot + 1) * {PHI}::DOUBLE)) * every)::BIGINT, every - 1) AS x
  FROM (SELECT unnest(range(0, every)) AS slot, every FROM (SELECT max(every) AS every FROM c))),
r AS (SELECT c.s, slot, row_number() OVER (PARTITION BY c.s ORDER BY slot) - 1 AS r FROM g JOIN c ON x >= lo AND x < lo + n),
due AS (SELECT s, every, lo, unnest(range(got, n)) AS r FROM (SELECT c.*, (SELECT count(*) FROM r WHERE r.s = c.s) AS got FROM c)),
b AS (
  SELECT k.s, slot, r * 1024 AS lo, least((r + 1) * 1024, c.quota) AS hi
  FROM (SELECT r.s, slot, r FROM r JOIN c ON c.s = r.s AND r < n UNION ALL SELECT s, every + lo + r, r FROM due) k JOIN c ON c.s = k.s),
z AS (SELECT s, a, size, unnest(range(0, quota // source_size + 1)) * source_size + a AS at FROM p WHERE size > 0),
h AS (SELECT z.s, z.a, min(slot) AS first_slot FROM z JOIN b ON b.s = z.s AND b.lo < z.at + z.size AND z.at < b.hi GROUP BY ALL)
SELECT doc_id, p.size, source_size, target,
       CASE WHEN p.size = 0 THEN 0 ELSE (quota // source_size) * p.size
         + greatest(0, least(p.a + p.size, quota % source_size) - p.a) END::BIGINT AS taken,
       CASE WHEN p.size > 0 THEN first_slot END AS first_slot
FROM p LEFT JOIN h ON h.s = p.s AND h.a = p.a
"""


def _quality_sql() -> str:
    traits = {n: t.replace("100 *", "100.0::DOUBLE *").replace("100 /", "100.0::DOUBLE /").replace("word_chars / n_words", "word_chars::DOUBLE / n_words") for n, t, _, _ in RULES}
    vote = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN ({traits[n]}) <= {g}::DOUBLE THEN 1 WHEN ({traits[n]}) > {b}::DOUBLE THEN -1 ELSE 0 END" for n, _, g, b in RULES)
    k = len(RULES)
    row = lambda p: "[" + ", ".join(f"{x}::DOUBLE" for x in p) + "]"
    model = lambda p: "[" + ", ".join(row(p) for _ in RULES) + "]"
    def post(prior: str, b: str, g: str, v: str) -> str:
        terms = " ".join(f"+ ln({g}[{r}][{v}[{r}] + 2]) - ln({b}[{r}][{v}[{r}] + 2])" for r in range(1, k + 1))
        return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-(ln({prior} / (1.0::DOUBLE - {prior})) {terms})))"
    steps = [f"m0 AS (SELECT {PRIOR}::DOUBLE AS prior, {model(START_BAD)} AS b, {model(START_GOOD)} AS g)"]
    for i in range(ROUNDS):
        def chances(weight: str) -> str:
            cell = lambda r, o: f"(1.0::DOUBLE + coalesce(sum({weight}) FILTER (v[{r}] = {o}), 0))"
            return "[" + ", ".join("[" + ", ".join(f"{cell(r, o)} / ({cell(r, -1)} + {cell(r, 0)} + {cell(r, 1)})" for o in (-1, 0, 1)) + "]" for r in range(1, k + 1)) + "]"
        steps.append(f"q{i} AS (SELECT v, n, n * {post('prior', 'b', 'g', 'v')} AS gd FROM pat, m{i})")
        steps.append(f"m{i + 1} AS (SELECT (sum(gd) + 1) / (sum(n) + 2) AS prior, {chances('n - gd')} AS b, {chances('gd')} AS g FROM q{i})")
    windows = "[hash(words[i:i + 7]) for i in range(1, len(words) - 6)]"
    return f"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
i AS (SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS ink, {windows} AS h FROM a),
win AS (SELECT doc_id, unnest(h) AS x, generate_subscripts(h, 1) AS p FROM i WHERE len(list_distinct(h)) < len(h)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(p - lp, 8)))::BIGINT AS n FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS lp FROM dup) GROUP BY doc_id),
c AS (
  SELECT i.doc_id, len(words)::BIGINT AS n_words, length(ink)::BIGINT AS word_chars,
         (length(ink) - length(regexp_replace(ink, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         (length(ink) - length(regexp_replace(ink, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
         (length(ink) - length(regexp_replace(ink, '[0-9]', '', 'g')))::BIGINT AS n_digits,
         (length(ink) - length(regexp_replace(ink, '[!#$%&*+/<=>@\\\\^_`{{|}}~]', '', 'g')))::BIGINT AS n_odd
  FROM i LEFT JOIN cov ON i.doc_id = cov.doc_id),
vv AS (SELECT *, [{vote}] AS v FROM c),
pat AS (SELECT v, count(*)::DOUBLE AS n FROM vv GROUP BY v),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {post("prior", "b", "g", "v")} >= 0.5 AS kept
FROM vv, m{ROUNDS}
"""


QUALITY_SQL = _quality_sql()


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NGRAM_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", _LOW)} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s
  FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
g AS (SELECT DISTINCT doc_id, unnest(s) AS g FROM s),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(reach) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY 1, 2
"""

#: Remainder by 4 of the CRC-32 of the decimal id, bit by bit: a character is XORed in, then eight shifts.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
  lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4"""

REBUILT_TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT c, {_CRC} AS h, c - c % 20 AS base FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT e.c, t.pos, t.role, t.text FROM e JOIN t ON t.c = e.base AND t.pos <= e.h
  UNION ALL SELECT t.c, t.pos, t.role, t.text FROM t JOIN e ON e.c = t.c AND t.pos > e.h),
s AS (
  SELECT e.c, coalesce(x.seq, []) AS seq FROM e
  LEFT JOIN (SELECT c, list(struct_pack(r := role, t := text) ORDER BY pos) AS seq FROM r GROUP BY c) x ON x.c = e.c),
m AS (SELECT c, d AS depth, len(seq) AS n, seq[1:d] AS pre FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)),
n AS (
  SELECT pre, depth, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth) AS ends
  FROM m GROUP BY pre, depth),
k AS (SELECT pre[1:depth - 1] AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, p.conv_id AS parent_conv_id,
    (n.n_convs - 1) * (CASE WHEN n.depth = 0 THEN 0 ELSE len(regexp_extract_all(n.pre[n.depth].t, '[^\\x20\\x09-\\x0D]+')) END) AS saved
  FROM n LEFT JOIN k ON k.up = n.pre LEFT JOIN n p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.pre = n.pre[1:n.depth - 1]),
g AS (
  SELECT f.pre[1:a] AS top, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.saved) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM f) f GROUP BY 1)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, g.n_leaves, g.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN g ON g.top = f.pre
"""
