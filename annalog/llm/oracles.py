"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from annalog.llm import pii, url_filters

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
wanted AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM item WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM wanted),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, lengths WHERE len(w) >= n)
),
hits AS (SELECT r, windows.n, s, item_id FROM windows JOIN wanted USING (win)),
covered AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS place FROM hits) GROUP BY r
),
items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

_BY_LENGTH = sorted(url_filters.WORD_RULES, key=lambda r: (len(r.name), r.name), reverse=True)
_WORD_CASES = "\n    ".join(
    f"WHEN regexp_matches(site, '(?i)(?:^|[^a-z0-9]){r.name}(?:[^a-z0-9]|$)') THEN '{r.name}'" for r in _BY_LENGTH
)

URL_FILTERS = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
judged AS (
  SELECT *, host || path AS site,
    CASE
      WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
      WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/'
    END AS rule
  FROM parts
),
worded AS (
  SELECT *, CASE
    {_WORD_CASES}
    END AS word
  FROM judged
)
SELECT page_id, host, path, rule, coalesce(rule, word) AS matched,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN word IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM worded
"""

# The base patterns as stated; the operator's own say the same without backtracking.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": pii.PATTERNS["iban"],
    "ssn": pii.PATTERNS["ssn"],
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN CAST(d[length(d) + 1 - i] AS INT)
      WHEN CAST(d[length(d) + 1 - i] AS INT) > 4 THEN CAST(d[length(d) + 1 - i] AS INT) * 2 - 9
      ELSE CAST(d[length(d) + 1 - i] AS INT) * 2 END)) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0, list_transform(
    string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''),
    lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)),
    lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"""
_VALID = {
    "email": "true",
    "ip": "list_min(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 "
    "AND coalesce(TRY_CAST(p AS HUGEINT), 999) <= 255))",
    "card": f"length(d) BETWEEN 12 AND 19 AND {_LUHN}",
    "phone": "length(d) BETWEEN 9 AND 15",
    "iban": f"NOT regexp_matches(before || after, '[A-Za-z0-9]') AND {_MOD97}",
    "ssn": "NOT regexp_matches(before || after, '[0-9-]')",
}


def _kind(k: str) -> str:
    rank, prior = pii.KINDS.index(k), pii.PRIOR[k]
    least = 0 if k in pii.BASE_KINDS else pii.ADDED_MIN
    return f"""
  SELECT r, {rank} AS rank, '{k}' AS kind, a AS start, a + length(v) AS stop, score FROM (
    SELECT *, {_DIGITS} AS d, {prior} + CASE WHEN regexp_matches(lower(right(piece, {pii.CONTEXT_CHARS})), '{pii.CONTEXT[k]}')
        THEN {pii.CONTEXT_BONUS} ELSE 0 END AS score,
      CASE WHEN a > 0 THEN substr(t, a, 1) ELSE '' END AS before, substr(t, a + length(v) + 1, 1) AS after
    FROM (
      SELECT r, t, m[i] AS v, p[i] AS piece, CAST(length(array_to_string(p[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS BIGINT) AS a
      FROM (SELECT r, t, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT r, t, regexp_extract_all(t, '{_PATTERNS[k]}') AS m, string_split_regex(t, '{_PATTERNS[k]}') AS p FROM doc))
    )
  ) WHERE score >= {least} AND {_VALID[k]}"""


PII = f"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
span AS MATERIALIZED ({" UNION ALL ".join(_kind(k) for k in pii.KINDS)}
),
told AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE_KINDS)},
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(pii.BASE_KINDS)}) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
    string_agg(CAST(score AS VARCHAR), ',' ORDER BY start, rank) AS scores
  FROM span GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM doc LEFT JOIN told USING (r)
"""

_COUNT = r"len(regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+'))"

# Every seat is listed and ranked; the saturated sources are a prefix in the order of their limits.
MIXING = f"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_COUNT.format("text")} AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS draw
  FROM documents
),
named AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
  FROM (SELECT source, sum(size) AS source_size FROM sized GROUP BY source)
),
weighed AS (SELECT *, CAST([3, 1, 2][no % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM named),
lined AS (
  SELECT *, 1.5 * CAST((SELECT sum(source_size) FROM named) AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM weighed
),
level AS (SELECT rest, open_weight FROM lined WHERE rest * weight / open_weight <= cap ORDER BY cap / weight, no LIMIT 1),
sources AS (
  SELECT source, source_size, no, least(coalesce((SELECT rest FROM level) * weight / (SELECT open_weight FROM level), cap), cap) AS target,
    greatest(CAST(ceil(source_size / 1000000.0) AS BIGINT), 1) AS shards
  FROM weighed
),
dealt AS (
  SELECT sized.*, no, source_size, target, CAST('0x' || substr(draw, 1, 8) AS BIGINT) % shards AS shard
  FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source
),
cells AS (
  SELECT no, shard, CAST(sum(size) AS BIGINT) AS words, greatest(CAST(floor(sum(size) / 16.0 + 0.5) AS BIGINT), 1) AS blocks
  FROM dealt GROUP BY no, shard HAVING sum(size) > 0
),
votes AS (
  SELECT no, own, CAST(floor(target * own / source_size * 1000 + 0.5) AS BIGINT) AS v
  FROM sources JOIN (SELECT no, CAST(sum(blocks) AS BIGINT) AS own FROM cells GROUP BY no) USING (no)
),
source_seats AS (
  SELECT no, own, row_number() OVER (ORDER BY CAST(v AS DOUBLE) / (2 * k - 1) DESC, no) AS place
  FROM (SELECT no, own, v, unnest(range(1, 2 * own + 3)) AS k FROM votes WHERE v > 0)
),
quotas AS (
  SELECT no, least(count(*), 2 * own) AS quota FROM source_seats
  WHERE place <= ((SELECT sum(v) FROM votes) + 500) // 1000 GROUP BY no, own
),
shard_seats AS (
  SELECT no, shard, row_number() OVER (PARTITION BY no ORDER BY CAST(blocks AS DOUBLE) / (2 * k - 1) DESC, shard) AS place
  FROM (SELECT no, shard, blocks, unnest(range(1, 2 * blocks + 3)) AS k FROM cells)
),
shard_quotas AS (
  SELECT no, shard, count(*) AS q FROM shard_seats JOIN quotas USING (no) WHERE place <= quota GROUP BY no, shard
),
runs AS (
  SELECT no, shard, words, blocks, coalesce(q, 0) // blocks AS laps, coalesce(q, 0) % blocks AS rest,
    CAST('0x' || substr(md5('7:' || no || ':' || shard), 1, 8) AS BIGINT) % blocks AS start
  FROM cells LEFT JOIN shard_quotas USING (no, shard)
),
edges AS (
  SELECT no, shard, laps, start * words // blocks AS low, least(start + rest, blocks) * words // blocks AS high,
    greatest(start + rest - blocks, 0) * words // blocks AS more
  FROM runs
),
placed AS (
  SELECT *, coalesce(CAST(sum(size) OVER (PARTITION BY no, shard ORDER BY draw, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS begins
  FROM dealt
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE laps * size + greatest(least(more, begins + size) - begins, 0)
    + greatest(least(high, begins + size) - greatest(low, begins), 0) END AS taken
FROM placed LEFT JOIN edges USING (no, shard)
"""

_CRC = (
    "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(str_split(CAST(conv_id AS VARCHAR), ''), "
    "lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), "
    "lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"
)

PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS k, id, words
  FROM (
    SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, {_COUNT.format("text")} AS words
    FROM conversations WHERE conv_id IS NOT NULL
  )
),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
joined AS (
  SELECT convs.conv_id, 0 AS part, k, id, words FROM convs JOIN turns ON turns.conv_id = base AND k <= h
  UNION ALL
  SELECT conv_id, 1, k, id, words FROM convs JOIN turns USING (conv_id) WHERE k > h
),
prefixes AS (
  SELECT conv_id, count(*) OVER w AS depth, string_agg(id, '') OVER w AS prefix, words
  FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY part, k ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
),
lengths AS (SELECT conv_id, max(depth) AS length FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY prefix, depth
),
children AS (SELECT substr(prefix, 1, 32 * (depth - 1)) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (
  SELECT substr(prefix, 1, 32 * up) AS prefix, sum(saved) AS saved, count(*) FILTER (WHERE n IS NULL) AS n_leaves
  FROM (SELECT prefix, saved, n, unnest(range(0, depth + 1)) AS up FROM nodes LEFT JOIN children USING (prefix)) GROUP BY 1
)
SELECT nodes.conv_id, nodes.depth, parents.conv_id AS parent_conv_id, nodes.n_convs, coalesce(children.n, 0) AS n_children,
  above.n_leaves, CAST(above.saved AS BIGINT) AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN above ON above.prefix = nodes.prefix LEFT JOIN children ON children.prefix = nodes.prefix
LEFT JOIN nodes AS parents ON nodes.depth > 0 AND parents.prefix = substr(nodes.prefix, 1, 32 * (nodes.depth - 1))
"""


def _clusters(rounds: int) -> str:
    square = "list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""
assigned{i} AS MATERIALIZED (
  SELECT kept.r, kept.vec_id, kept.v, c.c, CAST({square} AS BIGINT) AS distance
  FROM kept, centroids{i} AS c QUALIFY row_number() OVER (PARTITION BY kept.r ORDER BY distance, c.c) = 1
),
sums{i} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM assigned{i}) GROUP BY c, i
),
centroids{i + 1} AS MATERIALIZED (
  SELECT old.c, coalesce(new.v, old.v) AS v FROM centroids{i} AS old LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM sums{i} GROUP BY c
  ) AS new USING (c)
),""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
),
centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < 16
),{"".join(parts)}
inertia AS (SELECT c, CAST(sum(distance) AS BIGINT) AS s FROM assigned{rounds} GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, distance, s AS cluster_inertia, CAST((SELECT sum(s) FROM inertia) AS BIGINT) AS inertia,
  sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM assigned{rounds} AS a JOIN inertia USING (c) JOIN centroids{rounds} AS f USING (c)
"""


CLUSTERS = _clusters(3)
