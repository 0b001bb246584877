"""The SQL of the registered queries, for DuckDB."""

from __future__ import annotations

import math

from . import fill_middle, importance
from .license_scan import CONTAINMENT, STEP, step_of, templates
from .mixing import MOST, SEEDS, WEIGHTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

_MIX = rf"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *,
    sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER fill, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER fill, 0) AS left_weight
  FROM sums
  WINDOW fill AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), share AS (
  SELECT rest, left_weight FROM filled
  WHERE {MOST} * source_size * left_weight >= weight * rest
  ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size,
    CASE WHEN {MOST} * source_size < weight * rest::DOUBLE / left_weight THEN ({MOST} * source_size)::DOUBLE
      ELSE weight * rest::DOUBLE / left_weight END AS target
  FROM sums, share
), rated AS (
  SELECT rid, doc_id, size, targets.source, source_size, target, seed, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || seed), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source, range({SEEDS}) seeds(seed)
), tried AS (
  SELECT *, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
), seeds AS (
  SELECT source, arg_min(seed, (abs(taken - target), seed)) AS seed FROM (SELECT source, seed, target, sum(taken) AS taken FROM tried GROUP BY source, seed, target) GROUP BY source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken
FROM tried JOIN seeds ON tried.seed = seeds.seed AND tried.source IS NOT DISTINCT FROM seeds.source
"""


def _license_sql() -> str:
    found = templates()
    assert all(step_of(words) == STEP for _, _, words in found)  # one length of blocks
    # Of a template's words a block may lack so many; one of one more is in every block that matches.
    any_word = sorted({w for _, _, words in found for w in sorted(set(words))[: len(set(words)) - math.ceil(CONTAINMENT * len(set(words)) - 1e-9) + 1]})
    needed = ", ".join(f"'{w}'" for w in any_word)
    values = ", ".join(f"('{kind}', '{label}', '{' '.join(words)}')" for kind, label, words in found)
    return rf"""
WITH worded AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents),
templates AS (SELECT kind, label, string_split(phrase, ' ') AS phrase, list_distinct(string_split(phrase, ' ')) AS tokens FROM (VALUES {values}) v(kind, label, phrase)),
numbered AS (SELECT rid, words, unnest(range(0, len(words), {STEP})) AS first FROM worded),
blocks AS (SELECT rid, first, words[first + 1:first + {2 * STEP}] AS words FROM numbered),
matched AS (
  SELECT rid, first, blocks.words, kind, label, phrase, len(list_intersect(tokens, blocks.words))::DOUBLE / len(tokens) AS containment
  FROM blocks, templates
  WHERE list_has_any(blocks.words, [{needed}])
    AND len(list_intersect(tokens, blocks.words))::DOUBLE / len(tokens) >= {CONTAINMENT}
), placed AS (
  SELECT *, CASE WHEN kind = 'base' THEN list_filter(range(0, least({STEP}, len(words))), lambda s: words[s + 1:s + len(phrase)] = phrase) ELSE []::BIGINT[] END AS places
  FROM matched
), found AS (
  SELECT rid, sum(len(places)) AS n_base, min(first + list_min(places)) AS first_word, max(first + list_max(places)) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (len(places) > 0))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label) FILTER (kind <> 'base' OR len(places) > 0))), ',') AS labels,
    max(containment) FILTER (kind <> 'base' OR len(places) > 0) AS score
  FROM placed GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM worded LEFT JOIN found USING (rid)
"""


_EXACT = rf"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS sha FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY sha ORDER BY points DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
    row_number() OVER (PARTITION BY doc_id, sha ORDER BY points DESC) AS turn
  FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND turn = 1 AS kept, sha AS text_sha256 FROM ranked
"""

_LINES = rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT rid, doc_id, n, line, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key
  FROM (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM texts)
), repeated AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
marked AS (SELECT rid, n, line, coalesce(doc_id <> first, false) AS dropped FROM lines LEFT JOIN repeated USING (key)),
kept AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT dropped), '') AS kept
  FROM marked GROUP BY rid
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM texts JOIN kept USING (rid)
"""

_WINNOW = rf"""
WITH items AS (SELECT item_id, words, least(10, len(words)) AS size FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[s:s + size - 1], ' ') AS span
  FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM items)
), texts AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents),
spans AS (
  SELECT rid, s, size, array_to_string(words[s:s + size - 1], ' ') AS span
  FROM (SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM texts, (SELECT DISTINCT size FROM windows))
), matches AS (SELECT rid, s, size, item_id FROM spans JOIN windows USING (size, span)),
hit AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(s, s + size)) AS w FROM matches) GROUP BY rid),
by_item AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM matches GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (rid) LEFT JOIN by_item USING (rid)
"""

_MIDDLE = rf"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    [('0x' || substr(sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')), 8 * k + 1, 8))::BIGINT for k in range(4)] AS h
  FROM documents
), placed AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= {fill_middle.RATE} THEN 'plain'
      WHEN h[4] % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM placed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

# The CRC of a word goes byte by byte through a table that follows from the polynomial.
_IMPORTANCE = rf"""
WITH RECURSIVE steps AS (
  SELECT range AS b, range::BIGINT AS v, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
texts AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents),
source_words AS (SELECT rid, unnest(words) AS word FROM texts),
target_words AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
bytes AS (
  SELECT word, list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i::INT + 1, 2))::BIGINT) AS codes
  FROM (SELECT word FROM source_words UNION SELECT word FROM target_words)
), buckets AS (
  SELECT word, xor(list_reduce(codes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {importance.BUCKETS} AS bucket
  FROM bytes, crc
), s AS (SELECT bucket, count(*) AS n FROM source_words JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_words JOIN buckets USING (word) GROUP BY bucket),
sizes AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + {importance.BUCKETS} AS of_s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + {importance.BUCKETS} AS of_t),
gains AS (
  SELECT s.bucket, floor({importance.SCALE} * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * of_s / ((s.n + 1.0::DOUBLE) * of_t)))::BIGINT AS gain FROM sizes, s LEFT JOIN t ON s.bucket = t.bucket
), weights AS (
  SELECT rid, count(*) AS n_features, sum(gain)::BIGINT AS total FROM source_words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY rid
), scored AS (
  SELECT rid, doc_id, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
    floor(-{importance.SCALE}.0::DOUBLE * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS draw
  FROM texts LEFT JOIN weights USING (rid)
), ranked AS (
  SELECT rid, row_number() OVER (ORDER BY weight + draw DESC, doc_id NULLS LAST) AS place, count(*) OVER () * {importance.PERCENT} // 100 AS n_drawn
  FROM scored WHERE n_features >= {importance.LEAST_WORDS}
)
SELECT doc_id::BIGINT AS doc_id, n_features::BIGINT AS n_features, weight, weight + draw AS score, CASE WHEN place <= n_drawn THEN place END AS rank
FROM scored LEFT JOIN ranked USING (rid)
"""

SQL = {
    "op1_mix": _MIX,
    "op2_license_scan": _license_sql(),
    "op3_exact_dedup": _EXACT,
    "op8_line_dedup": _LINES,
    "op10_decontaminate": _WINNOW,
    "op12_fill_middle": _MIDDLE,
    "op13_importance": _IMPORTANCE,
}
