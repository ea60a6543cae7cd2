"""DuckDB SQL for what SQL can say of the training-data operators: whole results or their base columns."""

from __future__ import annotations

#: Lower-cases A-Z only.
LOW = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
VISIBLE = r"'[^\x20\x09-\x0D]+'"
DECONTAMINATE = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all({LOW.format(x='text')}, {ALNUM}), []) AS w FROM documents),
 i AS (SELECT item_id, regexp_extract_all({LOW.format(x='text')}, {ALNUM}) AS w FROM benchmark WHERE text IS NOT NULL),
 n AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda k: array_to_string(w[k:k + least(len(w), 13) - 1], ' '))) AS phrase FROM i WHERE len(w) > 0),
 s AS (SELECT DISTINCT size FROM n),
 o AS (SELECT row, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS phrase FROM (SELECT row, size, w, unnest(range(1, len(w) - size + 2)) AS pos FROM d, s WHERE len(w) >= size)),
 h AS (SELECT o.row, o.pos, o.size, n.item_id FROM o JOIN n USING (phrase, size)),
 c AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT row, unnest(range(pos, pos + size)) AS place FROM h) GROUP BY 1),
 m AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (row) LEFT JOIN m USING (row)"""
QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {VISIBLE}) AS w FROM documents),
 g AS (SELECT row, pos, array_to_string(w[pos:pos + 4], ' ') AS phrase FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS pos FROM d WHERE len(w) >= 5)),
 r AS (SELECT row, count(DISTINCT place) AS n_repeat_words FROM (SELECT row, unnest(range(pos, pos + 5)) AS place FROM g WHERE (row, phrase) IN (SELECT row, phrase FROM g GROUP BY ALL HAVING count(*) > 1)) GROUP BY 1),
 l AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {VISIBLE}) GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w) AS base_failed FROM d LEFT JOIN r USING (row) LEFT JOIN l USING (row)"""
_CARD = r"[0-9](?:[\x20-]?[0-9])+"
#: crc32 of the id as text, byte by byte.
CRC32_OF = "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(@, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0::UBIGINT for z in range(8)]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)"
CRC32 = CRC32_OF.replace("@", "CAST(doc_id AS VARCHAR)")
LM = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {CRC32} % 10 = 0 AS held_out, list_concat(regexp_extract_all({LOW.format(x="coalesce(text, '')")}, {VISIBLE}), ['']) AS w FROM documents),
 t AS (SELECT row, held_out, unnest(w) AS token FROM d), c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), s AS (SELECT sum(c) AS n, count(*) AS v FROM c),
 x AS (SELECT row, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS base_score FROM t LEFT JOIN c USING (token), s GROUP BY 1)
 SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, round(base_score, 3) AS base_score FROM d JOIN x USING (row), s"""


def _spans(kind: str, pattern: str, check: str) -> str:
    """Row, kind, start and value of the leftmost matches that pass the check over @."""
    return f"""SELECT row, '{kind}' AS kind, list_sum(list_transform(p[1:k], lambda x: length(x))) + list_sum(list_transform(list_concat([''], m[1:k - 1]), lambda x: length(x))) AS start, m[k] AS value
 FROM (SELECT row, p, m, unnest(range(1, len(m) + 1)) AS k FROM (SELECT row, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m FROM d)) WHERE {check.replace('@', 'm[k]')}"""


DIGITS = "regexp_replace(@, '[^0-9]', '', 'g')"
LUHN = f"length({DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(list_reverse(string_split({DIGITS}, '')), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END)) % 10 = 0"
# fixed values: the base kinds, in the order in which they are listed
KINDS = (
 ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
 ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(@, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 256) <= 255))"),
 ("card", _CARD, LUHN),
 ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 8 AND 15"),
)
PII = "WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(_spans(*k) for k in KINDS) + """),
 a AS (SELECT row, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
 string_agg(concat(kind, ':', start, ':', start + length(value)), ',' ORDER BY list_position(['email', 'ip', 'card', 'phone'], kind), start) AS listed FROM s GROUP BY 1)
 SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(listed, '')) AS base_sha256 FROM d LEFT JOIN a USING (row)"""


def _step(state: str, cost: int, edit: str, turn: str) -> str:
    """A state after one more edit; `turn` is the SQL of the turn that it leaves, if any."""
    kept = f"list_append({state}.t, {turn})" if turn else f"{state}.t"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {kept}}}"


def _least(*options: str) -> str:
    """The least option by cost and audit; the turns follow from the audit."""
    return f"list_sort([{', '.join(options)}])[1]"


def _edits(state: str, letter: str, role: str) -> list[str]:
    """Keep and re-role from a state that wants `letter`; FAR where the turn must go."""
    stays = "CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000::BIGINT WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    return [_step(state, f"{stays} + CASE WHEN letter = '{letter}' THEN 0 ELSE 1000000000::BIGINT END", "K", "role || ':' || text"), _step(state, f"{stays} + 1", "R", f"'{role}:' || text")]


_SPACE = r"'[^\x20\x09-\x0D]'"
_FAR = "{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}"
#: The four states are s0 (nothing yet), s1 (system), s2 (user), s3 (assistant); u and e are s2 and s3 after the inserts that can help.
_CLOSED = f"SELECT *, {_least('s3', _step('u', 5, 'I', "'assistant:'"))} AS e FROM (SELECT *, {_least('s2', *(_step(s, 5, 'I', "'user:'") for s in ('s0', 's1', 's3')))} AS u FROM v)"
TURNS = f"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32_OF.replace('@', "concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
 b AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS twin FROM d WHERE kind <> 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, twin) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, twin) AS nth, left(role, 1) AS letter FROM b),
 f AS (SELECT *, CASE WHEN NOT regexp_matches(text, {_SPACE}) THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault, lag(letter) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
 v AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s0, {_FAR} AS s1, {_FAR} AS s2, {_FAR} AS s3 FROM f
  UNION ALL SELECT x.conv_id, f.i, {_step('s0', 2, 'D', '')}, {_least(_step('s1', 2, 'D', ''), _edits('s0', 's', '')[0])}, {_least(_step('u', 2, 'D', ''), *(e for s in ('s0', 's1', 'e') for e in _edits(s, 'u', 'user')))}, {_least(_step('e', 2, 'D', ''), *_edits('u', 'a', 'assistant'))} FROM ({_CLOSED}) AS x JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i + 1),
 r AS (SELECT conv_id, {_least('s0', 'e')} AS best FROM ({_CLOSED.replace('FROM v)', 'FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS last FROM v) WHERE i = last)')})),
 c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
 SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) AS k LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM k.conv_id"""
WHITENING = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), FALSE)))),
 e AS (SELECT x, unnest(x) AS c, unnest(range(len(x))) AS d FROM (SELECT DISTINCT x FROM v)), t AS (SELECT d, sum(c) AS s FROM e GROUP BY 1), k AS (SELECT count(*) AS n FROM (SELECT DISTINCT x FROM v)), l AS (SELECT list(s ORDER BY d) AS s FROM t)
 SELECT vec_id, CAST(n AS BIGINT) AS n, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (n * x[i] - s[i]) * (n * x[i] - s[i]))) AS BIGINT) AS deviation FROM v, k, l"""
