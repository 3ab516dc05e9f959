"""SQL for those queries of this subpackage that SQL can express."""

SQL: dict[str, str] = {}

SQL["op1_chat"] = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
    SELECT *,
        role || chr(10) || text || chr(10) AS spoken,
        CASE WHEN role = 'assistant' THEN text ELSE '' END AS masked,
        length(replace(replace(replace(role, '\', '\\'), '>', '\g'), '<', '\l'))
            + length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '<turn ', '<\turn '))
            + length('<turn ') + length('>') + 1 + length('</turn>') + 1 AS chars
    FROM rows
)
SELECT
    conv_id,
    count(*) AS n_turns,
    sha256(string_agg(spoken, '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(length(masked)) AS BIGINT) AS loss_chars,
    sha256(string_agg(masked, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

SQL["op7_top_k"] = """
WITH valid AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM valid q JOIN valid c ON len(q.v) = len(c.v) AND q.vec_id IS DISTINCT FROM c.vec_id
    WHERE q.vec_id % 50 = 0
)
SELECT query_id,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

SQL["op8_repeated_words"] = r"""
WITH texts AS (
    SELECT doc_id,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS window_text
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts)
), least AS (
    SELECT window_text, min(doc_id) AS least FROM windows GROUP BY window_text
), repeated AS (
    SELECT w.doc_id, w.i FROM windows w JOIN least l USING (window_text) WHERE l.least < w.doc_id
), words AS (
    SELECT t.doc_id, t.j, t.word, max(r.i) OVER (PARTITION BY t.doc_id ORDER BY t.j) AS last_start
    FROM (SELECT doc_id, unnest(range(1, len(words) + 1)) AS j, unnest(words) AS word FROM texts) t
    LEFT JOIN repeated r ON r.doc_id = t.doc_id AND r.i = t.j
), marked AS (
    SELECT *, coalesce(j - last_start < 50, false) AS removed FROM words
)
SELECT t.doc_id,
    len(t.words) AS n_words,
    count(m.j) FILTER (WHERE m.removed) AS n_removed,
    sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.j) FILTER (WHERE NOT m.removed), '')) AS kept_sha256
FROM texts t LEFT JOIN marked m ON m.doc_id = t.doc_id
GROUP BY t.doc_id, len(t.words)
"""

# Texts are cut into pieces of 512 bytes and what windows need beyond, as a place in a long text takes time
# to reach. Windows are compared by hash first, and as text where their hash occurs in several documents.
SQL["op9_repeated_bytes"] = """
WITH texts AS MATERIALIZED (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents
), pieces AS MATERIALIZED (
    SELECT doc_id, c, substr(digits, 1024 * c + 1, 1024 + 98) AS part
    FROM (SELECT doc_id, digits, unnest(range(0, (length(digits) + 1023) // 1024)) AS c FROM texts)
), hashed AS MATERIALIZED (
    SELECT doc_id, c, k, hash(substr(part, 2 * k + 1, 100)) AS h
    FROM (SELECT doc_id, c, part, unnest(range(0, least(512, length(part) // 2 - 49))) AS k FROM pieces)
), shared AS MATERIALIZED (
    SELECT h FROM hashed GROUP BY h HAVING min(doc_id) < max(doc_id)
), windows AS MATERIALIZED (
    SELECT w.doc_id, 512 * w.c + w.k AS i, w.h, substr(p.part, 2 * w.k + 1, 100) AS window_digits
    FROM hashed w SEMI JOIN shared USING (h) JOIN pieces p USING (doc_id, c)
), least AS MATERIALIZED (
    SELECT h, window_digits, min(doc_id) AS least FROM windows GROUP BY h, window_digits
), repeated AS MATERIALIZED (
    SELECT w.doc_id, w.i FROM windows w JOIN least l USING (h, window_digits) WHERE l.least < w.doc_id
), bytes AS (
    SELECT t.doc_id, t.j, t.byte, max(r.i) OVER (PARTITION BY t.doc_id ORDER BY t.j) AS last_start
    FROM (SELECT doc_id, 512 * c + k AS j, substr(part, 2 * k + 1, 2) AS byte
        FROM (SELECT doc_id, c, part, unnest(range(0, least(512, length(part) // 2))) AS k
            FROM pieces SEMI JOIN repeated USING (doc_id))) t
    LEFT JOIN repeated r ON r.doc_id = t.doc_id AND r.i = t.j
), marked AS (
    SELECT *, coalesce(j - last_start < 50, false) AS removed FROM bytes
), edges AS (
    SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY j), false) AS edge
    FROM marked
), changed AS (
    SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed, count(*) FILTER (WHERE edge) AS n_spans,
        coalesce(string_agg(byte, '' ORDER BY j) FILTER (WHERE NOT removed), '') AS kept
    FROM edges GROUP BY doc_id
)
SELECT doc_id, length(digits) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(from_hex(coalesce(kept, digits))) AS kept_sha256
FROM texts LEFT JOIN changed USING (doc_id)
"""


def _edited(value: str, cost: int | str, letter: str) -> str:
    """Edits as text that orders like (cost, audit), with one more edit."""
    return f"lpad(CAST(CAST(left({value}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({value}, 10) || '{letter}'"


# Edits up to a row by the state they lead to: nothing yet, system, user, assistant. After a row first
# what keeps, renames or deletes it, then insertions.
_CUT = "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END"
_STAYS = "fault NOT IN ('blank', 'duplicate')"


def _row(before: dict[str, str], after: str) -> str:
    options = [_edited(f"s.{after}", 3, "D")]
    for state, role in before.items():
        kept = _edited(f"s.{state}", f"({_CUT})", "K")
        options.append(f"CASE WHEN {_STAYS} AND initial = '{role}' THEN {kept} END")
        if role != "s":
            renamed = _edited(f"s.{state}", f"(2 + {_CUT})", "R")
            options.append(f"CASE WHEN {_STAYS} THEN {renamed} END")
    return f"least({', '.join(options)}) AS {after}"


SQL["op13_repair"] = rf"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
            || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS codes
    FROM conversations
), checked AS (
    SELECT *, xor(list_reduce([4294967295] || codes, lambda crc, code: list_reduce([xor(crc, code)] || range(8),
        lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS damage
    FROM given
), hurt AS (
    SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
        CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM checked, LATERAL (SELECT unnest(range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy)
), numbered AS (
    SELECT *, left(role, 1) AS initial,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending
    FROM hurt
), rows AS (
    SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier,
        CASE WHEN ending = '' THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
    FROM numbered
), counted AS (
    SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM rows GROUP BY conv_id
), spent(conv_id, i, n0, ns, nu, na) AS (
    SELECT conv_id, 0, '000000000', CAST(NULL AS VARCHAR), '000000002I', '000000004II' FROM counted
    UNION ALL
    SELECT conv_id, i, n0, ns,
        least(nu, {_edited('n0', 2, 'I')}, {_edited('ns', 2, 'I')}, {_edited('na', 2, 'I')}) AS nu,
        least(na, {_edited('nu', 2, 'I')}, {_edited('n0', 4, 'II')}, {_edited('ns', 4, 'II')}) AS na
    FROM (
        SELECT r.conv_id, r.i, {_row({}, 'n0')}, {_row({'n0': 's'}, 'ns')},
            {_row({'n0': 'u', 'ns': 'u', 'na': 'u'}, 'nu')}, {_row({'nu': 'a'}, 'na')}
        FROM spent s JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1
    )
), audits AS (
    SELECT c.*, CAST(left(least(n0, na), 9) AS BIGINT) AS cost, substr(least(n0, na), 10) AS audit
    FROM counted c JOIN spent s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n
), letters AS (
    SELECT conv_id, k, substr(audit, k, 1) AS edit, k - length(replace(left(audit, k), 'I', '')) AS inserted,
        length(replace(left(audit, k), 'D', '')) AS place
    FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM audits)
), placed AS (
    SELECT l.*, r.role, r.text,
        coalesce(max(CASE WHEN place = 1 AND edit = 'K' AND r.initial = 's' THEN 1 END) OVER (PARTITION BY l.conv_id), 0)
            AS system
    FROM letters l LEFT JOIN rows r
        ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.k - l.inserted AND l.edit <> 'I'
    WHERE edit <> 'D'
), lines AS (
    SELECT conv_id, sha256(string_agg(
        CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS repaired_sha256
    FROM placed GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
    coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""
