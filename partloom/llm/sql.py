"""SQL that must give the same rows as the longer of the corpus queries."""

from __future__ import annotations


def _halves() -> list[int]:
    """What crc32 adds for each half byte."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 * (x & 1))
        out.append(x)
    return out


def crc(x: str) -> str:
    """crc32 (unsigned) of a text's UTF-8, half byte by half byte, the lower first: the dialect has no function for it."""
    h = f"hex(encode({x}))"
    halves = f"list_transform(range(0, length({h})), lambda i: CAST(instr('0123456789ABCDEF', substr({h}, CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END, 1)) - 1 AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {halves}), lambda a, b: xor(a >> 4, list_extract({_halves()}, 1 + (xor(a, b) & 15)))))"


TRIE = f"""
    WITH numbered AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
      FROM conversations WHERE conv_id IS NOT NULL
    ), convs AS (
      SELECT conv_id, conv_id - conv_id % 100 AS base, {crc('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
    ), turns AS (
      SELECT c.conv_id, 0 AS part, n.i, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.base AND n.i <= c.h
      UNION ALL
      SELECT c.conv_id, 1, n.i, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.i > c.h
    ), pathed AS (
      SELECT conv_id, text, row_number() OVER w AS d, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER w) AS k
      FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING)
    ), members AS (
      SELECT conv_id, d, k, text, coalesce(lag(k) OVER (PARTITION BY conv_id ORDER BY d), '') AS up FROM pathed
      UNION ALL SELECT conv_id, 0, '', '', NULL FROM convs
    ), ended AS (
      SELECT arg_max(k, d) AS k, conv_id FROM members GROUP BY conv_id
    ), ends AS (
      SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM ended GROUP BY k
    ), nodes AS (
      SELECT k, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(length(text)) AS chars FROM members GROUP BY k
    ), kids AS (SELECT up AS k, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
    whole AS (
      SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (k)
    ), below AS (
      SELECT m.k, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n - 1) * w.chars) AS saved
      FROM whole w JOIN members m ON m.conv_id = w.conv_id AND m.d <= w.depth GROUP BY m.k
    )
    SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs, CAST(w.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
           CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
    FROM whole w JOIN below USING (k) LEFT JOIN ends USING (k) LEFT JOIN nodes p ON p.k = w.up
"""

SPELLING = f"""
    WITH RECURSIVE found AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00c0-\u00ff]{{6,}}')) AS run FROM documents
    ), counted AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL),
    marked AS (SELECT *, {crc("CAST(doc_id AS VARCHAR) || ':' || run")} AS h FROM counted),
    changed AS (
        SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM marked
    ), words AS MATERIALIZED (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5
    ), gaps AS (
        SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), near AS (
        SELECT x.word, y.word AS other, y.n FROM gaps x JOIN gaps y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
        UNION SELECT x.word, y.word, y.n FROM gaps x JOIN words y ON x.a || x.b = y.word
        UNION SELECT y.word, x.word, x.n FROM gaps x JOIN words y ON x.a || x.b = y.word
    ), best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
    chosen AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN top END AS form_n,
               CASE WHEN top >= 5 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.n = top) END AS form
        FROM words w LEFT JOIN best USING (word)
    ), chain(word, last) AS (
        SELECT word, word FROM chosen UNION ALL SELECT c.word, x.form FROM chain c JOIN chosen x ON x.word = c.last WHERE x.form IS NOT NULL
    ), ends AS (SELECT c.word, c.last AS root FROM chain c JOIN chosen x ON x.word = c.last WHERE x.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM chosen JOIN ends USING (word)
"""
