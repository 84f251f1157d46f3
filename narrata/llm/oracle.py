"""DuckDB SQL for the queries that SQL can express."""

_WORDS4 = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP4 = f"""
WITH b AS (SELECT item_id, {_WORDS4} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS4} AS w FROM documents),
dw AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw USING (s, m)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_ESCAPED = "replace(coalesce(text, ''), '\\', '\\\\')"
for _c in ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>"):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

OP8 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
    CAST(sum(length('<|turn|>') + length(role) + 1 + length({_ESCAPED}) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars,
    string_agg(role, ',' ORDER BY turn, role, text) AS roles
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
  regexp_full_match(roles, '(system,)?user(,assistant,user)*(,assistant)?') AS valid
FROM g
"""

SQL = {"op4_decontamination": OP4, "op8_chat_format": OP8}

OP2 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN rep USING (s)),
ws AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n
  FROM ws ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
SQL["op2_substring_dedup"] = OP2

OP5 = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 85 * (na.n + nb.n - m)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
SQL["op5_near_dedup"] = OP5

#: Unsigned crc32 of the bytes of a list, four bits at a time.
_NIBBLES = []
for _i in range(16):
    for _ in range(4):
        _i = _i >> 1 ^ 0xEDB88320 * (_i & 1)
    _NIBBLES.append(_i)


def _crc32(data: str) -> str:
    half = lambda x: f"xor({x} >> 4, CAST({_NIBBLES} AS BIGINT[])[({x} & 15) + 1])"
    return f"xor(list_reduce({data}, lambda c, b: {half(half('xor(c, b)'))}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _bytes(text: str) -> str:
    """The UTF-8 bytes of a text up to U+00FF, for which the bytes follow from the code point."""
    return f"""flatten(list_transform(string_split({text}, ''), lambda c:
      CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"""


OP11 = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS x FROM documents) WHERE length(x) >= 7),
c AS (SELECT x, m, {_crc32(_bytes("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || x"))} AS h FROM (SELECT doc_id, x, count(*) AS m FROM r GROUP BY ALL)),
d AS (SELECT m, CASE WHEN h % 31 = 0 THEN left(x, h % length(x)) || substring(x, h % length(x) + 2) ELSE x END AS word FROM c),
w AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
gap AS (SELECT word, n, i, left(word, i - 1) AS a, substring(word, i + 1) AS b FROM p),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM gap x JOIN gap y USING (i, a, b) WHERE x.word <> y.word
  UNION SELECT gap.word, w.word, w.n FROM gap JOIN w ON w.word = a || b
  UNION SELECT w.word, gap.word, gap.n FROM gap JOIN w ON w.word = a || b),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
f AS (
  SELECT w.word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM w LEFT JOIN best USING (word)),
chain(word, place, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.place WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(place, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN root USING (word)
"""
SQL["op11_spelling_variants"] = OP11

OP13 = f"""
WITH one AS (
  SELECT click_id, unnest(min(struct_pack(ts := ts, arrived_at := arrived_at, kind := kind, value := value)))
  FROM clicks WHERE ts IS NOT NULL AND click_id IS NOT NULL GROUP BY click_id),
a AS (
  SELECT click_id, coalesce(kind, 'none') AS kind, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents, epoch_us(ts) AS us,
    CAST(date_diff('day', DATE '1970-01-01', CAST(coalesce(arrived_at, ts) AS DATE)) AS BIGINT) AS day,
    greatest(0, {_crc32(_bytes("CAST(click_id AS VARCHAR)"))} % 30 - 23) AS late
  FROM one),
b AS (
  SELECT click_id, kind, cents, least(9, (day % 10 + 10) % 10 + late) AS batch, us - (day - (day % 10 + 10) % 10) * 86400000000 AS us FROM a),
r AS (SELECT *, CAST(floor(us / 3600000000.0) AS BIGINT) AS hour FROM b),
w AS (
  SELECT t.batch, (SELECT max(us) FROM r WHERE r.batch < t.batch) AS w FROM (SELECT unnest(range(10)) AS batch) t),
x AS (SELECT r.*, coalesce(w >= (hour + 1 + 48) * 3600000000, false) AS late FROM r JOIN w USING (batch)),
n AS (SELECT kind, hour, batch, count(*) AS n, sum(cents) AS c FROM x WHERE NOT late GROUP BY ALL),
s AS (
  SELECT kind, hour, batch, sum(n) OVER o AS n, sum(c) OVER o AS c, lag(batch) OVER o AS earlier
  FROM n WINDOW o AS (PARTITION BY kind, hour ORDER BY batch)),
first_due AS (
  SELECT kind, hour, (SELECT min(w.batch) FROM w WHERE w >= (hour + 1 + 12) * 3600000000 AND w.batch >= opened) AS e
  FROM (SELECT kind, hour, min(batch) AS opened FROM n GROUP BY ALL)),
said AS (
  SELECT coalesce(e, 9) AS batch, CASE WHEN e IS NULL THEN 'final' ELSE 'emit' END AS record, kind, hour, max(n) AS n, arg_max(c, s.batch) AS c
  FROM s JOIN first_due USING (kind, hour) WHERE e IS NULL OR s.batch <= e GROUP BY kind, hour, e
  UNION ALL SELECT s.batch, 'replace', kind, hour, s.n, s.c FROM s JOIN first_due USING (kind, hour) WHERE s.batch > e
  UNION ALL SELECT s.batch, 'retract', kind, hour, o.n, o.c
    FROM s JOIN first_due USING (kind, hour) JOIN s o USING (kind, hour) WHERE s.batch > e AND o.batch = s.earlier)
SELECT CAST(batch AS BIGINT) AS batch, record, kind, hour, CAST(-1 AS BIGINT) AS click_id, CAST(n AS BIGINT) AS n_rows, CAST(c AS BIGINT) AS cents FROM said
UNION ALL SELECT CAST(batch AS BIGINT), 'late', kind, hour, click_id, 1, CAST(cents AS BIGINT) FROM x WHERE late
"""
SQL["op13_window_panes"] = OP13
