"""DuckDB SQL with the rows of ``queries``."""

from __future__ import annotations

BOOKS = "books AS (SELECT doc_id AS book_id, source AS title, lang, coalesce(text, '') AS text FROM documents)"
CONV = """books AS (SELECT conv_id AS book_id, string_agg(part, chr(10) ORDER BY turn, part) AS text FROM (
  SELECT conv_id, turn, (CASE WHEN role = 'user' THEN '# ' ELSE '## ' END) || 'turn ' || turn || chr(10) || chr(10) || coalesce(text, '') || chr(10) AS part FROM conversations) GROUP BY conv_id)"""
LINES = """lines AS (SELECT book_id, i - 1 AS line_no, line, size, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY book_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT book_id, length(text) AS size, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM books))"""
STRIPPED = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
DUPS = f"""dups AS (SELECT book_id, {STRIPPED} AS line, count(*) AS n, min(line_no) AS first_line FROM lines WHERE length({STRIPPED}) >= 12 GROUP BY 1, 2 HAVING count(*) >= 3)"""
REGIONS = """pieces AS (SELECT b.book_id, d.line, d.first_line, unnest(string_split(b.text, d.line)) AS piece, generate_subscripts(string_split(b.text, d.line), 1) - 1 AS k FROM books b JOIN dups d USING (book_id)),
placed AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY book_id, line ORDER BY k ROWS UNBOUNDED PRECEDING) + k * length(line) AS BIGINT) AS start, lead(k) OVER (PARTITION BY book_id, line ORDER BY k) IS NULL AS ended FROM pieces),
regions AS (SELECT book_id, first_line * 100000 + k + 3000000000 AS seq, start, start + length(line) AS stop, 'duplicate' AS reason, substring(line, 1, 30) AS label FROM placed WHERE NOT ended)"""
HEADS = r"""heads AS (SELECT book_id, 1000000000 AS seq, 0 AS start, least(length(text), 5000) AS stop, 'copyright' AS reason, '' AS label FROM books
  WHERE regexp_matches(substring(text, 1, 5000), '(?i)版权|版权所有|ISBN|Copyright|All rights reserved|出版发行|印刷|版次|CIP|翻印必究|定价[:：]'))"""
MERGED = """islands AS (SELECT *, sum(fresh) OVER (PARTITION BY book_id ORDER BY start, stop, seq) AS island FROM (
  SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY book_id ORDER BY start, stop, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM every)),
merged AS (SELECT book_id, island, min(start) AS start, max(stop) AS stop, arg_min(reason, (start, stop, seq)) AS reason FROM islands GROUP BY book_id, island)"""
PRUNED = f"""WITH {BOOKS}, {LINES}, {DUPS}, {REGIONS}, {HEADS},
every AS (SELECT book_id, seq, start, stop, reason FROM regions UNION ALL SELECT book_id, seq, start, stop, reason FROM heads), {MERGED},
gaps AS (SELECT book_id, island, coalesce(lag(stop) OVER (PARTITION BY book_id ORDER BY start), 0) AS a, start AS b FROM merged),
tails AS (SELECT book_id, max(stop) AS a FROM merged GROUP BY book_id),
kept AS (SELECT g.book_id, string_agg(substring(b.text, CAST(g.a + 1 AS INT), CAST(g.b - g.a AS INT)), '' ORDER BY g.a) AS head FROM gaps g JOIN books b USING (book_id) GROUP BY g.book_id),
pruned AS (SELECT b.book_id, b.lang, length(b.text) AS original_chars, coalesce(m.removed, 0) AS removed_chars, coalesce(m.n, 0) AS n_regions,
    CASE WHEN m.n IS NULL THEN b.text ELSE k.head || substring(b.text, CAST(t.a + 1 AS INT)) END AS pruned_text
  FROM books b LEFT JOIN (SELECT book_id, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS removed FROM merged GROUP BY book_id) m USING (book_id) LEFT JOIN kept k USING (book_id) LEFT JOIN tails t USING (book_id))"""
CHAPTERS = r"""chapters AS (SELECT book_id, row_number() OVER w - 1 AS chapter_ix, regexp_replace(line, '^#{1,6}\s+|\s+$', '', 'g') AS title, CAST(length(regexp_extract(line, '^(#{1,6})\s', 1)) AS INT) AS level,
    start AS start_char, coalesce(lead(start) OVER w, size) AS end_char FROM lines WHERE regexp_matches(line, '^#{1,6}\s+\S') WINDOW w AS (PARTITION BY book_id ORDER BY start))"""
UNITS = """top AS (SELECT c.*, min(level) OVER (PARTITION BY book_id) AS least_level FROM chapters c),
units AS (SELECT book_id, row_number() OVER w - 1 AS unit_ix, title, start_char AS start, coalesce(lead(start_char) OVER w, size) AS stop, text
  FROM top JOIN (SELECT book_id, text, length(text) AS size FROM books) USING (book_id) WHERE level = least_level WINDOW w AS (PARTITION BY book_id ORDER BY start_char)),
texts AS (SELECT book_id, unit_ix, title, start, stop, substring(text, CAST(start + 1 AS INT), CAST(stop - start AS INT)) AS text FROM units)"""


def chunk_fold(source: str, keys: str) -> str:
    """Greedy chunks of ``source`` (keys, text) by recursion over pieces: 600 characters, 60 kept."""
    on = " AND ".join(f"f.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    f_keys = ", ".join(f"f.{k.strip()}" for k in keys.split(","))
    return rf"""split AS (SELECT {keys}, string_split_regex(text, '\n\s*\n') AS ps, regexp_extract_all(text, '\n\s*\n') AS gs, length(text) AS size, text FROM {source}),
sizes AS (SELECT {keys}, size, text, flatten(list_transform(range(len(ps)), lambda i: CASE WHEN i < len(gs) THEN [length(ps[i + 1]), length(gs[i + 1])] ELSE [length(ps[i + 1])] END)) AS ns FROM split),
fold AS (
  SELECT {keys}, 0 AS i, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM sizes WHERE size > 600
  UNION ALL
  SELECT {f_keys}, f.i + 1,
    CASE WHEN f.e - f.s + p.ns[f.i + 1] > 600 AND f.e > f.s THEN CASE WHEN f.e - f.s > 60 THEN f.e - 60 ELSE f.e END ELSE f.s END, f.e + p.ns[f.i + 1],
    CASE WHEN f.e - f.s + p.ns[f.i + 1] > 600 AND f.e > f.s THEN f.s END, CASE WHEN f.e - f.s + p.ns[f.i + 1] > 600 AND f.e > f.s THEN f.e END
  FROM fold f JOIN sizes p ON {on} WHERE f.i < len(p.ns)),
spans AS (
  SELECT {keys}, CAST(0 AS BIGINT) AS start, CAST(size AS BIGINT) AS stop FROM sizes WHERE size <= 600
  UNION ALL SELECT {keys}, a, b FROM fold WHERE a IS NOT NULL
  UNION ALL SELECT {f_keys}, f.s, f.e FROM fold f JOIN sizes p ON {on} WHERE f.i = len(p.ns) AND regexp_matches(substring(p.text, CAST(f.s + 1 AS INT), CAST(f.e - f.s AS INT)), '\S')),
chunked AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY start, stop) - 1 AS chunk_ix, start, stop FROM spans)"""


CHUNKS = f"""WITH RECURSIVE {CONV}, {LINES}, {CHAPTERS}, {UNITS}, {chunk_fold("texts", "book_id, unit_ix")},
sized AS (SELECT book_id, unit_ix, count(*) AS n FROM chunked GROUP BY ALL),
chunks AS (SELECT c.book_id, c.unit_ix, c.chunk_ix, t.title, length(t.text) AS source_chars, greatest(CAST(floor(length(t.text) * (0.15::DOUBLE * 1.3::DOUBLE)) AS INT), 100) AS target_chars, s.n AS n_chunks,
    format('unit_{{:05d}}_{{:03d}}', c.unit_ix, c.chunk_ix) AS unit_id, substring(t.text, CAST(c.start + 1 AS INT), CAST(c.stop - c.start AS INT)) AS chunk_text
  FROM chunked c JOIN texts t USING (book_id, unit_ix) JOIN sized s USING (book_id, unit_ix)),
planned AS (SELECT *, greatest(1, target_chars // n_chunks) AS chunk_target FROM chunks)"""
KEYED = CHUNKS + r""",
keyed AS (SELECT *, sha256('["' || book_id || '", "' || unit_id || '", "' || chunk_target || '", "' || replace(replace(chunk_text, '\', '\\'), '"', '\"') || '"]') AS cache_key FROM planned)"""
TASKS = """tasks AS (SELECT o_orderkey AS task_id, o_custkey AS book_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE ['done', 'error', 'cancelled'][CAST(o_orderkey % 3 AS INT) + 1] END AS status,
  'queued' AS stage, o_orderkey AS queue_order, o_orderpriority = '1-URGENT' AS cancel_requested, o_orderpriority = '2-HIGH' AS delete_requested, o_orderdate AS created_at FROM orders)"""
LEDGER_UNITS = """units AS (SELECT l_orderkey AS task_id, format('unit_{:05d}_000', l_linenumber) AS unit_id, CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'R' THEN 'error' ELSE 'pending' END AS status,
  l_partkey AS cache_key, 'out ' || CAST(floor(l_quantity) AS BIGINT) AS output, l_shipdate AS updated_at FROM lineitem)"""
CACHE = "cache AS (SELECT p_partkey AS cache_key, CASE WHEN p_size > 25 THEN CAST(p_size AS BIGINT) END AS book_id, p_name AS output, CAST(0 AS BIGINT) AS hit_count FROM part)"
TOKENS = r"(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(length(regexp_replace(text, '\s', '', 'g')) - length(regexp_replace(text, '[\s\x{3400}-\x{9fff}]', '', 'g')) + ceil(length(regexp_replace(text, '[\s\x{3400}-\x{9fff}]', '', 'g')) / 4.0::DOUBLE) AS BIGINT)) END)"
CLEAN = r"""regexp_replace(regexp_replace(regexp_replace({0}, '</(p|div|h[1-6]|li|blockquote|tr)>', chr(10), 'gi'), '<(br|hr)[^>]*>', chr(10), 'gi'), '<[^>]+>', '', 'g')"""


def decoded(x: str) -> str:
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{value}')"
    return x


HTML_TEXT = rf"""regexp_replace(regexp_replace(regexp_replace({decoded(CLEAN.format("coalesce(html, '')"))}, '[^\S\n]*\n[^\S\n]*', chr(10), 'g'), '^\s+|\s+$', '', 'g'), '\n{{2,}}', chr(10) || chr(10), 'g')"""


COMPOSED = """parts AS (SELECT doc_id AS book_id, coalesce(text, '') AS body, CAST(doc_id AS VARCHAR) AS n, doc_id % 3 = 0 AS rights,
    '---' || chr(10) || 'title: ' || coalesce(source, '') || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'rights: Copyright ' || coalesce(source, '') || chr(10) ELSE '' END || '---' || chr(10) AS p0,
    'Copyright ' || coalesce(source, '') || chr(10) || 'ISBN ' || doc_id || chr(10) AS p1, 'CONTENTS' || chr(10) AS p2,
    'Part one .... 1' || chr(10) || 'Part two .... 2' || chr(10) || 'Part three .... 3' || chr(10) || 'Part four .... 4' || chr(10) AS p3,
    'Chapter 1' || chr(10) || coalesce(text, '') || chr(10) || chr(10) AS p4, 'Chapter 2' || chr(10) || 'The end of ' || doc_id || '.' || chr(10) || chr(10) AS p5, 'References' || chr(10) || 'Smith, ' || doc_id || chr(10) AS p6 FROM documents),
books AS (SELECT book_id, p0 || chr(10) || p1 || chr(10) || p2 || chr(10) || p3 || chr(10) || p4 || p5 || p6 AS text, NULL AS lang FROM parts),
places AS (SELECT *, length(p0) + 1 AS a1, length(p0) + length(p1) + 2 AS a2, length(p0) + length(p1) + length(p2) + 3 AS a3, length(p0) + length(p1) + length(p2) + length(p3) + 4 AS a4, length(p0) + length(p1) + length(p2) + length(p3) + length(p4) + 4 AS a5,
    length(p0) + length(p1) + length(p2) + length(p3) + length(p4) + length(p5) + 4 AS a6, length(p0) + length(p1) + length(p2) + length(p3) + length(p4) + length(p5) + length(p6) + 4 AS size FROM parts)"""
FIXED = """heads AS (SELECT book_id, 0 AS seq, 0 AS start, length(p0) AS stop, 'frontmatter' AS reason FROM places UNION ALL SELECT book_id, 1000000000, 0, length(p0), 'copyright' FROM places WHERE rights
  UNION ALL SELECT book_id, 1000000000 + a1, a1, a1 + length(p1), 'copyright' FROM places UNION ALL SELECT book_id, 1000000000 + a2, a2, a2 + length(p2), 'toc' FROM places
  UNION ALL SELECT book_id, 1000000000 + a3, a3, a3 + length(p3), 'toc' FROM places UNION ALL SELECT book_id, 2000000000 + a6, a6, size, 'backmatter' FROM places)"""
COMPOSED_PRUNED = PRUNED.replace(BOOKS, COMPOSED).replace(HEADS, FIXED)
COMPOSED_CHAPTERS = "chapters AS (SELECT book_id, 0 AS chapter_ix, 'Chapter 1' AS title, 1 AS level, a4 AS start_char, a5 AS end_char FROM places UNION ALL SELECT book_id, 1, 'Chapter 2', 1, a5, size FROM places)"


def audit_picks(chapters: str) -> str:
    """Five claims of each book of ``chapters`` (book_id, chapter_index, text) by recursion over the samples of a chapter: ``picks``."""
    return rf"""WITH RECURSIVE chapters AS ({chapters}),
l AS (SELECT book_id, chapter_index, unnest(string_split_regex(t, '\r\n|[\n\x0B\f\r]')) AS raw, generate_subscripts(string_split_regex(t, '\r\n|[\n\x0B\f\r]'), 1) - 1 AS line_no FROM (SELECT book_id, chapter_index, regexp_replace(text, '\.(\s)', '.;\1', 'g') AS t FROM chapters)),
b AS (SELECT book_id, chapter_index, line_no, regexp_replace(regexp_replace(regexp_replace(raw, '^[#>*+\-\d.\s]+', ''), '^\s+|\s+$', '', 'g'), '[*_`]+', '', 'g') AS line FROM l),
c AS (SELECT * FROM (SELECT book_id, chapter_index, line_no, i, regexp_replace(s, '^\s+|\s+$', '', 'g') AS claim FROM (
  SELECT book_id, chapter_index, line_no, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT *, regexp_extract_all(line, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$') AS ss FROM b WHERE length(line) >= 18 AND NOT ends_with(line, '：')))) WHERE length(claim) BETWEEN 18 AND 220),
usable AS (SELECT book_id, chapter_index, list({{'line_no': line_no, 'claim': claim}} ORDER BY line_no, i) AS cs FROM c GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index) - 1 AS place, count(*) OVER (PARTITION BY book_id) AS n FROM usable),
asked AS (SELECT book_id, chapter_index, cs, k, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY k) AS j,
    CAST(('0x' || substring(sha256('20260809:' || book_id || ':' || chapter_index || ':' || k), 1, 12)) AS BIGINT) % len(cs) AS first FROM placed JOIN (SELECT unnest(range(5)) AS k) ON (k * n) // 5 = place),
fold AS (
  SELECT book_id, chapter_index, CAST(0 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS k, NULL::STRUCT(line_no BIGINT, claim VARCHAR) AS pick, []::STRUCT(line_no BIGINT, claim VARCHAR)[] AS chosen FROM placed
  UNION ALL
  SELECT f.book_id, f.chapter_index, a.j, a.k, p, list_append(f.chosen, p) FROM fold f JOIN (
    SELECT *, cs[first + 1:] || cs[1:first] AS turned FROM asked) a ON f.book_id = a.book_id AND f.chapter_index = a.chapter_index AND a.j = f.j + 1,
    LATERAL (SELECT coalesce(list_filter(a.turned, lambda x: NOT list_contains(f.chosen, x))[1], a.turned[-1]) AS p)),
picks AS (SELECT book_id, chapter_index, k, pick.line_no AS line_no, pick.claim AS claim FROM fold WHERE k IS NOT NULL)"""


def _task_states() -> str:
    """A fold over each task's events; before each stands an element that lets a lease run out."""
    state = lambda at, status, stage, cancel, gone: f"{{'t': {at}, 'kind': '', 'name': '', 'status': {status}, 'stage': {stage}, 'cancel': {cancel}, 'del': {gone}}}"
    absent = lambda at: state(at, "'absent'", "''", "false", "false")
    restarted = lambda at, rest: f"WHEN s.del THEN {absent(at)} WHEN s.status = 'running' AND s.cancel THEN {state(at, chr(39) + 'cancelled' + chr(39), chr(39) + 'cancelled' + chr(39), 'true', 'false')} WHEN s.status = 'running' THEN {state(at, chr(39) + 'pending' + chr(39), chr(39) + 'resume' + chr(39), 'false', 'false')} ELSE {rest} END"
    same, end = state("e.t", "s.status", "s.stage", "s.cancel", "s.del"), "(s.t + 172800000000)"
    return f"""WITH log AS (
      SELECT user_id, epoch_us(ts) AS t, event_id, event_type, ['create', 'claim', 'stage', 'done', 'retry', 'create', 'claim', 'error', 'cancel', 'recover', 'claim', 'delete'][CAST(event_id % 12 AS INT) + 1] AS kind FROM events),
    marks AS (
      SELECT user_id, t, event_id, 0 AS part, 'lapse' AS kind, '' AS name FROM log
      UNION ALL SELECT user_id, t, event_id, 1, kind, event_type FROM log),
    lists AS (
      SELECT user_id, list_prepend({absent("CAST(NULL AS BIGINT)")},
        list({{'t': t, 'kind': kind, 'name': name, 'status': '', 'stage': '', 'cancel': false, 'del': false}} ORDER BY t, event_id, part)) AS l
      FROM marks GROUP BY user_id),
    folded AS (
      SELECT user_id, list_reduce(l, lambda s, e: CASE
        WHEN e.kind = 'lapse' THEN CASE WHEN NOT (s.status = 'running' AND s.t <= e.t - 172800000000) THEN s {restarted(end, "s")}
        WHEN s.status = 'absent' THEN CASE WHEN e.kind = 'create' THEN {state("e.t", "'pending'", "'queued'", "false", "false")} ELSE {same} END
        WHEN e.kind = 'claim' AND s.status = 'pending' AND NOT s.cancel AND NOT s.del THEN {state("e.t", "'running'", "'prune'", "false", "false")}
        WHEN e.kind = 'stage' AND s.status = 'running' AND NOT s.del THEN {state("e.t", "s.status", "e.name", "s.cancel", "s.del")}
        WHEN e.kind = 'cancel' AND s.status = 'pending' THEN {state("e.t", "'cancelled'", "'cancelled'", "true", "s.del")}
        WHEN e.kind = 'cancel' THEN {state("e.t", "s.status", "s.stage", "true", "s.del")}
        WHEN e.kind = 'delete' AND s.status = 'running' THEN {state("e.t", "s.status", "'deleting'", "true", "true")}
        WHEN e.kind = 'delete' THEN {absent("e.t")}
        WHEN e.kind IN ('done', 'error') AND s.status = 'running' THEN CASE WHEN s.del THEN {absent("e.t")} WHEN s.cancel THEN {state("e.t", "'cancelled'", "'cancelled'", "true", "false")} ELSE {state("e.t", "e.kind", "e.kind", "false", "false")} END
        WHEN e.kind = 'retry' AND s.status IN ('error', 'cancelled') THEN {state("e.t", "'pending'", "'queued'", "false", "false")}
        WHEN e.kind = 'recover' THEN CASE {restarted("e.t", same)}
        ELSE {same} END) AS s
      FROM lists)
    SELECT user_id AS task_id, s.t AS "at", s.status AS status, s.stage AS stage, s.cancel AS cancel_requested, s.del AS delete_requested FROM folded WHERE s.status <> 'absent'"""


STAGED_AUDIT = r"""WITH d AS (SELECT doc_id AS book_id, coalesce(text, '') AS text, doc_id * 1000 AS source_start FROM documents),
stages AS (SELECT unnest(range(9)) AS stage),
given AS (
  SELECT book_id, stage, (book_id + stage) % 4 <> 0 AS supported, stage = 0 AND book_id % 11 = 0 AS conflict,
    CASE WHEN (book_id + 2 * stage) % 3 = 0 THEN substring(text, length(text) // 2, 40) ELSE 'nowhere #' || stage || '#' END AS raw,
    CASE WHEN book_id % 5 = 0 THEN NULL ELSE book_id % 7 END AS window_ix, text
  FROM d, stages WHERE (book_id + stage) % 13 <> 0),
quoted AS (SELECT *, regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '^["''`“”‘’]+|["''`“”‘’]+$', '', 'g') AS quote FROM given),
compacted AS (SELECT *, regexp_replace(text, '\s+', '', 'g') AS loose_text, regexp_replace(quote, '\s+', '', 'g') AS loose_quote FROM quoted),
found AS (SELECT *, CASE WHEN quote = '' THEN -1 ELSE instr(text, quote) - 1 END AS exact, CASE WHEN loose_quote = '' THEN -1 ELSE instr(loose_text, loose_quote) - 1 END AS loose FROM compacted),
verdicts AS (
  SELECT book_id, stage, supported, conflict, raw, window_ix,
    CASE WHEN exact >= 0 THEN 'exact' WHEN loose >= 0 THEN 'whitespace_normalized' ELSE 'none' END AS match,
    CASE WHEN exact >= 0 THEN exact WHEN loose >= 0 THEN CAST(list_filter(range(length(text)), lambda i: NOT regexp_matches(text[i + 1], '^\s$'))[loose + 1] AS BIGINT) ELSE -1 END AS place,
    CASE WHEN window_ix < greatest(1, ceil((length(text) - 800) / 800.0)) AND length(text) > 0 THEN window_ix * 800 END AS window_at, substring(text, CAST(window_ix * 800 + 1 AS INT), 1600) AS window_text
  FROM found),
plain AS (SELECT d.*, coalesce(v.supported, false) AS s, coalesce(v.conflict, false) AS c, coalesce(v.raw, '') AS e, coalesce(v.place, -1) AS place, coalesce(v.match, 'none') AS m
  FROM d LEFT JOIN verdicts v ON v.book_id = d.book_id AND v.stage = 0),
sorted_out AS (SELECT *, CASE WHEN s AND place < 0 THEN 'unanchored' WHEN NOT s AND NOT c THEN 'rejected' ELSE 'settled' END AS course FROM plain),
later_stage AS (
  SELECT p.book_id, min(v.stage) AS stage FROM sorted_out p JOIN verdicts v USING (book_id)
  WHERE v.supported AND (p.course = 'unanchored' AND v.stage BETWEEN 1 AND 4 OR p.course = 'rejected' AND v.stage BETWEEN 5 AND 8)
    AND CASE WHEN v.stage IN (4, 8) THEN v.window_at IS NOT NULL ELSE v.place >= 0 END GROUP BY p.book_id),
settled AS (
  SELECT p.*, l.stage, v.supported AS ls, v.conflict AS lc, CASE WHEN l.stage IN (4, 8) THEN 'verified_window' ELSE v.match END AS lm,
    CASE WHEN l.stage IN (4, 8) THEN v.window_at ELSE v.place END AS lat, CASE WHEN l.stage IN (4, 8) THEN v.window_text ELSE v.raw END AS le
  FROM sorted_out p LEFT JOIN later_stage l USING (book_id) LEFT JOIN verdicts v ON v.book_id = p.book_id AND v.stage = l.stage),
closed AS (SELECT *, CASE WHEN stage IS NULL THEN s ELSE ls END AS js, CASE WHEN stage IS NULL THEN c ELSE lc END AS jc, CASE WHEN stage IS NULL THEN m ELSE lm END AS jm,
  CASE WHEN stage IS NULL THEN place ELSE lat END AS jat, CASE WHEN stage IS NULL THEN e ELSE le END AS je FROM settled)
SELECT book_id AS sample_id, js AS judge_supported, js AND jat >= 0 AS supported, jc AS conflict, jm AS evidence_match, jat >= 0 AS evidence_exact,
  CASE WHEN jat >= 0 THEN CAST(source_start + jat AS BIGINT) END AS source_char_offset, sha256(substring(text, 1, 30)) AS claim_sha256, CASE WHEN jat >= 0 THEN sha256(je) END AS evidence_sha256,
  CASE WHEN stage BETWEEN 1 AND 4 THEN stage ELSE 0 END AS anchor_repair_attempts, coalesce(stage >= 5, false) AS adjudicated, CASE WHEN stage >= 5 THEN stage - 4 ELSE 0 END AS adjudication_attempts
FROM closed"""


def later() -> dict[str, str]:
    """SQL of the queries over logs and stored results."""
    return {
        "task_states": _task_states(),
        "stored_prunes": PRUNED + """, kept_whole AS (SELECT *, book_id % 4 = 0 AS whole FROM pruned)
          SELECT book_id, 'ok' AS answer, CAST(CASE WHEN book_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS run, CASE WHEN whole THEN 0 ELSE n_regions END AS n_regions, original_chars,
            CASE WHEN whole THEN 0 ELSE removed_chars END AS removed_chars, md5(CASE WHEN whole THEN (SELECT text FROM books b WHERE b.book_id = k.book_id) ELSE pruned_text END) AS pruned_md5 FROM kept_whole k
          UNION ALL SELECT -1, 'absent', NULL, NULL, NULL, NULL, NULL""",
        "prune_sources": """SELECT coalesce(b.book_id, l.doc_id) AS book_id, CASE WHEN b.text IS NULL THEN 'absent' WHEN coalesce(l.quality, 0) <> 1 THEN 'unready' ELSE 'ok' END AS answer,
            CASE WHEN b.text IS NOT NULL AND l.quality = 1 THEN 1 END AS level, CASE WHEN l.quality = 1 THEN length(b.text) END AS end_char
          FROM (SELECT doc_id AS book_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 7 <> 0) b FULL JOIN labels l ON l.doc_id = b.book_id""",
        "staged_audit": STAGED_AUDIT,
        "claims_compared": f"""WITH {TASKS}, c AS (SELECT *, status = 'pending' AND NOT cancel_requested AND NOT delete_requested AS won FROM tasks WHERE task_id % 3 = 0)
          SELECT task_id, won, CASE WHEN won THEN 'running' ELSE status END AS after, CASE WHEN won THEN 'prune' ELSE stage END AS stage FROM c""",
        "queue_listing": f"""WITH {TASKS} SELECT task_id, CASE WHEN task_id % 11 = 0 THEN 'error' ELSE status END AS status, cancel_requested, delete_requested,
          row_number() OVER (ORDER BY queue_order, created_at, task_id) AS place FROM tasks""",
        "task_lookups": f"""WITH {TASKS}, asked AS (SELECT DISTINCT l_orderkey + 50 AS task_id FROM lineitem)
          SELECT a.task_id, t.task_id IS NOT NULL AS found, coalesce(t.status, '') AS status FROM asked a LEFT JOIN tasks t ON t.task_id = a.task_id""",
        "located_units": rf"""WITH RECURSIVE {BOOKS}, {LINES}, u AS (
            SELECT book_id, CASE WHEN book_id % 2 = 0 THEN -line_no ELSE line_no END AS unit_ix, CASE WHEN book_id % 5 = 0 AND line_no % 3 = 0 THEN line || ' not there' ELSE line END AS segment
            FROM lines WHERE line <> ''),
          o AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY unit_ix) AS i FROM u),
          f AS (
            SELECT book_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS unit_ix, CAST(0 AS BIGINT) AS cursor, CAST(-2 AS BIGINT) AS start FROM books
            UNION ALL
            SELECT book_id, i, unit_ix, CASE WHEN place > 0 THEN place - 1 + size ELSE cursor END, place - 1 FROM (
              SELECT o.book_id, o.i, CAST(o.unit_ix AS BIGINT) AS unit_ix, f.cursor, length(o.segment) AS size,
                CASE WHEN instr(substring(b.text, CAST(f.cursor + 1 AS INT)), o.segment) > 0 THEN f.cursor + instr(substring(b.text, CAST(f.cursor + 1 AS INT)), o.segment) ELSE instr(b.text, o.segment) END AS place
              FROM f JOIN o ON o.book_id = f.book_id AND o.i = f.i + 1 JOIN books b ON b.book_id = f.book_id))
          SELECT book_id, unit_ix, start, CASE WHEN start < 0 THEN 'not found' ELSE '' END AS error FROM f WHERE i > 0""",
        "requests_once": """SELECT event_id, user_id, event_type FROM (
          SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS gap FROM events)
          WHERE gap IS NULL OR gap > 21600000000""",
    }


def oracle_sql() -> dict[str, str]:
    return {
        "doc_word_count": rf"WITH {BOOKS} SELECT book_id, CAST(length(regexp_replace(text, '\s', '', 'g')) AS BIGINT) AS word_count, regexp_matches(text, '\S') AS ok FROM books",
        "doc_tokens": f"WITH {BOOKS} SELECT book_id, {TOKENS} AS tokens FROM books",
        "cost_estimate": f"""WITH {BOOKS}, t AS (SELECT book_id, length(text) AS n, {TOKENS} AS tokens FROM books),
          e AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(1, CAST(ceil(n / 12000.0::DOUBLE) AS BIGINT)) END AS calls FROM t),
          f AS (SELECT *, CAST(ceil(tokens * 1.12::DOUBLE) AS BIGINT) + calls * 300 AS i, CAST(ceil(tokens * 0.15::DOUBLE) AS BIGINT) AS o FROM e)
          SELECT book_id, n AS source_chars, calls AS api_calls, i AS input_tokens, o AS output_tokens, calls * 2 AS time_seconds_low, calls * 8 AS time_seconds_high,
            (i * 2 + o * 200 + 50) // 100 / 1e6::DOUBLE AS cost_cny_low, (i + o * 2) / 1e6::DOUBLE AS cost_cny_high, '2026-08-05' AS pricing_version FROM f""",
        "actual_costs": "SELECT l_orderkey, (CAST(sum(l_partkey) * 2 + sum(l_suppkey) * 100 + sum(CAST(floor(l_quantity) AS BIGINT)) * 200 AS BIGINT) + 50) // 100 / 1e6::DOUBLE AS cost_cny FROM lineitem GROUP BY l_orderkey",
        "target_ratios": "SELECT doc_id, round((CASE source WHEN 'src1' THEN 0.25 WHEN 'src2' THEN 0.08 ELSE 0.15 END)::DOUBLE * (CASE lang WHEN 'fr' THEN 0.7 WHEN 'de' THEN 1.3 ELSE 1.0 END)::DOUBLE, 6) AS ratio FROM documents",
        "line_spans": f"WITH {BOOKS}, {LINES} SELECT book_id, line_no, start, least(start + length(line) + 1, size) AS stop, line FROM lines",
        "summaries": rf"WITH {BOOKS}, f AS (SELECT book_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM books) SELECT book_id, CASE WHEN length(t) > 30 THEN substring(t, 1, 30) || '…' ELSE t END AS label FROM f",
        "blocks_from_lines": rf"""WITH {CONV}, {LINES}, marked AS (SELECT *, regexp_matches(line, '^[ \t]*$') AND start + length(line) < size AS blank FROM lines),
          runs AS (SELECT *, sum(CAST(blank AS INT)) OVER (PARTITION BY book_id ORDER BY line_no) AS run FROM marked)
          SELECT book_id, min(start) AS start, max(least(start + length(line) + 1, size)) AS stop FROM runs WHERE NOT blank GROUP BY book_id, run HAVING max(length({STRIPPED})) > 0""",
        "atx_chapters": f"WITH {CONV}, {LINES}, {CHAPTERS} SELECT * FROM chapters",
        "short_line_headings": rf"WITH {BOOKS}, {LINES}, h AS (SELECT book_id, start AS pos, regexp_replace(regexp_replace({STRIPPED}, '^#+', ''), '^\s+|\s+$', '', 'g') AS heading FROM lines) SELECT * FROM h WHERE regexp_matches(heading, '^[\pL\pM\pN_]+\.$')",
        "html_clean": f"WITH t AS (SELECT page_id, {HTML_TEXT} AS t FROM pages) SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM t",
        "html_headings": rf"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS html, generate_subscripts(regexp_extract_all(coalesce(html, ''), '(?is)<h1[^>]*>(.*?)</h1>', 1), 1) - 1 AS n FROM pages)
          SELECT page_id, n, 1 AS level, regexp_replace({HTML_TEXT}, '^\s+|\s+$', '', 'g') AS title FROM h""",
        "html_modalities": r"""SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '(?i)<table\b')) AS "table", len(regexp_extract_all(coalesce(html, ''), '(?i)<(?:img|svg)\b')) AS image,
          len(regexp_extract_all(coalesce(html, ''), '(?i)<(?:math|m:math)\b|class=["''][^"'']*(?:math|latex)')) AS formula, len(regexp_extract_all(coalesce(html, ''), '(?i)<(?:pre|code)\b')) AS code FROM pages""",
        "merged_warnings": "SELECT user_id, event_type AS type, '正文' AS location, max(CAST(floor(value) AS BIGINT)) AS count, 'm' || min(event_id) AS message, min(event_id) AS seq FROM events GROUP BY user_id, event_type",
        "dup_lines": f"WITH {BOOKS}, {LINES}, {DUPS} SELECT book_id, line, n FROM dups",
        "dup_regions": f"WITH {BOOKS}, {LINES}, {DUPS}, {REGIONS} SELECT book_id, start, stop, label FROM regions",
        "head_windows": f"WITH {BOOKS}, {LINES}, t AS (SELECT book_id, min(start) AS main_start FROM lines WHERE regexp_matches({STRIPPED}, '^#*\\s*(Chapter|CHAPTER)\\s+\\d+\\b') GROUP BY book_id) SELECT book_id, main_start, coalesce(main_start, least(length(text), 5000)) AS head_end FROM books LEFT JOIN t USING (book_id)",
        "copyright_blocks": f"WITH {BOOKS}, {HEADS} SELECT book_id, start, stop, reason FROM heads",
        "merged_regions": f"WITH {BOOKS}, {LINES}, {DUPS}, {REGIONS}, every AS (SELECT * FROM regions), {MERGED} SELECT book_id, start, stop, reason FROM merged",
        "pruned_docs": PRUNED + " SELECT book_id, n_regions, original_chars, removed_chars, CASE WHEN original_chars > 0 THEN round((original_chars - removed_chars)::DOUBLE / original_chars, 4) ELSE 0.0 END AS kept_ratio, md5(pruned_text) AS pruned_md5 FROM pruned",
        "kept_ratio_by_lang": PRUNED + " SELECT lang, count(*) AS n, CAST(sum(original_chars) AS BIGINT) AS original, CAST(sum(removed_chars) AS BIGINT) AS removed FROM pruned GROUP BY lang",
        "subtracted_regions": f"""WITH {BOOKS}, {LINES}, {DUPS}, {REGIONS}
          SELECT book_id, start, stop FROM regions WHERE 2000 <= start OR 100 >= stop
          UNION ALL SELECT book_id, start, 100 FROM regions WHERE NOT (2000 <= start OR 100 >= stop) AND start < 100
          UNION ALL SELECT book_id, 2000, stop FROM regions WHERE NOT (2000 <= start OR 100 >= stop) AND stop > 2000""",
        "remapped_chapters": f"""WITH {CONV}, {LINES}, {CHAPTERS}, sized AS (SELECT book_id, length(text) AS n FROM books),
          every AS (SELECT book_id, start_char AS seq, start_char + 15 AS start, least(start_char + 55, n) AS stop, 'duplicate' AS reason FROM chapters JOIN sized USING (book_id) WHERE start_char * 2 >= n), {MERGED},
          moved AS (SELECT c.book_id, c.chapter_ix, c.start_char, c.end_char, s.n,
              sum(greatest(0, least(m.stop, c.start_char) - m.start)) AS before, sum(greatest(0, least(m.stop, c.end_char) - m.start)) AS upto,
              sum(greatest(0, least(m.stop, c.end_char) - greatest(m.start, c.start_char))) AS lost, bool_or(m.start <= c.start_char AND c.start_char < m.stop) AS inside, sum(m.stop - m.start) AS gone
            FROM chapters c JOIN sized s USING (book_id) JOIN (SELECT book_id, start, stop FROM merged UNION ALL SELECT book_id, 0, 0 FROM sized) m USING (book_id) GROUP BY ALL)
          SELECT book_id, chapter_ix, CAST(start_char - before AS BIGINT) AS start_char, CAST(end_char - upto AS BIGINT) AS end_char FROM moved
          WHERE NOT inside AND NOT (end_char > start_char AND lost * 2 >= end_char - start_char) AND start_char - before < end_char - upto AND start_char - before < n - gone""",
        "distill_units": rf"WITH {CONV}, {LINES}, {CHAPTERS}, {UNITS} SELECT book_id, unit_ix, title, start, stop FROM texts WHERE regexp_matches(text, '\S')",
        "chunk_plan": f"WITH RECURSIVE {CONV}, {chunk_fold('books', 'book_id')} SELECT book_id, chunk_ix, start, stop FROM chunked",
        "call_counts": CHUNKS + " SELECT book_id, count(*) AS calls, count(DISTINCT unit_ix) AS units FROM planned GROUP BY book_id",
        "chunk_targets": CHUNKS + " SELECT book_id, unit_id, CAST(target_chars AS BIGINT) AS target_chars, CAST(chunk_target AS BIGINT) AS chunk_target, length(chunk_text) AS chunk_chars FROM planned",
        "cache_keys": KEYED + " SELECT book_id, unit_id, cache_key FROM keyed",
        "prompts": CHUNKS + " SELECT book_id, unit_id, md5('Part ' || (unit_ix + 1) || ' of 1: ' || title || chr(10) || 'Aim at about ' || chunk_target || ' characters.' || chr(10) || chr(10) || chunk_text) AS prompt_md5, length('Condense faithfully into Markdown. Keep definitions, steps, figures and limits. Strength: standard. Add nothing that the source doesn''t say.') AS system_chars FROM planned",
        "checkpoint_reuse": KEYED + """, found AS (SELECT *, CASE WHEN book_id % 2 = 0 AND length(chunk_text) > 0 THEN least(length(chunk_text), chunk_target) WHEN book_id % 3 = 0 AND chunk_target // 2 > 0 THEN least(length(chunk_text), chunk_target // 2) END AS n FROM keyed)
          SELECT book_id, unit_id, CASE WHEN n >= chunk_target * 0.75 AND NOT n > greatest(chunk_target * 2, chunk_target + 500) THEN CAST(n AS BIGINT) END AS reused_chars FROM found""",
        "length_verdicts": CHUNKS + " SELECT book_id, unit_id, CASE WHEN length(chunk_text) > greatest(chunk_target * 2, chunk_target + 500) THEN 'long' WHEN length(chunk_text) < chunk_target * 0.75 THEN 'short' ELSE '' END AS issue FROM planned",
        "merged_output": CHUNKS + r""", bad AS (SELECT book_id, unit_ix, min(chunk_ix) FILTER (WHERE length(chunk_text) % 97 = 0) AS b FROM planned GROUP BY ALL),
          parts AS (SELECT p.book_id, p.unit_ix, string_agg(chunk_text, chr(10) || chr(10) ORDER BY chunk_ix) FILTER (WHERE b IS NULL OR chunk_ix < b) AS t, max(CASE WHEN b IS NULL THEN 0 ELSE 1 END) AS failed FROM planned p JOIN bad USING (book_id, unit_ix) GROUP BY ALL)
          SELECT book_id, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY unit_ix) FILTER (WHERE regexp_matches(coalesce(t, ''), '\S')), '')) AS output_md5, count(*) AS n_units, CAST(sum(failed) AS BIGINT) AS n_errors FROM parts GROUP BY book_id""",
        "result_totals": CHUNKS + " SELECT book_id, CAST(sum(source_chars) AS BIGINT) AS source_chars, CAST(sum(chunk_target) AS BIGINT) AS target_chars, count(*) AS api_calls FROM planned GROUP BY book_id",
        "next_queue_orders": f"WITH {TASKS} SELECT task_id, (SELECT coalesce(max(queue_order), -1) FROM tasks WHERE task_id % 5 <> 0) + row_number() OVER (ORDER BY created_at, task_id) AS queue_order FROM tasks WHERE task_id % 5 = 0",
        "claimable": f"WITH {TASKS} SELECT task_id, queue_order FROM tasks WHERE status = 'pending' AND NOT cancel_requested AND NOT delete_requested",
        "claim_first": f"WITH {TASKS}, f AS (SELECT arg_min(task_id, queue_order) AS id FROM tasks WHERE status = 'pending' AND NOT cancel_requested AND NOT delete_requested) SELECT CASE WHEN task_id = id THEN 'running' ELSE status END AS status, count(*) AS n FROM tasks, f GROUP BY 1",
        "cancel_states": f"""WITH {TASKS} SELECT CASE WHEN task_id % 7 = 0 AND status = 'pending' THEN 'cancelled' ELSE status END AS status, CASE WHEN task_id % 7 = 0 AND status = 'pending' THEN 'cancelled' ELSE stage END AS stage,
          cancel_requested OR (task_id % 7 = 0 AND status = 'running') AS cancel_requested, count(*) AS n FROM tasks GROUP BY 1, 2, 3""",
        "recovery_states": f"WITH {TASKS} SELECT task_id, CASE WHEN status = 'running' THEN CASE WHEN cancel_requested THEN 'cancelled' ELSE 'pending' END ELSE status END AS status, CASE WHEN status = 'running' AND cancel_requested THEN 'cancelled' ELSE stage END AS stage FROM tasks WHERE NOT delete_requested",
        "upsert_latest": "SELECT l_partkey AS cache_key, max(l_shipdate) AS updated_at FROM lineitem GROUP BY 1",
        "failed_reset": f"WITH {LEDGER_UNITS} SELECT CASE WHEN status = 'error' THEN 'pending' ELSE status END AS status, count(*) AS n, count(*) FILTER (WHERE status <> 'error') AS with_output FROM units GROUP BY 1",
        "cache_puts": f"""WITH {CACHE}, new AS (SELECT s_suppkey AS cache_key, CASE WHEN s_nationkey > 12 THEN CAST(s_nationkey AS VARCHAR) ELSE '' END AS book, s_name AS o FROM supplier)
          SELECT cache_key, CASE WHEN coalesce(book, '') <> '' THEN book ELSE coalesce(CAST(book_id AS VARCHAR), '') END AS book_id, coalesce(o, output) AS output, coalesce(hit_count, 0) AS hit_count FROM cache FULL JOIN new USING (cache_key)""",
        "cache_hits": "SELECT p_partkey AS cache_key, count(l_partkey) AS hit_count FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1",
        "cache_backfill": f"""WITH {TASKS}, {LEDGER_UNITS}, {CACHE}, used AS (SELECT u.cache_key, arg_min(CAST(t.book_id AS VARCHAR), (u.task_id, u.unit_id)) AS b FROM units u JOIN tasks t USING (task_id) GROUP BY 1)
          SELECT c.cache_key, coalesce(CAST(c.book_id AS VARCHAR), b, '') AS book_id FROM cache c LEFT JOIN used USING (cache_key)""",
        "delete_answers": f"WITH {TASKS}, asked AS (SELECT DISTINCT l_orderkey + 50 AS task_id FROM lineitem) SELECT task_id, CASE WHEN status IS NULL THEN 'absent' WHEN status = 'running' THEN 'deleting' ELSE 'deleted' END AS answer FROM asked LEFT JOIN tasks USING (task_id)",
        "cascade_delete": f"WITH {TASKS} SELECT task_id, count(l_orderkey) AS n_units FROM tasks LEFT JOIN lineitem ON l_orderkey = task_id WHERE NOT delete_requested GROUP BY 1",
        "book_purge": f"""WITH {TASKS}, {LEDGER_UNITS}, {CACHE}, books AS (SELECT c_custkey AS book_id FROM customer WHERE c_custkey % 50 = 1)
          SELECT cache_key FROM cache WHERE coalesce(book_id NOT IN (SELECT book_id FROM books), true) AND cache_key NOT IN (SELECT cache_key FROM units WHERE task_id IN (SELECT task_id FROM tasks WHERE book_id IN (SELECT book_id FROM books)))""",
        "deletion_previews": f"WITH {TASKS} SELECT book_id, count(*) AS n_tasks, count(*) FILTER (WHERE status IN ('pending', 'running')) AS n_active, coalesce(string_agg(CAST(task_id AS VARCHAR), ',' ORDER BY task_id) FILTER (WHERE status IN ('pending', 'running')), '') AS active_ids FROM tasks GROUP BY 1",
        "moved_task": f"""WITH {TASKS}, w AS (SELECT * FROM tasks WHERE status = 'pending' AND NOT cancel_requested AND NOT delete_requested),
          a AS (SELECT max(task_id) AS moved, min(task_id) FILTER (WHERE task_id % 7 = 0) AS b FROM w)
          SELECT task_id, row_number() OVER (ORDER BY CASE WHEN task_id = moved AND moved <> b THEN b - 0.5 ELSE queue_order END, created_at, task_id) - 1 AS queue_order FROM w, a""",
        "deletion_states": "WITH r AS (SELECT CASE WHEN c_nationkey < 5 AND c_custkey % 4 <> 2 THEN 'staged' ELSE ['preparing', 'staged', 'completed', 'failed'][CAST(c_custkey % 4 AS INT) + 1] END AS state FROM customer) SELECT state, count(*) AS n FROM r WHERE state <> 'completed' GROUP BY 1",
        "library_listing": r"""SELECT d.doc_id, coalesce(source, '') AS title, CASE WHEN quality = 1 THEN 'ok' WHEN quality = 0 THEN 'error' WHEN regexp_matches(coalesce(text, ''), '\S') THEN 'ok' ELSE 'pending' END AS extract_status, coalesce(n_chars, 0) AS word_count FROM documents d LEFT JOIN labels USING (doc_id)""",
        "extraction_recovery": "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL AND NOT n_chars > 1000",
        "claim_candidates": r"""WITH l AS (SELECT item_id AS book_id, unnest(string_split(replace(text, '. ', '.; '), chr(10))) AS raw, generate_subscripts(string_split(replace(text, '. ', '.; '), chr(10)), 1) - 1 AS line_no FROM benchmark),
          k AS (SELECT book_id, line_no, regexp_replace(regexp_replace(regexp_replace(raw, '^[#>*+\-\d.\s]+', ''), '^\s+|\s+$', '', 'g'), '[*_`]+', '', 'g') AS line FROM l),
          s AS (SELECT book_id, line_no, unnest(regexp_extract_all(line, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$')) AS s FROM k WHERE length(line) >= 18 AND NOT ends_with(line, '：')),
          c AS (SELECT book_id, line_no, regexp_replace(s, '^\s+|\s+$', '', 'g') AS claim FROM s) SELECT * FROM c WHERE length(claim) BETWEEN 18 AND 220""",
        "audit_samples": audit_picks("SELECT conv_id AS book_id, turn AS chapter_index, coalesce(text, '') AS text FROM conversations") + " SELECT book_id, k + 1 AS sample, chapter_index, line_no, claim FROM picks",
        "bigram_windows": audit_picks("SELECT doc_id AS book_id, 0 AS chapter_index, coalesce(text, '') AS text FROM documents") + r""",
          src AS (SELECT doc_id AS book_id, text FROM documents WHERE text <> ''),
          w AS (SELECT book_id, i * 800 AS start, substring(text, CAST(i * 800 + 1 AS INT), 1600) AS win FROM (SELECT book_id, text, unnest(range(CAST(greatest(ceil((length(text) - 1600) / 800.0::DOUBLE), 0) AS BIGINT) + 1)) AS i FROM src)),
          gw AS (SELECT book_id, start, regexp_replace(win, '\s+', '', 'g') AS c FROM w),
          q AS (SELECT book_id, k, unnest(list_distinct(list_transform(range(1, length(c)), lambda i: substring(c, CAST(i AS INT), 2)))) AS g FROM (SELECT book_id, k, regexp_replace(claim, '\s+', '', 'g') AS c FROM picks)),
          s AS (SELECT book_id, k, start, sum(CAST(contains(c, g) AS INT))::DOUBLE / count(*) AS score FROM q JOIN gw USING (book_id) GROUP BY ALL),
          r AS (SELECT *, row_number() OVER (PARTITION BY book_id, k ORDER BY score DESC, start) AS rank FROM s) SELECT book_id, k + 1 AS sample, rank, start, round(score, 6) AS score FROM r WHERE rank <= 5""",
        "sample_per_group": f"""WITH {BOOKS}, {LINES}, n AS (SELECT book_id, max(line_no) + 1 AS n FROM lines GROUP BY 1) SELECT book_id, CAST(('0x' || substring(sha256('20260809:' || book_id), 1, 12)) AS BIGINT) % n AS line_no FROM n""",
        "audit_rollup": "SELECT coalesce(bool_and(quality = 1), false) AS all_pass, count(*) FILTER (WHERE quality = 1) AS supported, count(*) AS total FROM labels",
        "export_names": "SELECT o_orderkey, replace(o_orderpriority, '-', '') || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || (CASE WHEN k > 0 THEN '_' || k ELSE '' END) || '.md' AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey) - 1 AS k FROM orders)",
        "latest_event_states": "SELECT date_trunc('day', ts) AS day, user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY 1, 2",
            "rule_regions": f"WITH {COMPOSED}, {LINES}, {DUPS}, {REGIONS}, {FIXED} SELECT book_id, start, stop, reason FROM heads UNION ALL SELECT book_id, start, stop, reason FROM regions",
        "rule_removal": COMPOSED_PRUNED + " SELECT p.book_id, r.reasons, original_chars, removed_chars, md5(pruned_text) AS pruned_md5 FROM pruned p JOIN (SELECT book_id, string_agg(reason, ',' ORDER BY start) AS reasons FROM merged GROUP BY 1) r USING (book_id)",
        "composed_chapters": f"WITH {COMPOSED}, {COMPOSED_CHAPTERS} SELECT * FROM chapters",
        "distill_inputs": COMPOSED_PRUNED + f""", {COMPOSED_CHAPTERS},
          shifted AS (SELECT c.book_id, c.chapter_ix, c.start_char, c.end_char, p.original_chars AS n, sum(greatest(0, least(m.stop, c.start_char) - m.start)) AS before, sum(greatest(0, least(m.stop, c.end_char) - m.start)) AS upto,
              sum(greatest(0, least(m.stop, c.end_char) - greatest(m.start, c.start_char))) AS lost, bool_or(m.start <= c.start_char AND c.start_char < m.stop) AS inside, sum(m.stop - m.start) AS gone
            FROM chapters c JOIN pruned p USING (book_id) JOIN merged m USING (book_id) WHERE c.book_id % 2 = 0 GROUP BY ALL),
          moved AS (SELECT book_id, CAST(start_char - before AS BIGINT) AS start_char FROM shifted WHERE NOT inside AND NOT (end_char > start_char AND lost * 2 >= end_char - start_char) AND start_char - before < end_char - upto AND start_char - before < n - gone),
          chosen AS (SELECT * FROM moved UNION ALL SELECT book_id, start_char FROM chapters WHERE book_id NOT IN (SELECT book_id FROM moved)),
          counted AS (SELECT book_id, count(*) AS n_chapters, min(start_char) AS first_char FROM chosen GROUP BY 1)
          SELECT p.book_id, CASE WHEN p.book_id % 2 = 0 THEN length(pruned_text) ELSE original_chars END AS n_chars, coalesce(n_chapters, 0) AS n_chapters, first_char FROM pruned p LEFT JOIN counted USING (book_id)""",
        "plan_estimate": CHUNKS + f""", t AS (SELECT book_id, length(text) AS n, {TOKENS} AS tokens FROM books), c AS (SELECT book_id, count(*) AS calls FROM planned GROUP BY 1),
          e AS (SELECT t.*, coalesce(calls, 0) AS calls FROM t LEFT JOIN c USING (book_id)),
          f AS (SELECT *, CAST(ceil(tokens * 1.12::DOUBLE) AS BIGINT) + calls * 300 AS i, CAST(ceil(tokens * (0.15::DOUBLE * 1.3::DOUBLE)) AS BIGINT) AS o FROM e)
          SELECT book_id, n AS source_chars, calls AS api_calls, i AS input_tokens, o AS output_tokens, calls * 2 AS time_seconds_low, calls * 8 AS time_seconds_high,
            (i * 2 + o * 200 + 50) // 100 / 1e6::DOUBLE AS cost_cny_low, (i + o * 2) / 1e6::DOUBLE AS cost_cny_high, '2026-08-05' AS pricing_version FROM f""",
        "task_updates": f"WITH {TASKS} SELECT CASE WHEN task_id % 3 = 0 THEN 'error' ELSE status END AS status, CASE WHEN task_id % 6 = 0 THEN 'late' ELSE stage END AS stage, count(*) AS n FROM tasks GROUP BY 1, 2",
        "unknown_updates": "SELECT DISTINCT l_orderkey + 50 AS task_id FROM lineitem WHERE l_orderkey + 50 NOT IN (SELECT o_orderkey FROM orders)",
        "ordered_units": f"WITH {LEDGER_UNITS} SELECT task_id, unit_id, row_number() OVER (PARTITION BY task_id ORDER BY unit_id) AS place FROM units",
        "book_tasks": f"WITH {TASKS} SELECT book_id, task_id, row_number() OVER (PARTITION BY book_id ORDER BY queue_order, created_at, task_id) AS place FROM tasks",
        "deletion_guards": f"""WITH {TASKS}, d AS (SELECT c_custkey AS book_id, CASE WHEN c_nationkey < 10 THEN 'staged' ELSE 'failed' END AS state FROM customer WHERE c_custkey % 4 = 0),
          a AS (SELECT book_id, string_agg(CAST(task_id AS VARCHAR), ',' ORDER BY queue_order, created_at) AS ids FROM tasks WHERE status IN ('pending', 'running') GROUP BY 1)
          SELECT c_custkey AS book_id, CASE WHEN d.state IS NOT NULL THEN d.state WHEN ids IS NOT NULL THEN 'blocked' ELSE 'preparing' END AS state, CASE WHEN d.state IS NULL THEN coalesce(ids, '') ELSE '' END AS blocking
          FROM customer LEFT JOIN d ON d.book_id = c_custkey LEFT JOIN a ON a.book_id = c_custkey WHERE c_custkey % 3 <> 1""",
        "event_props": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) END AS k, '' AS note FROM events",
        "resource_ids": "SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z0-9][A-Za-z0-9_-]{0,127}') AS as_it_is, regexp_full_match(translate(p_name, ' #', '_-'), '[A-Za-z0-9][A-Za-z0-9_-]{0,127}') AS joined FROM part",
        "book_files": "SELECT 'b' || s_suppkey AS book_id, folder, 'b' || s_suppkey || ending AS name FROM supplier, (VALUES ('books', '.txt'), ('books', '.meta.json'), ('books', '_0.epub'), ('intermediate', '.prune.json')) f(folder, ending) WHERE s_suppkey % 3 = 1",
        "source_fingerprints": "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 AND doc_id % 2 = 0 THEN sha256(CAST(doc_id AS VARCHAR)) ELSE sha256(coalesce(text, '')) END AS fingerprint FROM documents",
        "export_markdown": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS title, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
          m AS (SELECT doc_id, '---' || chr(10) || '书名: ' || title || chr(10) || '作者: 未知' || chr(10) || '原格式: txt' || chr(10) || '压缩强度: 标准（约 15%）' || chr(10) || '保留比例: ' || CASE WHEN n > 0 THEN '100.0%' ELSE '0.0%' END || chr(10)
            || '原文约 ' || n || ' 字 → 精华 ' || n || ' 字' || chr(10) || 'API 调用: 1 次' || chr(10) || CASE WHEN doc_id % 3 > 0 THEN '提示: ' || doc_id % 3 || ' 处章节有告警（详见拆解结果）' || chr(10) ELSE '' END || '---' || chr(10) || chr(10)
            || CASE WHEN doc_id % 3 = 0 THEN '## 内容处理告警' || chr(10) || chr(10) || '- body：check（' || doc_id % 5 || ' 处）' || chr(10) || chr(10) ELSE '' END || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) AS md FROM d)
          SELECT doc_id AS book_id, length(md) AS n_chars, md5(md) AS markdown_md5 FROM m""",
        "evidence_matches": r"""WITH d AS (SELECT doc_id AS book_id, coalesce(text, '') AS text FROM documents),
          p AS (SELECT *, substring(text, length(text) // 2, 60) AS part FROM d),
          q AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN book_id % 3 = 0 THEN replace(part, ' ', '  ') ELSE part END, '^\s+|\s+$', '', 'g'), '^["''`“”‘’]+|["''`“”‘’]+$', '', 'g') AS quote FROM p),
          c AS (SELECT *, regexp_replace(text, '\s+', '', 'g') AS loose_text, regexp_replace(quote, '\s+', '', 'g') AS loose_quote FROM q),
          f AS (SELECT *, CASE WHEN quote = '' THEN -1 ELSE instr(text, quote) - 1 END AS exact, CASE WHEN loose_quote = '' THEN -1 ELSE instr(loose_text, loose_quote) - 1 END AS loose FROM c)
          SELECT book_id, CASE WHEN exact >= 0 THEN 'exact' WHEN loose >= 0 THEN 'whitespace_normalized' ELSE 'none' END AS match,
            CASE WHEN exact >= 0 THEN exact WHEN loose >= 0 THEN CAST(list_filter(range(length(text)), lambda i: NOT regexp_matches(text[i + 1], '^\s$'))[loose + 1] AS BIGINT) ELSE -1 END AS "offset" FROM f""",
    } | later()
