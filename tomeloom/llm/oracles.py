"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

MIXING = r"""
WITH docs AS (
  SELECT doc_id, source, text, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM docs GROUP BY source),
weighed AS (
  SELECT *, CAST([1, 2, 3][CAST(rank % 3 AS INTEGER) + 1] AS DOUBLE) AS weight,
    CAST(source_size * 3 AS DOUBLE) AS top
  FROM sources),
levels AS (
  SELECT *, top / weight AS ratio,
    (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(top) OVER ahead, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0)) AS own
  FROM weighed
  WINDOW ahead AS (ORDER BY top / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, weight,
    least(top, weight * (SELECT own FROM levels WHERE own <= ratio ORDER BY ratio, rank LIMIT 1)) AS target
  FROM levels),
summed AS (
  SELECT d.*, t.source_size, t.weight, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS UNBOUNDED PRECEDING) AS cum
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, key, size, pass, CAST(pass * source_size + cum AS DOUBLE) / weight AS finish
  FROM summed, (SELECT unnest([0, 1, 2]) AS pass) p),
queue AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, key, pass ROWS UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER () / 3.0 AS budget
  FROM copies),
taken AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS passes FROM queue WHERE upto <= budget GROUP BY doc_id)
SELECT s.doc_id, s.size, s.source_size, s.target, CAST(coalesce(t.passes, 0) * s.size AS BIGINT) AS taken,
  coalesce(t.passes, 0) AS passes, s.source
FROM summed s LEFT JOIN taken t USING (doc_id)
"""

DECONTAMINATE = r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
found AS (
  SELECT d.doc_id, d.i, d.n, g.item
  FROM (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n) d
  JOIN windows g ON g.n = d.n AND g.gram = array_to_string(d.w[d.i : d.i + d.n - 1], ' ')),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
owners AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(o.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(o.names, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN owners o USING (doc_id)
"""


def _either(words: str) -> str:
    """The words with each letter in either case, in ASCII alone: (?i) would fold more."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: Kind, pattern, group of the value, its least length. The texts searched start with a space, so
#: that a kind which must not follow certain characters can match the character before it.
_SECRET_KINDS = [
    ("assign", f"(?:{_either('password|passwd|secret|token|api_?key')})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("vendor", "(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})", 0, 1),
    ("jwt", "[^A-Za-z0-9_-](eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,})", 1, 1),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("url", "[a-z][a-z0-9+.-]{1,20}://[^\\x20\\t\\r\\n/:@]{1,80}:([^\\x20\\t\\r\\n/:@]{3,200})@", 1, 3),
    ("bearer", f"{_either('bearer')}\\x20+([A-Za-z0-9._~+/-]+=*)", 1, 20),
    ("named", f"(?:{_either('access_?key|secret_?key|private_?key|auth_?key|encryption_?key|credentials?|pwd')})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, 12),
]


def _searched(kind: int) -> str:
    name, pattern, group, least = _SECRET_KINDS[kind]
    return f"""SELECT r, {kind} AS kind, '{name}' AS name, {1 if name == 'jwt' else 0} AS skipped, {least} AS least,
    string_split_regex(padded, '{pattern}') AS p, regexp_extract_all(padded, '{pattern}') AS w, regexp_extract_all(padded, '{pattern}', {group}) AS v FROM docs"""


# A jwt's match holds the character before it, and every offset counts the space before the text.
SECRETS = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, ' ' || coalesce(text, '') AS padded,
    coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo
  FROM documents),
searched AS ({' UNION ALL '.join(_searched(k) for k in range(len(_SECRET_KINDS)))}),
steps AS (
  SELECT r, kind, name, skipped, least, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w, unnest(v) AS v, unnest(p[1 : len(w)]) AS p
  FROM searched WHERE len(w) > 0),
spans AS (
  SELECT r, kind, name, v, least,
    sum(length(p) + length(w)) OVER so_far - length(w) + skipped - 1 AS start,
    sum(length(p) + length(w)) OVER so_far - 1 AS stop
  FROM steps WINDOW so_far AS (PARTITION BY r, kind ORDER BY i ROWS UNBOUNDED PRECEDING)),
kept AS (
  SELECT r, kind, v, start, name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span
  FROM spans WHERE length(v) >= least),
held AS (
  SELECT *, owners > 2 AND repos > 2 AS copied FROM (
    SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM kept JOIN docs USING (r) GROUP BY v)),
listed AS (
  SELECT r,
    count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3 OR NOT copied) AS spans,
    string_agg(span, ',' ORDER BY start, kind) FILTER (copied) AS copied_spans,
    string_agg(owners || ':' || repos, ',' ORDER BY start, kind) FILTER (kind < 3 OR NOT copied) AS span_owners,
    count(*) FILTER (kind > 2 AND NOT copied) AS n_live, count(*) FILTER (kind > 2 AND copied) AS n_copied,
    count(*) FILTER (kind < 3 AND NOT copied) AS n_base_live, count(*) FILTER (kind < 3 AND copied) AS n_base_copied
  FROM kept JOIN held USING (v) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
  coalesce(n_base_live, 0) AS n_base_live, coalesce(n_base_copied, 0) AS n_base_copied,
  coalesce(copied_spans, '') AS copied_spans, coalesce(span_owners, '') AS span_owners
FROM docs LEFT JOIN listed USING (r)
"""

# DuckDB has no crc32: each text's bytes are folded through the table of the reversed polynomial.
SHARDS = """
WITH crc_table AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t
  FROM range(256) AS b(n)),
hexed AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, coalesce(strlen(text), 0) + 1 AS size
  FROM documents),
bytes AS (
  SELECT r, doc_id, size,
    list_transform(range(1, size), lambda k: CAST('0x' || substr(h, 2 * k - 1, 2) AS BIGINT)) AS b
  FROM hexed),
sized AS MATERIALIZED (
  SELECT r, doc_id, size,
    xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM bytes, crc_table),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY text_crc32, size, doc_id NULLS FIRST, r ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total
  FROM sized),
placed AS (SELECT *, CAST(least(15, (2 * before + size) * 16 // (2 * total)) AS INTEGER) AS shard FROM summed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""

# Every pair of vectors of one label, and components as what each vector reaches.
NEAR_VECTORS = """
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reached AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
roots AS (SELECT a, min(b) AS root FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, root) AS component_id, vec_id <= coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN roots ON roots.a = vec_id LEFT JOIN counted ON counted.a = vec_id
"""


# Words are hashed once each; what a table's words share is joined.
RESAMPLING = r"""
WITH crc_table AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t
  FROM range(256) AS b(n)),
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
in_doc AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM docs) GROUP BY r, w),
hashed AS (
  SELECT w, list_transform(range(1, strlen(w) + 1), lambda k: CAST('0x' || substr(hex(encode(w)), 2 * k - 1, 2) AS BIGINT)) AS b
  FROM (SELECT w FROM in_doc UNION SELECT w FROM target)),
buckets AS MATERIALIZED (
  SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM hashed, crc_table),
corpus_counts AS (SELECT bucket, sum(n) AS s FROM in_doc JOIN buckets USING (w) GROUP BY bucket),
target_counts AS (SELECT bucket, count(*) AS t FROM target JOIN buckets USING (w) GROUP BY bucket),
gains AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln(
      (coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM corpus_counts) + 10000)::DOUBLE
      / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM target_counts) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM buckets) LEFT JOIN corpus_counts USING (bucket) LEFT JOIN target_counts USING (bucket)),
weights AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total
  FROM in_doc JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features > 0 THEN CAST((total - ((total % n_features) + n_features) % n_features) // n_features AS BIGINT) ELSE 0 END AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM docs LEFT JOIN weights USING (r)),
placed AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
drawn AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, r) AS place, count(*) OVER () AS n
  FROM placed WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM placed LEFT JOIN drawn USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": SECRETS, "op2_shards": SHARDS, "op8_near_vectors": NEAR_VECTORS, "op9_decontaminate": DECONTAMINATE, "op10_mixing": MIXING, "op11_resampling": RESAMPLING}
