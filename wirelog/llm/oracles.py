"""SQL for the queries whose whole result SQL can express."""

#: Words of five or fewer in a row, all pairs by shared shingles, links at 0.8, components by
#: reachability.
JACCARD_JOIN = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(len(ws) - 4, 1)),
    lambda i: array_to_string(ws[i + 1 : i + 5], ' '))) AS g
  FROM w WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
  WHERE 10 * c >= 8 * (x.size + y.size - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, r.class_id, coalesce(l.n_links, 0) AS n_links FROM documents AS d
JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) AS r ON r.a = d.doc_id
LEFT JOIN (SELECT a, CAST(count(*) AS BIGINT) AS n_links FROM links GROUP BY a) AS l ON l.a = d.doc_id"""

#: Forty hexadecimal digits as four numbers of forty bits, eight letters each.
WARC = """
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, encode(coalesce(html, '')) AS payload FROM pages
), h AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p
), digits AS (
  SELECT *, list_transform(range(0, 4), lambda k: list_reduce(list_transform(
    range(1, 11), lambda i: CAST(instr('0123456789abcdef', substr(hex, CAST(k * 10 + i AS INTEGER), 1)) - 1 AS BIGINT)),
    lambda x, y: x * 16 + y)) AS numbers FROM h
), coded AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((numbers[j // 8 + 1] >> (35 - 5 * (j % 8))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex) AS last
  FROM digits
)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> last THEN last END AS refers_to FROM coded"""

#: The checksum by a table of bytes; near words by leaving out each letter in turn; forms followed to the root.
SPELLING = """
WITH RECURSIVE steps AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), coded AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
      ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END)) AS bytes FROM counted
), marked AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM coded, steps
), slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
    ELSE run END AS word, n FROM marked
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), holes AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), links AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes AS a JOIN holes AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes AS a JOIN words AS b ON b.word = a.rest
  UNION SELECT b.word, a.word, a.n FROM holes AS a JOIN words AS b ON b.word = a.rest
), best AS (
  SELECT word, near, near_n, CAST(count(*) OVER (PARTITION BY word) AS BIGINT) AS n_near FROM links
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
), rated AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
    CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words AS w LEFT JOIN best AS b ON b.word = w.word
), follow AS (
  SELECT word, word AS root, 0 AS depth FROM rated
  UNION ALL SELECT f.word, r.form, depth + 1 FROM follow AS f JOIN rated AS r ON r.word = f.root WHERE r.form IS NOT NULL
)
SELECT r.word, r.form, f.root, r.n, r.n_near, r.form_n FROM rated AS r
JOIN (SELECT word, arg_max(root, depth) AS root FROM follow GROUP BY word) AS f ON f.word = r.word"""
