"""DuckDB SQL of the corpus queries that SQL expresses over whole tables."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs by common deletion: two words one edit apart are equal without one letter each
#: (a replaced letter: the same position), or one is the other without a letter.
SPELLING = rf"""WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, length(run) AS size,
    xor(list_reduce([4294967295] || flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda ch:
      CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [CAST(192 + (unicode(ch) >> 6) AS BIGINT), CAST(128 + (unicode(ch) & 63) AS BIGINT)] END)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM runs, crc_table),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN run[:h % size] || run[h % size + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS near, max(n) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain(word, upto) AS (
  SELECT word, form FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.upto WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.upto FROM chain c JOIN forms f ON f.word = c.upto WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.upto, f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f LEFT JOIN ends e ON e.word = f.word"""

URLS = r"""WITH rules(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN url[position('://' IN url) + 3:] ELSE '' END AS rest FROM pages),
urls AS (
  SELECT row_number() OVER () AS row, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
fitting AS (
  SELECT u.row, first(r.host || r.path ORDER BY length(r.host || r.path) DESC) AS rule, first(r.verdict ORDER BY length(r.host || r.path) DESC) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.row)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.0-9-])(ads|spam|casino|adult|porn|xxx|pills|bets|betting|viagra|malware|phishing)([.0-9-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN fitting USING (row)"""

AUDIT = r"""WITH flags AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS smallest FROM documents),
split AS (SELECT *, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM texts),
fails AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > smallest, false)] AS f, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
  FROM split LEFT JOIN flags USING (doc_id)),
masks AS (SELECT part, f, good, bad, count(*) AS n FROM fails GROUP BY part, f, good, bad),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, o[s] AS filter, o[:s - 1] AS earlier, s AS step FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
outcomes AS (
  SELECT part, filter_order, step, filter, n, good, bad, f[filter] AS fails, len([x FOR x IN earlier IF f[x]]) > 0 AS gone, len([x FOR x IN f IF x]) = 1 AS alone
  FROM masks, steps),
counts AS (
  SELECT part, filter_order, step, filter,
    CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails AND alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (fails AND NOT gone AND good = 1), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (fails AND NOT gone AND bad = 1), 0) AS BIGINT) AS toxic_lost
  FROM outcomes GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counts"""
