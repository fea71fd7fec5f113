"""The queries' SQL, named as the queries."""

from sitewise.llm.licences import LEAST, TEMPLATES

op2_quality_rules = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT rid, doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM docs),
grams AS (
  SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM parts WHERE len(ws) >= 5)),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + d) AS n FROM repeated, range(5) AS r(d) GROUP BY rid),
m AS (
  SELECT p.rid, doc_id, lang, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::BIGINT AS n_upper, len(ls)::BIGINT AS n_lines
  FROM parts p LEFT JOIN covered c USING (rid)),
shares AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_share, coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_share,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share
  FROM m),
good AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
long AS (
  SELECT lang, good, u.rule AS rule, u.share AS share
  FROM shares JOIN good USING (doc_id),
  unnest([{'rule': 'symbol_share', 'share': symbol_share}, {'rule': 'upper_share', 'share': upper_share},
          {'rule': 'dup_line_share', 'share': dup_line_share}, {'rule': 'repeat_share', 'share': repeat_share}]) AS x(u)),
grid AS (SELECT unnest([0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.03])::DOUBLE AS cutoff),
counts AS (
  SELECT lang, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND share > cutoff) AS k,
         count(*) FILTER (NOT good AND share > cutoff) AS caught
  FROM long, grid GROUP BY ALL),
tests AS (
  SELECT *, CASE WHEN n = 0 OR k >= n * 0.005 THEN 1.0 ELSE (
           SELECT sum(exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(0.005) + (n - j) * ln(0.995)))
           FROM range(k + 1) AS r(j)) END AS p_value,
         (SELECT count(*) FROM (SELECT DISTINCT coalesce(lang, '~null') FROM counts)) AS strata
  FROM counts),
safe AS (
  SELECT * FROM (SELECT *, bool_and(p_value <= 0.05 / (4 * strata)) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS ok FROM tests) WHERE ok),
chosen AS (SELECT lang, rule, arg_max(cutoff, caught * 1000 + cutoff) AS cutoff FROM safe GROUP BY lang, rule),
cuts AS (
  SELECT lang, max(cutoff) FILTER (rule = 'symbol_share') AS c1, max(cutoff) FILTER (rule = 'upper_share') AS c2,
         max(cutoff) FILTER (rule = 'dup_line_share') AS c3, max(cutoff) FILTER (rule = 'repeat_share') AS c4
  FROM chosen GROUP BY lang)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines, base_failed,
       NOT base_failed AND NOT (coalesce(symbol_share > c1, false) OR coalesce(upper_share > c2, false)
       OR coalesce(dup_line_share > c3, false) OR coalesce(repeat_share > c4, false)) AS kept
FROM shares s LEFT JOIN cuts ON s.lang IS NOT DISTINCT FROM cuts.lang
"""

op6_poisson_mix = r"""
WITH mass AS (SELECT source, sum(coalesce(length(text), 0)) AS mass FROM documents GROUP BY source),
weights AS (SELECT source, mass, pow(mass::DOUBLE, 0.5) AS w FROM mass),
rates AS (
  SELECT source, CASE WHEN mass > 0 THEN (SELECT sum(mass)::DOUBLE / sum(w) FROM weights WHERE mass > 0) * w / mass ELSE 0 END AS rate
  FROM weights),
drawn AS (
  SELECT d.*, rate, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '~')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
steps AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS upto
          FROM rates, range(0, 200) AS r(k) WHERE rate > 0),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.upto <= d.u) AS n
  FROM drawn d),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INTEGER AS copy FROM counted WHERE n > 0)
SELECT *, ('0x' || substr(md5('17/order|' || coalesce(doc_id::VARCHAR, '~') || '|' || copy), 1, 13))::BIGINT / 4503599627370496.0 AS shuffle_key
FROM copies
"""

op9_lsh_forest = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM docs WHERE len(ws) > 1)
  UNION ALL SELECT DISTINCT doc_id, ws[1] FROM docs WHERE len(ws) = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN low USING (doc_id)
"""

op10_warc_round_trip = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n FROM pages),
top AS (SELECT t, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY t)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.t) AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN top ON p.t = top.t AND n >= 1000
"""

_TEMPLATES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in kv)) for kv in TEMPLATES.items())
op7_licence_dice = rf"""
WITH templates(name, t) AS (VALUES {_TEMPLATES}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
passages AS (
  SELECT row_number() OVER () AS pid, rid, t FROM (
    SELECT rid, unnest(string_split(text, chr(10))) AS t FROM docs
    UNION ALL SELECT rid, text FROM docs WHERE contains(text, chr(10)))),
texts AS (SELECT pid::VARCHAR AS id, t FROM passages UNION ALL SELECT name, t FROM templates),
words AS (
  SELECT id, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS ws
  FROM texts),
pairs AS (SELECT DISTINCT id, ws[i] AS a, ws[i + 1] AS b FROM (SELECT id, ws, unnest(range(1, len(ws))) AS i FROM words WHERE len(ws) > 1)),
sizes AS (SELECT id, count(*) AS n FROM pairs GROUP BY id),
common AS (
  SELECT p.id AS pid, q.id AS name, count(*) AS c
  FROM pairs p JOIN pairs q ON p.a = q.a AND p.b = q.b JOIN templates ON q.id = templates.name
  WHERE p.id NOT IN (SELECT name FROM templates) GROUP BY 1, 2),
hits AS (
  SELECT common.pid::BIGINT AS pid, name, 2 * c / (x.n + y.n)::DOUBLE AS dice
  FROM common JOIN sizes x ON x.id = common.pid JOIN sizes y ON y.id = name WHERE 2 * c / (x.n + y.n)::DOUBLE >= {LEAST}),
found AS (
  SELECT rid, count(DISTINCT hits.pid) AS n_passages, string_agg(DISTINCT name, ';' ORDER BY name) AS licences, max(dice) AS dice,
         min({{'d': -dice, 'name': name}}).name AS licence
  FROM hits JOIN passages USING (pid) GROUP BY rid)
SELECT doc_id, licence, dice, coalesce(licences, '') AS licences, coalesce(n_passages, 0)::BIGINT AS n_passages
FROM docs LEFT JOIN found USING (rid)
"""

op11_fenwick_fim = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents),
hashed AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3,
         ('0x' || d[25:32])::BIGINT AS h4
  FROM docs),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1:n], ''), '') AS s
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

op12_crc_resampling = r"""
WITH texts AS (
  SELECT 'd' AS side, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, rid, doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM texts),
runs AS (
  SELECT side, rid, array_to_string(ws[i:i + k - 1], ' ') AS f
  FROM (SELECT side, rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM words, range(1, 4) AS r(k) WHERE len(ws) >= k)),
steps AS (SELECT list(list_reduce(range(8), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT) ORDER BY b) AS t FROM range(256) AS r(b)),
buckets AS (
  SELECT f, xor(list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT),
                lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM runs), steps),
found AS (SELECT side, rid, bucket, count(*) AS c FROM runs JOIN buckets USING (f) GROUP BY ALL),
counts AS (SELECT bucket, coalesce(sum(c) FILTER (side = 'd'), 0) AS s, coalesce(sum(c) FILTER (side = 'b'), 0) AS t FROM found GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln(((counts.t + 1)::DOUBLE * (totals.s + 10000)) / ((counts.s + 1)::DOUBLE * (totals.t + 10000))))::BIGINT AS gain
  FROM counts, totals),
weighed AS (SELECT rid, sum(c) AS n, sum(c * gain) AS weight FROM found JOIN gains USING (bucket) WHERE side = 'd' GROUP BY rid),
scored AS (
  SELECT rid, doc_id, len(ws) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (rid) WHERE side = 'd'),
ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS many FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= many THEN place END AS rank FROM scored LEFT JOIN ranked USING (rid)
"""

op13_token_group_join = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM docs WHERE len(ws) > 3)
  UNION ALL SELECT DISTINCT doc_id, array_to_string(ws, ' ') FROM docs WHERE len(ws) BETWEEN 1 AND 3),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents LEFT JOIN sizes USING (doc_id) JOIN low USING (doc_id)
"""
