"""DuckDB SQL of the near-duplicate queries: every pair that shares something is compared, components by recursion."""

_COMPONENTS = """
reach AS (
  SELECT a AS node, a AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
), roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
"""

OP2_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), long AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k FROM long x JOIN long y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM common WHERE 100 * k >= 85 * (na + nb - k)), {_COMPONENTS}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept FROM sets LEFT JOIN roots ON node = doc_id
""".replace("GROUP BY ALL", "GROUP BY x.doc_id, y.doc_id")

OP10_SQL = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), {_COMPONENTS}, counts AS (SELECT a, count(*)::BIGINT AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN roots ON node = vec_id LEFT JOIN counts ON a = vec_id
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS terms FROM documents
), sized AS (SELECT *, len(terms)::BIGINT AS n FROM docs), total AS (SELECT (count(*) FILTER (n > 0))::BIGINT AS n_docs, coalesce(sum(n), 0)::BIGINT AS n_terms FROM sized),
held AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM sized) GROUP BY row, term),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
), df AS (SELECT term, count(*)::BIGINT AS df FROM held WHERE term IN (SELECT term FROM items) GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
lengths AS (SELECT row, doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM sized, total WHERE n > 0),
scores AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN held USING (term) JOIN lengths USING (row) GROUP BY item_id, row
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP12_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
placed AS (SELECT *, 2 * source_size AS cap, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sources),
levels AS (
  SELECT *, row_number() OVER o AS turn,
    (3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
    (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open
  FROM placed WINDOW o AS (ORDER BY cap::DOUBLE / weight, place)
), first AS (SELECT min(turn) AS turn, arg_min(rest, turn) AS rest, arg_min(open, turn) AS open FROM levels WHERE rest * weight < 2 * cap * open),
targets AS (
  SELECT source, source_size, CASE WHEN f.turn IS NULL OR l.turn < f.turn THEN cap::DOUBLE ELSE (f.rest * weight)::DOUBLE / (2 * f.open)::DOUBLE END AS target
  FROM levels l CROSS JOIN first f
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 1073741824)::BIGINT ELSE 0 END AS rate,
    ('0x' || substr(sha256('7:' || coalesce(source, '')), 1, 7))::BIGINT * 4 AS start
  FROM targets
), counted AS (
  SELECT r.*, source_size, target, rate, start, row_number() OVER (PARTITION BY r.source ORDER BY size DESC, doc_id NULLS LAST) AS k
  FROM rows r JOIN rates t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * ((start + k * rate) // 1073741824 - (start + (k - 1) * rate) // 1073741824))::BIGINT AS taken, source,
  ((start + k * rate) // 1073741824 - (start + (k - 1) * rate) // 1073741824)::BIGINT AS copies
FROM counted
"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS pos FROM split),
phrases AS (
  SELECT lang, size, list_slice(w, pos, pos + size - 1) AS words FROM places, (SELECT unnest([1, 2, 3]) AS size) WHERE pos + size - 1 <= len(w)
), counts AS (SELECT lang, size, array_to_string(words, ' ') AS phrase, any_value(words) AS words, count(*)::BIGINT AS f FROM phrases GROUP BY lang, size, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
chosen AS (SELECT * FROM counts WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM chosen) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[k + 1:], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase FROM chosen WHERE size = 3
  ) GROUP BY lang, phrase
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.f IS NULL OR 100 * g.f < 50 * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

#: Base32 of 20 bytes: each five hexadecimal digits are four letters.
_LETTERS = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * g + 1, 5))::BIGINT >> (15 - 5 * k)) & 31)::INTEGER + 1, 1)"

OP5_SQL = f"""
WITH payloads AS (
  SELECT row_number() OVER () AS row, page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), letters AS (SELECT row, g, k, {_LETTERS} AS letter FROM payloads, range(8) a(g), range(4) b(k)),
digests AS (SELECT row, string_agg(letter, '' ORDER BY g, k) AS payload_digest FROM letters GROUP BY row),
owners AS (SELECT payload, min(page_id) AS owner FROM payloads GROUP BY payload)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN owner IS NULL OR page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN owner IS NULL OR page_id = owner THEN NULL ELSE owner END AS refers_to
FROM payloads JOIN digests USING (row) JOIN owners USING (payload)
"""

#: The checksum's table by its rule (polynomial 0xEDB88320), and a text's bytes folded with it.
OP1_SQL = """
WITH RECURSIVE shifts AS (
  SELECT b, 0 AS k, b AS c FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM shifts WHERE k < 8
), lookup AS (SELECT list(c ORDER BY b) AS t FROM shifts WHERE k = 8),
rows AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT + 1 AS size, hex(coalesce(text, '')) AS digits FROM documents),
bytes AS (SELECT doc_id, size, list_transform(range(size - 1), lambda k: ('0x' || substr(digits, 2 * k + 1, 2))::BIGINT) AS b FROM rows),
sums AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[1 + xor(c, x) % 256])), 4294967295) AS text_crc32 FROM bytes, lookup
), ranged AS (
  SELECT *, sum(size) OVER o AS upto, row_number() OVER o AS place, sum(size) OVER () AS whole FROM sums
  WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
), placed AS (SELECT *, least(((2 * upto - size) * 8) // (2 * whole), 7)::INTEGER AS shard FROM ranged)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard FROM placed
"""
