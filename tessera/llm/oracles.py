"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

#: crc32 of a text's UTF-8 bytes, by the table of the polynomial 0xEDB88320.
_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(k))), lambda i: ('0x' || substr(hex(encode(k)), 2 * i::INT + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])))"""

SPELLING = f"""WITH RECURSIVE {_CRC_TABLE},
    cut AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
    runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS k, w, count(*) AS n FROM (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM cut) WHERE length(w) >= 7 GROUP BY ALL),
    summed AS (SELECT w, n, {_CRC} AS h FROM runs, crc_table),
    slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM summed),
    vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
    less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
    near AS (SELECT l.word, v.word AS other FROM less l JOIN vocab v ON v.word = l.d UNION SELECT v.word, l.word FROM less l JOIN vocab v ON v.word = l.d
        UNION SELECT a.word, b.word FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word),
    best AS (SELECT near.word, count(*) AS n_near, min({{'less': -o.n, 'word': near.other}}) AS b FROM near JOIN vocab o ON o.word = near.other GROUP BY 1),
    forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * v.n THEN b.word END AS form, CASE WHEN -b.less >= 10 * v.n THEN -b.less END AS form_n FROM vocab v LEFT JOIN best ON best.word = v.word),
    walk(word, last_) AS (SELECT word, word FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.last_ WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, w.last_ AS root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n FROM walk w JOIN forms e ON e.word = w.last_ AND e.form IS NULL JOIN forms f ON f.word = w.word"""

HARD_NEGATIVES = """WITH rows_ AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM rows_ a, rows_ b WHERE a.vec_id % 100 = 0),
    positive AS (SELECT anchor_id, id, score FROM scored WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INT) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10"""

JACCARD = """WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    cut AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM texts),
    sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM cut),
    each AS (SELECT doc_id, unnest(s) AS g FROM cut),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM met JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
    both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached AS (SELECT doc_id AS a, doc_id AS b FROM sized UNION SELECT r.a, l.b FROM reached r JOIN both_ l ON l.a = r.b)
    SELECT s.doc_id, s.n AS n_shingles, (SELECT min(b) FROM reached r WHERE r.a = s.doc_id) AS component_id FROM sized s"""
SUFFIX = """WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    starts AS (SELECT doc_id, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS i, h FROM texts),
    windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM starts),
    first_ AS (SELECT w, min(doc_id) AS d FROM windows GROUP BY w HAVING min(doc_id) <> max(doc_id)),
    hit AS (SELECT v.doc_id, v.i, v.i - coalesce(lag(v.i) OVER (PARTITION BY v.doc_id ORDER BY v.i), -1000) > 50 AS new FROM windows v JOIN first_ f ON f.w = v.w AND f.d < v.doc_id),
    grouped AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
    spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM grouped GROUP BY ALL),
    gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT t.doc_id, coalesce(s.b, 0), CAST(length(h) / 2 AS BIGINT) FROM texts t LEFT JOIN (SELECT doc_id, max(b) AS b FROM spans GROUP BY 1) s ON s.doc_id = t.doc_id),
    kept AS (SELECT g.doc_id, string_agg(substr(t.h, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS h FROM gaps g JOIN texts t ON t.doc_id = g.doc_id GROUP BY 1),
    counted AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY 1)
    SELECT t.doc_id, CAST(length(t.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
    FROM texts t LEFT JOIN counted c ON c.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id"""

ORACLES = {"op2_ngram_jaccard_join": JACCARD, "op4_suffix_dedup": SUFFIX, "op11_spelling_variants": SPELLING, "op13_hard_negatives": HARD_NEGATIVES}
