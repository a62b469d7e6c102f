"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i+3], ' '))) AS s FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PART = "CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT)"
ARCHIVE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda g: {' || '.join(f"substr('{_ALPHABET}', CAST((({_PART} >> {s}) & 31) + 1 AS BIGINT), 1)" for s in (15, 10, 5, 0))}), '') AS payload_digest, min(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN head <> page_id THEN head END AS refers_to FROM d"""

MIXTURE = f"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size,
  -ln((CAST('0x' || substr(md5('mix' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / (0.1::DOUBLE + coalesce(CAST(length(regexp_replace(text, '[0-9#*$%&|<>{{}}]', '', 'g')) AS DOUBLE) / nullif(length(text), 0), 1.0::DOUBLE)) AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY 1),
o AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM src),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
f AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE cap > level * w),
g AS (SELECT source, source_size, CASE WHEN (SELECT level FROM f) IS NULL THEN cap ELSE least(cap, (SELECT level FROM f) * w) END AS target FROM o),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM g),
r AS (SELECT s.doc_id, s.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size)::BIGINT AS rest, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS before FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r"""

_MEASURES = ("word_length", "symbols", "dup_lines", "repeats")
_LEAST_SPREAD = (0.1, 0.02, 0.03, 0.02)


def _drawn(k: str) -> str:
    """A quartile drawn to the language's, and this to the corpus', by ten documents each."""
    return f"(o.n * o.{k} + 10.0::DOUBLE * ((l.n * l.{k} + 10.0::DOUBLE * a.{k}) / (l.n + 10.0::DOUBLE))) / (o.n + 10.0::DOUBLE)"


def _quartile(keys: str) -> str:
    return f"""SELECT {keys}{"," if keys else ""} measure, arg_min(v, bin) FILTER (WHERE upto >= 0.25 * total) AS low, arg_min(v, bin) FILTER (WHERE upto >= 0.75 * total) AS high, max(total)::DOUBLE AS n FROM
  (SELECT *, sum(n) OVER (PARTITION BY {keys}{"," if keys else ""} measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {keys}{"," if keys else ""} measure) AS total, CASE WHEN bin > -2000 THEN pow(1.02::DOUBLE, bin) * 2 / (1.02::DOUBLE + 1) ELSE 0 END AS v
   FROM (SELECT {keys}{"," if keys else ""} measure, bin, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL"""


RULES = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {_WORD}) AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
base AS (SELECT id, doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM w),
spots AS (SELECT id, i, array_to_string(words[i:i+4], ' ') AS win FROM (SELECT id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT id, i FROM (SELECT *, count(*) OVER (PARTITION BY id, win) AS c FROM spots) WHERE c > 1),
covered AS (SELECT id, count(DISTINCT j)::BIGINT AS n FROM (SELECT id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY 1),
m AS (SELECT b.*, coalesce(c.n, 0)::BIGINT AS n_repeat_words, n_words < 10 OR 100 * coalesce(c.n, 0) > 20 * n_words AS base_failed FROM base b LEFT JOIN covered c USING (id)),
x AS (SELECT *, word_chars::DOUBLE / greatest(n_words, 1) AS word_length, n_symbols::DOUBLE / greatest(n_words, 1) AS symbols, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_lines, n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeats FROM m),
each AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {k} AS x FROM x WHERE NOT base_failed" for k in _MEASURES)}),
sketch AS (SELECT lang, source, measure, CASE WHEN x > 0 THEN greatest(-1999, ceil(ln(x) / ln(1.02::DOUBLE))::INT) ELSE -2000 END AS bin, count(*) AS n FROM each GROUP BY ALL),
own AS ({_quartile("lang, source")}), of_lang AS ({_quartile("lang")}), of_all AS ({_quartile("")}),
q AS (SELECT o.lang, o.source, o.measure, {_drawn("low")} AS low, {_drawn("high")} AS high FROM own o JOIN of_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN of_all a ON o.measure = a.measure),
spread AS (SELECT *, 4 * greatest(high - low, CASE measure {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in zip(_MEASURES, _LEAST_SPREAD))} END, 0.02::DOUBLE * high) AS s FROM q),
lim AS (SELECT lang, source, max(CASE WHEN measure = 'word_length' THEN low - s END) AS wf, {", ".join(f"max(CASE WHEN measure = '{k}' THEN high + s END) AS {k}_to" for k in _MEASURES)} FROM spread GROUP BY ALL)
SELECT x.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(word_length >= wf AND {" AND ".join(f"{k} <= {k}_to" for k in _MEASURES)}, true) AS kept
FROM x LEFT JOIN lim ON x.lang IS NOT DISTINCT FROM lim.lang AND x.source IS NOT DISTINCT FROM lim.source"""

NEGATIVES = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS MATERIALIZED (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score QUALIFY rank <= 10"""

COLLOCATIONS = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\n\x0B\f\r]')), '[^ \t]+') AS w FROM d),
size AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY 1),
grams AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces CROSS JOIN (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
parted AS MATERIALIZED (SELECT lang, phrase, k, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j+1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM f)),
cuts AS MATERIALIZED (SELECT c.lang, c.phrase, c.k, c.a, j, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a))::BIGINT AS score FROM parted c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM f WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM f WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase AND b.k = 2 WHERE g.longer IS NULL OR 100 * g.longer < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN size USING (lang) QUALIFY rank <= 2000"""

_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
URLS = rf"""
WITH rules(verdict, rh, rp) AS (VALUES {", ".join(map(str, _RULES))}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS id, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
fit AS (SELECT id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1),
listed AS (SELECT DISTINCT host || path AS key FROM p WHERE regexp_extract(path, '/([0-9]{{1,18}})([^0-9]|$)', 1) IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN fit USING (id)"""

ORACLES: dict[str, str] = {"op1_minhash_near_dedup": NEAR_DUPLICATES, "op4_warc_archive": ARCHIVE, "op5_source_mixing": MIXTURE, "op9_quality_rules": RULES, "op11_hard_negatives": NEGATIVES, "op12_phrase_collocations": COLLOCATIONS, "op13_url_filters": URLS}
