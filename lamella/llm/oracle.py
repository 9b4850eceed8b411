"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from lamella.llm.common import LOWER, UPPER
from lamella.llm.quality import LEAST_SEEN, LEAST_TEXTS, MOST_WEIGHT, STEMS, STRIPPED
from lamella.llm.urlfilter import RULES as URL_RULES

_SPACE = r"\x20\x09-\x0D"
#: Written out again, so that a wrong rule of the ledger shows.
_CASES = """CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
  + CASE WHEN n_words < 10 * n_symbols THEN 4 ELSE 0 END + CASE WHEN n_dup_lines > 0.3 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
  + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END + CASE WHEN n_upper > 0.5 * n_letters THEN 64 ELSE 0 END + CASE WHEN n_letters < 0.5 * word_chars THEN 128 ELSE 0 END
  + CASE WHEN toxicity >= 6 + 0.05 * n_words THEN 512 ELSE 0 END"""
_STRIP = STRIPPED.replace("'", "''")
_WORD = f"trim(translate(x, '{UPPER}', '{LOWER}'), '{_STRIP}')"
_FEATURES = f"[f] || list_transform(list_filter([{', '.join(map(str, STEMS))}], lambda k: length(f) > k), lambda k: f[1:k] || '-')"
_BASE = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^{_SPACE}]+') AS w FROM d),
starts AS (SELECT k, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
windows AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS s FROM starts),
twice AS (SELECT k, s FROM windows GROUP BY 1, 2 HAVING count(*) > 1),
hit AS (SELECT DISTINCT k, unnest(range(i, i + 8)) AS p FROM windows JOIN twice USING (k, s)),
repeats AS (SELECT k, count(*) AS n FROM hit GROUP BY 1),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
per AS (SELECT k, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM lines WHERE regexp_matches(line, '[^{_SPACE}]') GROUP BY 1),
words AS (SELECT k, {_WORD} AS f, count(*) AS times FROM (SELECT k, unnest(w) AS x FROM w) GROUP BY 1, 2),
marks AS (SELECT doc_id, max(toxic) > 0 AS toxic FROM labels WHERE toxic IS NOT NULL GROUP BY 1),
labelled AS (SELECT words.*, toxic FROM words JOIN d USING (k) JOIN marks USING (doc_id)),
total AS (SELECT sum(times) FILTER (toxic) AS toxic, sum(times) FILTER (NOT toxic) AS clean FROM labelled),
seen AS (SELECT feature, coalesce(sum(times) FILTER (toxic), 0) AS toxic, coalesce(sum(times) FILTER (NOT toxic), 0) AS clean, count(DISTINCT k) FILTER (toxic) AS texts
  FROM (SELECT k, times, toxic, unnest({_FEATURES}) AS feature FROM labelled) WHERE length(feature) > 2 GROUP BY 1),
lexicon AS (SELECT feature, least(floor(log2((seen.toxic * total.clean) // ((seen.clean + 1) * total.toxic))), {MOST_WEIGHT}) AS weight FROM seen, total
  WHERE seen.toxic >= {LEAST_SEEN} AND texts >= {LEAST_TEXTS} AND seen.toxic * total.clean >= 4 * (seen.clean + 1) * total.toxic),
heavy AS (SELECT k, times, f, max(weight) AS weight FROM (SELECT k, times, f, unnest({_FEATURES}) AS feature FROM words) JOIN lexicon USING (feature) GROUP BY 1, 2, 3),
toxicity AS (SELECT k, sum(times * weight)::BIGINT AS n FROM heavy GROUP BY 1),
m AS (SELECT d.doc_id AS doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(per.dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
  coalesce(per.n, 0)::BIGINT AS n_lines, len(regexp_extract_all(text, '[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]'))::BIGINT AS n_upper, len(regexp_extract_all(text, '\p{{L}}'))::BIGINT AS n_letters,
  coalesce(toxicity.n, 0)::BIGINT AS toxicity FROM d JOIN w USING (k) LEFT JOIN repeats USING (k) LEFT JOIN per USING (k) LEFT JOIN toxicity USING (k))
SELECT *, ({_CASES})::BIGINT AS failed, {_BASE} AS base_failed, NOT {_BASE} AND ({_CASES}) = 0 AS kept FROM m
"""

_TEXT_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TEXT_WORDS} AS w FROM documents), b AS (SELECT item_id, {_TEXT_WORDS} AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS s, len(w[i:i + 12]) AS n FROM starts),
sizes AS (SELECT DISTINCT n FROM windows), places AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS p FROM d),
spelled AS (SELECT k, p, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM places, sizes WHERE p + n - 1 <= len(w)),
found AS (SELECT k, p, n, item_id FROM spelled JOIN windows USING (n, s)),
hits AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT k, p, n FROM found)) GROUP BY 1),
items AS (SELECT k, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM found GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN hits USING (k) LEFT JOIN items USING (k)
"""

_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

_PAGES = rf"""r AS (SELECT * FROM (VALUES {_RULE_ROWS}) t(verdict, host, path)),
p AS (SELECT row_number() OVER () AS k, page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT k, page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
f AS (SELECT k, r.host || r.path AS rule, r.verdict AS ruled, row_number() OVER (PARTITION BY k ORDER BY length(r.host || r.path) DESC, (r.verdict = 'allow')::INTEGER DESC) AS n
  FROM h JOIN r ON (h.host = r.host OR h.host LIKE '%.' || r.host) AND starts_with(h.path, r.path)),
c AS (SELECT h.*, rule, ruled FROM h LEFT JOIN (SELECT * FROM f WHERE n = 1) f USING (k))"""

#: The given pages declare no canonical link or refresh, so no page has an alias.
URLS = f"WITH {_PAGES} SELECT page_id, host, path, rule, coalesce(ruled, 'allow') AS verdict FROM c"

#: Pages joined by redirects: labels spread along the edges, both ways, until none changes.
REDIRECTS = f"""
WITH RECURSIVE {_PAGES},
e AS (SELECT a.url AS a, b.url AS b FROM pages a JOIN pages b ON b.page_id = floor(a.page_id * 3 / 5) WHERE a.page_id % 4 < 2),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reached AS (SELECT url FROM c WHERE ruled = 'block' UNION SELECT both_ways.b FROM reached JOIN both_ways ON both_ways.a = reached.url)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN url IN (SELECT url FROM reached) THEN 'block' ELSE 'allow' END) AS verdict FROM c
"""

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d), occ AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM occ GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n_source FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY 1, 2),
p AS (SELECT kept.lang, s.source, kept.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n_source + 5 * v.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (kept.total + 5)) // (v.total + 5 * v.v))::BIGINT AS q
  FROM kept JOIN s ON s.lang = kept.lang JOIN v ON v.lang = kept.lang LEFT JOIN c ON c.lang = kept.lang AND c.source = s.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""

NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, list_sum(list_transform(list_zip(a.v, e.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

NEAR_VECTORS = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
fit AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reached AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT reached.a, l.b FROM reached JOIN l ON l.a = reached.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept FROM e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

ORACLE_SQL = {
    "op4_quality_rules": QUALITY,
    "op5_url_filters": URLS,
    "url_redirects": REDIRECTS,
    "op7_benchmark_decontamination": CONTAMINATION,
    "op11_source_divergence": DIVERGENCE,
    "op12_hard_negatives": NEGATIVES,
    "op13_embedding_near_dedup": NEAR_VECTORS,
}
