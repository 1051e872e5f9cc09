"""The queries of this subpackage, on the driver tables."""

from __future__ import annotations

from .fill_in_middle import op11_fill_in_middle
from .html_extraction import op9_html_extraction
from .jaccard_join import op5_jaccard_join
from .line_dedup import op12_line_dedup
from .media_columns import op4_media_columns
from .mixing import op7_mixing
from .nearest import op10_nearest
from .packing import op3_packing
from .periodic_runs import op13_periodic_runs
from .quality import op6_quality
from .substring_dedup import op1_substring_dedup
from .token_counts import op2_token_counts
from .url_filter import op8_url_filter

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_token_counts, op3_packing, op4_media_columns, op5_jaccard_join, op6_quality, op7_mixing, op8_url_filter, op9_html_extraction, op10_nearest, op11_fill_in_middle, op12_line_dedup, op13_periodic_runs)}

WORDS = "w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS a FROM documents)"
ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""WITH {WORDS},
k AS (SELECT doc_id, i, md5(array_to_string(a[i:i + 49], ' ')) AS h FROM (SELECT doc_id, a, unnest(range(1, len(a) - 48)) AS i FROM w WHERE len(a) >= 50)),
d AS (SELECT k.doc_id, k.i FROM k JOIN (SELECT h, min(doc_id) AS lo FROM k GROUP BY h) m ON k.h = m.h WHERE m.lo < k.doc_id),
g AS (SELECT DISTINCT doc_id, i + o AS p FROM d CROSS JOIN range(0, 50) AS r(o)),
x AS (SELECT doc_id, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS p FROM w),
y AS (SELECT x.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN y ON w.doc_id = y.doc_id""",
    "op5_jaccard_join": f"""WITH RECURSIVE {WORDS},
s AS (SELECT DISTINCT doc_id, md5(array_to_string(a[i:i + 4], ' ')) AS h FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 3, 2))) AS i FROM w WHERE len(a) > 0)),
n AS (SELECT doc_id, count(*) AS size, md5(string_agg(h, '' ORDER BY h)) AS set_id FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b, na.set_id AS set_a, nb.set_id AS set_b FROM p JOIN n na ON p.a = na.doc_id JOIN n nb ON p.b = nb.doc_id WHERE 9 * common >= 4 * (na.size + nb.size)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, count(*) AS n_links, count(DISTINCT CASE WHEN set_a <> set_b THEN set_b END) AS n_texts FROM l GROUP BY a)
SELECT r.doc_id, r.class_id, coalesce(n_links, 0) AS n_links, coalesce(n_texts, 0) AS n_texts FROM (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a) r LEFT JOIN c ON r.doc_id = c.a""",
    "op7_mixing": """WITH d AS (SELECT doc_id, coalesce('=' || source, '~') AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(concat_ws(':', '0', CAST(doc_id AS VARCHAR), md5(text))) AS h FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY k) - 1 AS nth FROM d GROUP BY k),
w AS (SELECT *, CASE nth % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CAST(2 * source_size AS DOUBLE) AS most FROM s),
f AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w WINDOW b AS (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size, least(most, weight * (SELECT level FROM f WHERE level * weight <= most ORDER BY most / weight, nth LIMIT 1)) AS target FROM f),
p AS (SELECT d.doc_id, d.k, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.k ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM d JOIN t ON d.k = t.k),
g AS (SELECT k, words, CAST(ceil(CAST(words AS DOUBLE) / CAST(sum(words) OVER () AS DOUBLE) * 65536) AS BIGINT) + least(greatest(words, 16), 64) AS part FROM (SELECT k, CAST(round(target) AS BIGINT) AS words FROM t) WHERE words > 0),
h AS (SELECT k, words, CAST(sum(part) OVER () AS BIGINT) AS n, CAST(coalesce(sum(part) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS low, part FROM g),
i AS (SELECT slot, (slot * CAST(0.6180339887498949 AS DOUBLE)) % CAST(1 AS DOUBLE) AS point FROM (SELECT unnest(range((SELECT max(n) FROM h))) AS slot)),
s2 AS (SELECT k, words, slot, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank, count(*) OVER (PARTITION BY k) AS n_slots FROM i JOIN h ON point >= CAST(low AS DOUBLE) / n AND point < CAST(low + part AS DOUBLE) / n),
n AS (SELECT DISTINCT k, n_slots FROM s2)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(b + size, p.words) - b) + greatest(0, least(b + source_size + size, p.words) - b - source_size) AS BIGINT) AS taken, s2.slot AS first_slot
FROM p LEFT JOIN n ON p.k = n.k LEFT JOIN s2 ON s2.k = p.k AND p.size > 0 AND p.b < p.words AND s2.rank = ((p.b + 1) * n.n_slots - 1) // p.words""",
    "op11_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', doc_id)) AS s FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS a, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(a) AS BIGINT) AS n, least(h1 % (len(a) + 1), h2 % (len(a) + 1)) AS lo, greatest(h1 % (len(a) + 1), h2 % (len(a) + 1)) AS hi,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(a[1:lo], ''), '') AS prefix, coalesce(array_to_string(a[lo + 1:hi], ''), '') AS middle, coalesce(array_to_string(a[hi + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op12_line_dedup": """WITH l AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS lo FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (SELECT k.doc_id, k.i, k.line, coalesce(m.lo < k.doc_id, false) AS gone FROM k LEFT JOIN m ON k.key = m.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id""",
}
