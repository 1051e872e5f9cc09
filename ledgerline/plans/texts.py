"""Queries on texts: lines, sections, rules, tables, amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text as tx
from ..operators import holdings, report, validate
from ..operators.ranking import budgets
from ..rules import FOREIGN_NAMES, SECRETS, SECTION_ALIASES, authority_frame
from ..sources.folders import dealt
from ..sources.markup import with_markup_text
from .registry import query
from .tables import read

# Rule packs for these tables' languages; the operators' defaults are the ones of the reports.
VAGUE = ("(?i)\\bof the\\b.*\\bof the\\b", "nicht", "(^|\\s)pour(\\s|$)")
SPECULATIVE = ("\\bthis\\b", "\\baus\\b")
MARKERS = (("\\bthat the\\b", "one"), ("!!", "two"), ("%%%", "three"))
ALIASES = (("A", 0, "</h1>"), ("A", 1, "<p><b>"), ("B", 0, "<p>Of"), ("B", 1, "<p>The"))

SQL_LINES = """src AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]') AS l FROM documents WHERE text IS NOT NULL AND text <> ''),
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line, len(l) AS n FROM src),
doc_lines AS (SELECT doc_id, line_no, line FROM lines WHERE NOT (line_no = n AND line = ''))"""
SQL_TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.lines(documents(spark, sf_dir))


@query(f"WITH {SQL_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, md5(line) AS line_md5 FROM doc_lines")
def text_lines(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", "line_no", F.md5(F.col("line").cast("binary")).alias("line_md5"))


SQL_STRIPPED = "regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '[ \\t\\x{{A0}}\\x{{3000}}]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT page_id, md5({SQL_TRIM.format(SQL_STRIPPED.format('html'))}) AS stripped_md5 FROM pages")
def html_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(tx.strip_tags(F.col("html")).cast("binary")).alias("stripped_md5"))


@query("SELECT page_id, md5(left(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'), 4000)) AS excerpt_md5 FROM pages")
def html_excerpt(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(tx.excerpt(F.col("html")).cast("binary")).alias("excerpt_md5"))


# Pages as reports: each paragraph's end begins a section with a Roman number on a line of its own.
SQL_SECTIONED = """sectioned AS (SELECT page_id, replace(html, '</p>', chr(10) || 'IV. part' || chr(10)) AS t FROM pages)"""
SQL_BODY = """substr(t, strpos(t, {0}), CASE WHEN regexp_matches(substr(t, strpos(t, {0}) + length({0})), '\\n\\s*([IVX]+)\\.\\s+[^\\n]+\\n')
  THEN least(12000, length({0}) + strpos(substr(t, strpos(t, {0}) + length({0})), regexp_extract(substr(t, strpos(t, {0}) + length({0})), '\\n\\s*([IVX]+)\\.\\s+[^\\n]+\\n')) - 1) ELSE 12000 END)"""


def _sectioned(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("</p>"), F.lit("\nIV. part\n")).alias("text"))


@query(f"""WITH {SQL_SECTIONED} SELECT page_id, md5({SQL_BODY.format("'</h1>'")}) AS body_md5 FROM sectioned WHERE strpos(t, '</h1>') > 0""")
def section_slice(spark, sf_dir):
    body = tx.section_slice(F.col("text"), F.lit("</h1>"))
    return _sectioned(spark, sf_dir).select("page_id", F.md5(body.cast("binary")).alias("body_md5")).where("body_md5 is not null")


@query(f"""WITH {SQL_SECTIONED}, a AS (SELECT * FROM (VALUES ('A', 0, '</h1>'), ('A', 1, '<p><b>'), ('B', 0, '<p>Of'), ('B', 1, '<p>The')) AS v(section_key, alias_ord, alias)),
h AS (SELECT page_id, section_key, alias, t, row_number() OVER (PARTITION BY page_id, section_key ORDER BY alias_ord) AS nth FROM sectioned JOIN a ON contains(t, alias))
SELECT page_id, section_key, alias, md5({SQL_BODY.format("alias")}) AS body_md5 FROM h WHERE nth = 1""")
def first_alias_match(spark, sf_dir):
    aliases = [(section, [alias for s, _, alias in ALIASES if s == section]) for section in ("A", "B")]
    found = validate.sections_of(_sectioned(spark, sf_dir), aliases, "page_id")
    return found.select("page_id", "section_key", "alias", F.md5(F.col("body").cast("binary")).alias("body_md5"))


# The reports' own section headers: of each page one alias of one of the twelve keys stands before its first paragraph.
SQL_ALIASES = ", ".join(f"({i}, '{key}', {j}, '{alias}')" for i, (key, j, alias) in enumerate((k, j, a) for k, aliases in SECTION_ALIASES for j, a in enumerate(aliases)))
N_ALIASES = sum(len(aliases) for _, aliases in SECTION_ALIASES)


@query(f"""WITH a AS (SELECT * FROM (VALUES {SQL_ALIASES}) AS v(i, section_key, alias_ord, alias)), t AS (SELECT page_id, alias || chr(10) || html AS t FROM pages JOIN a ON page_id % {N_ALIASES} = i),
h AS (SELECT page_id, section_key, alias, t, row_number() OVER (PARTITION BY page_id, section_key ORDER BY alias_ord) AS nth FROM t JOIN a ON contains(t, alias))
SELECT page_id, section_key, alias, md5({SQL_BODY.format("alias")}) AS body_md5 FROM h WHERE nth = 1""")
def report_sections(spark, sf_dir):
    header = F.get(F.array(*(F.lit(alias) for _, aliases in SECTION_ALIASES for alias in aliases)), (F.col("page_id") % N_ALIASES).cast("int"))
    texts = read(spark, sf_dir, "pages").select("page_id", F.concat(header, F.lit("\n"), "html").alias("text"))
    return validate.sections_of(texts, key="page_id").select("page_id", "section_key", "alias", F.md5(F.col("body").cast("binary")).alias("body_md5"))


SQL_MARKDOWN = f"""{SQL_LINES}, md AS (SELECT doc_id, line_no, CASE line_no % 7 WHEN 1 THEN '## ' || left(line, 30) || ' #' WHEN 2 THEN '```' WHEN 4 THEN '```' WHEN 3 THEN '### inside' ELSE '### ' || left(line, 12) END AS line FROM doc_lines),
f AS (SELECT *, CAST(starts_with(line, '```') AS INTEGER) AS fence, sum(CAST(starts_with(line, '```') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS opened FROM md)"""


@query(f"""WITH {SQL_MARKDOWN} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, length(regexp_extract(line, '^(#{{2,3}})\\s+(.+)$', 1)) AS level,
{SQL_TRIM.format("regexp_replace(" + SQL_TRIM.format("regexp_extract(line, '^(#{2,3})\\s+(.+)$', 2)") + ", '#+$', '')")} AS title FROM f WHERE opened % 2 = 0 AND fence = 0 AND regexp_matches(line, '^(#{{2,3}})\\s+(.+)$')""")
def toc_lines(spark, sf_dir):
    k = F.col("line_no") % 7
    line = (
        F.when(k == 1, F.concat(F.lit("## "), F.left("line", F.lit(30)), F.lit(" #"))).when(k.isin(2, 4), F.lit("```")).when(k == 3, F.lit("### inside"))
        .otherwise(F.concat(F.lit("### "), F.left("line", F.lit(12))))
    )
    return tx.table_of_contents(doc_lines(spark, sf_dir).withColumn("line", line))


@query("""SELECT event_id, CAST(regexp_extract(props, '"k"\\s*:\\s*([0-9]+)', 1) AS BIGINT) AS k FROM events""")
def json_extract(spark, sf_dir):
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n``` done }"))).otherwise(F.concat(F.lit("so "), "props", F.lit(" it is")))
    block = tx.json_block(answer)
    return read(spark, sf_dir, "events").select("event_id", F.from_json(block, "k long").k.alias("k"))


@query("""WITH d AS (SELECT doc_id, source AS grp, doc_id AS ord, n_chars, least(n_chars, 3000) AS want FROM documents), b AS (SELECT *, least(want, greatest(1, 60000 // count(*) OVER (PARTITION BY grp))) AS base FROM d),
r AS (SELECT *, want - base AS room, 60000 - sum(base) OVER (PARTITION BY grp) - coalesce(sum(want - base) OVER (PARTITION BY grp ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM b)
SELECT doc_id, CAST(base + least(room, greatest(rest, 0)) AS BIGINT) AS budget FROM r""")
def budget_greedy(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("grp"), F.col("doc_id").alias("ord"), "n_chars")
    return budgets(docs, 3000, 60_000).select("doc_id", "budget")


@query(f"""WITH {SQL_LINES}, h AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)\\bof the\\b.*\\bof the\\b') THEN 0 WHEN regexp_matches(line, 'nicht') THEN 1 WHEN regexp_matches(line, '(^|\\s)pour(\\s|$)') THEN 2 END AS rule_ord FROM doc_lines)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, 'fail' AS severity, 'vague_source' AS category, rule_ord FROM h WHERE rule_ord IS NOT NULL""")
def style_rule_hits(spark, sf_dir):
    return validate.style_hits(doc_lines(spark, sf_dir), VAGUE).drop("snippet")


@query(f"""WITH {SQL_LINES}, h AS (SELECT *, CASE WHEN regexp_matches(line, '\\bthis\\b') THEN 0 WHEN regexp_matches(line, '\\baus\\b') THEN 1 END AS rule_ord,
concat_ws(' ', line, lag(line) OVER w, lead(line) OVER w) AS near FROM doc_lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, 'fail' AS severity, 'missing_inference_marker' AS category, rule_ord FROM h WHERE rule_ord IS NOT NULL AND NOT contains(near, 'with')""")
def speculation_without_marker(spark, sf_dir):
    return validate.unmarked_speculation(doc_lines(spark, sf_dir), SPECULATIVE, "with").drop("snippet")


@query("""WITH m AS (SELECT * FROM (VALUES (0, '\\bthat the\\b', 'one'), (1, '!!', 'two'), (2, '%%%', 'three')) AS v(rule_ord, pattern, message)) SELECT doc_id, rule_ord, message FROM documents JOIN m ON regexp_matches(text, pattern)""")
def failure_markers(spark, sf_dir):
    return validate.failure_markers(documents(spark, sf_dir), MARKERS)


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '\\bthat the\\b|!!|%%%')")
def usable_texts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.where("text is not null").join(validate.failure_markers(docs, MARKERS), "doc_id", "left_anti").select("doc_id")


# Texts of which every fourth lacks the glossary, the analogy, both or neither, and every second the data box.
SQL_META = "meta AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '이번 회 등장 용어' WHEN 2 THEN chr(10) || '비유: 마치 강과 같다' ELSE chr(10) || '이번 등장 용어' || chr(10) || '강에 가깝다' || chr(10) || '데이터 기준시점' END AS t FROM documents)"


def _with_meta(spark, sf_dir):
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, "").when(k == 1, "\n이번 회 등장 용어").when(k == 2, "\n비유: 마치 강과 같다").otherwise("\n이번 등장 용어\n강에 가깝다\n데이터 기준시점")
    return documents(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))


@query(f"""WITH {SQL_META} SELECT doc_id, 0 AS line_no, 'warn' AS severity, 'missing_glossary_meta' AS category FROM meta WHERE NOT regexp_matches(t, '이번\\s*(회\\s*)?등장\\s*용어')
UNION ALL SELECT doc_id, 0, 'warn', 'missing_analogy' FROM meta WHERE NOT regexp_matches(t, '비유[:\\s]|마치\\s+.+\\s+같|닮았|에\\s*가깝다')""")
def missing_meta(spark, sf_dir):
    return validate.document_checks(_with_meta(spark, sf_dir), assembled=False)


@query(f"WITH {SQL_META} SELECT doc_id, 0 AS line_no, 'fail' AS severity, 'missing_timestamp_box' AS category FROM meta WHERE NOT regexp_matches(t, '데이터\\s*기준시점')")
def missing_box(spark, sf_dir):
    return validate.document_checks(_with_meta(spark, sf_dir), assembled=True)


_SQL_SECRETS = " UNION ALL ".join(
    f"""SELECT doc_id, line_no, '{label}' AS label, len(regexp_extract_all(line, '{pattern.replace(chr(39), chr(39) * 2)}')) AS n FROM shown""" for label, pattern in SECRETS
)
SQL_SECRETS = f"""{SQL_LINES}, shown AS (SELECT * FROM doc_lines WHERE NOT contains(upper(line), 'EXAMPLE') AND NOT contains(line, 'PUT_YOUR') AND NOT contains(line, 'REPLACE_WITH')), held AS ({_SQL_SECRETS})"""


@query(f"WITH {SQL_SECRETS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, label, n FROM held WHERE n > 0 AND label = '{SECRETS[0][0]}'")
def secret_scan(spark, sf_dir):
    found = validate.secrets(doc_lines(spark, sf_dir), SECRETS[:1])
    return found.groupBy("doc_id", "line_no", "label").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_SECRETS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, label, CAST(unnest(range(n)) AS INTEGER) AS nth FROM held WHERE n > 0")
def secret_scan_all(spark, sf_dir):
    return validate.secrets(doc_lines(spark, sf_dir)).select("doc_id", "line_no", "label", "nth")


FACTS = {"market_cap": 1.2041e15, "revenue": 9.7146675e13, "interim_q_operating_income": 3.761e13}


# Each order as a text that cites two facts, off by how much its key says.
SQL_CITED = "cited AS (SELECT o_orderkey AS doc_id, CAST(CAST(1000 + o_orderkey % 400 AS VARCHAR) || '.' || CAST(o_orderkey % 10 AS VARCHAR) AS DOUBLE) * 1e12 AS cap, CAST(CAST(o_orderkey % 90 AS VARCHAR) || '.5' AS DOUBLE) * 1e12 AS income FROM orders)"


@query(f"""WITH {SQL_CITED} SELECT doc_id, 1 AS line_no, 'market_cap' AS fact_key, cap AS found FROM cited WHERE abs(cap - 1.2041e15::DOUBLE) > 1.2041e15::DOUBLE * 0.05::DOUBLE
UNION ALL SELECT doc_id, 2, 'interim_q_operating_income', income FROM cited WHERE abs(income - 3.761e13::DOUBLE) > 3.761e13::DOUBLE * 0.05::DOUBLE""")
def authoritative_consistency(spark, sf_dir):
    facts = authority_frame(spark, FACTS)
    text = F.format_string("보고서의 시가총액 %d.%d조원\n1Q26 영업이익 %d.5조원", 1000 + F.col("o_orderkey") % 400, F.col("o_orderkey") % 10, F.col("o_orderkey") % 90)
    texts = dealt(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("doc_id")), "doc_id").select("doc_id", text.alias("text"))
    return validate.consistency(tx.lines(texts), facts).select("doc_id", "line_no", "fact_key", "found")


# Each order as a table: its lines' quantities, also as shares, and for two of three orders a total, right for one of four.
SQL_TABLES = """items AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' ') AS row_ord FROM lineitem),
sums AS (SELECT doc_id, count(*) AS details, sum(q) AS s, doc_id % 3 <> 0 AS has_total, sum(q) + doc_id % 4 AS total FROM items GROUP BY doc_id)"""


def _tables(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    body = report.joined(F.format_string("| L%d | %d | %d%% |", "l_linenumber", "q", "q"), [F.col("l_linenumber")])
    out = rows.groupBy("doc_id").agg(body.alias("body"), F.sum("q").alias("s"))  # an order has seven lines at most
    total = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.format_string("\n| 합계 | %d | 100%% |", F.col("s") + F.col("doc_id") % 4))
    return out.select("doc_id", F.concat(F.lit("| 구분 | 매출 | 비중 |\n|---|---|---|\n"), "body", total, F.lit("\n끝")).alias("text"))


@query(f"""WITH {SQL_TABLES} SELECT doc_id, 1 AS table_line, 1 AS col_ord, 'table_sum_mismatch' AS category, CAST(s AS DOUBLE) AS actual, CAST(total AS DOUBLE) AS expected FROM sums WHERE details >= 2 AND has_total AND abs(s - total) > greatest(0.02 * total, 0.5)
UNION ALL SELECT doc_id, 1, 2, 'table_sum_mismatch', CAST(s AS DOUBLE), CAST(100 AS DOUBLE) FROM sums WHERE details >= 2 AND has_total AND abs(s - 100) > 3
UNION ALL SELECT doc_id, 1, 2, 'percentage_sum_off', CAST(s AS DOUBLE), NULL FROM sums WHERE details >= 3 AND NOT has_total AND (s < 95 OR s > 105)""")
def table_arithmetic(spark, sf_dir):
    return validate.table_arithmetic(validate.tables_of(_tables(spark, sf_dir)))


@query(f"""WITH {SQL_TABLES} SELECT doc_id, 1 AS table_line, 0 AS row_ord, c AS col_ord, CASE c WHEN 0 THEN '구분' WHEN 1 THEN '매출' ELSE '비중' END AS cell FROM sums CROSS JOIN (VALUES (0), (1), (2)) AS v(c)
UNION ALL SELECT doc_id, 1, CAST(row_ord AS INTEGER), c, CASE c WHEN 0 THEN 'L' || n WHEN 1 THEN CAST(q AS VARCHAR) ELSE q || '%' END FROM items CROSS JOIN (VALUES (0), (1), (2)) AS v(c)
UNION ALL SELECT doc_id, 1, CAST(details + 1 AS INTEGER), c, CASE c WHEN 0 THEN '합계' WHEN 1 THEN CAST(total AS VARCHAR) ELSE '100%' END FROM sums CROSS JOIN (VALUES (0), (1), (2)) AS v(c) WHERE has_total""")
def md_table_parse(spark, sf_dir):
    return validate.tables_of(_tables(spark, sf_dir)).select("doc_id", "table_line", "row_ord", "col_ord", "cell")


# Every fourth text asserts what it calls unconfirmed elsewhere; in the others one of the two places is missing, about the
# future or marked as inference.
SQL_CROSS = """crossed AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'capex 확인되지 않음' || chr(10) || 'Capex 3.4조원' WHEN 1 THEN chr(10) || '배당금 확인되지 않음' WHEN 2 THEN chr(10) || 'capex 확인되지 않음 (예정)' || chr(10) || 'capex 3.4조원' ELSE chr(10) || 'WACC 확인되지 않음' || chr(10) || 'WACC 3.4조원 (추론)' END AS t FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, word, unnest(string_split(t, chr(10))) AS line FROM crossed CROSS JOIN (VALUES ('capex'), ('배당금'), ('WACC')) AS v(word)),
kinds AS (SELECT doc_id, word, CASE WHEN contains(line, '추론') THEN 'none' WHEN regexp_matches(line, '확인되지\\s*않음') THEN CASE WHEN regexp_matches(line, '예정') THEN 'none' ELSE 'unknown' END WHEN regexp_matches(line, '[\\d.,]+\\s*(조|억)\\s*원?') THEN 'asserted' ELSE 'none' END AS kind FROM placed WHERE contains(lower(line), lower(word)))"""


@query(f"WITH {SQL_CROSS} SELECT doc_id, word FROM kinds GROUP BY 1, 2 HAVING bool_or(kind = 'unknown') AND bool_or(kind = 'asserted')")
def unknown_vs_asserted(spark, sf_dir):
    k = F.col("doc_id") % 4
    tail = (
        F.when(k == 0, "\ncapex 확인되지 않음\nCapex 3.4조원").when(k == 1, "\n배당금 확인되지 않음").when(k == 2, "\ncapex 확인되지 않음 (예정)\ncapex 3.4조원")
        .otherwise("\nWACC 확인되지 않음\nWACC 3.4조원 (추론)")
    )
    return validate.unknown_and_asserted(documents(spark, sf_dir).withColumn("text", F.concat("text", tail)))


# Markup cut into its pieces: comments, raw elements, tags, declarations and what stands between.
SQL_PIECES = """pieces AS (SELECT page_id, html, regexp_extract_all(html, '(?is)<!--.*?(?:-->|\\z)|<script\\b[^<>]*>.*?(?:</script\\s*>|\\z)|<style\\b[^<>]*>.*?(?:</style\\s*>|\\z)|</?[a-z](?:[^<>"'']|"[^"<]*"|''[^''<]*'')*>|<[!?/a-z][^<>]*>|<|[^<]+') AS p FROM pages)"""
SQL_PIECE_TEXT = """CASE WHEN starts_with(x, '<!') OR starts_with(x, '<?') THEN '' WHEN regexp_matches(x, '(?is)^<(script|style)\\b') THEN regexp_replace(regexp_replace(x, '(?is)^<[^<>]*>', ''), '(?is)</(script|style)\\s*>$', '')
WHEN regexp_matches(x, '(?is)^<(td|th|tu)(\\s|/|>)') THEN '|' WHEN regexp_matches(x, '(?is)^</?[a-z].*>$') THEN ''
ELSE regexp_replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp$', '&') END"""
SQL_SPACE = "'(?s)[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'"


@query(f"""WITH {SQL_PIECES}, told AS (SELECT page_id, html, list_transform(p, lambda x: CASE WHEN regexp_matches(x, '(?is)^(</?(br|p|table|tr|section|title)|</(td|th|tu))(\\s|/|>)') THEN chr(10)
  ELSE regexp_replace({SQL_PIECE_TEXT}, {SQL_SPACE}, ' ', 'g') END) AS q FROM pieces),
lines AS (SELECT page_id, html, list_filter(list_transform(string_split(array_to_string(q, ' '), chr(10)), lambda l: trim(regexp_replace(l, ' +', ' ', 'g'))), lambda l: l <> '') AS l FROM told)
SELECT page_id, CASE WHEN html IS NULL THEN NULL WHEN len(l) = 0 THEN html ELSE array_to_string(l, chr(10)) END AS markup_text FROM lines""")
def markup_to_text(spark, sf_dir):
    return with_markup_text(read(spark, sf_dir, "pages").select("page_id", "html"), "html").select("page_id", "markup_text")


@query("""SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN s_suppkey * 1000 + 7 WHEN 6 THEN s_suppkey END AS as_int,
CASE s_suppkey % 8 WHEN 0 THEN CAST(s_suppkey * 1000 + 7 AS DOUBLE) WHEN 2 THEN -(s_suppkey + 0.5::DOUBLE) WHEN 4 THEN -CAST(s_suppkey || '.11' AS DOUBLE) WHEN 3 THEN CAST(s_suppkey AS DOUBLE) WHEN 6 THEN CAST(s_suppkey AS DOUBLE) WHEN 7 THEN CAST(s_suppkey AS DOUBLE) END AS as_cell FROM supplier""")
def parsed_numbers(spark, sf_dir):
    key = F.col("s_suppkey")
    text, k = key.cast("string"), key % 8
    raw = (
        F.when(k == 0, F.format_number(key * 1000 + 7, 0)).when(k == 1, "x").when(k == 2, F.concat(F.lit("△"), text, F.lit(".5"))).when(k == 3, F.concat(F.lit("▲ "), text))
        .when(k == 4, F.concat(F.lit("-"), text, F.lit(".11%"))).when(k == 5, "—").when(k == 6, F.concat(F.lit(" "), text, F.lit(" "))).otherwise(F.concat(F.lit("**"), text, F.lit("**")))
    )
    return read(spark, sf_dir, "supplier").select("s_suppkey", num.to_int(raw).alias("as_int"), num.cell_number(raw).alias("as_cell"))


_FOREIGN = "|".join(n.replace(".", "\\.") for n in FOREIGN_NAMES)


@query(f"""WITH n AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '국민' || c_custkey WHEN 1 THEN c_name WHEN 2 THEN '' WHEN 3 THEN CAST(c_custkey AS VARCHAR) WHEN 4 THEN '가 ' || c_custkey || ' Inc' WHEN 5 THEN c_name || ' BlackRock' END AS name FROM customer)
SELECT c_custkey, CASE WHEN trim(coalesce(name, '')) = '' THEN 'UNKNOWN' WHEN regexp_matches(name, '{_FOREIGN}') THEN 'FOREIGN' WHEN regexp_matches(name, '[가-힯]') THEN 'KR' WHEN regexp_matches(name, '[A-Za-z]') THEN 'FOREIGN' ELSE 'UNKNOWN' END AS nationality FROM n""")
def holder_nationality(spark, sf_dir):
    key, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 7
    name = (
        F.when(k == 0, F.concat(F.lit("국민"), key)).when(k == 1, F.col("c_name")).when(k == 2, "").when(k == 3, key).when(k == 4, F.concat(F.lit("가 "), key, F.lit(" Inc")))
        .when(k == 5, F.concat("c_name", F.lit(" BlackRock")))
    )
    return read(spark, sf_dir, "customer").select("c_custkey", holdings.nationality(name).alias("nationality"))


@query("SELECT section, attempt, passed, NOT passed AS best_effort FROM (SELECT user_id AS section, event_id AS attempt, value > 90 AS passed, row_number() OVER (PARTITION BY user_id ORDER BY (value > 90) DESC, CASE WHEN value > 90 THEN event_id ELSE -event_id END) AS nth FROM events) WHERE nth = 1")
def chosen_attempts(spark, sf_dir):
    attempts = read(spark, sf_dir, "events").select(F.col("user_id").alias("section"), F.col("event_id").alias("attempt"), (F.col("value") > 90).alias("passed"))
    return validate.chosen_attempt(attempts)


@query("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS loaded_chars, sum(length(text)) >= 300 AS passed FROM conversations GROUP BY conv_id")
def input_guard(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    filings = turns.select("conv_id", F.char_length("text").alias("loaded_chars"))
    guarded = validate.input_guard(filings, turns.select("conv_id"), "conv_id", least_chars=300, least_facts=1)
    return guarded.select("conv_id", F.col("facts").alias("turns"), F.col("loaded_chars").cast("long").alias("loaded_chars"), "passed")


