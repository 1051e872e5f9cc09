"""Queries on texts and files that are written from the driver's tables and read back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines
from ..operators import products, report, triggers, validate
from ..rules import authority_frame
from ..sources import answers, markup, sinks, tables
from ..sources.folders import dealt, shared_folder, write_once
from . import market
from .registry import query
from .tables import bars, filings, flows, read, watchlist

def _key() -> Column:
    return F.col("o_orderkey")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _amount_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a text of two lines: sales, and by its key a loss, a market cap, two amounts marked as inference, or
    a sum in two units."""
    sales = _text("매출 ", 1 + _key() % 500, ".", _key() % 10, "조원\n")
    other = (
        F.when(_key() % 4 == 0, _text("DS 적자 △", _key() % 900, "억원")).when(_key() % 4 == 1, _text("시가총액 ", _key() % 900, "조원 (KRX 종가)"))
        .when(_key() % 4 == 2, _text("자사주 매입 1,", F.lpad((_key() % 1000).cast("string"), 3, "0"), "억원 그리고 ", _key() % 7, ".5조 *(추론 — 어림)*")).otherwise(_text("연결 ", 1 + _key() % 99, "조 1,467억원"))
    )
    return read(spark, sf_dir, "orders").select(_key().alias("doc_id"), F.concat(sales, other).alias("text"))


SQL_DECIMAL = "CAST({0} || '.' || {1} AS DOUBLE)"


@query(f"""WITH k AS (SELECT o_orderkey AS k FROM orders), c AS (
  SELECT k, 1 AS line_no, {SQL_DECIMAL.format("(1 + k % 500)", "(k % 10)")} * 1e12 AS claim, false AS inferred FROM k
  UNION ALL SELECT k, 2, -CAST(k % 900 AS DOUBLE) * 1e8, false FROM k WHERE k % 4 = 0
  UNION ALL SELECT k, 2, CAST(1000 + k % 1000 AS DOUBLE) * 1e8, true FROM k WHERE k % 4 = 2 UNION ALL SELECT k, 2, {SQL_DECIMAL.format("(k % 7)", "5")} * 1e12, true FROM k WHERE k % 4 = 2
  UNION ALL SELECT k, 2, CAST(1 + k % 99 AS DOUBLE) * 1e12, false FROM k WHERE k % 4 = 3 UNION ALL SELECT k, 2, CAST(1467 AS DOUBLE) * 1e8, false FROM k WHERE k % 4 = 3)
SELECT k AS doc_id, line_no, claim, inferred AS is_in_inference FROM c WHERE abs(claim) >= 1e10""")
def numeric_claims(spark, sf_dir):
    return validate.numeric_claims(lines(_amount_texts(spark, sf_dir))).select("doc_id", "line_no", "claim", "is_in_inference")


@query("""SELECT c_custkey, '{"corp":"' || c_custkey || '"' || CASE WHEN c_acctbal >= 0 THEN ',"sector":"' || c_mktsegment || '"' ELSE '' END || ',"nation":' || c_nationkey || '}' AS envelope,
CASE WHEN c_acctbal >= 0 THEN 'GET list.json?key=***&corp=' || c_custkey ELSE 'GET list.json?key=k' || c_name || '&corp=' || c_custkey END AS redacted,
'> **데이터 기준시점**' || chr(10) || '> - corp ' || c_custkey || CASE WHEN c_acctbal >= 0 THEN chr(10) || '> - sector ' || c_mktsegment ELSE '' END AS provenance, CAST(trunc((c_custkey % 300) * CAST(1.6 AS DOUBLE)) AS INTEGER) + 5 AS days FROM customer""")
def envelopes(spark, sf_dir):
    known, corp, secret = F.col("c_acctbal") >= 0, F.col("c_custkey").cast("string"), F.concat(F.lit("k"), "c_name")
    sector = F.when(known, F.col("c_mktsegment"))
    address = F.concat(F.lit("GET list.json?key="), secret, F.lit("&corp="), corp)
    box = report.provenance(F.concat(F.lit("corp "), corp), F.concat(F.lit("sector "), sector))
    return read(spark, sf_dir, "customer").select(
        "c_custkey", report.envelope(corp=corp, sector=sector, nation=F.col("c_nationkey")).alias("envelope"), report.redacted(address, F.when(known, secret)).alias("redacted"), box.alias("provenance"),
        calendar_days_of(F.col("c_custkey") % 300).alias("days"),
    )


def calendar_days_of(business_days: Column) -> Column:
    from ..functions.dates import calendar_days

    return F.element_at(F.array(*(F.lit(calendar_days(n)) for n in range(300))), (business_days + 1).cast("int"))


# A customer's orders as attempts at a section: speculation, the right amount, ten times too little, hearsay, a table whose
# sum is off or right, and amounts near the fact.
SQL_ATTEMPTS = """attempts AS (SELECT o_custkey AS section, o_orderkey AS attempt, CASE o_orderkey % 7 WHEN 1 THEN true WHEN 4 THEN (o_orderkey // 7) % 2 = 0 WHEN 5 THEN abs(90 + (o_orderkey // 7) % 14 - 97) <= 0.97 ELSE false END AS passed FROM orders WHERE o_orderkey % 7 <> 6)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seventh = F.expr("o_orderkey div 7")
    table = F.concat(F.lit("| a | 매출 |\n|---|---|\n| x | 1 |\n| y | 2 |\n| 합계 | "), F.when(seventh % 2 == 0, "3").otherwise("9"), F.lit(" |"))
    text = (
        F.when(_key() % 7 == 0, "매출이 늘 것으로 예상된다").when(_key() % 7 == 1, "연결 매출 97조원").when(_key() % 7 == 2, "매출 9.7조원").when(_key() % 7 == 3, "업계 관계자 말").when(_key() % 7 == 4, table)
        .when(_key() % 7 == 5, _text("연결 매출 ", 90 + seventh % 14, "조원"))
    )
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("section"), _key().alias("attempt"), text.alias("text")).where("text is not null")


@query(f"""WITH {SQL_ATTEMPTS} SELECT section, attempt, passed, NOT passed AS best_effort FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY passed DESC, CASE WHEN passed THEN attempt ELSE -attempt END) AS nth FROM attempts) WHERE nth = 1""")
def accepted_sections(spark, sf_dir):
    """The retry loop over whole tables: all validators judge every attempt, the first that passes is accepted."""
    facts = spark.createDataFrame([(97e12,)], "fact double")
    found = products.accepted_sections(_attempts(spark, sf_dir), facts, authority_frame(spark, {"revenue": 97e12}))
    return found.select("section", "attempt", "passed", "best_effort")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'OFS' ELSE 'CFS' END AS fs_div, o_orderkey % 11 = 5 AS refused FROM orders)
SELECT o_custkey AS corp_code, o_orderkey AS request, l_partkey AS account_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE fs_div = 'CFS' AND NOT refused""")
def consolidated_statements(spark, sf_dir):
    """Statements as the service answers them, an order each: of the consolidated ones that weren't refused, the items."""
    order = F.struct(F.col("l_linenumber").alias("n"), F.struct(F.col("l_partkey").cast("string").alias("account_id"), F.format_number(F.round(F.col("l_extendedprice") * 100), 0).alias("thstrm_amount")).alias("item"))
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["item"]).alias("list"))
    refused = F.to_json(F.struct(F.lit("013").alias("status"), F.lit("none").alias("message")))
    text = F.when(_key() % 11 == 5, refused).otherwise(F.to_json(F.struct(F.lit("000").alias("status"), "list")))
    asked = read(spark, sf_dir, "orders").join(items, "o_orderkey").select(F.col("o_custkey").alias("corp_code"), _key().alias("request"), F.when(_key() % 3 == 0, "OFS").otherwise("CFS").alias("fs_div"), text.alias("text"))
    found, _ = answers.statements(asked, "CFS")
    return found.select("corp_code", "request", F.col("account_id").cast("long").alias("account_id"), F.replace("thstrm_amount", F.lit(","), F.lit("")).cast("long").alias("amount"))


_SECTIONS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(report.SECTIONS))


@query(f"""WITH s AS (SELECT * FROM (VALUES {_SECTIONS}) AS v(i, section_id)), r AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id AS doc_id, section_id FROM r CROSS JOIN s
WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = r.conv_id AND c.turn = s.i AND c.text IS NOT NULL)""")
def incomplete_reports(spark, sf_dir):
    """The sections for want of which reports can't be assembled."""
    turns = read(spark, sf_dir, "conversations")
    ids = F.array(*map(F.lit, report.SECTIONS))
    usable = turns.where("turn < 10 and text is not null").select(F.col("conv_id").alias("doc_id"), F.get(ids, F.col("turn").cast("int")).alias("section_id")).distinct()
    return report.incomplete(turns.select(F.col("conv_id").alias("doc_id")).distinct(), usable)


@query("""SELECT '| sector | orders | cents |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || sector || ' | ' || n || ' | ' || coalesce(CAST(cents AS VARCHAR), '—') || ' |', chr(10) ORDER BY sector) AS "table" FROM (
SELECT o_orderpriority AS sector, count(*) AS n, CAST(sum(CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) * 100 AS BIGINT) AS cents FROM orders GROUP BY 1)""")
def industry_note_table(spark, sf_dir):
    cents = (F.sum(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice").cast("decimal(18,2)"))) * 100).cast("long")
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("sector")).agg(F.count("*").alias("orders"), cents.alias("cents"))
    return report.markdown_table(rows, ["sector", "orders", "cents"], [F.col("sector")])


# Line items as scraped pages of ten rows: one date, numbers with commas, a sign and a percent; every fifth row is too short.
SQL_SCRAPED = "scraped AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey % 90000 AS close, l_suppkey AS volume, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * (l_partkey % 700) AS shares, l_partkey % 5 = 4 AS short FROM lineitem)"


@query(f"WITH {SQL_SCRAPED} SELECT l_orderkey AS ticker, CAST(l_linenumber AS BIGINT) AS page, CAST(l_shipdate AS DATE) AS dt, CAST(close AS BIGINT) AS close, CAST(volume AS BIGINT) AS volume, CAST(close * shares AS BIGINT) AS net_krw FROM scraped WHERE NOT short")
def scraped_pages(spark, sf_dir):
    part = F.col("l_partkey")
    shares = F.concat(F.when(F.col("l_returnflag") == "R", "-").otherwise("+"), F.format_number(part % 700, 0))
    cells = [F.date_format("l_shipdate", "yyyy.MM.dd"), F.format_number(part % 90000, 0), F.lit("x"), F.lit("+1.5%"), F.format_number("l_suppkey", 0), F.lit("0"), shares, F.lit("500"), F.lit("49.40%")]
    row = F.when(part % 5 == 4, F.lit("<td>short</td>")).otherwise(F.concat(*(F.concat(F.lit("<td> "), c, F.lit(" </td>")) for c in cells)))
    html = F.concat(F.lit('<table><tr><td>no</td></tr></table><table class="type2 x"><tr>'), row, F.lit("</tr></table>"))
    items = dealt(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_returnflag"))
    pages = items.select(F.col("l_orderkey").cast("string").alias("ticker"), F.col("l_linenumber").alias("page"), html.alias("html"))
    found = markup.scraped_flows(pages)
    return found.select(F.col("ticker").cast("long").alias("ticker"), "page", "dt", F.col("close").cast("long").alias("close"), F.col("volume").cast("long").alias("volume"), F.col("net_krw").cast("long").alias("net_krw"))


def _in_files(texts: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Writes a file for each row (key, text) and reads all back whole: key and text."""
    spark = texts.sparkSession
    folder = shared_folder(spark, name)
    sinks.write_files(texts.select(F.concat(F.col("key").cast("string"), F.lit(".md")).alias("name"), "text"), folder)
    found = tables.whole_texts(spark, folder)
    return folder, found.withColumn("key", F.regexp_extract("path", "/([0-9]+)[.]md$", 1).cast("long"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's items as a watchlist in Markdown, some without a corp code."""
    item = F.concat_ws(" | ", F.lit(""), F.col("nth").cast("string"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 3 == 0, "TBD").otherwise(F.col("l_orderkey").cast("string")), "l_returnflag", F.lit("note |"))
    rows = read(spark, sf_dir, "lineitem").withColumn("nth", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    body = rows.groupBy(F.col("l_suppkey").alias("key")).agg(report.joined(F.ltrim(item), [F.col("nth"), F.col("l_partkey").cast("string"), F.col("l_returnflag")]).alias("body"))
    return body.select("key", F.concat(F.lit("# title\n\n| # | 종목 | 코드 | corp | 섹터 | 메모 |\n|---|---|---|---|---|---|\n"), "body", F.lit("\n\n| 9 | after | the | table | is | over |\n")).alias("text"))


@query("""SELECT l_suppkey AS "key", CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, CAST(l_partkey AS VARCHAR), l_returnflag) - 1 AS INTEGER) AS ord, 'part ' || l_partkey AS name, CAST(l_partkey AS VARCHAR) AS ticker, CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS corp_code, l_returnflag AS sector FROM lineitem""")
def watchlist_files(spark, sf_dir):
    _, texts = _in_files(_listed(spark, sf_dir), "watchlists")
    return tables.watchlist(texts, "key").select("key", "ord", "name", "ticker", "corp_code", "sector")


@query("""SELECT l_suppkey AS "key", 'items of ' || l_suppkey AS headline, '> **트리거**: ' || count(*) || '건' AS trigger_line, count(*) AS cards FROM lineitem GROUP BY l_suppkey""")
def note_header_files(spark, sf_dir):
    card = F.concat(F.lit("### "), F.col("l_partkey").cast("string"), F.lit("\n\ntext"))
    notes = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.count("*").alias("n"), report.joined(card, [F.col("l_orderkey"), F.col("l_linenumber")]).alias("body"))
    text = F.concat(F.lit("# items of "), F.col("key").cast("string"), F.lit("\n\n> **트리거**: "), F.col("n").cast("string"), F.lit("건\n\n"), "body")
    _, texts = _in_files(notes.select("key", text.alias("text")), "notes")
    return tables.note_headers(texts, "key").select("key", "headline", "trigger_line", "cards")


@query("""WITH f AS (SELECT l_suppkey, l_linestatus, CASE l_linenumber WHEN 1 THEN '00_종합.md' WHEN 2 THEN '01_a.md' WHEN 3 THEN '01_a_warnings.md' ELSE '07_b.md' END AS name FROM lineitem),
r AS (SELECT DISTINCT l_suppkey, l_linestatus, name, CASE WHEN name LIKE '00%' THEN 0 ELSE 1 END AS rank FROM f WHERE name IN ('00_종합.md', '01_a.md'))
SELECT CAST(l_suppkey AS VARCHAR) AS company, l_linestatus AS period, name, rank = 1 AS partial FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linestatus ORDER BY rank) AS nth FROM r) WHERE nth = 1""")
def report_discovery(spark, sf_dir):
    """Reports of each company and period among the names of its files."""
    names = F.get(F.array(*map(F.lit, ("00_종합.md", "01_a.md", "01_a_warnings.md", "07_b.md"))), F.least(F.col("l_linenumber") - 1, F.lit(3)).cast("int"))
    files = read(spark, sf_dir, "lineitem").select(F.concat_ws("/", F.lit("companies"), F.col("l_suppkey").cast("string"), "l_linestatus", names).alias("path"), F.lit(1).alias("modified")).distinct()
    return tables.reports(files).select("company", "period", "name", "partial")


@query("""SELECT c_mktsegment AS sector, max('20' || lpad(CAST(10 + c_nationkey AS VARCHAR), 2, '0') || '-W' || lpad(CAST(1 + c_custkey % 52 AS VARCHAR), 2, '0')) AS last_week FROM customer WHERE c_custkey % 9 <> 0 GROUP BY 1""")
def industry_note_history(spark, sf_dir):
    year = F.concat(F.lit("20"), F.lpad((F.col("c_nationkey") + 10).cast("string"), 2, "0"))
    week = F.lpad((F.col("c_custkey") % 52 + 1).cast("string"), 2, "0")
    names = read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("index-"), "c_mktsegment")).otherwise(F.concat(year, F.lit("-W"), week, F.lit("-"), "c_mktsegment", F.lit(".md"))).alias("name"))
    return tables.sector_history(names).groupBy("sector").agg(F.max("iso_week").alias("last_week"))


@query("""SELECT 'timer-' || o_orderkey AS timer, CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'ok' END AS status, CAST(o_custkey AS VARCHAR) AS customer, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 10 <> 3""")
def health_files(spark, sf_dir):
    """Health rows as JSON lines, some of them broken, through the reader of health files."""
    row = F.to_json(F.struct(_text("timer-", _key()).alias("timer"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_run"), F.when(F.col("o_orderstatus") == "F", "fail").otherwise("ok").alias("status"), F.create_map(F.lit("customer"), F.col("o_custkey").cast("string")).alias("details")))
    text = read(spark, sf_dir, "orders").select(F.when(_key() % 10 == 3, F.left(row, F.lit(20))).otherwise(row).alias("value"))
    folder = shared_folder(spark, "health")
    text.write.text(folder)
    found = tables.health(spark, folder, multi_line=False)
    return found.select("timer", "status", F.col("details")["customer"].alias("customer"), F.to_date("last_run").alias("day"))


@query("""SELECT l_suppkey AS company, l_returnflag AS period, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS written, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def snapshots_replaced(spark, sf_dir):
    """Snapshots by period, of which one is written again: the others stay as they are."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company"), F.col("l_returnflag").alias("period"), F.lit(1).alias("written"))
    folder = shared_folder(spark, "snapshots")
    sinks.write_snapshot(rows, folder, "period")
    sinks.write_snapshot(rows.where("period = 'R'").withColumn("written", F.lit(2)), folder, "period")
    return spark.read.parquet(folder).groupBy("company", "period", "written").agg(F.count("*").alias("n"))


@query(market.SQL_HITS + "SELECT CAST(rank AS INTEGER) AS rank, ticker, trigger_type, round(severity, 6) AS severity, round(score, 6) AS score FROM ranked WHERE ticker = (SELECT ticker FROM ranked WHERE rank = 1)")
def hits_of_the_day(spark, sf_dir):
    """All triggers of the last day with a filing, evaluated as one product; of these the hits of the first ticker."""
    listed = filings(spark, sf_dir)
    last = listed.agg(F.max("rcept_dt")).first()[0]
    limits = {"flow": market.FLOW, "decoupling_pct": market.PCT, "decoupling_krw": 20_000.0}
    as_of = date(int(last[:4]), int(last[4:6]), int(last[6:])) if last else date(1970, 1, 1)
    hits = write_once(products.evaluate_triggers(watchlist(spark, sf_dir), bars(spark, sf_dir), flows(spark, sf_dir), listed, as_of, **limits), "hits")
    first = hits.where("rank = 1").select("ticker").first()
    found = triggers.hits_for_ticker(hits, first.ticker if first else None) if triggers.should_publish(hits) else hits.limit(0)
    return found.select("rank", "ticker", "trigger_type", F.round("severity", 6).alias("severity"), F.round("score", 6).alias("score"))


@query(market.SQL_HITS + """, top AS (SELECT ticker, sum(score) AS total_score, min(rank) AS first_rank FROM ranked GROUP BY ticker ORDER BY 2 DESC, 3 LIMIT 3)
SELECT CAST(rank AS BIGINT) AS ord, ticker, trigger_type, round(score, 6) AS score, CAST(NULL AS BIGINT) AS tickers, CAST(NULL AS BIGINT) AS n_top FROM ranked
UNION ALL SELECT 0, NULL, NULL, NULL, (SELECT count(DISTINCT ticker) FROM ranked), (SELECT count(*) FROM top)""")
def trigger_report_lines(spark, sf_dir):
    """The day's report as JSON lines, written in order and read back."""
    hits = write_once(market._hits(spark, sf_dir), "hits")
    told = report.trigger_report_lines("2026-05-12", hits, triggers.top_tickers(hits))
    folder = shared_folder(spark, "report")
    told.repartitionByRange("ord").sortWithinPartitions("ord").select("line").write.text(folder)
    line = "fetch_date string, tickers bigint, top array<struct<ticker:bigint>>, rank bigint, ticker bigint, trigger_type string, score double"
    found = spark.read.schema(line).json(folder)
    return found.select(F.coalesce("rank", F.lit(0)).cast("long").alias("ord"), "ticker", "trigger_type", F.round("score", 6).alias("score"), "tickers", F.when(F.col("top").isNotNull(), F.size("top")).cast("long").alias("n_top"))


@query("""WITH p AS (SELECT page_id // 40 AS company, 'II.' || page_id % 3 AS section_key, page_id, html FROM pages WHERE html IS NOT NULL AND html <> ''),
j AS (SELECT company, section_key, string_agg(html, chr(10) || chr(10) || '--- 다음 본문 조각 ---' || chr(10) || chr(10) ORDER BY page_id) AS t FROM p GROUP BY 1, 2)
SELECT company, section_key, md5(CASE WHEN length(t) > 8000 THEN left(t, 8000) || chr(10) || '... [잘림]' ELSE t END) AS text_md5 FROM j""")
def joined_sections(spark, sf_dir):
    """Pages as pieces of a company's sections, joined over its files and cut."""
    pieces = read(spark, sf_dir, "pages").select(F.expr("page_id div 40").alias("company"), F.concat(F.lit("II."), (F.col("page_id") % 3).cast("string")).alias("section_key"), "page_id", F.col("html").alias("text"))
    return report.joined_sections(pieces, "company", "page_id").select("company", "section_key", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN false ELSE true END AS note, event_id % 5 NOT IN (0, 1, 2) AND event_id % 3 = 2 AS industry_note FROM events""")
def publishable_notes(spark, sf_dir):
    """Notes made of events: without a text, failed in either way, or told; with none to two factors."""
    k = F.col("event_id") % 5
    text = F.when(k == 0, "").when(k == 1, "(LLM 호출 실패: x)").when(k == 2, "(LLM x)").otherwise(F.col("event_type"))
    factors = F.slice(F.array("event_type", "event_type"), F.lit(1), (F.col("event_id") % 3).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", report.valid_note(text).alias("note"), report.valid_industry_note(text, factors).alias("industry_note"))
