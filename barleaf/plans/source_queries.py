"""Source, sink and merge queries: each writes or parses what the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from barleaf.plans.basesql import BARS
from barleaf.plans.registry import add_query
from barleaf.sources import files as S
from barleaf.sources import tables as T

BAR = "date:d ticker open high low close adj_close volume:i"


def parquet_roundtrip(s, d):
    path = S.fresh_path(s, "bars")
    S.write_parquet(T.bars(s, d), path)
    return S.read_parquet(s, path)


def partitioned(s, d):
    path = S.fresh_path(s, "bars-by-year")
    S.write_partitioned(T.bars(s, d).withColumn("year", F.year("date")), path, ["year"])
    return S.read_parquet(s, path).filter("year = 1997")


add_query("io_parquet_bars", BAR, parquet_roundtrip, BARS, relation="bars")
add_query("io_partitioned_year", f"{BAR} year:i", partitioned, BARS, "out as (select *, year(date) as year from bars where year(date) = 1997)")


def sql_query(s, d):
    S.register_parquet(s, "panel_lines", f"{d}/lineitem.parquet")
    return S.query(s, "select l_returnflag, count(*) as n, sum(l_quantity) as qty from panel_lines where l_quantity > :least group by l_returnflag", least=10)


add_query("io_sql_view", "l_returnflag n:i qty:2", sql_query, "out as (select l_returnflag, count(*) as n, sum(l_quantity) as qty from lineitem where l_quantity > 10 group by 1)")


def table_append(s, d):
    orders = T.table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path, name = S.fresh_path(s, "order-table"), "order_table_" + S.fresh_path(s, "x")[-12:]
    S.write_table(orders.filter("o_orderstatus = 'F'"), name, "replace", path)
    S.write_table(orders.filter("o_orderstatus <> 'F'"), name, "append")
    return s.table(name)


add_query("io_table_replace_append", "o_orderkey:i o_totalprice:2 o_orderstatus", table_append, "out as (select o_orderkey, o_totalprice, o_orderstatus from orders)")


add_query("io_list_tables", "listed:i", lambda s, d: table_append(s, d).sparkSession.range(1).withColumn("listed", S.list_tables(s).filter("name like 'order_table_%' and not temporary").agg((F.count("*") > 0).cast("int")).scalar()).select("listed"),
          "out as (select 1 as listed from orders limit 1)")


def jsonl(s, d):
    """Event records as JSON lines, every fiftieth line cut short."""
    e = T.table(s, d, "events").select("event_id", "event_type", "value")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    broken = F.when(F.col("event_id") % 50 == 0, F.expr("substring(value, 1, 20)")).otherwise(F.col("value"))
    path = S.fresh_path(s, "events-jsonl")
    e.select("event_id", line.alias("value")).select(broken.alias("value")).write.text(path)
    return S.read_jsonl(s, path, "event_id long, event_type string, value double")


add_query("io_jsonl_skip_corrupt", "event_id:i event_type value:6", jsonl, "out as (select event_id, event_type, value from events where event_id % 50 <> 0)")


def blotter_frame(s, d):
    """Lines as fills: returned lines are sells with the list price as basis."""
    lines = T.table(s, d, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    parts = T.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    sell = F.col("l_returnflag") == "R"
    return lines.join(parts, "l_partkey").select(
        F.to_date("l_shipdate").alias("trade_date"), F.col("p_brand").alias("ticker"),
        F.when(sell, "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("qty"), "price",
        F.when(sell & (F.col("l_linenumber") != 3), F.col("p_retailprice")).alias("avg_cost_basis"),
    )


def blotter_csv(s, d):
    path = S.fresh_path(s, "blotter")
    blotter_frame(s, d).write.option("header", True).csv(path)
    return S.read_csv(s, path, "trade_date date, ticker string, side string, qty double, price double, avg_cost_basis double")


BLOTTER = """
blotter as (select cast(l_shipdate as date) as trade_date, p_brand as ticker, case when l_returnflag = 'R' then 'SELL' else 'BUY' end as side,
   l_quantity as qty, l_extendedprice / l_quantity as price,
   case when l_returnflag = 'R' and l_linenumber <> 3 then p_retailprice end as avg_cost_basis from lineitem join part on l_partkey = p_partkey)"""
add_query("io_csv_blotter", "trade_date:d ticker side qty price avg_cost_basis", blotter_csv, BLOTTER, relation="blotter")


def rate_csv(s, d):
    e = T.table(s, d, "events").select(
        F.to_date("ts").cast("string").alias("DATE"),
        F.when(F.col("event_id") % 10 == 0, ".").when(F.col("event_id") % 77 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("DFF"),
    )
    path = S.fresh_path(s, "rates")
    e.write.option("header", True).csv(path)
    return S.read_rate_csv(s, path)


add_query("io_rate_csv_missing_marks", "date:d value:4", rate_csv, "out as (select cast(ts as date) as date, value from events where event_id % 10 <> 0 and event_id % 77 <> 0)")


def raw_orders(s, d):
    return T.table(s, d, "orders").selectExpr("o_custkey", "cast(o_orderdate as date) as date", "o_orderkey", "o_totalprice", "o_orderstatus")


def merged(keep):
    def build(s, d):
        o = raw_orders(s, d)
        return S.keyed_merge(o.filter("o_orderstatus <> 'P'"), o.filter("o_orderstatus <> 'F'"), ["o_custkey", "date"], keep, within="o_orderkey")

    return build


MERGE = """
both0 as (select o_custkey, cast(o_orderdate as date) as date, o_orderkey, o_totalprice, o_orderstatus, 0 as load from orders where o_orderstatus <> 'P'
  union all select o_custkey, cast(o_orderdate as date), o_orderkey, o_totalprice, o_orderstatus, 1 from orders where o_orderstatus <> 'F')"""
for _keep, _way in (("last", "desc"), ("first", "asc")):
    add_query(
        f"merge_keyed_{_keep}", "o_custkey:i date:d o_orderkey:i o_totalprice:2 o_orderstatus", merged(_keep), MERGE,
        f"out as (select * from (select *, row_number() over (partition by o_custkey, date order by load {_way}, o_orderkey {_way}, o_totalprice {_way}) as rn from both0) where rn = 1)",
    )
add_query(
    "merge_recent_retention", "event_id:i event_type value:6", lambda s, d: S.keep_recent(T.table(s, d, "events"), "ts", 7),
    "out as (select * from events where ts >= (select max(ts) from events) - interval 7 days)",
)


def tail_overlap(s, d):
    t = T.tone_series(s, d)
    old = t.filter("date < date'1998-01-01'")
    new = t.filter("date >= date'1997-06-01'").withColumn("gdelt_vol", F.col("gdelt_vol") + 100)
    return S.overlap_merge(old, new)


add_query(
    "merge_tail_overlap", "ticker date:d gdelt_vol:i", tail_overlap,
    "tone as (select p_brand as ticker, cast(l_shipdate as date) as date, count(*) as v from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' group by 1, 2)",
    "cutoff as (select ticker, max(date) - 14 as f from tone where date < date '1998-01-01' group by 1)",
    """out as (select ticker, date, v + case when date >= date '1997-06-01' and date >= f then 100 else 0 end as gdelt_vol from tone left join cutoff using (ticker)
        where date < date '1998-01-01' or date >= f or f is null)""",
)


def universe(s, d):
    return T.table(s, d, "part").selectExpr("cast(p_partkey as string) as ticker")


def sold_back(s, d):
    return T.table(s, d, "lineitem").filter("l_returnflag = 'R' and l_linestatus = 'O' and l_quantity < 5").selectExpr("cast(l_partkey as string) as ticker")


_SOLD = "sold as (select distinct l_partkey as k from lineitem where l_returnflag = 'R' and l_linestatus = 'O' and l_quantity < 5)"
add_query(
    "coverage_share", "wanted:i covered:i missing:i share:9", lambda s, d: S.coverage(universe(s, d), sold_back(s, d)), _SOLD,
    "out as (select count(*) as wanted, count(k) as covered, count(*) - count(k) as missing, count(k) / count(*) as share from (select distinct p_partkey from part) left join sold on p_partkey = k)",
)
add_query(
    "coverage_missing_names", "ticker",
    lambda s, d: S.missing_names(universe(s, d), sold_back(s, d), T.table(s, d, "part").filter("p_size = 1").selectExpr("cast(p_partkey as string) as ticker")), _SOLD,
    "out as (select cast(p_partkey as varchar) as ticker from part where p_partkey not in (select k from sold) and p_size <> 1)",
)


def feed_bars(s, d):
    b = T.bars(s, d)
    return S.normalise_bars(b.select("date", "ticker", F.col("open").cast("string").alias("Open"), F.col("high").alias("High"),
                                     F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("adj_close").alias("Adj Close"), F.col("volume").cast("double").alias("Volume")))


add_query("bars_normalised", BAR, feed_bars, BARS, relation="bars")
add_query(
    "bars_diagonal_union", "ticker date:d close volume:i form",
    lambda s, d: S.stack(T.bars(s, d).select("ticker", "date", "close", "volume"), T.filings(s, d)), BARS,
    """out as (select ticker, date, close, volume, cast(null as varchar) as form from bars union all
       select c_mktsegment, cast(o_orderdate as date), null, null, case o_orderpriority when '1-URGENT' then '8-K' when '2-HIGH' then '4' when '3-MEDIUM' then '4/A'
       when '4-NOT SPECIFIED' then '424B5' else '10-Q' end from orders join customer on o_custkey = c_custkey)""",
)


def articles(s, d):
    docs = T.table(s, d, "documents")
    stamp = F.when(F.col("doc_id") % 7 == 0, "not a date").otherwise(
        F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.col("doc_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    return docs.select(
        F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("ticker"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, "finnhub").otherwise("wire").alias("backend"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_url"), stamp.alias("published_at"),
    )


add_query(
    "articles_to_events", "event_id source source_url published_at tickers sentiment:9 confidence:3 summary n:i",
    lambda s, d: S.article_events(articles(s, d), F.to_timestamp(F.lit("2030-01-01 00:00:00"))).select(
        "event_id", "source", "source_url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        F.array_join("tickers", ",").alias("tickers"), "sentiment", "confidence", "summary", F.length("content").alias("n")),
    """out as (select sha256('doc/' || doc_id || '|' || split_part(text, chr(10), 1)) as event_id, case when doc_id % 2 = 0 then 'finnhub' else 'wire' end as source,
        'doc/' || doc_id as source_url, strftime(case when doc_id % 7 = 0 then timestamp '2030-01-01' else timestamp '2020-01-01' + to_hours(cast(doc_id as int)) end, '%Y-%m-%d %H:%M:%S') as published_at,
        case when doc_id % 11 <> 0 then upper(source) else 'UNKNOWN' end as tickers, 0.0 as sentiment, case when doc_id % 2 = 0 then 0.6 else 0.45 end as confidence,
        split_part(text, chr(10), 1) as summary, length(text) as n from documents)""",
)
add_query(
    "news_first_source", "ticker source event_id:i",
    lambda s, d: S.first_source(T.table(s, d, "documents").selectExpr("lang as ticker", "source", "doc_id as event_id").filter("not (lang = 'en' and source = 'src3')"), ["src99", "src3", "src5", "src0"]),
    "r as (select lang as ticker, source, doc_id as event_id, case source when 'src3' then 2 when 'src5' then 3 when 'src0' then 4 end as k from documents where not (lang = 'en' and source = 'src3'))",
    "out as (select ticker, source, event_id from r where k = (select min(k) from r r2 where r2.ticker = r.ticker))",
)


def filing_json(s, d):
    o = T.table(s, d, "orders").select(
        F.col("o_custkey").cast("string").alias("ticker"),
        F.to_json(F.struct(
            F.array(F.concat(F.lit(" "), F.col("o_orderpriority")), F.col("o_orderstatus")).alias("form"),
            F.array(F.to_date("o_orderdate").cast("string"), F.when(F.col("o_orderstatus") == "P", "").otherwise("31/12/1999")).alias("filingDate"),
        )).alias("recent"),
    )
    return S.flatten_filings(o)


add_query("filings_from_json", "ticker date:d form", filing_json, "out as (select distinct cast(o_custkey as varchar) as ticker, cast(o_orderdate as date) as date, o_orderpriority as form from orders)")


def names(s, d):
    tail = F.element_at(F.array(*[F.lit(x) for x in (" INC", " HOLDINGS, INC", " CORP", " GROUP PLC", "", " CO /DE/", " COMPANY THE")]), F.col("p_size") % 7 + 1)
    return T.table(s, d, "part").select("p_partkey", F.concat(F.upper("p_name"), tail).alias("name"))


add_query(
    "names_cleaned", "p_partkey:i clean title", lambda s, d: names(s, d).select("p_partkey", S.clean_name("name").alias("clean"), S.article_title("name").alias("title")),
    """out as (select p_partkey, upper(p_name) || case p_size % 7 when 1 then ' HOLDINGS,' when 3 then ' GROUP' when 5 then ' CO' when 6 then ' COMPANY THE' else '' end as c0,
        upper(left(split_part(p_name, ' ', 1), 1)) || lower(substring(split_part(p_name, ' ', 1), 2)) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || lower(substring(split_part(p_name, ' ', 2), 2)) as title,
        case when p_size % 7 = 3 then upper(p_name) else c0 end as clean from part)""",
)


def pages(s, d):
    df = S.article_text(T.table(s, d, "pages"), "html")
    return df.select("page_id", "title", F.md5("body").alias("body_md5"), F.length("body").alias("n_chars"))


def plain_sql(x: str) -> str:
    e = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)")):
        e = f"replace({e}, '{a}', {b})"
    e = f"regexp_replace({e}, '&amp;?', '&', 'g')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def strip_sql(x: str) -> str:
    e = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for t in S.NOISE:
        e = f"regexp_replace({e}, '(?is)<{t}\\b.*?</{t}\\s*>', ' ', 'g')"
    return e


add_query(
    "pages_article_text", "page_id:i title body_md5 n_chars:i", pages,
    f"raw as (select page_id, {strip_sql('html')} as h from pages)",
    "blk as (select page_id, h, unnest(regexp_extract_all(h, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)) as b from raw)",
    "prt as (select page_id, h, regexp_split_to_array(b, '(?i)<p(?:\\s[^>]*)?>')[2:] as ps from blk)",
    f"txt as (select page_id, h, array_to_string(list_filter(list_transform(ps, lambda p: {plain_sql("regexp_replace(p, '(?is)</p\\s*>.*', '')")}), lambda t: length(t) >= 40), ' ') as t from prt)",
    f"out as (select page_id, {plain_sql("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title', 1)")} as title, md5(t) as body_md5, length(t) as n_chars from txt)",
)


def feeds(s, d):
    """One feed per page: the page itself and its mirror as items."""
    item = "concat('<item><title> ', {t}, ' </title><link>', replace(url, '&', '&amp;'), '</link><pubDate>', {d}, '</pubDate><source>', 'site ', page_id % 9, '</source></item>')"
    when = "date_format(timestamp_seconds(1577836800 + page_id * 3600), 'EEE, dd MMM yyyy HH:mm:ss')"
    return T.table(s, d, "pages").selectExpr(
        "concat('t', page_id % 5) as ticker",
        f"concat('<rss><channel>', {item.format(t=chr(39) + 'Page  ' + chr(39) + ', page_id', d='concat(' + when + ', ' + chr(39) + ' GMT' + chr(39) + ')')}, "
        f"{item.format(t=chr(39) + 'Mirror ' + chr(39) + ', page_id', d=chr(39) + 'unknown' + chr(39))}, '</channel></rss>') as xml",
    )


add_query(
    "feeds_parsed", "ticker title source_url published_at publisher_name",
    lambda s, d: S.feed_entries(feeds(s, d)).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")),
    "b as (select 'T' || page_id % 5 as ticker, page_id, url as source_url, 'site ' || page_id % 9 as publisher_name from pages)",
    """out as (select ticker, 'Page ' || page_id as title, source_url, strftime(timestamp '2020-01-01' + to_hours(cast(page_id as int)), '%Y-%m-%d %H:%M:%S') as published_at, publisher_name from b
        union all select ticker, 'Mirror ' || page_id, source_url, null, publisher_name from b)""",
)


def econ(s, d):
    days = T.meetings(s, d)
    return S.economic_calendar(days.filter("event_name = 'CPI'"), days.filter("event_name <> 'CPI'"), F.to_date(F.lit("1998-06-15")))


add_query(
    "calendar_window", "event_name date:d days_from_today:i", econ,
    """out as (select distinct event_name, date, date - date '1998-06-15' as days_from_today from (
        select 'CPI' as event_name, cast(o_orderdate as date) as date from orders group by 2 having arg_min(o_orderstatus, row(o_totalprice, o_orderkey)) = 'P' union all
        select 'FOMC Meeting', cast(o_orderdate as date) as date from orders group by 2 having arg_max(o_orderstatus, row(o_totalprice, o_orderkey)) = 'P')
        where date between date '1998-06-15' - 7 and date '1998-06-15' + 30)""",
)
