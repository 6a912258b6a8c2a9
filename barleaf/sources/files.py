"""Readers, writers and merges for landed files and tables."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barleaf.session import shared_folder

# Columns and types of a daily bar.
BAR_TYPES = {
    "date": "date",
    "ticker": "string",
    "open": "double",
    "high": "double",
    "low": "double",
    "close": "double",
    "adj_close": "double",
    "volume": "long",
}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is ever overwritten."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# -- parquet, tables, SQL -----------------------------------------------------


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def write_partitioned(df: DataFrame, root: str, by: Sequence[str], compression: str = "zstd", mode: str = "overwrite") -> None:
    """Hive partitions.  The rebalance hint lets AQE split an oversized
    partition value over several writers and merge small ones."""
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).option("compression", compression).partitionBy(*by).parquet(root)


def query(spark: SparkSession, text: str, **params) -> DataFrame:
    return spark.sql(text, args=params)


def register_parquet(spark: SparkSession, view: str, path: str) -> None:
    spark.read.parquet(path).createOrReplaceTempView(view)


def write_table(df: DataFrame, name: str, mode: str = "replace", path: str | None = None) -> None:
    """Replace a table, or append to it and create it when missing."""
    writer = df.write.mode({"replace": "overwrite", "append": "append"}[mode])
    (writer.option("path", path) if path else writer).saveAsTable(name)


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("show tables").select(F.col("tableName").alias("name"), F.col("isTemporary").alias("temporary"))


# -- text formats -------------------------------------------------------------


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records with an explicit schema; corrupt lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, null_mark: str = "") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", null_mark).csv(path)


def read_rate_csv(spark: SparkSession, path: str) -> DataFrame:
    """Two-column series file with "." for missing prints -> (date, value)."""
    raw = read_csv(spark, path, "date string, value string", null_mark=".")
    return raw.select(F.col("date").try_cast("date").alias("date"), F.col("value").try_cast("double").alias("value")).dropna()


def normalise_bars(df: DataFrame, ticker: str | Column | None = None) -> DataFrame:
    """Lower-case the column names, keep the bar columns, cast by the schema."""
    renamed = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    if ticker is not None:
        renamed = renamed.withColumn("ticker", F.lit(ticker) if isinstance(ticker, str) else ticker)
    if "adj_close" not in renamed.columns:
        renamed = renamed.withColumn("adj_close", F.col("close"))
    return renamed.select(*[F.col(c).cast(t).alias(c) for c, t in BAR_TYPES.items()])


# -- merges -------------------------------------------------------------------


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name, missing columns become null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def keyed_merge(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: str = "last", within: str | None = None) -> DataFrame:
    """One row per key from old + new; new wins with keep="last".

    An aggregation rather than a window: rows of one key meet as partial
    maxima, so a key with many copies never fills one task.  ``within`` names a
    column that orders copies inside the same load.
    """
    cols = old.columns + [c for c in new.columns if c not in old.columns]
    both = stack(old.withColumn("_load", F.lit(0)), new.withColumn("_load", F.lit(1)))
    rest = [c for c in cols if c not in keys]
    order = F.struct("_load", *([within] if within else []), *[c for c in rest if c != within])
    pick = F.max_by if keep == "last" else F.min_by
    row = pick(F.struct(*rest), order).alias("_row")
    return both.groupBy(*keys).agg(row).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in cols])


def keep_recent(df: DataFrame, ts: str, days: int = 90) -> DataFrame:
    """Rows within ``days`` of the newest one (a scalar subquery)."""
    newest = df.agg(F.max(ts)).scalar()
    return df.filter(F.col(ts) >= newest - F.expr(f"interval {days} days"))


def overlap_merge(old: DataFrame, new: DataFrame, days: int = 14) -> DataFrame:
    """Refresh the tail: new rows replace old ones from 14 days before each
    ticker's last old date; earlier new rows are ignored."""
    tail = old.groupBy("ticker").agg(F.date_sub(F.max("date"), days).alias("_from"))
    fresh = new.join(tail, "ticker", "left").filter(F.col("_from").isNull() | (F.col("date") >= F.col("_from"))).drop("_from")
    return keyed_merge(old, fresh, ["ticker", "date"])


def coverage(universe: DataFrame, data: DataFrame, key: str = "ticker") -> DataFrame:
    """Share of the universe with any row, and how many names are missing."""
    seen = data.select(key).distinct().withColumn("_seen", F.lit(1))
    return universe.select(key).distinct().join(seen, key, "left").agg(
        F.count("*").alias("wanted"), F.count("_seen").alias("covered"),
        (F.count("*") - F.count("_seen")).alias("missing"), (F.count("_seen") / F.count("*")).alias("share"),
    )


def missing_names(universe: DataFrame, data: DataFrame, known_empty: DataFrame | None = None, key: str = "ticker") -> DataFrame:
    """Universe names without data, minus names already known to have none."""
    left = universe.select(key).distinct().join(data.select(key), key, "left_anti")
    return left.join(known_empty.select(key), key, "left_anti") if known_empty is not None else left


def first_source(df: DataFrame, order: Sequence[str], source: str = "source") -> DataFrame:
    """Per ticker, only the rows of the first listed source that has any."""
    ranked = df.withColumn("_rank", F.array_position(F.array(*[F.lit(s) for s in order]), F.col(source))).filter("_rank > 0")
    best = ranked.groupBy("ticker").agg(F.min("_rank").alias("_best"))
    return ranked.join(best, "ticker").filter("_rank = _best").drop("_rank", "_best")


# -- record mapping -----------------------------------------------------------


def to_utc(value: Column, fallback: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(value), fallback)


# Confidence given to each news source.
CONFIDENCE = {"finnhub": 0.6, "google_news": 0.45, "newsapi": 0.4}


def article_events(articles: DataFrame, now: Column, sentiment=None) -> DataFrame:
    """Articles (ticker, title, content, backend, source_url, published_at) to events.

    The identifier is a hash of address and title, so a rerun gives the same one.
    """
    from barleaf.functions.text import lexicon_sentiment

    title = F.coalesce("title", F.lit(""))
    content = F.coalesce("content", F.lit(""))
    tone = (sentiment or lexicon_sentiment)(F.concat_ws(" ", title, content))
    trust = F.coalesce(*[F.when(F.col("backend") == k, v) for k, v in CONFIDENCE.items()], F.lit(0.45))
    return articles.select(
        F.sha2(F.concat_ws("|", "source_url", "title"), 256).alias("event_id"),
        F.col("backend").alias("source"),
        F.coalesce("source_url", F.lit("")).alias("source_url"),
        to_utc(F.col("published_at"), now).alias("published_at"),
        now.alias("known_at"),
        F.array(F.upper(F.coalesce("ticker", F.lit("UNKNOWN")))).alias("tickers"),
        F.array().cast("array<string>").alias("sectors"),
        F.lit("news").alias("event_type"),
        tone.alias("sentiment"),
        trust.alias("confidence"),
        F.lit(0.5).alias("novelty"),
        F.lit(0.0).alias("magnitude"),
        F.lit("1d").alias("time_horizon"),
        title.alias("summary"),
        content.alias("content"),
        F.array(F.lit("unverified")).alias("risk_flags"),
    )


def flatten_filings(df: DataFrame, column: str = "recent") -> DataFrame:
    """JSON of parallel arrays (form, filingDate) to one row per filing."""
    parsed = F.from_json(F.col(column), "form array<string>, filingDate array<string>")
    rows = df.withColumn("_p", parsed).select(
        "ticker", F.inline(F.arrays_zip(F.col("_p.form").alias("form"), F.col("_p.filingDate").alias("filed")))
    )
    rows = rows.select("ticker", F.try_to_date(F.col("filed")).alias("date"), F.trim(F.coalesce("form", F.lit(""))).alias("form"))
    return rows.dropna(subset=["date"]).dropDuplicates(["ticker", "date", "form"])


# Legal suffixes taken off company names.
SUFFIXES = [
    "INC", "CORP", "CO", "LTD", "PLC", "CORPORATION", "COMPANY",
    "INCORPORATED", "HOLDINGS", "GROUP", "CLASS A", "CLASS C", "/DE/",
]
ARTICLE_SUFFIXES = [*SUFFIXES, "THE", "N V", "S A"]


def clean_name(name: str) -> Column:
    """Each suffix is taken off once, in list order."""
    c = F.trim(F.col(name))
    for s in SUFFIXES:
        c = F.trim(F.regexp_replace(c, f"(?i) {s}$", ""))
    return c


def article_title(name: str) -> Column:
    """Nested suffixes peeled; an all-capitals name becomes title case."""
    bare = F.trim(F.regexp_replace(F.trim(F.col(name)), rf"(?i)(?:[,\s]*\s(?:{'|'.join(ARTICLE_SUFFIXES)})[,\s]*)+$", ""))
    letters = F.split(F.lower(bare), "")
    titled = F.array_join(
        F.transform(
            letters,
            lambda c, i: F.when((i == 0) | ~F.get(letters, i - 1).rlike("[a-z]"), F.upper(c)).otherwise(c),
        ),
        "",
    )
    return F.when((F.upper(bare) == bare) & (F.lower(bare) != bare), titled).otherwise(bare)


def economic_calendar(releases: DataFrame, fixed: DataFrame, today: Column, back: int = 7, ahead: int = 30) -> DataFrame:
    """Release dates and fixed meetings inside a window around today."""
    both = releases.select("event_name", "date").unionByName(fixed.select("event_name", "date"))
    near = both.filter(F.col("date").between(F.date_sub(today, back), F.date_add(today, ahead)))
    return near.dropDuplicates(["event_name", "date"]).withColumn("days_from_today", F.datediff("date", today))


# Two-day central bank meetings of 2025 and 2026.
MEETINGS = """
2025-01-28 2025-01-29 2025-03-18 2025-03-19 2025-04-29 2025-04-30 2025-06-17 2025-06-18
2025-07-29 2025-07-30 2025-09-16 2025-09-17 2025-10-28 2025-10-29 2025-12-09 2025-12-10
2026-01-27 2026-01-28 2026-03-17 2026-03-18 2026-04-28 2026-04-29 2026-06-09 2026-06-10
2026-07-28 2026-07-29 2026-09-15 2026-09-16 2026-10-27 2026-10-28 2026-12-08 2026-12-09
""".split()


def meetings(spark: SparkSession) -> DataFrame:
    days = F.explode(F.array(*[F.lit(d) for d in MEETINGS])).cast("date")
    return spark.range(1).select(F.lit("FOMC Meeting").alias("event_name"), days.alias("date"))


# -- HTML and feeds -----------------------------------------------------------

# Elements left out of an article's text, and where its text is looked for, in this order.
NOISE = ["script", "style", "noscript", "svg", "nav", "footer", "aside", "form"]
CONTAINERS = ["article", "main", "[role=main]", ".article-body", ".story-body", ".entry-content", ".post-content"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]


class _Page(HTMLParser):
    """Title, description and paragraphs of a page, each paragraph with the containers it stands in.

    A paragraph ends at its closing tag, at the next one, or with its container.
    Text inside ``NOISE`` elements at any depth is left out.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []  # tag and container kind
        self.depth: Counter[str] = Counter()
        self.quiet = 0
        self.containers: list[tuple[int, list[str]]] = []  # kind and paragraphs, in page order
        self.inside: list[int] = []
        self.paragraphs: list[str] = []
        self.told: dict[str, str] = {}
        self.heading: list[str] | None = None
        self.text: list[str] | None = None
        self.feed(html)
        self.close()
        self._end_paragraph()

    def _end_paragraph(self) -> None:
        if self.text is None:
            return
        text, self.text = " ".join(" ".join(self.text).split()), None
        if len(text) >= 40:
            self.paragraphs.append(text)
            for at in self.inside:
                self.containers[at][1].append(text)

    def _kinds(self, tag: str, told: dict[str, str]) -> list[int]:
        names = [tag, f"[role={told.get('role', '')}]", *(f".{c}" for c in told.get("class", "").split())]
        return [k for k, c in enumerate(CONTAINERS) if c in names]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        told = {k: v or "" for k, v in attrs}
        if tag == "meta":
            for key in (told.get("property"), told.get("name")):
                if key in ("og:title", "description"):
                    self.told.setdefault(key, told.get("content", ""))
        if tag in VOID:
            return
        if tag == "title" and self.heading is None and not self.quiet:
            self.heading = []
        if tag == "p":
            self._end_paragraph()
            if not self.quiet:
                self.text = []
        self.quiet += tag in NOISE
        kinds = [] if self.quiet else self._kinds(tag, told)
        for kind in kinds:
            self.inside.append(len(self.containers))
            self.containers.append((kind, []))
        self.open.append((tag, len(kinds)))
        self.depth[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "p":
            self._end_paragraph()
        if not self.depth[tag]:
            return
        while self.open:
            name, kinds = self.open.pop()
            self.depth[name] -= 1
            self.quiet -= name in NOISE
            if kinds:
                self._end_paragraph()
                del self.inside[len(self.inside) - kinds :]
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.quiet:
            return
        if self.open and self.open[-1][0] == "title" and self.heading is not None:
            self.heading.append(data)
        elif self.text is not None:
            self.text.append(data)

    def result(self) -> tuple[str, str]:
        squeeze = lambda t: " ".join(t.split())
        best = ""
        for _, found in sorted(self.containers, key=lambda c: c[0]):  # stable: page order within a kind
            text = " ".join(found)
            best = text if len(text) > len(best) else best
        body = best or " ".join(self.paragraphs) or squeeze(self.told.get("description", ""))
        return squeeze(self.told.get("og:title", "")) or squeeze("".join(self.heading or ())), body


#: Pages that are strings in Python at once; the rest of a batch stays in Arrow.
PAGES = 256
_TEXT = pa.struct([("title", pa.string()), ("body", pa.string())])


def _texts(html: pa.Array) -> pa.Array:
    """Titles and bodies of a batch, parsed some pages at a time."""
    parts = []
    for at in range(0, len(html), PAGES):
        title, body = zip(*[_Page(h or "").result() for h in html.slice(at, PAGES).to_pylist()])
        parts.append(pa.StructArray.from_arrays([pa.array(title, pa.string()), pa.array(body, pa.string())], fields=list(_TEXT)))
    return pa.concat_arrays(parts) if parts else pa.array([], _TEXT)


@F.arrow_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))
def page_text(html: pa.Array) -> pa.Array:
    return _texts(html)


def article_text(df: DataFrame, html: str, fallback: str = "") -> DataFrame:
    """Add ``title`` and ``body`` of a page: the longest container's paragraphs of 40
    characters or more, else the whole page's, else its description.

    Pages are parsed in Arrow batches, one pass each, whole; null pages have the
    fallback title and an empty body.
    """
    found = df.withColumn("_page", page_text(F.col(html)))
    title = F.coalesce(F.nullif(F.col("_page.title"), F.lit("")), F.lit(fallback))
    return found.withColumns({"title": title, "body": F.col("_page.body")}).drop("_page")


FEED = (
    "channel struct<item: array<struct<title: string, link: string, pubDate: string, source: string>>>"
)


def feed_entries(df: DataFrame, xml: str = "xml", limit: int | None = None) -> DataFrame:
    """RSS text to one row per item; ``limit`` is the feed's own cap on items."""
    items = F.from_xml(F.col(xml), FEED)["channel"]["item"]
    items = F.slice(items, 1, limit) if limit else items
    when = F.try_to_timestamp(F.regexp_replace(F.col("i.pubDate"), r"^\w+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    return df.select(F.upper("ticker").alias("ticker"), F.explode(items).alias("i")).select(
        "ticker", squeeze("i.title").alias("title"), squeeze("i.link").alias("source_url"),
        when.alias("published_at"), squeeze("i.source").alias("publisher_name"), squeeze("i.link").alias("fetch_url"),
    )
