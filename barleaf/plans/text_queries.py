"""Text queries: tokens, sentiment, near copies, retrieval, caching."""

from __future__ import annotations

from pyspark.sql import functions as F

from barleaf.functions import text as X
from barleaf.operators import similarity as SIM
from barleaf.operators import texts as M
from barleaf.plans.registry import add_query
from barleaf.sources import tables as T

_STOP = ", ".join(f"'{w}'" for w in X.IGNORED)
TOKENS = f"toks as (select doc_id, source, text, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda t: length(t) > 1 and t not in ({_STOP})))) as tokens from documents)"


def docs(s, d):
    return T.table(s, d, "documents")


add_query("words_token_set", "doc_id:i n:i digest", lambda s, d: docs(s, d).select("doc_id", X.token_set("text").alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.concat_ws(" ", "t")).alias("digest")),
          TOKENS, "out as (select doc_id, len(tokens) as n, md5(array_to_string(tokens, ' ')) as digest from toks)")
# the tables hold no lexicon words, so this query scores with words they do hold
_UP, _DOWN = ["the", "and", "la", "der"], ["of", "en", "que", "und"]


def lists(ws):
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


add_query(
    "words_sentiment", "doc_id:i sentiment:9", lambda s, d: docs(s, d).select("doc_id", X.lexicon_sentiment("text", _UP, _DOWN).alias("sentiment")),
    f"h as (select doc_id, len(list_filter(w, lambda t: list_contains({lists(_UP)}, t))) as p, len(list_filter(w, lambda t: list_contains({lists(_DOWN)}, t))) as n from (select doc_id, regexp_extract_all(lower(text), '[a-z'']+') as w from documents))",
    "out as (select doc_id, case when p + n > 0 then (p - n) / (p + n) else 0 end as sentiment from h)",
)
_BENCH_TOK = TOKENS.replace("toks as", "btoks as").replace("doc_id, source, text,", "item_id,").replace("from documents", "from benchmark")


def overlap(s, d):
    """Jaccard of every document with the benchmark items it shares a tenth of its tokens with."""
    a = docs(s, d).select("doc_id", X.token_set("text").alias("tokens"))
    b = T.table(s, d, "benchmark").select("item_id", X.token_set("text").alias("tokens"))
    return SIM.similar(a, b, "doc_id", "item_id", 0.1)


add_query("words_jaccard", "doc_id:i item_id:i jaccard:9", overlap, TOKENS, _BENCH_TOK,
          "out as (select * from (select doc_id, item_id, len(list_intersect(t.tokens, b.tokens)) / len(list_distinct(t.tokens || b.tokens)) as jaccard from toks t, btoks b where len(t.tokens) > 0 and len(b.tokens) > 0) where jaccard >= 0.1)")


def articles(s, d):
    return docs(s, d).selectExpr("source as ticker", "doc_id as id", "text")


GREEDY = """
seq as (select *, row_number() over (partition by source order by doc_id) as no from toks),
flat as (select source, doc_id, len(tokens) as n, unnest(tokens) as t from toks),
inter as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k from flat a join flat b on a.source = b.source and a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
sim as (select b as doc_id, list(a) as earlier from inter where k >= cast(0.9 as double) * (na + nb - k) group by 1),
walk as (select source, 0 as no, cast([] as bigint[]) as kept from (select distinct source from seq)
   union all select w.source, q.no, case when m.earlier is not null and list_has_any(w.kept, m.earlier) then w.kept else list_append(w.kept, q.doc_id) end
   from walk w join seq q on q.source = w.source and q.no = w.no + 1 left join sim m on m.doc_id = q.doc_id)"""
add_query(
    "words_near_copies_dropped", "ticker id:i", lambda s, d: M.drop_near_copies(articles(s, d)), "recursive " + TOKENS, GREEDY,
    "out as (select source as ticker, unnest(kept) as id from (select source, arg_max(kept, no) as kept from walk group by 1))",
)
_QUERY = "the of and la der que en und thing"


def corpus(s, d):
    return docs(s, d).select(F.col("source").alias("ticker"), F.col("doc_id").alias("id"), F.timestamp_seconds(F.lit(1577836800) + F.col("doc_id") * 3600).alias("known_at"), "text")


def as_of(s, d):
    """Three quarters into the known range."""
    t = F.unix_timestamp("known_at")
    return corpus(s, d).agg(F.timestamp_seconds((F.min(t) + (F.max(t) - F.min(t)) * 0.75).cast("long"))).scalar()


TFIDF = f"""
base as (select source as ticker, doc_id as id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') as w from documents
   where doc_id <= cast(floor((select min(doc_id) + (max(doc_id) - min(doc_id)) * 0.75 from documents)) as bigint)),
terms as (select ticker, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from base),
tf as (select ticker, id, term, count(*) as tf from terms group by all),
qw as (select string_split('{_QUERY}', ' ') as w),
q as (select term, count(*) as qf from (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from qw) group by 1),
nd as (select ticker, count(distinct id) + 1 as n from base group by 1),
idf as (select ticker, term, qf, ln((1 + n) / (1 + df)) + 1 as idf from (select coalesce(a.ticker, b.ticker) as ticker, coalesce(a.term, b.term) as term, qf,
   coalesce(df, 0) + case when qf is not null then 1 else 0 end as df from (select ticker, term, count(*) as df from tf group by all) a
   full join (select * from nd, q) b on a.ticker = b.ticker and a.term = b.term) join nd using (ticker)),
ql as (select ticker, sqrt(sum(pow(qf * idf, 2))) as ql from idf where qf is not null group by 1),
sc as (select ticker, id, sum(tf * idf * coalesce(qf, 0) * idf) / sqrt(sum(pow(tf * idf, 2))) / any_value(ql) as relevance from tf join idf using (ticker, term) join ql using (ticker) group by all),
found as (select * from (select *, row_number() over (partition by ticker order by relevance desc, id) as rank from sc where relevance > 0) where rank <= 6)"""
add_query("search_tfidf", "ticker id:i rank:i relevance:8", lambda s, d: M.tfidf_search(corpus(s, d), _QUERY, 6, as_of(s, d)), TFIDF, relation="found")


def packed(s, d):
    hits = M.tfidf_search(corpus(s, d), _QUERY, 6, as_of(s, d))
    text = corpus(s, d).select("ticker", "id", "known_at", F.regexp_replace("text", r"\s+", " ").alias("snippet"))
    # six hits a source are broadcast, so that the texts stay where they are
    return M.pack_context(text.join(F.broadcast(hits), ["ticker", "id"]), 6000)


add_query(
    "search_context_packed", "ticker n:i digest", lambda s, d: packed(s, d).withColumn("digest", F.md5("context")), TFIDF,
    "ln0 as (select f.ticker, rank, rank || '. [' || strftime(timestamp '2020-01-01' + to_hours(cast(id as int)), '%Y-%m-%d') || '] ' || regexp_replace(text, '\\s+', ' ', 'g') as line from found f join documents on doc_id = id)",
    "cum as (select *, sum(length(line)) over (partition by ticker order by rank) as used from ln0 where true)",
    "out as (select ticker, count(*) as n, md5(string_agg(line, chr(10) order by rank)) as digest from cum where used <= 6000 group by 1)",
)


def vectors(s, d):
    return T.table(s, d, "embeddings").select(F.col("label").cast("string").alias("ticker"), F.col("vec_id").alias("id"), "embedding")


def probe(s, d):
    return T.table(s, d, "embeddings").filter("vec_id = 0").select("embedding").scalar()


add_query(
    "search_embedding", "ticker id:i rank:i relevance:7", lambda s, d: M.embedding_search(vectors(s, d), probe(s, d), 5),
    "v as (select cast(label as varchar) as ticker, vec_id as id, cast(embedding as double[]) as e from embeddings)", "p as (select e as q from v where id = 0)",
    "c as (select ticker, id, list_dot_product(e, q) / sqrt(list_dot_product(e, e) * list_dot_product(q, q)) as relevance from v, p)",
    "out as (select * from (select *, row_number() over (partition by ticker order by relevance desc, id) as rank from c) where rank <= 5)",
)
add_query("words_content_key", "doc_id:i key", lambda s, d: docs(s, d).select("doc_id", M.content_key(F.col("text")).alias("key")), "out as (select doc_id, sha256(text) as key from documents)")


def cached(s, d):
    """Cache holds the English documents; the rest are scored now."""
    scored = X.lexicon_sentiment("text", _UP, _DOWN)
    cache = docs(s, d).filter("lang = 'en'").select(M.content_key(F.col("text")).alias("key"), F.lit(9.0).alias("score")).distinct()
    return M.score_new_texts(docs(s, d), cache, scored)


add_query(
    "words_score_cache", "key score:9", cached,
    f"h as (select distinct sha256(text) as key, len(list_filter(w, lambda t: list_contains({lists(_UP)}, t))) as p, len(list_filter(w, lambda t: list_contains({lists(_DOWN)}, t))) as n from (select text, regexp_extract_all(lower(text), '[a-z'']+') as w from documents))",
    "en as (select distinct sha256(text) as key from documents where lang = 'en')",
    "out as (select key, 9.0 as score from en union all select key, case when p + n > 0 then (p - n) / (p + n) else 0 end from h where key not in (select key from en))",
)
