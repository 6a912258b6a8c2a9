"""Page text, nearest neighbours and the corpus pipeline."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import public_tokenizers
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barleaf.llm import lines, pages, partitions, quality, queries, secrets, shingles
from barleaf.llm.common import components
from tests.llm.conftest import CLASH, SF
from tests.llm.test_documents import pieces_are_whole, slow_fingerprint

PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class='ad'>buy now</div>"
    "<article><header><h1>A title</h1></header><p><b>One &amp; two&#8217;s &mdash;  text.<br><p>Inner <i>mark</i>up<div class=box><p>deep</p></div><p>after</p>"
    "<section id=comments><p>nice!</p></section><form><button>go</button></form><script>if (a<b) '</p>'</script><ul><li>q<li>w</ul></article>"
    "<aside>side</aside><div class='cookie-notice'>we use cookies</div><footer>&copy; host"
)


def test_article_text():
    kept = [t for z, t, _ in pages.blocks(PAGE) if z == pages.MAIN]
    assert kept == ["A title", "One & two’s — text.", "Inner markup", "deep", "after", "q", "w"]
    assert pages.blocks(None) == [] and pages.blocks("a < b & c") == [(pages.OPEN, "a < b & c", False)]


def test_text_after_a_script_with_odd_quotes_stays():
    page = "<article><script>for(i=0;i<n;i++){} // don't</script><p>It's the first sentence of the article.</p><style>a<b'</style><p>'Tis more</p></article>"
    assert [t for _, t, _ in pages.blocks(page)] == ["It's the first sentence of the article.", "'Tis more"]
    assert pages.blocks("<p>a</p><script>if (a<b) 'never closed") == [(pages.OPEN, "a", False)]


def test_runs_decide_on_pages_without_article(spark):
    boiler = "this site belongs to nobody in particular and has no news at all"
    unique = [" ".join(f"word{i}x{k}" for k in range(14)) for i in range(6)]
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<div>{boiler}</div><div>{unique[i]}</div>", 1) for i in range(6)]
    rows += [(10, None, None, 1), (11, "http://x/", "", 1), (12, "http://h0.example/a", PAGE, 1), (12, "http://h0.example/a", PAGE, 1), (None, "http://y/", f"<p>{boiler}</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row int")
    got = [(r.page_id, r.text, r.n_chars) for r in pages.main_text(df).collect()]
    want = [(i, unique[i]) for i in range(6)] + [(10, ""), (11, ""), (12, "A title\nOne & two’s — text.\nInner markup\ndeep\nafter\nq\nw")] * 1 + [(12, "A title\nOne & two’s — text.\nInner markup\ndeep\nafter\nq\nw"), (None, boiler)]
    assert sorted(map(str, got)) == sorted(str((i, t, len(t))) for i, t in want)
    assert pages.main_text(df.limit(0)).count() == 0


def test_prose_of_articles_stays_and_their_menus_go(spark):
    closing = "please support this fine paper with a small gift of your own choice today"
    own = [" ".join(f"own{i}x{k}" for k in range(60)) for i in range(30)]
    menu = "home news weather sports culture travel money letters about contact"
    links = "".join(f"<a href=/{w}>{w}</a> " for w in menu.split())

    def page(i, *inside, outside=""):
        return (i, f"http://h.example/{i}", f"<nav>{outside}</nav><article><p>{own[i % 30]}</p>{''.join(inside)}</article>")

    rows = [page(i, f"<p class=side>{closing}</p>", f"<p><a href=x>{closing}</a> and more words that are no link and stay where they are</p>") for i in range(9)]
    rows += [page(10 + i, f"<p>{closing}</p>", f"<div>{links}</div>", outside=links) for i in range(9)]  # a menu of the host, inside too
    rows += [(40, "http://other.example/", f"<article><p>{own[0]}</p><div>{links}</div></article>")]  # not a menu of this host
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"{own[i]}\n{closing}\n{closing} and more words that are no link and stay where they are" for i in range(9)}
    want |= {10 + i: f"{own[10 + i]}\n{closing}" for i in range(9)} | {40: f"{own[0]}\n{menu}"}
    assert got == want


def test_no_line_of_an_article_is_lost(spark):
    """Every line of the given documents that stands in an article is in its page's text."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    lines_of = {" ".join(t.split()) for (text,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() for t in (text or "").split("\n")}
    kept = {r.page_id: set(r.text.split("\n")) for r in pages.main_text(table).collect()}
    seen = 0
    for r in table.collect():
        inside = {t for z, t, _ in pages.blocks(r.html) if z == pages.MAIN}
        assert inside <= kept[r.page_id]
        seen += len(inside & lines_of)
    assert seen > 100


@pytest.mark.parametrize("part", ['a <b "', "<", "a < b ", "<!", "<svg>x", "<p a=1 ", "<a x=\"", "<a x='<b y=\"", "<!--", "<li><center>", "<x y=\"1\" ", "</p"])
def test_a_megabyte_of_odd_markup_is_read_in_one_pass(part):
    start = time.process_time()
    pages.blocks("<article><p>first</p>" + part * (1_000_000 // len(part)))
    assert time.process_time() - start < 6  # a second or less on an idle machine; quadratic reading takes minutes


def slow_runs(rows):
    """Open blocks of article-less pages: more than half of the words in eight-word runs found on two pages of the host."""
    runs = {}
    for i, (url, texts) in enumerate(rows):
        words = " ".join(texts).split(" ")
        for k in range(len(words) - 7):
            runs.setdefault((url, *words[k : k + 8]), set()).add(i)
    out = []
    for url, texts in rows:
        words = " ".join(texts).split(" ")
        inside = [False] * len(words)
        for k in range(len(words) - 7):
            if len(runs[(url, *words[k : k + 8])]) > 1:
                inside[k : k + 8] = [True] * 8
        kept, at = [], 0
        for t in texts:
            n = len(t.split(" "))
            if 2 * sum(inside[at : at + n]) <= n:
                kept.append(t)
            at += n
        out.append("\n".join(kept or texts))
    return out


def test_host_runs_equal_brute_force(spark):
    pick = random.Random(12)
    shared = [" ".join(f"s{j}x{k}" for k in range(pick.randint(3, 30))) for j in range(12)]
    rows = []
    for i in range(120):
        texts = []
        for _ in range(pick.randint(1, 6)):
            words = pick.choice(shared).split() if pick.random() < 0.5 else [f"u{pick.randrange(40)}" for _ in range(pick.randint(1, 25))]
            texts.append(" ".join(words[pick.randint(0, 3) :] or ["x"]))
        rows.append((f"http://h{i % 7}.example", texts))
    df = spark.createDataFrame([(i, f"{u}/p{i}", "".join(f"<div>{t}</div>" for t in texts)) for i, (u, texts) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(df.repartition(5)).collect()}
    want = dict(enumerate(slow_runs(rows)))
    assert got == want and any(w != "\n".join(t) for w, (_, t) in zip(want.values(), rows))


def slow_search(x, ids, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def vectors(spark):
    odd = [(20000, None), (20020, [0.0] * 64), (20040, [float("nan")] + [1.0] * 63), (20060, [1.0] * 3), (20080, [1.0] * 63 + [None])]
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    copies = given.where("vec_id < 8").crossJoin(spark.range(1, 41).toDF("c")).select((F.col("vec_id") * 100 + F.col("c") + 30000).alias("vec_id"), "embedding")
    return given.union(copies).union(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).withColumn("v", F.lit(1)).withColumn("part", F.lit(2))


def test_search_of_all_partitions_equals_brute_force(spark):
    df = vectors(spark)
    plain = df.where("vec_id < 20000 or vec_id > 30000").toPandas()
    want = slow_search(np.stack(plain.embedding.to_numpy()).astype(float), plain.vec_id.to_numpy())
    got = {}
    for r in partitions.search(df, lambda i: i % 20 == 0, probes=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    for q, near in got.items():
        near.sort()
        assert [n for n, _, _ in near] == list(range(1, 21)) and [v for _, v, _ in near] == [v for v, _ in want[q]]
        assert np.allclose([s for _, _, s in near], [s for _, s in want[q]], rtol=1e-12)


def test_search_recall_and_small_tables(spark):
    df = vectors(spark)
    plain = df.where("vec_id < 20000 or vec_id > 30000").toPandas()
    want = slow_search(np.stack(plain.embedding.to_numpy()).astype(float), plain.vec_id.to_numpy())
    got = partitions.search(df, lambda i: i % 20 == 0).collect()
    hits = sum((r.vec_id in {v for v, _ in want[r.query_id]}) for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert partitions.search(df.limit(0), lambda i: i % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in partitions.search(few, lambda i: i % 20 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_balanced_parts_stay_within_capacity():
    x = np.random.default_rng(2).normal(size=(800, 8))
    label = partitions.balanced_parts(x, partitions.neighbours(x, 10), 8)
    assert np.bincount(label, minlength=8).max() <= 1.1 * 100 + 1


def slow_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def one_of_each_group(given, kept):
    """No two kept texts are near, and every text that went is linked to a kept one, directly or by others."""
    fps = {t: slow_fingerprint(t) for _, t in given}
    sets = {t: slow_shingles(t) for _, t in given}

    def near(x, y):
        return (fps[x] ^ fps[y]).bit_count() <= 3 or len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])

    assert not Counter(kept) - Counter(given)
    texts = [t for _, t in kept]
    assert not [(x, y) for i, x in enumerate(texts) for y in texts[:i] if near(x, y)]
    reached, open_ = set(texts), set(fps) - set(texts)
    while more := {x for x in open_ if any(near(x, y) for y in reached)}:
        reached, open_ = reached | more, open_ - more
    assert not open_


@pytest.mark.parametrize("given", ["documents", "messy"])
def test_pipeline_stages(spark, given, documents, messy):
    docs = documents if given == "documents" else messy.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, SF).cache()
    want = {(r.doc_id, r.cleaned) for r in lines.judge(docs).where("kept").collect()}
    assert kept.columns == docs.columns and {(r.doc_id, r.text) for r in kept.collect()} == want
    assert kept.where("n_chars != length(text)").count() == 0
    good = stages["quality classifier"](spark, kept, SF).cache()
    assert good.columns == docs.columns and good.count() <= kept.count()
    one = stages["near duplicates"](spark, good, SF).cache()
    assert one.columns == good.columns
    one_of_each_group([(r.doc_id, r.text) for r in good.collect()], [(r.doc_id, r.text) for r in one.collect()])
    safe = stages["secret scan"](spark, one, SF).cache()
    assert safe.columns == docs.columns and safe.count() == one.count()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in safe.collect():
        got = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        ids[r.doc_id, len(got)] = got
    pieces_are_whole(stages["packing"](spark, safe, SF).collect(), ids)


def test_near_copies_at_four_fifths_go(spark):
    pick = random.Random(3)
    made = [[f"w{pick.randrange(5000)}" for _ in range(300)] for _ in range(40)]
    texts = [" ".join(m) for m in made]
    for m in made[:20]:
        for changes in range(1, 8):  # similarity from 0.97 down to 0.79
            copy = list(m)
            for at in pick.sample(range(300), changes):
                copy[at] = "changed" + str(pick.random())
            texts.append(" ".join(copy))
    shared = [f"s{i}" for i in range(300)]
    texts += [" ".join(shared[: 300 - 4 * k] + [f"t{k}x{i}" for i in range(4 * k)]) for k in range(40)]  # one bucket, not all similar
    texts += ["", "   ", "one", "ONE"]
    texts.append(None)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [slow_shingles(t) for t in texts]
    assert sum(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in range(40) for j in range(40, 180)) > 100
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    one = stage(spark, df.withColumns({c: F.lit(c) for c in CLASH}), SF).cache()
    assert one.columns == [*df.columns, *CLASH] and one.count() < 120
    one_of_each_group([tuple(r) for r in df.collect()], [(r.doc_id, r.text) for r in one.collect()])
    assert stage(spark, df.limit(0), SF).count() == 0


def test_a_crowd_in_one_bucket_needs_few_rounds(spark, monkeypatch):
    """A passage shared by 600 unlike texts: the rounds follow the logarithm of the crowd."""
    pick = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"w{pick.randrange(9000)}" for _ in range(40)) for _ in range(600)]
    rounds, found = [], shingles._leaders
    monkeypatch.setattr(shingles, "_leaders", lambda members, n: rounds.append(n) or found(members, n))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert shingles.representatives(df).count() == 600 and 0 < len(rounds) <= 5


def plain_rules(text):
    """The line rules in plain Python: the cleaned text, or None."""
    words = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    text = text or ""
    every = words(text)
    triples = [tuple(every[i : i + 3]) for i in range(len(every) - 2)]
    twice = Counter(triples)
    repeated = {i + k for i, t in enumerate(triples) if twice[t] > 1 for k in range(3)}
    if len(every) < 50 or 100 * len(repeated) > 50 * len(every):
        return None
    seen, kept, lost, size = set(), [], 0, 0
    for line in text.split("\n"):
        w = words(line)
        chars, bars, n = sum(map(len, w)), len(re.findall("[|»›•]", line)), len(w)
        fails = n > 0 and (
            10 * len(re.findall("[#*$%&|<>]", line)) > chars
            or (bars >= 2 and 4 * bars >= n)
            or (n <= 12 and re.search(rf"(?i)^\s*(?:{lines._MENU})(?:\s+(?:{lines._MENU}))*\s*$", line))
            or (n >= 5 and line.upper() == line != line.lower())
            or (n >= 10 and 3 * len(set(w)) < n)
            or (n <= 30 and re.search(rf"\b(?:{lines._BOILERPLATE})", line.lower(), re.A))
            or (n >= 60 and not re.search("[.!?,;:…。、]", line))
            or line in seen
        )
        seen.add(line)
        size += chars
        lost += chars if fails else 0
        kept += [] if fails else [line]
    return "\n".join(kept) if lost <= 0.5 * size else None


def test_run_equals_a_plain_chain(spark, tmp_path, messy):
    """corpus_pipeline.run against the same decisions taken one document at a time."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    odd = messy.select("doc_id", "text").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(None).cast("long")})
    docs = given.union(odd).union(given.where("doc_id < 9"))  # odd rows and repeated ones
    # junk in sentences, so that only the classifier can tell it; two in three are labelled
    pick = random.Random(2)
    junk = [(9000 + i, "\n".join(" ".join(f"qxv{pick.randrange(400)}zk" for _ in range(9)) + "." for _ in range(30)), "en", "s", 1) for i in range(90)]
    prose = [line for (t,) in given.where("lang = 'en' and n_chars > 900").select("text").limit(12).collect() for line in t.split("\n")]
    keys = [(9500 + i, "\n".join([*pick.sample(prose, min(12, len(prose))), f'She said so: token = "{pick.getrandbits(160):040x}" and went.']), "en", "s", 1) for i in range(3)]
    docs = docs.union(spark.createDataFrame(junk + keys, docs.schema))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels = labels.union(spark.createDataFrame([(9000 + i, 0, 0) for i in range(90) if i % 3], labels.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = docs.collect()
    clean = [(r.doc_id, t) for r in rows if (t := plain_rules(r.text)) is not None]
    scores = quality._scorer(quality.train(quality.sample(docs, labels)))(pa.array([t for _, t in clean]))
    good = [x for x, s in zip(clean, scores) if s >= quality.THRESHOLD]
    assert 100 < len(good) < len(clean) < len(rows)
    left = {p.doc_id for p in pieces}
    texts = {i: t for i, t in good if i in left}
    assert left == set(texts) and len(left) < len(good)
    one_of_each_group(good, list(texts.items()))
    found = secrets.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).where("is_secret").collect()
    for r in sorted(found, key=lambda r: -len(r.candidate)):
        texts[r.doc_id] = texts[r.doc_id].replace(r.candidate, secrets.MARK)
    assert found and all(r.candidate not in texts[r.doc_id] for r in found)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in texts.items()}
    pieces_are_whole(pieces, {(i, len(x)): x for i, x in want.items()})


def test_run_of_nothing(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_suffix_array_is_in_order_with_common_prefixes(spark):
    import random

    rng = random.Random(4)
    rows = [(k, f"http://h{k % 3}.org/{k}", " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for k in range(300)]
    read = spark.createDataFrame(rows, "row long, url string, outside string").repartition(3)
    everything = np.full(1 << 13, 255, np.uint8)
    array = pages.suffix_array(pages._cut_suffixes(read, everything)).withColumn("part", F.spark_partition_id()).collect()

    counts, tokens = {}, lambda s: [s[i : i + 8] for i in range(0, len(s), 8)]
    for _, url, text in rows:
        host, h = pages._stream(url, text)
        words = [int(x).to_bytes(8, "big") for x in h]
        for s in {b"".join(words[i : i + pages.RUN]) for i in range(len(words) - pages.RUN + 1)}:
            counts[host, s] = counts.get((host, s), 0) + 1
    got = {}
    for r in array:
        got[r.host, bytes(r.suffix)] = got.get((r.host, bytes(r.suffix)), 0) + r.pages
    assert got == counts
    for a, b in zip(array, array[1:]):
        if a.part == b.part:
            assert (a.host, bytes(a.suffix)) <= (b.host, bytes(b.suffix))
            same = [x == y for x, y in zip(tokens(bytes(a.suffix)), tokens(bytes(b.suffix)))] + [False]
            assert b.lcp == (same.index(False) if a.host == b.host else 0)
    keys = {r.key for r in array if counts[r.host, bytes(r.suffix)] > 1}
    runs = [r.key for r in pages._runs(pages.suffix_array(pages._cut_suffixes(read, everything))).collect()]
    assert set(runs) == keys and len(runs) == len(keys)


def test_a_crowd_of_half_alike_texts_leaves_few_pairs(spark, monkeypatch):
    """Pairs that share a bucket but too few minima don't leave the bucket's join."""
    pick = random.Random(8)
    base = [f"p{i}" for i in range(120)]
    texts = [" ".join(w if pick.random() > 0.09 else f"x{pick.randrange(10**9)}" for w in base) for _ in range(300)]
    made, kept = [], shingles.stored

    def spy(df, label):
        out = kept(df, label)
        if label == "pairs":
            made.append((df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner"), out.count()))
        return out

    monkeypatch.setattr(shingles, "stored", spy)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = [slow_shingles(r.text) for r in shingles.representatives(df).collect()]
    assert not any(len(x & y) >= 0.8 * len(x | y) for i, x in enumerate(left) for y in left[:i]) and len(left) > 200
    least = [shingles.minima(shingles.shingles(t.encode())) for t in texts]
    agree = [(x == y) for i, x in enumerate(least) for y in least[:i]]
    meet = sum(a.reshape(shingles.BANDS, shingles.ROWS).all(axis=1).any() for a in agree)
    assert all(joins == 1 for joins, _ in made)
    assert sum(n for _, n in made) < meet / 2


def test_bands_tell_equal_minima(spark):
    rng = np.random.default_rng(3)
    one = rng.integers(0, 2**64, (50, 100), dtype=np.uint64)
    other = np.where(rng.random((50, 100)) < rng.random((50, 1)), one, rng.integers(0, 2**64, (50, 100), dtype=np.uint64))
    rows = [([int(v) for v in shingles.bands(x)], [int(v) for v in shingles.bands(y)], int((x == y).sum())) for x, y in zip(one, other)]
    rows.append((rows[0][0], rows[0][0], 100))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, same int").select("same", shingles._agreeing(F.col("x"), F.col("y")).alias("got"))
    assert all(r.same <= r.got <= r.same + 2 for r in df.collect())


def test_a_crowd_below_the_similarity_leaves_hardly_a_pair(spark, monkeypatch):
    """Pairs that agree in half of the minima and can't reach the similarity don't leave the bucket's join."""
    pick = random.Random(9)
    base = [f"p{i}" for i in range(120)]
    texts = [" ".join(w if pick.random() > 0.045 else f"x{pick.randrange(10**9)}" for w in base) for _ in range(200)]
    made, kept = [], shingles.stored

    def spy(df, label):
        out = kept(df, label)
        if label == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(shingles, "stored", spy)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = [slow_shingles(r.text) for r in shingles.representatives(df).collect()]
    assert not any(len(x & y) >= 0.8 * len(x | y) for i, x in enumerate(left) for y in left[:i])
    least = [shingles.minima(shingles.shingles(t.encode())) for t in texts]
    agree = sum((x == y).sum() >= shingles.AGREE for i, x in enumerate(least) for y in least[:i])
    assert len(left) > 20 and agree > 5000 and sum(made) < agree / 10


def test_masks_never_tell_more_than_the_sets(spark):
    rng = np.random.default_rng(4)
    rows = []
    for n in (1, 2, 5, 31, 32, 33, 64, 120, 300, 1024, 1030, 3000):
        for share in (0.0, 0.5, 0.8, 0.9, 1.0):
            x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            for m in {n, max(1, n * 4 // 5), n + n // 4, 3 * n}:
                y = np.unique(np.r_[x[: int(share * min(n, m))], rng.integers(0, 2**64, m - int(share * min(n, m)), dtype=np.uint64)])
                rows.append(([int(v) for v in shingles.mask(x)], [int(v) for v in shingles.mask(y)], len(np.setxor1d(x, y)), len(x), len(y)))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, apart int, n int, m int")
    got = df.withColumn("least", shingles._unshared(F.col("x"), F.col("y"))).collect()
    assert all(0 <= r.least <= r.apart and (r.apart - r.least) % 2 == 0 for r in got if max(len(r.x), len(r.y)) <= 2 * min(len(r.x), len(r.y)))
    assert all(r.least == 0 for r in got if max(len(r.x), len(r.y)) > 2 * min(len(r.x), len(r.y)))
    near = [r for r in got if 0.7 * max(r.n, r.m) <= min(r.n, r.m) and 50 < r.n and r.apart < 0.3 * (r.n + r.m)]
    assert sum(r.apart for r in near) > 1000 and sum(r.least for r in near) > 0.6 * sum(r.apart for r in near)


def test_few_links_are_read_by_few_tasks(spark):
    """Components of a small graph don't keep the shuffle's width from round to round."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        chain = spark.createDataFrame([(i, i + 1) for i in range(100) if i % 10 != 9], "a long, b long")
        got = components(chain)
        assert {(r.node, r.label) for r in got.collect()} == {(i, i // 10 * 10) for i in range(100)}
        assert "RDD" not in got._jdf.queryExecution().optimizedPlan().toString()  # a checkpoint has as many partitions as the shuffle
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_words_of_articles_are_in_the_suffix_array(spark):
    """Runs equal brute force over all words of a host's pages, and a menu known from one page goes from articles."""
    pick = random.Random(21)
    menu = "home news weather sports culture travel money letters about contact"
    links = "".join(f"<a href=/{w}>{w}</a> " for w in menu.split())
    shared = [" ".join(f"s{j}x{k}" for k in range(pick.randint(6, 14))) for j in range(9)]

    def words():
        return " ".join(pick.choice(shared) if pick.random() < 0.6 else f"u{pick.randrange(30)}" for _ in range(pick.randint(0, 5)))

    pages_, plain = [], []
    for i in range(80):
        inside, outside = [words() for _ in range(pick.randint(0, 3))], [words() for _ in range(2)]
        url = f"http://h{i % 5}.example/{i}"
        article = f"<article>{''.join(f'<p>{t}</p>' for t in inside)}</article>"
        pages_.append((i, url, f"<div>{outside[0]}</div>{article}<nav>{outside[1]}</nav>", None))
        plain.append((url.split("/")[2], *(" ".join(t for t in x if t).split() for x in (outside, inside))))
    df = spark.createDataFrame(pages_, "row long, url string, html string, page_id string").select("row", "page_id", "url", "html")
    read = pages._read(df.repartition(4), "string")
    held = {}
    for i, (host, *streams) in enumerate(plain):
        for outside, s in zip((True, False), streams):
            for k in range(len(s) - pages.RUN + 1):
                held.setdefault((host, *s[k : k + pages.RUN]), {}).setdefault(i, set()).add(outside)
    want = {int(pages._keys(h, pages._stream(None, " ".join(s))[1], pages.RUN)[0]): sum(True in x for x in on.values()) for (h, *s), on in held.items() if len(on) > 1}
    least = pages._bits(pages._counted(read).cache(), "key")
    found = pages._bits(pages._counted(read, least).cache(), "key")
    got = [tuple(r) for r in pages._runs(pages.suffix_array(pages._cut_suffixes(read, least, found))).collect()]
    assert dict(got) == want and len(got) == len(want) and 0 in want.values() and 1 in want.values()

    own = [" ".join(f"own{i}x{k}" for k in range(30)) for i in range(9)]
    rows = [(i, f"http://h.example/{i}", f"<article><p>{own[i]}</p><div>{links}</div></article>") for i in range(6)]
    rows += [(6, "http://h.example/", f"<nav>{links}</nav><article><p>{own[6]}</p></article>")]  # the menu stands outside on this page only
    rows += [(7, "http://h.example/list", f"<div>{own[0]}</div><div>{own[7]}</div>")]  # an article's words on a page without one
    rows += [(8, "http://other.example/", f"<article><p>{own[8]}</p><div>{links}</div></article>")]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: own[i] for i in range(7)} | {7: f"{own[0]}\n{own[7]}", 8: f"{own[8]}\n{menu}"}
