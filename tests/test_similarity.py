"""Set-similarity joins against brute force, and hot tokens."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from barleaf.operators import similarity as S
from barleaf.operators import texts
from tests.test_known_answers import greedy


def drawn(seed, n, vocabulary=60, most=25):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    out = []
    for i in range(n):
        mine = set(pick.choices(words, weights, k=pick.randint(0, most)))
        if out and i % 3 == 0:  # a near copy
            mine = set(pick.choice(out)) ^ set(pick.sample(words, pick.randint(0, 2)))
        out.append(sorted(mine))
    return out


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.8, 0.9, 1.0])
@pytest.mark.parametrize("cell", [4096, 5])
def test_pairs_equal_brute_force(spark, monkeypatch, threshold, cell):
    monkeypatch.setattr(S, "CELL", cell)
    left, right = drawn(1, 120), drawn(2, 60) + drawn(1, 40)
    frame = lambda rows, name: spark.createDataFrame([(i % 2 == 0, i, t) for i, t in enumerate(rows)], f"half boolean, {name} long, tokens array<string>")
    got = {(r.a, r.b): r.jaccard for r in S.similar(frame(left, "a"), frame(right, "b"), "a", "b", threshold, ["half"]).collect()}
    want = {(i, j): len(set(x) & set(y)) / len(set(x) | set(y)) for (i, x), (j, y) in itertools.product(enumerate(left), enumerate(right)) if i % 2 == j % 2 and x and y}
    want = {k: v for k, v in want.items() if v >= threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and want


def test_masks_bound_the_difference(spark):
    rows = drawn(3, 80, 400, 300)
    sets = S.masked(spark.createDataFrame(list(enumerate(rows)), "id long, tokens array<string>")).collect()
    bits = {r.id: sum((r[m] & (1 << 64) - 1) << 64 * k for k, m in enumerate(S.MASKS)) for r in sets}
    assert any(bits.values()) and all((bits[i] ^ bits[j]).bit_count() <= len(set(rows[i]) ^ set(rows[j])) for i, j in itertools.combinations(bits, 2))


def test_empty_sides(spark):
    none = spark.createDataFrame([], "a long, tokens array<string>")
    some = spark.createDataFrame([(1, ["x"]), (2, [])], "b long, tokens array<string>")
    assert S.similar(none, some, "a", "b", 0.5).count() == 0
    assert S.similar(some.withColumnRenamed("b", "a"), some, "a", "b", 0.5).count() == 1


def counted_rounds(monkeypatch):
    rounds = []
    found = texts.earliest
    monkeypatch.setattr(texts, "earliest", lambda postings, n: rounds.append(n) or found(postings, n))
    return rounds


def test_one_token_in_a_third_of_all_articles(spark, monkeypatch):
    """6,667 of 20,000 distinct sets meet in one token's group, and none of them are alike."""
    pick = random.Random(7)
    common = [f"c{i:02d}" for i in range(22)]
    seen, rows = set(), []
    while len(rows) < 20000:
        hot = len(rows) % 3 == 0
        mine = frozenset(["hot", *pick.sample(common, 7)] if hot else pick.sample(common, 8))
        if mine not in seen:
            seen.add(mine)
            rows.append(("A", len(rows), " ".join(sorted(mine))))
    near = [("A", 20000 + i, text) for i, (_, _, text) in enumerate(rows[:30])]  # copies go
    rounds = counted_rounds(monkeypatch)
    df = spark.createDataFrame(rows + near, "ticker string, id long, text string").repartition(8)
    assert sorted(r.id for r in texts.near_copies(df).collect()) == [i for _, i, _ in near]
    assert len(rounds) <= 6


def test_a_large_group_of_near_copies_is_decided_at_once(spark, monkeypatch):
    """Every article differs from its base in two of 60 words; the job count does not follow the group."""
    words = [f"w{i:02d}" for i in range(60)]
    spans = []
    for size in (200, 1200):
        rows = [("A", i, [*[w for k, w in enumerate(words) if k != i % 60], f"x{i}"]) for i in range(size)] + [("B", i, [f"y{i}", f"z{i}", "w01"]) for i in range(50)]
        rounds = counted_rounds(monkeypatch)
        df = spark.createDataFrame([(t, i, " ".join(w)) for t, i, w in rows], "ticker string, id long, text string")
        got = sorted((r.ticker, r.id) for r in texts.drop_near_copies(df).select("ticker", "id").collect())
        assert got == greedy(rows)
        spans.append(len(rounds))
        monkeypatch.undo()
    assert spans[0] == spans[1] == 1


@pytest.mark.parametrize("cell", [4096, 7])
def test_search_does_not_depend_on_the_cells(spark, monkeypatch, cell):
    """Retrieval against plain TF-IDF cosines, with a term that every document holds."""
    import math
    from collections import Counter

    monkeypatch.setattr(texts, "CELL", cell)
    pick = random.Random(3)
    docs = [("A" if i % 3 else "B", i, "common " + " ".join(pick.choices([f"w{k}" for k in range(30)], k=pick.randint(0, 12)))) for i in range(90)] + [("C", 500, "nothing here")]
    df = spark.createDataFrame(docs, "ticker string, id long, text string").selectExpr("*", "timestamp'2020-01-01' as known_at")
    query = "w1 w2 w1 unheard common"

    def grams(text):
        w = [x for x in text.split() if len(x) > 1]
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    want = {}
    for ticker in "AB":
        mine = {i: grams(t) for tk, i, t in docs if tk == ticker}
        q, n = grams(query), len(mine) + 1
        df_ = Counter(t for g in [*mine.values(), q] for t in g)
        idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df_.items()}
        size = lambda g: math.sqrt(sum((c * idf[t]) ** 2 for t, c in g.items()))  # noqa: B023, E731
        score = {i: sum(c * idf[t] * q.get(t, 0) * idf[t] for t, c in g.items()) / (size(g) * size(q)) for i, g in mine.items()}
        want[ticker] = sorted(((-s, i) for i, s in score.items() if s > 0))[:5]
    got = {}
    for r in texts.tfidf_search(df, query, 5).orderBy("ticker", "rank").collect():
        got.setdefault(r.ticker, []).append((-r.relevance, r.id))
    assert got.keys() == want.keys()
    for ticker, rows in want.items():
        assert [i for _, i in got[ticker]] == [i for _, i in rows] and all(abs(a - b) < 1e-9 for (a, _), (b, _) in zip(got[ticker], rows))


def test_a_search_stores_less_than_its_texts(spark, monkeypatch):
    """Postings stay out of the shared folder (they were several times the texts there), and pack many to a row."""
    from pathlib import Path

    from barleaf.session import shared_folder

    pick = random.Random(5)
    docs = [(f"T{i % 3}", i, " ".join(f"w{pick.randint(0, 3000)}" for _ in range(300))) for i in range(300)]
    df = spark.createDataFrame(docs, "ticker string, id long, text string").selectExpr("*", "timestamp'2020-01-01' as known_at")
    stored = lambda: sum(f.stat().st_size for f in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if f.is_file())
    before = stored()
    assert texts.tfidf_search(df, "w1 w2 w3", 4).count() == 12
    assert stored() - before < sum(len(t) for _, _, t in docs)

    monkeypatch.setattr(texts, "WORDS", 5000)
    lists = df.selectExpr("ticker", "101L as n", "7 as chunks", "id", "split(text, ' ') as words")
    rows = texts.packed_counts(lists).collect()
    want = {}
    for ticker, i, text in docs:
        w = text.split()
        for t in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
            want[ticker, i, t] = want.get((ticker, i, t), 0) + 1
    assert {(r.ticker, i, t): n for r in rows for t, i, n in zip(r.terms.split("\n"), r.ids, r["counts"])} == want
    assert len(rows) < len(want) / 20
    placed = {(r.ticker, t, r.chunk) for r in rows for t in r.terms.split("\n")}
    assert len(placed) == len({(k, t) for k, t, _ in placed})


def test_low_thresholds_move_whole_sets_once(spark):
    """At 0.1 prefixes are nearly the sets: their rows were exchanged several times, now a left set travels once, as one row."""
    left, right = drawn(1, 120), drawn(2, 60)
    frame = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, tokens array<string>")
    pairs = S.similar(frame(left, "a"), frame(right, "b").limit(60), "a", "b", 0.1)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and plan.count("Join Inner") == 1 and "sort" not in plan.lower()
    some = spark.createDataFrame([(1, [f"x{i}" for i in range(500)]), (2, ["x1"]), (3, [])], "a long, tokens array<string>")
    few = spark.createDataFrame([(1, [f"x{i}" for i in range(50)]), (2, []), (3, ["x1", "y"])], "b long, tokens array<string>")
    assert sorted(tuple(r) for r in S.similar(some, few, "a", "b", 0.1).collect()) == [(1, 1, 0.1), (2, 3, 0.5)]


def test_token_sets_of_odd_texts(spark):
    from barleaf.functions.text import IGNORED, token_set

    given = ["The cat's a CAT, the x y 'z 12 1 q''", "", None, "of AND to", "É ab éab İbc a'", "b a bb aa bb ''"]
    want = [sorted({w for w in re.findall("[a-z0-9']+", (t or "").lower()) if len(w) > 1 and w not in IGNORED}) for t in given]
    got = spark.createDataFrame(list(enumerate(given)), "i long, text string").select("i", token_set("text").alias("t")).collect()
    assert [r.t for r in sorted(got)] == want


def test_tokens_are_ranked_where_their_set_is(spark, monkeypatch):
    """Exploded tokens took two exchanges and two joins; now sets are dealt once, and any counts give right pairs."""
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "a long, tokens array<string>")
    left = [t for t in drawn(4, 120) if t]
    sets = frame(left)
    plan = S.prefixes(S.masked(sets), S.frequencies(sets).limit(9), ["a"], 0.5)._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Join Inner") == 1
    monkeypatch.setattr(S, "BUCKETS", 3)
    got = {(r.a, r.b) for r in S.similar(sets, frame(left).withColumnRenamed("a", "b"), "a", "b", 0.5).collect()}
    assert got == {(i, j) for (i, x), (j, y) in itertools.product(enumerate(left), repeat=2) if len(set(x) & set(y)) >= 0.5 * len(set(x) | set(y))}
