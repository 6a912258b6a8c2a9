"""Line-first cleaning: judge every line, remove what fails, then judge the document.

A line with a word fails when it is navigation (a menu's separators, or a short
run of menu words), boilerplate (a licence, cookie, copyright or subscription
phrase in a line without much else), noise (symbols in place of prose), shouting
(nearly every letter a capital over several words), a stutter (one word over
and over), a long line without any punctuation, or a repeat of an earlier line.
A document is kept when its base rules hold and the failing lines hold at most
``MOST_LOST`` of its characters in words.

Everything is DataFrame functions over whole texts, one row in and one row out:
no shuffle, no Python, and a row's arrays are the only state.

Edge cases.  A null text has no words: its counts are zero and it fails the base
rules, as empty texts and texts of white space do.  Repeated rows and null ids
stay as they are; other columns are ignored by ``judge`` and kept by ``clean``.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LOST = 0.5
LEAST_WORDS = 50
_SPACE = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "[#*$%&|<>]"

_BOILERPLATE = (
    "licensed under|all rights reserved|terms of (use|service)|privacy policy|cookie(s| policy| settings)|accept cookies"
    "|copyright (©|\\(c\\)|[0-9])|powered by|subscribe to|sign up for|log ?in|follow us on|share (this|on)|click here|read more|back to top"
    "|tous droits réservés|mentions légales|alle rechte vorbehalten|datenschutz|todos los derechos|política de privacidad"
)
_MENU = "home|about|about us|contact|contact us|login|log in|sign in|register|search|menu|next|previous|sitemap|faq|help"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _repeated_words(words: Column) -> Column:
    """Number of words that lie in three-word windows found twice or more.

    Windows are sorted by hash and place; equal neighbours repeat.  A repeated
    window covers three words, fewer where the next one starts sooner.
    """

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeats(sorted_: Column) -> Column:
        same = F.transform(sorted_, lambda s, i: F.when((F.get(sorted_, i - 1)["h"] == s["h"]) | (F.get(sorted_, i + 1)["h"] == s["h"]), s["i"]))
        return F.array_sort(F.array_compact(same))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(starts, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def count(w: Column) -> Column:
        some = _let(windows(w), lambda x: F.when(F.size(F.array_distinct(F.transform(x, lambda s: s["h"]))) < F.size(x), _let(F.sort_array(x), lambda s: _let(repeats(s), covered))))
        return F.when(F.size(w) > 3, some)

    return F.coalesce(count(words), F.lit(0).cast("long"))


def _fails(line: Column, words: Column) -> Column:
    """Does a line fail a rule?  Lines without a word never do."""
    n = F.size(words)
    size = F.length(F.array_join(words, ""))
    symbols = F.length(line) - F.length(F.regexp_replace(line, _SYMBOLS, ""))
    bars = F.size(F.split(line, "[|»›•]")) - 1
    menu = (bars >= 2) & (bars * 4 >= n) | (n <= 12) & line.rlike(f"(?i)^\\s*(?:{_MENU})(?:\\s+(?:{_MENU}))*\\s*$")
    boilerplate = (n <= 30) & F.lower(line).rlike(f"\\b(?:{_BOILERPLATE})")
    shouting = (n >= 5) & (F.upper(line) == line) & (F.lower(line) != line)
    stutter = (n >= 10) & (F.size(F.array_distinct(words)) * 3 < n)
    endless = (n >= 60) & ~line.rlike("[.!?,;:…。、]")
    return (n > 0) & ((symbols * 10 > size) | menu | shouting | stutter | boilerplate | endless)


def _line_repeats(lines: Column) -> Column:
    """For each line: does it equal an earlier one?  Null where no line does."""

    def flags(sorted_: Column) -> Column:
        told = F.transform(sorted_, lambda s, k: F.struct(s["i"].alias("i"), F.coalesce(F.get(sorted_, k - 1)["h"] == s["h"], F.lit(False)).alias("again")))
        return F.transform(F.sort_array(told), lambda t: t["again"])

    placed = F.transform(lines, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(lines)) < F.size(lines), _let(F.sort_array(placed), flags))


def _lines(text: Column) -> Column:
    """``struct(n_dup_lines, lost, cleaned)`` of one text."""

    def told(lines: Column) -> Column:
        def judged(again: Column) -> Column:
            def one(line: Column, i: Column) -> Column:
                return _let(_words(line), lambda w: F.struct(line.alias("line"), F.length(F.array_join(w, "")).alias("size"), (_fails(line, w) | F.coalesce(F.get(again, i), F.lit(False)) & (F.size(w) > 0)).alias("fails")))

            return F.transform(lines, one)

        return _let(_let(_line_repeats(lines), judged), summed)

    def summed(rows: Column) -> Column:
        lost = F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + F.when(r["fails"], r["size"]).otherwise(0))
        cleaned = F.array_join(F.transform(F.filter(rows, lambda r: ~r["fails"]), lambda r: r["line"]), "\n")
        worded = F.transform(F.filter(rows, lambda r: r["size"] > 0), lambda r: r["line"])
        dup = _let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        return F.struct(dup.cast("long").alias("n_dup_lines"), lost.alias("lost"), cleaned.alias("cleaned"))

    return _let(F.split(text, "\n"), told)


def _judged(rows: DataFrame, text: str, most_lost: float) -> DataFrame:
    """Adds the counts, the verdicts and the cleaned text to rows whose ``text`` is not null."""
    t = F.col(text)
    counts = _let(_words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated_words(w).alias("n_repeat_words")))
    symbols = (F.length(t) - F.length(F.regexp_replace(t, _SYMBOLS, ""))).cast("long")
    rows = rows.withColumns({"_counts": counts, "_lines": _lines(t), "_symbols": symbols})
    rows = rows.select("*", "_counts.*", F.col("_symbols").alias("n_symbols"), "_lines.*").drop("_counts", "_lines", "_symbols")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= most_lost * F.col("word_chars")))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """One row per input row: base counts, ``base_failed``, ``kept``, characters lost, cleaned text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return _judged(rows, "text", most_lost).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost", "cleaned")


def clean(docs: DataFrame, text: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """The kept rows with all their columns, failing lines removed from ``text``."""
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kept = _judged(rows, "_text", most_lost).where("kept")
    return kept.select(*(F.col("cleaned").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns))
