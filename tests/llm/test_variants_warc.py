"""Spelling variants and archives against brute force and known answers."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barleaf.llm import variants, warc
from barleaf.llm.common import fresh

# ---- spelling variants ---------------------------------------------------------


def slow_edits(a, b):
    """Edit distance by the full table."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def slow_variants(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and slow_edits(v, w) == 1] for w in n}
    form = {w: best for w in n if near[w] and n[best := min(near[w], key=lambda v: (-n[v], v))] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return Counter((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def misspelled(seed, size):
    pick = random.Random(seed)
    words = ["".join(pick.choice("abcdeé") for _ in range(pick.randint(4, 9))) for _ in range(25)] + ["x" * 150, "x" * 149 + "y", "x" * 151, "bAÉcd×", "aaaaa"]
    out = []
    for i in range(size):
        w = list(pick.choice(words))
        for _ in range(pick.choice([0, 0, 0, 1, 1, 2])):
            at = pick.randrange(len(w) + 1)
            w[at : at + pick.randint(0, 1)] = pick.choice(["", "a", "é", "Z"])
        out.append((pick.randrange(40), "".join(w)))
    return out


@pytest.mark.parametrize("home", [2048, 3])
def test_variants_match_brute_force(spark, home):
    rows = misspelled(5, 2500) + [(None, "Other others OTHER other"), (3, None), (3, ""), (4, "1 2 3 .")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ["word", "n", "key", "side", "root", "form", "chunk"]})
    got = variants.groups(docs, home=home)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = slow_variants(rows)
    assert Counter(map(tuple, got.collect())) == want
    assert sum(r[1] is not None for r in want) > 20


def test_chains_of_forms_end_at_their_root(spark):
    # a chain of eight words, each with twice the count of the one before
    chain = ["abcdefgh"[:i] + "zzzzzzzz"[i:] for i in range(9)]
    rows = [(1000, " ".join([w] * (3 * 2**i))) for i, w in enumerate(chain)]
    got = {r.word: r for r in variants.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {r[0]: r for r in slow_variants(rows)}
    assert {w: (r.form, r.root) for w, r in got.items()} == {w: (r[1], r[2]) for w, r in want.items()}
    assert len({r.root for r in got.values()}) < len(got)


def test_variants_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.groups(none).count() == 0
    assert variants.groups(spark.createDataFrame([(1, None), (None, "word")], "doc_id long, text string")).count() == 0


def test_large_counts_are_exact(spark):
    # counts whose squares pass single precision, one replaced letter apart
    a, b = "a" * 9000, "a" * 8999 + "b"
    docs = spark.createDataFrame([(1, f"{a} {a} {a} {b} {b} {b} {b} {b} {b}")], "doc_id long, text string")
    assert {r.word[-1]: (r.n_near, r.form and r.form[-1]) for r in variants.groups(docs).collect()} == {"a": (1, "b"), "b": (1, None)}


# ---- archives ------------------------------------------------------------------

PAGES = [
    (1, "http://a.org/x", "<p>one</p>"),
    (2, "http://a.org/y", "<p>one</p>"),
    (3, "http://b.org/", None),
    (4, None, ""),
    (5, "http://b.org/ a\r\nX: 1\n", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40),
    (6, "http://c.org/é", "é😀İ" * 5000 + "\n0\r\n\r\n"),
    (7, "http://c.org/", "é😀İ" * 5000 + "\n0\r\n\r\n"),
    (8, "http://c.org/", "é😀İ" * 5000 + "\n0\r\n\r\n "),
    (None, "http://d.org/", "<p>one</p>"),
    (None, "http://d.org/", "alone"),
    (9, "http://e.org/", "twice"),
    (9, "http://e.org/", "twice"),
    (10, "http://e.org/", "x" * 100),
    (10, "http://e.org/", "x" * 101),
]


def slow_inventory(pages):
    best = {}
    for i, _, html in pages:
        best[html or ""] = max(-1 if i is None else i, best.get(html or "", -1))
    out = Counter()
    for i, _, html in pages:
        data, last = (html or "").encode(), best[html or ""]
        last = None if last == -1 else last
        out[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == last else "revisit", None if i == last else last] += 1
    return out


@pytest.mark.parametrize("segment,chunk,per_file", [(warc.SEGMENT, warc.CHUNK, warc.PER_FILE), (97, 13, 3)])
def test_archives_round_trip(spark, segment, chunk, per_file):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ["value", "sha", "winner", "payload", "segment"]})
    folder = fresh(spark, "warc")
    warc.write(pages, folder, segment, chunk, per_file)
    back = warc.read(spark, folder).cache()
    rows = back.collect()
    assert all(r.complete for r in rows)
    assert Counter(tuple(r)[:5] for r in warc.inventory(back).collect()) == slow_inventory(PAGES)
    held = {bytes(r.payload).decode() for r in rows if r.record_type == "response"}
    assert held == {html or "" for _, _, html in PAGES}
    assert {r.target_uri for r in rows if r.page_id == 5} == {"http://b.org/%20a%0D%0AX:%201%0A"}


def test_archives_of_nothing(spark):
    folder = fresh(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.inventory(warc.read(spark, folder)).count() == 0


def test_files_are_plain_archives(spark):
    """Parsed here by hand: every record is its header, a block of the stated length and two line ends."""
    folder = fresh(spark, "warc")
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), folder, 97, 13, 10)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(folder).collect()]
    kinds = Counter()
    for data in map(gzip.decompress, files):
        n = 0
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert head.startswith(b"WARC/1.1\r\n") and size <= 97 and rest[size : size + 4] == b"\r\n\r\n"
            kinds[re.search(rb"WARC-Type: (\w+)", head)[1].decode()] += 1
            data, n = rest[size + 4 :], n + 1
        assert n <= 10
    assert kinds["continuation"] > 100 and kinds["response"] + kinds["revisit"] == len(PAGES)


def archive(spark, *members):
    """Foreign files: given bytes, one file each."""
    folder = fresh(spark, "foreign")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for i, data in enumerate(members):
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(path, f"{i}.warc.gz"))
        out.write(bytearray(data))
        out.close()
    return folder


def test_segments_are_verified(spark):
    block = warc.HTTP + warc.chunked(b"abcdefghij" * 10, 7)
    a, b, c = block[:50], block[50:120], block[120:]
    first = warc.record("response", a, WARC_Record_ID="<urn:a>", Content_Type="application/http;msgtype=response", WARC_Segment_Number=1, Page_ID=1)
    rest = lambda n, x, total=None: warc.record("continuation", x, WARC_Record_ID=f"<urn:a{n}>", WARC_Segment_Origin_ID="<urn:a>", WARC_Segment_Number=n, WARC_Segment_Total_Length=total)
    two, three = rest(2, b), rest(3, c, len(block))
    end = b"\r\n\r\n"

    def found(*records):
        return [(r.payload and bytes(r.payload), r.complete) for r in warc.read(spark, archive(spark, *records)).collect()]

    # one file out of order, and one file per record, the first compressed record by record
    assert found(three + end + first + end + two + end) == [(b"abcdefghij" * 10, True)]
    assert found(gzip.compress(two + end) + gzip.compress(first + end), three + end) == [(b"abcdefghij" * 10, True)]
    assert found(first + end + three + end) == [(None, False)]  # a gap
    assert found(first + end + two + end) == [(None, False)]  # no last segment
    assert found(first + end + two + end + two + end + three + end) == [(None, False)]  # one twice
    assert found(first + end + two + end + rest(3, c, len(block) + 1) + end) == [(None, False)]  # another length
    assert found(first + end + two + end + rest(3, c[:-4] + b"1\r\n\r", len(block)) + end) == [(None, False)]  # broken framing


def test_foreign_records(spark):
    info = warc.record("warcinfo", b"software: x\r\n", WARC_Record_ID="<urn:i>", Content_Type="application/warc-fields")
    plain = warc.record("response", b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nbody", WARC_Record_ID="<urn:p>", Content_Type="application/http; msgtype=response")
    wrong = warc.record("response", b"HTTP/1.0 200 OK\r\n\r\nbody", WARC_Record_ID="<urn:w>", Content_Type="application/http", WARC_Payload_Digest="sha1:" + "A" * 32)
    got = warc.read(spark, archive(spark, b"".join(gzip.compress(r + b"\r\n\r\n") for r in (info, plain, wrong))))
    assert {(r.record_id, r.payload and bytes(r.payload), r.complete) for r in got.collect()} == {("<urn:i>", b"software: x\r\n", True), ("<urn:p>", b"body", True), ("<urn:w>", None, False)}
    with pytest.raises(ValueError):
        list(warc.records(plain[:-1]))
