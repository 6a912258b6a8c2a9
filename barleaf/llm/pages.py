"""Main text of web pages: markup zones and a host's suffix array.

A page is read once into blocks of text in page order, each in a zone: ``main``
(inside the article), ``noise`` (inside menus, page headers, footers, sidebars,
notices, adverts, forms, reader comments) or ``open`` (neither).

Repetition judges what markup leaves open.  The words outside articles and the
words of articles make a page's two token streams, and all streams of a host are put
into one suffix array, cut at ``RUN`` tokens: suffixes are sorted by host and tokens
in ranges, so no task holds a host, and each is given the length of the prefix it
shares with the one before it.  Neighbours that share ``RUN`` tokens and lie on two
pages or more together are a run of the host, and it is counted on how many of them
it stands outside articles; overlapping places of runs on a page add up to the long ones.

* On pages that mark no article, open blocks covered by runs that stand outside
  articles on two pages or more are boilerplate, the others are kept.
* Inside articles a block goes only on two grounds together: its words stand in
  runs of the host that also stand outside an article, be it on one page, and more
  than half of it is link text (a menu, a share bar).  Prose stays however often it
  repeats: no count of pages removes a sentence of an article.

Covered means that more than ``SHARE`` of a block's tokens lie in runs; a block
shorter than ``RUN`` tokens is covered only as part of a longer run.

Traffic.  Nearly all suffixes are found once.  Equal suffixes hold the same
least ``GRAM``-token key, so these least keys are counted first, dealt into ranges
four bytes each, then the keys of the suffixes whose least key is on two pages or
more, and only suffixes that pass both are dealt out.  What is repeated goes back to the tasks as bits, sixteen for each repeated key
and ``MOST_BITS`` at most; a chance hit costs traffic, never changes a result, because
the array and the join on whole keys decide.  The text of pages without a block to
judge is written by the first pass; their words are in the array like all others.

Skew.  A run in a third of all pages reaches a reducer as one partial row per
slice of 256 pages; joining runs back to pages is an equi-join that adaptive
execution can split.

Edge cases.  Null and empty html have empty text.  A null url is a host of its
own name.  Unclosed and stray tags are tolerated, and a page of any length or
markup is read in one pass; character references are decoded once.  Repeated
rows are separate pages (with the consequence that an article-less page given
twice is covered by its copy and kept only if it has nothing else: such pages
keep their open blocks).  Other columns are ignored.  Empty tables give an empty
result.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barleaf.llm.common import parts, stored

RUN = 8
GRAM = 4
SHARE = 0.5
#: Bits that tell the tasks which keys are repeated, at least and at most (32 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Keys that a task deals out together; suffixes a quarter of that.
DEALT = 1 << 20
MAIN, OPEN, NOISE = 0, 1, 2

# a quote opens a value only behind an equals sign, and a tag ends before the next unquoted "<"; nothing is tried twice
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^<>]*+>|<\?[^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>=]|=\s*+(?:"[^"]*"|'[^']*'|))*+)>|[^<]++|<""", re.S)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math", "select", "video", "audio", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_CLOSES_P = _BLOCK - {"button", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "summary"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_STOPS = {"ul", "ol", "dl", "table", "div", "article", "section", "nav", "main", "aside", "form", "header", "footer", "body"}
_NOISE_TAGS = {"nav", "aside", "footer", "form", "button", "menu", "dialog", "head"}
_NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
_NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|rail|footer|foot|masthead|site-?header|page-?header|cookies?|consent|gdpr|notice|newsletter|subscri\w+|signup|sign-up|login"
    r"|share|sharing|social|related|recommend\w*|comments?|commentlist|respond|reply|replies|disqus|popup|modal|overlay|widget\w*|toolbar|pagination|pager|skip-?link|search\w*|form)(?:$|[\s_-])",
    re.I,
)
_MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main)[_-]?(?:body|text|content)(?:$|[\s_-])|(?:^|\s)(?:article|post|story)(?:$|\s)", re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


#: Text elements: their class names say how they look, not what they are.
_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}


def _zone(tag: str, attributes: str, outer: int) -> int:
    """Zone of an element's inside, given the zone around it; noise stays noise."""
    if outer == NOISE:
        return NOISE
    if tag in _NOISE_TAGS or tag == "header" and outer != MAIN:
        return NOISE
    if "=" in attributes or "hidden" in attributes:
        told = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        names = f"{told.get('class', '')} {told.get('id', '')}"
        role = told.get("role", "").lower()
        named = _NOISE_NAMES.search(names) and not (outer == MAIN and tag in _TEXT)
        if role in _NOISE_ROLES or named or told.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|\s)hidden(?:\s|$|=)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
            return NOISE if tag not in ("html", "body") else outer
        if role in ("main", "article") or told.get("itemprop", "").lower() == "articlebody" or tag not in ("html", "body") and _MAIN_NAMES.search(names):
            return MAIN
    return MAIN if tag in ("article", "main") else outer


def blocks(page: str | None) -> list[tuple[int, str, bool]]:
    """``(zone, text, linked)`` of a page's blocks in page order; linked if more than half of the text is in links."""
    out: list[tuple[int, str, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = [("", OPEN)]
    opened: Counter[str] = Counter()
    endless: set[str] = set()  # raw elements that no closing tag follows
    links, in_links, size = 0, 0, 0

    def close() -> None:
        nonlocal in_links, size
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((stack[-1][1], text, 2 * in_links > size))
        in_links = size = 0

    def leave(to: int) -> None:
        for tag, _ in stack[to:]:
            opened[tag] -= 1
        del stack[to:]

    place = 0
    page = page or ""
    while place < len(page):
        m = _TOKEN.match(page, place)  # some alternative matches at every place
        place = m.end()
        tag = m[2]
        if tag is None:
            if not (m[0].startswith(("<!", "<?")) and m[0].endswith(">")) and not m[0].startswith("<!--"):
                held.append(m[0])
                seen = len(m[0].strip())
                size += seen
                in_links += seen if links else 0
            continue
        tag, ends = tag.lower(), bool(m[1])
        if tag in _RAW:
            if not ends and tag not in endless:
                end = re.compile(rf"</{tag}\s*+>", re.I).search(page, m.end())
                if end:
                    place = end.end()
                else:
                    endless.add(tag)
                    place = len(page) if tag in ("script", "style") else m.end()
            continue
        if tag == "a":
            links = 0 if ends else 1
        if tag == "br" or tag == "hr":
            close()
            continue
        if tag in _VOID:
            continue
        if ends:
            if opened[tag] > 0:
                at = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
                close()
                leave(at)
            elif tag in _BLOCK:
                close()
            continue
        block = tag in _BLOCK
        zone = _zone(tag, m[3], stack[-1][1])
        if not block and zone == stack[-1][1]:
            continue  # inline markup
        close()
        if tag in _CLOSES_P and stack[-1][0] == "p":
            leave(len(stack) - 1)
            zone = _zone(tag, m[3], stack[-1][1])
        if (same := _SAME.get(tag)) and any(opened[t] > 0 for t in same):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in same:
                    leave(i)
                    zone = _zone(tag, m[3], stack[-1][1])
                    break
                if stack[i][0] in _STOPS:
                    break
        if not m[3].endswith("/"):
            stack.append((tag, zone))
            opened[tag] += 1
    close()
    return out


def _keys(host: str, h: np.ndarray, run: int) -> np.ndarray:
    """Keys of a stream's suffixes: the host and the hashes of the first ``run`` tokens."""
    return _chained(np.full(len(h), xxhash.xxh64_intdigest(host), np.uint64), h, run)


def _chained(seed: np.ndarray, h: np.ndarray, run: int) -> np.ndarray:
    n = max(0, len(h) - run + 1)
    key = seed[:n]
    with np.errstate(over="ignore"):
        for k in range(run):
            key = (key ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


class Told(dict):
    """Hashes of words, each made once."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _stream(url: str | None, text: str, told: Told | None = None) -> tuple[str, np.ndarray]:
    """A page's host and the hashes of its tokens, which stand between blanks and line ends."""
    m = _HOST.match(url or "")
    host = (m[1] if m else url or "").lower()
    words = text.replace("\n", " ").split(" ") if text else []
    return host, np.fromiter(map((Told() if told is None else told).__getitem__, words), np.uint64, len(words))


def _suffixes(host: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, least)`` of a stream's suffixes: their keys and their least ``GRAM``-token keys."""
    keys = _keys(host, h, RUN)
    least = np.lib.stride_tricks.sliding_window_view(_keys(host, h, GRAM), RUN - GRAM + 1).min(axis=1) if len(keys) else keys
    return keys, least


def _bits(df: DataFrame, key: str) -> np.ndarray:
    """Bits of the slots that ``key``'s values fall in; their number follows the rows."""
    n = df.count()
    slots = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
    slot = F.col(key).bitwiseAND(F.lit(slots - 1)) + 1
    rows = df.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    out = np.zeros(slots // 8, np.uint8)
    for r in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        at = (r.bucket - 1) * len(r.bits)
        some = np.frombuffer(bytes(r.bits), np.uint8)[: len(out) - at]
        out[at : at + len(some)] = some
    return out


def _held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` fall in a slot that is set."""
    slot = keys & np.int64(8 * len(bits) - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)")


def _slices(batches):
    for batch in batches:
        for at in range(0, len(batch), 256):
            yield batch.slice(at, 256)


def _read(rows: DataFrame, id_kind: str) -> DataFrame:
    """Every page's words outside articles, its article, and the blocks to judge where markup alone doesn't decide."""

    def work(batches):
        for some in _slices(batches):
            found = [blocks(page) for page in some.column(3).to_pylist()]
            outside, inside, texts, zones = [], [], [], []
            for one in found:
                main = any(z == MAIN for z, _, _ in one)
                outside.append(" ".join(t for z, t, _ in one if z != MAIN))
                # in an article only blocks of links are open to judgement
                open_ = any(z == MAIN and linked for z, _, linked in one) if main else any(z == OPEN for z, _, _ in one)
                inside.append("\n".join(t for z, t, _ in one if z == MAIN))
                texts.append([t for _, t, _ in one] if open_ else None)
                zones.append([z + 3 * linked for z, _, linked in one] if open_ else None)
            columns = [pa.array(outside, pa.string()), pa.array(inside, pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(zones, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), *columns], ["row", "page_id", "url", "outside", "inside", "texts", "zones"])

    return rows.mapInArrow(work, f"row long, page_id {id_kind}, url string, outside string, inside string, texts array<string>, zones array<int>")


def _streams(read: DataFrame) -> DataFrame:
    """A page's url and its two token streams; without a column ``inside`` pages have no article."""
    return read.select("url", "outside", "inside" if "inside" in read.columns else F.lit("").alias("inside"))


def _windows(some: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hosts and tokens of a slice of ``_streams``; and of every suffix stream, place, key and least key.

    Page i has the streams 2 i (outside articles) and 2 i + 1.
    """
    told, hosts, tokens = Told(), [], []
    for url, *texts in zip(*(some.column(i).to_pylist() for i in range(3))):
        for text in texts:
            host, h = _stream(url, text, told)
            tokens.append(h)
        hosts.append(host)
    stream = np.repeat(np.arange(len(tokens)), [len(h) for h in tokens])
    h = np.concatenate(tokens)
    seed = np.array([xxhash.xxh64_intdigest(host) for host in hosts], np.uint64)[stream // 2]
    n = max(0, len(h) - RUN + 1)
    at = np.flatnonzero(stream[:n] == stream[len(h) - n :])
    grams = _chained(seed, h, GRAM)
    least = np.min([grams[k : k + n] for k in range(RUN - GRAM + 1)], axis=0)
    return hosts, h, stream[at], at, _chained(seed, h, RUN)[at], least[at]


def _once(key: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """Of equal keys of a page the first one, in the order of the keys."""
    order = np.lexsort((stream, key))
    key, page = key[order], stream[order] // 2
    return order[np.r_[True, (key[1:] != key[:-1]) | (page[1:] != page[:-1])]] if len(order) else order


def _counted(read: DataFrame, repeated: np.ndarray | None = None) -> DataFrame:
    """``key``: the lower halves of keys that two pages or more hold: the sieves before the array.

    Of least ``GRAM``-token keys, or of the keys of the suffixes whose least key is in ``repeated``.  Keys that share
    a range and a lower half count as one; that only lets more through.
    """
    ranges = np.uint64(4 * parts(read.sparkSession))
    repeated = None if repeated is None else repeated.tobytes()

    def dealt(batches):
        # keys of some slices, once for each page that holds them
        held, size = [], 0

        def closed():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            place, low = ((keys >> np.uint64(32)) * ranges >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)
            edges = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
            rows = [(int(place[a]), low[a:b].tobytes(), np.packbits(n[a:b] > 1).tobytes()) for a, b in zip(edges[:-1], edges[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["place", "low", "more"])

        for some in _slices(batches):
            _, _, stream, _, key, least = _windows(some)
            if repeated is None:
                key = least
            else:
                passed = _held(np.frombuffer(repeated, np.uint8), least)
                key, stream = key[passed], stream[passed]
            held.append(key[_once(key, stream)].view(np.uint64))
            size += len(held[-1])
            if size > DEALT:
                yield from closed()
                held, size = [], 0
        if held:
            yield from closed()

    def answered(batches):
        def answer(blocks):
            low, more = (np.concatenate(x) for x in zip(*blocks))
            keys, first, n = np.unique(low, return_index=True, return_counts=True)
            some = np.r_[keys[n > 1], low[more]]
            return pa.RecordBatch.from_arrays([pa.array(np.unique(some).astype(np.int64))], ["key"])

        at, blocks = None, []
        for batch in batches:
            for place, low, more in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if place != at and blocks:
                    yield answer(blocks)
                    blocks = []
                at, low = place, np.frombuffer(low, np.uint32)
                blocks.append((low, np.unpackbits(np.frombuffer(more, np.uint8), count=len(low)).astype(bool)))
        if blocks:
            yield answer(blocks)

    rows = _streams(read).mapInArrow(dealt, "place long, low binary, more binary")
    return rows.repartition(parts(read.sparkSession), "place").sortWithinPartitions("place").mapInArrow(answered, "key long")


def _cut_suffixes(read: DataFrame, repeated: np.ndarray, found: np.ndarray | None = None) -> DataFrame:
    """``(host, suffix, key, pages, outside)``: the suffixes that the sieves let through, cut at ``RUN`` tokens, once per some slices of pages.

    ``suffix`` holds the tokens' hashes, eight bytes each and the largest first, so bytes sort as tokens do.
    ``pages`` hold it, ``outside`` of them outside articles.
    """
    repeated, found = repeated.tobytes(), None if found is None else found.tobytes()

    def work(batches):
        held, size = [], 0  # of some slices: hosts, keys, which are outside articles, tokens

        def closed():
            hosts = [host for some, _, _, _ in held for host in some]
            keys, open_, cuts = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            _, first, number, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            outside = np.bincount(number, open_, len(first)).astype(np.int64)
            order = np.argsort(first)  # suffixes of a passage together, for their compression
            first = first[order]
            borders = np.arange(0, 8 * RUN * (len(first) + 1), 8 * RUN, dtype=np.int32)
            suffix = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(borders), pa.py_buffer(cuts[first].astype(">u8").tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array([hosts[i] for i in first.tolist()], pa.string()), suffix, pa.array(keys[first]), pa.array(n[order].astype(np.int64)), pa.array(outside[order])], ["host", "suffix", "key", "pages", "outside"])

        for some in _slices(batches):
            hosts, h, stream, at, key, least = _windows(some)
            passed = _held(np.frombuffer(repeated, np.uint8), least)
            if found is not None:
                passed &= _held(np.frombuffer(found, np.uint8), key)
            passed = np.flatnonzero(passed)
            # of a page's equal suffixes the first is the one outside its article
            one = passed[np.sort(_once(key[passed], stream[passed]))]
            if not len(one):
                continue
            held.append(([hosts[i] for i in (stream[one] // 2).tolist()], key[one], stream[one] % 2 == 0, np.lib.stride_tricks.sliding_window_view(h, RUN)[at[one]]))
            size += len(one)
            if size > DEALT // 4:
                yield from closed()
                held, size = [], 0
        if held:
            yield from closed()

    return _streams(read).mapInArrow(work, "host string, suffix binary, key long, pages long, outside long")


def suffix_array(cuts: DataFrame) -> DataFrame:
    """``cuts`` in the order of (host, suffix) with ``lcp``, the tokens that each suffix shares with the one before it.

    Ranges of the order are tasks.  Equal suffixes lie in one range, so the first
    of a range shares less than ``RUN`` tokens with the end of the range before; its lcp is given as 0.
    """

    def work(batches):
        before, last = None, np.zeros((1, RUN), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").reshape(-1, RUN)
            hosts = np.array([before, *batch.column(0).to_pylist()], object)
            same = np.cumprod(tokens == np.concatenate([last, tokens[:-1]]), axis=1).sum(axis=1)
            lcp = np.where((hosts[1:] == hosts[:-1]).astype(bool), same, 0)
            before, last = hosts[-1], tokens[-1:]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lcp.astype(np.int32))], [*batch.schema.names, "lcp"])

    lined = cuts.repartitionByRange("host", "suffix").sortWithinPartitions("host", "suffix")
    return lined.mapInArrow(work, "host string, suffix binary, key long, pages long, outside long, lcp int")


def _runs(array: DataFrame) -> DataFrame:
    """``(key, outside)`` of the array's runs: neighbours with an lcp of ``RUN``, on two pages or more together, ``outside`` of them outside articles."""

    def work(batches):
        run = [np.zeros(0, np.int64)] * 3  # key, pages and outside of the run that is still open

        def told(key, pages, outside):
            return pa.RecordBatch.from_arrays([pa.array(key[pages > 1]), pa.array(outside[pages > 1])], ["key", "outside"])

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(np.r_[np.ones(len(run[0]), bool), batch.column(3).to_numpy() < RUN])
            key, pages, outside = (np.r_[x, batch.column(i).to_numpy()] for i, x in enumerate(run))
            run = [key[starts], np.add.reduceat(pages, starts), np.add.reduceat(outside, starts)]
            yield told(*(x[:-1] for x in run))
            run = [x[-1:] for x in run]
        yield told(*run)

    return array.select("key", "pages", "outside", "lcp").mapInArrow(work, "key long, outside long")


def _judged(texts: list[str], zones: list[int]) -> list[int]:
    """Numbers of the blocks whose words are held against the runs: an article's blocks of links, or else all."""
    return [i for i, z in enumerate(zones) if z == MAIN + 3] if any(z % 3 == MAIN for z in zones) else list(range(len(texts)))


def _places(read: DataFrame, repeated: np.ndarray) -> DataFrame:
    """``(row, place, key, least)``: suffixes of the judged blocks that may be repeated, and on how many pages outside articles they must stand."""

    def work(batches):
        bits = np.frombuffer(repeated, np.uint8)
        for some in _slices(batches):
            out = [(np.zeros(0, np.int64),) * 4]
            for row, url, texts, zones in zip(*(some.column(i).to_pylist() for i in range(4))):
                keys = _suffixes(*_stream(url, " ".join(texts[i] for i in _judged(texts, zones))))[0]
                at = np.flatnonzero(_held(bits, keys))
                out.append((np.full(len(at), row), at, keys[at], np.full(len(at), 1 if any(z % 3 == MAIN for z in zones) else 2)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["row", "place", "key", "least"])

    repeated = repeated.tobytes()
    return read.where("texts is not null").select("row", "url", "texts", "zones").mapInArrow(work, "row long, place long, key long, least long")


def _chosen(zones: list[int], texts: list[str], places: list[int]) -> list[int]:
    """Numbers of the blocks to keep; runs start at ``places`` of the judged blocks' stream."""
    main = any(z % 3 == MAIN for z in zones)
    judged = _judged(texts, zones)
    asked = [i for i, z in enumerate(zones) if z % 3 == (MAIN if main else OPEN)]
    if not places:
        return asked
    sizes = {i: texts[i].count(" ") + 1 for i in judged}
    ends = dict(zip(judged, np.cumsum(list(sizes.values())).tolist()))
    step = np.zeros(sum(sizes.values()) + 1, np.int64)
    starts = np.array(places, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + RUN, -1)
    inside = np.r_[0, np.cumsum(np.cumsum(step[:-1]) > 0)]
    return [i for i in asked if i not in sizes or inside[ends[i]] - inside[ends[i] - sizes[i]] <= SHARE * sizes[i]] or asked


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``: one row for each input row."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    read = stored(_read(rows, kind), "pages")

    least = stored(_counted(read), "least")
    repeated = _bits(least, "key")
    found = stored(_counted(read, repeated), "found")
    cuts = stored(_cut_suffixes(read, repeated, _bits(found, "key")), "suffixes")
    runs = stored(_runs(suffix_array(cuts)), "runs")
    # a run that stands in articles only is prose, or links that nothing tells from an article's own
    runs = runs.where("outside > 0")
    hits = _places(read, _bits(runs, "key")).join(runs, "key").where("outside >= least").groupBy("row").agg(F.collect_list("place").alias("places"))

    def work(batches):
        for some in _slices(batches):
            out = []
            for texts, zones, places in zip(*(some.column(i).to_pylist() for i in (2, 3, 4))):
                out.append("\n".join(texts[i] for i in _chosen(zones, texts, places or [])))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    judged = read.where("texts is not null").join(hits, "row", "left").select("page_id", "url", "texts", "zones", "places").mapInArrow(work, f"page_id {kind}, url string, text string")
    return read.where("texts is null").select("page_id", "url", F.col("inside").alias("text")).union(judged).withColumn("n_chars", F.length("text").cast("long"))
