"""Main text of web pages, with a host's boilerplate found by suffix arrays.

A page is read once into blocks, each with the zone it stands in: `main` (inside
article, main or an element named so), `noise` (menus, headers, footers, sidebars, notices, adverts,
forms, comments, by element or by the words of class, id and role) or `open`
(markup doesn't say).  Where there is a main zone its blocks are the text.

For pages without one, the host decides: the pages' open blocks and the noise of
the host's other pages are laid out as one stream per host, strings of at least
`repeat_bytes` bytes that start in streams of two pages are found
with the suffix arrays of suffix.py (equal runs counted together, so a host with
a third of all pages is no single task), what they cover is removed, and the
unique runs stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.suffix import removed_runs, repeats
from tidegraph.storage import stage

#: HTML's element names by what they mean here.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NOISE = frozenset("nav footer aside form dialog menu button label fieldset".split())
RAW = frozenset("script style noscript template title textarea select iframe object svg math head canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark what isn't the article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "sidebar rail menu menubar navbar nav navigation breadcrumb breadcrumbs footer masthead comment comments commentlist discussion replies reply respond disqus "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup popup modal overlay widget pager pagination toolbar "
    "copyright login search skip contentinfo complementary topbar dialog legal disclaimer".split()
)
#: Words that begin or end a class, or are an id, of what isn't the article though inside it.
INSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent sidebar breadcrumb breadcrumbs menu navbar "
    "comment comments commentlist reply replies respond disqus share sharing social related recommended newsletter subscribe popup modal pager pagination".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Pairs of such words mark the article where there is no element for it.
MAIN_WORDS = frozenset("article articlebody".split())
MAIN_OF, MAIN_PART = frozenset("entry post story main page".split()), frozenset("content body text".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _noisy(name: str, attrs: str, inside: bool) -> bool:
    """Whether attributes say that an element isn't the article; inside it only plain names of parts do, and none of headings."""
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key not in ("class", "id", "role"):
            continue
        if inside:
            own = [_WORDS.findall(c) for c in value.split()]
            if name not in HEADINGS and any(c and (c[0] in INSIDE_WORDS or c[-1] in INSIDE_WORDS) and (key != "id" or len(c) == 1) for c in own):
                return True
            continue
        words = set(_WORDS.findall(value))
        if name in ("article", "main") and key != "role":
            words &= {"comment", "comments", "reply", "advert", "ad", "sponsored", "related"}
        if words & NOISE_WORDS or "header" in words:
            return True
    return False


def _holds_article(attrs: str) -> bool:
    """Whether class, id, role or itemprop say that the element is the article."""
    for key, value in _ATTR.findall(attrs):
        words = set(_WORDS.findall(value.lower()))
        key = key.lower()
        if key == "role" and words & {"main", "article"} or key in ("class", "id", "itemprop") and (words & MAIN_WORDS or words & MAIN_OF and words & MAIN_PART):
            return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of a page's blocks in page order, white space turned into one space, empty blocks left out."""
    out: list[tuple[str, str]] = []
    buf: list[str] = []
    stack: list[tuple[str, str]] = []
    zone, at = "open", 0

    def flush() -> None:
        if buf:
            text = _SPACE.sub(" ", html.unescape("".join(buf))).strip()
            if text:
                out.append((zone, text))
            buf.clear()

    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            buf.append(page[at:])
            break
        if m.start() > at:
            buf.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        attrs = m[3] or m[6] or ""
        if name in RAW and not closing:
            if not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                # never closed: a script and its like go to the end, as browsers have it; of others only the tag goes
                at = close.end() if close else end if name in ("script", "style", "title", "textarea") else at
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            buf.append(" ")
        if name in VOID or name in ("html", "body"):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush()
                    del stack[k:]
                    zone = stack[-1][1] if stack else "open"
                    break
            continue
        if name == "p" or name in BLOCK:  # an open paragraph ends where a block begins
            if stack and stack[-1][0] == "p":
                stack.pop()
                zone = stack[-1][1] if stack else "open"
        if name in ("article", "main") and zone == "noise":
            # noise that is never closed doesn't hold the article
            while stack and stack[-1][1] == "noise" and page.find(f"</{stack[-1][0]}", at) < 0:
                stack.pop()
            zone = stack[-1][1] if stack else "open"
        noisy = name in NOISE or name == "header" and zone != "main" or _noisy(name, attrs, zone == "main")
        own = "noise" if zone == "noise" or noisy else "main" if name in ("article", "main") or zone == "open" and attrs and name in BLOCK and _holds_article(attrs) else zone
        if name in BLOCK or own != zone:
            if own != zone:
                flush()
            stack.append((name, own))
            zone = own
    flush()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_SEP = "\n\n"


def extract(pages: DataFrame, repeat_bytes: int = 48) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text, n_chars, decided): decided is `markup` or `host`.

    Blocks are joined in page order by two newlines.  Null or empty html and
    pages of markup only give an empty text.  A null or odd url is the host "".
    Null and repeated page_ids are kept, one row per row.  Blocks in an open
    zone lose what the host repeats, see unique_runs.
    """
    spark = pages.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What hosts are judged by: the open blocks of pages without a main zone, and all pages' noise."""
        for b in batches:
            hosts, opens, noises = [], [], []
            for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = blocks(page or "")
                free = [t for z, t in found if z == "open"]
                opens.append(None if not free or any(z == "main" for z, _ in found) else free)
                noises.append("\n".join(t for z, t in found if z == "noise"))
                hosts.append(host_of(url))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hosts, pa.string()), pa.array(opens, pa.list_(pa.string())), pa.array(noises, pa.string())], ["page_id", "url", "host", "open", "noise"])

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages that their markup decides; their texts are neither kept nor dealt out on the way."""
        for b in batches:
            texts = []
            for page in b.column(2).to_pylist():
                found = blocks(page or "")
                main = [t for z, t in found if z == "main"]
                texts.append(_SEP.join(main) if main or not any(z == "open" for z, _ in found) else None)
            text = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], ["page_id", "url", "text"]).filter(text.is_valid())

    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = stage(spark, raw.mapInArrow(read, "page_id long, url string, host string, open array<string>, noise string"), "pages", tidy=True)
    rows = rows.withColumn("stream", F.encode(F.concat_ws("\n", F.array_join("open", "\n"), "noise"), "UTF-8")).withColumn("uid", F.unhex(F.md5(F.concat_ws("\n", "host", "stream"))))
    found = repeats(rows.select("uid", F.col("host").alias("scope"), F.col("stream").alias("data")), repeat_bytes, k=repeat_bytes // 3, across=True)
    spans = found.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for free, at in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                texts.append(_SEP.join(unique_runs(free, [(s["lo"], s["hi"]) for s in at or []], repeat_bytes)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    asked = rows.where(F.col("open").isNotNull()).join(spans, "uid", "left").select("page_id", "url", "open", "spans").mapInArrow(decide, "page_id long, url string, text string")
    by_markup = raw.mapInArrow(main_text, "page_id long, url string, text string").select("page_id", "url", "text", F.lit("markup").alias("decided"))
    both = by_markup.union(asked.select("page_id", "url", "text", F.lit("host")))
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "decided")


def unique_runs(free: list[str], spans: list[tuple[int, int]], length: int) -> list[str]:
    """Open blocks (laid end to end, a newline between) without what repeated windows of `length` bytes cover.

    A block that is covered whole goes; of another, covered runs of `length`
    bytes or more go, up to whole words, so that a line repeated before a block
    doesn't take its first words along.
    """
    data = [t.encode("utf-8", "surrogatepass") for t in free]
    runs = []
    if spans:
        at = np.array(spans, np.int64)
        runs = list(zip(*(x.tolist() for x in removed_runs(at[:, 0], at[:, 1], length)), strict=True))
    out, begin = [], 0
    for d in data:
        end = begin + len(d)
        own = [(max(s, begin) - begin, min(e, end) - begin) for s, e in runs if s < end and e > begin]
        begin = end + 1
        if own == [(0, len(d))]:
            continue
        kept, last = [], 0
        for s, e in own:
            if e - s < length:
                continue
            if s and d[s - 1 : s] != b" ":
                s = d.find(b" ", s, e) + 1 or e
            if e < len(d) and d[e : e + 1] != b" ":
                e = d.rfind(b" ", s, e) + 1
            if s < e:
                kept.append(d[last:s])
                last = e
        text = _SPACE.sub(" ", b"".join([*kept, d[last:]]).decode("utf-8", "surrogatepass")).strip()
        if text:
            out.append(text)
    return out
