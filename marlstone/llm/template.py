"""Site template removal: element subtrees that recur across many pages of a host are deleted, and the rest is the text.

A page is scanned once for its tags (comments, declarations and the contents of script and style
are no tags; void elements have no subtree; an unclosed element ends with its parent, or where its kind
can't hold the next tag, as a paragraph in a paragraph). The hash of a
subtree is that of its bytes without white space, from one prefix sum for a whole batch. Spark counts, for
each host and hash, in how many different pages (by the hash of the whole page, so that copies of a page
count once) it occurs; subtrees in ``LEAST_PAGES`` or more, and at least ``LEAST_SHARE`` of the host's pages, are the host's template. In a second scan the outermost
template subtrees are deleted. A copied page body stays: a subtree in less than ``COPIED`` of the host's different pages that holds
more than ``MOST_SHARE`` of the page's text; in it, the subtrees that are in ``COPIED`` or more of them are deleted. The hashes to delete are broadcast up to ``MOST_KEYS``; beyond, they
are joined to the subtrees of the pages, and by page.

Inline elements (links, bold and the like) are judged only as parts of what holds them.
Defined cases: a null or empty page has an empty text and nothing removed; a url without a host is of
host ''; rows with a null page_id are dropped; repeated rows come out repeated; an empty table gives no
rows; a page of any length is scanned whole, in about 60 bytes of memory for each of its bytes; counts that tie with a threshold reach it; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text
from .store import stored, table

LEAST_PAGES, LEAST_SHARE, MOST_SHARE, COPIED, MOST_KEYS = 3, 0.002, 0.5, 0.05, 4 << 20
_TAG = re.compile(rb"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[!?][^>]*>", re.S)
_VOID = frozenset(b"area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(b"a abbr b bdi bdo cite code data em font i kbd mark q s samp small span strong sub sup time tt u var label title".split())
_WHOLE = frozenset((b"html", b"head", b"body"))
_RAW = {k: re.compile(rb"</" + k + rb"\s*>", re.I) for k in (b"script", b"style")}
_BLOCK = frozenset(b"address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {b"li": (b"li",), b"tr": (b"tr", b"td", b"th"), b"td": (b"td", b"th"), b"th": (b"td", b"th"), b"dt": (b"dt", b"dd"), b"dd": (b"dt", b"dd"), b"option": (b"option",)} | {k: (b"p",) for k in _BLOCK}
_ANY, _LINE = re.compile(rb"<[^>]*>"), re.compile(r"[ \t\r\f\v]+")
_INK = np.ones(256, bool)
_INK[[9, 10, 11, 12, 13, 32]] = False


def elements(page: bytes) -> list[tuple[int, int, bytes]]:
    """Start, end and name of the elements that have a subtree, inline ones left out, in document order."""
    found: list[list] = []
    stack: list[tuple[bytes, int]] = []
    at = 0
    while m := _TAG.search(page, at):
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for _, i in stack[k + 1 :]:
                        found[i][1] = m.start()
                    found[stack[k][1]][1] = at
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] in _CLOSES.get(name, ()):
            found[stack.pop()[1]][1] = m.start()
        if name in _VOID or page[at - 2 : at - 1] == b"/":
            continue
        found.append([m.start(), len(page), name])
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else len(page)
            found[-1][1] = at
        else:
            stack.append((name, len(found) - 1))
    return [(s, e, n) for s, e, n in found if n not in _INLINE]


def hashes(batch: pa.RecordBatch) -> tuple[list, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pages, their elements; owner and host-bound hash of each element; hash of each page; host hashes."""
    data, offs = text.raw(batch.column("html"))
    buffer = data.tobytes()
    pages = [buffer[s:e] for s, e in zip(offs[:-1], offs[1:], strict=True)]
    found = [elements(p) for p in pages]
    kept = np.concatenate([[0], np.cumsum(_INK[data])])
    s, inv = text.sums(data[_INK[data]])
    owner = np.repeat(np.arange(len(pages)), [len(x) for x in found])
    start = np.array([x[0] for f in found for x in f], np.int64) + offs[:-1][owner]
    end = np.array([x[1] for f in found for x in f], np.int64) + offs[:-1][owner]
    host, hoffs = text.raw(batch.column("host"))
    hs, hinv = text.sums(host)
    hosts = text.span(hs, hinv, hoffs[:-1], hoffs[1:])
    key = text.mix(text.span(s, inv, kept[start], kept[end]) ^ (hosts[owner] * text.U(3)))
    return pages, found, owner, key, text.span(s, inv, kept[offs[:-1]], kept[offs[1:]]), hosts


def shown(piece: bytes) -> str:
    """Text of a piece of a page: without tags, comments, scripts and styles, entities decoded, blocks on lines of their own."""
    out, at, skip = [], 0, None
    while m := _TAG.search(piece, at):
        out.append(piece[at : m.start()])
        at = m.end()
        name = (m[2] or b"").lower()
        if name in _RAW and not m[1]:
            skip = _RAW[name].search(piece, at)
            at = skip.end() if skip else len(piece)
        elif name and name not in _INLINE:
            out.append(b"\n")
    out.append(piece[at:])
    lines = _LINE.sub(" ", html.unescape(b"".join(out).decode("utf-8", "replace"))).split("\n")
    return "\n".join(x for x in (line.strip() for line in lines) if x)


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html")).where("page_id is not null")


def subtrees(pages: DataFrame) -> DataFrame:
    """key (host and subtree), page (hash of the page), page_id and site (hash of the host) of each different subtree of each row; and with the site as key, the page itself."""

    def run(batches):
        for whole in batches:
            for b in text.slices(whole, "html"):
                _, found, owner, key, page, hosts = hashes(b)
                sub = np.array([x[2] not in _WHOLE for f in found for x in f], bool)
                key, first = text.distinct(key[sub], np.searchsorted(owner[sub], np.arange(len(found) + 1)))
                own = np.concatenate([text.owners(first), np.arange(len(found))])
                key = np.concatenate([key, hosts])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(page[own].view(np.int64)), b.column("page_id").take(pa.array(own)), pa.array(hosts[own].view(np.int64))], ["key", "page", "page_id", "site"])

    return pages.mapInArrow(run, "key long, page long, page_id long, site long")


def templates(pages: DataFrame) -> DataFrame:
    """Keys of the subtrees that recur; and whether they are rare, in less than ``COPIED`` of their host's pages."""
    once = subtrees(pages).select("key", "page", "site").distinct()
    counted = once.groupBy("key", "site").agg(F.count("*").alias("pages")).where((F.col("pages") >= LEAST_PAGES) | (F.col("key") == F.col("site")))
    counted = stored(counted, "counted")
    sites = counted.where("key = site").select("site", F.col("pages").alias("all"))
    return counted.where("key <> site").join(sites, "site").where(F.col("pages") >= LEAST_SHARE * F.col("all")).select("key", (F.col("pages") < COPIED * F.col("all")).alias("rare"))


def cleaned(pages: DataFrame, doomed) -> DataFrame:
    """page_id, host, removed, text. ``doomed`` gives a batch's keys to delete, and the rare ones of them, both sorted."""

    def run(batches):
        for whole in batches:
            for b in text.slices(whole, "html"):
                docs, found, owner, key, _, _ = hashes(b)
                hit, rare = (keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key if len(keys) else np.zeros(len(key), bool) for keys in doomed(b))
                first = np.searchsorted(owner, np.arange(len(docs) + 1))
                texts, removed = [], []
                for i, page in enumerate(docs):
                    here = np.flatnonzero(hit[first[i] : first[i + 1]])
                    pieces, at, n, size = [], 0, 0, None
                    until = body = 0
                    for k in here:
                        s, e, name = found[i][k]
                        if s < until or name in _WHOLE:
                            continue
                        if rare[first[i] + k]:
                            if s < body:
                                continue
                            if size is None:
                                size = max(1, len(_ANY.sub(b"", page)))
                            if len(_ANY.sub(b"", page[s:e])) > MOST_SHARE * size and name not in _RAW:
                                body = e
                                continue
                        until = e
                        pieces.append(page[at:s])
                        at, n = e, n + 1
                    texts.append(shown(b"\n".join([*pieces, page[at:]])))
                    removed.append(n)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["page_id", "host", "removed", "text"])

    return pages.mapInArrow(run, "page_id long, host string, removed long, text string")


def without_templates(pages: DataFrame) -> DataFrame:
    pages = with_host(pages)
    found = stored(templates(pages), "templates")
    if found.count() <= MOST_KEYS:
        got = found.toArrow()
        keys, rare = got["key"].to_numpy().view(np.uint64), got["rare"].to_numpy()
        shared = pages.sparkSession.sparkContext.broadcast((np.sort(keys), np.sort(keys[rare])))
        return cleaned(pages, lambda b: shared.value)
    own = subtrees(pages).join(found, "key").groupBy("page_id").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("rare"), F.col("key"))).alias("rare"))

    def listed(b):
        return tuple(np.unique(b.column(c).flatten().to_numpy().view(np.uint64)) for c in ("keys", "rare"))

    return cleaned(pages.join(own, "page_id", "left"), listed)


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_templates(table(spark, sf_dir, "pages"))
