"""Column functions on URLs; all are native expressions. What isn't an http(s) URL with a host becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SKIPPED = sorted("7z avi avif bmp css doc docx gif gz ico jpeg jpg js json mov mp3 mp4 pdf png rar svg tar webm webp xml zip".split())
_PARTS = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/:?#]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 host, 3 port, 4 path, 5 query; '' where absent."""
    return F.regexp_extract(url, _PARTS, k)


def normalize(url: Column) -> Column:
    """Without fragment and tracking parameters; scheme and host in lower case; single slashes; a path."""
    url = F.btrim(url)
    path = F.regexp_replace(part(url, 4), "/+", "/")
    kept = F.array_join(F.filter(F.split(part(url, 5), "&"), lambda x: (x != "") & ~F.lower(x).rlike("^(utm_[^=]*|fbclid|gclid)(=|$)")), "&")
    out = F.concat(
        F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)),
        F.when(part(url, 3) != "", F.concat(F.lit(":"), part(url, 3))).otherwise(""),
        F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""),
    )
    return F.when(part(url, 2) != "", out)


def resolve(href: Column, base: Column) -> Column:
    """An absolute URL for a link on a page; relative links are put after the page's directory as they are."""
    origin = F.concat(F.lower(part(base, 1)), F.lit("://"), part(base, 2), F.when(part(base, 3) != "", F.concat(F.lit(":"), part(base, 3))).otherwise(""))
    path = part(base, 4)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "/[^/]*$", "/")
    return (
        F.when(href.startswith("//"), F.concat(F.lower(part(base, 1)), F.lit(":"), href))
        .when(href.rlike("(?i)^https?://"), href)
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(origin, folder, href))
    )


def skipped(url: Column) -> Column:
    """Whether the path ends in an extension that is no page."""
    return F.lower(F.regexp_extract(part(url, 4), r"\.([^./]+)$", 1)).isin(SKIPPED)


def title(url: Column) -> Column:
    """From the path's last part, words between dashes capitalised; the host where there is no path."""
    last = F.element_at(F.filter(F.split(part(url, 4), "/"), lambda x: x != ""), -1)
    words = F.transform(F.split(last, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100_000)))
    return F.coalesce(F.when(F.regexp_replace(part(url, 4), "/", "") != "", F.array_join(words, " ")), part(url, 2))


def private_address(url: Column) -> Column:
    """Whether the host is a literal private, loopback, link-local or reserved IPv4 address, or localhost."""
    return part(url, 2).rlike(r"^(?i)(localhost|0\..*|10\.\d+\.\d+\.\d+|127\.\d+\.\d+\.\d+|169\.254\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|(22[4-9]|2[34]\d|25[0-5])\.\d+\.\d+\.\d+)$")
