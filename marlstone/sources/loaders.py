"""Loaders of files by extension, into (path, page, text); a registry takes further ones."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

Loader = Callable[[SparkSession, str, str], DataFrame]


def _whole(spark: SparkSession, at: str, glob: str) -> DataFrame:
    return spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(at).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def load_text(spark: SparkSession, at: str, glob: str) -> DataFrame:
    return _whole(spark, at, glob).select("path", F.lit(None).cast("int").alias("page"), text.clean_text(F.col("raw")).alias("text"))


def load_markdown(spark: SparkSession, at: str, glob: str) -> DataFrame:
    return _whole(spark, at, glob).select("path", F.lit(None).cast("int").alias("page"), text.strip_markdown(F.col("raw")).alias("text"))


_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"\((?:\\.|[^()\\])*\)|\bT(?:[JjdD]\b|\*)|\bET\b|'", re.S)
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_PAGE, _TREE = re.compile(rb"/Type\s*/Page(?![a-zA-Z])"), re.compile(rb"/Type\s*/Pages(?![a-zA-Z])")
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _shown(stream: bytes) -> str:
    out: list[bytes] = []
    for token in _SHOW.findall(stream):
        if token[:1] == b"(":
            body = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), token[1:-1])
            out.append(re.sub(rb"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S))
        elif token in (b"T*", b"Td", b"TD", b"ET", b"'"):
            out.append(b"\n")
    return b"".join(out).decode("latin-1")


def _streams(content: bytes) -> list[str]:
    """The text of each content stream that shows some, plain or deflated, in file order."""
    out = []
    for head, body in _STREAM.findall(content):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"BT" in body and (b"Tj" in body or b"TJ" in body):
            out.append(_shown(body))
    return out


def _references(body: bytes, key: bytes) -> list[bytes]:
    """Numbers of the objects that an entry of a dictionary refers to: one, or an array of them."""
    found = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return _REFERENCE.findall(found[1]) if found else []


def pdf_pages(content: bytes) -> list[str]:
    """The text of each page, '' where it shows none, in the order of the page tree.

    A file without page objects has a page for each stream that shows text.
    """
    objects = dict(_OBJECT.findall(content))
    pages = [n for n, body in objects.items() if _PAGE.search(body.split(b"stream", 1)[0])]
    if not pages:
        return _streams(content)
    children = {n: _references(body, b"Kids") for n, body in objects.items() if _TREE.search(body)}
    agenda, seen, order = [n for n in children if not any(n in kids for kids in children.values())][::-1], set(), []
    while agenda:
        n = agenda.pop()
        if n not in seen:
            seen.add(n)
            agenda += children.get(n, [])[::-1]
            order += [n] if n in pages else []
    return ["\n".join(t for c in _references(objects[n], b"Contents") for t in _streams(objects.get(c, b""))) for n in [*order, *(n for n in pages if n not in seen)]]


def load_pdf(spark: SparkSession, at: str, glob: str) -> DataFrame:
    """A row for each page with text, pages counted from 1; a file in which no page shows text is an error."""

    def run(batches):
        for b in batches:
            rows = []
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                own = [(p, k, t) for k, t in enumerate(pdf_pages(c), 1) if t.strip()]
                if not own:
                    raise ValueError(f"no text in {p}")
                rows += own
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["path", "page", "raw"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(at).select("path", "content")
    return files.mapInArrow(run, "path string, page int, raw string").select("path", "page", text.clean_page(F.col("raw")).alias("text")).where("text <> ''")


def load_pdf_whole(spark: SparkSession, at: str, glob: str) -> DataFrame:
    """A row for each file: its pages with a blank line between them."""
    by = load_pdf(spark, at, glob).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    return by.select("path", F.lit(None).cast("int").alias("page"), text.clean_page(F.array_join(F.transform("pages", lambda x: x["text"]), "\n\n")).alias("text"))


class Loaders:
    """Extension -> loader; files of other extensions are passed over."""

    def __init__(self) -> None:
        self.known: dict[str, Loader] = {"txt": load_text, "md": load_markdown, "markdown": load_markdown, "pdf": load_pdf}

    def register(self, extension: str, loader: Loader) -> None:
        self.known[extension.lower().lstrip(".")] = loader

    def supported(self) -> list[str]:
        return sorted(self.known)

    def load(self, spark: SparkSession, at: str) -> DataFrame:
        """path, page, text of all files under a folder, or of one file; an unknown extension of a single file is an error."""
        if not self._folder(spark, at):
            name = at.rstrip("/").rsplit("/", 1)[-1]
            extension = name.rsplit(".", 1)[1].lower() if "." in name else ""
            if extension in self.known:
                return self.known[extension](spark, at, "*")
            raise ValueError(f"no loader for .{extension}; there are: {', '.join(self.supported())}")
        by: dict[Loader, list[str]] = {}
        for extension, loader in sorted(self.known.items()):
            by.setdefault(loader, []).append("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension))
        out = None
        for loader, globs in by.items():  # one listing of the tree for each loader
            part = loader(spark, at, "*." + (globs[0] if len(globs) == 1 else "{" + ",".join(globs) + "}"))
            out = part if out is None else out.unionByName(part)
        return out

    @staticmethod
    def _folder(spark: SparkSession, at: str) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
