import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text, urls, vectors
from marlstone.operators import chunk as C


def chunks_of(t, size, overlap):
    """The windows, one at a time."""
    t = t.strip(" \t\n\r\0\x0b")
    out, step = [], size - overlap
    if len(t) <= size:
        return [t] if t else []
    k = 0
    while True:
        win = t[k * step : k * step + size]
        if k * step + size < len(t):
            for needle in ("\n\n", "\n", ". ", " "):
                at = win.rfind(needle)
                if at >= size // 2:
                    win = win[: at + len(needle)]
                    break
        if win.strip(" \t\n\r\0\x0b"):
            out.append(win.strip(" \t\n\r\0\x0b"))
        if k * step + size >= len(t):
            return out
        k += 1


@pytest.mark.parametrize(("size", "overlap"), [(1000, 200), (200, 40), (7, 3), (10, 0)])
def test_chunks_equal_a_loop(spark, size, overlap):
    r = random.Random(size)
    texts = ["", "   \n", "x" * size, "y" * (size + 1), "é" * (3 * size), "a. b " * size, "no-boundary" * size]
    texts += ["".join(r.choice(["ab", " ", ". ", "\n", "\n\n", "ü", "日本", "x" * 9]) for _ in range(r.randrange(1, 4 * size))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    got = {}
    for row in C.chunk(docs, size, overlap).orderBy("doc_id", "position").collect():
        got.setdefault(row.doc_id, []).append((row.position, row.content))
    for i, t in enumerate(texts):
        assert got.get(i, []) == list(enumerate(chunks_of(t, size, overlap)))
    assert len(texts) not in got


def test_chunk_parameters_are_checked(spark):
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError, match="size must"):
            C.chunk(spark.createDataFrame([], "doc_id long, text string"), size, overlap)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_clean_text(spark):
    assert one(spark, " a\r\nb\rc\n\n\n\nd \x0b", text.clean_text) == "a\nb\nc\n\nd"
    assert one(spark, None, text.clean_text) is None


def test_markdown(spark):
    md = "# Title\n\n![pic](a.png) and [link](http://x)\n> quote\n- item\n**bold** `code`\n```py\nx = 1\n```"
    got = one(spark, md, text.strip_markdown)
    assert "Title" in got and "pic and link" in got and not re.search(r"[#`*\[\]]|http", got)


def test_hash_counts(spark):
    x = "alpha Beta alpha gamma, delta2 beta"
    got = spark.createDataFrame([(x,)], "x string").select(vectors.hash_counts(F.col("x"))).first()[0]
    want = [0] * 32
    for w in spark.createDataFrame([(x,)], "x string").select(text.words(F.col("x"))).first()[0]:
        want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 32] += 1
    assert got == want and sum(want) == 6


def test_hash_embedding_has_length_one(spark):
    got = spark.createDataFrame([("alpha beta",), ("",)], "x string").select(vectors.hash_embedding(F.col("x"))).collect()
    assert sum(v * v for v in got[0][0]) == pytest.approx(1) and got[1][0] == [0.0] * 32


def test_urls(spark):
    assert one(spark, "HTTP://Ex.com//a//b/?utm_source=x&q=1#frag", urls.normalize) == "http://ex.com/a/b/?q=1"
    assert one(spark, "http://ex.com:8080", urls.normalize) == "http://ex.com:8080/"
    assert one(spark, None, urls.normalize) is None
