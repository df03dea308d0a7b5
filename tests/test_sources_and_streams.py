import os
import zlib

import pytest

from marlstone.sources.loaders import Loaders, load_pdf_whole, load_text
from marlstone.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_text("plain\r\ntext\n\n\n\nend")
    (tmp_path / "deep" / "b.MD").write_text("# Title\n\nSome **bold** words")
    (tmp_path / "c.bin").write_bytes(b"ignored")
    streams = [b"BT /F1 12 Tf (Page \\(one\\)) Tj ET", zlib.compress(b"BT (Page) Tj T* (two) Tj ET")]
    heads = [b"<< /Length 9 >>", b"<< /Length 9 /Filter /FlateDecode >>"]
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nstream\n%s\nendstream\nendobj\n" % (k, h, s) for k, (h, s) in enumerate(zip(heads, streams, strict=True))))
    return str(tmp_path)


def test_loaders(spark, folder):
    got = {(os.path.basename(r.path), r.page): r.text for r in Loaders().load(spark, folder).collect()}
    assert got[("a.txt", None)] == "plain\ntext\n\nend"
    assert got[("b.MD", None)] == "Title\n\nSome bold words"
    assert got[("d.pdf", 1)] == "Page (one)" and got[("d.pdf", 2)] == "Page\ntwo" and len(got) == 4


def test_pdf_pages_follow_the_page_tree(spark, tmp_path):
    at = tmp_path / "data.v1"
    at.mkdir()
    show = b"stream\nBT (%s) Tj ET\nendstream"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [5 0 R 6 0 R 3 0 R] /Count 3 >>", b"<< /Type /Page /Contents 4 0 R >>", b"<< /Length 9 >>\n" + show % b"third", b"<< /Type /Page /Contents [7 0 R 8 0 R] >>", b"<< /Type /Page >>", b"<< /Length 9 >>\n" + show % b"first", b"<< /Length 9 >>\n" + show % b"too"]
    (at / "x.pdf").write_bytes(b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, x) for k, x in enumerate(objects, 1)))
    got = sorted((r.page, r.text) for r in Loaders().load(spark, str(at)).collect())
    assert [p for p, _ in got] == [1, 3] and got[0][1].split() == ["first", "too"] and got[1][1] == "third"
    loaders = Loaders()
    loaders.register("pdf", load_pdf_whole)
    assert [(r.page, r.text.split()) for r in loaders.load(spark, str(at)).collect()] == [(None, ["first", "too", "third"])]
    (at / "y.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n<< /Type /Page >>\nendobj\n")
    with pytest.raises(Exception, match="no text in"):
        Loaders().load(spark, f"{at}/y.pdf").collect()


def test_unknown_extensions(spark, folder):
    loaders = Loaders()
    with pytest.raises(ValueError, match="no loader for .bin"):
        loaders.load(spark, f"{folder}/c.bin")
    loaders.register(".bin", load_text)
    assert loaders.load(spark, f"{folder}/c.bin").first().text == "ignored" and "bin" in loaders.supported()


def test_streamed_ingestion_is_exactly_once(spark, tmp_path):
    at, out = tmp_path / "in", str(tmp_path / "out")
    at.mkdir()
    (at / "a.txt").write_text("first text")
    (at / "b.txt").write_text("first text")
    (at / "c.txt").write_text("second text")

    def once():
        ingest.ingest(ingest.arriving(spark, str(at)), out, str(tmp_path / "checkpoint")).awaitTermination(120)

    once()
    (at / "d.txt").write_text("second text")
    (at / "e.txt").write_text("third text")
    once()
    once()
    assert spark.read.parquet(f"{out}/documents").count() == 3
    assert sorted(r.content for r in spark.read.parquet(f"{out}/chunks").collect()) == ["first text", "second text", "third text"]
