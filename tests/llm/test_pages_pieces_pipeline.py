"""Template removal, pieces, and the pipeline."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from marlstone.llm import decontaminate, jaccard, pieces, pii, template, toxicity
from marlstone.llm import text as T

from .conftest import make, prose

NAV = "<nav><ul><li><a href='/'>Home sweet</a><li>About us</ul></nav>"
FOOT = "<footer><p>All rights kept<p>Imprint</footer>"


def page(body, nav=NAV):
    return f"<html><head><title>t</title></head><body>{nav}<div id=main><p>{body}</p></div>{FOOT}</body></html>"


def test_templates_go_and_the_rest_stays(spark):
    rows = [(k, f"https://Site{k % 2}.example/p{k}", page(f"Own words {k} &amp; more", NAV if k % 2 else NAV.upper())) for k in range(10)]
    rows += [(50, "https://other.example/", page("Alone here")), (51, "https://other.example/2", page("Alone there"))]
    got = {r.page_id: r for r in template.without_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(10):
        assert got[k].text == f"t\nOwn words {k} & more" or got[k].text == f"Own words {k} & more", got[k].text
        assert got[k].removed >= 2 and got[k].host == f"site{k % 2}.example"
    assert "Home sweet" in got[50].text and "Imprint" in got[51].text and got[50].removed == 0


def test_copies_of_a_page_count_once_and_keep_their_body(spark):
    rows = [(k, "http://a.b/x", page("The same body over and over, copied but a body all the same")) for k in range(6)]
    got = template.without_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("The same body" in r.text and "Imprint" in r.text for r in got)


def test_templates_go_from_thin_pages_too(spark):
    menu = "<div id=menu><ul>" + "".join(f"<li><p>Menu entry number {k} of the whole site</p></li>" for k in range(30)) + "</ul></div>"
    story = "<div id=story><p>" + " ".join(f"told{k}" for k in range(200)) + "</p>" + FOOT + "</div>"
    rows = [(k, "http://thin.example/", f"<body>{menu}<p>Tag page {k}</p></body>") for k in range(100)]
    rows += [(k, "http://thin.example/", f"<body><p>Copy {k}</p>{story}</body>") for k in range(100, 104)]
    rows += [(k, "http://thin.example/", f"<body><p>Other {k}</p>{FOOT}</body>") for k in range(104, 120)]
    got = {r.page_id: r.text for r in template.without_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Tag page {k}" for k in range(100))
    assert all("told7 told8" in got[k] and f"Copy {k}" in got[k] and "Imprint" not in got[k] for k in range(100, 104))
    assert all(got[k] == f"Other {k}" for k in range(104, 120))


def test_counts_equal_brute_force(spark, tiny):
    pages = template.with_host(spark.read.parquet(f"{tiny}/pages.parquet"))
    count = {}
    for r in pages.collect():
        raw = r.html.encode()
        squeeze = lambda b: bytes(c for c in b if c not in (9, 10, 11, 12, 13, 32))
        for s, e, n in template.elements(raw):
            if n not in template._WHOLE:
                count.setdefault((r.host, squeeze(raw[s:e])), set()).add(squeeze(raw))
    want = sum(len(v) >= template.LEAST_PAGES for v in count.values())
    assert template.templates(pages).count() == want


def test_many_templates_are_joined(spark, tiny, monkeypatch):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    one = sorted(map(tuple, template.without_templates(pages).collect()))
    monkeypatch.setattr(template, "MOST_KEYS", -1)
    assert sorted(map(tuple, template.without_templates(pages).collect())) == one


def test_page_edge_cases(spark):
    schema = "page_id long, url string, html string, host string, key long, text string"
    rows = [(1, None, None), (2, "no url", ""), (3, "http://h/", "<p>open <b>bold"), (3, "http://h/", "<p>open <b>bold"), (None, "http://h/", "<p>x</p>"), (4, "http://h/", "<!-- <p>c</p> --><script>if (a<b) x</script>seen" + "<div>" * 3000), (5, "http://h/", "</p></div><"), (6, "http://h/", "word " * 200_000)]
    got = sorted((r.page_id, r.host, r.removed, r.text) for r in template.without_templates(spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], schema)).collect())
    assert [g[0] for g in got] == [1, 2, 3, 3, 4, 5, 6] and got[0] == (1, "", 0, "") and got[1][3] == ""
    assert got[2][3] == "open bold" and got[4][3] == "seen"
    assert template.without_templates(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# Pieces


@pytest.fixture(scope="module")
def v():
    return pieces.vocabulary(pieces.MODEL)


def all_segmentations(word, v):
    heads = [i for i in range(len(word)) if i == 0 or word[i] & 0xC0 != 0x80] + [len(word)]

    def rest(i):
        if i == len(word):
            yield 0.0, ()
            return
        one = heads[heads.index(i) + 1]
        known = word[i:one] in v.ids
        for e in heads:
            if e > i and word[i:e] in v.ids:
                for s, ids in rest(e):
                    yield s + v.score[v.ids[word[i:e]]], (v.ids[word[i:e]], *ids)
        if not known:
            for s, ids in rest(one):
                yield s + v.unknown, tuple(int(v.byte_id[b]) for b in word[i:one]) + ids

    return sorted(rest(0), key=lambda x: -x[0])


def test_search_gives_the_n_best_of_a_word(v):
    for w in (" hello", " naïveté", "日x", " aaaaaaa", "\n", " ", "  ab"):
        want = all_segmentations(w.encode(), v)
        got = pieces.search(w.encode(), 6, v)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:6]]) and len({i for _, i in got}) == len(got)


def test_n_best_of_a_text_equal_brute_force(v):
    for x in ("hi to you", "a\nb  c", "ab", "ünder 日本"):
        got = pieces.encode(pa.array([x]), v)
        words = [w for w in _lattice_words(" " + x)]
        every = sorted((sum(s for s, _ in c) for c in itertools.product(*(all_segmentations(w.encode(), v)[:8] for w in words))), reverse=True)
        scores = [got["score"][0]] + [s for s, _ in got["alternatives"][0]]
        assert scores == pytest.approx(every[: pieces.NBEST])
        best = list(got["ids"])
        for s, edits in got["alternatives"][0]:
            ids = best.copy()
            for at, drop, new in reversed(edits):
                ids[at : at + drop] = new
            assert pieces.decode(np.array(ids), np.array([0, len(ids)]), v) == [x.encode()]
            assert s <= got["score"][0]


def _lattice_words(x):
    data, offs = T.raw(pa.array([x]))
    starts, _ = pieces.lattice_words(data, offs)
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]


def test_round_trip(spark, tiny, edge):
    for docs in (spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text"), edge.select("doc_id", "text")):
        back = pieces.decoded(pieces.encoded(docs))
        assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))


def test_piece_edge_cases(spark, edge, empty):
    got = {r.doc_id: r for r in pieces.encoded(edge).collect()}
    assert got[1].ids is None and got[1].score is None and got[1].alternatives is None and got[1].n_pieces is None
    assert got[2].ids == [] and got[2].score == 0 and got[2].alternatives == [] and got[2].n_pieces == 0
    assert got[5].ids == got[6].ids and len(got[4].ids) == got[4].n_pieces > 60_000
    assert pieces.encoded(empty).collect() == []


# The pipeline


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "pieces"]


def test_pipeline_equals_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").toPandas().sort_values("doc_id")
    labels, bench = spark.read.parquet(f"{tiny}/labels.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet").toPandas()
    fitted = toxicity.model(spark.read.parquet(f"{tiny}/documents.parquet"), labels)
    docs = docs[toxicity.probability(*T.raw(pa.array(docs.text), lower=True), fitted) < toxicity.THRESHOLD]
    from .test_search import first_of_each_group, grams

    docs = docs[docs.doc_id.isin(first_of_each_group(list(zip(docs.doc_id, docs.text, strict=True))))]
    items = [s for x in bench.text if len(s := grams(x, decontaminate.N)) and len(x.split()) >= decontaminate.N]
    docs = docs[[not any(len(s & grams(x, decontaminate.N)) / len(s) >= decontaminate.THRESHOLD for s in items) for x in docs.text]]
    model, texts = pii.train(pii.labelled_table()), []
    for x in docs.text:
        _, s, e, k, data, _ = pii.find(pa.array([x]), model)
        raw = data.tobytes()
        for a, b, c in sorted(zip(s, e, k, strict=True), reverse=True):
            raw = raw[:a] + f"[{pii.KINDS[c]}]".encode() + raw[b:]
        texts.append(raw.decode())
    got = {r.doc_id: r for r in pieces_of(spark, corpus_pipeline.run(spark, tiny))}
    assert {i: r.text for i, r in got.items()} == dict(zip(docs.doc_id, texts, strict=True)) and 50 < len(got) < 200


def pieces_of(spark, rows):
    return pieces.decoded(rows).collect()


def test_pipeline_over_edge_cases(spark, tiny, tmp_path, edge, empty):
    import os

    for name, docs in (("edge", edge), ("empty", empty)):
        at = str(tmp_path / name)
        docs.write.parquet(f"{at}/documents.parquet")
        for t in ("labels", "benchmark"):
            os.symlink(f"{tiny}/{t}.parquet", f"{at}/{t}.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        assert (len(got) == 0) == (name == "empty")
        if name == "edge":
            assert {1, 2, 3, 5}.issubset({r.doc_id for r in got}) and 6 not in {r.doc_id for r in got}


def test_long_words_keep_their_cost(v):
    got = pieces.encode(pa.array(["x" * 20_000, prose(1, 5)]), v)
    assert pieces.decode(got["ids"], got["ioffs"], v)[0] == b"x" * 20_000
