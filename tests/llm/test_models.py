"""Trained and scoring operators: scalar versions, held-out accuracy, and edge cases."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import langid, linear, mixing, pii, quality, toxicity
from marlstone.llm import text as T

from .conftest import make, prose


# Context mixing


def before(data, i, k):
    """The k bytes before place i as a number, the latest lowest; zeros before the start."""
    return sum((data[i - j] if i >= j else 0) << (8 * (j - 1)) for j in range(1, k + 1))


def slot(context, k, node):
    return ((context * mixing._SPREAD[k]) % 2**64 >> (64 - mixing.BITS)) ^ int(mixing._NODE[node])


def path(data, i, trees):
    """Node and side of each decision of a byte."""
    pair = (data[i - 1] if i else 0) * 256 + data[i]
    return [(int(trees.step[j, pair]) >> 1, int(trees.step[j, pair]) & 1) for j in range(trees.depth[pair])]


def scalar_counts(texts, trees):
    seen = {}
    for data in texts:
        for i in range(len(data)):
            for k, size in enumerate(mixing.ORDERS):
                for node, y in path(data, i, trees):
                    n = seen.setdefault((k, slot(before(data, i, size), k, node)), [0, 0])
                    n[y] += 1
    return seen


def scalar_bits(data, trees, counts):
    """Bits of one text, a decision at a time, from counts of other texts."""
    n_in, groups = len(mixing.ORDERS) + 1, (mixing.STATES, mixing.DEEP)
    weight, power = np.full((n_in, *groups), mixing.WEIGHT), np.ones((n_in, *groups))
    weight[-1] = np.array(mixing.TRUST)[:, None]
    cell = np.tile(1 / (1 + np.exp(-(np.arange(mixing.CELLS) - (mixing.CELLS - 1) / 2) * 16 / mixing.CELLS)), (*groups, 1))
    latest, run, total, at, blocks = {}, 0, 0.0, 0, itertools.chain(mixing.BLOCKS, itertools.repeat(mixing.BLOCKS[-1]))
    while at < len(data):
        to = min(len(data), at + next(blocks))
        grad, seen, ones = np.zeros_like(weight), np.zeros_like(cell), np.zeros_like(cell)
        for i in range(at, to):
            guess = latest.get(before(data, i, mixing.MATCH))
            state = 1 if run == 0 else 2 if run <= mixing.SURE else 3
            said = None if guess is None else path(data[:i] + bytes([data[guess]]), i, trees)
            for j, (node, y) in enumerate(path(data, i, trees)):
                x = []
                for k, size in enumerate(mixing.ORDERS):
                    n0, n1 = counts.get((k, slot(before(data, i, size), k, node)), (0, 0))
                    x.append(round(max(-127, min(127, math.log((n1 + 0.4) / (n0 + 0.4)) * 15))) / 15)
                x.append(0 if said is None else 1 if said[j][1] else -1)
                group = (0 if said is None else state, min(j, mixing.DEEP - 1))
                x = np.array(x)
                dot = float(np.clip(x @ weight[:, *group], -12, 12))
                p = 1 / (1 + math.exp(-dot))
                c = int(np.clip(dot * mixing.CELLS / 16 + mixing.CELLS / 2, 0, mixing.CELLS - 1))
                q = (p + cell[*group, c]) / 2
                total -= math.log2(q if y else 1 - q)
                grad[:, *group] += (y - p) * x
                seen[*group, c] += 1
                ones[*group, c] += y
                if said is not None and said[j][1] != y:
                    said = None
            run = run + 1 if guess is not None and data[guess] == data[i] else 0
            latest[before(data, i, mixing.MATCH)] = i
        power += grad * grad
        weight += mixing.RATE * grad / np.sqrt(power)
        cell = (cell + mixing.PULL * ones) / (1 + mixing.PULL * seen)
        at = to
    return total


def halves(spark, texts):
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", F.xxhash64(F.lit(1), "text").bitwiseAND(1).alias("h")).collect()
    return {r.text: r.h for r in rows}


def test_mixing_equals_a_scalar_version(spark):
    texts = [prose(k, 20 + 60 * k, 60) for k in range(6)] + ["ab" * 150 + "é日", "x"]
    docs = make(spark, list(enumerate([*texts, texts[2]])))
    trees = mixing.Trees(mixing.pair_counts(docs))
    half, raw = halves(spark, texts), {x: x.encode() for x in texts}
    counts = [scalar_counts([raw[x] for x in texts if half[x] != h], trees) for h in (0, 1)]
    got = {r.doc_id: r.bits for r in mixing.bits_per_byte(docs).collect()}
    assert set(half.values()) == {0, 1} and got[len(texts)] == got[2]
    for k, x in enumerate(texts):
        assert got[k] == pytest.approx(scalar_bits(raw[x], trees, counts[half[x]]), rel=2e-3)


def test_mixing_counts_the_whole_corpus(spark):
    texts = [prose(k, 300, 50) for k in range(12)]
    want = np.zeros((256, 256), int)
    for x in texts:
        for a, b in itertools.pairwise([0, *x.encode()]):
            want[a, b] += 1
    assert (mixing.pair_counts(make(spark, list(enumerate(texts)))).reshape(256, 256) == want).all()
    trees = mixing.Trees(want.reshape(-1))
    values = mixing.count([T.raw(pa.array(texts[:5])), T.raw(pa.array(texts[5:]))], trees)
    for (k, at), (n0, n1) in scalar_counts([x.encode() for x in texts], trees).items():
        assert values[k, at] == round(max(-127, min(127, math.log((n1 + 0.4) / (n0 + 0.4)) * 15)))
    assert np.count_nonzero(values) <= len(scalar_counts([x.encode() for x in texts], trees))


def test_mixing_cells_grow_with_the_corpus(spark, monkeypatch):
    docs = make(spark, [(k, prose(k, 200, 50)) for k in range(60)])
    one = {r.doc_id: r.bits for r in mixing.bits_per_byte(docs).collect()}
    monkeypatch.setattr(mixing, "CELL", 5000)
    some = {r.doc_id: r.bits for r in mixing.bits_per_byte(docs).collect()}
    assert one.keys() == some.keys() and sum(one.values()) < sum(some.values())  # smaller cells know less


@pytest.mark.parametrize("cell", [64 << 20, 3000])
def test_mixing_counts_all_rows_but_the_scored_one(spark, monkeypatch, cell):
    texts = [prose(k, 20 + 60 * k, 60) for k in range(6)] + ["ab" * 150 + "é日", "x", prose(9, 400, 2000)]
    rows = [*texts, texts[2], texts[8]]
    docs = make(spark, list(enumerate(rows)))
    monkeypatch.setattr(mixing, "CELL", cell)
    trees = mixing.Trees(mixing.pair_counts(docs))
    got = {r.doc_id: r.bits for r in mixing.bits_per_byte(docs).collect()}
    assert len(got) == len(rows) and got[len(texts)] == got[2]
    for k, x in enumerate(rows):
        counts = scalar_counts([y.encode() for j, y in enumerate(rows) if j != k], trees)
        assert got[k] == pytest.approx(scalar_bits(x.encode(), trees, counts), rel=2e-3)


def test_mixing_sorts_bytes_once_to_count_and_twice_to_score(monkeypatch):
    texts = ["é日", "", *(prose(k, 20 + 90 * k, 300) for k in range(8)), "x"]
    data, offs = T.raw(pa.array(texts))
    sizes = {"followers": [], "sorted_places": []}
    for name, seen in sizes.items():
        monkeypatch.setattr(mixing, name, lambda key, *rest, f=getattr(mixing, name), seen=seen: (seen.append(len(key)), f(key, *rest))[1])
    key, n = mixing.gathered([(3, data, offs)])
    assert sum(sizes["followers"]) == len(data)
    want = {}
    for x in map(str.encode, texts):
        for i, k in itertools.product(range(len(x)), range(len(mixing.ORDERS))):
            at = k << 56 | before(x, i, mixing.ORDERS[k]) << 8 | x[i]
            want[at] = want.get(at, 0) + 3
    assert dict(zip(key.tolist(), n.tolist(), strict=True)) == want and key.tolist() == sorted(want)
    trees = mixing.Trees(np.bincount(mixing.pairs(data, offs), minlength=1 << 16))
    total = mixing.tables(key, n, trees, np.int32)
    bits = mixing.scored(data, offs, trees, total)
    assert sum(sizes["sorted_places"]) < 2.9 * len(data)
    for name, size in (("_PART", 700), ("_CHUNK", 300)):  # how much is done at once doesn't matter
        monkeypatch.setattr(mixing, name, size)
        assert mixing.scored(data, offs, trees, total) == pytest.approx(bits, rel=1e-5)


def test_mixing_scores_apart_what_occurs_twice(spark):
    rows = [prose(k, 150, 5000) for k in range(40)]
    got = {r.doc_id: r.bits_per_byte for r in mixing.bits_per_byte(make(spark, list(enumerate([*rows, *rows[:5]])))).collect()}
    assert max(got[k] for k in range(5)) < min(got[k] for k in range(5, 40))


def test_mixing_codes_are_proper():
    depth, steps = mixing.tree(np.arange(256) ** 2)
    assert sum(2.0 ** -int(d) for d in depth) == pytest.approx(1) and depth.max() < 24
    assert len({tuple(steps[: depth[b], b]) for b in range(256)}) == 256
    assert mixing.tree(np.array([10**12] + [0] * 255))[0].max() < 24


def test_mixing_finds_known_prose_cheaper_than_noise(spark):
    rows = [(k, prose(k, 200, 80)) for k in range(40)]
    noise = "".join(chr(33 + int(c)) for c in np.random.default_rng(1).integers(0, 90, 1500))
    got = {r.doc_id: r.bits_per_byte for r in mixing.bits_per_byte(make(spark, [*rows, (99, noise), (100, "abcdefgh" * 100)])).collect()}
    assert max(v for k, v in got.items() if k < 99) < 4 < got[99] and got[100] < 1


def test_mixing_edge_cases(spark, edge, empty):
    rows = mixing.bits_per_byte(edge).collect()
    assert len(rows) == 12 and mixing.bits_per_byte(empty).collect() == []
    assert all((r.n_bytes == 0) == (r.bits == 0) == (r.bits_per_byte is None) for r in rows)
    same = [r.bits for r in rows if r.doc_id in (5, 6)]
    assert len(same) == 3 and len(set(same)) == 1


# Classifiers


def split(spark, sf, label):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(label).alias("y_")), "doc_id").select("doc_id", "text", "y_").orderBy("doc_id").toPandas()
    seen = toxicity.unlike(pa.array(docs.text))  # copies of training rows aren't held out
    docs = docs[seen]
    return docs[docs.doc_id % 2 == 0], docs[docs.doc_id % 2 == 1]


def test_toxicity_on_held_out_rows(spark):
    a, b = split(spark, "/root/testdata/sf0.1", "toxic")
    fitted = toxicity.train(pa.array(a.text), a.y_.to_numpy())
    p = toxicity.probability(*T.raw(pa.array(b.text), lower=True), fitted) >= toxicity.THRESHOLD
    y = b.y_.to_numpy() == 1
    assert p[y].mean() >= 0.8 and p[~y].mean() <= 0.05, (p[y].mean(), p[~y].mean())


def test_only_near_copies_are_dropped_from_training():
    apart = [prose(k, 400, 40) for k in range(60)]  # many common pairs, no copies
    assert toxicity.unlike(pa.array(apart)).all()
    words = prose(99, 300).split()
    chain = [" ".join(words[k : k + 200]) for k in (0, 20, 40)]  # the second is a copy of the first; the third only of the second
    rows = [*apart, *chain, apart[7], apart[8] + " and more", "", "one", "one"]
    assert toxicity.unlike(pa.array(rows)).tolist() == [True] * 61 + [False, True, False, False, True, True, False]


def test_log_count_ratios_scale_the_features():
    texts = pa.array([f"clean text number {k} is fine and calm" for k in range(40)] + [f"clean text number {k} vilewordx here" for k in range(40)])
    weight, bias = toxicity.train_windows(texts, np.array([0] * 40 + [1] * 40))
    z = lambda s: toxicity.margins(*T.raw(pa.array([s])), weight, bias)[1][0]
    assert z("vilewordx") > 0 > z("is fine and calm")


def test_toxicity_edge_cases(spark, edge, empty, tiny):
    fitted = toxicity.model(spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet"))
    got = toxicity.scored(edge.select("doc_id", "text"), fitted).collect()
    assert len(got) == 12 and all(r.toxicity == 0 for r in got if r.doc_id in (1, 2))
    assert toxicity.scored(empty, fitted).collect() == []
    stage = toxicity.filter_stage(spark, edge, tiny)
    assert stage.columns == edge.columns and stage.count() >= 10
    one_class = spark.createDataFrame([(5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = toxicity.model(edge, one_class)
    assert all(r.toxicity < 0.5 for r in toxicity.scored(edge.select("doc_id", "text"), none).collect())
    assert all(r.toxicity < 0.5 for r in toxicity.scored(edge.select("doc_id", "text"), toxicity.model(empty, one_class.limit(0))).collect())


def test_quality_on_held_out_rows(spark, small):
    a, b = split(spark, small, "quality")
    fitted = quality.train(pa.array(a.text), a.y_.to_numpy())
    p = quality.probability(*T.raw(pa.array(b.text)), fitted)
    y = b.y_.to_numpy() == 1
    right = ((p >= 0.5) == y).mean()
    assert right >= 0.9, right
    assert abs(p.mean() - y.mean()) < 0.15  # calibrated


def test_quality_edge_cases(spark, edge, empty, tiny):
    got = quality.scored(edge, None).collect()
    assert {r.decision for r in got if r.doc_id in (1, 2, 3)} == {"reject"} and {r.decision for r in got if r.doc_id == 5} == {"keep"}
    assert quality.scored(empty, None).collect() == []
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = toxicity.sample(docs, spark.read.parquet(f"{tiny}/labels.parquet"), "quality", quality.SAMPLE)
    fitted = quality.train(rows["text"].combine_chunks(), rows["y"].to_numpy())
    got = quality.scored(edge, fitted).collect()
    assert len(got) == 12 and all(r.decision == "reject" and r.quality == 0 for r in got if r.doc_id in (1, 2))


def test_logistic_regression_and_calibration():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < linear.sigmoid(0.5 * z - 1)).astype(float)
    slope, shift = linear.calibrate(z, y)
    assert slope == pytest.approx(0.5, abs=0.08) and shift == pytest.approx(-1, abs=0.12)
    w, b = linear.fit(np.zeros(4000, int), z, np.arange(4001), y, 1, 0.0, rounds=300, rate=0.1)
    assert w[0] == pytest.approx(0.5, abs=0.08) and b == pytest.approx(-1, abs=0.12)


# Personal data


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        k, sizes = 3, rng.integers(0, 6, 5)
        woffs = np.concatenate([[0], np.cumsum(sizes)])
        score, start, step = rng.normal(0, 2, (woffs[-1], k)), rng.normal(0, 1, k), rng.normal(0, 1, (k, k))
        for decode in (pii.viterbi, pii.decode):
            got = decode(score, woffs, start, step)
            for a, b in zip(woffs[:-1], woffs[1:], strict=True):
                total = lambda y: start[y[0]] + sum(score[a + i, x] for i, x in enumerate(y)) + sum(step[p, q] for p, q in itertools.pairwise(y))  # noqa: B023, E731
                if b > a:
                    assert tuple(got[a:b]) == max(itertools.product(range(k), repeat=b - a), key=total)


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_table())


def test_field_on_a_held_out_labelled_table(field):
    rows = pii.labelled_table(seed=77)
    by = {}
    for s, _, token, label in rows:
        by.setdefault(s, []).append((token, label))
    data, offs = T.raw(pa.array([t for x in by.values() for t, _ in x]))
    starts, ends, woffs = offs[:-1], offs[1:], np.cumsum([0, *(len(x) for x in by.values())])
    first, last = pii._ends(woffs, len(starts))
    got = pii.decode(pii._scores(pii.shapes(data, starts, ends), first, last, field), woffs, field[1], field[2])
    want = np.array([pii.LABELS.index(y) for x in by.values() for _, y in x])
    hit = (got == want)[want > 0].mean()
    assert hit >= 0.97 and (got > 0)[want == 0].mean() <= 0.02, hit


def test_spans_and_replacement(spark, field, tiny):
    text = "Ünser mail ana.bo@mail3.example.com, call +1 (555) 123-4567 or 192.168.10.20 now. Card 4111111111111111!"
    docs = make(spark, [(1, text), (2, "nothing private in here"), (3, text)])
    got = {(r.kind, r.value) for r in pii.spans(docs, field).where("doc_id = 1").collect()}
    assert got == {("EMAIL", "ana.bo@mail3.example.com"), ("PHONE", "+1 (555) 123-4567"), ("IP", "192.168.10.20"), ("CARD", "4111111111111111")}
    for r in pii.spans(docs, field).collect():
        assert text[r.start : r.end] == r.value
    out = {r.doc_id: r for r in pii.filter_stage(spark, docs, tiny).collect()}
    assert out[1].text == out[3].text == "Ünser mail [EMAIL], call [PHONE] or [IP] now. Card [CARD]!" and out[1].n_chars == len(out[1].text) and out[2].text == "nothing private in here"


def test_personal_data_in_unbroken_tokens(spark, field, tiny):
    mail, card = "ana.bo@mail3.example.com", "4111111111111111"
    around = {
        "json": lambda x: "{" + ",".join(f'"k{i}":"value{i}"' for i in range(300)) + f',"email":"{x}",' + ",".join(f'"z{i}":{i}' for i in range(500)) + "}",
        "csv": lambda x: ",".join(f"cell{i}" for i in range(700)) + f",{x},12," + ";".join(f"cell{i}" for i in range(700)),
        "url": lambda x: "https://w.example.com/" + "path/" * 900 + f"?a=b&mail={x}&c=" + "d" * 5000,
        "path": lambda x: "/part" * 1000 + f"/{x}/" + "part/" * 1000,
        "japanese": lambda x: "日本語の文章" * 280 + x + "です。連絡先" * 280,
    }
    rows = [(k, x) for k, x in enumerate((f(what), what) for f in around.values() for what in (mail, card))]
    docs = make(spark, [(k, text) for k, (text, _) in rows])
    assert all(len(text.encode()) > 9_000 and not set(text) & set(" \n\t") for _, (text, _) in rows)
    got = {(r.doc_id, r.kind, r.value) for r in pii.spans(docs, field).collect()}
    assert got == {(k, "EMAIL" if what == mail else "CARD", what) for k, (_, what) in rows}
    out = {r.doc_id: r.text for r in pii.filter_stage(spark, docs, tiny).collect()}
    assert all(out[k] == text.replace(what, "[EMAIL]" if what == mail else "[CARD]") for k, (text, what) in rows)


def test_spans_are_cut_at_punctuation(spark, field):
    key = "deadbeefdeadbeef0123deadbeefdeadbeef4567"
    cases = {
        f"set api_key={key} now": ("SECRET", key), "see http://10.20.30.40/x now": ("IP", "10.20.30.40"), "host 10.20.30.41:8080 is up": ("IP", "10.20.30.41"),
        "mailto:ana.bo@mail3.example.com?subject=hi": ("EMAIL", "ana.bo@mail3.example.com"), '{"email":"ana.bo@mail3.example.com","b":"xxx"}': ("EMAIL", "ana.bo@mail3.example.com"),
    }
    for x, (kind, value) in cases.items():
        _, s, e, k, data, _ = pii.find(pa.array([x]), field)
        got = [(pii.KINDS[c], data[a:b].tobytes().decode()) for a, b, c in zip(s, e, k, strict=True)]
        assert got and {c for c, _ in got} == {kind} and got[-1][1].endswith(value), (x, got)
        assert kind == "SECRET" or got[0][1] == value


def test_personal_data_edge_cases(spark, edge, empty, field, tiny):
    assert pii.spans(edge, field).collect() == [] and pii.spans(empty, field).collect() == []
    stage = pii.filter_stage(spark, edge, tiny)
    assert stage.columns == edge.columns and sorted(map(str, stage.collect())) == sorted(map(str, edge.collect()))


# Language


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.fresh(3, rng).items()}
    x, y = rng.integers(97, 103, (7, 4)), np.array([0, 1, 2, 1])
    _, g = langid.gradients(p, x, y)
    for k in p:
        for _ in range(4):
            at = (x[rng.integers(7), rng.integers(4)], rng.integers(p[k].shape[1])) if k[1:] == "x" else tuple(rng.integers(n) for n in p[k].shape)
            was, eps = p[k][at], 1e-3
            p[k][at] = was + eps
            up = langid.gradients(p, x, y)[0]
            p[k][at] = was - eps
            down = langid.gradients(p, x, y)[0]
            p[k][at] = was
            assert g[k][at] == pytest.approx((up - down) / (2 * eps), abs=2e-4)


def test_pooling_equals_a_plain_forward_pass():
    rng = np.random.default_rng(1)
    p = langid.fresh(3, rng)
    texts = ["abc", "", "hello world " * 40, "é" * 70]
    mass, votes = langid.pooled(*T.raw(pa.array(texts)), langid.halves(p), lanes=3)
    for i, x in enumerate(texts):
        want, labels, raw = np.zeros(3), np.zeros(3), np.frombuffer(x.encode(), np.uint8)
        for a in range(0, len(raw), langid.SPAN):
            lo = max(0, a - langid.WARM)
            part = raw[lo : a + langid.SPAN + langid.WARM]
            logits = np.tile(p["b"].astype(float), (len(part), 1))
            for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
                h = np.zeros(langid.HIDDEN)
                for t in order:
                    e = p[f"{d}x"][part[t]]
                    zr = langid.sigmoid(e[: 2 * langid.HIDDEN] + h @ p[f"{d}u"])
                    z, r = zr[: langid.HIDDEN], zr[langid.HIDDEN :]
                    c = np.tanh(e[2 * langid.HIDDEN :] + r * (h @ p[f"{d}n"] + p[f"{d}c"]))
                    h = z * h + (1 - z) * c
                    logits[t] += h @ p[f"{d}v"]
            q = np.exp(logits - logits.max(1, keepdims=True))
            core = slice(a - lo, a - lo + min(langid.SPAN, len(raw) - a))
            want += (q / q.sum(1, keepdims=True))[core].sum(0)
            labels += np.bincount(logits[core].argmax(1), minlength=3)
        assert mass[i] == pytest.approx(want, abs=1e-2) and votes[i] == pytest.approx(labels, abs=1)


def test_languages_of_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, weights = langid.model(docs.where("doc_id % 2 = 0"))
    got = langid.labelled(docs.where("doc_id % 2 = 1"), names, weights).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    right = got.language == got.lang
    assert right[got.n_chars >= 100].mean() >= 0.95 and right.mean() >= 0.9 and right[got.n_chars < 100].mean() >= 0.6, (right.mean(), right[got.n_chars < 100].mean())


def test_languages_of_short_rows_are_learnt(spark):
    rows = [(k, f"der{k} und ist", "de") for k in range(60)] + [(100 + k, f"the{k} and was", "en") for k in range(60)]
    names, weights = langid.model(make(spark, rows))
    got = langid.labelled(make(spark, [(1, "und ist der", ""), (2, "and was the", "")]), names, weights)
    assert {r.doc_id: r.language for r in got.collect()} == {1: "de", 2: "en"}


def test_language_edge_cases(spark, edge, empty):
    names, weights = langid.model(edge)
    got = langid.labelled(edge, names, weights).collect()
    assert names == ["en"] and len(got) == 12
    assert all((r.language is None) == (r.doc_id in (1, 2) or (r.doc_id is None and r.language is None)) for r in got)
    assert langid.labelled(edge, *langid.model(empty)).where("language is not null").count() == 0
    assert langid.labelled(empty, names, weights).collect() == []
