"""Near copies, contamination and shared passages against brute force, and their edge cases."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from .conftest import make, prose
from marlstone.llm import decontaminate, jaccard, repeats


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def corpus(spark, tiny, extra=()):
    got = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    r = random.Random(1)
    for k in range(30):  # near copies at many distances
        w = got[k][1].split(" ")
        for _ in range(max(1, len(w) * (k % 10) // 40)):
            w[r.randrange(len(w))] = f"zz{r.randrange(10**6)}"
        got.append((10_000 + k, " ".join(w)))
    return got + list(extra)


def classes(rows):
    """Sets of shingles, each with the ids that have it."""
    out = {}
    for i, x in rows:
        if i is not None and grams(x, jaccard.N):
            out.setdefault(frozenset(grams(x, jaccard.N)), set()).add(i)
    return out


def brute_pairs(rows, t):
    """Rows (doc_a, doc_b, jaccard): representatives of similar classes, and members with theirs."""
    flat = [(min(ids), s, ids) for s, ids in classes(rows).items()]
    out = {(i, k, 1.0) for i, _, ids in flat for k in ids if k != i}
    for (i, s, _), (j, u, _) in itertools.combinations(flat, 2):
        if i != j and (v := len(s & u) / len(s | u)) >= t:
            out.add((min(i, j), max(i, j), round(v, 6)))
    return sorted(out)


def links(spark, rows):
    """As ``brute_pairs``, from the operator's parts."""
    found, classes, members = jaccard.similar(make(spark, rows), jaccard.THRESHOLD)
    first = {r.print: r.first.doc_id for r in classes.collect()}
    out = {(*sorted((first[r.a], first[r.b])), round(r.jaccard, 6)) for r in found.collect()}
    return sorted(out | {(first[r.print], r.doc_id, 1.0) for r in members.collect() if first[r.print] != r.doc_id})


def test_jaccard_join_is_exact(spark, tiny):
    rows = corpus(spark, tiny, [(20_000 + k, "same short text") for k in range(40)] + [(30_000, "same short")])
    want = brute_pairs(rows, jaccard.THRESHOLD)
    assert links(spark, rows) == want
    got = {r.doc_id: r for r in jaccard.linked(make(spark, rows)).collect()}
    ids = {i for a, b, _ in want for i in (a, b)}
    assert set(got) == ids and got[20_007].copies == 39 and got[20_007].links == 0 and got[20_007].class_id == 20_000
    kept = first_of_each_group(rows)
    assert {r.class_id for r in got.values()} == ids & set(kept)
    for i, r in got.items():
        assert r.links == sum(j < 1 and i in (a, b) for a, b, j in want) or r.copies


def test_hot_shingles_and_large_families_are_cut_in_blocks(spark, monkeypatch):
    base = prose(8, 120).split()
    rows = [(k, " ".join([*base[: k % 7], f"u{k}", f"v{k}", *base[k % 7 + 2 :]])) for k in range(70)] + [(100 + k, prose(k, 50)) for k in range(40)]
    want = brute_pairs(rows, jaccard.THRESHOLD)
    assert len(want) > 2000
    assert links(spark, rows) == want
    for name, value in (("HOT", 7), ("BLOCK_BYTES", 9000), ("TASK_BYTES", 20_000)):
        monkeypatch.setattr(jaccard, name, value)
    assert links(spark, rows) == want

def test_pairs_of_large_families_are_not_listed(spark, monkeypatch):
    base = prose(8, 120).split()
    near = [(k, " ".join([*base[: k % 7], f"u{k}", f"v{k}", *base[k % 7 + 2 :]])) for k in range(220)]
    far = [(1000 + k, " ".join([*base[:40], *prose(k, 12).split(), *base[60:]])) for k in range(40)]
    copies = [(2000 + k, near[k][1]) for k in range(5)]
    rows = [*near, *far, *copies, *((3000 + k, prose(k, 50)) for k in range(40))]
    want = brute_pairs(rows, jaccard.THRESHOLD)
    docs = make(spark, rows)
    found, dense, _, _ = jaccard.candidates(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text"), jaccard.THRESHOLD)
    assert len(want) > 20_000 and found.count() < len(want) / 8 and dense.count() < len(want)
    degree = {}
    for a, b, j in want:
        if j < 1:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    got = {r.doc_id: (r.links, r.copies) for r in jaccard.linked(docs).collect()}
    assert got == {i: (degree.get(i % 2000 if 2000 <= i < 2005 else i, 0), int(i < 5 or 2000 <= i < 2005)) for p in want for i in p[:2]}
    for name, value in (("DENSE", 1), ("FAMILY_BYTES", 30_000)):
        monkeypatch.setattr(jaccard, name, value)
    assert links(spark, rows) == want


def test_a_dense_shingle_gives_one_list_of_its_groups(monkeypatch):
    r, n = np.random.default_rng(2), 400
    record = np.zeros(n + 60, jaccard._RECORD)
    record["token"], record["group"], record["size"] = 7, np.arange(n + 60), r.integers(90, 110, n + 60)
    record["at"] = r.integers(0, 30, n + 60) | r.integers(0, 3, n + 60) << 30
    record["low"] = np.where(r.random(n + 60) < 0.5, 5, np.arange(n + 60) + 10)
    record["at"][n:] = 80  # too late to be in a pair
    with_partner, pairs = set(), 0
    for a, b in itertools.combinations(record, 2):
        x, y, side = a["at"] & 0x3FFFFFFF, b["at"] & 0x3FFFFFFF, a["at"] >> 30
        ok = min(a["size"] - x, b["size"] - y) >= jaccard.least_overlap(a["size"], b["size"], 0.7) and (side == 0 or side != b["at"] >> 30)
        if ok and not (x and y and a["low"] == b["low"]):
            with_partner |= {int(a["group"]), int(b["group"])}
            pairs += 1
    found = list(jaccard.joined(record, 0.7, 1 << 12))
    lists = np.concatenate([x[1] for x in found])
    assert pairs > jaccard.DENSE * len(with_partner) and len(lists) == len(with_partner) < n + 60
    assert set(lists[:, 1].tolist()) == with_partner and len(set(lists[:, 0].tolist())) == 1
    assert sum(len(x[0]) for x in found) == 0
    monkeypatch.setattr(jaccard, "DENSE", n)
    assert sum(len(x[0]) for x in jaccard.joined(record, 0.7, 1 << 12)) == pairs


def test_sets_of_several_families_are_linked_once(monkeypatch):
    keys, offs = np.array([1, 2, 3, 4]), np.arange(5) * 10
    codes = np.concatenate([np.arange(10), np.arange(10), np.arange(10), np.arange(50, 60)]).astype(np.int32)
    less = [[7], [7], [], [7]]
    got = list(jaccard.compared(keys, codes, offs, np.zeros(4, int), less, 0.7, True))
    assert sorted((int(a), int(b)) for x, y, _, _ in got for a, b in zip(x, y, strict=True)) == [(1, 3), (2, 3)]
    edges, ends = jaccard.compared(keys, codes, offs, np.zeros(4, int), less, 0.7, False)
    assert dict(zip(ends[0].tolist(), ends[3].tolist(), strict=True)) == {1: 1, 2: 1, 3: 2} and len(edges[0]) == 2
    two = list(jaccard.compared(keys, codes, offs, np.array([1, 1, 2, 2]), [[], [], [], []], 0.7, True))
    assert sorted((int(a), int(b)) for x, y, _, _ in two for a, b in zip(x, y, strict=True)) == [(1, 3), (2, 3)]


def test_jaccard_join_edge_cases(spark, edge, empty):
    assert sorted(map(tuple, jaccard.linked(edge).collect())) == [(5, 5, 0, 1), (6, 5, 0, 1)]
    assert jaccard.linked(empty).collect() == []


def test_jaccard_stage_keeps_one_of_each_group(spark, edge, empty, tiny):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in jaccard.filter_stage(spark, edge, "").collect()) == sorted([(True, 0)] * 2 + [(False, k) for k in (1, 2, 3, 4, 5, 7, 8, 9)])
    assert jaccard.filter_stage(spark, empty, "").collect() == []
    rows = corpus(spark, tiny)
    docs = make(spark, rows)
    kept = jaccard.filter_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == first_of_each_group(rows)


def first_of_each_group(rows):
    """The ids that stay, where ids are different."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, _ in brute_pairs(rows, jaccard.THRESHOLD):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return sorted(i for i in root if find(i) == i)


def test_jaccard_stage_shuffles_no_texts_for_few_ids(spark, capsys):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.filter_stage(spark, make(spark, [(k, prose(k % 20, 50)) for k in range(40)]), "")
        kept.explain()
        assert "Exchange hashpartitioning" not in capsys.readouterr().out
        assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_jaccard_stage_tells_texts_of_one_id_apart(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (7, a), (7, b), (9, b + " x"), (9, b + " x"), (3, a + " y"), (12, "Other Words here"), (12, "other words HERE")]
    got = sorted((r.doc_id, r.text) for r in jaccard.filter_stage(spark, make(spark, rows), "").collect())
    assert got[:2] == [(1, a), (7, b)] and len(got) == 3 and got[2][0] == 12
    named = spark.createDataFrame([("5", a, 1, "p"), ("x", a, 2, "q"), ("6", a, 3, "r"), ("5", a, 1, "p")], "doc_id string, text string, hash int, __row string")
    assert sorted(map(tuple, jaccard.filter_stage(spark, named, "").collect())) == [("5", a, 1, "p"), ("x", a, 2, "q")]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 103), (101, 103), (101, 102)], "a long, b long")
    got = {r.v: r.root for r in jaccard.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in (101, 102, 103)}


def test_containment_is_found_in_long_documents(spark, tiny):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").collect()]
    rows = corpus(spark, tiny)
    for k, (_, x) in enumerate(items):  # whole items and parts of them, at any place of long texts
        w = x.split()
        part = w[: max(5, len(w) * (60 + k) // 100)]
        at = 37 * k
        base = prose(k, 6000).split()
        rows.append((50_000 + k, " ".join(base[:at] + part + base[at:])))
    rows += [(51_000, "some words, four short Words here"), (51_001, "nearly four short words"), (51_002, "Three words yes"), (51_003, "four short words")]
    bench = spark.createDataFrame([*items, (800, "Four short words here!"), (801, "four short words here"), (802, "three words yes"), (900, "too short"), (901, None), (902, ""), (None, items[0][1])], "item_id long, text string")
    got = {(r.item_id, r.doc_id): r.containment for r in decontaminate.matches(make(spark, rows), bench).collect()}
    want = {(800, 51_000): 1.0, (801, 51_000): 1.0, (802, 51_002): 1.0}
    for i, x in items:
        s = grams(x, decontaminate.N)
        if len(words(x)) >= decontaminate.N:
            for d, y in rows:
                if len(words(y)) >= decontaminate.N and (v := len(s & grams(y, decontaminate.N)) / len(s)) >= decontaminate.THRESHOLD:
                    want[i, d] = round(v, 6)
    assert got == want and len([k for k in want if k[1] >= 50_000]) >= len(items) + 3


def test_containment_edge_cases(spark, edge, empty, tiny):
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    assert decontaminate.matches(edge, bench).collect() == []
    assert decontaminate.matches(empty, bench).collect() == []
    assert decontaminate.matches(edge, bench.limit(0)).collect() == []
    stage = decontaminate.filter_stage(spark, edge, tiny)
    assert stage.columns == edge.columns and stage.count() == edge.count()


def test_items_in_several_slices(spark, tiny, monkeypatch):
    docs, bench = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    one = sorted(map(tuple, decontaminate.matches(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "SLICE", 7)
    assert sorted(map(tuple, decontaminate.matches(docs, bench).collect())) == one


def brute_passages(rows):
    at = {}
    n = repeats.LEAST
    for k, (i, x) in enumerate(rows):
        w = words(x)
        if i is not None:
            for p in range(len(w) - n + 1):
                at.setdefault(tuple(w[p : p + n]), []).append((k, p))
    hit = {}
    for places in at.values():
        if len({k for k, _ in places}) > 1:
            for k, p in places:
                hit.setdefault(k, set()).add(p)
    out = []
    for k, ps in hit.items():
        start = end = None
        for p in sorted(ps):
            if start is None or p > end:
                if start is not None:
                    out.append((rows[k][0], start, end))
                start = p
            end = p + n
        out.append((rows[k][0], start, end))
    return sorted(out)


def test_passages_are_exact(spark, tiny):
    rows = corpus(spark, tiny)
    shared = [prose(s, 50 + 13 * s, 10**6) for s in range(12)]
    for k in range(60):
        rows.append((60_000 + k, " ".join([prose(1000 + k, 40 + k, 10**6), shared[k % 12], prose(2000 + k, 30, 10**6), shared[(k * 7) % 12].rsplit(" ", k % 9)[0]])))
    rows += [(70_000, prose(5, 49, 10**6)), (70_001, prose(5, 49, 10**6)), (70_002, "a " * 300), (70_003, "a " * 200)]
    want = brute_passages(rows)
    assert sorted(map(tuple, repeats.passages(make(spark, rows)).collect())) == want and len(want) > 100


def test_passages_without_a_bit_table(spark, tiny, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    one = sorted(map(tuple, repeats.passages(docs).collect()))
    monkeypatch.setattr(repeats, "MOST_KEYS", -1)
    assert sorted(map(tuple, repeats.passages(docs).collect())) == one


def test_passages_edge_cases(spark, edge, empty):
    assert repeats.passages(edge).collect() == []
    assert repeats.passages(empty).collect() == []
    twice = make(spark, [(1, prose(3, 80)), (1, prose(3, 80)), (None, prose(3, 80))])
    assert sorted(map(tuple, repeats.passages(twice).collect())) == [(1, 0, 80)] * 2
