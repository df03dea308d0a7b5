"""SentencePiece encoding and decoding with N-best segmentation: forward Viterbi scores steer a backward A-star search.

Spaces stand for the vocabulary's space sign, one is put before a text, and nothing else is
normalised, so that decoding gives the text back byte by byte. Unknown characters (and the space sign itself, if a text
has it) become byte pieces. A segmentation scores the sum of its pieces' scores; a model
that holds ranks in place of scores gets log-probabilities by Zipf's law, -log(rank + 2).

No piece has a character before a space sign, or a line end within it, so the piece lattice of a text falls apart
at word starts and line ends. The lattices of a slice's different words are built at once: from each
byte, for each length, as long as it begins a piece. Viterbi runs forward over them, all words side by side. Its
scores f are exact heuristics: from a node of the best path backwards, an edge loses f(end) - f(start) - score, and so
each word's second best is known. The ``NBEST`` segmentations of a text change only the NBEST - 1 words whose second
bests lose least; there the agenda of the backward A-star search runs (priority: f(node) + score of what follows), and
sums over words give the text's best, exactly.

``ids`` is the best segmentation. ``alternatives`` are the others from the second best on, each with its score and its
edits: at index ``at`` of ``ids``, ``drop`` pieces give way to ``pieces``. Ties are put in order of what is changed first.
Defined cases: a null text has null results; an empty one no pieces, score 0 and no alternatives;
repeated rows come out alike; null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text
from .store import table

MODEL, NBEST, UNKNOWN_LOSS = "/opt/tokenizers/piece_bpe_32k.model", 4, 10.0
#: Units of a score in the search, where sums are whole numbers and ties exact.
FIXED = 10**9
_SPACE = "▁".encode()


class Vocabulary:
    """Pieces of a SentencePiece model file as tables for numpy: hash to id, scores, byte pieces."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.pieces: list[bytes] = [m.id_to_piece(i).encode().replace(_SPACE, b" ") for i in range(n)]
        self.byte_of = np.full(n, -1)
        self.byte_id = np.full(256, -1)
        normal = []
        for i in range(n):
            if m.is_byte(i):
                b = int(m.id_to_piece(i)[3:5], 16)
                self.byte_of[i], self.byte_id[b] = b, i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                normal.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        raw = np.array([m.get_score(i) for i in range(n)])
        own = raw[normal]
        ranks = len(own) and (own <= 0).all() and (own == np.round(own)).all()
        self.score = np.where(raw > -1e8, -np.log(np.maximum(0, -raw) + 2), raw.min()) if ranks else raw
        self.score[[i for i in normal if raw[i] < -1e8]] = -np.log(n + 2)
        self.unknown = float(self.score[normal].min()) - UNKNOWN_LOSS
        first: dict[bytes, int] = {}
        for i in normal:
            first.setdefault(self.pieces[i], i)
        self.ids = first
        if any(b" " in p.lstrip(b" ") or (b"\n" in p and len(p) > 1) for p in first):
            raise ValueError("a piece crosses a word start or a line end")
        self.fixed, self.fixed_unknown = np.round(self.score * FIXED).astype(np.int64).tolist(), round(self.unknown * FIXED)
        self.lengths = sorted({len(p) for p in first})
        self.longest = max(self.lengths)
        self.hash, self.of = self._table(sorted(first))
        starts = {p[:k] for p in first for k in range(1, len(p) + 1)}
        self.begins = np.zeros(1 << 20, bool)
        self.begins[self._hashes(sorted(starts)) >> text.U(44)] = True
        slot = (self.hash >> text.U(44)).astype(np.int64)
        count = np.bincount(slot, minlength=1 << 20)
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[slot] = np.arange(len(slot))
        self.slot[count > 1] = -2

    @staticmethod
    def _hashes(words: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        s, inv = text.sums(data)
        return text.span(s, inv, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)

    def _table(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h = self._hashes(words)
        order = np.argsort(h)
        return h[order], np.array([self.ids[w] for w in words], np.int32)[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashes, -1 where there is no piece."""
        at = self.slot[h >> text.U(44)]
        many = np.flatnonzero(at == -2)
        if len(many):
            at[many] = np.minimum(np.searchsorted(self.hash, h[many]), len(self.hash) - 1)
        return np.where((at >= 0) & (self.hash[at] == h), self.of[at], -1)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def lattice_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words that the lattice falls apart into (all bytes belong to one), and the rows' offsets into them."""
    new = np.zeros(len(data), bool)
    if len(data):
        prev = np.concatenate([[10], data[:-1]])
        new = ((data == 32) & (prev != 32)) | (data == 10) | (prev == 10)
        new[offs[:-1][offs[:-1] < offs[1:]]] = True
    starts = np.flatnonzero(new)
    return starts, np.searchsorted(starts, offs)


def segmented(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best pieces of words (flat ids and their offsets), scores, and what the second best of each loses."""
    size = ends - starts
    n = len(size)
    node = np.concatenate([[0], np.cumsum(size + 1)])  # of each word's start
    src = np.repeat(starts - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
    body = data[src]
    base = np.concatenate([[0], np.cumsum(size)])
    t = np.arange(len(body)) - np.repeat(base[:-1], size)
    left = np.repeat(size, size) - t
    at_node = np.repeat(node[:-1], size) + t
    head = (body & 0xC0) != 0x80
    head |= t == 0
    s, inv = text.sums(body)
    live = np.flatnonzero(head)
    single = np.zeros(len(body), bool)
    groups: list[tuple[np.ndarray, int, np.ndarray]] = []
    width = np.zeros(len(body), np.int64)
    heads = np.flatnonzero(head)
    width[heads] = np.diff(np.append(heads, len(body)))
    width[heads] = np.minimum(width[heads], left[heads])
    for length in range(1, v.longest + 1):
        live = live[left[live] >= length]
        if not len(live):
            break
        h = text.mix((s[live + length] - s[live]) * inv[live])
        on = v.begins[h >> text.U(44)]
        live, h = live[on], h[on]
        got = v.find(h)
        hit = got >= 0
        where, ids = live[hit], got[hit]
        single[where[width[where] == length]] = True
        groups.append((where, length, ids))
    unknown = heads[~single[heads]]
    for w in np.unique(width[unknown]):
        where = unknown[width[unknown] == w]
        groups.append((where, int(w), np.full(len(where), -1, np.int32)))
    steps: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for where, length, ids in groups:
        k = t[where]
        order = np.argsort(k.astype(np.uint16) if not len(k) or k.max() < 65536 else k, kind="stable")
        where, ids, k = where[order], ids[order], k[order]
        cut = np.flatnonzero(np.diff(k)) + 1
        for a, b in zip(np.concatenate([[0], cut]), np.append(cut, len(k)), strict=True):
            if a < b:
                steps.append((int(k[a]), length, where[a:b], ids[a:b]))
    steps.sort(key=lambda x: (x[0], x[1]))
    total = int(node[-1])
    f = np.full(total, -np.inf)
    f[node[:-1]] = 0
    back, back_id = np.full(total, -1, np.int64), np.full(total, -1, np.int32)
    for _, length, where, ids in steps:
        a = at_node[where]
        e = a + length
        new = f[a] + np.where(ids >= 0, v.score[ids], v.unknown)
        up = new > f[e]
        e = e[up]
        f[e], back[e], back_id[e] = new[up], a[up], ids[up]
    last = node[1:] - 1
    path = np.zeros(total, bool)
    counts, cur, word = np.zeros(n, np.int64), last.copy(), np.arange(n)
    trail = []
    while len(cur):
        on = back[cur] >= 0
        cur, word = cur[on], word[on]
        if not len(cur):
            break
        path[cur] = True
        wide = np.where(back_id[cur] >= 0, 1, cur - back[cur])
        trail.append((word, cur, counts[word].copy(), wide))
        counts[word] += wide
        cur = back[cur]
    offs = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offs[-1], np.int32)
    for word, cur, before, wide in trail:
        place = offs[word + 1] - before - wide
        known = back_id[cur] >= 0
        out[place[known]] = back_id[cur[known]]
        odd = np.flatnonzero(~known)
        for k in range(int(wide[odd].max()) if len(odd) else 0):
            some = odd[wide[odd] > k]
            byte = src[base[word[some]] + back[cur[some]] - node[word[some]] + k]
            out[place[some] + k] = v.byte_id[data[byte]]
    loss = np.full(n, np.inf)
    owner = np.repeat(np.arange(n), size)
    for _, length, where, ids in steps:
        a = at_node[where]
        e = a + length
        pick = np.flatnonzero(path[e] & ((back[e] != a) | (back_id[e] != ids)))
        if len(pick):
            a, e, ids = a[pick], e[pick], ids[pick]
            lost = f[e] - (f[a] + np.where(ids >= 0, v.score[ids], v.unknown))
            w = owner[where[pick]]
            loss[w] = np.minimum(loss[w], lost)  # each word at most once in a step
    return out, offs, f[last], loss


def search(word: bytes, n: int, v: Vocabulary) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of a word: score and ids, best first, by backward A-star with forward Viterbi scores."""
    size = len(word)
    heads = [i for i in range(size) if i == 0 or word[i] & 0xC0 != 0x80] + [size]
    into: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]
    f: list[int | None] = [None] * (size + 1)
    f[0] = 0
    for j, i in enumerate(heads[:-1]):
        here = f[i]
        if here is None:
            continue
        one = heads[j + 1]
        edges = [(e, got) for e in range(i + 1, min(size, i + v.longest) + 1) if (got := v.ids.get(word[i:e])) is not None]
        known = any(e == one for e, _ in edges)
        for e, got in edges if known else [*edges, (one, -1)]:
            score = v.fixed[got] if got >= 0 else v.fixed_unknown
            into[e].append((i, got, score))
            f[e] = here + score if f[e] is None else max(f[e], here + score)
    # Of equal priorities the one nearest to the word's start comes first: else, ties would be searched in breadth.
    agenda: list[tuple[int, int, int, int, tuple | None]] = [(-f[size], size, 0, 0, None)]
    turn, found = itertools.count(1), []
    while agenda and len(found) < n:
        _, at, _, after, path = heapq.heappop(agenda)
        if at == 0:
            ids: list[int] = []
            while path:
                own, path = path
                ids += own
            found.append((after / FIXED, tuple(ids)))
            continue
        for i, got, score in into[at]:
            own = (got,) if got >= 0 else tuple(int(v.byte_id[b]) for b in word[i:at])
            heapq.heappush(agenda, (-(f[i] + score + after), i, next(turn), score + after, (own, path)))
    return found


def led(found: list[tuple[float, tuple[int, ...]]], best: tuple[int, ...]) -> list[tuple[float, tuple[int, ...]]]:
    """The segmentations with the best one that Viterbi chose first; it ties with the first, if it isn't that."""
    rest = [x for x in found if x[1] != best]
    return [(found[0][0], best), *(rest if len(rest) < len(found) else rest[:-1])]


def combined(choices: list[list[tuple[float, tuple[int, ...]]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best ways to choose one of each list: what they lose, and the indexes chosen, best first."""
    found = []
    agenda = [(0.0, (0,) * len(choices))]
    seen = {agenda[0][1]}
    while agenda and len(found) < n:
        lost, at = heapq.heappop(agenda)
        found.append((lost, at))
        for k, c in enumerate(choices):
            if at[k] + 1 < len(c):
                nxt = (*at[:k], at[k] + 1, *at[k + 1 :])
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(agenda, (sum(c[0][0] - c[i][0] for c, i in zip(choices, nxt, strict=True)), nxt))
    return found


def encode(texts: pa.Array, v: Vocabulary, n: int = NBEST, best_only: bool = False, cache: dict | None = None) -> dict:
    """ids and ioffs (flat best pieces), score of each row, and alternatives (lists of (score, edits))."""
    data, offs = text.raw(texts)
    size = np.diff(offs)
    full = size > 0
    moved = np.empty(len(data) + full.sum(), np.uint8)
    shift = np.cumsum(full)
    put = offs[:-1][full] + shift[full] - 1
    moved[put] = 32
    rest = np.ones(len(moved), bool)
    rest[put] = False
    moved[rest] = data
    offs = offs + np.concatenate([[0], shift])
    starts, woffs = lattice_words(moved, offs)
    ends = np.append(starts[1:], len(moved)) if len(starts) else starts
    s, inv = text.sums(moved)
    h = text.span(s, inv, starts, ends)
    _, first, word = np.unique(h, return_index=True, return_inverse=True)
    flat, foffs, score, loss = segmented(moved, starts[first], ends[first], v)
    count = np.diff(foffs)[word]
    into = np.concatenate([[0], np.cumsum(count)])
    ids = flat[np.repeat(foffs[:-1][word] - into[:-1], count) + np.arange(into[-1])]
    # A row without words takes what stands at its offset; it is set to 0.
    sums = np.add.reduceat(np.append(score[word], 0.0), woffs[:-1]) * (np.diff(woffs) > 0) if len(woffs) > 1 else np.zeros(0)
    out = {"ids": ids, "ioffs": into[woffs], "score": sums}
    if best_only:
        return out
    cache = {} if cache is None else cache
    buffer = moved.tobytes()
    lost = loss[word]
    alternatives = []
    for r in range(len(offs) - 1):
        a, b = woffs[r], woffs[r + 1]
        own = lost[a:b]
        if b - a > n - 1:
            edge = np.partition(own, n - 2)[n - 2]
            sure = np.flatnonzero(own < edge)
            tied = np.flatnonzero(own == edge)[: n - 1 - len(sure)]
            pick = np.sort(np.concatenate([sure, tied]))
        else:
            pick = np.arange(b - a)
        pick = pick[own[pick] < np.inf]
        if n < 2 or not len(pick):
            alternatives.append([])
            continue
        choices = []
        for k in pick:
            w = buffer[starts[a + k] : ends[a + k]]
            if w not in cache:
                if len(cache) > 200_000:
                    cache.clear()
                i = word[a + k]
                cache[w] = led(search(w, n, v), tuple(flat[foffs[i] : foffs[i + 1]].tolist()))
            choices.append(cache[w])
        row = []
        for gone, at in combined(choices, n)[1:]:
            edits = [(int(into[a + pick[k]] - into[a]), len(choices[k][0][1]), list(choices[k][i][1])) for k, i in enumerate(at) if i]
            row.append((float(out["score"][r] - gone), edits))
        alternatives.append(row)
    out["alternatives"] = alternatives
    return out


def decode(ids: np.ndarray, ioffs: np.ndarray, v: Vocabulary) -> list[bytes]:
    """The rows' texts, as bytes."""
    parts = [p if b < 0 else bytes([b]) for p, b in zip(v.pieces, v.byte_of, strict=True)]
    out = []
    for a, b in zip(ioffs[:-1], ioffs[1:], strict=True):
        got = b"".join([parts[i] for i in ids[a:b].tolist()])
        out.append(got[1:])
    return out


SCHEMA = "doc_id long, n_pieces int, score double, whole boolean, ids array<int>, alternatives array<struct<score:double,edits:array<struct<at:int,drop:int,pieces:array<int>>>>>"
_EDITS = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("pieces", pa.list_(pa.int32()))])))]))


def encoded(docs: DataFrame, path: str = MODEL, n: int = NBEST) -> DataFrame:
    """doc_id, n_pieces, score, whole, ids, alternatives of every row; whole: the ids, decoded, are the text, byte by byte."""

    def run(batches):
        v, cache = vocabulary(path), {}
        for whole in batches:
            for b in text.slices(whole, "text", 2 << 20):
                got = encode(b.column("text"), v, n, cache=cache)
                none = pc.is_null(b.column("text")).to_numpy(zero_copy_only=False)
                counts = np.diff(got["ioffs"])
                ids = pa.ListArray.from_arrays(pa.array(got["ioffs"].astype(np.int32)), pa.array(got["ids"]))
                if none.any():
                    ids = pc.if_else(pa.array(~none), ids, pa.scalar(None, ids.type))
                alts = pa.array([None if x else [{"score": s, "edits": [{"at": p, "drop": q, "pieces": w} for p, q, w in e]} for s, e in a] for x, a in zip(none, got["alternatives"], strict=True)], _EDITS)
                data, offs = text.raw(b.column("text"))
                back, ends = b"".join(decode(got["ids"], got["ioffs"], v)), offs.tolist()
                whole_ = [back[s:e] == data[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts.astype(np.int32), mask=none), pa.array(np.round(got["score"], 6), mask=none), pa.array(whole_, mask=none), ids, alts], ["doc_id", "n_pieces", "score", "whole", "ids", "alternatives"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows of ids; null ids have a null text, bytes that aren't UTF-8 are replaced."""

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            ids = b.column("ids")
            flat = pc.fill_null(ids, pa.scalar([], ids.type)) if ids.null_count else ids
            texts = decode(flat.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(flat).to_numpy())]), v)
            shown = [t.decode("utf-8", "replace") if ok else None for ok, t in zip(pc.is_valid(ids).to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shown, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every document's id with its pieces, score and alternatives."""
    return encoded(docs)
