"""LM scoring: online logistic mixing of hashed-context bit predictors, refined adaptively; total bits and bits per byte.

A byte is a path of binary decisions in the Huffman tree of the byte before it, over the byte pairs of all documents (a byte that
often follows takes few), and its bits are the sum of the decisions' code lengths -log2 p. For each decision
there is one static predictor for each of the ``ORDERS`` bytes before it, a slot of a hashed table that tells how often either side
was taken elsewhere in the corpus, and one that adapts online: the byte that followed the latest earlier place of the text with the
same ``MATCH`` bytes before it says which side it expects.

The counts are those of all rows of the corpus but the one that is scored: a row doesn't help to predict itself, its copies do.
What is gathered grows with the corpus: texts are dealt by hash into cells of about ``CELL`` bytes. Each cell counts what follows its
contexts, the counts of a context meet in one task, and each cell gets back the sums over the corpus for the contexts that it has.
Counts become stretched probabilities, ln(p / (1 - p)) with p = (n1 + 0.4) / (n + 0.8), of 8 bits.

The predictors' values are combined in the logistic domain by weights that a gate selects: how the latest
expectations of the online predictor came true (none; wrong; right up to ``SURE`` bytes; longer), and the
decision's depth (first, second, later). Each text starts with the same weights and learns its own online by the gradient of
its code length (steps scaled by Adagrad), block by block: within a block of bytes (``BLOCKS``, doubling up to 2048) weights are those that
the blocks before left; the online predictor moves with every byte. The mix is refined by an adaptive map of the text (gate and quantised
mix to a probability, moved towards what was seen after each block), averaged with the mix. A
document's score depends on its text and the corpus only, not on what shares its task.

Defined cases: a null or empty text has 0 bytes, 0 bits and null bits_per_byte; null ids are kept; repeated rows (and other rows of
the same text) score alike; an empty table gives no rows; of a single row all static predictors say 1/2; ties
can't occur; a text of any length is scored whole; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text
from .store import table

ORDERS, MATCH, BITS, CELL = (2, 3, 5), 5, 22, 64 << 20
BLOCKS = (32, 64, 128, 256, 512, 1024, 2048)
SURE, DEEP, RATE, CELLS, PULL = 15, 3, 0.08, 24, 0.02
STATES, GATES = 4, 12
#: Weights that each text starts with: of the static predictors, and of the online one in each of its states.
WEIGHT, TRUST = 0.4, (0.0, 0.5, 1.5, 3.0)
SCALE = 15.0
_NODE = np.random.default_rng(3).integers(1, 1 << BITS, 256, dtype=np.int32)
_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_CHUNK = 1 << 15
_KIND, _HELD, _PART = 56, 1 << 22, 1 << 17


def tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its depth in the Huffman tree of the counts, and for each depth and byte 2 * node + side (of at most 255 nodes).

    A count is at least a 2**12th part of all, so that no path is long.
    """
    least = int(counts.sum()) >> 12
    agenda = [(max(int(c), least) + 1, b, [b]) for b, c in enumerate(counts)]
    heapq.heapify(agenda)
    paths: list[list[int]] = [[] for _ in range(256)]
    for node in range(255):
        (n0, k0, zero), (n1, _, one) = heapq.heappop(agenda), heapq.heappop(agenda)
        for side, own in enumerate((zero, one)):
            for b in own:
                paths[b].append(2 * node + side)
        heapq.heappush(agenda, (n0 + n1, k0, zero + one))
    depth = np.array([len(p) for p in paths])
    steps = np.zeros((depth.max(), 256), np.int32)
    for b, p in enumerate(paths):
        steps[: len(p), b] = p[::-1]
    return depth, steps


class Trees:
    """The trees of all preceding bytes as flat tables by 256 * preceding byte + byte."""

    def __init__(self, counts: np.ndarray):
        each = [tree(c) for c in counts.reshape(256, 256)]
        self.depth = np.concatenate([d for d, _ in each]).astype(np.int64)
        self.deep = int(self.depth.max())
        self.step = np.zeros((self.deep, 256, 256), np.int32)
        for p, (d, s) in enumerate(each):
            self.step[: len(s), p] = s
        self.step = self.step.reshape(self.deep, 1 << 16)
        self.code = np.zeros(1 << 16, np.int32)
        for j in range(self.deep):
            self.code |= (self.step[j] & 1) << (self.deep - 1 - j)
        self.bits = np.zeros(1 << self.deep, np.int16)  # how many a number has
        for j in range(self.deep):
            self.bits[1 << j :] = j + 1
        self.side = (self.step & 1).astype(np.int8)
        # A decision's slot and side, 2 * slot + side, is twice its base and this number by exclusive or.
        self.node = _NODE[self.step >> 1] << 1 | self.step & 1
        # A byte's place among the leaves of its tree: those below a node are neighbours.
        self.rank = self.code.reshape(256, 256).argsort(1).argsort(1).astype(np.uint8).reshape(-1)


def pair_counts(docs: DataFrame) -> np.ndarray:
    """How often each byte follows each other one (0 at a text's start), over all documents."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for whole in batches:
            for b in text.slices(whole, "text"):
                total += np.bincount(pairs(*text.raw(b.column("text"))), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    got = docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16, np.int64)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out


def pairs(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """256 * preceding byte + byte, of each byte."""
    before = np.zeros(len(data), np.uint16)
    before[1:] = data[:-1]
    before[offs[:-1][offs[:-1] < offs[1:]]] = 0
    return (before << np.uint16(8)) | data


def contexts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The ``MATCH`` bytes before each byte as one number, the latest lowest; before a text there are zeros."""
    n = len(data)
    d = np.concatenate([np.zeros(MATCH, np.uint8), data])
    two = d[1:].astype(np.uint16) | (d[:-1].astype(np.uint16) << np.uint16(8))  # two[i] ends at d[i + 1]
    four = two[2:].astype(np.uint32) | (two[:-2].astype(np.uint32) << np.uint32(16))
    out = four[1 : n + 1].astype(np.uint64)
    out |= d[:n].astype(np.uint64) << np.uint64(32)
    for t in range(MATCH):
        at = offs[:-1] + t
        out[at[at < offs[1:]]] &= np.uint64((1 << (8 * t)) - 1)
    return out


def bases(context: np.ndarray, k: int, bits: int = BITS) -> np.ndarray:
    """The base of each byte's context of ``ORDERS[k]`` bytes; a decision's slot is its base and its node's number by exclusive or."""
    h = context & np.uint64((1 << (8 * ORDERS[k])) - 1)
    h *= np.uint64(_SPREAD[k])
    h >>= np.uint64(64 - bits)
    return h.astype(np.int32)


def followers(context: np.ndarray, byte: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different contexts of ``ORDERS[k]`` bytes with the byte that follows, and how often it does."""
    wide = 8 * ORDERS[k]
    key = ((context & np.uint64((1 << wide) - 1)) << np.uint64(8)) | byte
    if wide <= 24:
        key = key.astype(np.uint32)
    key.sort()
    first = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1]))
    n = np.diff(np.append(first, len(key))).astype(np.int32)
    key = key[first].astype(np.uint64)
    return key >> np.uint64(8), (key & np.uint64(0xFF)).astype(np.uint8), n


def add(total: np.ndarray, k: int, before: np.ndarray, then: np.ndarray, n: np.ndarray, trees: Trees) -> None:
    """Add to a table of counts, by slot and side, bytes that follow contexts of ``ORDERS[k]`` bytes."""
    base = bases(before, k, len(total).bit_length() - 2)
    pair = ((before.astype(np.int32) & 0xFF) << 8) | then
    deep = trees.depth.take(pair)
    for j in range(int(deep.max(initial=0))):
        on = deep > j
        if j:
            base, pair, n, deep = base[on], pair[on], n[on], deep[on]
        step = trees.step[j].take(pair)
        np.add.at(total, (base ^ _NODE.take(step >> 1)) << 1 | (step & 1), n)


def count(slices: list[tuple[np.ndarray, np.ndarray]], trees: Trees) -> np.ndarray:
    """The tables of 8-bit values by order and slot, from texts given as (bytes, offsets)."""
    total = np.zeros((len(ORDERS), 2 << BITS), np.int32)
    for data, offs in slices:
        context = contexts(data, offs)
        for k in range(len(ORDERS)):
            add(total[k], k, *followers(context, data, k), trees)
    return np.stack([stretched(c[0::2], c[1::2]) for c in total])


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their counts, from sorted parts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")  # merges what is sorted
    key = key[order]
    first = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n[order], first) if len(first) else n


def gathered(slices: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (order, context, byte that follows) and how often they occur in texts given as (rows of each, bytes, offsets)."""
    keys, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for times, data, offs in slices:
        before, then, n = followers(contexts(data, offs), data, len(ORDERS) - 1)
        keys.append(before << np.uint64(8) | then)
        counts.append(n.astype(np.int64) * times)
        held += len(keys[-1])
        if held > _HELD + 2 * len(keys[0]):
            key, n = summed(keys, counts)
            keys, counts, held = [key], [n], 0
    key, n = summed(keys, counts)
    # Shorter contexts are the ends of the longest ones.
    each = [summed([key & np.uint64((1 << 8 * (order + 1)) - 1)], [n]) for order in ORDERS[:-1]] + [(key, n)]
    return np.concatenate([np.uint64(k << _KIND) | key for k, (key, _) in enumerate(each)]), np.concatenate([n for _, n in each])


def tables(key: np.ndarray, n: np.ndarray, trees: Trees, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the counts by slot and side, from ``gathered`` keys, and their values ``without_one``; with 4 slots or more for each key."""
    cuts = np.searchsorted(key, np.arange(len(ORDERS) + 1, dtype=np.uint64) << np.uint64(_KIND))
    out = []
    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        total = np.zeros(2 << max(BITS, min(29, int(4 * (z - a)).bit_length())), kind)
        add(total, k, key[a:z] >> np.uint64(8) & np.uint64((1 << 8 * ORDERS[k]) - 1), (key[a:z] & np.uint64(0xFF)).astype(np.uint8), n[a:z].astype(kind), trees)
        out.append((total, without_one(total)))
    return out


def sorted_places(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, where each begins among all in order, and the place of each of these; no key is above ``most``."""
    low = max(1, (len(key) - 1).bit_length())
    if most.bit_length() + low > 64:
        place = np.argsort(key, kind="stable")
        key = key[place]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key.take(first), first, place
    both, mask = key << np.uint64(low), np.uint64((1 << low) - 1)
    both |= np.arange(len(key), dtype=np.uint64)
    both.sort()
    first = np.flatnonzero(np.append(True, (both[1:] ^ both[:-1]) > mask))
    key = both.take(first) >> np.uint64(low)
    both &= mask
    return key, first, both.view(np.int64)


def without_one(total: np.ndarray) -> np.ndarray:
    """For each slot and side the 8-bit value of the slot's counts, less one on that side."""
    out = np.empty(len(total), np.int8)
    for a in range(0, len(total), 2 * _CHUNK):
        n0, n1 = total[a : a + 2 * _CHUNK].reshape(-1, 2).T
        out[a : a + 2 * _CHUNK : 2] = stretched(np.maximum(n0 - 1, 0), n1)
        out[a + 1 : a + 2 * _CHUNK : 2] = stretched(n0, np.maximum(n1 - 1, 0))
    return out


def alike(group: np.ndarray, context: np.ndarray, rank: np.ndarray, done: int, order: int, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different (group, bytes ``done`` to ``order`` of the context, rank) in order; the place of one of each, the sum of ``n`` (1 if None), and which one each place has."""
    wide = 8 * (order - done)
    key = group << np.uint64(wide)
    key |= (context >> np.uint64(8 * done)) & np.uint64((1 << wide) - 1)
    key <<= np.uint64(8)
    key |= rank
    key, first, place = sorted_places(key, ((int(group.max()) + 1) << (wide + 8)) - 1)
    many = np.diff(np.append(first, len(place)))
    of = np.empty(len(place), np.int32)
    of[place] = np.repeat(np.arange(len(first), dtype=np.int32), many)
    return key, place.take(first), many if n is None else np.add.reduceat(n.take(place), first), of


def parts(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Whole rows that aren't empty together, from one to another, as many as a cache holds."""
    row = 0
    while row < len(offs) - 1:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + _PART, "right")) - 1)
        if offs[row] < offs[to]:
            yield row, to
        row = to


def predicted(offs: np.ndarray, pair: np.ndarray, context: np.ndarray, trees: Trees, total: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What the static predictors say by the counts of all rows but the byte's own one.

    For each order the number of each byte's context and byte among a row's different ones; and their values by level.
    """
    at = [np.empty(len(pair), np.int32 if len(pair) < 1 << 31 else np.int64) for _ in ORDERS]
    values, start = [[] for _ in ORDERS], np.zeros(len(ORDERS), np.int64)
    for row, to in parts(offs):
        a, z = offs[row], offs[to]
        group, part, rank = text.owners(offs[row : to + 1]).astype(np.uint64), context[a:z], trees.rank.take(pair[a:z]).astype(np.uint64)

        def told(k, key, place, n, of):
            """The contexts' numbers of different contexts and bytes, whose values are kept."""
            own = np.cumsum(np.append(False, (key[1:] ^ key[:-1]) > 0xFF))
            values[k].append(others(own, pair[a:z].take(place), bases(part.take(place), k, len(total[k][0]).bit_length() - 2), n, trees, *total[k]))
            np.add(of, start[k], out=at[k][a:z], casting="same_kind")
            start[k] += len(key)
            return own

        key, middle, n, of = alike(group, part, rank, 0, ORDERS[1])
        group_of = told(1, key, middle, n, of).astype(np.uint64).take(of, mode="clip")
        key, place, n, short = alike(group.take(middle), part.take(middle), rank.take(middle), 0, ORDERS[0], n)  # from those of the middle order
        told(0, key, middle.take(place), n, short.take(of, mode="clip"))
        told(2, *alike(group_of, part, rank, ORDERS[1], ORDERS[2]))
    for k, x in enumerate(values):
        whole, done = np.empty((max(map(len, x)), int(start[k])), np.int8), 0
        for v in x:
            whole[: len(v), done : done + v.shape[1]] = v
            done += v.shape[1]
        values[k] = whole
    return at, values


def others(own: np.ndarray, pair: np.ndarray, base: np.ndarray, n: np.ndarray, trees: Trees, total: np.ndarray, less: np.ndarray) -> np.ndarray:
    """The values by level of all decisions from ``total`` less the own counts: of contexts (numbered by ``own``) and bytes in the trees' order, which occur ``n`` times.

    Bytes below a node are neighbours, from ``low`` to ``high``. Where only one is left, all its decisions are told at once; if it occurs once, by ``without_one``.
    """
    deep = trees.depth.astype(np.uint8).take(pair)
    value = np.empty((int(deep.max()), len(pair)), np.int8)
    two, base, upto = total.reshape(-1, 2), base << 1, np.append(0, np.cumsum(n))
    # The level at which a byte's path leaves that of the byte before, 255 for a context's first one; places by level.
    code = trees.code.take(pair)
    leaves = np.full(len(pair), 255, np.uint8)
    leaves[1:] = trees.deep - trees.bits.take(code[1:] ^ code[:-1])
    leaves[1:] |= (own[1:] != own[:-1]).view(np.uint8) * np.uint8(255)
    places, cuts = np.argsort(leaves, kind="stable"), np.append(0, np.cumsum(np.bincount(leaves, minlength=256)))
    low = places[cuts[255] :]
    high = np.append(low[1:], len(pair))
    lone, level = [], 0
    while True:
        size = high - low
        lone.append(low.take(np.flatnonzero(size == 1)))
        on = np.flatnonzero(size > 1)
        if not len(on):
            break
        low, high, size = low.take(on), high.take(on), size.take(on)
        node, last = trees.node[level].take(pair.take(low)), trees.side[level].take(pair.take(high - 1))
        both = upto.take(high) - upto.take(low)
        ones = both * last
        forks, at = np.flatnonzero(last > (node & 1)), places[cuts[level] : cuts[level + 1]]
        ones[forks] = upto.take(high.take(forks)) - upto.take(at)
        found = two.take((base.take(low) ^ node) >> 1, axis=0, mode="clip")
        told = stretched(found[:, 0] - (both - ones), found[:, 1] - ones)
        if size.sum() > len(pair) >> 2:  # what lies between is told later
            value[level, low[0] :] = np.repeat(told, np.diff(np.append(low, len(pair))))
        else:
            ends = np.cumsum(size)
            value[level][np.arange(ends[-1]) + np.repeat(low - (ends - size), size)] = np.repeat(told, size)
        parts = np.ones(len(low), np.int64)
        parts[forks] = 2
        low, high, forks = np.repeat(low, parts), np.repeat(high, parts), forks + np.arange(len(forks))
        high[forks] = low[forks + 1] = at
        level += 1
    skip = np.repeat(np.arange(len(lone), dtype=np.uint8), [len(x) for x in lone])
    lone = np.concatenate(lone)
    rest, often = deep.take(lone) - skip, (n > 1).take(lone)
    by, rare = np.argsort(often.view(np.uint8) << 7 | (127 - rest), kind="stable"), len(lone) - np.count_nonzero(often)
    lone, skip, rest = lone.take(by), skip.take(by).astype(np.int32), rest.take(by)
    flat, wide = value.reshape(-1), len(pair)
    start, which, base = skip * np.int64(wide) + lone, pair.take(lone) + (skip << 16), base.take(lone)
    for j, m in enumerate(longer(rest[:rare])):
        slot = base[:m] ^ trees.node.reshape(-1)[j << 16 :].take(which[:m], mode="clip")
        flat[j * wide :][start[:m]] = less.take(slot, mode="clip")
    start, which, base, n = start[rare:], which[rare:], base[rare:], n.take(lone[rare:])
    for j, m in enumerate(longer(rest[rare:])):
        slot = base[:m] ^ trees.node.reshape(-1)[j << 16 :].take(which[:m], mode="clip")
        found, ones = two.take(slot >> 1, axis=0, mode="clip"), n[:m] * (slot & 1)
        flat[j * wide :][start[:m]] = stretched(found[:, 0] - (n[:m] - ones), found[:, 1] - ones)
    return value


def longer(n: np.ndarray) -> np.ndarray:
    """How many of the numbers are above 0, above 1 and so on."""
    return len(n) - np.cumsum(np.bincount(n))[:-1]


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    x = (n1 + np.float32(0.4)) / (n0 + np.float32(0.4))
    np.log(x, out=x)
    x *= np.float32(SCALE)
    np.clip(x, -127, 127, out=x)
    return np.rint(x, out=x).astype(np.int8)


def expected(data: np.ndarray, offs: np.ndarray, pair: np.ndarray, context: np.ndarray, trees: Trees) -> tuple[np.ndarray, np.ndarray]:
    """For each byte at how many decisions the online predictor is right before it is wrong (-1 if it expects nothing), and its state from 1 on."""
    n = len(data)
    low = max(1, (n - 1).bit_length())
    row = text.owners(offs).astype(np.uint64)
    row *= text.U(0x9E3779B97F4A7C15)
    row += context
    key = text.mix(row)
    key &= ~np.uint64((1 << low) - 1)
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    mask = np.uint64((1 << low) - 1)
    again = np.flatnonzero((key[1:] ^ key[:-1]) <= mask)
    place, before = (key[again + 1] & mask).astype(np.int64), (key[again] & mask).astype(np.int64)
    agree = np.full(n, -1, np.int8)
    actual = pair[place]
    differ = trees.code[actual] ^ trees.code[(actual & 0xFF00) | data[before]]
    # The first decision apart is the highest bit in which the codes differ.
    agree[place] = np.int16(trees.deep) - trees.bits.take(differ)
    wrong = np.arange(n, dtype=np.int32)
    wrong[place.take(np.flatnonzero(differ == 0))] = -1
    np.maximum.accumulate(wrong, out=wrong)
    run = np.arange(-1, n - 1, dtype=np.int32)
    run[1:] -= wrong[:-1]
    run[0] = 0
    return agree, np.int8(1) + (run > 0) + (run > SURE)


def scored(data: np.ndarray, offs: np.ndarray, trees: Trees, total: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Total bits of each row, which ``total``, the tables of ``tables``, counts too."""
    rows = len(offs) - 1
    bits = np.zeros(rows)
    if not len(data):
        return bits
    n_in = len(ORDERS) + 1
    pair = pairs(data, offs).astype(np.int32)
    context = contexts(data, offs)
    agree, state = np.empty(len(data), np.int8), np.empty(len(data), np.int8)
    for a, z in parts(offs):
        own = slice(offs[a], offs[z])
        agree[own], state[own] = expected(data[own], offs[a : z + 1] - offs[a], pair[own], context[own], trees)
    size = np.diff(offs)
    row = text.owners(offs)
    first_at, values = predicted(offs, pair, context, trees, total)
    edges = np.cumsum(np.concatenate([[0], BLOCKS, np.full(max(0, int(size.max()) // BLOCKS[-1]), BLOCKS[-1])]))
    n = np.searchsorted(edges, size)  # blocks of each row
    block = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    long = np.minimum(edges[1:].take(block), np.repeat(size, n)) - edges.take(block)
    block = np.repeat(block.astype(np.uint16 if len(edges) < 65536 else np.int64), long)
    order = np.argsort(block, kind="stable")
    cuts = np.append(0, np.cumsum(np.bincount(block)))
    row, pair, agree, state = (x.take(order) for x in (row, pair, agree, state))
    first_at = [x.take(order) for x in first_at]
    deep = trees.depth.astype(np.uint8).take(pair)
    start = np.full((n_in, GATES), WEIGHT / SCALE, np.float32)
    start[-1] = np.tile(TRUST, DEEP)
    weight, power = np.repeat(start[:, None], rows, 1), np.ones((n_in, rows, GATES), np.float32)
    centre = (np.arange(CELLS, dtype=np.float32) - (CELLS - 1) / 2) * np.float32(16 / CELLS)
    cell = np.tile(1 / (1 + np.exp(-centre)), (rows, GATES, 1)).astype(np.float32)
    one, half = np.float32(1), np.float32(0.5)
    unit = np.full(n_in, 1 / SCALE, np.float32)
    unit[-1] = 1
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        upto = np.cumsum(deep[a:z], dtype=np.int64)
        first = np.flatnonzero(np.append(True, row[a + 1 : z] != row[a : z - 1]))  # of each row's part
        ends = np.append(first[1:], z - a)
        at = 0
        while at < len(first):  # whole rows, as many as a cache holds
            done = upto[first[at] - 1] if first[at] else 0
            to = max(at + 1, int(np.searchsorted(upto[ends - 1], done + _CHUNK, "right")))
            s, e = a + first[at], a + ends[to - 1]
            who = row[a + first[at:to]]
            # Level by level; bytes of many decisions come first, so that those that have a level are the first ones.
            by = np.argsort(~deep[s:e], kind="stable")
            many = longer(deep[s:e])
            reach = np.append(0, np.cumsum(many))
            m = int(reach[-1])
            ahead, true, which = agree[s:e].take(by), state[s:e].take(by), pair[s:e].take(by).astype(np.int64)
            places = [f[s:e].take(by).astype(np.int64) for f in first_at]
            gate = np.repeat(np.arange(to - at) * GATES, ends[at:to] - first[at:to]).take(by)
            group, sides, said = np.empty(m, np.int64), np.empty(m, np.int8), np.empty((n_in, m), np.int8)
            for level, (l, r) in enumerate(itertools.pairwise(reach)):
                c = r - l
                for k, f in enumerate(places):
                    np.take(values[k][level], f[:c], out=said[k, l:r], mode="clip")
                np.take(trees.side[level], which[:c], out=sides[l:r], mode="clip")
                np.subtract((ahead[:c] > level).view(np.int8), (ahead[:c] == level).view(np.int8), out=said[-1, l:r])
                np.add(gate[:c], true[:c] * (ahead[:c] >= level).view(np.int8), out=group[l:r])
                if level < DEEP - 1:
                    gate += STATES
            yes = sides.astype(np.float32)
            no = one - yes  # |q - no| is the probability of what came
            x = said.astype(np.float32)
            x[-1] *= yes - no
            w = weight[:, who].reshape(n_in, -1)
            dot = w[0].take(group, mode="clip") * x[0]
            for k in range(1, n_in):
                dot += w[k].take(group, mode="clip") * x[k]
            np.clip(dot, -12, 12, out=dot)
            where = dot * np.float32(CELLS / 16)
            where += np.float32(CELLS / 2)
            where = np.clip(where, 0, CELLS - 1, out=where).astype(np.int64)
            where += group * CELLS
            np.negative(dot, out=dot)
            np.exp(dot, out=dot)
            dot += one
            p = np.divide(one, dot, out=dot)
            own = cell[who]
            q = (p + own.reshape(-1).take(where, mode="clip")) * half
            q -= no
            shape = (to - at, GATES)
            bits[who] -= np.bincount(group, np.log2(np.abs(q, out=q)), shape[0] * GATES).reshape(shape).sum(1)
            error, pull = yes - p, np.empty(m)
            for k in range(n_in):
                g = (np.bincount(group, np.multiply(error, x[k], out=pull), shape[0] * GATES).reshape(shape) * unit[k]).astype(np.float32)
                power[k, who] += g * g
                weight[k, who] += np.float32(RATE) * g / np.sqrt(power[k, who]) * unit[k]
            both = np.bincount(where, yes + np.float64(2**26), own.size).reshape(own.shape)  # counts and ones in one sum
            seen = np.floor(both * 2.0**-26)
            ones = (both - seen * 2.0**26).astype(np.float32)
            seen = seen.astype(np.float32)
            cell[who] = (own + np.float32(PULL) * ones) / (one + np.float32(PULL) * seen)
            at = to
    return bits


def labels(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions a number that Spark's hash sends there, so that each gets one cell."""
    found, many = [], 8 * n
    while len(found) < n:
        at = F.pmod(F.hash("id"), F.lit(n)).alias("at")
        found = spark.range(many).select("id", at).groupBy("at").agg(F.min("id").alias("id")).orderBy("at").collect()
        many *= 2
    return np.array([r.id for r in found])


def held(rows: pa.Table, most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a cell's different texts, all of a slice with the same number of rows, and that number."""
    k1, k2 = (rows.column(c).to_numpy() for c in ("k1", "k2"))
    order = np.lexsort((rows.column("text").is_null().to_numpy(), k2, k1))
    k1, k2 = k1[order], k2[order]
    first = np.flatnonzero(np.append(len(k1) > 0, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
    times = np.diff(np.append(first, len(k1)))
    by = np.argsort(times, kind="stable")
    times, texts = times[by], rows.column("text").cast(pa.large_string())
    whole = pa.table({"k1": k1[first[by]], "k2": k2[first[by]], "text": texts.take(pa.array(order[first[by]]))})
    cuts = np.append(np.flatnonzero(np.append(len(times) > 0, times[1:] != times[:-1])), len(times))
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        for b in whole.slice(a, z - a).to_batches():
            for part in text.slices(b, "text", most):
                yield int(times[a]), part


def bits_per_byte(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, bits, bits_per_byte of every row.

    Different texts are scored once, in their cell; a map task sends only the key of a text that it sent before.
    Scores are joined to the rows by two 64-bit hashes of the text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = pair_counts(docs)
    spark, n_bytes = docs.sparkSession, int(counts.sum())
    shared = spark.sparkContext.broadcast(Trees(counts))
    cells = max(1, -(-n_bytes // CELL))
    label = labels(spark, cells)
    kind = np.int32 if n_bytes < 1 << 31 else np.int64
    keys = F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")

    def deal(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            k1, k2, new = b.column("k1"), b.column("k2"), []
            for key in zip(k1.to_pylist(), k2.to_pylist(), strict=True):
                new.append(key not in seen)
                seen.add(key)
            cell = label[k1.to_numpy().view(np.uint64) % np.uint64(cells)]
            once = pc.if_else(pa.array(new, pa.bool_()), b.column("text"), pa.scalar(None, b.column("text").type))
            yield pa.RecordBatch.from_arrays([pa.array(cell), k1, k2, once], ["cell", "k1", "k2", "text"])

    def ask(rows):
        key, n = gathered((times, *text.raw(b.column("text"))) for times, b in held(rows, 4 << 20))
        part = (text.mix((key >> text.U(8)) * text.U(_SPREAD[0])) % text.U(cells)).astype(np.uint16 if cells <= 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(cells + 1))
        parts = [order[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({
            "part": label, "cell": pa.array([rows.column("cell")[0].as_py()] * cells, pa.int64()),
            "keys": pa.array([key[x].tobytes() for x in parts], pa.binary()), "counts": pa.array([n[x].tobytes() for x in parts], pa.binary()),
        })

    def answer(batches):
        asked = [(r["cell"], np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64)) for b in batches for r in b.to_pylist()]
        if not asked:
            return
        key, n = summed([x[1] for x in asked], [x[2] for x in asked])
        for cell, own, _ in asked:
            before = own & ~text.U(0xFF)
            before = before[np.append(len(before) > 0, before[1:] != before[:-1])]
            low, high = np.searchsorted(key, before), np.searchsorted(key, before | text.U(0xFF), "right")
            size = high - low
            at = np.repeat(high - np.cumsum(size), size) + np.arange(int(size.sum()))
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([key[at].tobytes()], pa.binary()), pa.array([n[at].tobytes()], pa.binary())], ["cell", "keys", "counts"])

    def run(rows, answers):
        key = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in answers.column("keys")])
        n = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in answers.column("counts")])
        order = np.argsort(key, kind="stable")
        total = tables(key[order], n[order], shared.value, kind)
        del key, n, order
        done = [(b.column("k1"), b.column("k2"), scored(*text.raw(b.column("text")), shared.value, total)) for _, b in held(rows, 1 << 20)]
        return pa.table({"k1": pa.chunked_array([x[0] for x in done], pa.int64()), "k2": pa.chunked_array([x[1] for x in done], pa.int64()), "bits": pa.chunked_array([x[2] for x in done], pa.float64())})

    texts = docs.where("text <> ''").select(*keys, "text").mapInArrow(deal, "cell long, k1 long, k2 long, text string").repartition(cells, "cell")
    asked = texts.groupBy("cell").applyInArrow(ask, "part long, cell long, keys binary, counts binary")
    answers = asked.repartition(cells, "part").mapInArrow(answer, "cell long, keys binary, counts binary").repartition(cells, "cell")
    scores = texts.groupBy("cell").cogroup(answers.groupBy("cell")).applyInArrow(run, "k1 long, k2 long, bits double")
    rows = docs.select("doc_id", *keys, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    bits = F.coalesce("bits", F.lit(0.0))
    return rows.join(scores, ["k1", "k2"], "left").select("doc_id", "n_bytes", F.round(bits, 3).alias("bits"), F.round(bits / F.nullif("n_bytes", F.lit(0)), 5).alias("bits_per_byte"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bits_per_byte(table(spark, sf_dir, "documents"))
