"""Personal data: a linear-chain conditional random field over word-shape features, decoded by Viterbi in numpy batches.

Tokens are runs of bytes that aren't ASCII white space, parted at delimiters that no entity holds (quotes, brackets, commas, colons, slashes and the
like, where something follows), between characters of three bytes or more and others, and, beyond ``LONG`` bytes, at
all other punctuation that no entity holds. A token's shape is the tuple of
quantised counts of digits, letters, capitals and punctuation kinds in it, whether it is all hexadecimal, and
whether it is a word that announces a secret; its features are those values, and those of the tokens beside
it. Weights and label transitions are fitted to a small labelled table (``labelled_table``)
by gradient ascent on the exact conditional likelihood (forward-backward), on the driver. Whole texts are decoded: the
rows of a slice go side by side through Viterbi, in steps of one token.

Spans are runs of one entity, without punctuation at their ends; ``start`` and ``end`` count characters
from 0. Defined cases: null and empty texts have no spans; null ids are dropped in ``spans`` and
left as they are by ``filter_stage``; repeated rows are
decoded alike; empty tables give no rows; other columns are carried along or ignored.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text
from .store import table

LABELS = ("O", "EMAIL", "IP", "CARD", "PHONE", "I-PHONE", "SECRET", "I-SECRET", "SSN", "I-CARD")
KINDS = tuple(x.removeprefix("I-") for x in LABELS)
#: Sentences of the labelled table, rounds and weight decay of training.
SENTENCES, ROUNDS, DECAY = 500, 80, 1e-4
_TRIGGERS = ("token", "secret", "password", "passwd", "pwd", "key", "api_key", "apikey", "access_token")


def _counts(kinds: list[str]) -> np.ndarray:
    """For each byte, one in the field (of 8 bits) of each kind it belongs to."""
    out = np.zeros(256, np.uint64)
    for k, chars in enumerate(kinds):
        for c in chars if isinstance(chars, (range, list)) else chars.encode():
            out[c] += np.uint64(1 << (8 * k))
    return out


_A = _counts(["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", list(range(128, 256)), "@", ".", "-", "abcdefABCDEF"])
_B = _counts(["()", "+", "=", "\"'", ":", "/", "_", ",;!?%&$#*|<>[]{}~^`\\"])
_INK = np.ones(256, bool)
_INK[[9, 10, 11, 12, 13, 32]] = False
_EDGE = np.zeros(256, bool)
_EDGE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Upper limits of the buckets of each count: digits, letters, capitals, dots, dashes, length.
_CUTS = {"digit": (0, 1, 2, 3, 4, 7, 8, 9, 10, 11, 13, 15, 16, 19), "letter": (0, 1, 3), "upper": (0, 1), "dot": (0, 1, 2, 3), "dash": (0, 1, 2), "length": (1, 3, 6, 10, 18, 30, 45)}
_WIDTH = np.array([len(_CUTS[k]) + 1 for k in ("digit", "letter", "upper", "dot", "dash", "length")] + [2] * 8)
_FIRST = np.concatenate([[0], np.cumsum(_WIDTH)])
FEATURES = int(_FIRST[-1])


def _marks(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Bytes that part what is on both sides of them; those that may stand with them; and those that part only what is longer than ``LONG``.
_PARTS, _WITH, _PARTS_LONG, LONG = _marks(b"\"'{}[]<>,;&|`\\?=:/"), _marks(b""), _marks(b":/!*$#%^~()'=,"), 255
_OPENS = _EDGE | _marks(b"+(")


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of tokens, and each row's offsets into them (rows + 1)."""
    n, ink = len(data), _INK[data]
    starts, ends, woffs = text.words(data, offs, _INK)
    if not n:
        return starts, ends, woffs
    far = np.concatenate([data, np.zeros(5, np.uint8)])
    digit, letter = (far >= 48) & (far <= 57), (far >= 128) | ((far | 32) >= 97) & ((far | 32) <= 122)
    part = _PARTS[data]
    at = np.flatnonzero(data == 44)  # a comma of a number's thousands
    part[at[digit[at - 1] & digit[at + 1] & digit[at + 2] & digit[at + 3] & ~digit[at + 4] & ~(digit[at - 2] & digit[at - 3] & digit[at - 4])]] = False
    at = np.flatnonzero(data == 39)  # an apostrophe within a word
    part[at[letter[at - 1] & letter[at + 1]]] = False
    at = np.flatnonzero(data == 61)  # a short value
    part[at[ends[np.searchsorted(starts, at, "right") - 1] - at <= 4]] = False
    run = part | _WITH[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], run, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if len(begin):
        own = np.searchsorted(starts, begin, "right") - 1
        inner = (begin > starts[own]) & (end < ends[own]) & _OPENS[far[end]] & np.logical_or.reduceat(np.append(part, False), np.stack([begin, end], 1).ravel())[::2]
        gap = np.zeros(n + 1, np.int8)
        gap[begin[inner]], gap[end[inner]] = 1, -1
        ink &= np.cumsum(gap[:-1], dtype=np.int8) == 0
    wide = data >= 0xE0  # characters of three bytes and more: scripts without spaces, dashes, quotation marks
    first, most = np.flatnonzero(wide), np.flatnonzero(data >= 0xF0)
    for k, x in ((1, first), (2, first), (3, most)):
        wide[x[x + k < n] + k] = True
    new = np.append(True, np.append(wide[1:] != wide[:-1], True))
    new[offs] = True

    def cut():
        return np.flatnonzero(ink & (new[:-1] | ~np.append(False, ink[:-1]))), np.flatnonzero(ink & (new[1:] | ~np.append(ink[1:], False))) + 1

    starts, ends = cut()
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        for s, e in zip(starts[long], ends[long], strict=True):
            ink[s:e] &= ~_PARTS_LONG[data[s:e]]
        starts, ends = cut()
    return starts, ends, np.searchsorted(starts, offs)


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each token's shape; ``features`` tells what it stands for."""
    fields = []
    for lut in (_A, _B):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lut[data])])
        fields.append((c[ends] - c[starts])[:, None].view(np.uint8).reshape(-1, 8).astype(np.int64))
    a, b = fields
    length = ends - starts
    for i in np.flatnonzero(length > 255):  # more than a field of 8 bits holds
        n = np.bincount(data[starts[i] : ends[i]], minlength=256)
        for x, lut in ((a, _A), (b, _B)):
            x[i] = n @ lut[:, None].view(np.uint8).reshape(256, 8).astype(np.int64)
    s, inv = text.sums(np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8))
    said = np.isin(text.span(s, inv, starts, ends), _trigger_hashes())
    letters = a[:, 1] + a[:, 2] + a[:, 3]
    cols = [np.searchsorted(_CUTS[k], v, "left") for k, v in (("digit", a[:, 0]), ("letter", letters), ("upper", a[:, 2]), ("dot", a[:, 5]), ("dash", a[:, 6]), ("length", length))]
    cols += [a[:, 4] > 0, b[:, 0] > 0, b[:, 1] > 0, b[:, 2] > 0, b[:, 3] > 0, (b[:, 4] + b[:, 5] + b[:, 6]) > 0, (letters == a[:, 7]) & (letters > 0) & (a[:, 0] > 0), said]
    code = np.zeros(len(starts), np.int64)
    for v, w in zip(cols, _WIDTH, strict=True):
        code = code * w + v
    return code


def features(code: np.ndarray) -> np.ndarray:
    """Indexes of the features of shape numbers, one column for each property."""
    out, rest = np.empty((len(code), len(_WIDTH)), np.int64), code.copy()
    for k in range(len(_WIDTH) - 1, -1, -1):
        out[:, k] = _FIRST[k] + rest % _WIDTH[k]
        rest //= _WIDTH[k]
    return out


def _trigger_hashes() -> np.ndarray:
    data, offs = text.raw(pa.array(_TRIGGERS))
    s, inv = text.sums(data)
    return text.span(s, inv, offs[:-1], offs[1:])


def labelled_table(seed: int = 11) -> list[tuple[int, int, str, str]]:
    """The labelled rows: sentence, position, token, label; made up, the same at every call."""
    r = random.Random(seed)
    syllables = "an the re ti on er in ou st ed nd ar lo mi ka vel tor é ö ñ ü sch ment ción".split()
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))

    def plain() -> str:
        w = word()
        kind = r.random()
        if kind < 0.55:
            return w
        if kind < 0.7:
            return w.capitalize()
        if kind < 0.8:
            return w + r.choice(".,;:!?")
        return r.choice([w.upper(), w.upper() + "!!", w + r.choice(("***", "%%%", "$$$", "###", "&&&")), "|", "-", "=", "+", f"{w}-{word()}", f'"{w}"', f"({w})", f"{w}'s", f"{w}={digits(1)}", digits(r.choice((1, 2, 3, 4, 5, 6))), digits(4), f"{digits(1)}.{digits(1)}", f"{digits(1)}.", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"${digits(2)},{digits(3)}", f"{digits(2)}%", f"http://{w}.example.com/{word()}", f"@{w}", f"#{digits(3)}", "token", "key", "BY-NC", f"{w}_{word()}", f"{w}{digits(2)}", f"({digits(4)})", digits(8), f"{digits(1)}.{digits(2)}.{digits(4)}", word() * 4])

    def entity() -> list[tuple[str, str]]:
        kind = r.choice(("EMAIL", "IP", "CARD", "PHONE", "SECRET", "SSN", "CARDS"))
        up = r.random() < 0.15
        if kind == "EMAIL":
            got = [(f"{word()}{r.choice(('.', '', '_', '-'))}{r.choice((digits(2), word(), ''))}@{r.choice((f'mail{digits(1)}.example', word(), f'{word()}.{word()}'))}.{r.choice(('com', 'org', 'net', 'de', 'fr'))}", "EMAIL")]
        elif kind == "IP":
            got = [(".".join(str(r.randint(0, 255)) for _ in range(4)), "IP")]
        elif kind == "CARD":
            got = [(digits(16), "CARD") if r.random() < 0.8 else (f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", "CARD")]
        elif kind == "CARDS":
            got = [(digits(4), "CARD")] + [(digits(4), "I-CARD") for _ in range(3)]
        elif kind == "PHONE":
            got = r.choice(([(f"+{digits(1)}", "PHONE"), (f"({digits(3)})", "I-PHONE"), (f"{digits(3)}-{digits(4)}", "I-PHONE")],) * 3 + ([(f"({digits(3)})", "PHONE"), (f"{digits(3)}-{digits(4)}", "I-PHONE")], [(f"{digits(3)}-{digits(3)}-{digits(4)}", "PHONE")], [(f"+{digits(2)}-{digits(3)}-{digits(7)}", "PHONE")], [(f"+{digits(11)}", "PHONE")]))
        elif kind == "SECRET":
            marks = r.choice(("0123456789abcdef",) * 3 + ("0123abcdefabcdef",))
            h = "".join(r.choice(marks) for _ in range(r.choice((32, 40, 40, 64))))
            got = r.choice(([(r.choice(_TRIGGERS), "SECRET"), ("=", "I-SECRET"), (f'"{h}"', "I-SECRET")],) * 3 + ([(r.choice(_TRIGGERS), "SECRET"), (h, "I-SECRET")], [(h, "SECRET")], [(f'"{h}"', "SECRET")]))
        else:
            got = [(f"{digits(3)}-{digits(2)}-{digits(4)}", "SSN")]
        if up:
            got = [(a.upper(), b) for a, b in got]
        tail = r.choice(("", "", "", "", ",", ".", "!!", "***", "%%%", "$$$", "###", "&&&"))
        got[-1] = got[-1][0] + tail, got[-1][1]
        if len(got) > 1 and tail and len(tail) > 1:
            got = [(a + tail if i < len(got) - 1 else a, b) for i, (a, b) in enumerate(got)]
        return got

    rows = []
    for s in range(SENTENCES):
        line = []
        for _ in range(r.randint(1, 4)):
            line += [(plain(), "O") for _ in range(r.randint(0, 6))]
            if r.random() < 0.75:
                line += entity()
        line += [(plain(), "O") for _ in range(r.randint(1, 4))]
        rows += [(s, k, a, b) for k, (a, b) in enumerate(line)]
    return rows


def _scores(code: np.ndarray, first: np.ndarray, last: np.ndarray, model: tuple) -> np.ndarray:
    """Label scores of each token from its shape and those beside it within its row."""
    emit, _, _ = model
    kinds, own = np.unique(code, return_inverse=True)
    f = features(kinds)
    tables = [emit[k][f].sum(1) for k in range(3)]
    out = tables[0][own]
    before, after = np.flatnonzero(~first), np.flatnonzero(~last)
    out[before] += tables[1][own[before - 1]]
    out[after] += tables[2][own[after + 1]]
    return out


def _ends(woffs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    full = woffs[:-1] < woffs[1:]
    first[woffs[:-1][full]] = True
    last[woffs[1:][full] - 1] = True
    return first, last


def viterbi(score: np.ndarray, woffs: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best labels of all rows; rows go side by side, longest first. Ties take the first label."""
    size = np.diff(woffs)
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")
    at = woffs[:-1][order]
    back = np.zeros(score.shape, np.int8)
    best = (score[at[: active[0]]] + start) if len(active) else None
    final = np.zeros(len(size), np.int64)
    for t in range(1, len(active)):
        n = active[t]
        if n < len(best):
            final[order[n : len(best)]] = best[n:].argmax(1)
        here = best[:n, :, None] + step
        arg = here.argmax(1)
        where = at[:n] + t
        back[where] = arg
        best = np.take_along_axis(here, arg[:, None, :], 1)[:, 0] + score[where]
    if len(active):
        final[order[: len(best)]] = best.argmax(1)
    label = np.zeros(len(score), np.int8)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        rows = order[:n]
        label[at[:n] + t] = final[rows]
        if t:
            final[rows] = back[at[:n] + t, final[rows]]
    return label


def decode(score: np.ndarray, woffs: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The labels that ``viterbi`` gives, by its recursion over the uncertain tokens only.

    Whatever the labels beside it, to change one label moves the score of a path by at most twice the
    range of the transitions. A token whose score for O leads by more is O on the best path; it cuts the
    row in two that are decoded apart.
    """
    first, last = _ends(woffs, len(score))
    most = 2 * max(np.ptp(step), np.ptp(start))
    open_ = np.flatnonzero(score[:, 0] - score[:, 1:].max(1, initial=-np.inf) <= most)
    label = np.zeros(len(score), np.int8)
    if len(open_):
        new = np.ones(len(open_), bool)
        new[1:] = (np.diff(open_) > 1) | first[open_[1:]]
        own = score[open_]
        ends = np.append(np.flatnonzero(new)[1:], len(open_)) - 1
        heads, tails = np.flatnonzero(new), ends
        own[heads] += np.where(first[open_[heads]][:, None], start, step[0])
        own[tails] += np.where(last[open_[tails]][:, None], 0, step[:, 0])
        label[open_] = viterbi(own, np.append(heads, len(open_)), np.zeros(len(start), np.float32), step)
    return label


def train(rows: list[tuple[int, int, str, str]]) -> tuple:
    """Emission weights (own, previous, next), start scores and transitions, by Adam on the penalised likelihood."""
    rows = sorted(rows)
    sentence = np.array([r[0] for r in rows])
    data, offs = text.raw(pa.array([r[2] for r in rows]))
    code = shapes(data, offs[:-1], offs[1:])
    gold = np.array([LABELS.index(r[3]) for r in rows])
    n_labels = len(LABELS)
    cuts = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
    woffs = np.append(cuts, len(rows))
    first, last = _ends(woffs, len(rows))
    size = np.diff(woffs)
    width = size.max()
    grid = np.minimum(woffs[:-1, None] + np.arange(width), len(rows) - 1)
    live = np.arange(width) < size[:, None]
    f = features(code)
    before, after = np.flatnonzero(~first), np.flatnonzero(~last)
    theta = [np.zeros((3, FEATURES, n_labels)), np.zeros(n_labels), np.zeros((n_labels, n_labels))]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for k in range(1, ROUNDS + 1):
        emit, start, step = theta
        score = emit[0][f].sum(1)
        score[before] += emit[1][f[before - 1]].sum(1)
        score[after] += emit[2][f[after + 1]].sum(1)
        s = score[grid]
        alpha, beta = np.empty(s.shape), np.zeros(s.shape)
        alpha[:, 0] = s[:, 0] + start
        for t in range(1, width):
            nxt = np.logaddexp.reduce(alpha[:, t - 1, :, None] + step, axis=1) + s[:, t]
            alpha[:, t] = np.where(live[:, t, None], nxt, alpha[:, t - 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        for t in range(width - 2, -1, -1):
            nxt = np.logaddexp.reduce(step + (s[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(live[:, t + 1, None], nxt, 0)
        node = np.exp(alpha + beta - z[:, None, None])[live]
        edge = np.exp(alpha[:, :-1, :, None] + step + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])[live[:, 1:]].sum(0)
        g = -node
        g[np.arange(len(gold)), gold] += 1
        grad = [np.zeros_like(theta[0]), g[first].sum(0), -edge]
        np.add.at(grad[2], (gold[before - 1], gold[before]), 1)
        for c in range(f.shape[1]):
            np.add.at(grad[0][0], f[:, c], g)
            np.add.at(grad[0][1], f[before - 1, c], g[before])
            np.add.at(grad[0][2], f[after + 1, c], g[after])
        for i, x in enumerate(theta):
            d = grad[i] / len(cuts) - DECAY * x
            m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.99 * v[i] + 0.01 * d * d
            x += 0.15 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    return theta[0].astype(np.float32), theta[1].astype(np.float32), theta[2].astype(np.float32)


@lru_cache(1)
def fitted() -> tuple:
    """The model of the labelled table, fitted once for each driver."""
    return train(labelled_table())


def find(texts: pa.Array, model: tuple) -> tuple[np.ndarray, ...]:
    """Row, byte start, byte end (within the slice), kind of every span; and the slice's bytes and offsets."""
    data, offs = text.raw(texts)
    starts, ends, woffs = tokens(data, offs)
    first, last = _ends(woffs, len(starts))
    label = decode(_scores(shapes(data, starts, ends), first, last, model), woffs, model[1], model[2])
    inner = np.isin(label, [LABELS.index("I-PHONE"), LABELS.index("I-SECRET"), LABELS.index("I-CARD")])
    kind = np.array([LABELS.index(k) for k in KINDS])[label]
    prev = np.concatenate([[0], kind[:-1]])
    on = label > 0
    begin = on & (~inner | first | (prev != kind))
    at = np.flatnonzero(begin)
    to = np.flatnonzero(on & ~(np.append(on[1:] & ~begin[1:], False) & ~last))
    s, e, k = starts[at].copy(), ends[to].copy(), kind[at]
    for i in range(len(s)):
        keep_front, keep_back = (b"+(", b"") if KINDS[k[i]] == "PHONE" else (b"\"'", b"\"'") if KINDS[k[i]] == "SECRET" else (b"", b"")
        while s[i] < e[i] and not _EDGE[data[s[i]]] and data[s[i]] not in keep_front:
            s[i] += 1
        while s[i] < e[i] and not _EDGE[data[e[i] - 1]] and data[e[i] - 1] not in keep_back:
            e[i] -= 1
    row = np.searchsorted(offs, starts[at], "right") - 1 if len(at) else np.zeros(0, np.int64)
    good = s < e
    return row[good], s[good], e[good], k[good], data, offs


def spans(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, start, end, kind, value of every span."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for b in text.slices(whole, "text"):
                row, s, e, k, data, offs = find(b.column("text"), shared.value)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                from_row = chars[offs[:-1]][row]
                buffer = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array((chars[s] - from_row).astype(np.int32)), pa.array((chars[e] - from_row).astype(np.int32)), pa.array([KINDS[x] for x in k], pa.string()), pa.array([buffer[x:y].decode() for x, y in zip(s, e, strict=True)], pa.string())],
                    ["doc_id", "start", "end", "kind", "value"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return docs.mapInArrow(run, "doc_id long, start int, end int, kind string, value string")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"), fitted())


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span replaced by its kind in brackets, and n_chars (if there is one) as it then is."""
    shared = spark.sparkContext.broadcast(fitted())
    names = docs.columns

    def run(batches):
        for whole in batches:
            for b in text.slices(whole, "text"):
                row, s, e, k, data, offs = find(b.column("text"), shared.value)
                if not len(row):
                    yield b
                    continue
                texts, buffer = b.column("text").to_pylist(), data.tobytes()
                for r in np.unique(row):
                    out, at = [], offs[r]
                    for i in np.flatnonzero(row == r):
                        out += [buffer[at : s[i]].decode(), f"[{KINDS[k[i]]}]"]
                        at = e[i]
                    texts[r] = "".join(out) + buffer[at : offs[r + 1]].decode()
                cols = list(b.columns)
                cols[names.index("text")] = pa.array(texts, b.column("text").type)
                if "n_chars" in names:
                    now = cols[names.index("n_chars")].to_pylist()
                    for r in np.unique(row):
                        now[r] = len(texts[r])
                    cols[names.index("n_chars")] = pa.array(now, b.column("n_chars").type)
                yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(run, docs.schema)
