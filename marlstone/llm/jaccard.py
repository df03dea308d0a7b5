"""N-gram Jaccard join: grouped prefix join over sets of ``N``-word shingles.

Shingles are ordered by how rare they are, by counts of all documents in a hashed table of fixed size
(any one order gives the same result; a good one gives short lists). A set of n shingles has a prefix of
n - ceil(t n) + 1; two sets of similarity t or more have a shingle in common in their
prefixes. Documents with the same prefix and size are one group, which is indexed once, however many
copies it has. Records (shingle, the one before it, group, size, position) are packed by range of the shingle's hash and
sent to one task for each range, which joins them in numpy: pairs of groups must pass the size and the
position filter, and are taken where the shingles before differ. A shingle that the counts show to be in more than ``HOT`` records is
salted: its records are cut in blocks, and each pair of blocks is a range of its own, so that no task gets all of them.

Where the groups of a shingle would be in more than ``DENSE`` pairs each, as in a large family of near copies, the groups are noted rather than
their pairs, so that what is written grows with the members of a family and not with their square. Such lists that share groups make a
family; its texts go to one task, or to one for each pair of salts if they have more than ``FAMILY_BYTES``, which compares all of them
exactly and returns each class's number of links and edges that connect what is linked. Two classes of several common families
are compared in the least.

Documents of equal sets are one class, represented by its least doc_id. Group pairs are expanded to pairs of classes (and classes of
one group among each other); a histogram of each set's hashes gives an upper bound of the overlap and drops most chance pairs; the rest are verified exactly on the whole sets: pairs of a family of candidates, cut in blocks
of about twice ``BLOCK_BYTES`` of text at most, go to one task with the text of each class once.

``linked`` gives one row for each document that has a copy or a link to a similar class, with its connected group and the number of both; ``similar`` has
the links. ``filter_stage`` keeps one document of each connected group.

Defined cases: rows without an id, or with one that is no whole number, are in no pair; so are texts without words; a text of fewer
than ``N`` words is one shingle; repeated rows count once; a document is never paired with itself; of equal least ids, the class of
the least hash comes first; texts of any length are compared whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text
from .decontaminate import SQL_WORDS
from .store import discard, stored, table

N, THRESHOLD = 2, 0.7
#: Counters that order the shingles; bytes of index records for a task, and of texts that share a salt; records of a shingle in a range; ids to broadcast.
BUCKETS, TASK_BYTES, BLOCK_BYTES, HOT, MOST_IDS = 1 << 24, 12 << 20, 24 << 20, 1 << 15, 1 << 20
#: Pairs for each group of a shingle from which its groups are a family; bytes of a family's texts that share a salt.
DENSE, FAMILY_BYTES = 16, 6 << 20
#: Records that are packed at once, and members in a batch: the parts grow with the corpus, and each slice has little for each.
PACKED, MEMBERS = 1 << 18, 1 << 10
_CHUNK = 1 << 18
#: What a record takes in a payload, a column at a time. Of a shingle 32 bits go with its range (others that share them give candidates that
#: don't stand verification); of the one before it, which drops a pair, 48.
_RECORD = np.dtype([("token", "<u4"), ("low", "<u4"), ("high", "<u2"), ("group", "<u8"), ("size", "<u4"), ("at", "<u4")])
_MEMBER = np.dtype([("doc", "<i8"), ("hash", "<i8"), ("print", "<u8"), ("group", "<u8"), ("bytes", "<u4"), ("size", "<u4"), ("bins", "<u8")])


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and offsets."""
    data, offs = text.raw(texts, lower=True)
    starts, ends, woffs = text.words(data, offs)
    return text.distinct(*text.shingles(text.word_hashes(data, starts, ends), woffs, N))


def prints(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    total = np.concatenate([np.zeros(1, text.U), np.cumsum(text.mix(h))])
    return text.mix(total[offs[1:]] - total[offs[:-1]] + np.diff(offs).astype(text.U))


def least_overlap(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """The overlap that sets of these sizes need."""
    return np.ceil(t / (1 + t) * (a.astype(np.int64) + b) - 1e-9)


def prefix_size(n: np.ndarray, t: float) -> np.ndarray:
    return np.where(n > 0, n - np.ceil(t * n - 1e-9).astype(np.int64) + 1, 0)


def ranks(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each counter a rank from rare to frequent (eight times the logarithm of its count), and the number of shingles of all documents.

    Counts are summed in two levels, so that no task reads the counts of all others; one task's count for more than 65535 as that.
    """

    def count(batches):
        total = np.zeros(BUCKETS, np.uint32)
        for whole in batches:
            for b in text.slices(whole, "text", 1 << 20):
                at = np.sort((sets(b.column("text"))[0] >> text.U(65 - BUCKETS.bit_length())).astype(np.uint32))
                first = np.flatnonzero(np.append(len(at) > 0, at[1:] != at[:-1]))
                total[at[first]] += np.diff(np.append(first, len(at))).astype(np.uint32)
        for k, c in enumerate(total.reshape(-1, _CHUNK)):
            if c.any():
                yield batch({k: np.minimum(c, 0xFFFF).astype("<u2")})

    def batch(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["chunk", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("chunk").to_pylist(), b.column("counts"), strict=True):
                raw = c.as_buffer()
                total[k] = total.get(k, 0) + np.frombuffer(raw, f"<u{raw.size // _CHUNK}").astype("<u8")
        if total:
            yield batch({k: c.astype("<u4") if c.max() < 1 << 32 else c for k, c in total.items()})

    def last(batches):
        for b in add(batches):
            for k, c in zip(b.column("chunk").to_pylist(), b.column("counts"), strict=True):
                c = np.frombuffer(c.as_buffer(), f"<u{c.as_buffer().size // _CHUNK}").astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(255, np.log2(np.maximum(c, 1)) * 8).astype(np.uint8).tobytes()], pa.binary()), pa.array([int(c.sum())])], ["chunk", "rank", "n"])

    schema = "chunk int, counts binary"
    some = docs.select("text").mapInArrow(count, schema).withColumn("part", F.spark_partition_id() % 8).repartition("chunk", "part").select("chunk", "counts").mapInArrow(add, schema)
    rank, n = np.zeros(BUCKETS, np.uint8), 0
    for r in some.repartition("chunk").mapInArrow(last, "chunk int, rank binary, n long").collect():
        rank[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(bytes(r.rank), np.uint8)
        n += r.n
    return rank, n


def bins(n: np.ndarray) -> np.ndarray:
    """Histogram cells of a set of n, a power of two."""
    return np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(2, n / 4))).astype(np.int64), 0)


def indexed(batch: pa.RecordBatch, rank: np.ndarray, parts: int, hot: int, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Index records of a slice and the tasks they go to; members, the tasks they go to, and their histograms."""
    h, offs = sets(batch.column("text"))
    size = np.diff(offs)
    row = text.owners(offs)
    often = rank[(h >> text.U(65 - BUCKETS.bit_length())).astype(np.int64)]
    order = (often.astype(text.U) << text.U(56)) | (h >> text.U(8))
    by = np.argsort(order, kind="stable")
    by = by[np.argsort(row[by].astype(np.int32), kind="stable")]
    token = order[by]
    p = prefix_size(size, t)
    own = np.repeat(np.arange(len(size)), p)
    at = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
    where = offs[:-1][own] + at
    total = np.concatenate([np.zeros(1, text.U), np.cumsum(text.mix(token[where]))])
    poffs = np.concatenate([[0], np.cumsum(p)])
    group = text.mix(total[poffs[1:]] - total[poffs[:-1]] + size.astype(text.U))
    once = np.zeros(len(size), bool)
    once[np.unique(group, return_index=True)[1]] = True  # a group is indexed once
    on = once[own]
    own, at, where = own[on], at[on], where[on]
    record = np.empty(len(where), _RECORD)
    before = np.where(at > 0, token[np.maximum(0, where - 1)], text.U(0))
    record["token"], record["low"], record["high"] = (token[where] & text.U(0xFFFFFFFF)), before & text.U(0xFFFFFFFF), before >> text.U(32) & text.U(0xFFFF)
    record["size"], record["at"], record["group"] = size[own], at, group[own]
    to = ((token[where] >> text.U(24)) & text.U(0xFFFFFFFF)).astype(np.int64) % parts
    salts = -(-np.exp2((token[where] >> text.U(56)).astype(np.float64) / 8).astype(np.int64) // hot)
    many = np.flatnonzero(salts > 1)
    if len(many):  # a copy for each pair of blocks that the record's block is in
        n = salts[many]
        again = np.repeat(many, n)
        one = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
        mine = (record["group"][again] >> text.U(7)).astype(np.int64) % salts[again]
        pair = np.minimum(one, mine) * salts[again] + np.maximum(one, mine)
        few = np.flatnonzero(salts <= 1)
        block = np.concatenate([np.zeros(len(few), np.int64), pair + 1])
        to = np.concatenate([to[few], (to[again] + text.mix(pair.astype(text.U)).astype(np.int64) % parts) % parts])
        record = record[np.concatenate([few, again])]
        side = np.where(one == mine, 0, np.where(mine < one, 1, 2)).astype(np.uint32)
        record["at"] |= np.concatenate([np.zeros(len(few), np.uint32), side]) << np.uint32(30)
        # A pair of blocks has a token of its own; the top bits of the position tell its two blocks apart.
        record["token"] = np.where(block > 0, text.mix(record["token"] + block.astype(text.U) * text.U(0x9E3779B97F4A7C15)) & text.U(0xFFFFFFFF), record["token"])
    full = np.flatnonzero(size)
    member = np.zeros(len(full), _MEMBER)
    member["doc"], member["hash"] = text.ids(batch, "doc_id")[full], text.ids(batch, "hash")[full]
    member["print"], member["group"] = prints(h, offs)[full], group[full]
    member["bytes"] = np.minimum(np.diff(text.raw(batch.column("text"))[1])[full], 0xFFFFFFFF)
    member["size"], member["bins"] = size[full], bins(size[full])
    coffs = np.concatenate([[0], np.cumsum(bins(size))])
    hist = np.bincount(coffs[:-1][row] + ((h >> text.U(18)).astype(np.int64) & (bins(size)[row] - 1)), minlength=coffs[-1])
    hist = np.minimum(255, hist).astype(np.uint8).tobytes()
    ends = coffs.tolist()
    return record, to, member, (member["print"] >> text.U(24)).astype(np.int64) % parts, [hist[ends[k] : ends[k + 1]] for k in full.tolist()]


def packed(held: list[tuple], parts: int) -> pa.RecordBatch:
    """What ``indexed`` gave for some slices, packed by task."""
    record, to, member, mto = (np.concatenate([x[k] for x in held]) for k in range(4))
    hist = [h for x in held for h in x[4]]
    by = np.argsort(to, kind="stable")
    record, cut = record[by], np.searchsorted(to[by], np.arange(parts + 1))
    by = np.argsort(mto, kind="stable")
    member, mcut, hist = member[by], np.searchsorted(mto[by], np.arange(parts + 1)), [hist[k] for k in by.tolist()]
    columns = {f: np.ascontiguousarray(record[f]) for f in _RECORD.names}
    out_to = np.flatnonzero((np.diff(cut) > 0) | (np.diff(mcut) > 0))
    out = [np.array([cut[k + 1] - cut[k], mcut[k + 1] - mcut[k]], "<u8").tobytes() + b"".join(columns[f][cut[k] : cut[k + 1]].tobytes() for f in _RECORD.names) + member[mcut[k] : mcut[k + 1]].tobytes() + b"".join(hist[mcut[k] : mcut[k + 1]]) for k in out_to]
    return pa.RecordBatch.from_arrays([pa.array(out_to.astype(np.int32)), pa.array(out, pa.binary())], ["part", "payload"])


def spread(count: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, step) of each i with the steps below its count, some ``most`` at once."""
    sums, at = np.cumsum(count), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, "right")))
        c = count[at:to]
        if c.any():
            yield np.repeat(np.arange(at, to), c), np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        at = to


def partners(block: np.ndarray, size: np.ndarray, place: np.ndarray, t: float, most: int) -> np.ndarray:
    """For each record how many others of its block pass the filters of size, position and side with it.

    Records of one block, size and place (position and side) are one kind, and pairs of kinds are tried: far fewer in a family, however large.
    """
    order = np.lexsort((place, size, block))
    block, size, place = block[order], size[order], place[order]
    new = np.append(len(order) > 0, (block[1:] != block[:-1]) | (size[1:] != size[:-1]) | (place[1:] != place[:-1]))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    block, size, at, side = block[first], size[first], place[first] & 0x3FFFFFFF, place[first] >> 30
    end = np.searchsorted((block << 32) | size, (block << 32) | np.minimum(np.floor(size / t + 1e-9).astype(np.int64), 0xFFFFFFFF), "right")
    found = np.zeros(len(first), np.int64)
    for i, step in spread(end - np.arange(len(first)), most):
        j = i + step
        ok = np.minimum(size[i] - at[i], size[j] - at[j]) >= least_overlap(size[i], size[j], t)
        ok &= (side[i] == 0) | (side[i] != side[j])
        i, j = i[ok], j[ok]
        found += np.bincount(i, n[j] - (i == j), len(found)).astype(np.int64)
        found += np.bincount(j, np.where(i == j, 0, n[i]), len(found)).astype(np.int64)
    out = np.empty(len(order), np.int64)
    out[order] = found[np.cumsum(new) - 1]
    return out


def joined(record: np.ndarray, t: float, most: int = 1 << 20):
    """Of one task's records, a part at a time: distinct pairs of groups, and lists (number, group) of groups that are dense.

    Shingles of more than a 16th of ``most`` pairs are told to be dense by counts of partners, before any of their pairs is formed; each gives one list.
    """
    record = record[np.lexsort((record["group"], record["size"], record["token"]))]
    token, group = record["token"], record["group"]
    keep = np.ones(len(record), bool)
    keep[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
    record = record[keep]
    new = np.ones(len(record), bool)
    new[1:] = record["token"][1:] != record["token"][:-1]
    block = np.cumsum(new) - 1
    size = record["size"].astype(np.int64)
    key = (block << 32) | size
    end = np.searchsorted(key, (block << 32) | np.minimum(np.floor(size / t + 1e-9).astype(np.int64), 0xFFFFFFFF), "right")
    count = end - np.arange(len(record)) - 1
    large = np.flatnonzero((np.bincount(block, count) > most >> 4)[block]) if len(record) else block
    if len(large):
        of, place = block[large], record["at"][large].astype(np.int64)
        degree = partners(of, size[large], place, t, most)
        before = record["low"][large].astype(np.int64) | record["high"][large].astype(np.int64) << 32
        by = np.lexsort((before, of))
        same = np.empty(len(large), np.int64)
        same[by] = np.cumsum(np.append(True, (of[by][1:] != of[by][:-1]) | (before[by][1:] != before[by][:-1])))
        later = np.flatnonzero(place & 0x3FFFFFFF)
        degree[later] -= partners(same[later], size[large][later], place[later], t, most)  # they are found at the shingle before
        dense = (np.bincount(of, degree) > 2 * DENSE * np.bincount(of, degree > 0))[of]
        on = large[dense & (degree > 0)]
        yield np.zeros((0, 2), text.U), np.stack([text.mix(record["token"][on].astype(text.U)), record["group"][on]], axis=1)
        count[large[dense]] = 0
    for i, step in spread(count, most):
        start, j = i[0], i + 1 + step
        a, b = record[i], record[j]
        side = a["at"] >> np.uint32(30)
        other = (side == 0) | (side != b["at"] >> np.uint32(30))
        a["at"] &= np.uint32(0x3FFFFFFF)
        b["at"] &= np.uint32(0x3FFFFFFF)
        rest = np.minimum(a["size"] - a["at"], b["size"] - b["at"])
        ok = (rest >= least_overlap(a["size"], b["size"], t)) & (a["group"] != b["group"]) & other
        ok &= ~((a["low"] == b["low"]) & (a["high"] == b["high"]) & (a["at"] > 0) & (b["at"] > 0))
        a, b, of = a["group"][ok], b["group"][ok], block[i[ok]]
        first = np.flatnonzero(np.append(len(of) > 0, of[1:] != of[:-1]))
        ends = np.append(first[1:], len(of))
        few, dense = np.ones(len(of), bool), [np.zeros((0, 2), text.U)]
        for k in np.flatnonzero(ends - first > 2 * DENSE * DENSE):  # fewer pairs can't be dense
            s, e = first[k], ends[k]
            groups = np.unique(np.concatenate([a[s:e], b[s:e]]))
            if e - s > DENSE * len(groups):
                few[s:e] = False
                number = text.mix(np.array([record["token"][i[ok][s]]], text.U) + text.U(0x9E3779B97F4A7C15 * (int(start) + 1) % 2**64))
                dense.append(np.stack([np.repeat(number, len(groups)), groups], axis=1))
        a, b = a[few], b[few]
        yield np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0), np.concatenate(dense)


def candidates(docs: DataFrame, t: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pairs of groups (ga, gb); dense lists of groups (list, group); the classes: print, group, bytes, and the least doc_id with its text's hash;
    the members: print, doc_id, hash."""
    spark = docs.sparkSession
    rank, shingle_count = ranks(docs)
    parts = max(4, int(shingle_count * (1.05 - t) * _RECORD.itemsize / TASK_BYTES))
    hot = max(HOT, 4 * shingle_count // BUCKETS)  # counters hold several shingles
    shared = spark.sparkContext.broadcast(rank)

    def pack(batches):
        held, n = [], 0
        for whole in batches:
            for b in text.slices(whole, "text", 1 << 20):
                held.append(indexed(b, shared.value, parts, hot, t))
                n += len(held[-1][0])
                if n >= PACKED:
                    yield packed(held, parts)
                    held, n = [], 0
        if held:
            yield packed(held, parts)

    names = ["kind", "a", "b", "doc_id", "hash", "bytes", "size", "hist"]

    def rows(kind, a, b, member=None, hist=None):  # kind: 0 member, 1 pair, 2 list
        n = len(a)
        extra = [pa.nulls(n, pa.int64())] * 4 if member is None else [pa.array(member[c].astype(np.int64)) for c in ("doc", "hash", "bytes", "size")]
        extra.append(pa.nulls(n, pa.binary()) if hist is None else pa.array(hist, pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a.astype(text.U).view(np.int64)), pa.array(b.astype(text.U).view(np.int64)), *extra], names)

    def listed(some, hist):
        member = np.concatenate(some)
        return rows(0, member["print"], member["group"], member, hist)

    def join(batches):
        held: dict[int, list[np.ndarray]] = {}
        some, hist = [], []
        for batch in batches:
            for k, payload in zip(batch.column("part").to_pylist(), batch.column("payload"), strict=True):
                raw = payload.as_buffer()
                n, m = (int(x) for x in np.frombuffer(raw, "<u8", 2))
                record, at = np.empty(n, _RECORD), 16
                for f in _RECORD.names:
                    record[f] = np.frombuffer(raw, _RECORD[f], n, at)
                    at += n * _RECORD[f].itemsize
                held.setdefault(k, []).append(record)
                member = np.frombuffer(raw, _MEMBER, m, at)
                if m:
                    ends = (at + m * _MEMBER.itemsize + np.cumsum(member["bins"].astype(np.int64))).tolist()
                    cells = raw.to_pybytes()
                    some.append(member.copy())
                    hist.extend(cells[s:e] for s, e in zip([at + m * _MEMBER.itemsize, *ends[:-1]], ends, strict=True))
                if len(hist) >= MEMBERS:
                    yield listed(some, hist)
                    some, hist = [], []
        if some:
            yield listed(some, hist)
        for k in list(held):
            for pair, dense in joined(np.concatenate(held.pop(k)), t):
                yield rows(1, pair[:, 0], pair[:, 1])
                yield rows(2, dense[:, 0], dense[:, 1])

    both = stored(docs.mapInArrow(pack, "part int, payload binary").repartition(parts, "part").mapInArrow(join, "kind int, a long, b long, doc_id long, hash long, bytes long, size long, hist binary"), "groups")
    found = both.where("kind = 1").select(F.col("a").alias("ga"), F.col("b").alias("gb")).distinct()
    dense = both.where("kind = 2").select(F.col("a").alias("list"), F.col("b").alias("group"))
    members = both.where("kind = 0").select(F.col("a").alias("print"), "doc_id", "hash")
    classes = both.where("kind = 0").groupBy(F.col("a").alias("print")).agg(F.first("b").alias("group"), F.max("bytes").alias("bytes"), F.first("size").alias("size"), F.first("hist").alias("hist"), F.min(F.struct("doc_id", "hash")).alias("first"))
    return found, dense, stored(classes, "classes"), members


def families(dense: DataFrame, classes: DataFrame) -> DataFrame:
    """group, families (sorted) of the groups in dense lists, and of those of many classes.

    All groups of a list have its family in common: the least group that it is connected with by a few lists (however many steps are taken,
    no pair of a list is lost).
    """
    crowded = classes.groupBy("group").count().where(F.col("count") > 2 * DENSE).select(F.col("group").alias("list"), "group")
    lists = stored(dense.unionByName(crowded).distinct(), "lists")
    family = lists.groupBy("list").agg(F.min("group").alias("family"))
    for _ in range(2):
        near = lists.join(family, "list").groupBy("group").agg(F.min("family").alias("family"))
        family = lists.join(near, "group").groupBy("list").agg(F.min("family").alias("family"))
    out = stored(lists.join(family, "list").groupBy("group").agg(F.array_sort(F.collect_set("family")).alias("families")), "families")
    discard(lists)
    return out


def bounded(pairs: DataFrame, t: float) -> DataFrame:
    """The pairs (a, b, na, nb, ha, hb) whose histograms allow enough overlap: a, b. A full cell allows anything."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            need = least_overlap(na, nb, t)
            for i, (x, y) in enumerate(zip(batch.column("ha"), batch.column("hb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                if x.max() == 255 or y.max() == 255:
                    keep[i] = True
                    continue
                n = min(len(x), len(y))
                x, y = (v if len(v) == n else v.reshape(-1, n).sum(0, dtype=np.uint16) for v in (x, y))
                keep[i] = np.minimum(x, y).sum(dtype=np.int64) >= need[i]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def compared(keys: np.ndarray, codes: np.ndarray, offs: np.ndarray, side: np.ndarray, less: list, t: float, whole: bool) -> Iterator[tuple]:
    """(a, b, jaccard, links) of a block of a family, arrays or None: pairs if ``whole``, else each key's links, and edges that connect what is linked.

    ``side``: 0, or 1 and 2 where only sets of two sides are compared. ``less``: the other families of each set that have its pairs.
    """
    n = len(keys)
    size, row = np.diff(offs), text.owners(offs)
    often = np.bincount(codes, minlength=1) > 1  # a shingle of one set is in no overlap
    codes, row = codes[often[codes]], row[often[codes]]
    by = np.argsort(size, kind="stable")
    place = np.empty(n, np.int64)
    place[by] = np.arange(n)
    order = np.argsort(place[row], kind="stable")
    codes, row = codes[order], place[row][order]
    on = np.unique(row)  # sets with a shingle in common with another one
    by = by[on]
    offs = np.append(np.searchsorted(row, on), len(row))
    keys, size, side, less = keys[by], size[by], side[by], [less[k] for k in by]
    elsewhere: dict[int, list[int]] = {}
    for k, ids in enumerate(less):
        for f in ids:
            elsewhere.setdefault(f, []).append(k)
    to = np.searchsorted(size, np.floor(size / t + 1e-9), "right")
    # Shingles of many sets are bits, 64 to a word; the others are looked up.
    common = np.bincount(codes, minlength=len(often)) > max(1, len(by) >> 6)
    number = np.cumsum(common) - 1
    bits = np.zeros((-(-int(common.sum()) // 64), len(by)), text.U)
    which, owner = common[codes], text.owners(offs)
    spot = number[codes[which]]
    np.bitwise_or.at(bits, (spot >> 6, owner[which]), text.U(1) << (spot & 63).astype(text.U))
    codes, offs = codes[~which], np.searchsorted(owner[~which], np.arange(len(by) + 1))
    seen = np.zeros(len(often), np.int32)
    links, label, edges = np.zeros(len(by), np.int64), np.arange(len(by)), []
    for k in range(len(by)):
        if (z := int(to[k])) <= k + 1:
            continue
        mine = codes[offs[k] : offs[k + 1]]
        same = np.zeros(z - k - 1, np.int64)
        for word in bits:
            if word[k]:
                same += np.bitwise_count(word[k + 1 : z] & word[k])
        if len(mine):
            seen[mine] = 1
            rest = np.append(0, np.cumsum(seen.take(codes[offs[k + 1] : offs[z]])))
            same += np.diff(rest[offs[k + 1 : z + 1] - offs[k + 1]])
            seen[mine] = 0
        j = same / (size[k] + size[k + 1 : z] - same)
        good = j >= t
        if side[k]:
            good &= side[k + 1 : z] != side[k]
        for f in less[k]:
            other = np.array(elsewhere[f])
            good[other[(other > k) & (other < z)] - k - 1] = False
        at = np.flatnonzero(good)
        if not len(at):
            continue
        if whole:
            yield np.minimum(keys[k], keys[k + 1 + at]), np.maximum(keys[k], keys[k + 1 + at]), j[at], None
            continue
        links[k] += len(at)
        links[k + 1 + at] += 1
        root = label[k + 1 + at]
        if (root != label[k]).any():
            root = np.unique(np.append(root, label[k]))
            label[np.isin(label, root)] = root[0]
            edges.extend((r, root[0]) for r in root[1:])
    if not whole:
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        yield keys[a], keys[b], None, None
        yield keys[links > 0], None, None, links[links > 0]


def verified(pairs: DataFrame, families: DataFrame, classes: DataFrame, members: DataFrame, docs: DataFrame, t: float, whole: bool) -> DataFrame:
    """a, b (prints), jaccard of the pairs (a < b) that reach the threshold; and unless ``whole``, of families only a, links, and edges a, b.

    Of the pairs, a family is those of equal labels, the least class up to three steps away (so that a text seldom goes to several); of the
    texts of a larger family than ``BLOCK_BYTES`` each is salted by hash, and each pair of salts is a block.
    """
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label"))
    for _ in range(2):
        label = edges.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("label"))
    label = stored(label, "labels")
    keyed = pairs.join(label.withColumnRenamed("label", "la"), "a").join(label.select(F.col("a").alias("b"), F.col("label").alias("lb")), "b")
    keyed = keyed.select(F.xxhash64("la", "lb").alias("family"), "a", "b")
    ends = keyed.select("family", F.col("a").alias("print")).unionByName(keyed.select("family", F.col("b").alias("print"))).distinct()
    salts = ends.join(classes.select("print", "bytes"), "print").groupBy("family").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("salts")).where("salts > 1")
    salt = lambda c: F.pmod(F.xxhash64(c), F.coalesce("salts", F.lit(1)))
    keyed = stored(keyed.join(salts, "family", "left").select(F.xxhash64("family", F.least(salt("a"), salt("b")), F.greatest(salt("a"), salt("b"))).alias("block"), "a", "b"), "keyed")
    need = keyed.select("block", F.col("a").alias("print")).unionByName(keyed.select("block", F.col("b").alias("print"))).distinct()
    need = need.select("block", "print", F.lit(None).cast("int").alias("side"), F.lit(None).cast("array<long>").alias("less"))
    each = classes.select("print", "group", "bytes").join(families, "group").select("print", "bytes", "families", F.explode("families").alias("family"))
    salts = each.groupBy("family").agg(F.ceil(F.sum("bytes") / FAMILY_BYTES).cast("int").alias("salts"))
    each = each.join(salts, "family").withColumn("salt", F.pmod(F.xxhash64("print"), "salts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    side = F.when(F.col("salt") == F.col("other"), 0).when(F.col("salt") < F.col("other"), 1).otherwise(2)
    block = F.xxhash64(F.lit("family"), "family", F.least("salt", "other"), F.greatest("salt", "other"))
    need = need.unionByName(each.select(block.alias("block"), "print", side.alias("side"), F.expr("filter(families, x -> x < family)").alias("less")))
    first = classes.select("print", "first.doc_id", "first.hash")
    need = stored(need.join(first, "print"), "need")
    wanted = docs.join(F.broadcast(need) if need.count() <= MOST_IDS else need, ["doc_id", "hash"])
    again = members.groupBy("doc_id", "hash").count().where("count > 1")
    if not again.join(need, ["doc_id", "hash"], "left_semi").isEmpty():
        wanted = wanted.dropDuplicates(["block", "print"])  # a row that is repeated goes once
    sent = wanted.select("block", F.col("print").alias("a"), F.lit(None).cast("long").alias("b"), "side", "less", "text")
    rows = keyed.select("block", "a", "b").unionByName(sent, allowMissingColumns=True)

    def verify(batches):
        now, waiting = None, []
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if waiting and block[s] != now:
                    yield from solved(waiting)
                    waiting = []
                now = block[s]
                waiting.append(batch.slice(s, e - s))
            # Slices of one batch keep it whole; what waits for the next one is copied.
            waiting = [pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]] if len(waiting) > 1 else waiting
        if waiting:
            yield from solved(waiting)

    def solved(parts):
        both = pa.Table.from_batches(parts).combine_chunks()
        is_text = both["text"].is_valid()
        have, pair = both.filter(is_text), both.filter(pc.invert(is_text)).select(["a", "b"])
        parts.clear()
        del both
        keys, codes, offs = [], [], [0]  # a key may come twice, from a row that is repeated
        family = have.num_rows > 0 and have["side"].null_count == 0
        for b in have.to_batches():
            for one in text.slices(b, "text", 1 << 20):
                h, o = sets(one.column("text"))
                keys.append(one.column("a").to_numpy())
                codes.append(h)
                offs.extend((o[1:] + offs[-1]).tolist())
        if not keys or not (family or pair.num_rows):
            return
        keys, offs = np.concatenate(keys), np.array(offs)
        import pandas as pd  # in workers only

        code, tokens = pd.factorize(np.concatenate(codes))
        code = code.astype(np.int32)
        if family:
            once = np.sort(np.unique(keys, return_index=True)[1])
            if len(once) < len(keys):
                code = np.concatenate([code[offs[k] : offs[k + 1]] for k in once])
                offs = np.append(0, np.cumsum(np.diff(offs)[once]))
            less = have["less"].take(pa.array(once)).to_pylist()
            for found in compared(keys[once], code, offs, have["side"].to_numpy()[once], less, t, whole):
                yield result(*found)
            return
        by = np.argsort(keys)
        a, b = (by[np.searchsorted(keys, pair[c].to_numpy(), sorter=by)] for c in ("a", "b"))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        size, same = np.diff(offs), np.zeros(len(a), np.int64)
        seen = np.zeros(len(tokens), bool)
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        for s, e in zip(first, np.append(first[1:], len(a)), strict=True):
            mine = code[offs[a[s]] : offs[a[s] + 1]]
            seen[mine] = True
            for k in range(s, e):
                same[k] = np.count_nonzero(seen[code[offs[b[k]] : offs[b[k] + 1]]])
            seen[mine] = False
        j = same / (size[a] + size[b] - same)
        good = j >= t
        yield result(keys[a[good]], keys[b[good]], j[good], None)

    def result(a, b, j, links):
        column = lambda x, kind: pa.nulls(len(a), kind) if x is None else pa.array(x, kind)
        return pa.RecordBatch.from_arrays([pa.array(a), column(b, pa.int64()), column(j, pa.float64()), column(links, pa.int64())], ["a", "b", "jaccard", "links"])

    checked = rows.repartition("block").sortWithinPartitions("block").mapInArrow(verify, "a long, b long, jaccard double, links long")
    out = stored(checked, "similar")
    for done in (label, keyed, need):
        discard(done)
    return out


def related(docs: DataFrame, t: float, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``verified`` found, the classes, and their members."""
    docs = docs.select(F.expr("try_cast(doc_id as long)").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").where("doc_id is not null")
    groups, dense, classes, members = candidates(docs, t)
    family = families(dense, classes)
    one, two = (family.select(F.col("group").alias(f"g{x}"), F.col("families").alias(f"f{x}")) for x in "ab")
    groups = groups.join(one, "ga", "left").join(two, "gb", "left").where(~F.coalesce(F.arrays_overlap("fa", "fb"), F.lit(False))).drop("fa", "fb")
    left, right = (classes.select(F.col("group").alias(f"g{x}"), F.col("print").alias(f"p{x}"), F.col("size").alias(f"n{x}"), F.col("hist").alias(f"h{x}")) for x in "ab")
    across = groups.join(left, "ga").join(right, "gb").drop("ga", "gb")
    within = left.join(one, "ga", "left_anti").join(right, (F.col("ga") == F.col("gb")) & (F.col("pa") < F.col("pb"))).drop("ga", "gb")
    both = across.unionByName(within).select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "na", "nb", "ha", "hb")
    pairs = stored(bounded(both, t), "pairs")
    out = verified(pairs, family, classes, members, docs, t, whole)
    discard(pairs)
    discard(family)
    return out, classes, members


def similar(docs: DataFrame, t: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified pairs of classes (prints a, b, jaccard), the classes, and their members."""
    out, classes, members = related(docs, t, True)
    return out.drop("links"), classes, members


def linked(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, links, copies of every document that has any.

    ``class_id`` is the least doc_id of its connected group; ``links`` counts the classes of other sets that are similar, ``copies`` the other
    documents of its own set. A document of several texts has a row for each set.
    """
    found, classes, members = related(docs, t, False)
    root = components(found.where("b is not null").select("a", "b"))
    pairs = found.where("jaccard is not null")
    both = pairs.select("a", F.lit(1).alias("links")).unionByName(pairs.select(F.col("b").alias("a"), F.lit(1).alias("links"))).unionByName(found.where("links is not null").select("a", "links"))
    degree = both.groupBy(F.col("a").alias("print")).agg(F.sum("links").alias("links"))
    own = members.select("print", "doc_id").distinct()
    size = own.groupBy("print").agg(F.count("*").alias("size"))
    known = classes.select("print", F.col("first.doc_id").alias("first")).join(size, "print").join(degree, "print", "left").where("size > 1 or links > 0")
    known = known.join(root.select(F.col("v").alias("print"), "root"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    ids = known.groupBy("root").agg(F.min("first").alias("class_id"))
    known = known.join(ids, "root").select("print", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"), (F.col("size") - 1).alias("copies"))
    return own.join(known, "print").select("doc_id", "class_id", "links", "copies")


def components(edges: DataFrame) -> DataFrame:
    """v, root (the least of its group) for all ends of edges (a, b) that aren't their group's least.

    Each round links every end to its least smaller neighbour, follows links to their ends by
    doubling, and contracts the edges; tables between rounds are written.
    """
    live = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    roots = None
    while True:
        link = stored(live.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("root")), "links")
        if link.isEmpty():
            break
        while True:
            nxt = link.select(F.col("v").alias("root"), F.col("root").alias("further"))
            if link.join(nxt, "root", "left_semi").isEmpty():
                break
            link = stored(link.join(nxt, "root", "left").select("v", F.coalesce("further", "root").alias("root")), "links")
        if roots is None:
            roots = link
        else:
            to = link.select(F.col("v").alias("root"), F.col("root").alias("further"))
            roots = stored(roots.join(to, "root", "left").select("v", F.coalesce("further", "root").alias("root")).unionByName(link), "roots")
        ends = link.select(F.col("v").alias("k"), F.col("root").alias("to"))
        live = live.join(ends.withColumnRenamed("k", "a").withColumnRenamed("to", "ra"), "a", "left").join(ends.withColumnRenamed("k", "b").withColumnRenamed("to", "rb"), "b", "left")
        live = live.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        live = stored(live, "edges")
    return link if roots is None else roots


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without all but one of each group of connected near copies, with all their columns: the one with the least doc_id
    (and of its texts, if it has several in the group, the one of the least hash).

    Rows without an id (a whole number), or without words, stay. Decisions are about a row's id and text: another text of the same id stands for
    itself. Rows that repeat an id and its text stay once, the one whose columns have the least hash.
    """
    found, classes, members = related(docs, THRESHOLD, False)
    roots = components(found.where("b is not null").select("a", "b"))
    first = classes.join(roots.select(F.col("v").alias("print"), "root"), "print", "left").groupBy(F.coalesce("root", "print").alias("root")).agg(F.min("first").alias("first"))
    kept = first.select("first.doc_id", "first.hash")
    later = stored(members.select("doc_id", "hash").distinct().join(kept, ["doc_id", "hash"], "left_anti"), "later")
    names, mark = docs.columns, "_".join(["hash", *docs.columns])
    ident = F.expr("try_cast(doc_id as long)")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    gone = later.select(F.col("doc_id").alias(f"{mark}_id"), F.col("hash").alias(f"{mark}_hash"))
    gone = F.broadcast(gone) if later.count() <= MOST_IDS else gone  # else all texts are shuffled
    out = marked.join(gone, (ident == F.col(f"{mark}_id")) & (F.col(mark) == F.col(f"{mark}_hash")), "left_anti")
    again = stored(members.groupBy("doc_id", "hash").count().where("count > 1").select(F.col("doc_id").alias(f"{mark}_id"), F.col("hash").alias(f"{mark}_hash")), "again")
    if again.isEmpty():
        return out.select(*names)
    repeats = (ident == F.col(f"{mark}_id")) & (F.col(mark) == F.col(f"{mark}_hash"))
    row = F.struct(*(F.col(c) for c in names))
    once = out.join(again, repeats).groupBy(f"{mark}_id", f"{mark}_hash").agg(F.min_by(row, F.xxhash64(*(F.col(c) for c in names))).alias("row")).select("row.*")
    return out.join(again, repeats, "left_anti").select(*names).unionByName(once)


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, {SQL_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {N - 1}, 1) + 1), lambda i: array_to_string(w[i:i+{N - 1}], ' ')))) AS l FROM d WHERE len(w) > 0),
k AS (SELECT doc_id, l, min(doc_id) OVER (PARTITION BY l) AS rep, count(*) OVER (PARTITION BY l) - 1 AS copies FROM e),
s AS (SELECT doc_id, len(l) AS n, unnest(l) AS s FROM k WHERE doc_id = rep),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c, any_value(x.n) AS na, any_value(y.n) AS nb FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM c WHERE c / (na + nb - c) >= {THRESHOLD}),
u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS v, a AS w FROM u UNION SELECT r.v, u.b FROM r JOIN u ON r.w = u.a),
g AS (SELECT v, min(w) AS root FROM r GROUP BY v),
n AS (SELECT a, count(*) AS links FROM u GROUP BY a)
SELECT doc_id, coalesce(root, rep) AS class_id, coalesce(links, 0) AS links, copies FROM k LEFT JOIN g ON v = rep LEFT JOIN n ON n.a = rep WHERE copies > 0 OR links > 0
"""
