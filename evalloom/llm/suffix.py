"""Exact removal of byte strings that an earlier document has, by threshold-bounded interval expansion on a BWT.

A byte goes if it lies in a string of ``MIN`` bytes that also starts in a document with a smaller doc_id.

1. Every window of ``MIN`` bytes belongs to the least hash among its substrings of ``KS[0]`` bytes, so equal windows
   belong together. Owners that a sample finds heavier than ``HEAVY`` are split: their windows belong to the least hash
   among their substrings of ``KS[1]`` bytes, and where that is heavy, too, each different window is its own owner. A
   maximal run of windows of one owner is one string; owners are dealt into shards. A task gathers ``FLUSH`` bytes of strings
   before it packs a block for each shard; beyond ``FAN`` shards strings are dealt in two passes, first to groups of
   shards, so blocks never get smaller as the table grows. Of equal strings that a task holds only those of the smallest
   doc_id travel, and stand for the others, so a passage that a third of all documents share sends one string each time.
2. In a shard, equal strings form a class that one string stands for. The classes with several strings and those with a
   window that another class has, too, go to a Burrows-Wheeler transform. Intervals are expanded breadth-first: each level
   extends all open intervals backward by one symbol, which closes the boundaries whose common prefix has just that length.
   It stops at ``MIN``; what is still open shares a window. The least doc_id of each interval's classes decides.
3. Removed spans are merged by document, and applied to the texts: by broadcast where their measured size allows it, else
   by an ordinary join.

Defined results: null texts count as empty; texts below ``MIN`` bytes lose nothing; a null doc_id counts as larger than
all others; rows with one doc_id are one document (none of them makes another lose bytes), and each keeps its own spans;
an empty table gives an empty result. Texts longer than ``CHUNK`` are worked on in overlapping pieces; no byte is left out.
Columns of any names may be there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

MIN, K = 50, 12
KS = (K, 30, MIN)  # lengths of the substrings that own windows: of all, of heavy owners, of heavy ones among these
CHUNK = 1 << 18  # bytes of text that a task works on at once
CACHED = 1 << 15  # places that are hashed together, so that their numbers stay in the cache
SHARD = 4 << 20  # bytes of strings that a shard holds, about
HEAVY = 2 * SHARD  # bytes of strings from which on an owner is split
MOST_HEAVY = 1 << 20  # owners that are split at most: they are broadcast
GATHER = 256 << 20  # bytes of text whose spans meet in one group, about
SAMPLE = 32 << 20  # bytes of text that are weighed, about; a thousandth of the table, if that is more
FLUSH = 16 << 20  # bytes of strings that a task holds before it packs them
FAN = 1 << 15  # shards, or groups of shards, that a task deals to at once
RUN = 512  # windows of one string at most
LAST = (1 << 63) - 1  # stands for a null doc_id
BROADCAST = 64 << 20  # bytes of spans that may be broadcast
U = np.uint64


def kmer_hashes(a: np.ndarray) -> np.ndarray:
    """A mixed 64-bit number for each K-byte substring of ``a`` (uint8), len(a) - K + 1 of them."""
    n = len(a) - K + 1
    out = np.empty(max(n, 0), U)
    for i in range(0, n, CACHED):
        e = min(i + CACHED, n)
        h = out[i:e]
        h[:] = np.ndarray((e - i,), "<u8", a, i, strides=(1,))
        h *= U(0x9E3779B97F4A7C15)
        t = np.ndarray((e - i,), "<u4", a, i + 8, strides=(1,)).astype(U)
        t *= U(0xC2B2AE3D27D4EB4F)
        h ^= t
        for shift in (31, 32):
            np.right_shift(h, U(shift), out=t)
            h ^= t
            if shift == 31:
                h *= U(0xD6E8FEB86659FD93)
    return out


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


class Sums:
    """Order-sensitive hashes of any stretch of k-mers, from two running sums."""

    def __init__(self, h: np.ndarray):
        self.one, self.two = np.zeros(len(h) + 1, U), np.zeros(len(h) + 1, U)
        np.cumsum(h, out=self.one[1:])
        np.multiply(h, np.arange(len(h), dtype=U), out=self.two[1:])
        np.cumsum(self.two[1:], out=self.two[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        s = self.one[stop] - self.one[start]
        t = self.two[stop] - self.two[start] - start.astype(U) * s
        return (t * U(0x9FB21C651E98DF25)) ^ (s + (t >> U(29)))


    def every(self, size: int, step: int = CACHED) -> np.ndarray:
        """``of`` all stretches of ``size``, from each place, a part that stays in the cache at a time."""
        out = np.empty(len(self.one) - size, U)
        for a in range(0, len(out), step):
            e = min(a + step, len(out))
            s = self.one[a + size : e + size] - self.one[a:e]
            t = self.two[a + size : e + size] - self.two[a:e]
            t -= np.arange(a, e, dtype=U) * s
            s += t >> U(29)
            t *= U(0x9FB21C651E98DF25)
            np.bitwise_xor(t, s, out=out[a:e])
        return out


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every stretch, one after another."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def equal_strings(a: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each string the place of the first equal one. Hashes propose, bytes decide."""
    order = np.lexsort((lens, hashes))
    h, n = hashes[order], lens[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (n[1:] != n[:-1])]) if len(h) else np.zeros(0, bool)
    head = order[np.nonzero(new)[0]][np.cumsum(new) - 1] if len(h) else order
    first = np.empty(len(h), np.int64)
    first[order] = head
    dup = np.nonzero(first != np.arange(len(first)))[0]
    if len(dup):
        wrong = a[spread(starts[dup], lens[dup])] != a[spread(starts[first[dup]], lens[dup])]
        if wrong.any():
            bad = np.add.reduceat(wrong, np.cumsum(lens[dup]) - lens[dup]) > 0
            first[dup[bad]] = dup[bad]
    return first


def merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by (key, start), overlapping or touching ones of one key as one."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    # keys become disjoint ranges of one line, so that one running maximum serves all
    base = (np.cumsum(new_key) - 1) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    head = np.concatenate([[True], (start + base)[1:] > reach[:-1]])
    at = np.nonzero(head)[0]
    last = np.concatenate([at[1:] - 1, [len(key) - 1]])
    return key[at], start[at], (reach - base)[last]


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block."""
    head = ";".join(f"{k},{v.dtype.str},{len(v)}" for k, v in arrays.items()).encode()
    return zstandard.compress(len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(v).tobytes() for v in arrays.values()), 3)


def unpack(block: bytes) -> dict[str, np.ndarray]:
    data = zstandard.decompress(block)
    size = int.from_bytes(data[:4], "little")
    out, at = {}, 4 + size
    for part in data[4 : 4 + size].decode().split(";"):
        name, kind, n = part.split(",")
        out[name] = np.frombuffer(data, kind, int(n), at)
        at += out[name].nbytes
    return out


def interval_groups(t: np.ndarray, least: int = MIN) -> np.ndarray:
    """A number for each place of ``t`` (uint8): places with the same next ``least`` symbols share it.

    Suffixes are sorted by their first 8, 16, 32, ... symbols up to ``least`` or more. The last sort below ``least`` tells which
    neighbours have a shorter common prefix than it; the transform and the interval expansion give the longer ones, by
    increasing value up to ``least``.
    """
    n = len(t)
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(U)
    size, told, known = 8, 0, np.zeros(0, U)
    while True:
        # ties must keep their places in the last sort only
        order = np.argsort(key, kind="stable" if size >= least else None)
        s = key[order]
        rank = np.empty(n, U)
        rank[order] = np.cumsum(np.concatenate([[1], (s[1:] != s[:-1]).astype(np.int64)])).astype(U)
        if size >= least:
            break
        told, known = size, rank
        after = np.zeros(n, U)
        after[: max(0, n - size)] = rank[size:]
        key = (rank << U(32)) | after
        size *= 2
    del key, s, rank, padded
    closed = np.ones(n + 1, bool)  # between neighbours with a shorter common prefix
    if told:
        closed[2:] = known[order[1:]] != known[order[:-1]]
    del known
    # the empty suffix comes first; the symbol before the whole text is an end mark below all others
    sa = np.concatenate([[n], order])
    bwt = t.astype(np.int16)[sa - 1]
    bwt[sa == 0] = -1
    psi = np.argsort(bwt, kind="stable")  # the inverse of the LF mapping
    if not told:
        told, first = 1, bwt[psi]
        closed[1:] = first[1:] != first[:-1]
    open_ = np.nonzero(~closed)[0]
    for _ in range(told, least):
        if not len(open_):
            break
        group = np.cumsum(closed, dtype=np.int32)
        # a boundary opens where the two suffixes behind it, one symbol on, are already apart
        apart = group[psi[open_]] != group[psi[open_ - 1]]
        closed[open_[apart]] = True
        open_ = open_[~apart]
    out = np.empty(n + 1, np.int64)
    out[sa] = np.cumsum(closed) - 1
    return out[:n]


class Strings(NamedTuple):
    """Strings of windows, and spans that equal strings with a smaller doc_id decide; documents are places in ``key``."""

    key: np.ndarray
    tag: np.ndarray
    doc: np.ndarray
    off: np.ndarray
    len: np.ndarray
    owner: np.ndarray
    hash: np.ndarray
    text: np.ndarray  # of all strings, one after another
    gone: tuple[np.ndarray, np.ndarray, np.ndarray]  # document, start, end


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    return (x ^ U(0xA0761D6478BD642F * (level + 1) & LAST)) * U(0xE7037ED1A0B428DB)


def owners(h: np.ndarray, sums: Sums, at: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The owner of each window that starts at a place in ``at``; ``heavy`` is sorted."""
    own = sliding_min(h, MIN - K + 1)[at]
    for level in (1, 2) if len(heavy) else ():
        split = np.nonzero(heavy[np.searchsorted(heavy, own).clip(max=len(heavy) - 1)] == own)[0]
        if not len(split):
            break
        size, places = KS[level], np.arange(len(h) + K - KS[level])
        finer = sliding_min(sums.of(places, places + size - K + 1), MIN - size + 1) if size < MIN else sums.of(places, places + MIN - K + 1)
        own[split] = _mixed(finer[at[split]], level)
    return own


def _once(s: Strings) -> Strings:
    """Of equal strings those of the smallest doc_id; the spans of the others are decided."""
    start = np.cumsum(s.len) - s.len
    same = equal_strings(s.text, start, s.len, s.hash)
    least = np.full(len(same), LAST, np.int64)
    np.minimum.at(least, same, s.key[s.doc])
    late = s.key[s.doc] > least[same]
    if not late.any():
        return s
    gone = merged(*(np.concatenate(x) for x in zip(s.gone, (s.doc[late], s.off[late], (s.off + s.len)[late]), strict=True)))
    keep = ~late
    return Strings(s.key, s.tag, s.doc[keep], s.off[keep], s.len[keep], s.owner[keep], s.hash[keep], s.text[spread(start[keep], s.len[keep])], gone)


def _chunk(keys: list[int], tags: list[int], data: list[tuple[int, int, bytes]], heavy: np.ndarray) -> Strings:
    """The strings of one chunk. data: (document, offset, bytes)."""
    whole = np.frombuffer(b"".join(x[2] for x in data) + b"\0" * 8, np.uint8)
    sizes = np.array([len(x[2]) for x in data])
    begin, windows = np.cumsum(sizes) - sizes, sizes - MIN + 1
    h = kmer_hashes(whole[: int(sizes.sum())])
    sums = Sums(h)
    piece = np.repeat(np.arange(len(data), dtype=np.int32), windows)
    at = spread(begin, windows)
    own = owners(h, sums, at, heavy)
    head = np.concatenate([[True], (own[1:] != own[:-1]) | (piece[1:] != piece[:-1])])
    runs = np.nonzero(head)[0]
    pos = np.arange(len(at), dtype=np.int32) - np.repeat(runs.astype(np.int32), np.diff(np.append(runs, len(at))))
    runs = np.nonzero(head | (pos % RUN == 0))[0]
    lens = np.diff(np.append(runs, len(at))) + MIN - 1
    start, own, part = at[runs], own[runs], piece[runs]
    del h, head, pos, piece, at
    hashes = sums.of(start, start + lens - K + 1)
    del sums
    doc, base = np.array([x[0] for x in data])[part], np.array([x[1] for x in data])[part]
    none = np.zeros(0, np.int64)
    return _once(Strings(np.array(keys, np.int64), np.array(tags, np.int64), doc, start - begin[part] + base, lens, own, hashes, whole[spread(start, lens)], (none, none, none)))


def _together(parts: list[Strings]) -> Strings:
    """All strings, equal ones once."""
    if len(parts) == 1:
        return parts[0]
    first = np.cumsum([0] + [len(p.key) for p in parts])[:-1]
    gone = zip(*[(p.gone[0] + d, *p.gone[1:]) for p, d in zip(parts, first, strict=True)], strict=True)
    rest = {c: np.concatenate([getattr(p, c) for p in parts]) for c in ("key", "tag", "off", "len", "owner", "hash", "text")}
    return _once(Strings(doc=np.concatenate([p.doc + d for p, d in zip(parts, first, strict=True)]), gone=tuple(np.concatenate(x) for x in gone), **rest))


def _dealt(s: Strings, shards: int, buckets: int, group: int) -> Iterator[tuple[int, bytes]]:
    """(number, block) with the strings and decided spans of each shard, or of each ``group`` neighbouring shards."""
    shard = ((s.owner >> U(20)) % U(shards)).astype(np.int64) // group
    gone_shard = s.key[s.gone[0]] % buckets % shards // group
    start = np.cumsum(s.len) - s.len
    order, by_shard = np.argsort(shard, kind="stable"), np.argsort(gone_shard, kind="stable")
    numbers = np.unique(np.concatenate([shard, gone_shard]))
    edges, held = (np.append(np.searchsorted(a, numbers), len(a)) for a in (shard[order], gone_shard[by_shard]))
    for i, number in enumerate(numbers.tolist()):
        x, y = order[edges[i] : edges[i + 1]], by_shard[held[i] : held[i + 1]]
        docs, place = np.unique(np.concatenate([s.doc[x], s.gone[0][y]]), return_inverse=True)
        yield number, pack(
            key=np.diff(s.key[docs], prepend=0), tag=s.tag[docs], doc=np.diff(place[: len(x)], prepend=0).astype(np.int32), off=s.off[x] if not len(x) or s.off[x].max() >= 1 << 31 else s.off[x].astype(np.int32), len=s.len[x].astype(np.uint16),
            text=s.text[spread(start[x], s.len[x])], gdoc=place[len(x) :].astype(np.int32), gstart=s.gone[1][y], gend=s.gone[2][y],
        )


def _unpacked(blocks: list[bytes]) -> Strings:
    """The strings of blocks, without their owners."""
    parts = [unpack(b) for b in blocks]
    first = np.cumsum([0] + [len(p["key"]) for p in parts])[:-1]
    rest = {c: np.concatenate([p[c].astype(np.int64) for p in parts]) for c in ("tag", "off", "len")}
    gone = tuple(np.concatenate(x) for x in zip(*[(p["gdoc"].astype(np.int64) + d, p["gstart"], p["gend"]) for p, d in zip(parts, first, strict=True)], strict=True))
    doc = np.concatenate([np.cumsum(p["doc"], dtype=np.int64) + d for p, d in zip(parts, first, strict=True)])
    return Strings(key=np.concatenate([np.cumsum(p["key"]) for p in parts]), doc=doc, owner=np.zeros(0, U), hash=np.zeros(0, U), text=np.concatenate([p["text"] for p in parts]), gone=gone, **rest)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[tuple[int, int, bytes]]]]:
    keys: list[int] = []
    tags: list[int] = []
    data: list[tuple[int, int, bytes]] = []
    held = 0
    for b in batches:
        for k, tag, text in zip(b.column("k").to_pylist(), b.column("tag").to_pylist(), b.column("text"), strict=True):
            text = (text.as_py() or "").encode("utf-8", "replace")
            if len(text) < MIN:
                continue
            for base in range(0, len(text) - MIN + 1, CHUNK):
                keys.append(k)
                tags.append(tag)
                data.append((len(keys) - 1, base, text[base : base + CHUNK + MIN - 1]))
                held += len(data[-1][2])
                if held >= CHUNK:
                    yield keys, tags, data
                    keys, tags, data, held = [], [], [], 0
    if data:
        yield keys, tags, data


def _shard_spans(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Removed spans (key, tag, start, end) that one shard finds or was handed."""
    s = _unpacked(blocks)
    key, tag, doc, off, lens, spans = s.key, s.tag, s.doc, s.off, s.len, [s.gone]
    a = np.concatenate([s.text, np.zeros(8, np.uint8)])
    del s
    if len(doc):
        start = np.cumsum(lens) - lens
        h = kmer_hashes(a)
        sums = Sums(h)
        del h
        same = equal_strings(a, start, lens, sums.of(start, start + lens - K + 1))
        least = np.full(len(same), LAST, np.int64)
        np.minimum.at(least, same, key[doc])
        # of each class the first string; windows that two of them have, or one has twice
        rep = np.nonzero(same == np.arange(len(same)))[0]
        windows = spread(start[rep], lens[rep] - MIN + 1)
        w = sums.every(MIN - K + 1)[windows]
        del sums, windows
        s = np.sort(w)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        del s
        mark = np.zeros(1 << 20, bool)
        mark[(twice & U((1 << 20) - 1)).astype(np.int64)] = True
        hit = np.nonzero(mark[(w & U((1 << 20) - 1)).astype(np.int64)])[0]
        if len(twice):
            hit = hit[twice[np.searchsorted(twice, w[hit]).clip(max=len(twice) - 1)] == w[hit]]
        del w
        string_of = np.searchsorted(np.cumsum(lens[rep] - MIN + 1), hit, side="right")
        shared = np.bincount(same, minlength=len(same)) > 1
        shared[rep[np.unique(string_of)]] = True
        chosen = rep[shared[rep]]
        if len(chosen):
            # the transform's text: the chosen strings, each ended by a zero
            size = lens[chosen] + 1
            t = np.zeros(int(size.sum()), np.uint8)
            t_start = np.cumsum(size) - size
            t[spread(t_start, lens[chosen])] = a[spread(start[chosen], lens[chosen])]
            group = interval_groups(t)
            valid = spread(t_start, lens[chosen] - MIN + 1)
            low = np.full(int(group.max()) + 1, LAST, np.int64)
            np.minimum.at(low, group[valid], np.repeat(least[chosen], lens[chosen] - MIN + 1))
            at = np.full(len(same), -1, np.int64)
            at[chosen] = t_start
            for occ in np.array_split(np.nonzero(shared[same])[0], 1 + len(same) // 20_000):
                count = lens[occ] - MIN + 1
                who = np.repeat(occ, count)
                step = spread(np.zeros(len(occ), np.int64), count)
                lost = low[group[at[same[who]] + step]] < key[doc[who]]
                who, step = who[lost], step[lost]
                spans.append(merged(who, off[who] + step, off[who] + step + MIN))
                spans[-1] = (doc[spans[-1][0]], *spans[-1][1:])
    d, s, e = merged(*(np.concatenate(x) for x in zip(*spans, strict=True)))
    return key[d], tag[d], s, e


def heavy_owners(docs: DataFrame, total: int) -> np.ndarray:
    """Owners with more than ``HEAVY`` bytes of strings, by a sample: it only decides how strings are dealt.

    At most one for each two shards, and the ``MOST_HEAVY`` heaviest of these, come to the driver; a heavy owner that isn't
    among them makes a larger shard. The second look weighs the parts of the first one's finds.
    """
    share = min(1.0, max(SAMPLE, total / 1000) / max(1, total))
    sample = docs if share == 1 else docs.where(F.rand(7) < share)
    heavy = np.zeros(0, U)
    for _ in range(2):

        def weigh(batches, heavy=heavy):
            for keys, tags, data in _pieces(batches):
                s = _chunk(keys, tags, data, heavy)
                own, at = np.unique(s.owner, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.bincount(at, s.len).astype(np.int64))], ["owner", "n"])

        weights = sample.select("k", "tag", "text").mapInArrow(weigh, "owner long, n long").groupBy("owner").agg(F.sum("n").alias("n"))
        most = weights.where(F.col("n") > HEAVY * share).orderBy(F.desc("n"), "owner").limit(MOST_HEAVY)
        found = np.array([r["owner"] for r in most.select("owner").collect()], np.int64).view(U)
        if not len(found):
            break
        heavy = np.unique(np.concatenate([heavy, found]))
    return heavy


def spans(docs: DataFrame, total: int) -> DataFrame:
    """k, tag, spans (packed starts and ends, merged) of every document that loses bytes.

    docs: k (doc_id, ``LAST`` for null), tag (tells rows of one doc_id apart; 0 where ids are unique), text; total: its bytes.
    """
    tasks = partitions(docs.sparkSession)
    buckets = max(tasks, -(-total // GATHER))  # groups of documents whose spans meet
    shards = max(2 * tasks, -(-total * 7 // (2 * SHARD)))
    group = -(-shards // FAN)  # shards that the first pass deals to as one
    sent = docs.sparkSession.sparkContext.broadcast(heavy_owners(docs, total))

    def cut(batches):
        parts, held = [], 0
        for keys, tags, data in _pieces(batches):
            parts.append(_chunk(keys, tags, data, sent.value))
            held += len(parts[-1].text)
            if held >= FLUSH:
                yield from packed(_together(parts), group)
                parts, held = [], 0
        if parts:
            yield from packed(_together(parts), group)

    def packed(s, group):
        rows = list(_dealt(s, shards, buckets, group))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "block"])

    def again(batches):
        # the second pass: blocks of one group of shards follow each other
        held, size, of = [], 0, None

        def deal():
            s = _unpacked(held)
            start = np.cumsum(s.len) - s.len
            if len(start):
                h = kmer_hashes(np.concatenate([s.text, np.zeros(8, np.uint8)]))
                sums = Sums(h)
                s = _once(s._replace(owner=owners(h, sums, start, sent.value), hash=sums.of(start, start + s.len - K + 1)))
            return packed(s, 1)

        for b in batches:
            for number, block in zip(b.column("shard").to_pylist(), b.column("block").to_pylist(), strict=True):
                if held and (number != of or size >= FLUSH):
                    yield from deal()
                    held, size = [], 0
                of = number
                held.append(block)
                size += 3 * len(block)
        if held:
            yield from deal()

    def search(t: pa.Table) -> pa.Table:
        key, tag, start, end = _shard_spans(t.column("block").to_pylist())
        bucket = (key ^ (key >> 17)) % buckets
        order = np.argsort(bucket, kind="stable")
        there, edges = np.unique(bucket[order], return_index=True)
        rows = [(b, pack(key=key[x], tag=tag[x], start=start[x], end=end[x])) for b, x in zip(there.tolist(), np.split(order, edges[1:]), strict=True)] if len(there) else []
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.binary())})

    def gather(t: pa.Table) -> pa.Table:
        parts = [unpack(b) for b in t.column("block").to_pylist()]
        key, tag, start, end = (np.concatenate([p[x] for p in parts]) for x in ("key", "tag", "start", "end"))
        order = np.lexsort((tag, key))
        key, tag, start, end = key[order], tag[order], start[order], end[order]
        ident = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])]))
        head = np.nonzero(np.concatenate([[True], ident[1:] != ident[:-1]]))[0]
        d, s, e = merged(ident, start, end)
        edges = np.searchsorted(d, np.arange(len(head) + 1))
        return pa.table({"k": pa.array(key[head], pa.int64()), "tag": pa.array(tag[head], pa.int64()), "spans": pa.array([np.stack([s[i:j], e[i:j]]).tobytes() for i, j in zip(edges, edges[1:], strict=False)], pa.binary())})

    blocks = docs.select("k", "tag", "text").mapInArrow(cut, "shard long, block binary")
    if group > 1:
        copies = max(1, -(-group * SHARD // (8 * FLUSH)))  # tasks that share a group
        salt = F.pmod(F.xxhash64("block"), F.lit(copies))
        blocks = blocks.repartition(max(buckets, -(-shards // 64)), "shard", salt).sortWithinPartitions("shard").mapInArrow(again, "shard long, block binary")
    return blocks.groupBy("shard").applyInArrow(search, "bucket long, block binary").groupBy("bucket").applyInArrow(gather, "k long, tag long, spans binary")


def _with_spans(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row (a struct of ``columns``), text and spans for every row of ``docs``; so names can't clash."""
    sizes = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).agg(F.max("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    tag = F.lit(0).cast("long") if (sizes["rows"] or 0) <= 1 else F.xxhash64("text")
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    marked = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), tag.alias("tag"), "text", row)
    found = written(spans(marked.select("k", "tag", "text"), sizes["bytes"] or 0), "spans")
    size = found.agg(F.sum(F.length("spans") + 48)).first()[0] or 0
    return marked.join(F.broadcast(found) if size <= BROADCAST else found, ["k", "tag"], "left").select("row", "text", "spans")


def kept(text: bytes, block: bytes | None) -> tuple[bytes, int, int]:
    """Remaining bytes, how many are gone, and in how many runs."""
    if not block:
        return text, 0, 0
    start, end = np.frombuffer(block, np.int64).reshape(2, -1)
    parts, at = [], 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]]), int((end - start).sum()), len(start)


def report(docs: DataFrame) -> DataFrame:
    """Query form: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches):
        for b in batches:
            rows = []
            for text, block in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                text = (text.as_py() or "").encode("utf-8", "replace")
                rest, gone, runs = kept(text, block)
                rows.append((len(text), gone, runs, hashlib.sha256(rest).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column("row").field(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, ["doc_id"]).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with repeated bytes cut from ``text`` (a character cut in two goes); n_chars is renewed.

    Null texts stay null; documents that lose everything stay with an empty text.
    """
    others = [c for c in columns if c != "text"]
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema

    def run(batches):
        for b in batches:
            new = [None if t is None else kept(t.encode("utf-8", "replace"), s)[0].decode("utf-8", "ignore") if s else t for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else b.column("row").field(others.index(c)) for c in columns], columns)

    out = _with_spans(docs, others).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in columns else out
