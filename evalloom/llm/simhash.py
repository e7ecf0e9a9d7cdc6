"""SimHash near-duplicates: fingerprints linked by vantage-point trees, and their connected components.

1. A fingerprint for each document (three-word shingles, XXH64, majority of each bit), written once.
2. Equal fingerprints form one class; only distinct ones go on.
3. The upper levels of a vantage-point tree, drawn from a sample of ``PER_SHARD`` fingerprints a shard, deal the classes
   into shards of about ``SHARD`` members: one level for each doubling of the table. By the triangle bound a fingerprint
   also visits, as a query, every shard whose region may hold one within ``REACH`` bits: of n random ones
   (n / SHARD) ** 0.54, as a level multiplies visits by 1.45. Members are not copied.
4. Each shard searches the tree of its members for the larger ones of members and visitors: regions out of reach are
   pruned, small ones compared; a dense region that no point divides is linked by values one bit off. Of the links found only a spanning forest leaves the shard, so that a group of n near
   copies gives n links, not n * n.
5. Components: large-star and small-star steps over the links, each written to the shared folder, until all links form stars.

Defined results: null and empty texts have fingerprint zero and link like any other; equal fingerprints of repeated rows
form one class; rows with a null doc_id get a fingerprint and the component of their class (null if no id is in it); an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_classes, slices, texts, written

WORDS, REACH = 3, 2
SHARD = 40_000  # distinct fingerprints that a shard has as members, about
PER_SHARD = 32  # fingerprints a shard in the sample from which the upper tree is drawn
DEALT = 1 << 18  # fingerprints that are dealt together
BROADCAST = 4_000_000  # ids of copies that may be broadcast
DENSE = 2048  # members of a region that no vantage point divides, from which on the flipped values link it
SMALL = 192  # a region of at most so many is compared directly


def fingerprint(text: str) -> int:
    """64 bits: each is 1 if set in over half the shingles' hashes."""
    words = text.encode("utf-8", "replace").lower().split()  # ASCII lower case and white space only
    if not words:
        return 0
    if len(words) < WORDS:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        whole = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: -WORDS] + 1).tolist()]
        of = xxhash.xxh64_intdigest
        hashes = [of(whole[a:b], 42) for a, b in zip(starts, ends[WORDS - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[i : i + (1 << 15)], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((1 << np.nonzero(2 * total > len(hashes))[0].astype(object)).sum())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long); one pass, no shuffle."""

    def run(batches):
        for b in slices(batches, "text", 8 << 20):
            fps = np.array([fingerprint(t) for t in texts(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fp": pa.array(fps, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class Tree:
    """The upper tree: vantage points and radii, by node; region 2i+1 is within the radius, 2i+2 beyond it.

    A region without a sample gets a vantage point of all: it's rarely visited, and any point serves.
    """

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.points, self.radii = np.zeros((1 << depth) - 1, np.uint64), np.zeros((1 << depth) - 1, np.int64)
        held = {0: sample}
        for node in range((1 << depth) - 1):
            x = held.pop(node)
            if len(x) or len(sample):
                self.points[node] = x[rng.integers(len(x))] if len(x) else sample[rng.integers(len(sample))]
            d = np.bitwise_count(x ^ self.points[node])
            self.radii[node] = int(np.median(d)) if len(x) else 32
            held[2 * node + 1], held[2 * node + 2] = x[d <= self.radii[node]], x[d > self.radii[node]]

    def deal(self, x: np.ndarray, reach: int = REACH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, places in x, whether it is their own shard) for every shard that any of them must visit."""
        todo = [(0, np.arange(len(x)), np.ones(len(x), bool))]
        while todo:
            node, at, own = todo.pop()
            if not len(at):
                continue
            if node >= len(self.points):
                yield node - len(self.points), at, own
                continue
            d, r = np.bitwise_count(x[at] ^ self.points[node]).astype(np.int64), self.radii[node]
            near, far = d <= r + reach, d > r - reach
            todo += [(2 * node + 1, at[near], own[near] & (d[near] <= r)), (2 * node + 2, at[far], own[far] & (d[far] > r))]


class Forest:
    """Union of places by least place."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, a: np.ndarray) -> np.ndarray:
        while True:
            b = self.up[a]
            if (b == a).all():
                return a
            self.up[a] = self.up[b]
            a = self.up[a]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            diff = a != b
            a, b = a[diff], b[diff]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def dense_pairs(members: np.ndarray, m: np.ndarray, queries: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of members and queries at most two bits apart whose components are those of all such pairs; exact.

    Two fingerprints are that near just if both are within one bit of some third. So each one is listed under itself and the
    64 values one bit off, and under each value all queries (members are among them) are tied to the first member. The work
    is in proportion to the number of fingerprints, however dense they lie.
    """
    shares = max(1, (len(members) + len(queries)) >> 17)  # values go by a share of their hash at a time: some 200 MB
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])

    def listed(x, share):
        values, of = (x[:, None] ^ flips[None]).ravel(), np.repeat(np.arange(len(x)), len(flips))
        if shares == 1:
            return values, of
        own = (values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shares) == share
        return values[own], of[own]

    for share in range(shares):
        (a, i), (b, j) = (tuple(np.concatenate(y) for y in zip(*(listed(x[k : k + (1 << 16)], share) for k in range(0, len(x), 1 << 16)), strict=True)) for x in (members, queries))
        if not len(a) or not len(b):
            continue
        order = np.argsort(a, kind="stable")
        a, i = a[order], i[order]
        at = np.searchsorted(a, b)
        met = (at < len(a)) & (a[np.minimum(at, len(a) - 1)] == b)
        first = i[at[met]]  # the first member under the value
        other = j[met]
        differ = members[first] != queries[other]
        if differ.any():
            yield m[first[differ]], q[other[differ]]


def near_pairs(members: np.ndarray, queries: np.ndarray, reach: int = REACH, seed: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (member place, query place) with distance at most ``reach`` and member < query in value; exact."""
    rng = np.random.default_rng(seed)
    todo = [(np.arange(len(members)), np.arange(len(queries)), 0)]
    while todo:
        m, q, stuck = todo.pop()
        if not len(m) or not len(q):
            continue
        if len(m) <= SMALL or len(q) <= SMALL // 4 or stuck > 3:
            step = max(1, 2_000_000 // len(m))
            for i in range(0, len(q), step):
                near = np.bitwise_count(queries[q[i : i + step], None] ^ members[None, m]) <= reach
                a, b = np.nonzero(near)
                a, b = q[i : i + step][a], m[b]
                keep = members[b] < queries[a]
                if keep.any():
                    yield b[keep], a[keep]
            continue
        point = members[m[rng.integers(len(m))]]
        dm, dq = np.bitwise_count(members[m] ^ point).astype(np.int64), np.bitwise_count(queries[q] ^ point).astype(np.int64)
        r = int(np.median(dm))
        if (dm <= r).all():
            r = max(int(dm.min()), r - 1)
        inside = dm <= r
        qi, qo = dq <= r + reach, dq > r - reach
        if reach == 2 and qi.sum() + qo.sum() > 1.6 * len(q) and len(m) > DENSE:
            yield from dense_pairs(members[m], m, queries[q], q)
            continue
        same = (len(m) - max(inside.sum(), (~inside).sum())) * 20 < len(m)
        todo += [(m[inside], q[qi], stuck + 1 if same else 0), (m[~inside], q[qo], stuck + 1 if same else 0)]


def _links(members: np.ndarray, visitors: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of one shard's links, as fingerprints (node, its least); each array holds no number twice."""
    x = np.sort(np.concatenate([members, visitors]))
    members = np.sort(members)
    home, forest = np.searchsorted(x, members), Forest(len(x))
    # each pair is found in the shard of its smaller side; x is sorted, so places order like values
    for a, b in near_pairs(members, x, reach):
        forest.join(home[a], b)
    root = forest.root(np.arange(len(x)))
    linked = np.nonzero(root != np.arange(len(x)))[0]
    return x[linked], x[root[linked]]


def links(classes: DataFrame, count: int, reach: int = REACH) -> DataFrame:
    """Links (a, b) with b < a as unsigned numbers, both as signed longs, whose components are those of all near pairs.

    classes: distinct fingerprints ``fp``; count: about how many. The sample that comes to the driver has ``PER_SHARD``
    fingerprints for every ``SHARD`` of the table.
    """
    depth = max(0, int(np.ceil(np.log2(max(1, count) / SHARD))))
    share = min(1.0, (PER_SHARD << depth) / max(count, 1))
    sample = classes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).toPandas()["fp"].to_numpy(np.int64).view(np.uint64) if depth else np.zeros(0, np.uint64)
    tree = Tree(np.sort(sample), depth)

    def deal(batches):
        # a shard gets one packed row from each block of fingerprints
        held, size = [], 0

        def rows(x):
            out = [(s, x[at[own]].tobytes(), x[at[~own]].tobytes()) for s, at, own in tree.deal(x, reach)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2))], ["shard", "members", "visitors"])

        for b in batches:
            held.append(b.column("fp").to_numpy().view(np.uint64))
            size += len(held[-1])
            if size >= DEALT:
                yield rows(np.concatenate(held))
                held, size = [], 0
        if held:
            yield rows(np.concatenate(held))

    def search(table: pa.Table) -> pa.Table:
        members, visitors = (np.concatenate([np.frombuffer(x, np.uint64) for x in table.column(c).to_pylist()]) for c in ("members", "visitors"))
        a, b = _links(members, visitors, reach)
        return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

    dealt = classes.select("fp").mapInArrow(deal, "shard int, members binary, visitors binary")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (a, b), by star contraction.

    A large-star step ties each node's larger neighbours to its least neighbour, a small-star step its smaller ones; both
    keep components. When no node has two links down, or one and a link from above, all links form stars, whose centres are
    the roots; one aggregate tells. Hubs hold many edges, so each step finds the least neighbour by a partial aggregate and
    joins it back. A step's table goes when the next one is written.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
        sums = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if not sums.where("down > 1 or (down = 1 and up = 1)").limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        before, edges = edges, written(small, "links")
        discard(before)


def linked(fps: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, fp, component_id from doc_id and fp; links at ``reach`` or fewer differing bits."""
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("many")), "classes")
    found = components(links(classes, classes.count(), reach))
    # by class: the least id of its component
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "first", "many", F.coalesce("root", "fp").alias("root"))
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("classes")), "roots")
    by_class = written(joined_classes(rooted, least, ["root"], "classes").select("fp", "many", "component_id"), "components")
    # a class or a component may hold a third of all rows
    return joined_classes(fps, by_class, ["fp"], "many").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Query form: doc_id, fingerprint (16 hex digits), component_id."""
    fps = written(fingerprints(docs), "fingerprints")
    return linked(fps).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; rows with a null id stay.

    Of repeated rows with one id all stay: the decision is by id.
    """
    gone = written(near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    few = gone.count() <= BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


