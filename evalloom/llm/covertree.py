"""Embedding near-duplicates: exact cosine pairs within a label by a dual traversal of cover trees.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c), so triangle bounds hold.

1. Equal vectors of a label form one class with its number of rows; only classes go on.
2. A label of up to ``SHARD`` classes is searched as a whole. A larger one is dealt to shards: a sample gives a centre for
   each ``SHARD`` classes, a class belongs to its nearest centre, and visits, as a query, each shard of a lower number whose
   covering radius it can't rule out. So every near pair of different shards meets just once. Visitors stream past the tree
   of a shard in packs; a task holds one shard and one pack.
3. A shard's cover tree has nested levels with halving radii: a level's centres are further apart than its radius, and each
   node knows the true radius of what it covers.
4. The dual traversal takes pairs of nodes: beyond both radii and the reach they are pruned, within the reach by both radii
   all their pairs are links, counted without listing them; of other pairs the larger node is replaced by its children. Single
   vectors are decided by the cosine itself. A block of pairs is done to its end before the next one.
5. A shard gives partial numbers of links and a spanning forest of them; components as for SimHash.

On data without structure distances are all alike and no bound prunes much: then the work is the square of a label's
classes, as blocks of matrix products, and a class visits every lower shard.

Defined results: each row is a vector, repeated rows and ids, too, and links of a vector are other rows; null labels, null,
zero or non-finite vectors and those with null components have no links and are their own component; vectors of different
length never link; a null vec_id takes part, its component is the least id reachable (null if none) and it isn't kept; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_classes, partitions, written
from .simhash import Forest, components

LEAST_COSINE = 0.93
SHARD, MOST_SHARDS = 16_384, 32_768  # classes in a shard, about; shards of all labels together (their centres are broadcast)
LEAF = 64  # a node of so many vectors isn't cut further
PACK = 16_384  # visitors that pass a shard's tree together
BLOCK = 1_000_000  # pairs of nodes, or of vectors, that are met at once
SLACK = 1e-9  # bounds are taken with this much room; vectors nearer to the threshold than that are compared exactly


class Node:
    """Children as arrays: centre (a row of the tree's vectors), radius, slice of the tree's order, and node (or None)."""

    __slots__ = ("centre", "high", "low", "node", "radius")

    def __init__(self, centre, radius, low, high, node):
        self.centre, self.radius, self.low, self.high, self.node = centre, radius, low, high, node

    def part(self, rows: np.ndarray) -> Node:
        """A node of just these children."""
        return Node(self.centre[rows], self.radius[rows], self.low[rows], self.high[rows], [self.node[i] for i in rows.tolist()])


class CoverTree:
    """Nested nets of halving radii over unit vectors; each node's vectors are one slice of ``order``."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        self.order = np.zeros(len(unit), np.int64)
        self.root = self._cut(np.arange(len(unit)), 0, 2.0)

    def net(self, idx: np.ndarray, radius: float, step: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres (the first of ``idx`` is one), each vector's centre number and its distance, at most ``radius``."""
        centres: list[int] = []
        of, far = np.zeros(len(idx), np.int64), np.zeros(len(idx))
        near = 1 - radius * radius / 2
        for at in range(0, len(idx), step):
            block = np.arange(at, min(at + step, len(idx)))
            x = self.unit[idx[block]]
            best = np.full(len(block), -2.0)
            if centres:
                g = x @ self.unit[centres].T
                of[block] = g.argmax(1)
                best = g.max(1)
            open_ = np.flatnonzero(best < near)
            g = x[open_] @ x[open_].T
            left = np.ones(len(open_), bool)
            for k in range(len(open_)):
                if not left[k]:
                    continue
                better = left & ((g[k] >= near) | (np.arange(len(open_)) == k))
                of[block[open_[better]]], best[open_[better]] = len(centres), g[k, better]
                best[open_[k]] = 1.0
                left &= ~better
                centres.append(int(idx[block[open_[k]]]))
            far[block] = np.sqrt(np.maximum(0, 2 - 2 * best))
        return np.array(centres), of, far

    def _cut(self, idx: np.ndarray, low: int, radius: float) -> Node:
        top: list = [None]
        todo = [(idx, low, radius, top, 0)]
        while todo:
            idx, low, radius, into, place = todo.pop()
            of = None
            while len(idx) > LEAF and radius > 1e-6:
                radius /= 2
                centres, of, far = self.net(idx, radius)
                if len(centres) > 1:
                    break
                of = None
            if of is None:
                at = low + np.arange(len(idx))
                self.order[at] = idx
                into[place] = Node(idx, np.zeros(len(idx)), at, at + 1, [None] * len(idx))
                continue
            by = np.lexsort((far, of))  # a centre comes before what it covers
            idx, of, far = idx[by], of[by], far[by]
            start = np.searchsorted(of, np.arange(len(centres) + 1))
            reach = np.maximum.reduceat(far, start[:-1])
            reach[np.diff(start) == 1] = 0.0
            # equal centres after sorting by distance: the centre itself stands first
            for s in np.flatnonzero(idx[start[:-1]] != centres):
                a, b = start[s], start[s + 1]
                k = a + int(np.flatnonzero(idx[a:b] == centres[s])[0])
                idx[a], idx[k] = idx[k], idx[a]
            self.order[low : low + len(idx)] = idx
            made = Node(centres, reach, low + start[:-1], low + start[1:], [None] * len(centres))
            into[place] = made
            for s in np.flatnonzero(np.diff(start) > 1).tolist():
                todo.append((idx[start[s] : start[s + 1]], low + int(start[s]), radius, made.node, s))
        return top[0]


class Found:
    """Numbers of links and the forest of what was found among the members and one pack of visitors."""

    def __init__(self, members: Vectors, visitors: Vectors | None = None):
        self.sides = (members, visitors if visitors is not None else members)
        self.own = visitors is None
        self.base = 0 if self.own else len(members.weight)
        self.forest = Forest(self.base + len(self.sides[1].weight))
        self.links = [np.zeros(len(members.weight), np.int64)]
        self.links.append(self.links[0] if self.own else np.zeros(len(visitors.weight), np.int64))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links of single vectors."""
        np.add.at(self.links[0], a, self.sides[1].weight[b])
        np.add.at(self.links[1], b, self.sides[0].weight[a])
        self.forest.join(a, self.base + b)

    def all_of(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every vector of ``a`` with every one of ``b``."""
        self.links[0][a] += self.sides[1].weight[b].sum()
        self.links[1][b] += self.sides[0].weight[a].sum()
        both = np.concatenate([a, self.base + b])
        self.forest.join(both[1:], np.full(len(both) - 1, both[0]))

    def within(self, a: np.ndarray) -> None:
        """All pairs among ``a``."""
        w = self.sides[0].weight[a]
        self.links[0][a] += w.sum() - w
        self.forest.join(a[1:], np.full(len(a) - 1, a[0]))

    def rows(self) -> pa.RecordBatch:
        """a, b, links: numbers of links (b null) and links of the forest (links null)."""
        ids = self.sides[0].ids if self.own else np.concatenate([self.sides[0].ids, self.sides[1].ids])
        counts = self.links[0] if self.own else np.concatenate(self.links)
        some = np.flatnonzero(counts)
        root = self.forest.root(np.arange(len(ids)))
        tied = np.flatnonzero(root != np.arange(len(ids)))
        none = lambda n: np.ones(n, bool)
        a = np.concatenate([ids[some], ids[tied]])
        b = pa.array(np.concatenate([ids[some], ids[root[tied]]]), mask=np.concatenate([none(len(some)), ~none(len(tied))]))
        n = pa.array(np.concatenate([counts[some], counts[tied]]), mask=np.concatenate([~none(len(some)), none(len(tied))]))
        return pa.RecordBatch.from_arrays([pa.array(a), b, n], ["a", "b", "links"])


class Vectors:
    """Class ids, numbers of rows, vectors, and their cover tree."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, raw: np.ndarray):
        self.ids, self.weight = ids, weight
        self.raw = raw / np.abs(raw).max(1, keepdims=True)
        self.norm = np.sqrt((self.raw * self.raw).sum(1))
        self.tree = CoverTree(self.raw / self.norm[:, None])


def _decided(one: Vectors, two: Vectors, p: np.ndarray, q: np.ndarray, c: np.ndarray, cosine: float) -> np.ndarray:
    """Which single vectors with inner products ``c`` are near; those next to the threshold by the cosine itself."""
    sure = c >= cosine
    for k in np.flatnonzero(np.abs(c - cosine) < SLACK).tolist():
        sure[k] = one.raw[p[k]] @ two.raw[q[k]] / (one.norm[p[k]] * two.norm[q[k]]) >= cosine
    return sure


def _compared(found: Found, one: Vectors, two: Vectors, p: np.ndarray, q: np.ndarray, cosine: float, wanted=None) -> None:
    """Every vector of ``p`` with every one of ``q``, as blocks of a matrix product; only pairs of places that are ``wanted``."""
    x, step = one.tree.unit[p], max(1, BLOCK // len(p))
    for at in range(0, len(q), step):
        g = x @ two.tree.unit[q[at : at + step]].T
        i, j = np.nonzero(g >= cosine - SLACK)
        c = g[i, j]
        if wanted is not None and len(i):
            keep = wanted(i, at + j)
            i, j, c = i[keep], j[keep], c[keep]
        if len(i):
            a, b = p[i], q[at + j]
            sure = _decided(one, two, a, b, c, cosine)
            found.pairs(a[sure], b[sure])


def _runs(by: np.ndarray, other: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``by`` with its values of ``other``."""
    order = np.argsort(by, kind="stable")
    by, other = by[order], other[order]
    start = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, np.int64)
    yield from zip(by[start].tolist(), np.split(other, start[1:]) if len(by) else [], strict=True)


def _held(tree: CoverTree, node: Node, rows: np.ndarray) -> np.ndarray:
    """The vectors below these children of a node."""
    low, many = node.low[rows], node.high[rows] - node.low[rows]
    return tree.order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]


def traverse(members: Vectors, visitors: Vectors | None, cosine: float) -> Found:
    """All pairs of members and visitors (of members among themselves, without visitors) of at least ``cosine``.

    The children of two nodes are met a block of pairs at a time, and what a block leaves open is done before the next one: so
    no more than a block of pairs a level waits, however little the bounds prune. Of an open pair the larger child is replaced
    by its own children, for all its partners together; pairs of small children are compared vector by vector.
    """
    found, one, two = Found(members, visitors), members, visitors if visitors is not None else members
    reach, own = float(np.sqrt(2 - 2 * cosine)), visitors is None
    x, y = one.tree.unit, two.tree.unit
    stack = [(one.tree.root, two.tree.root, own, 0)]
    while stack:
        a, b, same, at = stack.pop()
        part = slice(at, at + max(1, BLOCK // len(b.centre)))
        if part.stop < len(a.centre):
            stack.append((a, b, same, part.stop))
        g = x[a.centre[part]] @ y[b.centre].T
        cover = a.radius[part, None] + b.radius[None]
        d = np.sqrt(np.maximum(0, 2 - 2 * g))
        near = d <= cover + (reach + SLACK)
        if same:
            near &= np.arange(at, at + len(g))[:, None] < np.arange(len(b.centre))[None]
        i, j = np.nonzero(near)
        c, r, far = g[i, j], cover[i, j], d[i, j]
        del g, cover, d, near
        i += at
        many, more = a.high[i] - a.low[i], b.high[j] - b.low[j]
        single = (many == 1) & (more == 1)
        if single.any():
            p, q = a.centre[i[single]], b.centre[j[single]]
            sure = _decided(one, two, p, q, c[single], cosine)
            found.pairs(p[sure], q[sure])
        all_ = ~single & (far + r <= reach - SLACK)
        for k in np.flatnonzero(all_).tolist():
            found.all_of(one.tree.order[a.low[i[k]] : a.high[i[k]]], two.tree.order[b.low[j[k]] : b.high[j[k]]])
        open_, first, small = ~single & ~all_, many >= more, np.maximum(many, more) <= LEAF
        low = open_ & small
        if low.any():
            p, q = np.unique(i[low]), np.unique(j[low])
            of_p, of_q = np.repeat(p, a.high[p] - a.low[p]), np.repeat(q, b.high[q] - b.low[q])
            if len(of_p) * len(of_q) <= 8 * (many[low] * more[low]).sum():  # most are open: one product for all of them
                wanted = np.zeros((part.stop - at, len(b.centre)), bool)
                wanted[i[low] - at, j[low]] = True
                _compared(found, one, two, _held(one.tree, a, p), _held(two.tree, b, q), cosine, lambda k, m, f=of_p, t=of_q, w=wanted, at=at: w[f[k] - at, t[m]])
            else:
                for k, others in _runs(i[low & first], j[low & first]):
                    _compared(found, one, two, one.tree.order[a.low[k] : a.high[k]], _held(two.tree, b, others), cosine)
                for k, others in _runs(j[low & ~first], i[low & ~first]):
                    _compared(found, one, two, _held(one.tree, a, others), two.tree.order[b.low[k] : b.high[k]], cosine)
        stack += [(a.node[k], b.part(others), False, 0) for k, others in _runs(i[open_ & ~small & first], j[open_ & ~small & first])]
        stack += [(a.part(others), b.node[k], False, 0) for k, others in _runs(j[open_ & ~small & ~first], i[open_ & ~small & ~first])]
        if same and at == 0:
            for k in np.flatnonzero(a.high - a.low > 1).tolist():
                if 2 * a.radius[k] <= reach - SLACK:
                    found.within(one.tree.order[a.low[k] : a.high[k]])
                else:
                    stack.append((a.node[k], a.node[k], True, 0))
    return found


def _vectors(batch) -> Vectors:
    """The vectors of a table with columns cid, many and x."""
    flat = batch.column("x").combine_chunks() if isinstance(batch, pa.Table) else batch.column("x")
    raw = flat.flatten().to_numpy().reshape(batch.num_rows, -1)
    return Vectors(batch.column("cid").to_numpy(), batch.column("many").to_numpy(), raw)


def _packed(shard: int, visits: bool, batch: pa.RecordBatch, rows: np.ndarray, raw: np.ndarray) -> tuple:
    return shard, visits, batch.column("cid").to_numpy()[rows].tobytes(), batch.column("many").to_numpy()[rows].tobytes(), raw[rows].tobytes()


OUT = "a long, b long, links long"


def _dealt(classes: DataFrame, big: list, cosine: float, shard: int) -> DataFrame:
    """Partial results of the groups of ``big`` (group, count), each cut into shards."""
    spark = classes.sparkSession
    numbers = {(r["label"], r["size"]): k for k, r in enumerate(big)}
    shard = max(shard, -(-sum(r["count"] for r in big) // MOST_SHARDS))
    named = spark.createDataFrame([(r["label"], r["size"], k, float(2 * -(-r["count"] // shard)) / r["count"]) for k, r in enumerate(big)], "label string, size int, grp int, share double")
    rows = classes.join(F.broadcast(named), ["label", "size"])
    sample = rows.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < F.col("share") * float(1 << 30)).select("grp", "x").collect()
    held: dict[int, list] = {k: [] for k in numbers.values()}
    for r in sample:
        held[r["grp"]].append(r["x"])
    # of about twice as many sampled vectors, those farthest from one another
    centres, first, total = {}, {}, 0
    for k, r in enumerate(big):
        x = np.array(sorted(held[k]) or [[1.0] * r["size"]])
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        keep, closest = [0], x @ x[0]
        while len(keep) < min(len(x), -(-r["count"] // shard)):
            keep.append(int(closest.argmin()))
            closest = np.maximum(closest, x @ x[keep[-1]])
        centres[k], first[k] = x[keep], total
        total += len(keep)
    sent = spark.sparkContext.broadcast(centres)
    reach = float(np.sqrt(2 - 2 * cosine))

    def groups(batch):
        grp = batch.column("grp").to_numpy()
        for g in np.unique(grp).tolist():
            at = np.flatnonzero(grp == g)
            raw = batch.column("x").take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
            unit = raw / np.abs(raw).max(1, keepdims=True)
            unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
            for k in range(0, len(at), 4096):
                d = np.sqrt(np.maximum(0, 2 - 2 * (unit[k : k + 4096] @ sent.value[g].T)))
                yield g, at[k : k + 4096], raw[k : k + 4096], d

    def homes(batches):
        for batch in batches:
            for g, _, _, d in groups(batch):
                home = d.argmin(1)
                which, many = np.unique(home, return_counts=True)
                far = np.zeros(d.shape[1])
                np.maximum.at(far, home, d.min(1))
                yield pa.RecordBatch.from_arrays([pa.array(which + first[g], pa.int32()), pa.array(far[which]), pa.array(many, pa.int64())], ["shard", "far", "many"])

    radius = np.zeros(total)
    for r in rows.select("grp", "x").mapInArrow(homes, "shard int, far double, many long").groupBy("shard").agg(F.max("far").alias("far")).toLocalIterator():
        radius[r["shard"]] = r["far"]
    copies = max(1, -(-2 * partitions(spark) // total))

    def deal(batches):
        for batch in batches:
            out = []
            for g, at, raw, d in groups(batch):
                home, part = d.argmin(1), batch.take(pa.array(at))
                span = radius[first[g] : first[g] + d.shape[1]]
                visits = (d <= span + (reach + SLACK)) & (np.arange(d.shape[1])[None] < home[:, None])
                for s in np.unique(home).tolist():
                    out.append(_packed(first[g] + s, False, part, np.flatnonzero(home == s), raw))
                for s in np.flatnonzero(visits.any(0)).tolist():
                    out.append(_packed(first[g] + s, True, part, np.flatnonzero(visits[:, s]), raw))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "visits", "cid", "many", "x"])

    packed = rows.select("grp", "cid", "many", "x").mapInArrow(deal, "shard int, visits boolean, cid binary, many binary, x binary")
    every = F.sequence(F.lit(0), F.lit(copies - 1))
    to = packed.withColumn("copy", F.explode(F.when(F.col("visits"), F.array(F.pmod(F.xxhash64("cid"), F.lit(copies)).cast("int"))).otherwise(every)))

    def search(batches) -> Iterator[pa.RecordBatch]:
        def whole(parts):
            ids, many, x = (b"".join(p[k] for p in parts) for k in range(3))
            ids = np.frombuffer(ids, np.int64)
            return Vectors(ids, np.frombuffer(many, np.int64), np.frombuffer(x).reshape(len(ids), -1))

        at, held, members, waiting = None, [], None, 0

        def ready(copy):
            nonlocal members
            members = whole(held)
            held.clear()
            return traverse(members, None, cosine).rows() if copy == 0 else None

        def passed():
            nonlocal waiting
            out = traverse(members, whole(held), cosine).rows()
            held.clear()
            waiting = 0
            return out

        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in ("shard", "copy", "visits", "cid", "many", "x")}  # a row is a pack: not all rows at once
                key = (r["shard"], r["copy"])
                if key != at or (r["visits"] and members is None):
                    if held:
                        out = ready(at[1]) if members is None else passed()
                        if out is not None:
                            yield out
                    if key != at:
                        at, members = key, None
                held.append((r["cid"], r["many"], r["x"]))
                if r["visits"]:
                    waiting += len(r["cid"]) // 8
                    if waiting >= PACK:
                        yield passed()
        if held:
            out = ready(at[1]) if members is None else passed()
            if out is not None:
                yield out

    return to.repartition(min(total * copies, 16 * partitions(spark)), "shard", "copy").sortWithinPartitions("shard", "copy", "visits").mapInArrow(search, OUT)


def near(df: DataFrame, cosine: float = LEAST_COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    x = F.col(f"`{vector}`")
    usable = F.col(f"`{label}`").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)
    # adding 0.0 makes -0.0 equal to 0.0
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.when(F.coalesce(usable, F.lit(False)), F.transform(x, lambda c: c.cast("double") + 0.0)).alias("x"))
    part = rows.where("x is not null")
    found = part.groupBy("label", "x").agg(F.count(F.lit(1)).alias("many"), F.min("vec_id").alias("least"))
    classes = written(found.withColumn("cid", F.monotonically_increasing_id()).withColumn("size", F.size("x")), "vectors")
    sizes = classes.groupBy("label", "size").count()
    big = sizes.where(F.col("count") > shard).orderBy("label", "size").collect()  # at most one for each ``shard`` classes

    def alone(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([traverse(_vectors(t), None, cosine).rows()])

    small = classes
    if big:
        named = df.sparkSession.createDataFrame([(r["label"], r["size"]) for r in big], "label string, size int")
        small = classes.join(F.broadcast(named), ["label", "size"], "left_anti")
    hits = small.select("label", "size", "cid", "many", "x").groupBy("label", "size").applyInArrow(alone, OUT)
    if big:
        hits = hits.union(_dealt(classes, big, cosine, shard))
    hits = written(hits, "cosines")
    counts = hits.where("links is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    tied = components(hits.where("b is not null").select("a", "b"))
    rooted = classes.select("cid", "label", "x", "many", "least").join(counts, "cid", "left").join(tied.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes")), "roots")
    ended = joined_classes(rooted, least, ["root"], "classes").select("label", "x", "many", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    ended = written(ended, "classes")
    shown = joined_classes(part, ended, ["label", "x"], "many").select("vec_id", "n_links", "component_id")
    out = shown.union(rows.where("x is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
