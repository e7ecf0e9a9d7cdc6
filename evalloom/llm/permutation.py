"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. In a block of vectors each pivot's inverted file posts the
vectors that have it among their first ``PREFIX`` pivots, with the place. A query walks the files of its own first
``WALK`` pivots and adds up the footrule distance (a missing pivot counts as place ``PREFIX``); the best ``share`` of a
block is reranked by exact inner products in double precision.

Equal vectors form one class, searched once; a class keeps the ids of ``TOP`` + 1 of its rows, the smallest, which is all
that a result can show. Packs of queries stream past the blocks of the index: a task holds one block and one pack. On data without
structure the reranked share needed for a given recall is a constant, so the work is queries times rows over a constant
(README: figures at three sizes); the pivots and the share are parameters.

Defined results: null, zero, non-finite vectors, those with a null component, and null ids take no part, neither as queries
nor as candidates; rows of one id with different vectors are queries and candidates of their own, and only the query's own
row isn't its candidate; repeated rows (same id and vector) count once; vectors of one dimension are searched among
themselves; with fewer candidates than ``TOP`` all are returned; no query gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import merged_lists, streamed, written

TOP = 20
PIVOTS, PREFIX, WALK = 512, 64, 40
SHARE, LEAST = 0.18, 400  # of a block, and vectors at least, that are reranked
BLOCK = 4096  # classes in a block, about; grows with the table up to MOST_BLOCK
MOST_BLOCK = 131_072
QUERIES = 1024  # queries that travel together


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (the vector's doubles as bytes) and size (their number) of the rows that take part."""
    x = F.col(vector)
    usable = df.where(F.col(key).isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0))
    usable = usable.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: c.cast("double")).alias("x"))

    def run(batches):
        for b in batches:
            flat, sizes = b.column("x").flatten().to_numpy() + 0.0, b.column("x").value_lengths().to_numpy()  # -0.0 becomes 0.0
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "v": pa.array([flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()), "size": pa.array(sizes, pa.int32())})

    return usable.mapInArrow(run, "id long, v binary, size int")


def by_dimension(rows: DataFrame, search: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """The results of ``search`` over the rows of each dimension; a table has few."""
    sizes = [r["size"] for r in rows.groupBy("size").count().orderBy(F.desc("count"), "size").toLocalIterator()]
    out = [search(rows.where(F.col("size") == n).select("id", "v")) for n in sizes]
    return functools.reduce(DataFrame.union, out) if out else rows.sparkSession.createDataFrame([], schema)


def classes(rows: DataFrame, keep: int = TOP + 1) -> DataFrame:
    """v, ids (bytes of the smallest ids of ``keep`` rows) for each different vector; tasks reduce their rows before the shuffle."""

    def fold(batches):
        held: dict[bytes, list[int]] = {}
        for b in batches:
            for v, ids in zip(b.column("v").to_pylist(), b.column("ids").to_pylist(), strict=True):
                held.setdefault(v, []).extend(x for part in ids for x in np.frombuffer(part, np.int64).tolist())
            # a vector's list is cut back as it grows, and all go out before they fill memory
            for v, ids in held.items():
                if len(ids) > 4 * keep:
                    held[v] = sorted(ids)[:keep]
            if len(held) > 50_000:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    def out(held):
        return pa.RecordBatch.from_pydict({"v": pa.array(list(held), pa.binary()), "ids": pa.array([np.array(sorted(x)[:keep], np.int64).tobytes() for x in held.values()], pa.binary())})

    def single(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("v"), pa.array([[np.int64(i).tobytes()] for i in b.column("id").to_pylist()], pa.list_(pa.binary()))], ["v", "ids"])

    once = rows.mapInArrow(lambda batches: fold(single(batches)), "v binary, ids binary")
    return once.groupBy("v").agg(F.collect_list("ids").alias("ids")).mapInArrow(fold, "v binary, ids binary")


def block_size(count: int) -> int:
    return int(min(MOST_BLOCK, max(BLOCK, count // 256)))


def places(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest ``prefix`` pivots of each vector in order (largest inner product first, then by number)."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)


class Inverted:
    """The inverted files of one block."""

    def __init__(self, perms: np.ndarray, pivots: int):
        n, self.prefix = perms.shape
        order = np.argsort(perms.ravel(), kind="stable")
        self.rows, self.at = order // self.prefix, (order % self.prefix).astype(np.int32)
        self.edges = np.searchsorted(perms.ravel()[order], np.arange(pivots + 1))
        self.n = n

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Distance of each of the block's vectors from the query's first pivots."""
        out = np.full(self.n, len(query) * self.prefix, np.int32)
        for place, pivot in enumerate(query.tolist()):
            a, b = self.edges[pivot], self.edges[pivot + 1]
            # a vector is posted once in a file, so plain indexing adds
            out[self.rows[a:b]] += np.abs(self.at[a:b] - place) - self.prefix
        return out


def _search(index: dict, queries: np.ndarray, pivots: np.ndarray, walk: int, share: float, keep: int):
    """For each query the places and exact products of the best ``keep`` of the block."""
    vectors, inverted = index["vectors"], index["inverted"]
    perms = places(queries, pivots, walk)
    many = min(len(vectors), max(LEAST, int(share * len(vectors))))
    for q, perm in zip(queries, perms, strict=True):
        d = inverted.footrule(perm)
        near = np.argpartition(d, many - 1)[:many] if many < len(d) else np.arange(len(d))
        score = vectors[near] @ q
        if len(near) > keep:
            edge = np.partition(score, len(score) - keep)[len(score) - keep]
            best = np.nonzero(score >= edge)[0]  # ties stay: ids decide between them later
            near, score = near[best], score[best]
        yield near, score


def _list(score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> bytes:
    """Scores, ids, and whether the vector is the query's, packed."""
    return score.tobytes() + ids.tobytes() + own.astype(np.uint8).tobytes()


def _listed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 17
    return np.frombuffer(data, np.float64, n), np.frombuffer(data, np.int64, n, 8 * n), np.frombuffer(data, np.uint8, n, 16 * n)


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", top: int = TOP, pivots: int = PIVOTS, prefix: int = PREFIX, walk: int = WALK, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each row that ``queries`` (a condition on ``id``) selects.

    The pivots are a sample of ``pivots`` classes by hash (a documented bound); every class is indexed.
    """
    return by_dimension(valid(df, key, vector).distinct(), lambda rows: _search_rows(rows, queries, top, pivots, prefix, walk, share), RESULT)


RESULT = "query_id long, rank int, vec_id long, score double"


def _search_rows(rows: DataFrame, queries: Column, top: int, pivots: int, prefix: int, walk: int, share: float) -> DataFrame:
    keep = top + 1
    table = written(classes(rows, keep), "vector-classes")
    count = table.count()
    share_of = min(1.0, 2 * pivots / max(count, 1))
    sample = table.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share_of * (1 << 30))).select("v").limit(4 * pivots).collect()
    piv = np.stack([np.frombuffer(r["v"]) for r in sorted(sample, key=lambda r: bytes(r["v"]))])
    piv = piv[np.random.default_rng(11).permutation(len(piv))[:pivots]]
    piv = piv / np.linalg.norm(piv, axis=1, keepdims=True)
    prefix, walk = min(prefix, len(piv)), min(walk, len(piv))
    size = block_size(count)
    blocks = max(1, -(-count // size))

    def index(t: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x, np.int64) for x in t.column("ids").to_pylist()]
        vectors = np.frombuffer(b"".join(t.column("v").to_pylist())).reshape(t.num_rows, -1)
        perms = places(vectors, piv, prefix)
        one = lambda x: pa.array([x], pa.binary())
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "perms": one(perms.tobytes()), "vectors": one(vectors.tobytes()), "sizes": one(np.array([len(x) for x in ids], np.int32).tobytes()), "ids": one(np.concatenate(ids).tobytes())})

    dealt = table.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
    indexed = written(dealt.groupBy("block").applyInArrow(index, "block int, perms binary, vectors binary, sizes binary, ids binary"), "permutation-index")

    asked = rows.where(queries)

    def travel(batches):
        for b in batches:
            v = b.column("v").to_pylist()
            for i in range(0, len(v), QUERIES):
                yield pa.RecordBatch.from_pydict({"queries": pa.array([b"".join(v[i : i + QUERIES])], pa.binary())})

    packed = asked.select("v").distinct().mapInArrow(travel, "queries binary")

    def answer(rows):
        for r in rows:
            if r["queries"] is None:
                vectors, inverted = np.frombuffer(r["vectors"]).reshape(-1, piv.shape[1]), Inverted(np.frombuffer(r["perms"], np.int32).reshape(-1, prefix), len(piv))
                ids, sizes = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int32)
                ends = np.cumsum(sizes)
                continue
            q = np.frombuffer(r["queries"]).reshape(-1, piv.shape[1])
            found = []
            for x, (near, score) in zip(q, _search({"vectors": vectors, "inverted": inverted}, q, piv, walk, share, keep), strict=True):
                many = sizes[near]
                member = ids[np.repeat(ends[near] - many, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                value, own = np.repeat(score, many), np.repeat((vectors[near] == x).all(1), many)
                best = np.lexsort((member, -value))[:keep]
                found.append(_list(value[best], member[best], own[best]))
            yield pa.RecordBatch.from_pydict({"v": pa.array([x.tobytes() for x in q], pa.binary()), "block": pa.array([r["block"]] * len(q), pa.int32()), "found": pa.array(found, pa.binary())})

    def merge(parts: list[bytes]) -> bytes:
        score, ids, own = (np.concatenate(x) for x in zip(*map(_listed, parts), strict=True))
        best = np.lexsort((ids, -score))[:keep]
        return _list(score[best], ids[best], own[best])

    def shown(batches):
        for b in batches:
            rows = []
            for q, x in zip(b.column("id").to_pylist(), b.column("found").to_pylist(), strict=True):
                others, gone = [], False
                for s, i, own in zip(*(y.tolist() for y in _listed(x)), strict=True):
                    if own and i == q and not gone:
                        gone = True  # the query's own row
                    else:
                        others.append((s, i))
                rows += [(q, k + 1, i, s) for k, (s, i) in enumerate(others[:top])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])

    best = merged_lists(streamed(indexed, packed, blocks, answer, "v binary, block int, found binary"), blocks, merge)
    return asked.join(best, "v").select("id", "found").mapInArrow(shown, RESULT)


def nearest(embeddings: DataFrame) -> DataFrame:
    """Query form: queries are the rows whose vec_id is divisible by 20."""
    return search(embeddings, F.col("id") % 20 == 0)
